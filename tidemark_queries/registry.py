"""Registration of the queries of this repository and the SQL that states the same result."""

from tidemark.functions.files import shared_dir
from tidemark.functions.hashing import NULL_TOKEN, SEPARATOR

QUERIES, ORACLES = {}, {}


def query(key, sql=None):
    """Register ``function(spark, sf_dir) -> DataFrame`` under ``key``."""

    def add(function):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_built = {}


def once(build):
    """Build a stored dataset once per session and data folder."""

    def get(spark, sf_dir):
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _built:
            _built[key] = build(spark, sf_dir)
        return _built[key]

    return get


_runs = [0]


def fresh_dir(spark, name):
    """A folder for one run's output, on storage that every executor reaches."""
    _runs[0] += 1
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/queries/{app}/{name}-{_runs[0]}"


# --- the same expressions in SQL ------------------------------------------------------


def sql_text(columns):
    parts = ", ".join(f"coalesce(cast({c} as varchar), '{NULL_TOKEN}')" for c in columns)
    return f"concat_ws('{SEPARATOR}', {parts})"


def sql_framed(columns):
    parts = [
        f"coalesce('{len(c)}:{c}' || length(cast({c} as varchar)) || ':' || cast({c} as varchar), '')"
        for c in sorted(columns)
    ]
    return " || ".join(parts)


def sql_hash(columns):
    return f"sha256({sql_text(columns)})"


def sql_stored_hash(columns):
    """The hash that stored rows carry."""
    return f"sha256({sql_framed(columns)})"


def sql_checksum(hash_column):
    """Sums of the four groups of 16 hex digits; DuckDB reads hex text with the prefix 0x."""
    groups = ", ".join(
        f"cast(sum(cast(('0x' || substr({hash_column}, {at}, 16)) as hugeint)) as varchar)"
        for at in range(1, 65, 16)
    )
    return f"concat_ws('-', {groups})"


LINEITEM = [
    "l_discount",
    "l_extendedprice",
    "l_linenumber",
    "l_linestatus",
    "l_orderkey",
    "l_partkey",
    "l_quantity",
    "l_returnflag",
    "l_shipdate",
    "l_suppkey",
    "l_tax",
]
ORDERS = [
    "o_custkey",
    "o_orderdate",
    "o_orderkey",
    "o_orderpriority",
    "o_orderstatus",
    "o_totalprice",
]
EVENTS = ["event_id", "event_type", "props", "ts", "user_id", "value"]
