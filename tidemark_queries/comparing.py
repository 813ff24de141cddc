"""Differences between two versions, and column profiles."""

from pyspark.sql import functions as F

from tidemark.operators import diff as D
from tidemark.operators import frequent
from tidemark.operators import profile as P
from tidemark.operators import statistics as S
from tidemark_queries.cleaning import TEXTS, number_texts
from tidemark_queries.hashing import DUPLICATED, NULLED, duplicated, nulled
from tidemark_queries.registry import LINEITEM, ORDERS, query, sql_hash, table

# Two versions of orders: some rows only in the first, some only in the second, some changed.
BEFORE = "(select * from orders where o_orderpriority <> '1-URGENT')"
AFTER = """(select o_orderkey, o_custkey, o_orderstatus,
                   case when o_orderpriority = '5-LOW' then o_totalprice * 1.5
                        else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority
            from orders where o_orderstatus <> 'F')"""
OLD = f"(select distinct {sql_hash(ORDERS)} as h from {BEFORE})"
NEW = f"(select distinct {sql_hash(ORDERS)} as h from {AFTER})"


def before(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'")


def after(spark, sf_dir):
    price = F.col("o_totalprice")
    low = F.col("o_orderpriority") == "5-LOW"
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderstatus <> 'F'")
        .withColumn("o_totalprice", F.when(low, price * 1.5).otherwise(price))
    )


def after_other_schema(spark, sf_dir):
    return (
        after(spark, sf_dir)
        .withColumn("o_custkey", F.col("o_custkey").cast("string"))
        .withColumn("o_note", F.when(F.col("o_orderstatus") == "O", F.lit("open")))
        .drop("o_orderpriority")
    )


@query(
    "d1_schema_diff",
    f"""select 'added' as change, 'o_note' as "column", '-' as type_before,
               'string' as type_after, 0 as filled_before,
               count(*) filter (where o_orderstatus = 'O') as filled_after from {AFTER}
        union all select 'removed', 'o_orderpriority', 'string', '-', count(*), 0 from {BEFORE}
        union all select 'type_changed', 'o_custkey', 'bigint', 'string', count(*),
                         (select count(*) from {AFTER}) from {BEFORE}""",
)
def schema_diff(spark, sf_dir):
    """Changed columns, with the number of values that each side holds in them."""
    old, new = before(spark, sf_dir), after_other_schema(spark, sf_dir)

    def filled(df, name):
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        return counts.unpivot([], df.columns, "column", name)

    changes = D.schema_diff(old, new)
    joined = changes.join(filled(old, "filled_before"), "column", "left").join(
        filled(new, "filled_after"), "column", "left"
    )
    return joined.fillna({"type_before": "-", "type_after": "-"}).fillna(
        0, ["filled_before", "filled_after"]
    )


ROW_DIFF = f"""select (select count(*) from {NEW} n where h not in (select h from {OLD}))
                   as rows_added,
               (select count(*) from {OLD} o where h not in (select h from {NEW}))
                   as rows_removed,
               (select count(*) from {OLD} o where h in (select h from {NEW}))
                   as rows_unchanged,
               (select count(*) from {BEFORE}) as rows_total_before,
               (select count(*) from {AFTER}) as rows_total_after"""


@query(
    "d2_row_diff",
    f"""with a as (select distinct {sql_hash(LINEITEM)} as h from {DUPLICATED}),
             b as (select distinct {sql_hash(LINEITEM)} as h from lineitem
                   where l_linestatus = 'O')
        select 0::bigint as rows_added,
               (select count(*) from a where h not in (select h from b)) as rows_removed,
               (select count(*) from b) as rows_unchanged,
               (select count(*) from {DUPLICATED}) as rows_total_before,
               (select count(*) from lineitem where l_linestatus = 'O') as rows_total_after""",
)
def row_diff(spark, sf_dir):
    open_lines = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    return D.row_diff(duplicated(spark, sf_dir), open_lines).drop("change_rate")


@query(
    "d3_change_rate",
    f"""select *, round((rows_added + rows_removed) / rows_total_before, 6) as change_rate
        from ({ROW_DIFF})""",
)
def change_rate(spark, sf_dir):
    found = D.row_diff(before(spark, sf_dir), after(spark, sf_dir))
    return found.withColumn("change_rate", F.round("change_rate", 6))


KEYED = ["o_orderkey", "o_orderdate"]


@query(
    "d4_hash_source",
    f"""with a as (select distinct {sql_hash(KEYED)} as h from {BEFORE}),
             b as (select distinct {sql_hash(KEYED)} as h from {AFTER})
        select 'named' as hashed, (select count(*) from b where h not in (select h from a))
                   as rows_added,
               (select count(*) from a where h not in (select h from b)) as rows_removed
        union all
        select 'stored', (select count(*) from {NEW} n where h not in (select h from {OLD})),
               (select count(*) from {OLD} o where h not in (select h from {NEW}))""",
)
def hash_source(spark, sf_dir):
    """Named columns across different schemas; a stored hash against one computed here."""
    from tidemark.operators.dedup import with_row_hash

    old, new = before(spark, sf_dir), after(spark, sf_dir)
    named = D.row_diff(old, after_other_schema(spark, sf_dir), columns=KEYED)
    stored = D.row_diff(with_row_hash(old), new)
    columns = ["hashed", "rows_added", "rows_removed"]
    return (
        named.withColumn("hashed", F.lit("named"))
        .select(*columns)
        .unionAll(stored.withColumn("hashed", F.lit("stored")).select(*columns))
    )


@query(
    "d5_added_rows",
    f"select * from {AFTER} where {sql_hash(ORDERS)} not in (select h from {OLD})",
)
def added_rows(spark, sf_dir):
    return D.rows_only_in(after(spark, sf_dir), before(spark, sf_dir))


@query(
    "d5_removed_rows",
    f"select * from {BEFORE} where {sql_hash(ORDERS)} not in (select h from {NEW})",
)
def removed_rows(spark, sf_dir):
    return D.rows_only_in(before(spark, sf_dir), after(spark, sf_dir))


@query(
    "d5_unchanged_rows",
    f"select * from {BEFORE} where {sql_hash(ORDERS)} in (select h from {NEW})",
)
def unchanged_rows(spark, sf_dir):
    return D.rows_in_both(before(spark, sf_dir), after(spark, sf_dir))


def _each(names, row, source):
    return " union all ".join(f"select '{n}' as \"column\", {row(n)} from {source}" for n in names)


@query(
    "d6_null_profile",
    _each(
        ["event_id", "ts", "user_id", "event_type", "value", "props"],
        lambda n: f"""count(*) as rows, count(*) - count({n}) as null_count,
                      round(1 - count({n}) / count(*), 6) as null_fraction""",
        NULLED,
    ),
)
def null_profile(spark, sf_dir):
    found = P.profile(nulled(spark, sf_dir), unique=None)
    return found.select(
        "column", "rows", "null_count", F.round("null_fraction", 6).alias("null_fraction")
    )


@query(
    "d7_unique_counts",
    _each(LINEITEM, lambda n: f"count(distinct {n}) as unique_count", "lineitem"),
)
def unique_counts(spark, sf_dir):
    found = P.profile(table(spark, sf_dir, "lineitem"))
    return found.select("column", "unique_count")


@query(
    "d7_unique_counts_of_texts",
    _each(
        ["event_id", "few_bad", "many_bad", "whole"],
        lambda n: f"count(distinct {n}) as unique_count",
        "(select case when user_id < 20 then event_id end as event_id, few_bad, many_bad,"
        f" whole from {TEXTS})",
    ),
)
def unique_counts_of_texts(spark, sf_dir):
    events = number_texts(spark, sf_dir).drop("user_id").withColumn(
        "event_id", F.when(F.col("whole").cast("int") < 20, F.col("event_id"))
    )
    return P.profile(events).select("column", "unique_count")


@query(
    "d7_unique_counts_of_many_values",
    _each(
        ["order_key", "quantity", "ship_date"],
        lambda n: f"count(distinct {n}) as unique_count",
        "(select l_orderkey + 10000000 * k as order_key, l_quantity * (k + 1) as quantity,"
        " l_shipdate as ship_date from lineitem, range(4) t(k))",
    ),
)
def unique_counts_of_many_values(spark, sf_dir):
    """More non-null values than any small table has: the lines four times, with shifted keys."""
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "k", F.explode(F.array(*[F.lit(i) for i in range(4)]))
    )
    many = lines.select(
        (F.col("l_orderkey") + F.lit(10_000_000) * F.col("k")).alias("order_key"),
        (F.col("l_quantity") * (F.col("k") + 1)).alias("quantity"),
        F.col("l_shipdate").alias("ship_date"),
    )
    return P.profile(many).select("column", "unique_count")


SKETCHED = ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag"]


@query(
    "d7_united_unique_estimates",
    _each(
        SKETCHED,
        lambda n: f"""count(*) as rows, count(distinct {n}) as unique_count,
                      true as equals_direct, true as within_bound""",
        "lineitem",
    ),
)
def united_unique_estimates(spark, sf_dir):
    """Sketches of the lines of each status and flag, united, against one sketch of all lines.

    The bound is five standard errors; the exact counts stand beside the estimates.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.withColumn("part", F.concat("l_linestatus", "l_returnflag"))
    united = S.profile_of(S.united(S.column_states(parts, SKETCHED, by=("part",))))
    direct = S.profile_of(S.column_states(lines, SKETCHED)).select(
        "column", F.col("unique_count").alias("direct")
    )
    exact = lines.agg(*[F.count_distinct(n).alias(n) for n in SKETCHED])
    exact = exact.unpivot([], SKETCHED, "column", "exact")
    error = F.abs(F.col("unique_count") - F.col("exact")) / F.col("exact")
    return united.join(direct, "column").join(exact, "column").select(
        "column",
        "rows",
        F.col("exact").alias("unique_count"),
        (F.col("unique_count") == F.col("direct")).alias("equals_direct"),
        (error <= 5 * 1.04 / 2 ** (S.REGISTERS / 2)).alias("within_bound"),
    )


@query(
    "d8_united_numeric_profile",
    _each(
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber"],
        lambda n: f"""count(*) as rows, min({n})::double as min_value, max({n})::double as max_value,
                      round(avg({n}), 4) as mean_value, round(stddev_samp({n}), 4) as std_value""",
        "lineitem",
    ),
)
def united_numeric_profile(spark, sf_dir):
    """Counts, means and squared deviations of the lines of each ship date, united."""
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag"]
    states = S.column_states(table(spark, sf_dir, "lineitem"), names, by=("l_shipdate",))
    return S.profile_of(S.united(states)).where("is_numeric").select(
        "column", "rows", "min_value", "max_value",
        F.round("mean_value", 4).alias("mean_value"),
        F.round("std_value", 4).alias("std_value"),
    )


@query(
    "d8_numeric_profile",
    _each(
        [
            "l_orderkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_linenumber",
        ],
        lambda n: f"""min({n})::double as min_value, max({n})::double as max_value,
                      round(avg({n}), 4) as mean_value, round(stddev_samp({n}), 4) as std_value""",
        "lineitem",
    ),
)
def numeric_profile(spark, sf_dir):
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    found = P.profile(table(spark, sf_dir, "lineitem"), [*names, "l_returnflag"], unique=None)
    return found.filter("is_numeric").select(
        "column",
        "min_value",
        "max_value",
        F.round("mean_value", 4).alias("mean_value"),
        F.round("std_value", 4).alias("std_value"),
    )


@query(
    "d8_text_and_time_profile",
    f"""select 'few_bad' as "column", true as is_numeric,
               round(avg(try_cast(few_bad as double)), 4) as mean_value,
               round(max(try_cast(few_bad as double)), 4) as max_value,
               timestamp '1970-01-01' as max_time from {TEXTS}
        union all select 'many_bad', false, -1, -1, timestamp '1970-01-01' from {TEXTS} group by 2
        union all select 'ts', false, -1, -1, (select max(ts) from events)""",
)
def text_and_time_profile(spark, sf_dir):
    texts = number_texts(spark, sf_dir).join(
        table(spark, sf_dir, "events").select("event_id", "ts"), "event_id"
    )
    found = P.profile(texts, ["few_bad", "many_bad", "ts"], unique=None)
    return found.select(
        "column",
        "is_numeric",
        F.coalesce(F.round("mean_value", 4), F.lit(-1.0)).alias("mean_value"),
        F.coalesce(F.round("max_value", 4), F.lit(-1.0)).alias("max_value"),
        F.coalesce("max_time", F.lit("1970-01-01").cast("timestamp")).alias("max_time"),
    )


def _top(names, source):
    parts = " union all ".join(
        f"""(select '{n}' as "column", {n} as value, count(*) as count,
                    row_number() over (order by count(*) desc, {n}) as rank
             from {source} where {n} is not null group by {n})"""
        for n in names
    )
    return f"select * replace (rank::integer as rank) from ({parts}) where rank <= 5"


@query("d9_top_values", _top(["text", "lang", "source"], "documents"))
def top_values(spark, sf_dir):
    return P.top_values(table(spark, sf_dir, "documents"))


SPREAD = ["l_returnflag", "l_quantity", "l_shipdate", "l_partkey", "l_orderkey"]


@query("d9_frequent_values", _top(SPREAD, f"(select {', '.join(f'{n}::varchar as {n}' for n in SPREAD)} from lineitem)"))
def frequent_values(spark, sf_dir):
    """Columns of few values, which summaries prove, and of many even ones, which they cannot."""
    lines = table(spark, sf_dir, "lineitem")
    return frequent.frequent_values(lines, SPREAD, tracked=200)


@query("d9_top_values_lineitem", _top(["l_returnflag", "l_linestatus"], "lineitem"))
def top_values_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return P.top_values_of_non_numeric(lines, P.profile(lines, unique=None))


def _delta(n, figures):
    a, b = f"(select * from {BEFORE})", f"(select * from {AFTER})"
    return "select '{0}' as \"column\", {1} from (select {2} from {3}) a, (select {2} from {4}) b".format(
        n, figures, f"count(distinct {n}) as u, avg({n}) as m, stddev_samp({n}) as s", a, b
    )


NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(
    "d10_column_deltas",
    " union all ".join(
        _delta(
            n,
            """0 as null_fraction_delta, b.u - a.u as unique_count_delta,
               round(b.m - a.m, 4) as mean_delta, round(b.s - a.s, 4) as std_delta""",
        )
        for n in NUMERIC
    ),
)
def column_deltas(spark, sf_dir):
    deltas = D.column_deltas(before(spark, sf_dir), after(spark, sf_dir))
    return deltas.filter(F.col("column").isin(*NUMERIC)).select(
        "column",
        F.round("null_fraction_delta", 6).cast("int").alias("null_fraction_delta"),
        "unique_count_delta",
        F.round("mean_delta", 4).alias("mean_delta"),
        F.round("std_delta", 4).alias("std_delta"),
    )


@query(
    "d11_significance",
    " union all ".join(
        _delta(n, "abs(b.m - a.m) / greatest(abs(a.m), 1e-9) > 0.1 as is_significant")
        for n in NUMERIC
    ),
)
def significance(spark, sf_dir):
    deltas = D.column_deltas(before(spark, sf_dir), after(spark, sf_dir), unique=None)
    return deltas.filter(F.col("column").isin(*NUMERIC)).select("column", "is_significant")


@query(
    "d11_null_significance",
    f"""select 'event_type' as "column",
               avg((event_type is null)::int) > 0.05 as is_significant from {NULLED}
        union all select 'value', avg((value is null)::int) > 0.05 from {NULLED}""",
)
def null_significance(spark, sf_dir):
    deltas = D.column_deltas(table(spark, sf_dir, "events"), nulled(spark, sf_dir), None)
    return deltas.filter("column in ('event_type', 'value')").select("column", "is_significant")


@query(
    "d12_breaking_changes",
    f"""select 'same' as compared, false as has_breaking_changes, count(*) as rows from {AFTER}
        union all select 'retyped', true, count(*) from {AFTER}""",
)
def breaking_changes(spark, sf_dir):
    old = before(spark, sf_dir)
    found = []
    for name, new in (
        ("same", after(spark, sf_dir)),
        ("retyped", after_other_schema(spark, sf_dir)),
    ):
        flag = D.has_breaking_changes(old, new)
        found.append(
            new.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("compared"), F.lit(flag).alias("has_breaking_changes"), "rows"
            )
        )
    return found[0].unionAll(found[1])


SIGNIFICANT = " union all ".join(
    _delta(n, "abs(b.m - a.m) / greatest(abs(a.m), 1e-9) > 0.1 as moved") for n in NUMERIC
)


@query(
    "d13_diff_report",
    f"""select 'orders' as dataset, 'v1' as version_before, 'v2' as version_after,
               '' as added_columns, '' as removed_columns, '' as type_changed,
               (select coalesce(string_agg("column", ',' order by "column"), '')
                from ({SIGNIFICANT}) where moved) as significant_columns, *,
               round((rows_added + rows_removed) / rows_total_before, 4) as change_rate,
               false as has_breaking_changes
        from ({ROW_DIFF})""",
)
def diff_report(spark, sf_dir):
    return D.diff_report(before(spark, sf_dir), after(spark, sf_dir), "orders", "v1", "v2")


@query(
    "d15_preview_profile",
    _each(
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        lambda n: f"""case when '{n}' in ('p_name', 'p_brand', 'p_type') then 'string'
                           when '{n}' = 'p_size' then 'int'
                           when '{n}' = 'p_partkey' then 'bigint' else 'double' end as type,
                      round(100 * (1 - count({n}) / count(*)), 1) as null_percent,
                      count(distinct {n}) as unique_count""",
        "part",
    ),
)
def preview_profile(spark, sf_dir):
    found = P.profile(table(spark, sf_dir, "part"))
    percent = F.round(100 * F.col("null_fraction"), 1).alias("null_percent")
    return found.select("column", "type", percent, "unique_count")


@query(
    "d16_type_distribution",
    """select 'bigint' as base_type, 1::bigint as columns, count(vec_id) as filled from embeddings
       union all select 'array', 1, count(embedding) from embeddings
       union all select 'int', 1, count(label) from embeddings""",
)
def type_distribution(spark, sf_dir):
    """Columns per base type, with the number of values they hold."""
    vectors = table(spark, sf_dir, "embeddings")
    base = F.regexp_extract("type", r"^[^\[(<]*", 0).alias("base_type")
    filled = (
        P.profile(vectors, unique=None)
        .select(base, (F.col("rows") - F.col("null_count")).alias("filled"))
        .groupBy("base_type")
        .agg(F.sum("filled").alias("filled"))
    )
    return P.type_distribution(vectors).join(filled, "base_type")
