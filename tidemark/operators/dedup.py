"""Removing duplicate rows within a batch and against rows seen before."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.files import path_exists
from tidemark.functions.hashing import hash_columns, row_hash
from tidemark.functions.skew import key_set
from tidemark.names import ROW_HASH, quoted

_DIGEST = "_digest"

# Types whose minimum Spark keeps in a fixed-width buffer, which allows a hash aggregate.
_FIXED_WIDTH = (T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _holds_map(data_type):
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(field.dataType) for field in data_type.fields)
    return False


def _key_columns(df, names):
    """Grouping columns: the values themselves, or their hash where Spark cannot group."""
    if any(_holds_map(df.schema[name].dataType) for name in names):
        return [row_hash(df, names, framed=True).alias("_key")]
    return [_without_nan(df, name).alias(f"_k{i}") for i, name in enumerate(names)]


def _without_nan(df, name):
    """The column; NaN is null in it, as in the row hash."""
    column = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def _order(df, order_by):
    """Total order of rows: the given columns, then a hash of the whole row."""
    given = [F.col(quoted(name)) for name in order_by or []]
    return F.struct(*given, F.xxhash64(*_hashable(df)))


def _hashable(df):
    return [
        row_hash(df, [f.name], framed=True) if _holds_map(f.dataType) else F.col(quoted(f.name))
        for f in df.schema.fields
    ]


def with_row_hash(df, columns=None, algorithm="sha256", framed=False):
    return df.withColumn(ROW_HASH, row_hash(df, columns, algorithm, framed))


def deduplicate(
    df, columns=None, keep="first", order_by=None, algorithm="sha256", framed=False
):
    """One row per distinct value of the hash columns, with its row hash; NaN becomes null.

    ``order_by`` says what first and last mean; without it, and among equal rows, a hash of
    the row decides, so the choice does not depend on how the data is laid out.

    All data columns (and at most one more such as the ingestion time): a hash aggregate on
    the columns. A subset or an order: ``min_by`` / ``max_by`` on the whole row. Both combine on the map side, so a value held by a third of all rows
    reaches the shuffle as one row per task. Rows that only share a joined text are not equal
    and both stay; ``framed=True`` gives them different hashes too.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    if ROW_HASH in df.columns:
        df = df.drop(ROW_HASH)
    names = hash_columns(df, columns)
    df = df.select(
        *[_without_nan(df, name).alias(name) if name in set(names) else F.col(quoted(name))
          for name in df.columns]
    )
    keys = _key_columns(df, names)
    others = [field for field in df.schema.fields if field.name not in set(names)]
    by_value = len(keys) == len(names) and not order_by
    if by_value and not others:
        kept = df.dropDuplicates()
    elif by_value and len(others) == 1 and isinstance(others[0].dataType, _FIXED_WIDTH):
        extreme = F.min if keep == "first" else F.max
        other = others[0].name
        kept = (
            df.groupBy(*[F.col(quoted(name)) for name in names])
            .agg(extreme(F.col(quoted(other))).alias(other))
            .select(*[F.col(quoted(name)) for name in df.columns])
        )
    else:
        pick = F.min_by if keep == "first" else F.max_by
        row = F.struct(*[F.col(quoted(name)) for name in df.columns])
        kept = (
            df.groupBy(*keys)
            .agg(pick(row, _order(df, order_by)).alias("_row"))
            .select("_row.*")
        )
    return with_row_hash(kept, names, algorithm, framed)


def duplicates(df, columns=None, order_by=None, algorithm="sha256", framed=False):
    """All rows but the first of every group of equal hash columns; NaN becomes null.

    Whole rows are counted and not moved: one aggregate gives each different row and its number of
    copies, and the copies but one are made anew. A subset is ranked twice: within (key, input
    split), then among the first row of each split. A hot key is so spread over many tasks, and the
    second ranking sees at most one row per split and key. The split follows the input partition,
    which a repeated task does not change.
    """
    if ROW_HASH in df.columns:
        df = df.drop(ROW_HASH)
    names = hash_columns(df, columns)
    keys = _key_columns(df, names)
    if set(names) == set(df.columns) and len(keys) == len(names):
        return _copies(df, keys, names, algorithm, framed)
    key_names = [f"_k{i}" for i in range(len(keys))]
    prepared = df.select(
        *[F.col(quoted(name)) for name in df.columns],
        *[key.alias(alias) for key, alias in zip(keys, key_names)],
        _order(df, order_by).alias("_order"),
        F.spark_partition_id().alias("_split"),
    )
    within = Window.partitionBy(*key_names, "_split").orderBy("_order")
    ranked = prepared.withColumn("_rank", F.row_number().over(within))
    # Second ranking in the same plan, so nothing is read twice: the leaders of a key form
    # one window group, the known duplicates stay in their small groups.
    group = F.when(F.col("_rank") > 1, F.col("_split"))
    among = Window.partitionBy(*key_names, group).orderBy("_order")
    rest = ranked.withColumn("_lead", F.row_number().over(among)).filter(
        (F.col("_rank") > 1) | (F.col("_lead") > 1)
    )
    rows = rest.select(*[F.col(quoted(name)) for name in df.columns])
    return with_row_hash(rows, names, algorithm, framed)


#: Copies that one task makes of one row; a row with more is dealt to several tasks first.
COPIES_AT_ONCE = 10_000


def _copies(df, keys, names, algorithm, framed):
    """Each different row as often as it is repeated.

    The aggregate combines on the map side, so a row that makes up a third of the table leaves each
    task once. Its copies are made by as many tasks as their number asks for.
    """
    values = {name: key for name, key in zip(names, keys)}
    counted = (
        df.groupBy(*[values[name].alias(name) for name in df.columns])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .withColumn("_copies", F.col("_copies") - 1)
    )
    # The hash once for each different row.
    hashed = with_row_hash(counted, names, algorithm, framed)
    few = hashed.where(F.col("_copies") <= COPIES_AT_ONCE)
    rounds = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES_AT_ONCE))
    many = hashed.where(F.col("_copies") > COPIES_AT_ONCE).withColumn("_round", F.explode(rounds))
    left = F.col("_copies") - F.col("_round") * COPIES_AT_ONCE
    many = many.withColumn("_copies", F.least(left, F.lit(COPIES_AT_ONCE).cast("bigint")))
    many = many.drop("_round").hint("rebalance")
    made = [
        part.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        for part in (few, many)
    ]
    columns = [*[F.col(quoted(name)) for name in df.columns], F.col(ROW_HASH)]
    return made[0].select(*columns).unionAll(made[1].select(*columns))


def drop_known(df, known, large_ledger=False):
    """Rows whose hash is not in ``known``.

    A plain anti-join by digest, half the bytes of its hex text: Spark broadcasts the known ones
    only when their size is below the broadcast threshold, and shuffles both sides otherwise. After
    ``deduplicate`` every hash occurs once; without it, hot hashes are split by adaptive execution.

    ``large_ledger=True`` suits a batch that is small against all that is known: first the
    known hashes that occur in the batch are found. With a batch below the broadcast threshold
    that is one scan of the ledger without a shuffle, and what goes on is no larger than the
    batch. The batch is read twice for it, or once where it comes out of a shuffle that Spark
    uses again. ``HashLedger.drop_known`` also leaves out the folders that the batch cannot hold.
    """
    known = known.select(F.unhex(ROW_HASH).alias(_DIGEST))
    if large_ledger:
        digests = df.select(_digest_or_empty().alias(_DIGEST))
        known = known.join(key_set(digests, _DIGEST), _DIGEST, "left_semi")
    return _without(df, known)


def _digest_or_empty():
    return F.coalesce(F.unhex(ROW_HASH), F.lit(bytearray()))


def _without(df, known):
    """Rows whose digest is not among the known ones; rows without a hash are not known.

    The hex text of a hash is twice its digest and is written anew after the join; only a text that
    is not that of its digest travels with the row.
    """
    digest = F.unhex(ROW_HASH)
    other = F.when(~F.col(ROW_HASH).eqNullSafe(F.lower(F.hex(digest))), F.col(ROW_HASH))
    rows = df.withColumns({_DIGEST: digest, ROW_HASH: other})
    left = rows.join(key_set(known, _DIGEST), _DIGEST, "left_anti")
    text = F.coalesce(F.col(ROW_HASH), F.lower(F.hex(_DIGEST)))
    return left.withColumn(ROW_HASH, text).select(*[F.col(quoted(name)) for name in df.columns])


def drop_duplicates_native(df, subset=None):
    """Spark's own ``dropDuplicates``; which row of a subset group stays is open."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def duplicate_statistics(df, columns=None):
    """One row: rows before and after, rows removed, removed fraction."""
    names = hash_columns(df, columns)
    groups = df.groupBy(*_key_columns(df, names)).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n"), F.lit(0))
    after = F.count(F.lit(1))
    return groups.agg(
        before.alias("original_rows"),
        after.alias("deduplicated_rows"),
        (before - after).alias("duplicates_removed"),
        F.coalesce(F.try_divide(before - after, before), F.lit(0.0)).alias(
            "duplicate_fraction"
        ),
    )


class HashLedger:
    """Digests seen so far, in folders by label and by the first bits of the digest.

        <path>/label=<label>/prefix=<two hex digits>/*.parquet     digest, source

    A small batch opens only the folders whose digits occur in it. Labels are added, never changed
    in place; ``source`` says which batch a digest came with, where that matters.
    """

    _schema = T.StructType(
        [
            T.StructField("digest", T.BinaryType()),
            T.StructField("source", T.LongType()),
            T.StructField("label", T.StringType()),
            T.StructField("prefix", T.StringType()),
        ]
    )

    def __init__(self, spark, path):
        self.spark = spark
        self.path = path.rstrip("/")

    def digests(self):
        """``digest``, ``source``, ``label`` and ``prefix`` of everything that was added."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self._schema)
        reader = self.spark.read.schema(self._schema).option("basePath", self.path)
        return reader.parquet(self.path)

    def hashes(self):
        """The same as hex text under the name of stored row hashes."""
        return self.digests().select(F.lower(F.hex("digest")).alias(ROW_HASH))

    def holds(self, label):
        """Whether a label was added completely."""
        return path_exists(self.spark, f"{self.path}/label={label}/_SUCCESS")

    def add(self, df, batch, source=None):
        """Add the hashes of ``df`` under a batch label; the same label again replaces it.

        ``source`` names a column that goes with each hash. Copies combine before the shuffle; rows
        without a hash are left out. A folder that holds most of the digests is split over files.
        """
        given = F.lit(None) if source is None else F.col(quoted(source))
        rows = df.where(F.col(ROW_HASH).isNotNull()).select(
            F.unhex(ROW_HASH).alias("digest"),
            given.cast("bigint").alias("source"),
            F.lower(F.substring(ROW_HASH, 1, 2)).alias("prefix"),
        )
        target = f"{self.path}/label={batch}"
        rows.distinct().hint("rebalance", "prefix").write.mode("overwrite").partitionBy(
            "prefix"
        ).parquet(target)

    def drop_known(self, df, *known):
        """Rows of ``df`` whose hash the ledger does not hold.

        ``known`` are the frames of ``prefix`` and ``digest`` that count instead of all. The digests and digits of ``df`` are looked up in
        the ledger first: where they can be broadcast, Spark prunes the folders by them while the
        query runs; a batch beyond that is joined by shuffles. What goes on is no larger than ``df``.
        """
        # Filters on the hash, also those for null that a join brings, would go down to the rows as they
        # are read, and all that makes the hash would be done there once more for every row. So neither
        # column is null; rows without a hash look up an empty one and are not known all the same.
        prefix = F.coalesce(F.lower(F.substring(ROW_HASH, 1, 2)), F.lit(""))
        wanted = df.groupBy(prefix.alias("prefix"), _digest_or_empty().alias("digest"))
        # Spark prunes partitions only by a side that it expects to be selective, so one with a filter.
        wanted = wanted.agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")
        met = [
            frame.join(wanted, ["prefix", "digest"], "left_semi").select(F.col("digest").alias(_DIGEST))
            for frame in known or [self.digests()]
        ]
        met = reduce(lambda a, b: a.unionAll(b), met)
        return _without(df, met)

    def count(self):
        return self.digests().select("digest").distinct().count()

    def at(self, path):
        """A new, empty ledger elsewhere; clearing never changes the files of the old one."""
        return HashLedger(self.spark, path)
