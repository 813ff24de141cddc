"""Most frequent values from bounded summaries, exactly.

Each task keeps a bounded number of counters for each column and, when they run out, lowers all by the
count of the first one that no longer fits (Misra and Gries). A value without a counter has so occurred
no more often than the counters were lowered, and the same holds after the tasks' counters are added
and cut again. The values with counters are then counted exactly in a second pass. If the n-th of them
occurs more often than any value without a counter can, they are the answer; columns where that is not
so, as their values are spread too evenly, are counted in full.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.names import data_columns, quoted
from tidemark.operators.profile import top_values

#: Counters of a column, in every task and after the merge.
TRACKED = 1000


def text_columns(df):
    return [n for n in data_columns(df) if isinstance(df.schema[n].dataType, T.StringType)]


def _lowered(keys, counts, tracked):
    """The ``tracked`` largest counters, lowered by the next one; and by how much."""
    if len(keys) <= tracked:
        return keys, counts, 0
    low = int(np.partition(counts, len(counts) - tracked - 1)[len(counts) - tracked - 1])
    kept = counts > low
    return keys[kept], counts[kept] - low, low


def _added(keys, counts):
    every, place = np.unique(keys, return_inverse=True)
    return every, np.bincount(place, weights=counts, minlength=len(every)).astype(np.int64)


def summaries(df, columns, tracked=TRACKED):
    """``i``, ``key``, ``count``: one row for each counter of each task, and a null key for what the
    task lowered its counters by. ``i`` is the place of the column, ``key`` the hash of the value."""
    hashes = [
        F.when(F.col(quoted(name)).isNotNull(), F.xxhash64(F.col(quoted(name)).cast("string"))).alias(f"h{i}")
        for i, name in enumerate(columns)
    ]
    schema = pa.schema([("i", pa.int32()), ("key", pa.int64()), ("count", pa.int64())])

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0) for _ in columns]
        for batch in batches:
            for i, (keys, counts, low) in enumerate(held):
                seen, n = np.unique(batch.column(i).drop_null().to_numpy(), return_counts=True)
                keys, counts = _added(np.concatenate([keys, seen]), np.concatenate([counts, n]))
                keys, counts, more = _lowered(keys, counts, tracked)
                held[i] = keys, counts, low + more
        for i, (keys, counts, low) in enumerate(held):
            key = pa.array(np.append(keys, 0), mask=np.append(np.zeros(len(keys), bool), True))
            place = np.full(len(keys) + 1, i, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), key, pa.array(np.append(counts, low))], schema=schema)

    return df.select(*hashes).mapInArrow(run, "i int, key long, count long")


def candidates(df, columns, tracked=TRACKED):
    """``i``, ``key`` of at most ``tracked`` values of each column, and ``missed``: no other value of
    the column occurs more often than that. Each column has a row with a null key as well."""
    merged = summaries(df, columns, tracked).groupBy("i", "key").agg(F.sum("count").alias("count"))
    lowered = F.sum(F.when(F.col("key").isNull(), F.col("count"))).over(Window.partitionBy("i"))
    order = Window.partitionBy("i", F.col("key").isNull()).orderBy(F.desc("count"), "key")
    ranked = merged.select("i", "key", "count", lowered.alias("low"), F.row_number().over(order).alias("rank"))
    ranked = ranked.where(F.col("rank") <= tracked + 1)
    cut = F.max(F.when(F.col("rank") > tracked, F.col("count"))).over(Window.partitionBy("i"))
    missed = F.col("low") + F.coalesce(cut, F.lit(0))
    return ranked.withColumn("missed", missed).where(F.col("rank") <= tracked).select("i", "key", "missed")


def proven_values(df, columns=None, n=5, tracked=TRACKED):
    """``column, value, count, rank`` of the columns whose summaries prove them, and these columns.

    The candidates are at most ``tracked`` for each column, so they are collected and sent to the
    recount whatever the table's size; only the counts of candidates are shuffled.
    """
    columns = list(columns) if columns is not None else text_columns(df)
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column string, value string, count bigint, rank int")
    if not columns:
        return empty, []
    found = candidates(df, columns, tracked).toArrow()
    missed = dict(zip(found["i"].to_pylist(), found["missed"].to_pylist(), strict=True))
    pairs = zip(found["i"].to_pylist(), found["key"].to_pylist(), strict=True)
    pairs = [(i, key) for i, key in pairs if key is not None]
    keys = F.broadcast(spark.createDataFrame(pairs, "i int, key long"))
    values = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col(quoted(name)).cast("string").alias("value"))
            for i, name in enumerate(columns)
        ]
    )
    rows = df.select(F.inline(values)).where("value IS NOT NULL").withColumn("key", F.xxhash64("value"))
    counts = rows.join(keys, ["i", "key"], "left_semi").groupBy("i", "value").count()
    order = Window.partitionBy("i").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    names = F.create_map(*[F.lit(x) for i, name in enumerate(columns) for x in (i, name)])
    best = ranked.select(names[F.col("i")].alias("column"), "value", "count", "rank", "i")
    best = best.toArrow()  # n rows for each column
    held = {}
    for i, count in zip(best["i"].to_pylist(), best["count"].to_pylist(), strict=True):
        held.setdefault(i, []).append(count)
    proven = [
        name
        for i, name in enumerate(columns)
        if not missed.get(i) or (len(held.get(i, ())) == n and min(held[i]) > missed[i])
    ]
    best = spark.createDataFrame(best.drop_columns(["i"]).to_pandas(), empty.schema) if best.num_rows else empty
    return best.where(F.col("column").isin(proven)), proven


def frequent_values(df, columns=None, n=5, tracked=TRACKED):
    """The ``n`` most frequent values of each column, exactly; ties go to the smaller value.

    Columns that the summaries cannot prove are counted in full, by ``top_values``.
    """
    columns = list(columns) if columns is not None else text_columns(df)
    best, proven = proven_values(df, columns, n, tracked)
    rest = [name for name in columns if name not in proven]
    return best.unionByName(top_values(df, rest, n)) if rest else best
