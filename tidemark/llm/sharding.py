"""Shards of near equal size by longest-processing-time scheduling of whole groups.

Rows with equal texts stay together. Groups go, largest first, to the shard with the least load,
which a heap finds. The heap runs on the driver over a bounded number of units:

* a group that holds at least ``1 / (shards * FINE)`` of all bytes is a unit of its own, so there
  are at most ``shards * FINE`` of these;
* all other groups are bundled by their hash, 99 of 100 into ``COARSE`` bundles and the rest into
  ``SMALL`` much smaller ones, which come last and level the shards out.

The law is the same for any number of rows; on small tables nearly every group is its own unit.
"""

import heapq

from pyspark.sql import functions as F

from tidemark.llm.shared import gapless

FINE, COARSE, SMALL = 256, 8192, 4096


def schedule(sizes, shards):
    """Shard of each unit: (size, name) pairs, largest first, each to the least loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, name in sorted(sizes, key=lambda unit: (-unit[0], unit[1])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        placed[name] = shard
    return placed


def shard_documents(docs, shards=40, overhead=16, id_column="doc_id", text_column="text"):
    """Deal rows into shards whose byte sizes are near equal, equal texts together.

    Returns ``row`` (a struct of all given columns but the text), ``size`` (UTF-8 bytes of the text
    plus ``overhead``), ``text_crc32``, ``shard`` and ``slot``, the row's place in its shard from 0
    without gaps, in the order of ids. A null text counts as the empty one. Rows without an id come
    first in their shard; repeated rows get slots of their own.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(id_column).alias("_order"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.xxhash64(text, F.lit("again")).alias("_again"),
    )
    coarse, small = F.pmod("_key", F.lit(COARSE)), COARSE + F.pmod("_key", F.lit(SMALL))
    bundle = F.when(F.pmod("_again", F.lit(100)) == 0, small).otherwise(coarse)
    rows = rows.withColumn("_bundle", bundle.cast("int"))

    groups = rows.groupBy("_key", "_again", "_bundle").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") * shards * FINE >= total
    units = groups.groupBy(
        F.when(heavy, F.col("_key")).alias("key"),
        F.when(heavy, F.col("_again")).alias("again"),
        F.when(~heavy, F.col("_bundle")).alias("bundle"),
    ).agg(F.sum("bytes").alias("bytes"))
    # At most shards * FINE + COARSE + SMALL rows, by the definition of heavy.
    named = [(u.bytes, (u.key or 0, u.again or 0, -1 if u.bundle is None else u.bundle)) for u in units.collect()]
    placed = schedule(named, shards)

    spark = docs.sparkSession
    own = [(k, a, s) for (k, a, b), s in placed.items() if b < 0]
    own = spark.createDataFrame(own, "_key long, _again long, _own int")
    bundles = [(b, s) for (_, _, b), s in placed.items() if b >= 0]
    bundles = spark.createDataFrame(bundles, "_bundle int, _with int")
    dealt = rows.join(F.broadcast(own), ["_key", "_again"], "left")
    dealt = dealt.join(F.broadcast(bundles), "_bundle", "left")
    dealt = dealt.select(
        "row", "_order", "size", "text_crc32", F.coalesce("_own", "_with").alias("shard")
    )
    return gapless(dealt, ["shard"], ["_order", "text_crc32"], "slot").select(
        "row", "size", "text_crc32", "shard", "slot"
    )
