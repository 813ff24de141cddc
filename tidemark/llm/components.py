"""Connected components of links, by alternating large and small stars."""

from pyspark.sql import functions as F

from tidemark.llm.shared import Steps


#: Links of one partition; fewer links are kept in fewer files, so that small rounds are short.
LINKS_A_PART = 500_000


def _star(steps, edges, small, parts):
    """One star step: neighbours hang on the least node that they share; the edges read are deleted."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.where("b < a") if small else both
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = steps.store(least.coalesce(parts), "least")
    # The least nodes are read from storage, so both sides of the join are plain shuffles and a
    # node with very many neighbours can be split.
    joined = near.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = steps.store(moved.where("a <> b").distinct().coalesce(parts), "edges")
    steps.drop(edges, least)
    return out


def components(edges):
    """``node`` and ``root`` (least node of its component) for every node of the links ``a``, ``b``.

    Nodes without a link are not returned. Links of a node with itself are ignored; the number of
    rounds grows with the logarithm of the longest path.
    """
    steps = Steps()
    edges = steps.store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before, parts = None, -(-edges.count() // LINKS_A_PART) or 1
    while True:
        edges = _star(steps, _star(steps, edges, False, parts), True, parts)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.union(roots)
