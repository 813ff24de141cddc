"""Where versions come from: a table of nodes with the ids of their parents."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.files import cut_lineage, path_exists
from tidemark.functions.rows import one_row, utc
from tidemark.functions.skew import key_set

NODE_SCHEMA = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("version_tag", T.StringType()),
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("source_uris", T.ArrayType(T.StringType())),
        T.StructField("parent_node_ids", T.ArrayType(T.StringType())),
        T.StructField("transforms", T.ArrayType(T.StringType())),
        T.StructField("schema_snapshot", T.MapType(T.StringType(), T.StringType())),
        T.StructField("row_count", T.LongType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def lineage_of(nodes, dataset):
    """Nodes of a dataset, oldest first."""
    return nodes.filter(F.col("dataset") == dataset).orderBy("created_at", "node_id")


def node_by_id(nodes, node_id):
    return nodes.filter(F.col("node_id") == node_id)


def latest_nodes(nodes):
    """The newest node of every dataset."""
    newest = F.max_by(F.struct("*"), F.struct("created_at", "node_id"))
    return nodes.groupBy("dataset").agg(newest.alias("n")).select("n.*")


def datasets_with_lineage(nodes):
    return nodes.select("dataset").distinct()


def edges(nodes):
    """``node_id, parent_id`` for parents that exist as nodes."""
    pairs = nodes.select("node_id", F.explode("parent_node_ids").alias("parent_id")).distinct()
    known = key_set(nodes, "node_id", "parent_id")
    return pairs.join(known, "parent_id", "left_semi").select("node_id", "parent_id")


def ancestors(nodes, starts):
    """``start_id, node_id, distance`` of every node reachable through parents.

    The start itself is included at distance 0. ``starts`` is a frame with a ``node_id`` column;
    the result has a row for every start and ancestor, so starts should be few where chains are
    long. Jumps over 1, 2, 4, ... parents double what is reached, so the rounds are as many as the
    logarithm of the longest path; cycles end, because pairs are kept once, at their least distance.
    Each round is checkpointed to shared storage, which keeps the plan short and survives lost
    executors.
    """
    jumps = cut_lineage(edges(nodes))
    present = key_set(nodes, "node_id")
    seen = cut_lineage(
        starts.select("node_id")
        .distinct()
        .join(present, "node_id", "left_semi")
        .select(
            F.col("node_id").alias("start_id"), "node_id", F.lit(0).cast("int").alias("distance")
        )
    )
    pairs, step = seen.count(), 1
    while True:
        further = seen.join(jumps, "node_id").select(
            "start_id",
            F.col("parent_id").alias("node_id"),
            (F.col("distance") + F.lit(step)).alias("distance"),
        )
        nearest = F.min("distance").cast("int").alias("distance")
        seen = cut_lineage(
            seen.unionByName(further).groupBy("start_id", "node_id").agg(nearest)
        )
        found = seen.count()
        if found == pairs:
            return seen
        pairs, step = found, 2 * step
        second = jumps.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_next"))
        jumps = cut_lineage(
            jumps.join(second, "parent_id").select("node_id", F.col("_next").alias("parent_id")).distinct()
        )


def provenance(nodes):
    """One row per dataset: versions, first and last time, distinct sources and steps."""
    base = nodes.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("version_count"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    counts = (
        provenance_items(nodes)
        .groupBy("dataset")
        .agg(
            F.count_if(F.col("kind") == "source").alias("sources"),
            F.count_if(F.col("kind") == "transform").alias("transforms"),
        )
    )
    return base.join(counts, "dataset", "left").fillna({"sources": 0, "transforms": 0})


def provenance_items(nodes):
    """Every distinct source and step of a dataset with where it was seen first.

    ``kind, value, first_at, first_node, first_position``: sorting by the last three gives
    the order of first sight. Kept as rows, so nothing of a dataset with very many versions has
    to fit into one list.
    """
    parts = []
    for kind, column in (("source", "source_uris"), ("transform", "transforms")):
        parts.append(
            nodes.select(
                "dataset",
                F.lit(kind).alias("kind"),
                "created_at",
                "node_id",
                F.posexplode(column).alias("position", "value"),
            )
        )
    first = F.min(F.struct("created_at", "node_id", "position")).alias("first")
    return (
        parts[0]
        .unionByName(parts[1])
        .groupBy("dataset", "kind", "value")
        .agg(first)
        .select(
            "dataset",
            "kind",
            "value",
            F.col("first.created_at").alias("first_at"),
            F.col("first.node_id").alias("first_node"),
            F.col("first.position").alias("first_position"),
        )
    )


class LineageTable:
    """The node table below one folder. One writer."""

    def __init__(self, spark, root):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/lineage"

    def nodes(self):
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], NODE_SCHEMA)
        return self.spark.read.schema(NODE_SCHEMA).parquet(self.path)

    def recorded(self, dataset, version_tag, snapshot_id):
        """Id of the node of this version and snapshot, or None."""
        mine = self.nodes().filter(
            (F.col("dataset") == dataset)
            & (F.col("version_tag") == version_tag)
            & F.col("snapshot_id").eqNullSafe(snapshot_id)
        )
        row = mine.select("node_id").first()
        return row and row["node_id"]

    def record(self, dataset, version_tag, source_uris, transforms, schema_snapshot, row_count,
               snapshot_id=None, parent_node_ids=None, extra=None, at=None, node_id=None):
        """Add a node; without parents given, the latest node of the dataset is the parent."""
        if parent_node_ids is None:
            mine = self.nodes().filter(F.col("dataset") == dataset)
            parent_node_ids = [row["node_id"] for row in latest_nodes(mine).collect()]
        node_id = node_id or str(uuid.uuid4())
        row = (
            node_id,
            dataset,
            version_tag,
            snapshot_id,
            utc(at),
            list(source_uris),
            list(parent_node_ids),
            list(transforms),
            dict(schema_snapshot),
            row_count,
            {key: str(value) for key, value in (extra or {}).items()},
        )
        one_row(self.spark, row, NODE_SCHEMA).write.mode("append").parquet(self.path)
        return node_id
