"""Small helpers of the operators: stored steps, Arrow frames and gapless numbers."""

import itertools
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.files import delete_path, shared_dir

#: Rows of one Arrow batch that holds whole texts, for which Spark and a worker have a copy each.
TEXT_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_numbers = itertools.count()


def fresh_path(spark, name):
    """A new folder on the storage that all executors share."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}-{next(_numbers)}"


def stored(df, name):
    """The frame written as Parquet in the shared folder and read back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Stored frames that are deleted once what reads them is stored itself."""

    def __init__(self):
        self._paths = {}

    def store(self, df, name):
        path = fresh_path(df.sparkSession, name)
        df.write.parquet(path)
        found = df.sparkSession.read.schema(df.schema).parquet(path)
        self._paths[id(found)] = (found, path)
        return found

    def drop(self, *frames):
        """Delete frames; none of the given ones without a reader that is stored may be left."""
        for frame in frames:
            _, path = self._paths.pop(id(frame))
            delete_path(frame.sparkSession, path)

    def close(self):
        self.drop(*[frame for frame, _ in list(self._paths.values())])


@contextmanager
def text_batches(spark, rows=TEXT_ROWS):
    """What is stored meanwhile goes to Python by batches of at most ``rows`` rows; then as before."""
    before = spark.conf.get(_ARROW_ROWS, None)
    if before is not None and 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ARROW_ROWS)
        else:
            spark.conf.set(_ARROW_ROWS, before)


def in_arrow(function, schema=None):
    """A mapInArrow function from one that maps one record batch to a dict of columns, or None."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run


def gapless(df, group, order, name):
    """Numbers from 0 without gaps within each group, for groups of any size.

    Rows are dealt by range over ``group`` and ``order``, so a large group lies in many
    partitions. Each row's number is its place among the group's rows of its partition, plus the
    rows of the group in earlier partitions; only one count per group and partition is gathered.
    The dealt rows are stored first, because the counts and the rows must be of one dealing.
    """
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = dealt.withColumn("_id", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_id", 33)), name)
    counts = dealt.groupBy(*group, "_part").agg(
        F.count("*").alias("_rows"), F.min("_id").alias("_least")
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    numbered = dealt.join(counts.drop("_rows"), [*group, "_part"])
    number = F.col("_id") - F.col("_least") + F.col("_before")
    return numbered.withColumn(name, number).drop("_id", "_part", "_least", "_before")
