"""Statistics of a dataset's snapshots from states of its batches, without reading data again.

    <root>/<dataset>/statistics/*.parquet      one row for each batch and column

A batch never changes, so its state is taken once, by the first call that needs it. A snapshot's
profile unites the states of the batches it sees; deltas compare two of them. Only batches of which a
later overwrite hides a part are read again, as the snapshot sees them.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.files import path_exists
from tidemark.names import is_system
from tidemark.operators.diff import compare_profiles
from tidemark.operators.statistics import STATE_SCHEMA, column_states, profile_of, united
from tidemark.plans.versions import BATCH, TableDefinition

_SCHEMA = T.StructType([T.StructField(BATCH, T.LongType()), *STATE_SCHEMA.fields])


class StoredStatistics:
    def __init__(self, dataset):
        self.dataset = dataset
        self.path = f"{dataset.path}/statistics"

    def states(self):
        """Stored states of all batches, under stored column names."""
        spark = self.dataset.spark
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], _SCHEMA)
        # A run that died after its file was complete may have left a batch twice, alike.
        return spark.read.schema(_SCHEMA).parquet(self.path).dropDuplicates([BATCH, "column"])

    def _states_of(self, definition, batches, overwrites=()):
        rows = self.dataset.rows_of(definition, batches, overwrites)
        names = [stored for name, stored, _ in definition.columns if not is_system(name)]
        return column_states(rows, names, by=(BATCH,))

    def complete(self, snapshot_id=None):
        """Take the states of batches that have none yet, by one pass over these batches alone."""
        _, definition, view = self._view(snapshot_id)
        missing = set(view.batches) - {row[0] for row in self.states().select(BATCH).distinct().collect()}
        if missing:
            # One small file, complete or absent.
            taken = self._states_of(definition, tuple(sorted(missing))).coalesce(1)
            taken.write.mode("append").parquet(self.path)

    def _view(self, snapshot_id):
        log = self.dataset.commit_log()
        if snapshot_id is None:
            snapshot_id = log.current_id
        row = log.snapshot(snapshot_id)
        return log, TableDefinition.from_json(row["table"]), log.view(snapshot_id)

    def profile(self, snapshot_id=None):
        """The profile of a snapshot; unique counts are estimates from united sketches.

        A column that a batch does not have is null in its rows. Text and number are told apart by
        all rows together, as in a profile of the rows.
        """
        self.complete(snapshot_id)
        _, definition, view = self._view(snapshot_id)
        hidden_before = max(view.overwrites, default=0)
        whole = [b for b in view.batches if b >= hidden_before]
        partly = tuple(b for b in view.batches if b < hidden_before)
        states = self.states().where(F.col(BATCH).isin(whole))
        if partly:
            states = states.unionByName(self._states_of(definition, partly, view.overwrites))
        # One row for each batch, a small frame.
        total = states.groupBy(BATCH).agg(F.max("rows").alias("rows")).agg(F.sum("rows")).first()[0]
        names = {stored: name for name, stored, _ in definition.columns}
        named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        states = states.where(F.col("column").isin(list(names))).drop(BATCH)
        states = united(states).withColumn("rows", F.lit(total or 0).cast("bigint"))
        return profile_of(states.withColumn("column", named[F.col("column")]))

    def deltas(self, before_id, after_id):
        """Deltas of the columns that two snapshots have in common, from stored states alone."""
        return compare_profiles(self.profile(before_id), self.profile(after_id))
