"""Which rows a dataset already holds, from a ledger of digests that is kept beside it.

    <root>/<dataset>/ledger/label=<first>-<last>/prefix=<two hex digits>/*.parquet

Digests of stored batches go into the ledger in groups of batches, once a group holds enough rows for
folders of a useful size; hashes of the newest batches, which are in no group yet, are read from the
data. The ledger is derived: a group that is missing or was left incomplete by a dead run is written
again from the batches, and no commit waits for it.
"""

from pyspark.sql import functions as F

from tidemark.functions.files import path_exists
from tidemark.names import ROW_HASH, quoted
from tidemark.operators.dedup import HashLedger

#: Rows of a group of batches before it goes into the ledger.
GROUP_ROWS = 5_000_000


class KnownRows:
    def __init__(self, dataset, group_rows=GROUP_ROWS):
        self.dataset = dataset
        self.group_rows = group_rows
        self.ledger = HashLedger(dataset.spark, f"{dataset.path}/ledger")

    def _groups(self, log):
        """Runs of batches that hold enough rows together, as ``(first, last, batches)``.

        They follow from the log alone, so that every run finds the same ones.
        """
        groups, held, rows = [], [], 0
        for row in log.rows:
            if row["batch_id"] is not None:
                held.append(row["batch_id"])
                rows += int(row["summary"]["added-records"])
                if rows >= self.group_rows:
                    groups.append((held[0], held[-1], tuple(held)))
                    held, rows = [], 0
        return groups

    def _stored(self, definition, batches):
        stored = {name: stored for name, stored, _ in definition.columns}[ROW_HASH]
        rows = self.dataset.rows_of(definition, batches)
        return rows.select(F.col(quoted(stored)).alias(ROW_HASH), F.col("_batch_id").alias("source"))

    def recorded(self, log, definition):
        """Batches in the ledger, after groups that it lacks were added."""
        found = set()
        for first, last, batches in self._groups(log):
            label = f"{first}-{last}"
            if not self.ledger.holds(label):
                # Batches that expiry has deleted are in no state any more.
                held = [b for b in batches if path_exists(self.dataset.spark, self.dataset.batch_path(b))]
                self.ledger.add(self._stored(definition, held), label, "source")
            found.update(batches)
        return found

    def drop_from(self, df):
        """Rows of ``df``, which carry a row hash, that the current state does not hold.

        Batches older than an overwrite may be hidden in part and are read as they are visible now.
        """
        log = self.dataset.commit_log()
        if log.current_id is None:
            return df
        definition, view = self.dataset.definition(log), log.view(log.current_id)
        in_ledger = self.recorded(log, definition)
        hidden_before = max(view.overwrites, default=0)
        whole = [b for b in view.batches if b >= hidden_before and b in in_ledger]
        rest = tuple(b for b in view.batches if b not in set(whole))
        parts = []
        if whole:
            parts.append(self.ledger.digests().where(F.col("source").isin(whole)).select("prefix", "digest"))
        if rest:
            seen = self.dataset.rows_of(definition, rest, view.overwrites)
            stored = {name: stored for name, stored, _ in definition.columns}[ROW_HASH]
            text = F.col(quoted(stored))
            parts.append(
                seen.select(F.lower(F.substring(text, 1, 2)).alias("prefix"), F.unhex(text).alias("digest"))
            )
        return self.ledger.drop_known(df, *parts) if parts else df
