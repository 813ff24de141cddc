"""From a source to a version of a dataset, as one Spark job over the rows.

    read -> clean -> drop duplicates -> check rules -> append -> record version and lineage

Everything up to the write is one lazy frame. Rules on rows are measured while the batch is
written and the commit waits for them; only a unique key needs a look at the written batch. A
batch that breaks a rule is deleted before anyone could see it.
"""

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import dedup, validation
from tidemark.operators.catalog import Catalog
from tidemark.operators.cleaning import Cleaning
from tidemark.operators.lineage import LineageTable
from tidemark.operators.rules import TableRules
from tidemark.plans.known import GROUP_ROWS, KnownRows
from tidemark.plans.versions import CODEC, TableDefinition, VersionedDataset
from tidemark.sources.readers import read_many, read_source


@dataclass(frozen=True)
class IngestResult:
    dataset: str
    version_tag: str
    rows_ingested: int
    rows_written: int
    snapshot_id: int | None
    lineage_node_id: str | None
    checksum: str
    steps: list
    warnings: list = field(default_factory=list)


@dataclass
class Ingest:
    """One run. ``at`` is its time stamp; a fixed one makes the run repeatable. ``allowed`` maps
    columns to frames of one column with their allowed values."""

    root: str
    dataset: str
    version_tag: str
    rules: TableRules | None = None
    cleaning: Cleaning | None = None
    description: str = ""
    tags: tuple = ()
    codec: str = CODEC
    partition_by: tuple = ()
    sort_by: tuple = ()
    incremental: bool = False
    at: datetime | None = None
    ledger_rows: int = GROUP_ROWS
    allowed: dict = field(default_factory=dict)

    def __post_init__(self):
        self.at = self.at or datetime.now(timezone.utc).replace(tzinfo=None)
        self.cleaning = self.cleaning or Cleaning.standard(str(self.at))

    @property
    def steps(self):
        """Names of the steps that really run, in order."""
        known = ["drop_known"] if self.incremental else []
        return [*self.cleaning.names, "deduplicate", *known]

    def prepare(self, df, known=None):
        """Cleaned rows without duplicates, and without known rows in an incremental run."""
        rows = dedup.deduplicate(self.cleaning.run(df), framed=True)
        return rows if known is None else known.drop_from(rows)

    def dry_run(self, df):
        """``(rows, report)`` with nothing written."""
        rows = self.prepare(df)
        return rows, validation.validate(rows, self.rules or TableRules(), self.allowed)

    def run(self, spark, source, source_format=None, options=None):
        """Read one source, or a list of sources, and append it as a version."""
        if isinstance(source, (list, tuple)):
            return self.run_frame(
                read_many(spark, source, source_format, options), list(source)
            )
        return self.run_frame(read_source(spark, source, source_format, options=options), [source])

    def run_frame(self, df, source_uris):
        spark = df.sparkSession
        catalog, nodes = Catalog(spark, self.root), LineageTable(spark, self.root)
        # Refused before any work, not after the batch is written.
        catalog.check_new_tag(self.dataset, self.version_tag)
        dataset = VersionedDataset(spark, self.root, self.dataset)
        known = None
        if self.incremental and dataset.exists():
            known = KnownRows(dataset, self.ledger_rows)
        # A count of its own: footers alone for Parquet, and exact when tasks are repeated.
        rows_read = df.count()
        rows = self.prepare(df, known)
        if dataset.exists():
            definition = dataset.widened(rows)
        else:
            definition = TableDefinition.of(rows.schema, self.partition_by, self.sort_by)
        rules = self.rules or TableRules()
        checks = validation.aggregate_checks(rows, rules)
        measures = {f"check_{i}": check.violations for i, check in enumerate(checks)}
        warnings = []

        def gate(measured, batch):
            issues = self._issues(rows, rules, checks, measured, batch)
            broken = [issue for issue in issues if issue[2] == validation.ERROR]
            if broken:
                raise validation.ValidationFailed(
                    "; ".join(f"{column or 'table'}: {text}" for column, _, _, _, text in broken)
                )
            warnings.extend(issues)

        # A run that died after its commit is finished by the next run of the same tag: the token
        # keeps the batch from being written again, and the records below are completed.
        written = dataset.append(
            rows, self.at, self.codec, catalog.tag_token(self.dataset, self.version_tag),
            measures, gate, definition,
        )
        schema = dict(rows.dtypes)
        node_id = nodes.recorded(self.dataset, self.version_tag, written.snapshot_id)
        if node_id is None:
            node_id = nodes.record(
                self.dataset,
                self.version_tag,
                source_uris,
                self.steps,
                schema,
                written.rows_written,
                written.snapshot_id,
                at=self.at,
            )
        catalog.register(
            self.dataset,
            description=self.description,
            tags=self.tags,
            source_uri=",".join(source_uris),
            table_path=dataset.path,
            schema=schema,
            at=self.at,
        )
        state = dataset.commit_log().by_id[written.snapshot_id]["summary"]
        catalog.add_version(
            self.dataset,
            self.version_tag,
            written.rows_written,
            int(state["total-records"]),
            written.snapshot_id,
            written.checksum,
            lineage_node_id=node_id,
            at=self.at,
        )
        return IngestResult(
            self.dataset,
            self.version_tag,
            rows_read,
            written.rows_written,
            written.snapshot_id,
            node_id,
            written.checksum,
            self.steps,
            warnings,
        )

    def _issues(self, rows, rules, checks, measured, batch):
        issues = []
        for i, check in enumerate(checks):
            count = measured[f"check_{i}"]
            if count:
                issues.append(
                    (check.column, check.rule, check.severity, count, f"{count} {check.text}")
                )
        issues += validation.schema_issues(rows, rules)
        keys = validation.unique_key_columns(rows, rules)
        if keys:
            count = validation.unique_key_violations(batch, keys).first()["violations"]
            if count:
                text = f"{count} rows repeat the key " + ", ".join(keys)
                issues.append(
                    (", ".join(keys), "unique_constraint", validation.ERROR, count, text)
                )
        for name, values in self.allowed.items():
            if name in batch.columns:
                found = validation.membership_violations(batch, name, values)
                count = found.first()["violations"]
                if count:
                    text = f"{count} values outside the allowed set"
                    issues.append((name, "allowed_values", validation.ERROR, count, text))
        return issues


def step_audit(df, cleaning):
    """Rows into and out of every step of a chain: ``position, step, rows_in, rows_out``.

    Every step is observed in one plan and one pass over the rows fills all counters. Steps
    that decide by the data have decided before, on frames without counters.
    """
    counters = []

    def counted(frame):
        counter = Observation()
        counters.append(counter)
        return frame.observe(counter, F.count(F.lit(1)).alias("rows"))

    settled = cleaning.settled(df)
    rows = counted(df)
    for item in settled.steps:
        rows = counted(rows.transform(item))
    rows.write.format("noop").mode("overwrite").save()
    counts = [counter.get["rows"] for counter in counters]
    return df.sparkSession.createDataFrame(
        [(i, name, counts[i], counts[i + 1]) for i, name in enumerate(settled.names)],
        "position int, step string, rows_in bigint, rows_out bigint",
    )
