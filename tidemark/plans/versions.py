"""A dataset in versions on plain Spark: Parquet batches and a log of commits.

    <root>/<dataset>/data/_batch_id=<n>/[partition=...]/*.parquet
    <root>/<dataset>/overwritten/_batch_id=<n>/*.parquet   partitions an overwrite replaced
    <root>/<dataset>/log/*.parquet                         one row per commit, written last

A batch without a commit is invisible, so a job that dies on the way leaves nothing behind that
a reader could see. There is one writer per dataset.

Columns have a stored name that never changes and a name that may; adding or renaming a column
is one row in the log and touches no data.
"""

import json
from functools import reduce
from dataclasses import dataclass, replace
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.files import delete_path, path_exists
from tidemark.functions.hashing import (
    checksum_numbers,
    content_proof,
    proof_numbers,
    proofs_added,
    row_hash,
    summed,
)
from tidemark.functions.partitioning import PartitionBy, partition_type, partition_value
from tidemark.functions.rows import one_row, utc
from tidemark.functions.typenames import canonical_type
from tidemark.names import ROW_HASH, dataset_dir, quoted
from tidemark.plans import commits
from tidemark.plans.commits import LOG_SCHEMA, CommitLog, SnapshotNotFound

# Default codec and target size of data files.
CODEC = "zstd"
TARGET_FILE_BYTES = 128 * 1024 * 1024

# The batch of a row, and the proof of no rows.
BATCH = "_batch_id"
NO_ROWS = "0:0"
_KEY = "_sys_partition_key"

# Columns of the numbers that the checksum and the proof of a batch add up.
_CHECKSUM = tuple(f"_sys_checksum_{i}" for i in range(4))
_PROOF = tuple(f"_sys_proof_{i}" for i in range(2))


# What may follow a sort column.
_DIRECTIONS = {
    "": "asc_nulls_last",
    " asc": "asc_nulls_last",
    " desc": "desc_nulls_last",
    " asc nulls first": "asc_nulls_first",
    " desc nulls first": "desc_nulls_first",
}


def sort_column(spec):
    """The column of a sort entry such as ``price`` or ``price desc nulls first``."""
    ending = max((d for d in _DIRECTIONS if spec.lower().endswith(d)), key=len)
    return spec[: len(spec) - len(ending)]


def _sort_order(spec, definition):
    name = sort_column(spec)
    stored = {n: s for n, s, _ in definition.columns}[name]
    return getattr(F.col(quoted(stored)), _DIRECTIONS[spec[len(name) :].lower()])()


class SchemaMismatch(ValueError):
    """A batch does not fit the columns of its dataset."""


@dataclass(frozen=True)
class TableDefinition:
    """Columns ``(name, stored name, type)``, partition transforms and sort columns."""

    columns: tuple[tuple[str, str, str], ...]
    partition_by: tuple[PartitionBy, ...] = ()
    sort_by: tuple[str, ...] = ()

    def to_json(self):
        return json.dumps(
            {
                "columns": [list(column) for column in self.columns],
                "partition_by": [[p.column, p.transform] for p in self.partition_by],
                "sort_by": list(self.sort_by),
            }
        )

    @classmethod
    def from_json(cls, text):
        content = json.loads(text)
        return cls(
            tuple(tuple(column) for column in content["columns"]),
            tuple(PartitionBy(*item) for item in content["partition_by"]),
            tuple(content["sort_by"]),
        )

    @classmethod
    def of(cls, schema, partition_by=(), sort_by=()):
        """Definition for a new dataset; partition and sort columns it lacks are ignored."""
        names = {field.name for field in schema.fields}
        specs = [p if isinstance(p, PartitionBy) else PartitionBy(p) for p in partition_by]
        return cls(
            tuple((f.name, f.name, f.dataType.simpleString()) for f in schema.fields),
            tuple(p for p in specs if p.column in names),
            tuple(spec for spec in sort_by if sort_column(spec) in names),
        )

    @property
    def names(self):
        return [name for name, _, _ in self.columns]

    def type_of(self, stored):
        kind = next(kind for _, s, kind in self.columns if s == stored)
        return _type(kind)

    def stored_schema(self):
        """Schema of the files: stored columns, partition columns, batch number."""
        fields = [T.StructField(s, _type(k)) for _, s, k in self.columns]
        present = {field.name for field in fields}
        for spec in self.partition_by:
            if spec.directory not in present:
                kind = partition_type(spec, self.type_of(spec.column))
                fields.append(T.StructField(spec.directory, kind))
        return T.StructType([*fields, T.StructField(BATCH, T.LongType())])

    def partition_key(self):
        """Text of the partition of a stored row, with its own token for null."""
        parts = []
        for spec in self.partition_by:
            text = F.col(quoted(spec.directory)).cast("string")
            parts.append(
                F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-;"))
            )
        return F.concat(*parts)


@dataclass(frozen=True)
class WriteResult:
    snapshot_id: int
    batch_id: int
    rows_written: int
    files_written: int
    bytes_written: int
    codec: str
    checksum: str
    measures: dict


class VersionedDataset:
    def __init__(self, spark, root, name):
        self.spark = spark
        self.name = name
        self.path = f"{root.rstrip('/')}/{dataset_dir(name)}"
        self.data_path = f"{self.path}/data"

    # --- log --------------------------------------------------------------------------

    @classmethod
    def create(cls, spark, root, name, schema, partition_by=(), sort_by=(), at=None):
        """A new dataset; one that exists is left as it is."""
        dataset = cls(spark, root, name)
        if not dataset.exists():
            definition = TableDefinition.of(schema, partition_by, sort_by)
            for spec in definition.partition_by:
                partition_value(spec, definition.type_of(spec.column))
            dataset._commit(CommitLog([]), "create", at=at, table=definition.to_json())
        return dataset

    def exists(self):
        return path_exists(self.spark, f"{self.path}/log")

    def log(self):
        """The commit log as a frame."""
        if not self.exists():
            raise SnapshotNotFound(f"no dataset {self.name}")
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")

    def commit_log(self):
        return CommitLog.from_frame(self.log())

    def definition(self, log=None):
        return TableDefinition.from_json((log or self.commit_log()).table_json())

    def _commit(self, log, operation, at=None, parent=None, batch=None, base=None, table=None,
                summary=None):
        number, rows = log.next_id, []
        if not log.rows and operation != "create":
            # A first batch creates its dataset, in one file with its own commit.
            rows.append((number, None, utc(at), "create", None, None, table, {}))
            number += 1
        rows.append((number, parent, utc(at), operation, batch, base, table, summary or {}))
        frames = [one_row(self.spark, row, LOG_SCHEMA) for row in rows]
        together = reduce(lambda a, b: a.unionAll(b), frames).coalesce(1)
        together.write.mode("append").parquet(f"{self.path}/log")
        return number

    # --- writing ----------------------------------------------------------------------

    def _fit(self, df, definition):
        """The batch in the order, names and types of the dataset, or an error."""
        declared = {name: (stored, kind) for name, stored, kind in definition.columns}
        extra = [name for name in df.columns if name not in declared]
        if extra:
            raise SchemaMismatch(f"{self.name} has no columns {extra}; add_column() first")
        present, columns = set(df.columns), []
        for name, (stored, kind) in declared.items():
            if name not in present:
                columns.append(F.lit(None).cast(kind).alias(stored))
                continue
            actual = df.schema[name].dataType.simpleString()
            if actual != kind and (actual, kind) not in _WIDENINGS:
                raise SchemaMismatch(f"{self.name}.{name} is {kind}, the batch has {actual}")
            columns.append(F.col(quoted(name)).cast(kind).alias(stored))
        return df.select(*columns)

    @staticmethod
    def _with_partitions(df, definition):
        """The batch with the values of its partition columns."""
        derived = {
            spec.directory: partition_value(spec, definition.type_of(spec.column))
            for spec in definition.partition_by
            if spec.directory != spec.column
        }
        return df.withColumns(derived) if derived else df

    def _laid_out(self, df, definition):
        """The batch clustered by partition columns and sorted for the write.

        Rebalancing is left to adaptive execution: it merges small partitions and splits a
        partition value that holds most of the rows over several files.
        """
        if definition.partition_by:
            df = df.hint("rebalance", *[spec.directory for spec in definition.partition_by])
        order = [_sort_order(spec, definition) for spec in definition.sort_by]
        if not order:
            return df
        # The writer wants rows by partition. Sorted so from the start, they are not sorted again,
        # which would keep the wanted order only as long as nothing spills.
        folders = [F.col(quoted(spec.directory)).asc() for spec in definition.partition_by]
        return df.sortWithinPartitions(*folders, *order)

    def _write(self, df, definition, batch, codec, measures=None, compact=False):
        """Write one batch and return what it holds; nothing is visible yet.

        Row count, checksum and the caller's measures are observed while the rows go to the
        files, so the input is computed once. That is before the rows are dealt to their
        partitions, of which there may be few, so that hashing runs in all tasks of the input.
        Files have the last word: should the observed rows not be the rows of the files, the
        figures are taken from the batch instead.
        """
        fitted = self._fit(df, definition)
        if not compact:
            fitted = self._with_partitions(fitted, definition)
        named = self._numbered(self._named(fitted, definition), definition)
        figures = self._figures(definition, measures or {})
        observation = Observation()
        laid_out = named.observe(observation, *figures).select(
            *[F.col(quoted(name)).alias(stored) for name, stored, _ in definition.columns],
            *[F.col(name) for name in self._derived(definition)],
        )
        if not compact:
            laid_out = self._laid_out(laid_out, definition)
        target = f"{self.data_path}/{BATCH}={batch}"
        writer = laid_out.write.mode("overwrite").option("compression", _codec(codec))
        if definition.partition_by:
            writer = writer.partitionBy(*[spec.directory for spec in definition.partition_by])
        writer.parquet(target)
        stored = self._scan(definition, (batch,))
        facts = self._file_facts(stored)
        # Without a row there may be no observation: adaptive execution leaves empty stages out.
        seen = observation.get if facts["rows"] else {}
        if seen.get("_rows") != facts["rows"]:
            named = self._numbered(self._named(stored, definition), definition)
            seen = named.agg(*figures).first().asDict()
        if seen["_empty_partitions"]:
            delete_path(self.spark, target)
            raise SchemaMismatch("empty text cannot be a partition value: it would read as null")
        return {
            **facts,
            "checksum": seen["_checksum"],
            "proof": seen["_proof"],
            "measures": {name: seen[name] for name in measures or {}},
        }

    @staticmethod
    def _derived(definition):
        """Partition columns that are not columns of the dataset."""
        stored = {s for _, s, _ in definition.columns}
        return [p.directory for p in definition.partition_by if p.directory not in stored]

    def _named(self, df, definition):
        return df.select(
            *[F.col(quoted(stored)).alias(name) for name, stored, _ in definition.columns],
            *[F.col(name) for name in self._derived(definition)],
        )

    @staticmethod
    def _numbered(named, definition):
        """Rows under their names with the numbers that checksum and proof add up."""
        frame = named.select(*[F.col(quoted(name)) for name in definition.names])
        hashed = F.col(ROW_HASH) if ROW_HASH in frame.columns else row_hash(frame)
        proofs = proof_numbers(frame, {name: s for name, s, _ in definition.columns})
        return named.withColumns(
            dict(zip([*_CHECKSUM, *_PROOF], [*checksum_numbers(hashed), *proofs]))
        )

    @staticmethod
    def _figures(definition, measures):
        """Aggregates over a numbered batch: rows, checksum, guards, measures."""
        named = {s: name for name, s, _ in definition.columns}
        empty = [
            F.count_if(F.col(quoted(named[spec.column])) == "")
            for spec in definition.partition_by
            if isinstance(definition.type_of(spec.column), T.StringType)
            and not spec.transform.startswith("bucket")
        ]
        return [
            F.count(F.lit(1)).alias("_rows"),
            summed(_CHECKSUM, "-").alias("_checksum"),
            summed(_PROOF, ":").alias("_proof"),
            sum(empty, F.count_if(F.lit(False))).alias("_empty_partitions"),
            *[measure.alias(name) for name, measure in measures.items()],
        ]

    def _file_facts(self, rows):
        """Files, rows and bytes behind a scan, from file metadata."""
        row = (
            self._by_file(rows)
            .agg(
                F.count(F.lit(1)).alias("files"),
                F.sum("records").alias("rows"),
                F.sum("file_size").alias("bytes"),
            )
            .first()
        )
        return {name: row[name] or 0 for name in ("files", "rows", "bytes")}

    @staticmethod
    def _by_file(rows):
        return rows.groupBy("_metadata.file_path").agg(
            F.count(F.lit(1)).alias("records"),
            F.max("_metadata.file_size").alias("file_size"),
        )

    def _summary(
        self, log, facts, extra=None, deleted_files=0, deleted_records=0, base=False, gone=NO_ROWS
    ):
        before = {"total-records": 0, "total-data-files": 0, "total-proof": NO_ROWS}
        if log.current_id is not None and not base:
            before = log.by_id[log.current_id]["summary"]
        # What the state holds: what it held, with the batch, without the rows that it replaces.
        proof = proofs_added((1, before.get("total-proof")), (1, facts["proof"]), (-1, gone))
        return {
            **({"total-proof": proof} if proof is not None else {}),
            "added-records": str(facts["rows"]),
            "added-data-files": str(facts["files"]),
            "added-bytes": str(facts["bytes"]),
            "deleted-data-files": str(deleted_files),
            "deleted-records": str(deleted_records),
            "total-records": str(int(before["total-records"]) + facts["rows"] - deleted_records),
            "total-data-files": str(
                int(before["total-data-files"]) + facts["files"] - deleted_files
            ),
            "checksum": facts["checksum"],
            **(extra or {}),
        }

    def _result(self, snapshot_id, batch, facts, codec):
        return WriteResult(
            snapshot_id,
            batch,
            facts["rows"],
            facts["files"],
            facts["bytes"],
            codec,
            facts["checksum"],
            facts["measures"],
        )

    def committed_token(self, token, log=None):
        """Snapshot id of the commit that carries ``token``, or None."""
        for row in (log or self.commit_log()).rows:
            if (row["summary"] or {}).get("token") == token:
                return row["snapshot_id"]
        return None

    def append(
        self, df, at=None, codec=CODEC, token=None, measures=None, gate=None, definition=None
    ):
        """Add a batch. ``token`` makes it happen once, however often it is called.

        A ``definition`` takes effect with the batch: it creates the dataset or gives it new
        columns in the very commit, so a batch that is refused leaves neither.

        ``measures`` are named aggregates over the batch, taken during the write. ``gate`` is
        called with them and with the written batch before the commit; if it raises, the
        batch is deleted and the dataset is as it was.
        """
        log = self.commit_log() if self.exists() else CommitLog([])
        if definition is None and not log.rows:
            raise SnapshotNotFound(f"no dataset {self.name}")
        if token is not None and log.rows:
            done = self.committed_token(token, log)
            if done is not None:
                row = log.by_id[done]
                facts = {
                    "rows": int(row["summary"]["added-records"]),
                    "files": int(row["summary"]["added-data-files"]),
                    "bytes": int(row["summary"]["added-bytes"]),
                    "checksum": row["summary"]["checksum"],
                    "measures": {},
                }
                return self._result(done, row["batch_id"], facts, codec)
        definition, batch = definition or self.definition(log), log.next_batch
        facts = self._write(df, definition, batch, codec, measures)
        if gate is not None:
            try:
                gate(facts["measures"], self._read_batches(definition, (batch,), ()))
            except Exception:
                delete_path(self.spark, f"{self.data_path}/{BATCH}={batch}")
                raise
        extra = {"codec": codec, **({"token": token} if token is not None else {})}
        made = self._commit(
            log,
            "append",
            at,
            log.current_id,
            batch,
            table=definition.to_json(),
            summary=self._summary(log, facts, extra),
        )
        return self._result(made, batch, facts, codec)

    def overwrite_partitions(self, df, at=None, codec=CODEC):
        """Replace the partitions that occur in ``df``, leave all others.

        Without partitions the whole dataset is one partition and is replaced.
        """
        log = self.commit_log()
        definition = self.definition(log)
        if not definition.partition_by:
            return self.replace_all(df, at, codec)
        batch = log.next_batch
        facts = self._write(df, definition, batch, codec)
        touched = self._scan(definition, (batch,)).select(
            definition.partition_key().alias(_KEY),
            *[F.col(quoted(spec.directory)) for spec in definition.partition_by],
        )
        target = f"{self.path}/overwritten/{BATCH}={batch}"
        touched.distinct().coalesce(1).write.mode("overwrite").parquet(target)
        deleted_files, deleted_records, proof = 0, 0, NO_ROWS
        if log.current_id is not None:
            replaced = self._replaced(definition, log.view(log.current_id), target)
            columns = {stored: stored for _, stored, _ in definition.columns}
            gone = replaced.agg(
                F.count_distinct("_file").alias("files"),
                F.count(F.lit(1)).alias("rows"),
                content_proof(replaced, columns).alias("proof"),
            ).first()
            deleted_files, deleted_records, proof = gone["files"], gone["rows"], gone["proof"]
        made = self._commit(
            log,
            "overwrite",
            at,
            log.current_id,
            batch,
            table=definition.to_json(),
            summary=self._summary(
                log, facts, {"codec": codec}, deleted_files, deleted_records, gone=proof
            ),
        )
        return self._result(made, batch, facts, codec)

    def _replaced(self, definition, view, touched):
        """Visible rows in the touched partitions; only the folders of these are read.

        Partitions meet by their values, by which Spark prunes folders while it runs. Those with a
        null in their values are looked up among the folders for null.
        """
        folders = [spec.directory for spec in definition.partition_by]
        keys = self.spark.read.parquet(touched)
        visible = self._visible(definition, view.batches, view.overwrites)
        visible = visible.withColumn("_file", F.col("_metadata.file_path"))
        null = F.lit(False)
        for name in folders:
            null |= F.col(quoted(name)).isNull()
        # A side with a comparison, as Spark prunes only by one that it expects to be selective.
        wanted = keys.where(~null & (F.col(_KEY) > "")).select(*[F.col(quoted(name)) for name in folders])
        plain = visible.join(wanted, folders, "left_semi")
        marked = visible.where(null).withColumn(_KEY, definition.partition_key())
        with_null = marked.join(keys.where(null).select(_KEY), _KEY, "left_semi").drop(_KEY)
        return plain.unionByName(with_null.select(*plain.columns))

    def replace_all(self, df, at=None, codec=CODEC):
        """New content for the whole dataset; old snapshots stay readable."""
        log = self.commit_log()
        return self._replace(log, self.definition(log), df, at, codec)

    def _replace(self, log, definition, df, at, codec, extra=None, compact=False):
        batch = log.next_batch
        facts = self._write(df, definition, batch, codec, compact=compact)
        before = log.by_id[log.current_id]["summary"] if log.current_id is not None else {}
        summary = self._summary(log, facts, {"codec": codec, **(extra or {})}, base=True)
        summary["deleted-data-files"] = before.get("total-data-files", "0")
        summary["deleted-records"] = before.get("total-records", "0")
        made = self._commit(
            log,
            "replace",
            at,
            log.current_id,
            batch,
            base=batch,
            table=definition.to_json(),
            summary=summary,
        )
        return self._result(made, batch, facts, codec)

    def compact(self, target_bytes=TARGET_FILE_BYTES, at=None, codec=CODEC):
        """Rewrite the current rows into files of about ``target_bytes``.

        Returns file counts and bytes before. Without partitions and sort order the read
        partitions are merged with no shuffle; otherwise rows are laid out as in any write.
        """
        log = self.commit_log()
        definition = self.definition(log)
        view = log.view(self._current(log))
        facts = self._file_facts(self._visible(definition, view.batches, view.overwrites))
        size = facts["bytes"]
        rows = self._read_batches(definition, view.batches, view.overwrites)
        plain = not definition.partition_by and not definition.sort_by
        if plain:
            rows = rows.coalesce(max(1, -(-size // target_bytes)))
        made = self._replace(
            log, definition, rows, at, codec, {"rewritten-bytes": str(size)}, compact=plain
        )
        return {
            "snapshot_id": made.snapshot_id,
            "rewritten_files": facts["files"],
            "added_files": made.files_written,
            "rewritten_bytes": size,
        }

    # --- reading ----------------------------------------------------------------------

    def _scan(self, definition, batches):
        """Rows of some batches under stored names; only their folders are listed."""
        paths = [self.batch_path(batch) for batch in batches]
        schema = definition.stored_schema()
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.data_path)
        return reader.parquet(*paths)

    def _visible(self, definition, batches, overwrites):
        """Scan without the partitions that a later overwrite replaced."""
        rows = self._scan(definition, batches)
        if not overwrites or not batches:
            return rows
        paths = [f"{self.path}/overwritten/{BATCH}={batch}" for batch in overwrites]
        hidden = (
            self.spark.read.option("basePath", f"{self.path}/overwritten")
            .parquet(*paths)
            .groupBy(_KEY)
            .agg(F.max(F.col(BATCH).cast("bigint")).alias("_before"))
        )
        marked = rows.withColumn(_KEY, definition.partition_key())
        newer = (marked[_KEY] == hidden[_KEY]) & (marked[BATCH] < hidden["_before"])
        return marked.join(hidden, newer, "left_anti").drop(_KEY)

    def _read_batches(self, definition, batches, overwrites):
        return self._visible(definition, batches, overwrites).select(
            *[F.col(quoted(stored)).alias(name) for name, stored, _ in definition.columns]
        )

    def _current(self, log):
        if log.current_id is None:
            raise SnapshotNotFound(f"{self.name} has no snapshot yet")
        return log.current_id

    def read(self, snapshot_id=None, as_of=None):
        """Rows at a snapshot, at a time, or now.

        An old snapshot is read with the columns it had, the current state with the columns
        the dataset has now.
        """
        log = self.commit_log()
        if as_of is not None:
            snapshot_id = log.as_of(utc(as_of))["snapshot_id"]
        if snapshot_id is None:
            if log.current_id is None:
                return self._read_batches(self.definition(log), (), ())
            view = log.view(log.current_id)
            return self._read_batches(self.definition(log), view.batches, view.overwrites)
        definition = TableDefinition.from_json(log.snapshot(snapshot_id)["table"])
        view = log.view(snapshot_id)
        return self._read_batches(definition, view.batches, view.overwrites)

    def read_between(self, start_id, end_id):
        """Rows appended after ``start_id`` up to ``end_id``."""
        log = self.commit_log()
        batches = log.appended_between(start_id, end_id)
        definition = TableDefinition.from_json(log.snapshot(end_id)["table"])
        return self._read_batches(definition, batches, ())

    def known_hashes(self):
        """Row hashes of the current state; only that column is read."""
        return self.read().select(ROW_HASH)

    def batch_path(self, batch):
        return f"{self.data_path}/{BATCH}={batch}"

    def rows_of(self, definition, batches, overwrites=()):
        """Rows of some batches under stored names, with ``_batch_id``."""
        return self._visible(definition, batches, overwrites)

    # --- snapshots --------------------------------------------------------------------

    def snapshots(self, limit=None):
        return commits.list_snapshots(self.log(), limit)

    def current_snapshot(self):
        return commits.current_snapshot(self.log())

    def history(self):
        log = self.commit_log()
        ancestors = []
        if log.current_id is not None:
            ancestors = [row["snapshot_id"] for row in log.chain(log.current_id)]
        return commits.history(self.log(), ancestors)

    def rollback_to(self, snapshot_id, at=None):
        """A new snapshot with the state of an old one; nothing is deleted."""
        log = self.commit_log()
        target = log.snapshot(snapshot_id)
        state = target["summary"]
        return self._commit(
            log,
            "rollback",
            at,
            snapshot_id,
            table=target["table"],
            summary={
                "total-records": state["total-records"],
                "total-data-files": state["total-data-files"],
                "rollback-to": str(snapshot_id),
                **({"total-proof": state["total-proof"]} if "total-proof" in state else {}),
            },
        )

    def rollback_to_time(self, as_of, at=None):
        return self.rollback_to(self.commit_log().as_of(utc(as_of))["snapshot_id"], at)

    def expire(self, older_than, retain_last=5, at=None):
        """Make old snapshots unreadable and delete batches no other snapshot sees.

        The commits stay in the log, because the chains of retained snapshots run through
        them. The log is written first: a job that dies later leaves files, never gaps.
        """
        log = self.commit_log()
        gone = log.to_expire(utc(older_than), retain_last)
        batches = [b for b in log.unneeded_batches(gone) if self._has_batch(b)]
        if gone:
            summary = {"expired": ",".join(str(number) for number in gone)}
            self._commit(log, "expire", at, summary=summary)
        files = 0
        if batches:
            files = self._file_facts(self._scan(self.definition(log), batches))["files"]
            for batch in batches:
                delete_path(self.spark, f"{self.data_path}/{BATCH}={batch}")
        return {
            "expired_snapshots": len(gone),
            "deleted_batches": len(batches),
            "deleted_data_files": files,
        }

    def _has_batch(self, batch):
        return path_exists(self.spark, f"{self.data_path}/{BATCH}={batch}")

    # --- columns ----------------------------------------------------------------------

    def add_column(self, name, kind, after=None, at=None):
        """A new column, null in every old row."""
        log = self.commit_log()
        return self._evolve(log, self._with_column(log, self.definition(log), name, kind, after), at)

    def widened(self, df):
        """The definition with the columns of ``df`` that the dataset lacks; nothing is stored."""
        log = self.commit_log()
        definition = self.definition(log)
        for name, kind in df.dtypes:
            if name not in definition.names:
                definition = self._with_column(log, definition, name, kind)
        return definition

    def _with_column(self, log, definition, name, kind, after=None):
        if name in definition.names:
            raise SchemaMismatch(f"{self.name} already has a column {name}")
        taken = {stored for _, stored, _ in definition.columns} | self._stored_names(log)
        stored, number = name, 1
        while stored in taken:
            stored, number = f"{name}_{number}", number + 1
        columns = list(definition.columns)
        place = definition.names.index(after) + 1 if after else len(columns)
        columns.insert(place, (name, stored, canonical_type(kind)))
        return replace(definition, columns=tuple(columns))

    def rename_column(self, old, new, at=None):
        log = self.commit_log()
        definition = self.definition(log)
        if old not in definition.names:
            raise SchemaMismatch(f"{self.name} has no column {old}")
        if new in definition.names:
            raise SchemaMismatch(f"{self.name} already has a column {new}")
        columns = tuple((new if n == old else n, s, k) for n, s, k in definition.columns)
        sort_by = tuple(
            new + spec[len(old) :] if sort_column(spec) == old else spec
            for spec in definition.sort_by
        )
        return self._evolve(log, replace(definition, columns=columns, sort_by=sort_by), at)

    @staticmethod
    def _stored_names(log):
        """Stored names of any time: a name once used in files is never used anew."""
        return {
            stored
            for row in log.rows
            if row["table"]
            for _, stored, _ in TableDefinition.from_json(row["table"]).columns
        }

    def _evolve(self, log, definition, at):
        return self._commit(log, "evolve", at, table=definition.to_json())

    # --- facts ------------------------------------------------------------------------

    def files(self):
        """Data files of the current state: path, rows, bytes."""
        log = self.commit_log()
        view = log.view(self._current(log))
        return self._by_file(self._visible(self.definition(log), view.batches, view.overwrites))

    def partitions(self):
        """Rows and files of every partition of the current state."""
        log = self.commit_log()
        definition, view = self.definition(log), log.view(self._current(log))
        keys = [F.col(quoted(spec.directory)) for spec in definition.partition_by]
        visible = self._visible(definition, view.batches, view.overwrites)
        by_file = visible.groupBy(*keys, F.col("_metadata.file_path").alias("_file")).count()
        return by_file.groupBy(*keys).agg(
            F.sum("count").alias("records"), F.count(F.lit(1)).alias("files")
        )

    def info(self):
        """Schema rows and the last five snapshots."""
        definition = self.definition()
        schema = self.spark.createDataFrame(
            [(i, name, kind) for i, (name, _, kind) in enumerate(definition.columns)],
            "position int, column string, type string",
        )
        return schema, self.snapshots(limit=5)

    def verify(self, snapshot_id=None):
        """One row: what is read back, what the log says it must be, and whether both agree.

        The log carries the number of rows and an additive proof of their values from commit to
        commit, with what was added and without what was replaced. ``is_intact`` compares both with
        the rows of the files as they are now; it is null for states whose log has no proof. The
        checksum is that of the row hashes.
        """
        log = self.commit_log()
        row = log.snapshot(self._current(log) if snapshot_id is None else snapshot_id)
        definition, view = TableDefinition.from_json(row["table"]), log.view(row["snapshot_id"])
        stored = self._visible(definition, view.batches, view.overwrites)
        named = self._numbered(self._named(stored, definition), definition)
        logged = int(row["summary"]["total-records"])
        proof = row["summary"].get("total-proof")
        rows = F.count(F.lit(1))
        found = summed(_PROOF, ":")
        return named.agg(
            rows.alias("rows_read"),
            summed(_CHECKSUM, "-").alias("checksum"),
            F.lit(logged).cast("bigint").alias("rows_logged"),
            ((rows == logged) & (found == F.lit(proof).cast("string"))).alias("is_intact"),
        )


def _type(kind):
    return T.StructType.fromDDL(f"c {kind}")["c"].dataType


def _codec(name):
    return "uncompressed" if name == "none" else name


# Batch types that fit a wider column type without loss.
_WIDENINGS = {
    ("tinyint", "smallint"),
    ("tinyint", "int"),
    ("tinyint", "bigint"),
    ("smallint", "int"),
    ("smallint", "bigint"),
    ("int", "bigint"),
    ("tinyint", "double"),
    ("smallint", "double"),
    ("int", "double"),
    ("float", "double"),
    ("date", "timestamp"),
}
