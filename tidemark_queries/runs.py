"""Whole runs from source to version, incremental runs, streams."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.operators.cleaning import Cleaning
from tidemark.operators.rules import rules_from_dict
from tidemark.operators.validation import ValidationFailed, report_summary
from tidemark.plans.ingest import Ingest, step_audit
from tidemark.plans.loading import load
from tidemark.plans.versions import VersionedDataset
from tidemark.operators.catalog import Catalog
from tidemark.streaming.ingest import stream_distinct, stream_into
from tidemark_queries.cleaning import HOLES, holes
from tidemark_queries.registry import EVENTS, fresh_dir, query, sql_stored_hash, table

AT = datetime(2024, 6, 1)
RULES = rules_from_dict(
    {
        "min_rows": 1,
        "require_unique": ["event_id"],
        "columns": [
            {"name": "event_id", "dtype": "int64", "nullable": False},
            {"name": "event_type", "dtype": "object", "max_length": 5},
            {"name": "value", "dtype": "float64", "min_value": 0, "max_value": 1000000},
        ],
    }
)
INGESTED = f"""select event_id, ts, user_id, event_type, value, props,
                      timestamp '2024-06-01' as _sys_ingested_at,
                      {sql_stored_hash(EVENTS)} as _sys_row_hash from events"""


def _written_twice(spark, sf_dir, where="true"):
    """Parquet files of events in which all clicks are there twice, under messy names."""
    events = table(spark, sf_dir, "events").filter(where)
    events = events.unionAll(events.filter("event_type = 'click'"))
    messy = events.withColumnsRenamed({"event_type": " Event Type", "ts": "TS"}).withColumn(
        "props", F.concat(F.lit(" \t"), F.col("props"))
    )
    path = fresh_dir(spark, "source") + ".parquet"
    messy.withColumn("Nothing", F.lit(None).cast("string")).write.parquet(path)
    return path


@query("p1_full_run", INGESTED)
def full_run(spark, sf_dir):
    root = fresh_dir(spark, "run")
    run = Ingest(root, "click stream", "v1", rules=RULES, at=AT, tags=("events",))
    run.run(spark, _written_twice(spark, sf_dir))
    return load(Catalog(spark, root), root, "click stream", version="v1")


@query(
    "p1_run_result",
    """select count(*) + count(*) filter (where event_type = 'click') as rows_ingested,
              count(*) as rows_written, 1 as snapshot_id, 1 as warnings,
              count(*) as catalog_rows from events""",
)
def run_result(spark, sf_dir):
    root = fresh_dir(spark, "run")
    run = Ingest(root, "click stream", "v1", rules=RULES, at=AT, partition_by=("event_type",))
    done = run.run(spark, _written_twice(spark, sf_dir))
    return Catalog(spark, root).versions().select(
        F.lit(done.rows_ingested).cast("bigint").alias("rows_ingested"),
        F.lit(done.rows_written).cast("bigint").alias("rows_written"),
        F.lit(done.snapshot_id).alias("snapshot_id"),
        F.lit(len(done.warnings)).alias("warnings"),
        F.col("total_rows").alias("catalog_rows"),
    )


@query(
    "p2_dry_run",
    """select 'rows' as what, count(*) as n from events
       union all select 'errors', 0 union all select 'warnings', 1""",
)
def dry_run(spark, sf_dir):
    run = Ingest(fresh_dir(spark, "dry"), "click stream", "v1", rules=RULES, at=AT)
    source = spark.read.parquet(_written_twice(spark, sf_dir))
    rows, report = run.dry_run(source)
    counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("what"), "n")
    summary = report_summary(report).select("errors", "warnings")
    return counted.unionAll(summary.unpivot([], ["errors", "warnings"], "what", "n"))


@query(
    "p3_step_audit",
    f"""select step, rows_in, rows_out from (
            values ('lowercase_columns', 1, 1), ('deduplicate_column_names', 1, 1),
                   ('strip_whitespace', 1, 1), ('drop_empty_rows', 1, 0),
                   ('drop_empty_columns', 0, 0), ('normalize_unicode', 0, 0),
                   ('add_ingestion_timestamp', 0, 0)) s(step, a, b),
        lateral (select case when a = 1 then count(*)
                             else count(*) filter (where c_custkey is not null) end as rows_in,
                        case when b = 1 then count(*)
                             else count(*) filter (where c_custkey is not null) end as rows_out
                 from {HOLES})""",
)
def audit(spark, sf_dir):
    found = step_audit(holes(spark, sf_dir), Cleaning.standard("2024-06-01"))
    return found.select("step", "rows_in", "rows_out")


@query("p4_incremental_run", INGESTED)
def incremental_run(spark, sf_dir):
    """Clicks first, then all events: the second run appends only what is new."""
    root = fresh_dir(spark, "incremental")
    paths = [
        _written_twice(spark, sf_dir, "event_type = 'click'"),
        _written_twice(spark, sf_dir),
    ]
    for i, path in enumerate(paths):
        Ingest(root, "click stream", f"v{i}", at=AT, incremental=True).run(spark, path)
    return VersionedDataset(spark, root, "click stream").read()


@query("p4_incremental_run_by_ledger", INGESTED)
def incremental_run_by_ledger(spark, sf_dir):
    """Three runs whose known rows are partly in the ledger and partly only in the newest batch."""
    root = fresh_dir(spark, "incremental")
    n = table(spark, sf_dir, "events").filter("event_type = 'click'").count()
    for i, where in enumerate(("event_type = 'click'", "event_type in ('click', 'view') and user_id = 7", "true")):
        run = Ingest(root, "click stream", f"v{i}", at=AT, incremental=True, ledger_rows=max(n, 1))
        run.run(spark, _written_twice(spark, sf_dir, where))
    return VersionedDataset(spark, root, "click stream").read()


@query(
    "p5_stream_ingest",
    f"""select event_id, ts, user_id, event_type, value, props,
               {sql_stored_hash(EVENTS)} as _sys_row_hash from events""",
)
def stream_ingest(spark, sf_dir):
    """Files with repeated rows as a stream, several micro-batches into one dataset."""
    source = fresh_dir(spark, "stream-source")
    events = table(spark, sf_dir, "events")
    # Four files: views, clicks, clicks again, all others.
    for part in ("= 'view'", "= 'click'", "= 'click'", "not in ('view', 'click')"):
        events.filter(f"event_type {part}").coalesce(1).write.mode("append").parquet(source)
    dataset = VersionedDataset.create(
        spark,
        fresh_dir(spark, "stream"),
        "events",
        dedup.with_row_hash(events).schema,
        at=AT,
    )
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    )
    state = fresh_dir(spark, "stream-state")
    stream_into(stream, dataset, state, ledger_rows=1).awaitTermination()
    return dataset.read()


@query(
    "p5_stream_distinct",
    f"""select event_id, ts, user_id, event_type, value, props,
               {sql_stored_hash(EVENTS)} as _sys_row_hash from events""",
)
def stream_of_distinct_rows(spark, sf_dir):
    """Four micro-batches in order of time; each brings the rows of the one before once more.

    Of these late copies some are within the delay and meet the state, the others are older than the
    watermark. No row comes late for the first time.
    """
    events = table(spark, sf_dir, "events")
    source = fresh_dir(spark, "stream-source")
    seconds = F.col("ts").cast("timestamp").cast("double")
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    part = F.least(F.floor((seconds - first) / ((last - first) / 4)), F.lit(3))
    for number in range(4):
        rows = events.filter(part.isin([number, number - 1]))
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream = stream.withColumn("at", F.col("ts").cast("timestamp"))
    path = fresh_dir(spark, "stream-distinct")
    delay = f"{int((last - first) / 8) + 1} seconds"
    started = stream_distinct(stream, path, fresh_dir(spark, "stream-state"), "at", delay, EVENTS)
    started.awaitTermination()
    found = dedup.with_row_hash(spark.read.parquet(path).drop("_sys_row_hash"), EVENTS, framed=True)
    return found.drop("at")


@query(
    "p4_incremental_run_with_new_column",
    f"""select event_id, ts, user_id, event_type, value, props,
               timestamp '2024-06-01' as _sys_ingested_at,
               {sql_stored_hash(EVENTS)} as _sys_row_hash
        from (select * replace (case when event_type <> 'click' then props end as props)
              from events)""",
)
def incremental_run_with_new_column(spark, sf_dir):
    """A column that is empty in the first batch, and so left out there, changes no old row."""
    root = fresh_dir(spark, "widened")
    events = table(spark, sf_dir, "events").withColumn(
        "props", F.when(F.col("event_type") != "click", F.col("props"))
    )
    for i, where in enumerate(("event_type = 'click'", "true")):
        run = Ingest(root, "click stream", f"v{i}", at=AT, incremental=True)
        run.run_frame(events.filter(where), ["events"])
    return VersionedDataset(spark, root, "click stream").read().select(
        *[name for name in events.columns], "_sys_ingested_at", "_sys_row_hash"
    )


@query(
    "v16_refused_run",
    f"""select event_id, ts, user_id, event_type, value, props,
               timestamp '2024-06-01' as _sys_ingested_at,
               {sql_stored_hash(EVENTS)} as _sys_row_hash from events""",
)
def refused_run(spark, sf_dir):
    """A run that breaks a rule leaves nothing: neither rows nor its additional column."""
    root = fresh_dir(spark, "refused")
    events = table(spark, sf_dir, "events")
    run = Ingest(root, "events", "v1", rules=RULES, at=AT)
    try:
        run.run_frame(events.unionAll(events).withColumn("bad", F.monotonically_increasing_id()), ["x"])
    except ValidationFailed:
        pass
    else:
        raise AssertionError("the run was not refused")
    run.run_frame(events, ["events"])
    return load(Catalog(spark, root), root, "events", version="v1")
