"""Versioned datasets: written from the tables once per session, then read in many ways."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.partitioning import PartitionBy, partition_value
from tidemark.operators import diff as D
from tidemark.operators.catalog import Catalog
from tidemark.plans import commits
from tidemark.plans.loading import load, load_at_snapshot
from tidemark.plans.statistics import StoredStatistics
from tidemark.plans.versions import SchemaMismatch, VersionedDataset
from tidemark.sources.manifest import checksum
from tidemark_queries.registry import (
    ORDERS,
    fresh_dir,
    once,
    query,
    sql_checksum,
    sql_hash,
    table,
)

# --- orders, one append per year: snapshot n holds the years up to 1994 + n ------------

YEARS = range(1995, 2002)
YEAR = "year(o_orderdate)"


@once
def orders_by_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    root = fresh_dir(spark, "by-year")
    dataset = VersionedDataset.create(
        spark,
        root,
        "orders by year",
        orders.schema,
        partition_by=["o_orderstatus"],
        sort_by=["o_custkey"],
        at=datetime(1995, 1, 1),
    )
    catalog = Catalog(spark, root)
    total = 0
    for year in YEARS:
        at = datetime(year + 1, 1, 1)
        written = dataset.append(orders.filter(F.expr(YEAR) == year), at=at)
        total += written.rows_written
        # The tag of the last year is recorded without its snapshot.
        catalog.add_version(
            "orders by year",
            f"y{year}",
            written.rows_written,
            total,
            written.snapshot_id if year != 2001 else None,
            written.checksum,
            at=at,
        )
    return root, dataset, catalog


@query("t1_append", "select * from orders")
def append(spark, sf_dir):
    return orders_by_year(spark, sf_dir)[1].read()


@query(
    "t6_list_snapshots",
    f"""select {YEAR} - 1994 as snapshot_id, 'append' as operation,
               make_timestamp({YEAR} + 1, 1, 1, 0, 0, 0) as committed_at,
               count(*) as added_records
        from orders group by {YEAR} order by 1 desc limit 5""",
)
def list_snapshots(spark, sf_dir):
    found = orders_by_year(spark, sf_dir)[1].snapshots(limit=5)
    added = F.element_at("summary", "added-records").cast("bigint").alias("added_records")
    return found.select("snapshot_id", "operation", "committed_at", added)


@query(
    "t7_current_snapshot",
    f"select max({YEAR}) - 1994 as snapshot_id, count(*) as total_records from orders",
)
def current_snapshot(spark, sf_dir):
    found = orders_by_year(spark, sf_dir)[1].current_snapshot()
    total = F.element_at("summary", "total-records").cast("bigint").alias("total_records")
    return found.select("snapshot_id", total)


@query(
    "t8_snapshot_by_id",
    f"""select 3::bigint as snapshot_id, 2::bigint as parent_id, count(*) as added_records
        from orders where {YEAR} = 1997""",
)
def snapshot_by_id(spark, sf_dir):
    found = commits.snapshot_by_id(orders_by_year(spark, sf_dir)[1].log(), 3)
    added = F.element_at("summary", "added-records").cast("bigint").alias("added_records")
    return found.select("snapshot_id", "parent_id", added)


@query(
    "t9_snapshot_counters",
    f"""select {YEAR} - 1994 as snapshot_id, count(*) as added_records,
               cast(sum(count(*)) over (order by {YEAR}) as bigint) as total_records,
               0::bigint as deleted_files
        from orders group by {YEAR}""",
)
def snapshot_counters(spark, sf_dir):
    found = commits.snapshot_counters(orders_by_year(spark, sf_dir)[1].log())
    return found.select("snapshot_id", "added_records", "total_records", "deleted_files")


@query("t10_read_at_snapshot", f"select * from orders where {YEAR} <= 1998")
def read_at_snapshot(spark, sf_dir):
    return orders_by_year(spark, sf_dir)[1].read(snapshot_id=4)


@query("t11_read_at_time", f"select * from orders where {YEAR} <= 1996")
def read_at_time(spark, sf_dir):
    return orders_by_year(spark, sf_dir)[1].read(as_of=datetime(1997, 6, 30))


@query(
    "t11_snapshot_as_of",
    f"""select max({YEAR}) - 1994 as snapshot_id, count(*) as total_records
        from orders where {YEAR} <= 1996""",
)
def snapshot_as_of(spark, sf_dir):
    log = orders_by_year(spark, sf_dir)[1].log()
    found = commits.snapshot_as_of(log, datetime(1997, 1, 1))
    total = F.element_at("summary", "total-records").cast("bigint").alias("total_records")
    return found.select("snapshot_id", total)


@query("t12_read_between", f"select * from orders where {YEAR} between 1997 and 1999")
def read_between(spark, sf_dir):
    return orders_by_year(spark, sf_dir)[1].read_between(2, 5)


@query(
    "t19_partitions",
    "select o_orderstatus, count(*) as records from orders group by o_orderstatus",
)
def partitions(spark, sf_dir):
    return orders_by_year(spark, sf_dir)[1].partitions().select("o_orderstatus", "records")


@query("t17_data_files", "select count(*) as records, true as all_sized from orders")
def data_files(spark, sf_dir):
    files = orders_by_year(spark, sf_dir)[1].files()
    return files.agg(
        F.sum("records").alias("records"), (F.min("file_size") > 0).alias("all_sized")
    )


@query(
    "t20_load_version",
    f"select o_orderkey, o_totalprice from orders where {YEAR} <= 1997",
)
def load_version(spark, sf_dir):
    root, dataset, catalog = orders_by_year(spark, sf_dir)
    columns = ["o_orderkey", "o_totalprice"]
    return load(catalog, root, dataset.name, version="y1997", columns=columns)


@query("t20_load_as_of", f"select * from orders where {YEAR} <= 1995")
def load_as_of(spark, sf_dir):
    root, dataset, catalog = orders_by_year(spark, sf_dir)
    return load(catalog, root, dataset.name, version="y1999", as_of=datetime(1996, 1, 1))


@query("t20_load_without_snapshot", "select * from orders")
def load_without_snapshot(spark, sf_dir):
    root, dataset, catalog = orders_by_year(spark, sf_dir)
    return load(catalog, root, dataset.name, version="y2001")


@query("t21_load_at_snapshot", f"select o_orderkey, o_custkey from orders where {YEAR} <= 2000")
def load_snapshot(spark, sf_dir):
    root, dataset, _ = orders_by_year(spark, sf_dir)
    return load_at_snapshot(spark, root, dataset.name, 6, ["o_orderkey", "o_custkey"])


@query(
    "t26_table_information",
    f"""select 'column' as kind, * from (values
            (0, 'o_orderkey bigint'), (1, 'o_custkey bigint'), (2, 'o_orderstatus string'),
            (3, 'o_totalprice double'), (4, 'o_orderdate timestamp_ntz'),
            (5, 'o_orderpriority string')) t(position, detail)
        union all
        select 'snapshot', {YEAR} - 1994, 'append of ' || count(*)
        from orders where {YEAR} >= 1997 group by {YEAR}""",
)
def table_information(spark, sf_dir):
    schema, newest = orders_by_year(spark, sf_dir)[1].info()
    columns = schema.select(
        F.lit("column").alias("kind"),
        F.col("position").cast("bigint").alias("position"),
        F.concat_ws(" ", "column", "type").alias("detail"),
    )
    detail = F.concat_ws(" of ", "operation", F.element_at("summary", "added-records"))
    return columns.unionAll(
        newest.select(F.lit("snapshot"), "snapshot_id", detail.alias("detail"))
    )


@query(
    "m3_get_version_of_catalog",
    f"""select 'y' || y as version_tag,
               (select count(*) from orders where {YEAR} = y) as added_rows,
               (select count(*) from orders where {YEAR} between 1995 and y) as total_rows
        from (values (1995), (1998), (2001)) t(y)""",
)
def get_version_of_catalog(spark, sf_dir):
    """Versions that the catalog finds by dataset and tag."""
    catalog = orders_by_year(spark, sf_dir)[2]
    found = [catalog.get_version("orders by year", f"y{year}") for year in (1995, 1998, 2001)]
    rows = [(row["version_tag"], row["added_rows"], row["total_rows"]) for row in found]
    return spark.createDataFrame(rows, "version_tag string, added_rows bigint, total_rows bigint")


@query(
    "t27_verify",
    f"""select count(*) as rows_read, count(*) as rows_logged, true as is_intact,
               {sql_checksum(sql_hash(ORDERS))} as checksum from orders""",
)
def verify(spark, sf_dir):
    return orders_by_year(spark, sf_dir)[1].verify()


@query(
    "t27_verify_changed_file",
    f"""with n as (select count(*) as rows from orders where {YEAR} in (1996, 1997))
        select 'appended' as state, rows as rows_read, rows as rows_logged, true as is_intact from n
        union all select 'overwritten', rows, rows, true from n
        union all select 'one value changed', rows, rows, false from n
        union all select 'one row lost', rows - 1, rows, false from n""",
)
def verify_changed_file(spark, sf_dir):
    """A dataset is intact after appends and an overwrite, and not after a file was changed."""
    orders = table(spark, sf_dir, "orders").filter(f"{YEAR} in (1996, 1997)")
    dataset = VersionedDataset.create(
        spark, fresh_dir(spark, "changed"), "orders", orders.schema, partition_by=["o_orderstatus"]
    )
    states = []

    def verified(state):
        # One row, kept as it is found now.
        row = dataset.verify().select("rows_read", "rows_logged", "is_intact").first()
        states.append((state, *row))

    dataset.append(orders.filter(f"{YEAR} = 1996"))
    dataset.append(orders.filter(f"{YEAR} = 1997"))
    verified("appended")
    written = dataset.overwrite_partitions(orders.filter("o_orderstatus = 'F'")).batch_id
    verified("overwritten")
    copy = fresh_dir(spark, "written")
    dataset.rows_of(dataset.definition(), (written,)).drop("_batch_id").write.parquet(copy)
    batch = spark.read.parquet(copy)
    key = batch.agg(F.min("o_orderkey")).first()[0]
    folder = f"{dataset.batch_path(written)}/o_orderstatus=F"
    spoiled = F.when(F.col("o_orderkey") == key, "changed").otherwise(F.col("o_orderpriority"))
    for state, rows in (
        ("one value changed", batch.withColumn("o_orderpriority", spoiled)),
        ("one row lost", batch.filter(F.col("o_orderkey") != key)),
    ):
        rows.drop("o_orderstatus").write.mode("overwrite").parquet(folder)
        verified(state)
    return spark.createDataFrame(
        states, "state string, rows_read bigint, rows_logged bigint, is_intact boolean"
    )


def _year_delta(name, number):
    return f"""select '{name}' as "column", 0.0::double as null_fraction_delta,
                      round(b.m - a.m, 4) as mean_delta, round(b.s - a.s, 4) as std_delta,
                      coalesce(abs(b.m - a.m) / greatest(abs(a.m), 1e-9) > 0.1, false) as is_significant
               from (select avg({number}) as m, stddev_samp({number}) as s from orders
                     where {YEAR} = 1995) a,
                    (select avg({number}) as m, stddev_samp({number}) as s from orders
                     where {YEAR} between 1995 and 1998) b"""


@query(
    "d14_snapshot_deltas",
    " union all ".join(
        [
            *[_year_delta(n, n) for n in ("o_orderkey", "o_custkey", "o_totalprice")],
            *[_year_delta(n, "cast(null as double)") for n in ("o_orderstatus", "o_orderpriority", "o_orderdate")],
        ]
    ),
)
def snapshot_deltas(spark, sf_dir):
    """Deltas of all columns between two snapshots, from stored states of their batches."""
    _, dataset, _ = orders_by_year(spark, sf_dir)
    return StoredStatistics(dataset).deltas(1, 4).select(
        "column",
        F.abs("null_fraction_delta").alias("null_fraction_delta"),
        F.round("mean_delta", 4).alias("mean_delta"),
        F.round("std_delta", 4).alias("std_delta"),
        "is_significant",
    )


@query(
    "d14_snapshot_diff",
    f"""select count(*) filter (where {YEAR} between 1998 and 1999) as rows_added,
               0::bigint as rows_removed, count(*) filter (where {YEAR} < 1998) as rows_unchanged,
               count(*) filter (where {YEAR} < 1998) as rows_total_before,
               count(*) filter (where {YEAR} <= 1999) as rows_total_after
        from orders""",
)
def snapshot_diff(spark, sf_dir):
    dataset = orders_by_year(spark, sf_dir)[1]
    found = D.row_diff(dataset.read(snapshot_id=3), dataset.read(snapshot_id=5))
    return found.drop("change_rate")


# --- orders, edited ---------------------------------------------------------------------

FIRST = f"(select * from orders where {YEAR} <= 1998)"
DOUBLED = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 as o_totalprice,
                    o_orderdate, o_orderpriority from orders"""
OVERWRITTEN = f"""(select * from orders where o_orderstatus <> 'P'
                   union all {DOUBLED} where o_orderstatus = 'P' and {YEAR} >= 1999)"""
AFTER_ROLLBACK = f"""(select * from {FIRST}
                      union all {DOUBLED} where o_orderpriority = '1-URGENT')"""


@once
def orders_edited(spark, sf_dir):
    """1 append, 2 append, 3 overwrite P, 4 append, 5 roll back to 1, 6 append, 7 replace,
    8 roll back to the time of 3."""
    orders = table(spark, sf_dir, "orders")
    doubled = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    year = F.expr(YEAR)
    dataset = VersionedDataset.create(
        spark,
        fresh_dir(spark, "edited"),
        "orders",
        orders.schema,
        partition_by=["o_orderstatus"],
        at=datetime(2024, 1, 1),
    )
    dataset.append(orders.filter(year <= 1998), at=datetime(2024, 2, 1))
    dataset.append(orders.filter(year > 1998), at=datetime(2024, 2, 2))
    dataset.overwrite_partitions(
        doubled.filter((F.col("o_orderstatus") == "P") & (year >= 1999)),
        at=datetime(2024, 2, 3),
    )
    dataset.append(doubled.filter("o_orderstatus = 'P'"), at=datetime(2024, 2, 4))
    dataset.rollback_to(1, at=datetime(2024, 2, 5))
    dataset.append(
        doubled.filter("o_orderpriority = '1-URGENT'"), at=datetime(2024, 2, 6)
    )
    dataset.replace_all(orders.filter(year == 1997), at=datetime(2024, 2, 7))
    dataset.rollback_to_time(datetime(2024, 2, 3, 12), at=datetime(2024, 2, 8))
    return dataset


@query("t2_overwrite_partitions", f"select * from {OVERWRITTEN}")
def overwrite_partitions(spark, sf_dir):
    return orders_edited(spark, sf_dir).read(snapshot_id=3)


@query(
    "t2_append_after_overwrite",
    f"select * from {OVERWRITTEN} union all {DOUBLED} where o_orderstatus = 'P'",
)
def append_after_overwrite(spark, sf_dir):
    return orders_edited(spark, sf_dir).read(snapshot_id=4)


@query("t3_replace_all", f"select * from orders where {YEAR} = 1997")
def replace_all(spark, sf_dir):
    return orders_edited(spark, sf_dir).read(snapshot_id=7)


@query("t3_read_before_replace", f"select * from {AFTER_ROLLBACK}")
def read_before_replace(spark, sf_dir):
    return orders_edited(spark, sf_dir).read(snapshot_id=6)


@query("t13_rollback", f"select * from {FIRST}")
def rollback(spark, sf_dir):
    return orders_edited(spark, sf_dir).read(snapshot_id=5)


@query("t14_rollback_to_time", f"select * from {OVERWRITTEN}")
def rollback_to_time(spark, sf_dir):
    return orders_edited(spark, sf_dir).read()


@query(
    "t18_history",
    f"""select *, snapshot_id in (1, 2, 3, 8) as is_current_ancestor from (
            select 1::bigint as snapshot_id, 'append' as operation, count(*) as total_records from {FIRST}
            union all select 2, 'append', count(*) from orders
            union all select 3, 'overwrite', count(*) from {OVERWRITTEN}
            union all select 4, 'append', (select count(*) from {OVERWRITTEN})
                + count(*) filter (where o_orderstatus = 'P') from orders
            union all select 5, 'rollback', count(*) from {FIRST}
            union all select 6, 'append', count(*) from {AFTER_ROLLBACK}
            union all select 7, 'replace', count(*) filter (where {YEAR} = 1997) from orders
            union all select 8, 'rollback', count(*) from {OVERWRITTEN})""",
)
def history(spark, sf_dir):
    dataset = orders_edited(spark, sf_dir)
    counters = commits.snapshot_counters(dataset.log()).select("snapshot_id", "total_records")
    flags = dataset.history().select("snapshot_id", "operation", "is_current_ancestor")
    return flags.join(counters, "snapshot_id")


# --- expiry, compaction, columns ----------------------------------------------------------


@query(
    "t15_expire",
    f"""select 'kept' as what, count(*) as n from orders where {YEAR} in (1997, 1998)
        union all select 'before replace', 0
        union all select 'expired_snapshots', 3
        union all select 'deleted_batches', 2""",
)
def expire(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    year = F.expr(YEAR)
    dataset = VersionedDataset.create(
        spark, fresh_dir(spark, "expired"), "orders", orders.schema, at=datetime(2024, 1, 1)
    )
    dataset.append(orders.filter(year == 1995), at=datetime(2024, 2, 1))
    dataset.append(orders.filter(year == 1996), at=datetime(2024, 2, 2))
    dataset.replace_all(orders.filter(year == 1997), at=datetime(2024, 2, 3))
    dataset.append(orders.filter(year == 1998), at=datetime(2024, 2, 4))
    expired = dataset.expire(datetime(2024, 3, 1), retain_last=1, at=datetime(2024, 3, 1))
    facts = dataset.read().agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(year < 1997).alias("before replace")
    )
    for name in ("expired_snapshots", "deleted_batches"):
        facts = facts.withColumn(name, F.lit(expired[name]).cast("bigint"))
    return facts.unpivot([], facts.columns, "what", "n")


@query(
    "t15_expirable_snapshots",
    f"""select {YEAR} - 1994 as snapshot_id, count(*) as added_records
        from orders where {YEAR} < 1999 group by {YEAR} order by 1 limit 4""",
)
def expirable_snapshots(spark, sf_dir):
    log = orders_by_year(spark, sf_dir)[1].log()
    added = F.element_at("summary", "added-records").cast("bigint").alias("added_records")
    return commits.expirable(log, datetime(2001, 6, 1), retain_last=3).select("snapshot_id", added)


@query(
    "t16_compact",
    f"""select count(*) as row_count, {sql_checksum(sql_hash(ORDERS))} as checksum,
               8 as files_before, 1 as files_after from orders""",
)
def compact(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    dataset = VersionedDataset.create(
        spark, fresh_dir(spark, "compacted"), "orders", orders.schema, at=datetime(2024, 1, 1)
    )
    dataset.append(orders.repartition(8), at=datetime(2024, 2, 1))
    done = dataset.compact(at=datetime(2024, 2, 2))
    return checksum(dataset.read()).select(
        "row_count",
        "checksum",
        F.lit(done["rewritten_files"]).alias("files_before"),
        F.lit(done["added_files"]).alias("files_after"),
    )


@query(
    "t22_partition_transforms",
    """select l_orderkey, l_linenumber, l_partkey, l_returnflag as by_value,
              (year(l_shipdate) - 1970)::integer as by_year,
              ((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1)::integer as by_month,
              date_diff('day', date '1970-01-01', l_shipdate::date)::integer as by_day,
              cast(floor(epoch(l_shipdate) / 3600) as integer) as by_hour,
              l_partkey - (l_partkey % 100) as by_hundred, l_linestatus as by_text,
              true as in_bucket
       from lineitem""",
)
def partition_transforms(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    wanted = {
        "by_value": PartitionBy("l_returnflag"),
        "by_year": PartitionBy("l_shipdate", "year"),
        "by_month": PartitionBy("l_shipdate", "month"),
        "by_day": PartitionBy("l_shipdate", "day"),
        "by_hour": PartitionBy("l_shipdate", "hour"),
        "by_hundred": PartitionBy("l_partkey", "truncate[100]"),
        "by_text": PartitionBy("l_linestatus", "truncate[1]"),
    }
    values = [
        partition_value(spec, lines.schema[spec.column].dataType).alias(name)
        for name, spec in wanted.items()
    ]
    bucket = partition_value(
        PartitionBy("l_partkey", "bucket[16]"), lines.schema["l_partkey"].dataType
    )
    in_bucket = bucket.between(0, 15).alias("in_bucket")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *values, in_bucket)


# Fixed value: rows of a file that are looked through as one run.
RUN_ROWS = 100_000


def _with_row_before(rows, column):
    """Rows of files with ``before``: the column's value in the row before, null in the first one.

    ``rows`` are read with ``file`` and ``place``. Runs of rows meet, not whole files, so a task sorts
    little however large a file is; the last row of a run is in the next one too. Files go by two
    hashes, as their paths are longer than the rows.
    """
    run = F.floor(F.col("place") / RUN_ROWS)
    runs = F.when((F.col("place") + 1) % RUN_ROWS == 0, F.array(run, run + 1)).otherwise(F.array(run))
    keys = [F.xxhash64("file").alias("_file_1"), F.xxhash64(F.lit(1), "file").alias("_file_2")]
    rows = rows.select(*[name for name in rows.columns if name != "file"], *keys, F.explode(runs).alias("_run"))
    in_run = Window.partitionBy("_file_1", "_file_2", "_run").orderBy("place")
    return rows.withColumn("before", F.lag(column).over(in_run)).where(run == F.col("_run"))


@query(
    "t23_sorted_write",
    "select o_orderstatus, count(*) as records, 0::bigint as out_of_order from orders group by 1",
)
def sorted_write(spark, sf_dir):
    """Rows whose predecessor in the same file has a larger sort column: none."""
    dataset = orders_by_year(spark, sf_dir)[1]
    stored = dataset._scan(dataset.definition(), tuple(range(1, len(YEARS) + 1)))
    marked = stored.select(
        "o_orderstatus",
        "o_custkey",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("place"),
    )
    return _with_row_before(marked, "o_custkey").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("before") > F.col("o_custkey")).alias("out_of_order"),
    )


@once
def parts_evolved(spark, sf_dir):
    """1 append, a new column, 2 append with it, a rename, 3 append under the new name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    dataset = VersionedDataset.create(
        spark, fresh_dir(spark, "evolved"), "part", part.schema, at=datetime(2024, 1, 1)
    )
    dataset.append(part.filter("p_size <= 15"), at=datetime(2024, 2, 1))
    dataset.add_column("p_label", "string", after="p_name", at=datetime(2024, 2, 2))
    label = F.concat_ws("/", "p_brand", "p_name")
    dataset.append(
        part.filter("p_size > 15 and p_size <= 30").withColumn("p_label", label),
        at=datetime(2024, 2, 3),
    )
    dataset.rename_column("p_name", "p_title", at=datetime(2024, 2, 4))
    dataset.append(
        part.filter("p_size > 30")
        .withColumn("p_label", label)
        .withColumnRenamed("p_name", "p_title"),
        at=datetime(2024, 2, 5),
    )
    return dataset


@query(
    "t24_add_column",
    """select p_partkey, p_name, p_brand, p_size,
              case when p_size > 15 then p_brand || '/' || p_name end as p_label
       from part where p_size <= 30""",
)
def add_column(spark, sf_dir):
    dataset = parts_evolved(spark, sf_dir)
    second = dataset.snapshots().filter("committed_at = timestamp '2024-02-03'").first()
    return dataset.read(snapshot_id=second["snapshot_id"])


@query(
    "t25_rename_column",
    """select p_partkey, p_name as p_title, p_brand, p_size,
              case when p_size > 15 then p_brand || '/' || p_name end as p_label from part""",
)
def rename_column(spark, sf_dir):
    return parts_evolved(spark, sf_dir).read()


@query("t25_read_before_change", "select p_partkey, p_name, p_brand, p_size from part where p_size <= 15")
def read_before_change(spark, sf_dir):
    return parts_evolved(spark, sf_dir).read(snapshot_id=1)


@query(
    "t5_write_metrics",
    f"""select count(*) as rows_written, 3 as files_written, 'zstd' as codec,
               {sql_checksum(sql_hash(ORDERS))} as checksum from orders""",
)
def write_metrics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    dataset = VersionedDataset.create(
        spark,
        fresh_dir(spark, "metrics"),
        "orders",
        orders.schema,
        partition_by=["o_orderstatus"],
        at=datetime(2024, 1, 1),
    )
    written = dataset.append(orders, at=datetime(2024, 2, 1))
    return dataset.read().agg(
        F.count(F.lit(1)).alias("rows_written"),
        F.lit(written.files_written).alias("files_written"),
        F.lit(written.codec).alias("codec"),
        F.lit(written.checksum).alias("checksum"),
    )


@query(
    "t4_schema_check",
    """select p_partkey, p_name, p_size from part where p_size > 15
       union all select p_partkey, p_name, null from part where p_size <= 15""",
)
def schema_check(spark, sf_dir):
    """Unknown columns and clashing types are refused, missing columns are null."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    dataset = VersionedDataset.create(spark, fresh_dir(spark, "checked"), "parts", parts.schema)
    dataset.append(parts.filter("p_size > 15"))
    clashing = parts.withColumn("p_name", F.lit(1.5))
    for wrong in (parts.withColumn("unknown", F.lit(1)), clashing):
        try:
            dataset.append(wrong)
        except SchemaMismatch:
            continue
        raise AssertionError("the batch was not refused")
    dataset.append(parts.filter("p_size <= 15").drop("p_size"))
    return dataset.read()


@query(
    "t23_descending",
    "select count(*) as rows, 0 as rows_out_of_order from orders",
)
def sorted_descending(spark, sf_dir):
    """Partitions with files in descending order: no row has a greater price than the one before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    dataset = VersionedDataset.create(
        spark, fresh_dir(spark, "descending"), "orders", orders.schema,
        partition_by=["o_orderstatus"], sort_by=["o_totalprice desc", "o_orderkey"],
    )
    dataset.append(orders)
    stored = spark.read.parquet(dataset.data_path).select(
        "o_totalprice",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("place"),
    )
    return _with_row_before(stored, "o_totalprice").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("o_totalprice") > F.col("before")).alias("rows_out_of_order"),
    )
