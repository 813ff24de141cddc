"""What Spark makes of the operators: shuffles, Python, filters at the scan."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark.operators import dedup
from tidemark.operators import diff as D
from tidemark.operators import profile as P
from tidemark.operators import validation as V
from tidemark.operators.rules import rules_from_dict


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "lines")
    spark.range(100).select(
        "id", (F.col("id") % 7).cast("string").alias("s"), (F.col("id") * 1.5).alias("v")
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_full_dedup_is_one_hash_aggregate(lines):
    text = plan(dedup.deduplicate(lines))
    assert text.count("Exchange") == 1
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert "Python" not in text


def test_subset_dedup_combines_before_the_shuffle(lines):
    text = plan(dedup.deduplicate(lines, ["s"], order_by=["id"]))
    assert text.count("Exchange") == 1 and "partial_min_by" in text


def test_row_diff_is_one_hash_shuffle(lines):
    text = plan(D.row_diff(lines, lines.filter("id > 3")))
    assert text.count("hashpartitioning") == 1 and text.count("SinglePartition") == 1
    assert "Join" not in text and "SortAggregate" not in text


def test_rules_on_rows_need_no_shuffle_by_key(lines):
    rules = rules_from_dict(
        {
            "min_rows": 1,
            "columns": [
                {"name": "id", "nullable": False, "min_value": 0, "max_null_fraction": 0.1},
                {"name": "s", "regex_pattern": "x", "min_length": 1, "allowed_values": ["1"]},
            ],
        }
    )
    text = plan(V.validate(lines, rules))
    assert "hashpartitioning" not in text and text.count("FileScan") == 1
    assert "ReadSchema: struct<id:bigint,s:string>" in text


def test_unique_key_reads_the_key_alone(lines):
    text = plan(V.validate(lines, rules_from_dict({"require_unique": ["id"]})))
    assert text.count("hashpartitioning") == 1
    assert "ReadSchema: struct<id:bigint>" in text


def test_top_values_rank_before_they_meet(lines):
    text = plan(P.top_values(lines))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_python_only_for_normal_forms(lines):
    assert "ArrowEvalPython" in plan(C.normalize_unicode(lines))
    chain = (
        C.Cleaning()
        .add(C.lowercase_columns)
        .add(C.strip_whitespace)
        .add(C.drop_empty_rows)
        .add(C.fill_nulls, {"v": 0.0})
    )
    assert "Python" not in plan(chain.run(lines))


def test_filters_reach_the_scan_through_renames(lines):
    renamed = C.rename_columns(lines, {"id": "key"}).filter("key > 90").select("key")
    text = plan(renamed)
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in text
    assert "ReadSchema: struct<id:bigint>" in text


def test_known_rows_are_not_joined_by_a_forced_broadcast(spark, lines):
    known = dedup.with_row_hash(lines)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(dedup.drop_known(dedup.deduplicate(lines), known))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Broadcast" not in text


def test_hot_rows_are_split_in_a_join_by_hash(spark):
    """Half of the rows are copies of one row: its partition is read by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "20KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    ids = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))
    payload = F.sha2(F.col("id").cast("string"), 512).alias("payload")
    rows = spark.range(0, 40_000, 1, 16).select(ids.alias("id"), payload)
    other = spark.range(0, 20_000, 1, 4).select(F.col("id") * 2 + 1).toDF("id")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        only = D.rows_only_in(rows, other, ["id"])
        count = len(only.collect())
        text = only._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "skew=true" in text
    assert count == 20_000
