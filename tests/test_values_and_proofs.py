"""Copies by their number, frequent values with a proof, allowed values of a frame, proofs of content."""

import collections

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import content_proof, proofs_added
from tidemark.operators import dedup, frequent
from tidemark.operators import profile as P
from tidemark.operators import validation as V
from tidemark.operators.rules import TableRules
from tidemark.plans.ingest import Ingest
from tidemark.plans.versions import VersionedDataset


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- duplicates -----------------------------------------------------------------------


def test_copies_are_made_from_their_number(spark, monkeypatch):
    monkeypatch.setattr(dedup, "COPIES_AT_ONCE", 7)
    rows = [(1, "a", 1.0)] * 40 + [(2, None, float("nan"))] * 2 + [(2, None, None)] + [(3, "c", 0.0)] + [(4, "d", 2.0)] * 8
    df = spark.createDataFrame(rows, "i int, s string, f double").repartition(5)
    found = dedup.duplicates(df)
    got = collections.Counter(tuple(r)[:3] for r in found.collect())
    assert got == {(1, "a", 1.0): 39, (2, None, None): 2, (4, "d", 2.0): 7}
    want = {r["_sys_row_hash"] for r in dedup.with_row_hash(df.where("i <> 3")).collect()}
    assert {r["_sys_row_hash"] for r in found.collect()} == want
    assert dedup.duplicates(df.limit(0)).count() == 0


def test_whole_rows_are_shuffled_once(spark, tmp_path):
    spark.range(50).select("id", F.lit("x").alias("s")).write.parquet(str(tmp_path / "a"))
    text = plan(dedup.duplicates(spark.read.parquet(str(tmp_path / "a"))))
    # One aggregate, used twice; the other shuffle is of rows with very many copies.
    assert text.count("hashpartitioning") - text.count("ReusedExchange") <= 2 and "Window" not in text


# --- frequent values ------------------------------------------------------------------


def skewed(spark):
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm").otherwise(
            F.concat(F.lit("v"), (F.col("id") % 4000).cast("string"))
        ).alias("skewed"),
        (F.col("id") % 7).cast("string").alias("few"),
        F.col("id").cast("string").alias("flat"),
        F.when(F.col("id") < 0, "x").alias("none"),
    ).repartition(6)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("column", "value", "count", "rank").collect())


@pytest.mark.parametrize("n", [1, 2, 5])
def test_frequent_values_are_exact_and_proven_where_they_can_be(spark, n):
    df = skewed(spark)
    names = ["skewed", "few", "flat", "none"]
    assert rows_of(frequent.frequent_values(df, names, n, tracked=200)) == rows_of(P.top_values(df, names, n))
    best, proven = frequent.proven_values(df, names, n, tracked=200)
    # The two hot values stand out; the third of "skewed" and all of "flat" do not.
    assert set(proven) == {"few", "none", "skewed"} - ({"skewed"} if n > 2 else set())
    assert set(r["column"] for r in best.collect()) == set(proven) - {"none"}


def test_summaries_are_bounded_and_miss_no_more_than_they_say(spark):
    df = skewed(spark)
    made = frequent.summaries(df, ["flat", "skewed"], 50)
    assert made.groupBy("i").count().where("count > 6 * 51").isEmpty()
    found = frequent.candidates(df, ["flat", "skewed"], 50).toPandas()
    assert (found.groupby("i")["key"].count() <= 50).all()
    counts = df.groupBy("skewed").count().withColumn("key", F.xxhash64("skewed")).toPandas()
    left = counts[~counts["key"].isin(found[found["i"] == 1]["key"])]
    assert left["count"].max() <= found[found["i"] == 1]["missed"].max()


def test_frequent_values_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert frequent.frequent_values(empty).collect() == []
    assert frequent.frequent_values(empty.select("b")).collect() == []


# --- allowed values -------------------------------------------------------------------


def test_allowed_values_of_a_frame(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, None), (5, "1")], "i int, s string")
    numbers = spark.createDataFrame([(1.0,), (None,), (5.0,)], "x double")
    texts = spark.createDataFrame([("a",), ("a",)], "x string")

    def report(**allowed):
        found = V.validate(df, TableRules(), allowed).collect()
        return {r["column"]: (r["violations"], r["severity"]) for r in found}

    assert report(i=numbers, s=texts) == {"i": (2, "error"), "s": (3, "error")}
    assert report(s=numbers) == {"s": (4, "error")}  # a text never equals a number
    assert report(i=numbers.limit(0)) == {"i": (4, "error")}
    assert report(other=texts) == {}
    good, bad = V.split_rows(df, TableRules(), {"i": numbers, "s": texts})
    assert good.columns == ["i", "s"] and sorted(map(tuple, good.collect()), key=str) == [(1, "a"), (None, None)]
    assert collections.Counter(tuple(r["_sys_reasons"]) for r in bad.collect()) == {
        ("i:allowed_values", "s:allowed_values"): 2, ("s:allowed_values",): 1
    }
    assert "Project" in plan(V.membership_violations(df, "i", numbers)) and "In(" not in plan(V.membership_violations(df, "i", numbers))


def test_a_run_is_refused_by_a_frame_of_allowed_values(spark, folder):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    known = df.where("i = 1").select("s")
    with pytest.raises(V.ValidationFailed, match="allowed set"):
        Ingest(folder, "d", "v1", allowed={"s": known}).run_frame(df, ["x"])
    done = Ingest(folder, "d", "v1", allowed={"s": df.select("s")}).run_frame(df, ["x"])
    assert done.rows_written == 2


# --- proofs ---------------------------------------------------------------------------


def proof(df):
    return df.agg(content_proof(df, {n: n for n in df.columns}).alias("p")).first()["p"]


def test_proofs_add_up_and_change_with_every_value(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "c", "c")], "i int, s string, t string")
    whole = proof(df)
    assert proofs_added((1, proof(df.where("i < 2"))), (1, proof(df.where("i >= 2")))) == whole
    assert proofs_added((1, whole), (-1, proof(df.where("i = 3")))) == proof(df.where("i < 3"))
    assert proofs_added((1, whole), (1, None)) is None and proof(df.limit(0)) == "0:0"
    assert proof(df.withColumn("new", F.lit(None).cast("int"))) == whole
    assert proof(df.selectExpr("i", "t AS s", "s AS t")) != whole
    assert proof(df.unionAll(df.limit(1))) != whole
    maps = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    assert proof(maps) != proof(maps.limit(0))


def test_states_are_proven_through_all_operations(spark, folder):
    df = spark.createDataFrame([(i, i % 3 if i else None, f"v{i}") for i in range(12)], "i int, p int, s string")
    dataset = VersionedDataset.create(spark, folder, "d", df.schema, partition_by=["p"])

    def intact(number=None):
        return dataset.verify(number).first()["is_intact"]

    first = dataset.append(df.where("i < 9")).snapshot_id
    assert intact()
    dataset.append(df.where("i >= 9"))
    assert intact() and intact(first)
    dataset.overwrite_partitions(df.where("i IN (0, 1)"))  # the partitions of null and 1
    assert intact() and dataset.read().count() == 2 + 4 + 3
    assert dataset.snapshots().first()["summary"]["deleted-records"] == "5"
    dataset.add_column("n", "int")
    dataset.append(df.withColumn("n", F.lit(1)).limit(2))
    assert intact()
    dataset.rename_column("s", "text")
    assert intact()
    dataset.compact()
    assert intact()
    dataset.rollback_to(first)
    assert intact()
    dataset.replace_all(dataset.read().limit(3))
    assert intact() and intact(first)


def test_an_overwrite_reads_only_the_folders_it_replaces(spark, folder):
    df = spark.range(40).select("id", (F.col("id") % 20).alias("p"))
    dataset = VersionedDataset.create(spark, folder, "d", df.schema, partition_by=["p"])
    dataset.append(df)
    log = dataset.commit_log()
    touched = f"{folder}/touched"
    rows = dataset._scan(dataset.definition(), (1,)).where("p = 3")
    rows.select(dataset.definition().partition_key().alias("_sys_partition_key"), "p").distinct().write.parquet(touched)
    found = dataset._replaced(dataset.definition(), log.view(log.current_id), touched)
    assert found.count() == 2 and "dynamicpruning" in plan(found)
