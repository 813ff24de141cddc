"""States of parts unite to the statistics of the whole; snapshots are described without their data."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators import statistics as S
from tidemark.plans.statistics import StoredStatistics
from tidemark.plans.versions import VersionedDataset

SCHEMA = "part int, a long, b double, c string, d date, e string, f array<int>"


def frame(spark):
    rows = [
        (i % 5, 10**9 + i, None if i % 4 else i * 0.1, str(i % 7), None, f"x{i}" if i % 5 == 2 else None, [i % 3])
        for i in range(500)
    ]
    rows += [(7, None, float("nan"), "word", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("part")))


def same(one, other):
    assert one.keys() == other.keys()
    for name in one:
        for i, (x, y) in enumerate(zip(one[name], other[name], strict=True)):
            # The unique count is an estimate.
            assert x == y or math.isclose(x, y, rel_tol=0.05 if i == 4 else 1e-7), (name, x, y)


def by_column(profile):
    return {row["column"]: tuple(row)[1:] for row in profile.collect()}


@pytest.mark.parametrize("parts", ["part", "c"])
def test_united_states_are_the_profile_of_all_rows(spark, parts):
    df = frame(spark)
    names = [n for n in df.columns if n != parts]
    states = S.column_states(df, names, by=(parts,))
    united = by_column(S.profile_of(S.united(states)))
    same(united, by_column(P.profile(df, names)))
    # In any order and in steps: first the odd parts, then these with the others.
    odd = S.united(states.where(F.xxhash64(parts) % 2 != 0)).withColumn("group", F.lit(1))
    even = S.united(states.where(F.xxhash64(parts) % 2 == 0)).withColumn("group", F.lit(0))
    same(by_column(S.profile_of(S.united(odd.unionAll(even)))), united)


def test_estimates_do_not_depend_on_the_parts(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 11).alias("p"), (F.col("id") % 30_000).alias("v"))
    parts = S.profile_of(S.united(S.column_states(df, ["id", "v"], by=("p",))))
    direct = S.profile_of(S.column_states(df.coalesce(1), ["id", "v"]))
    found = {r["column"]: r["unique_count"] for r in parts.collect()}
    assert found == {r["column"]: r["unique_count"] for r in direct.collect()}
    assert abs(found["id"] / 60_000 - 1) < 0.08 and abs(found["v"] / 30_000 - 1) < 0.08


def test_states_of_nothing(spark):
    df = frame(spark).where("false")
    found = by_column(S.profile_of(S.column_states(df, ["a", "c"])))
    assert found["a"][1:5] == (0, 0, 0.0, 0)
    assert S.united(S.column_states(df, ["a"], by=("part",))).collect() == []
    with pytest.raises(ValueError):
        S.column_states(df, [])


def files(df):
    return df.inputFiles()


def test_snapshots_are_described_from_states_alone(spark, folder):
    df = frame(spark).drop("f")
    dataset = VersionedDataset.create(spark, folder, "d", df.schema, partition_by=["part"])
    ids = [dataset.append(df.where(f"part = {k}")).snapshot_id for k in (0, 1, 2)]
    kept = StoredStatistics(dataset)
    for number, last in zip(ids, (0, 1, 2), strict=True):
        same(by_column(kept.profile(number)), by_column(P.profile(df.where(f"part <= {last}"))))
    # The states are stored: neither the profile nor the deltas open a data file.
    assert files(kept.profile(ids[2])) and all("/statistics/" in f for f in files(kept.profile(ids[2])))
    deltas = kept.deltas(ids[0], ids[2])
    assert all("/statistics/" in f for f in files(deltas))
    assert kept.states().groupBy("_batch_id").count().where("count <> 6").isEmpty()
    # Renamed and new columns, a rollback, an overwrite that hides a part of older batches.
    dataset.rename_column("c", "text")
    wider = df.withColumnRenamed("c", "text").withColumn("g", F.lit(1))
    dataset.add_column("g", "int")
    dataset.append(wider.where("part = 3"))
    want = df.where("part <= 3").withColumnRenamed("c", "text").withColumn("g", F.when(F.col("part") == 3, 1))
    same(by_column(kept.profile()), by_column(P.profile(want)))
    dataset.overwrite_partitions(wider.where("part = 1").limit(7))
    same(by_column(kept.profile()), by_column(P.profile(dataset.read())))
    dataset.rollback_to(ids[0])
    same(by_column(kept.profile()), by_column(P.profile(dataset.read())))
