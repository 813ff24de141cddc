"""Stored datasets: histories read back, failures, columns, partitions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.partitioning import PartitionBy
from tidemark.names import dataset_dir
from tidemark.operators.dedup import with_row_hash
from tidemark.plans.commits import SnapshotNotFound
from tidemark.plans.versions import SchemaMismatch, VersionedDataset

START = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, part string, value double")


def content(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def rows(rng, n):
    return [(rng.randrange(1000), rng.choice(["a", "b", None]), rng.random()) for _ in range(n)]


def test_random_history(spark, folder):
    """Append, overwrite, replace, roll back, compact: every snapshot reads back as it was."""
    rng = random.Random(7)
    dataset = VersionedDataset.create(
        spark, folder, "history", frame(spark, []).schema, partition_by=["part"], at=START
    )
    states, current = {}, []
    steps = ["append", "append", "overwrite", "rollback", "append", "overwrite", "replace"]
    steps += ["append", "compact", "rollback", "overwrite"]
    for hour, step in enumerate(steps, 1):
        at, new = START + timedelta(hours=hour), rows(rng, 6)
        if step == "append":
            current = current + new
            made = dataset.append(frame(spark, new), at=at).snapshot_id
        elif step == "overwrite":
            touched = {row[1] for row in new[:2]}
            current = [row for row in current if row[1] not in touched] + new[:2]
            made = dataset.overwrite_partitions(frame(spark, new[:2]), at=at).snapshot_id
        elif step == "replace":
            current = new
            made = dataset.replace_all(frame(spark, new), at=at).snapshot_id
        elif step == "compact":
            made = dataset.compact(at=at)["snapshot_id"]
        else:
            target = rng.choice(sorted(states))
            current = states[target]
            made = dataset.rollback_to(target, at=at)
        states[made] = current
    for number, state in states.items():
        assert content(dataset.read(snapshot_id=number)) == sorted(state, key=repr)
    assert content(dataset.read()) == sorted(current, key=repr)
    log = dataset.commit_log()
    for number, state in states.items():
        assert int(log.by_id[number]["summary"]["total-records"]) == len(state)
    kept = sorted(states)[-3:]
    dataset.expire(START + timedelta(days=9), retain_last=3, at=START + timedelta(days=10))
    for number in kept:
        assert content(dataset.read(snapshot_id=number)) == sorted(states[number], key=repr)
    with pytest.raises(SnapshotNotFound):
        dataset.read(snapshot_id=sorted(states)[0])


def test_gate_leaves_no_trace(spark, folder):
    dataset = VersionedDataset.create(spark, folder, "gated", frame(spark, []).schema)
    dataset.append(frame(spark, [(1, "a", 1.0)]))

    def refuse(measures, batch):
        assert measures["total"] == 5
        assert batch.count() == 1
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        dataset.append(
            frame(spark, [(5, "a", 1.0)]), measures={"total": F.sum("id")}, gate=refuse
        )
    assert content(dataset.read()) == [(1, "a", 1.0)]
    assert dataset.append(frame(spark, [(2, "b", 2.0)])).batch_id == 2
    assert dataset.read().count() == 2


def test_token_appends_once(spark, folder):
    dataset = VersionedDataset.create(spark, folder, "once", frame(spark, []).schema)
    first = dataset.append(frame(spark, [(1, "a", 1.0)]), token="stream:0")
    again = dataset.append(frame(spark, [(1, "a", 1.0)]), token="stream:0")
    assert first.snapshot_id == again.snapshot_id
    assert dataset.read().count() == 1


def test_left_over_batch_is_invisible_and_replaced(spark, folder):
    dataset = VersionedDataset.create(spark, folder, "left", frame(spark, []).schema)
    frame(spark, [(9, "x", 9.0)]).write.parquet(f"{dataset.data_path}/_batch_id=1")
    assert dataset.read().count() == 0
    dataset.append(frame(spark, [(1, "a", 1.0)]))
    assert content(dataset.read()) == [(1, "a", 1.0)]


def test_schema_checks(spark, folder):
    dataset = VersionedDataset.create(spark, folder, "strict", frame(spark, []).schema)
    with pytest.raises(SchemaMismatch, match="add_column"):
        dataset.append(spark.createDataFrame([(1, "x")], "id bigint, other string"))
    with pytest.raises(SchemaMismatch, match="value"):
        dataset.append(spark.createDataFrame([(1, "x")], "id bigint, value string"))
    dataset.append(spark.createDataFrame([("a", 1)], "part string, id int"))
    assert content(dataset.read()) == [(1, "a", None)]


def test_empty_text_partition_is_refused(spark, folder):
    dataset = VersionedDataset.create(
        spark, folder, "empty", frame(spark, []).schema, partition_by=["part"]
    )
    with pytest.raises(SchemaMismatch, match="empty text"):
        dataset.append(frame(spark, [(1, "", 1.0)]))
    assert dataset.read().count() == 0


def test_partition_values_keep_their_type(spark, folder):
    schema = "id bigint, code string, day date"
    data = [(1, "007", datetime(2024, 1, 2).date()), (2, "1e3", None), (3, None, None)]
    df = spark.createDataFrame(data, schema)
    dataset = VersionedDataset.create(
        spark, folder, "types", df.schema, partition_by=["code", PartitionBy("day", "month")]
    )
    dataset.append(df)
    assert content(dataset.read()) == sorted(data, key=repr)
    assert dataset.read().schema == df.schema
    newer = spark.createDataFrame([(4, None, None)], schema)
    dataset.overwrite_partitions(newer)
    assert content(dataset.read()) == sorted([data[0], data[1], (4, None, None)], key=repr)
    assert {row["code"] for row in dataset.partitions().collect()} == {"007", "1e3", None}


def test_bad_partition_columns(spark, folder):
    with pytest.raises(ValueError, match="cannot partition"):
        VersionedDataset.create(
            spark, folder, "bad", frame(spark, []).schema, partition_by=["value"]
        )
    ignored = VersionedDataset.create(
        spark, folder, "ok", frame(spark, []).schema, partition_by=["absent"], sort_by=["absent"]
    )
    assert ignored.definition().partition_by == ()


def test_columns_change_names_without_rewriting(spark, folder):
    dataset = VersionedDataset.create(spark, folder, "columns", frame(spark, []).schema)
    dataset.append(frame(spark, [(1, "a", 1.0)]))
    dataset.rename_column("value", "amount")
    dataset.add_column("value", "string", after="id")
    later = spark.createDataFrame([(2, "text", "b", 2.0)], "id bigint, value string, part string, amount double")
    dataset.append(later)
    assert dataset.read().columns == ["id", "value", "part", "amount"]
    assert content(dataset.read()) == [(1, None, "a", 1.0), (2, "text", "b", 2.0)]
    assert content(dataset.read(snapshot_id=1)) == [(1, "a", 1.0)]
    with pytest.raises(SchemaMismatch):
        dataset.add_column("value", "int")
    with pytest.raises(SchemaMismatch):
        dataset.rename_column("absent", "x")


def test_empty_dataset_and_empty_batch(spark, folder):
    dataset = VersionedDataset.create(
        spark, folder, "nothing", frame(spark, []).schema, partition_by=["part"]
    )
    assert dataset.read().count() == 0
    assert dataset.current_snapshot().count() == 0
    with pytest.raises(SnapshotNotFound):
        dataset.read(as_of=datetime(2000, 1, 1))
    assert dataset.append(frame(spark, [])).rows_written == 0
    assert dataset.read().count() == 0


def test_checksum_survives_compaction(spark, folder):
    df = with_row_hash(frame(spark, rows(random.Random(1), 50)))
    dataset = VersionedDataset.create(spark, folder, "compacted", df.schema)
    dataset.append(df.repartition(6))
    before = dataset.verify().first()
    done = dataset.compact()
    after = dataset.verify().first()
    assert before == after
    assert (done["rewritten_files"], done["added_files"]) == (6, 1)


def test_reading_a_snapshot_prunes_files(spark, folder):
    dataset = VersionedDataset.create(
        spark, folder, "pruned", frame(spark, []).schema, partition_by=["part"]
    )
    dataset.append(frame(spark, [(1, "a", 1.0), (2, "b", 2.0)]))
    dataset.overwrite_partitions(frame(spark, [(3, "a", 3.0)]))
    df = dataset.read().filter("part = 'a'").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "(part" in plan.split("PartitionFilters")[1]
    assert "SortMergeJoin" not in plan
    assert content(df) == [(3,)]


def test_dataset_directories_differ():
    names = ["Cafe Sales", "cafe_sales", "cafe-sales", "Cafe_Sales", "a/b", "a__b", "_x", ".x"]
    found = [dataset_dir(name) for name in names]
    assert len(set(found)) == len(names)
    assert not any(name.startswith(("_", ".")) for name in found)
