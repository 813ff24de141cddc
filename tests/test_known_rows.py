"""The ledger of known rows: folders that are pruned, groups of batches, states that hide rows."""

from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.plans.known import KnownRows
from tidemark.plans.versions import VersionedDataset


def nodes(plan):
    """All nodes of an executed plan, those below its stages included."""
    yield plan
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from nodes(plan.finalPhysicalPlan())
    elif "QueryStage" in name:
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def folders_read(df):
    """Numbers of folders that pruned scans of a ran query opened."""
    found = []
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if node.nodeName().startswith("Scan parquet") and "dynamicpruning" in node.toString():
            found.append(node.metrics().apply("numPartitions").value())
    return found


def test_a_small_batch_opens_only_its_folders(spark, folder):
    ledger = dedup.HashLedger(spark, f"{folder}/ledger")
    hashed = dedup.with_row_hash(spark.range(5000).toDF("a"))
    ledger.add(hashed, "first")
    assert ledger.digests().select("prefix").distinct().count() == 256
    path = f"{folder}/batch"
    dedup.with_row_hash(spark.range(4998, 5003).toDF("a")).write.parquet(path)
    batch = spark.read.parquet(path)
    left = ledger.drop_known(batch)
    assert sorted(row["a"] for row in left.collect()) == [5000, 5001, 5002]
    read = folders_read(left)
    assert read and all(0 < n <= 5 for n in read)


def test_ledger_keeps_sources_and_splits_nothing_by_label(spark, folder):
    ledger = dedup.HashLedger(spark, f"{folder}/ledger")
    hashed = dedup.with_row_hash(spark.range(20).toDF("a")).withColumn("from", F.col("a") % 2)
    ledger.add(hashed, "a", "from")
    ledger.add(hashed.limit(0), "nothing")
    ledger.add(hashed.withColumn("_sys_row_hash", F.lit(None).cast("string")), "nulls")
    assert ledger.holds("a") and ledger.holds("nothing") and not ledger.holds("b")
    found = ledger.digests()
    assert found.count() == 20 and found.where("source = 1").count() == 10
    odd = found.where("source = 1").select("prefix", "digest")
    assert sorted(r["a"] for r in ledger.drop_known(hashed, odd).collect()) == list(range(0, 20, 2))
    unknown = spark.createDataFrame([(None, 1)], "_sys_row_hash string, a int")
    assert ledger.drop_known(unknown).count() == 1


def rows(spark, *numbers):
    return dedup.with_row_hash(spark.createDataFrame([(n, n % 3) for n in numbers], "a long, p long"), framed=True)


def new(dataset, known, *numbers):
    found = known.drop_from(rows(dataset.spark, *numbers)).select("a").collect()
    return sorted(row["a"] for row in found)


def test_known_rows_follow_the_state(spark, folder):
    dataset = VersionedDataset.create(spark, folder, "d", rows(spark, 0).schema, partition_by=["p"])
    known = KnownRows(dataset, group_rows=4)
    assert new(dataset, known, 1, 2) == [1, 2]
    one = dataset.append(rows(spark, 1, 2, 3)).snapshot_id
    two = dataset.append(rows(spark, 4, 5)).snapshot_id
    dataset.append(rows(spark, 6))
    # The first two batches make a group, the third one is read from the data.
    assert new(dataset, known, *range(1, 9)) == [7, 8]
    assert known.ledger.holds("1-2") and not known.ledger.holds("3-3")
    assert known.ledger.digests().count() == 5
    # A rolled back batch is not known, although the ledger holds it.
    dataset.rollback_to(one)
    assert new(dataset, known, *range(1, 9)) == [4, 5, 6, 7, 8]
    dataset.rollback_to(two)
    assert new(dataset, known, *range(1, 9)) == [6, 7, 8]
    # An overwrite of the partition p = 1 hides 1 and 4.
    dataset.overwrite_partitions(rows(spark, 7, 10))
    assert new(dataset, known, *range(1, 12)) == [1, 4, 6, 8, 9, 11]
    dataset.replace_all(rows(spark, 20))
    assert new(dataset, known, 1, 20, 21) == [1, 21]


def test_a_group_that_a_dead_run_left_incomplete_is_written_again(spark, folder):
    from tidemark.functions.files import delete_path

    dataset = VersionedDataset.create(spark, folder, "d", rows(spark, 0).schema)
    dataset.append(rows(spark, *range(10)))
    known = KnownRows(dataset, group_rows=1)
    assert new(dataset, known, 3, 11) == [11]
    delete_path(spark, f"{known.ledger.path}/label=1-1/_SUCCESS")
    assert new(dataset, known, 3, 11) == [11]
    assert known.ledger.holds("1-1") and known.ledger.digests().count() == 10
