"""How much of the work one task gets: figures of a write, runs of files, parts by size, bytes that move."""

import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import dedup
from tidemark.plans.versions import VersionedDataset


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- figures of a write ---------------------------------------------------------------


def test_figures_of_a_write_are_taken_in_all_tasks_of_the_input(spark, folder):
    rows = spark.range(400).select("id", F.lit("one").alias("part")).repartition(8)
    dataset = VersionedDataset.create(spark, folder, "d", rows.schema, partition_by=["part"], sort_by=["id"])
    last = F.max(F.spark_partition_id())
    written = dataset.append(rows, at=datetime(2024, 1, 1), measures={"last": last, "sum": F.sum("id")})
    # All rows are in one partition; dealt to it first, they would be hashed in task 0 alone.
    assert written.measures == {"last": 7, "sum": 79800}
    assert (written.rows_written, written.files_written) == (400, 1)
    assert dataset.verify().first()["is_intact"]
    assert dataset.verify().first()["checksum"] == written.checksum
    assert dataset.read().columns == ["id", "part"]


# --- order within files ---------------------------------------------------------------


def test_rows_of_a_file_meet_in_runs(spark, monkeypatch):
    from tidemark_queries import versions

    monkeypatch.setattr(versions, "RUN_ROWS", 3)
    rows = [(f, p, 100 * p if (f, p) != ("a", 6) else 1) for f in "ab" for p in range(10)] + [("c", 0, None)]
    placed = spark.createDataFrame(rows, "file string, place long, v long").repartition(4)
    found = versions._with_row_before(placed, "v")
    assert "_run" in plan(found)
    before = {(r["place"], r["v"], r["before"]) for r in found.collect()}
    wanted = {(p, 100 * p, 100 * (p - 1) if p else None) for p in range(10)}
    wanted |= {(6, 1, 500), (7, 700, 1), (0, None, None)}
    assert before == wanted and found.count() == len(rows)


# --- parts by size --------------------------------------------------------------------


def test_rows_are_dealt_by_size(spark, folder):
    from tidemark_queries.sources import content_checksum

    spark.range(50).select((F.col("id") % 9).alias("l_orderkey"), F.lit(None).cast("string").alias("x")).write.parquet(
        f"{folder}/lineitem.parquet"
    )
    found = content_checksum(spark, folder)
    # A number of parts given in the code lets a part grow with the table.
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in text and "Repartition 5" not in text
    assert found.first()["row_count"] == 50


def test_files_of_texts_grow_in_number(spark, folder, monkeypatch):
    from tidemark_queries import sources

    rows = [(i, f'line "{i}"\nnext, of {i}' * 20, "en", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    docs.repartition(6).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(sources, "TEXT_FILE_BYTES", 1000, raising=False)
    monkeypatch.setattr(sources, "fresh_dir", lambda spark, name: f"{folder}/{name}")
    found = sources.csv_with_line_breaks(spark, folder)
    assert {(r["doc_id"], r["text"]) for r in found.collect()} == {(i, text) for i, text, _, _ in rows}
    files = spark.read.text(f"{folder}/texts.csv").select("_metadata.file_path").distinct().count()
    assert files > 2


# --- rows that are known --------------------------------------------------------------


def test_hashes_move_as_digests(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = dedup.with_row_hash(spark.range(20).select("id", F.col("id").cast("string").alias("s")))
        odd = spark.createDataFrame([(50, "x", "ABCD"), (51, "y", None), (52, "z", "no hex"), (53, "w", "abcd")], rows.schema)
        rows = rows.unionByName(odd)
        known = rows.where("id < 5 or id = 53")
        for large in (False, True):
            left = dedup.drop_known(rows, known, large_ledger=large)
            # Digests meet, however their text is written; what stays has its own text.
            wanted = {r for r in map(tuple, rows.collect()) if r[0] >= 5 and r[0] not in (50, 53)}
            assert set(map(tuple, left.collect())) == wanted and left.columns == rows.columns
        text = plan(dedup.drop_known(rows, known))
        assert text.index("lower(hex(_digest") < text.index("LeftAnti")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_ledger_makes_hashes_once_for_each_row_that_reads_it(spark, folder):
    rows = spark.range(20).select((F.col("id") % 7).cast("string").alias("s"))
    ledger = dedup.HashLedger(spark, f"{folder}/ledger")
    ledger.add(dedup.with_row_hash(rows.where("s = '3'"), framed=True), "a")
    left = ledger.drop_known(dedup.deduplicate(rows, framed=True))
    assert {r["s"] for r in left.collect()} == set("012456")
    # No filter on the hash below the aggregate, where every row would be hashed for it.
    text = left._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Filter" in line and "sha2(" in line]


# --- values in Python -----------------------------------------------------------------


def test_normal_forms_hold_few_values_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(T, "VALUES_AT_ONCE", 7, raising=False)
    held = "é" * 3
    rows = [(i, None if i % 5 == 0 else f"{held}{i}" if i % 2 else f"plain {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, s string").coalesce(1)
    found = {r["i"]: r["n"] for r in df.select("i", T.normalized_text([F.col("s")])[0].alias("n")).collect()}
    assert found == {i: s if s is None else unicodedata.normalize("NFC", s) for i, s in rows}
    # One Arrow batch is made in runs of few values, not as objects all at once.
    assert not hasattr(T, "pd") and "VALUES_AT_ONCE" in vars(T)
