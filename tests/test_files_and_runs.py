"""Files in, catalog, lineage, whole runs, streams."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import row_hash
from tidemark.functions.typenames import canonical_type, parse_type, schema_from_file
from tidemark.operators import catalog as M
from tidemark.operators import codecs
from tidemark.operators import dedup
from tidemark.operators import lineage as L
from tidemark.operators.catalog import Catalog
from tidemark.operators.lineage import LineageTable
from tidemark.operators.rules import TableRules, rules_from_dict, rules_from_file
from tidemark.operators.validation import ValidationFailed
from tidemark.plans.ingest import Ingest
from tidemark.plans.loading import load
from tidemark.plans.versions import VersionedDataset
from tidemark.sources import manifest as manifests
from tidemark.sources import readers
from tidemark.streaming.ingest import drop_repeats_within, stream_into

AT = datetime(2024, 1, 1)


def plain(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def write(path, text):
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    return str(path)


# --- sources ----------------------------------------------------------------------------


def test_formats():
    assert readers.detect_format("s3://b/x/*.parquet") == "parquet"
    assert readers.detect_format("/d/x.TSV") == "tsv"
    assert readers.detect_format("s3a://b/x.jsonl") == "jsonl"
    assert readers.detect_format("file:///d/x.ndjson") == "jsonl"
    with pytest.raises(ValueError):
        readers.detect_format("/d/x.xlsx")
    assert readers.spark_path("s3://b/x") == "s3a://b/x"


def test_csv_with_bad_lines(spark, folder):
    path = write(f"{folder}/x.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,,12\n6,7,8,\n1,2,3,4,5,6\n")
    found = readers.read_source(spark, path)
    assert plain(found) == sorted([(1, 2, 3), (4, 5, None), (10, None, 12)], key=repr)
    assert readers.count_bad_lines(spark, path) == 3
    assert plain(found.select("b")) == sorted([(2,), (5,), (None,)], key=repr)
    assert found.filter("a = 4").count() == 1


def test_csv_values_in_quotes_and_types(spark, folder):
    text = 'n,t,f,d\n1,"a,b,c",true,2024-01-01\n2,"x""y,",FALSE,2024-01-02\n3,"a,b",true,x,y\nNA,,,\n'
    path = write(f"{folder}/x.csv", text)
    found = readers.read_source(spark, path, options={"escape": '"'})
    assert [kind for _, kind in found.dtypes] == ["bigint", "string", "boolean", "string"]
    assert plain(found) == sorted(
        [
            (1, "a,b,c", True, "2024-01-01"),
            (2, 'x"y,', False, "2024-01-02"),
            (None, None, None, None),
        ],
        key=repr,
    )


def test_csv_headers(spark, folder):
    path = write(f"{folder}/x.csv", "a,a,,b c\n1,2,3,x\n")
    assert readers.read_source(spark, path).columns == ["a", "a_1", "unnamed_2", "b c"]
    empty = write(f"{folder}/empty.csv", "")
    assert readers.read_source(spark, empty).columns == []


def test_csv_quotes_and_options(spark, folder):
    path = write(f"{folder}/x.csv", 'a;b\n"x;y";"say ""hi"""\nNULL;z\n')
    options = {"sep": ";", "escape": '"', "nullValue": "NULL"}
    assert plain(readers.read_source(spark, path, options=options)) == sorted(
        [("x;y", 'say "hi"'), (None, "z")], key=repr
    )


def test_json_document_and_lines(spark, folder):
    rows = [{"a": 1, "b": "x"}, {"a": 2}]
    document = write(f"{folder}/x.json", json.dumps(rows, indent=2))
    lines = write(f"{folder}/x.jsonl", "\n".join(json.dumps(row) for row in rows))
    wanted = sorted([(1, "x"), (2, None)], key=repr)
    assert plain(readers.read_source(spark, document)) == wanted
    assert plain(readers.read_source(spark, lines)) == wanted


def test_union_of_different_types(spark):
    a = spark.createDataFrame([(1, 1)], "x int, y int")
    b = spark.createDataFrame([(2, "q", True)], "x bigint, y string, z boolean")
    found = readers.union_sources([a, b])
    assert found.dtypes == [("x", "bigint"), ("y", "string"), ("z", "boolean")]
    assert plain(found) == sorted([(1, "1", None), (2, "q", True)], key=repr)


def test_sample_is_the_same_for_any_layout(spark):
    df = spark.range(1000)
    first = plain(readers.sample_rows(df, 20))
    assert first == plain(readers.sample_rows(df.repartition(9), 20))
    assert len(first) == 20
    assert readers.sample_rows(df, 5000).count() == 1000
    assert first != plain(readers.sample_rows(df, 20, seed=1))


def test_manifest(spark, folder):
    spark.range(10).write.parquet(f"{folder}/x.parquet")
    df = readers.read_source(spark, f"{folder}/x.parquet")
    size = manifests.source_bytes(df).first()["size_bytes"]
    row = manifests.manifest(df, "x", "parquet", AT, source_count=3, size_bytes=size).first()
    assert row["row_count"] == 10 and row["size_bytes"] == size > 0
    assert row["source_uri"] == "multi:3 sources"
    assert row["schema_snapshot"] == {"id": "bigint"}


def test_type_names(folder):
    assert parse_type(" Float64 ").simpleString() == "double"
    assert canonical_type("object") == "string"
    assert canonical_type("datetime64[ns]") == "timestamp"
    with pytest.raises(ValueError, match="decimal"):
        parse_type("decimal")
    columns = [{"name": "a", "type": "long", "nullable": False}, {"name": "b", "dtype": "object"}]
    for content in (columns, {"columns": columns}):
        path = write(f"{folder}/s.json", json.dumps(content))
        schema = schema_from_file(path)
        assert [f.simpleString() for f in schema.fields] == ["a:bigint", "b:string"]
        assert [f.nullable for f in schema.fields] == [False, True]
    with pytest.raises(ValueError):
        schema_from_file(write(f"{folder}/t.json", "{}"))


# --- catalog and lineage ----------------------------------------------------------------


def test_catalog(spark, folder):
    catalog = M.Catalog(spark, folder)
    assert catalog.datasets().count() == 0
    catalog.register("a", description="First", tags=["x", "y"], extra={"k": 1, "o": "p"})
    catalog.register("a", source_uri="s", extra={"k": 2})
    row = catalog.get("a")
    assert (row["description"], row["tags"], row["source_uri"]) == ("First", ["x", "y"], "s")
    assert row["extra"] == {"k": "2", "o": "p"}
    catalog.add_version("a", "v1", 5)
    catalog.add_version("b", "v1", 7, total_rows=9)
    catalog.add_version("a", "v2", 3, total_rows=8, snapshot_id=4)
    assert catalog.latest_version("a")["version_tag"] == "v2"
    assert catalog.get_version("a", "v2")["snapshot_id"] == 4
    with pytest.raises(M.DuplicateVersion):
        catalog.add_version("a", "v1", 1)
    with pytest.raises(M.VersionNotFound):
        catalog.get_version("a", "v9")
    with pytest.raises(M.DatasetNotFound):
        catalog.get("zzz")
    listed = {row["name"]: row["versions"] for row in
              M.list_datasets(catalog.datasets(), catalog.versions()).collect()}
    assert listed == {"a": 2, "b": 1}
    assert M.search(catalog.datasets(), "FIRST", ["y"]).count() == 1
    assert M.search(catalog.datasets(), "", ["Y"]).count() == 0
    assert M.statistics(catalog.datasets(), catalog.versions()).first()[2] == 15
    catalog.delete("a")
    with pytest.raises(M.DatasetNotFound):
        catalog.latest_version("a")
    assert [row["name"] for row in catalog.datasets().collect()] == ["b"]
    catalog.add_version("a", "v1", 2)
    assert catalog.latest_version("a")["added_rows"] == 2
    assert catalog.get("a")["description"] == ""
    catalog.export(f"{folder}/export")
    assert spark.read.json(f"{folder}/export/datasets").count() == 2


def test_many_versions_at_once(spark, folder):
    catalog = M.Catalog(spark, folder)
    rows = spark.createDataFrame(
        [("a", "v1", 1, AT), ("b", "v1", 2, AT)],
        "name string, version_tag string, added_rows bigint, created_at timestamp",
    )
    catalog.add_versions(rows)
    assert {row["name"] for row in catalog.datasets().collect()} == {"a", "b"}
    with pytest.raises(M.DuplicateVersion):
        catalog.add_versions(rows)
    with pytest.raises(M.DuplicateVersion):
        catalog.add_versions(rows.unionAll(rows).withColumn("version_tag", F.lit("v2")))
    assert catalog.versions().count() == 2


def test_ancestors_with_cycle_diamond_and_absent_parent(spark):
    graph = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["a", "nowhere"], "z": []}
    nodes = spark.createDataFrame(
        [(n, "set", p) for n, p in graph.items()],
        "node_id string, dataset string, parent_node_ids array<string>",
    )
    start = spark.createDataFrame([("a",), ("z",), ("nowhere",)], "node_id string")
    assert plain(L.ancestors(nodes, start)) == [
        ("a", "a", 0),
        ("a", "b", 1),
        ("a", "c", 1),
        ("a", "d", 2),
        ("z", "z", 0),
    ]


def test_long_chain_of_ancestors(spark, monkeypatch):
    nodes = spark.createDataFrame(
        [(str(i), [str(i - 1)]) for i in range(2000)], "node_id string, parent_node_ids array<string>"
    )
    cuts, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    found = L.ancestors(nodes, nodes.filter("node_id = '1999'"))
    assert sorted(row["distance"] for row in found.collect()) == list(range(2000))
    assert len(cuts) <= 2 * 12 + 2


# --- codecs -----------------------------------------------------------------------------


def test_recommendation(spark):
    def best(zstd, snappy):
        rows = [("zstd", *zstd), ("snappy", *snappy), ("none", 1.0, 9.0)]
        df = spark.createDataFrame(
            rows, "codec string, compression_ratio double, throughput_mb_s double"
        )
        return codecs.recommend_codec(df).first()["recommended"]

    assert best((2.5, 1.0), (2.0, 9.0)) == "zstd"
    assert best((2.4, 1.0), (2.0, 1.6)) == "snappy"
    assert best((2.4, 1.0), (2.0, 1.5)) == "zstd"


def test_codec_that_fails_is_left_out(spark, folder):
    found = codecs.compare_codecs(spark.range(100), f"{folder}/c", ("zstd", "nonsense", "none"))
    assert {row["codec"] for row in found.collect()} == {"zstd", "none"}


# --- runs -------------------------------------------------------------------------------


def source(spark, folder, name, rows):
    path = f"{folder}/{name}.parquet"
    spark.createDataFrame(rows, "Id bigint, ` Name ` string").write.parquet(path)
    return path


def test_runs_build_versions(spark, folder):
    first = source(spark, folder, "one", [(1, " a "), (1, "a"), (2, "b"), (None, None)])
    second = source(spark, folder, "two", [(2, "b"), (3, "c")])
    run = Ingest(folder, "Cafe Sales", "v1", at=AT, tags=("x",)).run(spark, first)
    assert (run.rows_ingested, run.rows_written) == (4, 2)
    again = Ingest(folder, "Cafe Sales", "v2", at=datetime(2024, 1, 2), incremental=True)
    done = again.run(spark, second)
    assert done.rows_written == 1
    assert done.steps[-2:] == ["deduplicate", "drop_known"]
    catalog = M.Catalog(spark, folder)
    assert load(catalog, folder, "Cafe Sales", version="v1").count() == 2
    assert plain(load(catalog, folder, "Cafe Sales", columns=["id", "name"])) == [
        (1, "a"),
        (2, "b"),
        (3, "c"),
    ]
    assert load(catalog, folder, "Cafe Sales", as_of=AT).count() == 2
    assert load(catalog, folder, "Cafe Sales", limit=1).count() == 1
    latest = catalog.latest_version("Cafe Sales")
    assert (latest["added_rows"], latest["total_rows"]) == (1, 3)
    nodes = L.LineageTable(spark, folder).nodes()
    node = L.node_by_id(nodes, done.lineage_node_id).first()
    assert node["parent_node_ids"] == [run.lineage_node_id]
    assert node["source_uris"] == [second]
    with pytest.raises(M.DuplicateVersion):
        Ingest(folder, "Cafe Sales", "v2").run(spark, second)
    third = spark.createDataFrame([(4, "d", 1.5)], "id bigint, name string, price double")
    Ingest(folder, "Cafe Sales", "v3", at=datetime(2024, 1, 3)).run_frame(third, ["memory"])
    assert plain(load(catalog, folder, "Cafe Sales", columns=["id", "price"])) == sorted(
        [(1, None), (2, None), (3, None), (4, 1.5)], key=repr
    )


def test_several_sources_in_one_run(spark, folder):
    paths = [source(spark, folder, n, [(i, n), (0, "same")]) for i, n in enumerate("xy", 1)]
    done = Ingest(folder, "many", "v1", at=AT).run(spark, paths)
    assert (done.rows_ingested, done.rows_written) == (4, 3)


def test_broken_rules_write_nothing(spark, folder):
    path = source(spark, folder, "one", [(1, "a"), (1, "b"), (2, "c")])
    for content, message in (
        ({"require_unique": ["id"]}, "repeat the key"),
        ({"columns": [{"name": "id", "max_value": 1}]}, "above"),
        ({"columns": [{"name": "absent"}]}, "missing"),
    ):
        run = Ingest(folder, "strict", "v1", rules=rules_from_dict(content), at=AT)
        with pytest.raises(ValidationFailed, match=message):
            run.run(spark, path)
    assert not VersionedDataset(spark, folder, "strict").exists()
    assert M.Catalog(spark, folder).versions().count() == 0
    rules = rules_from_dict({"max_rows": 1, "columns": [{"name": "id", "dtype": "float64"}]})
    done = Ingest(folder, "strict", "v1", rules=rules, at=AT).run(spark, path)
    assert {warning[1] for warning in done.warnings} == {"max_rows", "dtype"}


def test_rules_from_file(spark, folder):
    content = {"min_rows": 1, "columns": [{"name": "a", "allowed_values": ["x"]}]}
    rules = rules_from_file(write(f"{folder}/rules.json", json.dumps(content)))
    assert rules.min_rows == 1 and rules.columns[0].allowed_values == ("x",)


# --- streams ----------------------------------------------------------------------------


def test_stream_is_exact_and_restartable(spark, folder):
    rows = spark.range(30).select("id", F.concat(F.lit("n"), "id").alias("name"))
    files, state = f"{folder}/files", f"{folder}/state"
    for low, high in ((0, 15), (10, 20)):
        rows.filter(f"id between {low} and {high}").coalesce(1).write.mode("append").parquet(files)
    dataset = VersionedDataset.create(
        spark, folder, "stream", dedup.with_row_hash(rows).schema, at=AT
    )

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
        stream_into(stream.parquet(files), dataset, state).awaitTermination()

    run()
    assert sorted(row["id"] for row in dataset.read().collect()) == list(range(21))
    rows.coalesce(1).write.mode("append").parquet(files)
    run()
    run()
    assert sorted(row["id"] for row in dataset.read().collect()) == list(range(30))
    assert dataset.committed_token("stream:0") == 1


def test_repeats_within_a_delay(spark, folder):
    rows = spark.createDataFrame([(1, AT), (1, AT), (2, AT)], "id int, at timestamp")
    rows.write.parquet(f"{folder}/files")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/files")
    query = (
        drop_repeats_within(stream, "at", "1 hour", ["id"])
        .writeStream.format("memory")
        .queryName("repeats")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert plain(spark.table("repeats").select("id")) == [(1,), (2,)]


@pytest.mark.parametrize("broken", ["record", "register", "add_version"])
def test_a_run_that_dies_after_its_commit_is_completed(spark, folder, monkeypatch, broken):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    run = Ingest(folder, "rows", "v1", at=AT)
    owner = LineageTable if broken == "record" else Catalog
    with monkeypatch.context() as patch:
        patch.setattr(owner, broken, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run.run_frame(df, ["x"])
    done = run.run_frame(df, ["x"])
    assert done.rows_written == 2
    assert load(Catalog(spark, folder), folder, "rows", version="v1").count() == 2
    assert LineageTable(spark, folder).nodes().count() == 1
    assert Catalog(spark, folder).versions().count() == 1


def test_a_refused_run_leaves_no_table_and_no_column(spark, folder):
    rules = TableRules(min_rows=3)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    with pytest.raises(ValidationFailed):
        Ingest(folder, "rows", "v0", rules=rules, at=AT).run_frame(df, ["x"])
    assert not VersionedDataset(spark, folder, "rows").exists()
    Ingest(folder, "rows", "v1", at=AT).run_frame(df, ["x"])
    with pytest.raises(ValidationFailed):
        wide = df.withColumn("bad", F.lit(1))
        Ingest(folder, "rows", "v2", rules=rules, at=AT).run_frame(wide, ["x"])
    assert "bad" not in VersionedDataset(spark, folder, "rows").read().columns


def test_csv_with_quotes_as_pandas_reads_it(spark, folder):
    import pandas as pd

    os.makedirs(f"{folder}/q")
    text = 'n,s,t\n1,"He said ""hi"", ok",x\n2,"a,b",\n3,plain,"""q"""\n4,"",back\\slash\n5,a,b,c\n'
    with open(f"{folder}/q/a.csv", "w") as handle:
        handle.write(text)
    found = [tuple(r) for r in readers.read_source(spark, f"{folder}/q/a.csv").orderBy("n").collect()]
    want = pd.read_csv(f"{folder}/q/a.csv", on_bad_lines="skip")
    want = [tuple(None if v != v else v for v in r) for r in want.itertuples(index=False)]
    assert found == want
    assert readers.count_bad_lines(spark, f"{folder}/q/a.csv") == 1
    with open(f"{folder}/lines.csv", "w") as handle:
        handle.write('a,b\n1,"two\nlines"\n2,one\n')
    lines = readers.read_source(spark, f"{folder}/lines.csv", options={"multiLine": True})
    assert plain(lines) == [(1, "two\nlines"), (2, "one")]
    with open(f"{folder}/q/b.csv", "w") as handle:
        handle.write("t,n,s\nz,9,w\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_source(spark, f"{folder}/q", "csv").collect()


def test_nan_is_null_for_duplicates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 0.5)], "id int, v double")
    kept = dedup.deduplicate(df)
    assert kept.count() == 2 and dedup.duplicates(df).count() == 1
    assert dedup.duplicate_statistics(df).first()["duplicates_removed"] == 1


def test_framed_hash_does_not_see_null_columns(spark):
    a = spark.createDataFrame([(1, "a|b", "c")], "id int, s string, t string")
    b = spark.createDataFrame([(1, "a", "b|c", None)], "id int, s string, t string, u int")
    same = a.withColumn("u", F.lit(None).cast("int"))
    hashes = [f.select(row_hash(f, framed=True)).first()[0] for f in (a, b, same)]
    assert hashes[0] == hashes[2] != hashes[1]


def test_versions_added_in_bulk_after_a_delete_are_seen(spark, folder):
    catalog = Catalog(spark, folder)
    rows = spark.createDataFrame(
        [("d", f"v{i}", AT) for i in range(3)], "name string, version_tag string, created_at timestamp"
    )
    catalog.add_versions(rows)
    catalog.delete("d")
    catalog.add_versions(rows)
    assert catalog.versions().count() == 3 and catalog.latest_version("d")["version_tag"] == "v2"
