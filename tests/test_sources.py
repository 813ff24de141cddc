"""Line breaks in quotes over many tasks, and many paths by few readers."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.sources.quoted import LineStates, UnclosedQuote, inside_splits


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def written(path, rows, **options):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n", **options).writerows(rows)
    with open(path, "w", encoding="utf-8", newline="") as handle:
        handle.write(text.getvalue())
    return str(path)


def values(seed, n):
    pick = random.Random(seed)
    parts = ["a", "b c", '"', '""', ",", "\n", "\n\n", "é日", "x,y", '"\n"', "\r\n", "'"]
    return ["v" + "".join(pick.choices(parts, k=pick.randrange(0, 9))) + "w" for _ in range(n)]


def test_states_of_lines_follow_a_plain_reader():
    plain = LineStates({})
    for state, line, after in [
        (0, "a,b", 0), (0, '"a,b', 1), (0, 'a,"b', 1), (0, '5" disk,b', 0), (0, '"a","b"', 0),
        (0, '"a""', 1), (0, '"a"""', 0), (1, 'b",c', 0), (1, "b,c", 1), (1, 'b","c', 1), (1, '"",c', 1),
        (1, '"', 0), (0, "", 0), (1, "", 1), (0, '"abc,""d,""', 1),
    ]:
        assert plain.after(state, line) == after, (state, line)
    slash = LineStates({"escape": "\\", "sep": "\t"})
    assert slash.after(0, 'a\t"b\\"') == 1 and slash.after(0, 'a,"b') == 0 and slash.after(1, 'x\\\\"') == 0


@pytest.mark.parametrize("seed", range(4))
def test_records_that_cross_lines_and_splits(spark, small_splits, tmp_path, seed):
    rows = [[str(i), t, str(i % 7)] for i, t in enumerate(values(seed, 300))]
    rows[150][1] = "long " + "line\n" * 600 + "end"  # several splits lie inside this value
    folder = tmp_path / "f.csv"
    folder.mkdir()
    written(folder / "a.csv", [["id", "text", "n"], *rows[:200]])
    written(folder / "b.csv", [["id", "text", "n"], *rows[200:]], quoting=csv.QUOTE_ALL)
    found = readers.read_source(spark, str(folder))
    assert found.dtypes == [("id", "bigint"), ("text", "string"), ("n", "bigint")]
    got = sorted((r["id"], r["text"], r["n"]) for r in found.collect())
    assert got == [(int(a), b, int(c)) for a, b, c in rows]
    assert found.rdd.getNumPartitions() > 4
    starts = inside_splits(spark, str(folder), {"escape": '"'})
    assert len({block for _, block in starts}) >= 3


def test_files_without_line_breaks_take_the_plain_reader(spark, tmp_path):
    path = written(tmp_path / "a.csv", [["a", "b"], ["1", 'say ""hi""'], ["2", "x,y"]])
    assert "Python" not in readers.read_source(spark, path)._jdf.queryExecution().executedPlan().toString()
    with open(tmp_path / "b.csv", "w") as handle:
        handle.write('size,n\n5" disk,1\n3" disk,2\n')
    got = [tuple(r) for r in readers.read_source(spark, str(tmp_path / "b.csv")).collect()]
    assert got == [('5" disk', 1), ('3" disk', 2)]


def test_broken_files_are_refused(spark, tmp_path):
    folder = tmp_path / "f.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(UnclosedQuote):
        readers.read_source(spark, str(folder))
    (folder / "a.csv").write_text('a,b\n1,"two\nlines"\n')
    (folder / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read_source(spark, str(folder)).collect()


def test_short_and_long_records_with_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,"x\ny",2\n3,"p\nq"\n4,"p\nq",5,6\n\n7,NA,8\n')
    got = sorted(tuple(r) for r in readers.read_source(spark, str(path)).collect())
    assert got == [(1, "x\ny", 2), (3, "p\nq", None), (7, None, 8)]
    assert readers.count_bad_lines(spark, str(path)) == 1


def test_many_paths_of_three_schemas_are_three_scans(spark, tmp_path):
    paths = []
    for i in range(240):
        if i % 3 < 2:
            head = ["id", "name"] if i % 3 else ["id", "price"]
            paths.append(written(tmp_path / f"f {i}.csv", [head, [i, "x" if i % 3 else i / 2]]))
    for k in range(4):
        paths.append(str(tmp_path / f"p{k}.parquet"))
        spark.range(1000 + k, 1001 + k).coalesce(1).write.parquet(paths[-1])
    found = readers.read_many(spark, paths)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 3 and text.count("FileScan csv") == 2
    assert found.count() == 164
    row = found.where("id = 12").first()
    assert (row["price"], row["name"]) == (6.0, None)
    assert found.where("id >= 1000 AND name IS NULL").count() == 4


def test_parquet_paths_whose_types_differ(spark, tmp_path):
    one, two = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.range(3).write.parquet(one)
    spark.range(3).select(F.col("id").cast("string")).write.parquet(two)
    found = readers.read_many(spark, [one, two])
    assert found.dtypes == [("id", "string")] and found.count() == 6
