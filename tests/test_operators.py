"""Edge cases and properties of cleaning, hashing, dedup, validation, profile and diff."""

import hashlib
import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import content_checksum, row_hash
from tidemark.functions.text import NUMBER, normalized_text, to_number, to_whole_number
from tidemark.operators import cleaning as C
from tidemark.operators import dedup
from tidemark.operators import diff as D
from tidemark.operators import profile as P
from tidemark.operators import validation as V
from tidemark.operators.rules import rules_from_dict


def plain(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


# --- names ------------------------------------------------------------------------------


def test_clean_and_unique_names():
    assert C.clean_name("  Order ID ") == "order_id"
    assert C.clean_name("_Sys") == "sys"
    assert C.clean_name("_sys_row_hash") == "_sys_row_hash"
    assert C.clean_name("名前") == "col"
    assert C.unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert C.unique_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    for names in (["a", "a", "a_1", "a_1"], ["x"] * 5, ["x_1", "x", "x", "x_1"]):
        assert len(set(C.unique_names(names))) == len(names)


# --- cleaning ---------------------------------------------------------------------------


def test_strip_every_kind_of_space(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([(s + "x y" + s, s) for s in spaces], "a string, b string")
    found = plain(C.strip_whitespace(df))
    assert {row[0] for row in found} == {"x y"}
    assert {row[1] for row in found} == {""}


def test_strip_nan_text(spark):
    df = spark.createDataFrame([(" nan ",), ("NaN",), (None,), ("nano",)], "a string")
    assert {row[0] for row in plain(C.strip_whitespace(df))} == {None, "NaN", "nano"}


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms(spark, form):
    texts = ["plain", "e\u0301", "\u00e9", "\ufb01", "", None, "\u1e9b\u0323", "한글"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    (column,) = normalized_text([F.col("t")], form)
    found = [row[0] for row in df.select(column).collect()]
    assert found == [None if t is None else unicodedata.normalize(form, t) for t in texts]


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b string, c string")
    assert C.drop_empty_columns(df).columns == ["a", "c"]
    assert C.drop_empty_columns(df, 0.5).columns == ["a"]
    assert C.drop_empty_columns(df.limit(0)).columns == ["a", "b", "c"]
    late = spark.range(3000).select(
        "id", F.when(F.col("id") == 2999, F.lit("x")).alias("late"), F.lit(None).alias("never")
    )
    assert C.drop_empty_columns(late.coalesce(1)).columns == ["id", "late"]


def test_cast_numeric_like_pandas(spark):
    columns = {
        "whole": ["1", " 2 ", "-3", "+4"],
        "holes": ["1", None, "3", "4"],
        "mixed": ["1.5", "2e3", ".5", "x"],
        "half": ["1", "2", "x", "y"],
        "suffix": ["1d", "2f", "3d", "4d"],
        "large": ["1", "2", "3", "99999999999999999999"],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), list(columns))
    found = C.cast_numeric_columns(df)
    types = dict(found.dtypes)
    assert types == {
        "whole": "bigint",
        "holes": "double",
        "mixed": "double",
        "half": "string",
        "suffix": "string",
        "large": "double",
    }
    rows = found.toPandas()
    for name in ("whole", "holes", "mixed", "large"):
        wanted = pd.to_numeric(pd.Series(columns[name]), errors="coerce").astype(float)
        assert list(rows[name].astype(float)) == pytest.approx(list(wanted), nan_ok=True)
    with pytest.raises(ValueError, match="absent"):
        C.cast_numeric_columns(df, ["absent"])


def test_numbers_are_what_the_pattern_says(spark):
    """Random texts: a number by pattern converts, whole ones exactly, others never."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789+-.eEdDfFx \tna", k=rng.randint(1, 6))) for _ in range(20_000)]
    texts += ["inf", "Infinity", "nan", "1d", "2F", "0x1p3", "1_000", "9223372036854775807"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    number = to_number(F.col("s"), df.schema["s"].dataType)
    found = df.select("s", number.alias("n"), to_whole_number(F.col("s")).alias("w")).collect()
    pattern, whole = re.compile(NUMBER), re.compile(r"\s*[+-]?\d+\s*")
    for text, value, integer in found:
        if pattern.match(text):
            assert value == float(text)
        else:
            assert value is None
        assert integer == (int(text) if whole.fullmatch(text) else None)


def test_coerce_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "x"), (None, None)], "a string, b string")
    found = C.coerce_dtypes(df, {"a": "int64", "b": "int64", "absent": "int64"})
    assert found.dtypes == [("a", "bigint"), ("b", "string")]


def test_fill_nulls_that_do_not_fit(spark):
    df = spark.createDataFrame([(None, None)], "a int, b string")
    with pytest.raises(Exception, match="(?i)cast|malformed|type"):
        C.fill_nulls(df, {"a": "z"}).collect()


def test_settled_chain_runs_no_job_and_gives_the_same(spark):
    df = spark.createDataFrame([("1", None), ("2", None)], "a string, b string")
    chain = C.Cleaning().add(C.drop_empty_columns).add(C.cast_numeric_columns)
    settled = chain.settled(df)
    assert settled.names == chain.names == ["drop_empty_columns", "cast_numeric_columns"]
    assert settled.run(df).dtypes == chain.run(df).dtypes == [("a", "bigint")]


def test_standard_chain_on_edges(spark):
    chain = C.Cleaning.standard("2024-01-01")
    empty = spark.createDataFrame([], "A string, B int")
    assert chain.run(empty).columns == ["a", "b", "_sys_ingested_at"]
    one = spark.createDataFrame([(" x ", 1)], "A string, B int")
    assert plain(chain.run(one).drop("_sys_ingested_at")) == [("x", 1)]


# --- hashing ----------------------------------------------------------------------------


def test_hash_text_is_as_declared(spark):
    df = spark.createDataFrame(
        [(2, "x", None, True, float("nan"))], "b int, a string, c string, d boolean, e double"
    )
    found = df.select(row_hash(df).alias("h"), row_hash(df, ["b", "a"], "md5").alias("m")).first()
    assert found["h"] == hashlib.sha256(b"x|2|<NA>|true|<NA>").hexdigest()
    assert found["m"] == hashlib.md5(b"2|x").hexdigest()
    with pytest.raises(ValueError, match="absent"):
        row_hash(df, ["absent"])
    with pytest.raises(ValueError, match="unknown hash"):
        row_hash(df, algorithm="crc")
    with pytest.raises(ValueError, match="no data column"):
        row_hash(df.select(F.lit(1).alias("_sys_x")))


def test_framed_hash_tells_rows_apart(spark):
    df = spark.createDataFrame(
        [("a|b", "c"), ("a", "b|c"), (None, "x"), ("<NA>", "x"), ("-;", "x")], "l string, r string"
    )
    assert df.select(row_hash(df)).distinct().count() == 3
    assert df.select(row_hash(df, framed=True)).distinct().count() == 5


def test_nested_and_binary_columns_hash(spark):
    df = spark.createDataFrame(
        [([1, 2], {"a": 1}, bytearray(b"\xff"))], "a array<int>, m map<string,int>, b binary"
    )
    assert len(df.select(row_hash(df)).first()[0]) == 64
    assert dedup.deduplicate(df.unionAll(df)).count() == 1


def test_checksum_ignores_order_and_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("x"))

    def value(frame):
        return frame.agg(content_checksum(row_hash(frame))).first()[0]

    assert value(df) == value(df.repartition(13).orderBy(F.desc("id")))
    assert value(df) != value(df.unionAll(df.limit(1)))
    assert value(df.limit(0)) == "0-0-0-0"


# --- dedup ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows are copies of one row; keys repeat with different orders."""
    rng = random.Random(3)
    rows = [(1, "hot", 0)] * 200 + [
        (rng.randrange(40), rng.choice(["a", "b", None]), rng.randrange(50)) for _ in range(400)
    ]
    return spark.createDataFrame(rows, "k int, s string, o int").repartition(7), rows


def test_dedup_all_columns(skewed):
    df, rows = skewed
    once = dedup.deduplicate(df)
    assert plain(once.drop("_sys_row_hash")) == sorted(set(rows), key=repr)
    assert plain(dedup.deduplicate(once)) == plain(once)
    hashes = {row[0] for row in df.select(row_hash(df)).collect()}
    assert {row["_sys_row_hash"] for row in once.collect()} == hashes


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedup_subset_by_order(skewed, keep):
    df, rows = skewed
    found = dedup.deduplicate(df, ["k"], keep=keep, order_by=["o"])
    pick = min if keep == "first" else max
    wanted = {k: pick(o for x, _, o in rows if x == k) for k, _, _ in rows}
    assert {row["k"]: row["o"] for row in found.collect()} == wanted


def test_dedup_does_not_depend_on_layout(skewed):
    df, _ = skewed
    first = plain(dedup.deduplicate(df, ["k"]))
    assert first == plain(dedup.deduplicate(df.repartition(3).orderBy("o"), ["k"]))


def test_duplicates_are_the_rest(skewed):
    df, rows = skewed
    rest = plain(dedup.duplicates(df).drop("_sys_row_hash"))
    kept = plain(dedup.deduplicate(df).drop("_sys_row_hash"))
    assert sorted(rest + kept, key=repr) == sorted(rows, key=repr)
    by_key = dedup.duplicates(df, ["k"], ["o"])
    first = dedup.deduplicate(df, ["k"], order_by=["o"])
    assert sorted(plain(by_key) + plain(first), key=repr) == plain(dedup.with_row_hash(df, ["k"]))


def test_dedup_with_ingestion_time(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, s string")
    timed = C.add_ingestion_timestamp(df, "2024-01-01")
    found = dedup.deduplicate(timed)
    assert found.columns == ["i", "s", "_sys_ingested_at", "_sys_row_hash"]
    assert found.count() == 2
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_a_text_both_stay(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "l string, r string")
    assert dedup.deduplicate(df).count() == 2
    assert dedup.duplicate_statistics(df).first()["duplicates_removed"] == 0


def test_statistics_of_nothing(spark):
    row = dedup.duplicate_statistics(spark.createDataFrame([], "a int")).first()
    assert tuple(row) == (0, 0, 0, 0.0)
    assert dedup.deduplicate(spark.createDataFrame([], "a int")).columns == ["a", "_sys_row_hash"]


def test_ledger(spark, folder):
    df = dedup.with_row_hash(spark.range(10).toDF("a"))
    ledger = dedup.HashLedger(spark, f"{folder}/ledger")
    assert ledger.count() == 0
    ledger.add(df.limit(6), 1)
    ledger.add(df.limit(6), 1)
    ledger.add(df, 2)
    assert ledger.count() == 10
    assert dedup.drop_known(df, ledger.hashes()).count() == 0
    assert ledger.at(f"{folder}/new").count() == 0


# --- validation -------------------------------------------------------------------------


def report(df, rules):
    return {
        (row["column"], row["rule"]): row["violations"]
        for row in V.validate(df, rules_from_dict(rules)).collect()
    }


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string")
    assert report(df, {}) == {}
    rules = {
        "require_unique": ["a"],
        "columns": [
            {"name": "a", "nullable": False, "max_null_fraction": 0.0, "min_value": 3},
            {"name": "s", "regex_pattern": "x", "min_length": 1},
        ],
    }
    assert report(df, rules) == {}
    assert report(df, {"min_rows": 1}) == {(None, "min_rows"): 1}


def test_nulls_and_text_that_is_no_number(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,), ("50",)], "s string")
    rules = {"columns": [{"name": "s", "min_value": 10, "max_value": 40, "min_length": 2}]}
    assert report(df, rules) == {
        ("s", "min_value"): 1,
        ("s", "max_value"): 1,
        ("s", "min_length"): 2,
    }


def test_allowed_values_compare_by_kind(spark):
    df = spark.createDataFrame([("1", 1, True), ("2", 2, False)], "s string, i int, b boolean")
    allow = [{"name": n, "allowed_values": [1]} for n in ("s", "i", "b")]
    assert report(df, {"columns": allow}) == {
        ("s", "allowed_values"): 2,
        ("i", "allowed_values"): 1,
        ("b", "allowed_values"): 2,
    }


def test_pattern_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("abc",), ("xab",), ("b",)], "s string")
    assert report(df, {"columns": [{"name": "s", "regex_pattern": "ab|b"}]}) == {
        ("s", "regex_pattern"): 1
    }


def test_length_counts_characters(spark):
    df = spark.createDataFrame([("😀😀",)], "s string")
    assert report(df, {"columns": [{"name": "s", "min_length": 2, "max_length": 2}]}) == {}


def test_unique_key_counts_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, 1), (1, 2)], "a int, b int")
    assert report(df, {"require_unique": ["a", "b"]}) == {("a, b", "unique_constraint"): 1}
    assert report(df, {"require_unique": ["absent"]}) == {}


def test_gate_and_unknown_keys(spark):
    df = spark.createDataFrame([(1,)], "a int")
    rules = rules_from_dict({"min_rows": 2, "max_rows": 0})
    with pytest.raises(V.ValidationFailed, match="1 rows missing"):
        V.require_valid(V.validate(df, rules))
    only_warning = V.validate(df, rules_from_dict({"max_rows": 0}))
    assert [row["rule"] for row in V.require_valid(only_warning)] == ["max_rows"]
    assert V.report_summary(only_warning).first()["passed"]
    with pytest.raises(ValueError, match="typo"):
        rules_from_dict({"typo": 1})
    with pytest.raises(ValueError, match="min_valu"):
        rules_from_dict({"columns": [{"name": "a", "min_valu": 1}]})


def test_split_rows_keeps_all(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (9, "c")], "n int, s string")
    rules = rules_from_dict({"columns": [{"name": "n", "nullable": False, "max_value": 5}]})
    good, rejected = V.split_rows(df, rules)
    assert plain(good) == [(1, "a")]
    assert plain(rejected) == sorted(
        [(None, "b", ["n:nullable"]), (9, "c", ["n:max_value"])], key=repr
    )
    same, none = V.split_rows(df, rules_from_dict({}))
    assert same.count() == 3 and none.count() == 0


# --- profile and diff -------------------------------------------------------------------


def test_profile_edges(spark):
    df = spark.createDataFrame(
        [(None, 1, "9", True), (None, 2, "10", False), (None, 2, "x", True)],
        "empty string, n int, text string, flag boolean",
    )
    found = {row["column"]: row for row in P.profile(df).collect()}
    assert found["empty"]["null_fraction"] == 1.0 and not found["empty"]["is_numeric"]
    assert found["empty"]["unique_count"] == 0
    assert found["text"]["is_numeric"] and found["text"]["max_value"] == 10.0
    assert found["n"]["unique_count"] == 2
    assert found["flag"]["mean_value"] == pytest.approx(2 / 3)
    nothing = {row["column"]: row for row in P.profile(df.limit(0)).collect()}
    assert nothing["n"]["null_fraction"] == 0.0 and nothing["n"]["mean_value"] is None
    one = P.profile(df.limit(1), ["n"]).first()
    assert one["std_value"] is None


def test_profile_counts_unique_values_of_any_number_of_rows(spark):
    df = spark.range(150_000).select(
        "id",
        F.when(F.col("id") < 5, F.col("id")).alias("few"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(-0.0)).alias("odd"),
    )
    found = {row["column"]: row["unique_count"] for row in P.profile(df).collect()}
    assert found == {"id": 150_000, "few": 5, "odd": 1}
    loose = P.profile(df, unique="approximate").collect()
    assert abs(loose[0]["unique_count"] - 150_000) <= 15_000
    assert {row["unique_count"] for row in P.profile(df, unique=None).collect()} == {None}


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "bbaaccdddef"], "s string")
    found = [(row["value"], row["count"]) for row in P.top_values(df).orderBy("rank").collect()]
    assert found == [("d", 3), ("a", 2), ("b", 2), ("c", 2), ("e", 1)]


def test_diff_with_itself_and_reverse(skewed):
    df, rows = skewed
    same = D.row_diff(df, df).first()
    assert (same["rows_added"], same["rows_removed"]) == (0, 0)
    assert same["rows_unchanged"] == len(set(rows)) and same["rows_total_after"] == len(rows)
    some = df.filter("o > 20")
    there, back = D.row_diff(some, df).first(), D.row_diff(df, some).first()
    assert there["rows_added"] == back["rows_removed"] > 0
    assert D.rows_only_in(df, some).distinct().count() == there["rows_added"]
    empty = df.limit(0)
    assert D.row_diff(empty, empty).first()["change_rate"] == 1.0


def test_diff_ignores_column_order_and_system_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = C.add_ingestion_timestamp(a.select("s", "n"), "2024-01-01")
    assert D.row_diff(a, b).first()["rows_unchanged"] == 1
    assert {row["column"] for row in D.column_deltas(a, b).collect()} == {"n", "s"}


def test_schema_changes(spark):
    a = spark.createDataFrame([], "n int, s string, gone int")
    b = spark.createDataFrame([], "s string, n bigint, new int")
    assert D.schema_changes(a, b) == (["new"], ["gone"], {"n": ("int", "bigint")})
    assert D.has_breaking_changes(a, b) and not D.has_breaking_changes(a, a)


def test_old_mean_of_zero_is_not_significant(spark):
    a = spark.createDataFrame([(-1.0,), (1.0,)], "v double")
    b = spark.createDataFrame([(5.0,), (6.0,)], "v double")
    assert not D.column_deltas(a, b).first()["is_significant"]
    assert D.column_deltas(b, a).first()["is_significant"]
