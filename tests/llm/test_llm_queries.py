"""Queries of the training-data operators against their SQL, on the smallest tables."""

import os

import compare
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, key):
    names, found = compare.spark_rows(QUERIES[key](spark, SF_DIR))
    sql_names, wanted = compare.sql_rows(compare.connect(SF_DIR), ORACLES[key])
    assert names == sql_names and found == wanted


def test_quality_and_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    quality = QUERIES["op2_quality_classifier"](spark, SF_DIR).where("held_out")
    right = quality.join(labels, "doc_id").selectExpr("avg(int(predicted = quality))").first()[0]
    assert right >= 0.9
    found = QUERIES["op8_language_id"](spark, SF_DIR).where("held_out").join(docs, "doc_id")
    assert found.selectExpr("avg(int(lang_pred = lang))").first()[0] >= 0.95


def test_url_verdicts(spark):
    found = QUERIES["op5_url_filter"](spark, SF_DIR)
    assert found.where("rule = 'net/' AND verdict <> 'block'").isEmpty()
    assert found.where("rule = 'example.net/en/' AND verdict <> 'allow'").isEmpty()
    assert found.where("verdict NOT IN ('allow', 'block')").isEmpty()
