"""Stages that turn raw documents into packed training sequences.

Every stage takes and returns the columns of ``documents``, further columns included; the last one
returns the pieces of the packed sequences. ``run`` stores each stage's rows in the shared folder
before the next one reads them, as recomputing a stage would cost more than storing it.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, near, packing, substrings
from tidemark.llm.queries import held_out
from tidemark.llm.shared import stored

TOKENIZER = "word_bpe_49k.json"

#: The stages' results rest on trained models, hashes and a tokenizer, which SQL cannot state.
ORACLE_SQL = None


def keep_known_languages(spark, docs, sf_dir):
    """Drop texts without any language; learn from ``lang`` of documents that are not held out.

    Where there is no language to learn from, only texts without a letter are dropped.
    """
    learnt = docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    model = language.train(learnt)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model).where("lang_pred <> 'und'")
    return _columns(found, docs)


def keep_one_of_near_copies(spark, docs, sf_dir):
    """Keep the document with the least id of every group of near copies.

    Rows without an id are no part of a group and stay.
    """
    found = near.classes(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(stored(found, "near_copies"), "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark, docs, sf_dir):
    """Cut passages of 13 words or more that an earlier document has; drop what is left empty."""
    found = substrings.remove_repeated(docs)
    cut = found.where("n_removed = 0 OR n_removed < n_words").withColumnRenamed("kept_text", "text")
    cut = _columns(cut, docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Drop documents that hold a window like a benchmark item, also those without an id.

    Rows are told apart by id and text, so other texts under a leak's id stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    of_text = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    row = F.struct("doc_id", of_text[0].alias("h1"), of_text[1].alias("h2"))
    found = decontaminate.matches(docs.select(row.alias("doc"), "text"), benchmark, id_column="doc")
    found = found.select(*[F.col(f"doc.{c}").alias(f"_leak_{c}") for c in ("doc_id", "h1", "h2")]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_leak_doc_id"))
    same &= (of_text[0] == F.col("_leak_h1")) & (of_text[1] == F.col("_leak_h2"))
    return docs.join(stored(found, "leaks"), same, "left_anti").select(docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pack the documents' ids into sequences of at most 2048 tokens."""
    packed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return packed.withColumnRenamed("id", "doc_id")


def _columns(found, docs):
    """The columns of ``docs`` from the struct ``row`` and ``text``."""
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]


def run(spark, sf_dir):
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
