"""The registered queries of the training-data operators and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    language,
    lexical,
    middle,
    near,
    packing,
    quality_crf,
    quality_rules,
    sharding,
    substrings,
    tokens,
    toxicity,
    urls,
)

QUERIES, ORACLES = {}, {}


def query(key, sql=None):
    def add(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS g FROM p
), least AS (
  SELECT g, min(doc_id) AS least FROM g GROUP BY g
), hit AS (
  SELECT g.doc_id, list(i) AS starts FROM g JOIN least USING (g) WHERE least < g.doc_id GROUP BY g.doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 13)))) AS gone FROM hit
), kept AS (
  SELECT w.doc_id, coalesce(len(words), 0) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words
      ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i])
    END AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM kept
""",
)
def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.remove_repeated(docs, with_text=False)
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


@query("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, RULES).select(
        "row.page_id", "host", "path", "rule", "verdict", "block_score"
    )


@query("op3_token_output")
def op3_token_output(spark, sf_dir):
    uri = tokens.token_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), uri)
    return tokens.read_tokens(files, uri).withColumnRenamed("id", "doc_id")


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality_rules.judge(docs)
    return out.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance",
    )


def held_out():
    """Documents that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    labels = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = quality_crf.score(docs, quality_crf.train(learnt, labels)).select("row.*", "score")
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnt = docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    out = language.predict(docs.select("doc_id", "text"), language.train(learnt))
    return out.select("row.*", "lang_pred", "score").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


@query(
    "op6_ngram_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
)
def op6_ngram_jaccard_join(spark, sf_dir):
    return near.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op7_benchmark_decontamination",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), d AS (
  SELECT doc_id, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) AS s
  FROM w WHERE len(words) >= 5
), b AS (
  SELECT item_id, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) AS t
  FROM (
    SELECT item_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS words
    FROM benchmark
  ) WHERE len(words) >= 5
), shared AS (
  SELECT DISTINCT doc_id, item_id
  FROM (SELECT doc_id, unnest(s) AS g FROM d) JOIN (SELECT item_id, unnest(t) AS g FROM b) USING (g)
), v AS (
  SELECT doc_id, item_id, t, s, unnest(range(1, len(s) - len(t) + 2)) AS p
  FROM shared JOIN d USING (doc_id) JOIN b USING (item_id) WHERE len(s) >= len(t)
), c AS (
  SELECT doc_id, item_id, p, len(t) AS m, list_sum(list_transform(list_distinct(t), lambda x: least(
    len(list_filter(t, lambda y: y = x)),
    len(list_filter(s[p : p + len(t) - 1], lambda y: y = x))))) AS c
  FROM v
), hit AS (
  SELECT doc_id, item_id, p - 1 AS start, m + 4 AS n_words, c / (2 * m - c) AS similarity
  FROM c WHERE 10 * c >= 8 * (2 * m - c)
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words, similarity
FROM hit
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""",
)
def op7_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query(
    "op11_lexical_search",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), c AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
), p AS (
  SELECT doc_id, n, t, count(*) AS tf
  FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, c GROUP BY t, n_docs
), s AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), c
  GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
)
def op11_lexical_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = lexical.search(docs, items)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query(
    "op12_fill_in_middle",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
  FROM documents
), c AS (
  SELECT *, len(lines) AS n,
    ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n, form,
    coalesce(array_to_string(lines[1 : least(a, b)], ''), '') AS p,
    coalesce(array_to_string(lines[least(a, b) + 1 : greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(lines[greatest(a, b) + 1 :], ''), '') AS s
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
)
def op12_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = middle.restore(middle.transform(docs))
    return out.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    labels = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    out = toxicity.score(docs, toxicity.train(learnt, labels)).select("row.*", "score")
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
