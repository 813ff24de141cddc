"""Lexical search, fill-in-middle and toxicity against plain statements of their contracts."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from tidemark.llm import lexical, middle, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, vocabulary=300):
    random = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in random.zipf(1.3, n) % vocabulary)


def corpus():
    texts = [prose(i, 20 + 7 * i) for i in range(40)]
    texts += [texts[3], texts[3], texts[4].upper(), None, "", " \n\t", "?!", "É w1,w2;É日本"]
    texts += ["a\nb", "a\nb\n", "\n", "\n\n", "x <P> y\nz", "<S", "P>\nq", "ends <", "M> starts\n", "é\nß\n日本\n"]
    texts += ["line\n" * 500, "w7 " * 30_000, prose(99, 20_000, 9000)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], None, None, 1), (None, texts[5], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 ------------------------------------------------------------------------------


def items():
    texts = ["w1 w2 w3 W4 w1", prose(3, 41), prose(7, 60) + " unseen", "nothing of it", None, "", "日本 w9", "w0"]
    return [(i, t) for i, t in enumerate(texts)] + [(1, "w250 w251"), (None, "w1")]


def ranked(rows, queries, top):
    held = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    wanted = collections.defaultdict(set)
    for item, text in queries:
        if item is not None:
            wanted[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


@pytest.mark.parametrize("top, block", [(10, 20_000), (3, 20), (1000, 20_000)])
def test_ranking_equals_brute_force(spark, docs, monkeypatch, top, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "FIRST", 2)
    queries = spark.createDataFrame(items(), "item_id long, text string")
    found = lexical.search(docs, queries, top=top)
    assert sorted(map(tuple, found.collect())) == ranked(corpus(), items(), top)


def test_search_of_empty_tables_and_other_columns(spark, docs, empty):
    queries = spark.createDataFrame(items(), "item_id long, text string")
    assert lexical.search(empty, queries).collect() == []
    assert lexical.search(docs, queries.limit(0)).collect() == []
    assert lexical.search(docs.where("text IS NULL"), queries).collect() == []
    named = docs.selectExpr("doc_id AS h0", "text AS doc", "lang AS text", "doc_id AS item", "n_chars AS score")
    other = queries.selectExpr("item_id AS doc", "text AS h1", "item_id AS text")
    found = lexical.search(named, other, id_column="h0", item_column="doc", text_column="doc")
    assert found.columns == ["item", "rank", "doc", "score"]
    found = lexical.search(docs.selectExpr("doc_id AS h0", "text", "lang AS doc"), queries, id_column="h0")
    assert sorted(map(tuple, found.collect())) == ranked(corpus(), items(), 10)


def sparse_rows(seed, rows, size, clusters):
    random = np.random.default_rng(seed)
    centers = [random.choice(size, 12, replace=False) for _ in range(clusters)]
    terms = [np.unique(np.append(centers[i % clusters], random.integers(0, size, 3))) for i in range(rows)]
    edges = np.append(0, np.cumsum([len(t) for t in terms]))
    values = random.integers(1, 10**13, edges[-1])
    return lexical.Vectors(np.arange(rows), edges, np.concatenate(terms), values)


def below(tree, node):
    if tree.children[node] is None:
        return [tree.leaves[node]]
    return [leaf for child in tree.children[node] for leaf in below(tree, child)]


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_for_every_node_and_leaves_are_left_out(seed):
    size = 701
    rows = sparse_rows(seed, 900, size, 30)
    tree = lexical.BallTree(rows, size)
    assert sum(len(x) for x in tree.leaves.values()) == 900
    scored = 0
    for item in range(20):
        terms = np.sort(np.random.default_rng(item).choice(size, 15, replace=False))
        terms = np.unique(np.append(terms, rows.terms[rows.edges[item] : rows.edges[item] + 9]))
        wanted = np.isin(np.arange(size), terms).astype(np.int64)
        bound = tree.bounds(terms)
        for node in range(len(bound)):
            assert bound[node] >= max(x.sums(x.values * wanted[x.terms]).max() for x in below(tree, node))
        best = lexical.Best(10)
        scored += lexical.search_tree(tree, terms, best)
        every = rows.sums(rows.values * wanted[rows.terms])
        order = np.lexsort((rows.docs, -every))[:10]
        order = order[every[order] > 0]
        assert best.docs.tolist() == order.tolist() and best.scores.tolist() == every[order].tolist()
    assert scored < 20 * len(tree.leaves) / 2


def test_equal_rows_make_a_tree():
    one = sparse_rows(5, 1, 50, 1)
    rows = one.take(np.zeros(300, np.int64))
    tree = lexical.BallTree(rows, 50)
    best = lexical.Best(5)
    lexical.search_tree(tree, one.terms, best)
    assert len(best.docs) == 5 and len(set(best.scores.tolist())) == 1


# --- 12 ------------------------------------------------------------------------------


def cut(doc, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"seed": 11, "rate": 40, "spm_rate": 80}, {"seed": 12, "rate": 0}])
def test_middles_equal_brute_force_and_are_restored(docs, options):
    found = middle.restore(middle.transform(docs, **options)).collect()
    got = collections.Counter(
        (r.row.doc_id, r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found
    )
    assert got == collections.Counter((r[0], r[1] or "", *cut(r[0], r[1], **options)) for r in corpus())
    if not options:
        assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_middle_of_empty_tables_clashing_columns_and_broken_outputs(spark, docs, empty):
    assert middle.restore(middle.transform(empty)).collect() == []
    named = docs.selectExpr("doc_id", "text", "lang AS output", "source AS form", "n_chars AS n", "doc_id AS h0")
    found = middle.restore(middle.transform(named))
    assert found.count() == docs.count()
    assert found.select("row.*").columns == ["doc_id", "output", "form", "n", "h0"]
    for output, form in (("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", "spm"), ("abc", "psm")):
        broken = spark.createDataFrame([(output, form)], "output string, form string")
        with pytest.raises(Exception, match="mark"):
            middle.restore(broken).collect()


# --- 13 ------------------------------------------------------------------------------


def test_plain_words_undo_disguises():
    texts = ["You IDIOT! stup1d tr4sh m.o.r.o.n looooser a55hole ÉTÉ l'idiot “scum” well-known", "", None, "!!! a"]
    words = toxicity.PlainWords(pa.array(texts))
    every = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends)]
    assert every == "you idiot stupid trash moron loser asshole été l idiot scum wellknown a".split()
    plain = {"you", "idiot", "été", "l", "scum", "a"}
    assert [not d for d in words.disguised] == [w in plain for w in every]
    assert words.counts.tolist() == [12, 0, 0, 1]


def test_terms_equal_plain_ones():
    words = toxicity.PlainWords(pa.array(["straßen été", "日本語日本語 ab"]))
    at, hashes, stem = toxicity.terms(words)
    assert sorted(zip(at.tolist(), stem.tolist())) == sorted(
        [(i, False) for i in range(4)] + [(0, True)] * 3 + [(2, True)] * 2
    )
    again = toxicity.terms(toxicity.PlainWords(pa.array(["straß straßen"])))
    assert set(hashes[stem & (at == 0)].tolist()) & set(again[1][again[2]].tolist())


def toxic_corpus(n=900):
    """Texts of random words; toxic ones hold an insult, or a word that begins as one, now and then disguised."""
    random = np.random.default_rng(3)
    insults, rows = ["grobzak", "vlurmi", "shonkadel"], []
    for i in range(n):
        words = [f"{'abcdefghij'[j % 10]}w{'qrstuvwxyz'[j // 10 % 10]}{'klmnopqrst'[j // 100]}" for j in random.integers(0, 1000, 60)]
        label = int(random.random() < 0.2)
        for _ in range(3 * label):
            bad = insults[random.integers(0, 3)] + ["", "en", "tum", "isch"][random.integers(0, 4)]
            if random.random() < 0.3:
                bad = bad.replace("o", "0").replace("i", "1")
            words[random.integers(0, 60)] = bad
        rows.append((i, " ".join(words), label))
    copies = [(n + i, rows[0][1] + f" x{i}", rows[0][2]) for i in range(60)]
    return rows + copies


def test_toxicity_learns_words_and_beginnings(spark):
    rows = toxic_corpus()
    frame = spark.createDataFrame(rows, "id long, text string, label int").repartition(4)
    learnt = frame.where("id % 3 <> 1")
    model = toxicity.train(learnt.select("id", "text"), learnt.select("id", "label"))
    found = toxicity.score(frame, model).select("row.*", "score").where("id % 3 = 1 AND id < 900").collect()
    assert len({r.id for r in found}) == 300
    assert np.mean([(r.score >= 0.7) == (r.label == 1) for r in found]) >= 0.97
    # Calibrated: the mean score is near the share of toxic texts.
    assert abs(np.mean([r.score for r in found]) - np.mean([r.label for r in found])) < 0.05
    again = toxicity.train(learnt.repartition(7).select("id", "text"), learnt.select("id", "label").repartition(2))
    assert np.array_equal(again.lexicon.hashes, model.lexicon.hashes)
    scores = {r.id: r.score for r in toxicity.score(frame, again).select("row.*", "score").collect()}
    assert all(abs(scores[r.id] - r.score) < 1e-9 for r in found)


def test_lexicon_counts_equal_plain_ones_and_copies_count_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEMS", ())
    name = lambda i: "bcdfgh"[i % 6] + "xyzvwq"[i // 6 % 6] + "mnprkl"[i // 36 % 6]
    rows = [(i, f"{name(i)} bad word {name(i + 20)} {name(i + 40)}", i % 2) for i in range(12)]
    rows += [(100 + i, "this long text of many words is copied bad copyword", 1) for i in range(50)]
    rows += [(200 + i, f"{name(60 + i)} vile {name(80 + i)} {name(100 + i)} mild{'ly' * (i % 2)}", 1) for i in range(6)]
    rows += [(300 + i, f"{name(120 + i)} mild {name(140 + i)} {name(160 + i)} mildly", 0) for i in range(2)]
    frame = spark.createDataFrame(rows, "id long, text string, label int").repartition(5)
    lessons = toxicity.lessons(frame.select("id", "text"), frame.select("id", "label"))
    assert lessons.count() == 12 + 1 + 6 + 2
    held = {1: collections.Counter(), 0: collections.Counter()}
    for row in lessons.collect():
        held[row.label].update(set(row.text.split()))
    wanted, z2 = {}, toxicity.DEVIATIONS**2
    for word, a in held[1].items():
        n = a + held[0][word]
        p = a / n
        share = (p + z2 / (2 * n) - toxicity.DEVIATIONS * math.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
        if a >= 2 and share >= 0.5:
            code = int(toxicity.PlainWords(pa.array([word])).hashes()[0] >> np.uint64(2))
            wanted[code] = share
    every = toxicity.lexicons(lessons)[2]
    assert len(wanted) == 1  # "vile"; "mild" and "bad" stand in clean texts, "copyword" counts once
    assert dict(zip(every.hashes.tolist(), every.shares.tolist())) == pytest.approx(wanted)


def test_toxicity_of_odd_rows_and_single_labels(spark, docs, empty):
    texts, labels = docs.selectExpr("doc_id AS id", "text"), docs.selectExpr("doc_id AS id", "1 AS label")
    for train_labels, wanted in ((labels, 1.0), (labels.limit(0), 0.0), (labels.withColumn("label", labels.id * 0 + 5), 0.0)):
        found = toxicity.score(docs, toxicity.train(texts, train_labels)).collect()
        assert len(found) == docs.count() and {r.score for r in found} == {wanted}
    model = toxicity.train(texts, docs.selectExpr("doc_id AS id", "CAST(doc_id % 2 AS int) AS label"))
    named = docs.selectExpr("doc_id AS features", "text", "lang AS margin", "source AS prediction", "n_chars AS score")
    found = toxicity.score(named, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    blank = [r.score for r in toxicity.score(docs.where("text IS NULL OR text = ''"), model).collect()]
    assert len(set(blank)) == 1
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.train(empty.selectExpr("doc_id AS id", "text"), labels).prior == 0
