"""The training-data operators on small cases, against plain statements of their contracts."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tidemark.llm import (  # noqa: E402
    components,
    decontaminate,
    language,
    linestats,
    near,
    packing,
    quality_crf,
    quality_rules,
    sharding,
    substrings,
    tokens,
    urls,
    words,
)

WORD = re.compile(words.WORD)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    random = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in random.integers(0, vocabulary, n))


def corpus():
    """Copies, near copies, shared passages, and every odd row that an operator must stand."""
    base = [prose(i, 60 + i, 5000) for i in range(30)]
    passage = prose(99, 25, 5000)
    texts = list(base)
    texts += [base[0], base[0], base[1] + " tail", base[2].upper(), base[3][:-20]]
    texts += [f"{prose(200 + i, 30, 5000)}\n{passage} {prose(300 + i, 9, 5000)}" for i in range(4)]
    texts += [None, "", " \n\t ", "one two three", "one two three", "a b c d e", "é ß 日本"]
    texts += [prose(5, 40_000, 30_000), "x" * 50_000, "same " * 300]
    rows = [(i, text, "en" if i % 2 else None, f"s{i % 3}", len(text or "")) for i, text in enumerate(texts)]
    rows += [(3, texts[3], "en", None, 1), (3, texts[3], "en", None, 1), (None, base[0], None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return WORD.findall(text or "")


# --- words ---------------------------------------------------------------------------


def test_words_windows_and_slices():
    texts = ["a b  c", None, "", " x\ny ", "日本 é"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    found = words.Words(batch.column("text"))
    assert found.counts.tolist() == [3, 0, 0, 2, 2]
    raw = found.data.tobytes()
    every = [raw[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert every == [w for t in texts for w in split(t)]
    hashes, at = found.windows(2)
    assert at.tolist() == [0, 1, 3, 5] and len(set(hashes.tolist())) == 4
    assert sum(p.num_rows for p in words.slices(batch, limit=3)) == 5


# --- 1 -------------------------------------------------------------------------------


def removed(rows, window):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            gram = tuple(w[i : i + window])
            if doc is not None:
                first[gram] = min(first.get(gram, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = split(text), set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("window", [5, 13, 30])
def test_removed_passages_equal_brute_force(docs, window):
    import hashlib

    want = removed([(r[0], r[1]) for r in corpus()], window)
    found = substrings.remove_repeated(docs, window=window).collect()
    got = collections.Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found)
    assert got == collections.Counter(
        (d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in want
    )
    assert sum(r.n_removed for r in found) > 0
    assert all(r.kept_text is None or r.n_removed or "w" not in r.kept_text or " " in r.kept_text for r in found)


# --- 2 -------------------------------------------------------------------------------


def test_chain_marginals_equal_enumeration():
    unary, tie = np.array([0.3, -1.2, 2.0, 0.1]), 0.7
    row = np.array([0, 0, 0, 1])
    weight = collections.defaultdict(float)
    for bits in range(8):
        y = [(bits >> i) & 1 for i in range(3)]
        score = sum(u * v for u, v in zip(unary, y)) + tie * sum(a == b for a, b in zip(y, y[1:]))
        for i in range(3):
            weight[i, y[i]] += np.exp(score)
        for i in range(2):
            weight["same", i, y[i] == y[i + 1]] += np.exp(score)
    good, same = quality_crf.marginals(unary, row, tie)
    want = [weight[i, 1] / (weight[i, 0] + weight[i, 1]) for i in range(3)]
    assert np.allclose(good[:3], want) and np.isclose(good[3], 1 / (1 + np.exp(-0.1)))
    ties = [weight["same", i, True] / (weight["same", i, True] + weight["same", i, False]) for i in range(2)]
    assert np.allclose(same, ties)


def test_quality_learns_and_scores_odd_rows(spark, docs, empty):
    good = [prose(i, 80) + "." for i in range(40)]
    bad = [("BUY!! " * 40) + "### $$$" for _ in range(40)]
    rows = [(i, t, int(i < 40)) for i, t in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "id long, text string, label int")
    chain = quality_crf.train(frame.select("id", "text"), frame.select("id", "label"))
    scores = chain.score(pa.array([*good[:5], *bad[:5], None, ""]))
    assert (scores[:5] > 0.5).all() and (scores[5:10] < 0.5).all() and (scores[10:] == 0.5).all()
    found = quality_crf.score(docs, chain)
    assert found.count() == docs.count() and found.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality_crf.score(empty, chain).count() == 0
    assert quality_crf.fit([], []).score(pa.array(["a b"])).tolist() == [0.5]


# --- 3 -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_whole_texts(name):
    from tokenizers import Tokenizer

    random = np.random.default_rng(3)
    letters = list(" \n\t'.,aZé9²\u2026\u0301\u00a0Σß|<>日×\x1c\u3000")
    texts = ["".join(random.choice(letters, 40)) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "foo  <|endoftext|> bar", "don't 've x's", "", None, "ΑΣ. x", "a\r\n b"]
    path = public_tokenizers.path(name)
    ids, sizes = tokens.Encoder(path).encode(pa.array(texts))
    whole = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [w.ids for w in whole]


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [prose(i, 8) for i in range(6)]
    coder = tokens.Encoder(path)
    parts = [coder.encode(pa.array([t]))[0].tolist() for t in texts]
    assert parts == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 33])
def test_packing_of_bits_round_trips(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 32), 1001).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tokens.unpack(data, bits, 1001) == ids).all()


def test_token_files_round_trip(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    uri = tokens.token_folder(spark)
    files = tokens.write_tokens(docs, path, uri)
    found = sorted(tokens.read_tokens(files, uri).collect(), key=lambda r: r.start)
    coder = tokens.Encoder(path).tokenizer
    want = collections.Counter()
    for doc, text, *_ in corpus():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found[:-1]]).tolist()
    ids = [-1 if r.id is None else r.id for r in found]
    assert ids == sorted(ids)
    name = files.orderBy("file").first().file
    file = tokens.TokenFile(f"{uri}/{name}")
    assert len(file.row(0)) == file.ends[0] and file.bits == 16
    other = tokens.token_folder(spark)
    assert tokens.read_tokens(tokens.write_tokens(empty, path, other), other).count() == 0


# --- 4 -------------------------------------------------------------------------------


def test_schedule_gives_each_unit_to_the_least_loaded():
    placed = sharding.schedule([(7, "a"), (5, "b"), (4, "c"), (3, "d"), (3, "e")], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


@pytest.mark.parametrize("fine", [256, 0.01])
def test_shards_keep_groups_and_are_level(spark, docs, empty, fine, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", fine)  # at 0.01 nearly all groups are bundled
    found = sharding.shard_documents(docs, shards=4).collect()
    assert len(found) == docs.count()
    text = {r[0]: r[1] or "" for r in corpus()}
    shard = {}
    for r in found:
        if r.row.doc_id is not None:
            t = text[r.row.doc_id]
            assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
            assert shard.setdefault(t, r.shard) == r.shard
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, shards=4).count() == 0


# --- 5 -------------------------------------------------------------------------------


def test_url_rules_and_trees(spark):
    rules = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"))
    known = [
        ("http://A.NET/x?q=1", "a.net", "/x", "net/", "block"),
        ("http://m.example.net/en/1#t", "m.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
        ("http://net", "net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://x.org/a://b/c", "x.org", "/a://b/c", None, None),
    ]
    frame = spark.createDataFrame([(i, k[0]) for i, k in enumerate(known)], "page_id long, url string")
    found = {r.row.page_id: r for r in urls.judge(frame, rules).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(known):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert {r.verdict for r in urls.judge(frame, ()).collect()} == {"allow"}
    assert urls.judge(frame.limit(0), rules).count() == 0


# --- 6 -------------------------------------------------------------------------------


def reach(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = split((text or "").translate(lower))
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets[i] = (doc, grams)
    parent = {doc: doc for doc, _ in sets.values() if doc is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(d, g) for d, g in sets.values() if g and d is not None]
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return [(d, len(g), None if d is None else root(d)) for d, g in sets.values()]


def test_components_of_near_copies_equal_brute_force(docs, empty):
    found = near.classes(docs).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == collections.Counter(reach([(r[0], r[1]) for r in corpus()]))
    assert near.classes(empty).count() == 0


def test_chains_and_hot_groups_without_loss(spark, monkeypatch):
    """Chains of copies whose ends differ, and many sets that share most frequent shingles."""
    monkeypatch.setattr(near, "CELL_ROWS", 8)
    rows, text = [], prose(1, 120, 10_000).split()
    for i in range(40):
        rows.append((100 - i, " ".join(text)))
        text = [*text[3:], *prose(50 + i, 3, 10_000).split()]
    common = prose(2, 60, 10_000)
    rows += [(200 + i, f"{common} {prose(500 + i, 40, 10_000)}") for i in range(40)]
    rows += [(300 + i, f"{common} {prose(700 + i, 6, 10_000)}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.classes(frame).collect())
    assert got == sorted(reach(rows))


@pytest.mark.parametrize("leaf", [4, 64])
def test_signature_tree_finds_every_possible_pair(leaf, monkeypatch):
    monkeypatch.setattr(near, "LEAF_ROWS", leaf)
    random = np.random.default_rng(0)
    base = random.integers(1, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for i in range(60):
        own = base[random.permutation(400)[: 360 + i % 30]] if i % 3 else random.integers(
            1, 1 << 63, int(random.integers(3, 500)), dtype=np.uint64
        )
        sets.append(np.unique(own))
    columns = (
        np.array([len(s) for s in sets]), [near.bitmap(s, near.width(len(s))) for s in sets],
        np.arange(60), np.full(60, -1), np.full(60, 10), np.zeros(60, int), np.ones(60, bool),
    )
    found = {tuple(sorted(p)) for a, b, _ in near.pairs(near.tree(*columns)) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j) for j in range(60) for i in range(j)
        if near.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
    }
    assert want and want <= found and len(found) < 60 * 59 / 2


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(1000, 1001 + i) for i in range(50)]
    edges = spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(51)}}


# --- 7 -------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left(spark):
    items = [(i, prose(i, 14 + 4 * i, 100_000)) for i in range(10)]
    items += [(50, None), (51, ""), (52, "only three words")]
    edited = items[9][1].split()
    edited[0] = "other"
    rows = [(i, f"{prose(90 + i, 50, 100_000)} {t} {prose(40, 20, 100_000)}") for i, t in items[:9]]
    rows += [(20, " ".join(edited)), (21, items[3][1].upper()), (22, "say only three words now")]
    rows += [(30, prose(77, 300, 100_000)), (31, None), (32, ""), (None, items[2][1]), (33, "three only words")]
    half = items[5][1].split()
    rows += [(34, " ".join(half[: len(half) // 2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    want = {(i, i) for i in range(9)} | {(20, 9), (21, 3), (22, 52), (None, 2)}
    assert set(found) == want
    assert found[4, 4].start == 50 and found[4, 4].similarity == 1.0 and found[22, 52].n_words == 3
    assert found[20, 9].similarity < 1
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_documents_shorter_than_an_item_are_windows(spark, threshold):
    items = {i: prose(i, n, 100_000).split() for i, n in enumerate((9, 10, 15, 24, 28, 31, 44, 59))}
    items[8] = ["same"] * 20
    rows, random = [], np.random.default_rng(7)
    for w in items.values():
        for gone in range(1, len(w) // 2):
            front = int(random.integers(0, gone + 1))
            part = w[front : len(w) - gone + front]
            rows += [part, [*part[:-1], "other"], [*part[:3], "other", *part[4:]]]
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for doc, w in enumerate(rows):
        for item, t in items.items():
            a, b = grams(w), grams(t)
            c = (a & b).total()
            if 0 < a.total() < b.total() and c >= (threshold - 1e-12) * (a.total() + b.total() - c):
                want[doc, item] = (0, len(w), c / (a.total() + b.total() - c))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontaminate.matches(docs, bench, threshold=threshold).collect()
    assert len(want) > 30
    assert {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in found} == want


def test_decontamination_runs_no_python(spark, docs):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    plan = decontaminate.matches(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 8 -------------------------------------------------------------------------------


def test_language_kernel_is_the_nystrom_ridge_solution():
    texts = ["the thing of that", "der die das und", "the other of it", "und das der", "of the", "die der"]
    langs = ["en", "de"] * 3
    model = language.fit(texts, langs, landmarks=2)
    found, scores = model.predict(["the of thing", "und die der", "12 34", "", None])
    assert found == ["en", "de", "und", "und", "und"] and scores[2:].tolist() == [0, 0, 0]
    assert ((scores >= 0) & (scores <= 1)).all()


def test_language_frames(spark, docs, empty):
    model = language.train(
        docs.select(F.col("doc_id").alias("id"), "text", F.coalesce("lang", F.lit("xx")).alias("lang"))
    )
    found = language.predict(docs, model)
    assert found.count() == docs.count()
    und = {r.row.doc_id for r in found.where("lang_pred = 'und'").collect()}
    assert und == {r[0] for r in corpus() if not any(c.isalpha() for c in r[1] or "")}
    nothing = language.train(empty.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r.lang_pred for r in language.predict(docs, nothing).where("text rlike '[a-z]'").collect()} <= {"und"}


# --- 9 -------------------------------------------------------------------------------


def test_base_statistics_equal_plain_counts(docs):
    found = {r.row.doc_id: r for r in quality_rules.judge(docs, least_rows=5).collect()}
    for doc, text, *_ in corpus():
        w = split(text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        want = (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(twice),
        )
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_outliers_of_a_source_are_rejected(spark, empty):
    rows = [(i, prose(i, 60 + i % 40) + ".", "en", "a" if i % 3 else "b") for i in range(600)]
    rows += [(600 + i, " ".join(f"{w}###%%%" for w in prose(900 + i, 60).split()), "en", "a") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.row.doc_id: r.kept for r in quality_rules.judge(frame, least_rows=100).collect()}
    assert not any(found[600 + i] for i in range(20))
    assert sum(found[i] for i in range(600)) >= 597
    assert quality_rules.judge(empty).count() == 0


def test_sources_with_few_fit_rows_are_judged_by_wider_groups(spark):
    noise = lambda i: " ".join(f"{w}###%%%" for w in prose(i, 60).split())
    rows = [(i, prose(i, 60 + i % 40) + ".", "en", "a") for i in range(200)]
    # Many rows of which few meet the base rules, a lone small source, a small language, and nulls.
    rows += [(1000 + i, "w " * 40, "en", "b") for i in range(150)]
    for at, lang, source in ((2000, "en", "b"), (3000, "en", "c"), (4000, "de", "c"), (5000, None, None)):
        rows += [(at + i, prose(at + i, 60 + i % 40) + ".", lang, source) for i in range(20)]
        rows += [(at + 500 + i, noise(at + 500 + i), lang, source) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.row.doc_id: r for r in quality_rules.judge(frame, least_rows=100).collect()}
    assert len(found) == len(rows) and all(r.distance is not None for r in found.values())
    for at in (2000, 3000, 4000, 5000):
        assert not any(found[at + 500 + i].kept for i in range(5))
        assert sum(found[at + i].kept for i in range(20)) >= 19
    assert sum(found[i].kept for i in range(200)) >= 198
    few = quality_rules.judge(frame.where("doc_id >= 1000"), least_rows=101).collect()
    assert all(r.distance is None and r.kept != r.base_failed for r in few)


def test_lines_of_a_batch():
    found = linestats.Lines(words.Words(pa.array(["a\na\n\n a", None, "a", "\nb"])))
    assert found.row.tolist() == [0, 0, 0, 2, 3]
    assert found.duplicates(4).tolist() == [1, 0, 0, 0]


# --- 10 ------------------------------------------------------------------------------


def one_by_one(lengths, limits, weights):
    """Vector best fit piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [(((((b - need) / limits) ** 2) * weights).sum(), k) for k, b in enumerate(bins) if (b >= need).all()]
        if fits:
            bins[min(fits)[1]] = bins[min(fits)[1]] - need
        else:
            bins.append(limits - need)
    return bins


@pytest.mark.parametrize("documents", [None, 4])
def test_plan_equals_best_fit_one_by_one(documents):
    capacity = packing.Capacity(100, documents)
    lengths = np.random.default_rng(5).integers(1, 101, 500).tolist()
    plan = packing.plan(collections.Counter(lengths), capacity)
    held = collections.defaultdict(list)
    for length, lo, hi, first, each, offset in plan:
        for k in range(hi - lo):
            held[first + k // each].append((offset + k % each * length, length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist()
        assert sum(n for _, n in parts) <= 100 and len(parts) <= (documents or 100)
    assert collections.Counter(n for p in held.values() for _, n in p) == collections.Counter(lengths)
    assert len(held) == len(one_by_one(lengths, capacity.vector(), np.array(capacity.weights)))


def test_cost_capacity_binds():
    plan = packing.plan({50: 10}, packing.Capacity(100, cost=3000))
    assert all(each == 1 for *_, each, _ in plan)
    with pytest.raises(ValueError):
        packing.plan({60: 1}, packing.Capacity(100, cost=3000))


def test_packed_documents(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack_documents(docs, path).collect()
    coder = tokens.Encoder(path).tokenizer
    ids = {d: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in corpus()}
    for r in found:
        part = ids[r.id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in found) == sum(len(ids[d]) for d, *_ in corpus())
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist()
        assert parts[-1][0] + parts[-1][1] <= 2048
    assert packing.pack_documents(empty, path).count() == 0


# --- pipeline, clashing names --------------------------------------------------------

CLASHING = ("row", "key", "n_words", "kept", "score", "doc", "hash", "start", "shard", "id", "piece", "component_id")


def test_clashing_columns(spark, docs):
    odd = docs.where("doc_id < 20 AND doc_id <> 3")
    for name in CLASHING:
        odd = odd.withColumn(name, F.lit("mine"))
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    chain = quality_crf.fit(["a b", "c d"], [0, 1])
    frames = [
        substrings.remove_repeated(odd), quality_crf.score(odd, chain), sharding.shard_documents(odd),
        language.predict(odd, language.fit(["a"], ["en"])), quality_rules.judge(odd),
    ]
    for frame in frames:
        assert frame.where("row.key = 'mine' AND row.row = 'mine'").count() == 19
    assert near.classes(odd).count() == 19
    assert decontaminate.matches(odd, bench).count() == 0
    assert packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).count() >= 19


def test_pipeline_stages(spark, folder):
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).withColumn("key", F.lit(2))
    docs.write.parquet(f"{folder}/documents.parquet")
    item = " ".join(rows[10][1].split()[5:40])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == docs.columns
    ids = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in known.collect()} == ids
    single = stages["ngram_jaccard_join"](spark, known, folder)
    firsts = {c for d, n, c in reach([(r[0], r[1]) for r in rows]) if d in ids}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == firsts
    cut = stages["substring_dedup"](spark, single, folder)
    kept = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns
    for doc, n, gone, text in removed([(r.doc_id, r.text) for r in single.collect()], 13):
        assert gone < n and (kept[doc].text == text if gone else True)
        assert kept[doc].n_chars == len(kept[doc].text) and kept[doc].extra == 1
    clean = stages["benchmark_decontamination"](spark, cut, folder)
    assert {r.doc_id for r in clean.collect()} == firsts - {10}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == firsts - {10}


def test_pipeline_without_ids_or_languages(spark, folder):
    item = prose(1, 30, 100_000)
    leak, clean = f"{prose(2, 30, 100_000)} {item}", prose(3, 60, 100_000)
    rows = [(i, text, None, None, 1) for i in (7, None) for text in (leak, clean)]
    rows += [(8, leak, None, None, 1), (8, "12 34", None, None, 1), (None, "", None, None, 1), (9, None, None, None, 1)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    known = corpus_pipeline.keep_known_languages(spark, docs, folder)
    assert known.columns == docs.columns
    texts = lambda frame: sorted([(r.doc_id or 0, r.text) for r in frame.collect()])
    assert texts(known) == sorted([(i, text) for i in (7, 0) for text in (leak, clean)] + [(8, leak)])
    left = corpus_pipeline.drop_benchmark_leaks(spark, known, folder)
    assert left.columns == docs.columns and texts(left) == [(0, clean), (7, clean)]
