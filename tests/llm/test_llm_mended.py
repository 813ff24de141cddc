"""Cases of the first ten operators that earlier tests left out."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tidemark.llm import decontaminate, language, near, quality_crf, substrings, urls  # noqa: E402


def prose(seed, n, vocabulary=5000):
    pick = np.random.default_rng(seed)
    return [f"w{i}" for i in pick.integers(0, vocabulary, n)]


# --- 1 -------------------------------------------------------------------------------


def test_rows_without_an_id_lose_nothing(spark):
    passage = " ".join(prose(1, 20))
    rows = [(1, passage + " tail"), (5, passage + " x y z"), (None, passage + " x y z"), (None, passage)]
    found = substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r.row.doc_id, r.n_words, r.n_removed) for r in found)
    assert got == {(1, 21, 0): 1, (5, 23, 20): 1, (None, 23, 0): 1, (None, 20, 0): 1}


# --- 2, 8 ----------------------------------------------------------------------------


def test_samples_do_not_depend_on_the_layout(spark):
    rows = [(i % 60, f"text {i} of {i % 7}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "id long, label int")
    docs = spark.createDataFrame(rows, "id long, text string")
    samples = []
    for parts in (1, 3, 7):
        sample = quality_crf.sample_ids(labels.repartition(parts), "label", 10)
        found = quality_crf.sampled_texts(docs.repartition(parts, "text"), sample, ["id"])
        samples.append(found.sort_values("id").values.tolist())
    assert samples[0] == samples[1] == samples[2] and len(samples[0]) == 20
    least = {i: min(t for j, t in rows if j == i) for i in range(60)}
    assert all(row[-1] == least[row[0]] for row in samples[0])


def test_few_rows_of_a_label_reach_its_window(spark):
    many = spark.range(200_000).select(F.col("id"), (F.col("id") % 2).alias("label"))
    kept = quality_crf.sample_ids(many, "label", 50)
    least = many.withColumn("h", F.xxhash64("id")).toPandas()
    want = {int(i) for k in (0, 1) for i in least[least.label == k].nsmallest(50, "h")["id"]}
    assert {r["id"] for r in kept.collect()} == want


def test_languages_of_many_letters_are_told_apart():
    pick = random.Random(4)
    letters = {
        "el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "en": "abcdefghijklmnopqrstuvwxyz",
        "zh": "".join(chr(0x4E00 + 7 * i) for i in range(300)), "ja": "".join(chr(0x3041 + i) for i in range(80)),
        "ko": "".join(chr(0xAC00 + 11 * i) for i in range(300)), "he": "אבגדהוזחטיכלמנסעפצקרשת",
    }

    def texts(lang, n):
        return [" ".join("".join(pick.choices(letters[lang], k=4)) for _ in range(12)) for _ in range(n)]

    learnt = [(t, lang) for lang in letters for t in texts(lang, 60)]
    model = language.fit([t for t, _ in learnt], [lang for _, lang in learnt])
    asked = [(t, lang) for lang in letters for t in texts(lang, 30)]
    found, _ = model.predict([t for t, _ in asked])
    assert np.mean([a == b for a, (_, b) in zip(found, asked, strict=True)]) >= 0.98


def test_bisection_finds_the_same_grams_as_the_table(monkeypatch):
    texts = ["the one and the other", "der eine und der andere", "été à la mer"] * 4
    langs = ["en", "de", "fr"] * 4
    by_table = language.fit(texts, langs)
    monkeypatch.setattr(language, "TABLE_GRAMS", 0)
    by_bisection = language.fit(texts, langs)
    asked = [*texts, "unseen ωμέγα words", "", "12"]
    for a, b in zip(by_table.scores(asked), by_bisection.scores(asked), strict=True):
        assert np.allclose(a, b, atol=1e-5)


# --- 5 -------------------------------------------------------------------------------


def test_trees_carry_a_lexical_pattern_to_other_hosts(spark):
    pick, rows = random.Random(5), []

    def url(host, bad):
        if bad:
            return f"http://x{pick.randrange(10**6)}.{host}/{pick.randrange(10**9)}?a={pick.randrange(999)}&b=1&c=2"
        return f"https://www.{host}/{pick.choice(['news', 'about', 'blog'])}/{pick.choice(['one', 'two', 'three'])}"

    for i in range(600):
        bad = pick.random() < 0.5
        host = ("bad.test" if bad else "good.test") if i % 2 else f"site{i % 40}.other"
        rows.append((i, url(host, bad), bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = (urls.Rule("block", "bad.test", "/"), urls.Rule("allow", "good.test", "/"))
    found = urls.judge(pages, rules).select("row.bad", "rule", "verdict").collect()
    rest = [r for r in found if r.rule is None]
    assert len(rest) == 300
    assert np.mean([(r.verdict == "block") == r.bad for r in rest]) >= 0.95


def test_rates_leave_the_own_label_out(spark):
    frame = spark.createDataFrame([(1.0, 3, 1.0), (0.0, None, 0.0)], "label double, urls long, blocked double")
    frame = frame.withColumnsRenamed({"urls": "r_urls", "blocked": "r_blocked"})
    own = frame.select(urls._rate("r", 0.5, F.col("label"))).first()[0]
    assert own == (1 - 1 + 1) / (3 - 1 + 2)
    assert [r[0] for r in frame.select(urls._rate("r", 0.5)).collect()] == [2 / 5, 1 / 2]


# --- 6 -------------------------------------------------------------------------------


def test_sets_with_one_key_are_kept_apart(spark, monkeypatch):
    rows = [(i, " ".join(prose(i, 40))) for i in range(12)] + [(50, " ".join([*prose(3, 40), "tail"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(tuple(r) for r in near.classes(frame).collect())
    assert sum(d != c for d, _, c in want) == 1
    # A column of two keys only, as if the sets' first hashes met.
    found = []
    original = near.links

    def links(rows, sets, clashes=()):
        found.append(list(clashes))
        return original(rows, sets, clashes)

    monkeypatch.setattr(near, "links", links)
    assert sorted(tuple(r) for r in near.classes(frame).collect()) == want and found == [[]]


def test_a_group_of_near_copies_of_near_copies(spark, monkeypatch):
    """Copies that differ from the first text by more than the limit, but not from each other."""
    monkeypatch.setattr(near, "CELL_ROWS", 16)
    pick, base, rows = random.Random(6), prose(9, 120), []
    for i in range(70):
        words = list(base)
        for at in pick.sample(range(120), pick.choice([1, 2, 4, 5, 6])):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, parent = [shingles(t) for _, t in rows], list(range(70))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(70):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [(i, len(sets[i]), root(i)) for i in range(70)]
    assert len({r for *_, r in want}) > 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in near.classes(frame).collect()) == want


def test_frequent_passages_make_no_large_cells(spark, monkeypatch):
    """Texts that all share a passage, and most of their words with one other, meet only that one."""
    def words(seed, n):
        pick = random.Random(seed)
        return [f"w{pick.randrange(10**9)}" for _ in range(n)]

    rows = [
        (i, " ".join([*words(1, 12), *words(1000 + i // 2, 200), *words(5000 + i, 80)])) for i in range(120)
    ]
    rows += [(200 + i, f"{rows[i][1]} tail") for i in range(0, 40, 4)]
    largest, dealt = [], near._dealt

    def watched(steps, cells):
        found = dealt(steps, cells)
        sizes = found.groupBy("pivot", "level", "i", "j").count().agg(F.max("count")).first()[0]
        largest.append(sizes or 0)
        return found

    monkeypatch.setattr(near, "_dealt", watched)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id) for r in near.classes(frame).collect())
    assert found == [(i, i - 200 if i >= 200 else i) for i, _ in rows]
    assert largest and max(largest) <= 6


# --- 7 -------------------------------------------------------------------------------


def best_window(item, text):
    """The greatest similarity of a window of the item's size, or of a shorter text as a whole."""
    t, w = [tuple(item[i : i + 5]) for i in range(len(item) - 4)], text
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    m = len(t)
    spans = [s] if len(s) < m else [s[p : p + m] for p in range(len(s) - m + 1)]
    best, counts = 0, collections.Counter(t)
    for span in spans:
        common = sum((counts & collections.Counter(span)).values())
        best = max(best, common / (m + len(span) - common)) if span else best
    return best


def test_edits_around_the_limit_are_found(spark):
    pick = random.Random(8)
    items = [(i, prose(100 + i, pick.randrange(18, 60), 3000)) for i in range(12)]
    docs, wanted = [], {}
    for k in range(240):
        item, words = items[k % 12]
        edited = list(words)
        for at in pick.sample(range(len(words)), pick.choice([0, 1, 1, 2])):
            edited[at] = f"x{k}y{at}"
        if k % 5 == 0:
            edited = edited[pick.choice([0, 1, 3]) : len(edited) - pick.choice([0, 1, 2])]
        if k % 3:
            edited = [*prose(1000 + k, 15, 3000), *edited, *prose(2000 + k, 15, 3000)]
        docs.append((k, " ".join(edited)))
        for other, text in items:
            similarity = best_window(text, edited)
            if similarity >= 0.8:
                wanted[k, other] = similarity
    assert 60 < len(wanted) < 240 and any(s < 0.85 for s in wanted.values())
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame, bench).collect()}
    assert all(abs(wanted[k] - s) < 1e-9 for k, s in found.items())
    assert len(found) >= 0.99 * len(wanted)


def test_windows_meet_only_the_items_that_were_seen_in_them(spark):
    """Two hundred items of one size, each in one document: the join by blocks stays as large."""
    items = [(i, " ".join(prose(300 + i, 24, 50_000))) for i in range(200)]
    docs = [(i, f"{' '.join(prose(900 + i, 30, 50_000))} {text}") for i, text in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(frame, bench)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(200)]
    text = found._jdf.queryExecution().toString()
    assert re.search(r"Join.*item#\d+L?.*block#\d+", text)
