"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

An item's window in a document has as many words as the item. Similarity is that of weighted
shingles: each shingle weighs as often as it occurs, and the common weight is divided by the weight
of the union. With equally many shingles on both sides, a window of similarity ``threshold`` misses
few of them, so that some run of its shingles, of a length known from the item sizes, is in the
benchmark. Looking up every r-th shingle of a document, r being the shortest such run, therefore
finds every place where a window can lie. This screen only says which windows to fingerprint.

A document with fewer shingles than the item, ``n`` of ``m``, is one window as a whole, of
similarity common / (m + n - common), which needs threshold * m shingles at least. Such a window is
compared with the items that the screen found in it directly, without fingerprints.

Each different window gets a 64-bit SimHash. The bits are cut into ``radius`` + 1 blocks; two
fingerprints within the radius agree in at least one block, so joining windows and items of one size
on a block finds all items within the radius. The exact similarity decides.
"""

from pyspark.sql import functions as F

from tidemark.llm.shared import stored

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19

_WORDS = r"split(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+')"


def words(column):
    """Lower-cased words of a text; none for null."""
    return F.expr(f"coalesce(array_remove({_WORDS.format(column)}, ''), array())")


def _shingles(column, size, step=1):
    """Hashes of every ``step``-th run of ``size`` words."""
    last = f"size({column}) - {size - 1}"
    each = f"transform(sequence(1, {last}, {step}), i -> xxhash64(slice({column}, i, {size})))"
    return F.expr(f"IF({last} >= 1, {each}, CAST(array() AS array<bigint>))")


def _fingerprint(column):
    """SimHash: each bit is the majority of that bit over all shingles."""
    ones = f"aggregate({column}, 0, (a, h) -> a + CAST(shiftright(h, b) & 1L AS INT))"
    bit = f"IF(2 * {ones} > size({column}), shiftleft(1L, b), 0L)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | {bit})")


def _blocks(fingerprint, radius):
    """Number and value of each of the ``radius`` + 1 blocks."""
    n = radius + 1
    parts = []
    for block in range(n):
        low, high = 64 * block // n, 64 * (block + 1) // n
        mask = (1 << (high - low)) - 1
        value = f"shiftrightunsigned({fingerprint}, {low}) & {mask}L"
        parts.append(f"named_struct('block', {block}, 'value', {value})")
    return F.explode(F.expr(f"array({', '.join(parts)})")).alias("block")


def _common(a, b):
    """Common weight of two lists of shingles."""
    times = lambda column: f"size(filter({column}, y -> y = x))"
    return F.expr(
        f"aggregate(array_distinct({a}), 0, (total, x) -> total + least({times(a)}, {times(b)}))"
    )


def _missing(m, threshold, n=None):
    """How many of a window's ``n`` shingles (``m`` if not given) the item's ``m`` may lack.

    From common / (m + n - common) >= threshold; below 0 if no such window reaches the threshold.
    """
    n = m if n is None else n
    return F.floor((n - threshold * m) / (1 + threshold) + 1e-9).cast("int")


def _whole_step(m, threshold):
    """The largest step at which a whole shorter document that reaches ``threshold`` has a hit.

    Its first shingle is always looked up, so of n shingles ceil(n / step) are, more than may be missing.
    """
    shorter = F.sequence(F.greatest(F.floor(threshold * m), F.lit(1)).cast("int"), m)
    return F.array_min(F.transform(shorter, lambda n: F.when(
        _missing(m, threshold, n) > 0, F.floor((n - 1) / _missing(m, threshold, n))
    )))


def matches(
    docs, benchmark, threshold=THRESHOLD, radius=RADIUS, id_column="doc_id", text_column="text",
    item_column="item_id", item_text="text",
):
    """One row for each document and item that a window of the document resembles.

    Returns the document's id and item's id under their own names, ``start`` (the window's first
    word, from 0), ``n_words`` and ``similarity`` of the best, then earliest, window. A-Z are
    lower-cased. A document shorter than the item is one window of all its words. Items with fewer
    words than a shingle are one shingle of all their words. Null or
    empty texts and items match nothing; rows without an id are matched and return a null id;
    repeated documents and items give one row for each pair of ids.
    """
    items = benchmark.select(F.col(item_column).alias("item"), words(f"`{item_text}`").alias("w"))
    items = items.where("size(w) > 0").withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    rows = docs.select(
        F.col(id_column).alias("doc"),
        F.col(text_column).alias("text"),
        F.xxhash64(id_column, text_column).alias("key"),
    ).where("text IS NOT NULL")
    found = None
    for size in sorted(r.size for r in items.select("size").distinct().collect()):  # five at most
        part = items.where(F.col("size") == size).select("item", _shingles("w", size).alias("s"))
        part = part.withColumns({"m": F.size("s"), "k": _missing(F.size("s"), threshold)})
        pairs = _matches(rows, stored(part, "items"), size, threshold, radius)
        found = pairs if found is None else found.union(pairs)
    if found is None:
        empty = "CAST(null AS bigint) AS item, 0 AS start, 0 AS n_words, CAST(0 AS double) AS similarity"
        found = rows.selectExpr("doc", *empty.split(", ")).where("false")
    best = found.groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("at"), "n_words")).alias("best")
    )
    return best.select(
        F.col("doc").alias(id_column), F.col("item").alias(item_column),
        (-F.col("best.at")).alias("start"), F.col("best.n_words").alias("n_words"),
        F.col("best.similarity").alias("similarity"),
    )


def _matches(rows, items, size, threshold, radius):
    # Stored, so that Spark knows their size when it chooses how to join them.
    known = stored(items.select("item", "m", "k", F.explode(F.array_distinct("s")).alias("h")), "known")
    facts = items.agg(
        F.min(
            F.least(F.ceil((F.col("m") - F.col("k")) / (F.col("k") + 1)), _whole_step(F.col("m"), threshold))
        ).alias("step"),
    ).first()
    step = facts.step

    # Every step-th shingle of every document, looked up in the benchmark.
    hits = rows.select("key", words("text").alias("w")).withColumn("n", F.size("w") - (size - 1))
    hits = hits.select("key", "n", F.posexplode(_shingles("w", size, step)).alias("at", "h"))
    hits = hits.join(known, "h").groupBy("key", "n", "item", "m", "k").agg(
        F.sort_array(F.collect_set(F.col("at") * step)).alias("hits")
    )
    whole = F.col("n") < F.col("m")
    hits = hits.withColumn("k", F.when(whole, _missing(F.col("m"), threshold, F.col("n"))).otherwise(F.col("k")))
    looked_up = F.when(whole, F.ceil(F.col("n") / step)).otherwise(F.floor(F.col("m") / step))
    least = F.greatest(looked_up - F.col("k"), F.lit(1)).cast("int")
    hits = stored(hits.withColumn("least", least).where("k >= 0 AND size(hits) >= least"), "hits")

    # Windows of the item's size that hold enough of its hits, or the whole of a shorter document.
    starts = """IF(n < m, array(0), filter(
        array_distinct(flatten(transform(hits,
            q -> IF(least(q, n - m) >= greatest(q - m + 1, 0),
                    sequence(greatest(q - m + 1, 0), least(q, n - m)), CAST(array() AS array<int>))))),
        p -> size(filter(hits, q -> q >= p AND q < p + m)) >= least))"""
    windows = (
        rows.join(hits, "key")
        .select("doc", "item", "n", "m", "least", "hits", words("text").alias("w"))
        .select("doc", "item", "n", "m", "least", "hits", _shingles("w", size).alias("s"))
    )
    windows = windows.select("doc", "item", "n", "m", "s", F.explode(F.expr(starts)).alias("start"))
    windows = windows.select(
        "doc", "item", "m", "start", whole.alias("whole"), F.expr("slice(s, start + 1, m)").alias("s")
    )
    windows = stored(
        windows.withColumns(
            {"w1": F.xxhash64("s"), "w2": F.xxhash64("s", F.lit(1))}
        ).distinct(),
        "windows",
    )

    # Fingerprints of different windows, and of items. A window meets the items whose shingles the
    # screen found in it, so the join is as large as the screen's finds; in it a block must agree.
    different = windows.groupBy("w1", "w2", "m", "whole").agg(F.first("s").alias("s"))
    print_ = F.when(~F.col("whole"), _fingerprint("s"))
    different = stored(different.withColumn("f", print_), "fingerprints")
    prints = items.select("item", "m", "s", _fingerprint("s").alias("f"))
    met = windows.select("w1", "w2", "m", "item", "whole").distinct()
    pairs = met.where("NOT whole").join(different.where("NOT whole"), ["w1", "w2", "m"])
    near = pairs.select("w1", "w2", "m", "item", "f", _blocks("f", radius)).join(
        prints.select("item", "m", F.col("f").alias("g"), _blocks("f", radius)),
        ["item", "m", "block"],
    )
    near = near.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    near = near.select("w1", "w2", "m", "item")
    near = near.union(met.where("whole").select("w1", "w2", "m", "item")).distinct()
    near = near.join(different.drop("f", "whole"), ["w1", "w2", "m"]).join(
        items.select("item", "m", F.col("s").alias("t")), ["item", "m"]
    )
    near = near.withColumn("c", _common("s", "t"))
    near = near.withColumn("n", F.size("s"))
    near = near.withColumn("similarity", F.col("c") / (F.col("m") + F.col("n") - F.col("c")))
    near = near.where(F.col("similarity") >= threshold).select("w1", "w2", "m", "n", "item", "similarity")
    return windows.join(near, ["w1", "w2", "m", "item"]).select(
        "doc", "item", "start", (F.col("n") + size - 1).alias("n_words"), "similarity"
    )
