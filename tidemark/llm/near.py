"""N-gram Jaccard join with signature trees, and the classes that its links form.

A document's set is its distinct shingles. Documents of equal sets are one class, and only classes
are compared. Links are found in three steps; each is exact.

1. Every set sends the least fifth of its shingles (in an order that puts very frequent ones last),
   and all whose hash lies in the lowest fifth of the range, to be grouped by shingle. Two sets that
   are similar enough share at least one of the first kind. Of the second kind, the smaller set may
   miss a ninth of its size, as it lacks no more in all; a set that shares less with all others
   together is the smaller side of no link, and most sets are.
2. In every group, each class is compared with the group's least class. This ties together large
   groups of near copies with a number of comparisons that is linear in their size.
3. Of the shingles that a possible smaller side shares with other components, it must have so many
   in common with a link that it may leave out all but a few: it asks only in the smallest groups
   of them. As frequent shingles grow with the table, their groups are hardly ever asked.
   Groups that are asked and have the same least class are one cell: near copies share many
   shingles, and their groups differ a little, but nearly all have the same least class, so a pair
   meets in few cells. Cells that hold several components are searched by a signature tree: leaves
   are classes with a bitmap of their shingles, nodes hold the OR of the bitmaps below and the range
   of sizes. Both sides of a pair of nodes are opened only if one of them asks and the largest
   possible overlap suffices; pairs of nodes that lie in one component are closed. Cells are cut by
   size, and large ones dealt in parts. The search runs twice: first a class is compared only with
   the one that may have the most in common with it, then with all that are still in other
   components.

Candidates of steps 2 and 3 pass the bitmap bound and then the exact test on whole texts. As pairs
within a component are closed, the links that are found are not all links, but join all classes
that any links join: the result is components.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.linestats import in_row
from tidemark.llm.shared import Steps, in_arrow, stored, text_batches
from tidemark.llm.words import Words, mix, signed, slices

SIZE = 5
PERCENT = 80
#: Bounded sample that only orders shingles: documents read, and from how many of them on a
#: shingle counts as very frequent. The order never changes a result.
SAMPLE_DOCUMENTS, FREQUENT_IN, FREQUENT_SHINGLES = 4000, 12, 50_000
FANOUT, LEAF_ROWS, CELL_ROWS = 8, 64, 4096
#: Pairs that a task gathers before it hands them on.
PAIRS_AT_ONCE = 100_000
#: Hashes below this share of the range are sent by every set.
LOWEST = np.uint64((1 << 64) // 5)


def shingles(words, size=SIZE):
    """Distinct shingles of all rows as (row, hash), in no order."""
    hashes, at = words.windows(size)
    row = words.row_of(at)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    hashes = np.concatenate([hashes, words.whole()[short]])
    row = np.concatenate([row, short])
    _, first = np.unique(in_row(hashes, row), return_index=True)
    return row[first], hashes[first]


def enough(both, a, b):
    """Whether ``both`` common shingles make sets of ``a`` and ``b`` similar enough."""
    return (100 + PERCENT) * both >= PERCENT * (a + b)


def prefix_size(n):
    return n + (-(PERCENT * n) // 100) + 1


def least_shared(low, n):
    """Of ``low`` shingles of a set of ``n``, how many a similar set that is no smaller has (columns)."""
    return low - F.floor(n * (100 - PERCENT) / (100 + PERCENT) + 1e-9)


# --- bitmaps -------------------------------------------------------------------------


def width(n):
    """Bits of a set's bitmap: at least four for each shingle, a power of two."""
    return max(64, 1 << int(4 * n - 1).bit_length())


def bitmap(hashes, bits):
    out = np.zeros(bits // 64, np.uint64)
    at = hashes & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def fold(bits, size):
    """The bitmap at a smaller width."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def count(bits):
    return int(np.bitwise_count(bits).sum())


def may_link(a, bits_a, b, bits_b):
    """Whether the bitmaps leave room for enough common shingles."""
    if not enough(min(a, b), a, b):
        return False
    size = min(len(bits_a), len(bits_b))
    x, y = fold(bits_a, size), fold(bits_b, size)
    both = count(x & y)
    # A bit that only one side has stands for at least one shingle that the other lacks.
    return enough(min(a - (count(x) - both), b - (count(y) - both)), a, b)


# --- signature tree ------------------------------------------------------------------


class Leaf:
    """Classes of similar size, compared with those of another leaf in one numpy operation."""

    items = None

    def __init__(self, places, sizes, bits, components, sides, shared, needed, asks):
        self.places, self.sizes, self.components, self.sides = places, sizes, components, sides
        self.shared, self.needed, self.asking, self.asks = shared, needed, asks, bool(asks.any())
        words = min(len(x) for x in bits)
        self.matrix = np.stack([fold(x, words) for x in bits])
        self.bits = np.bitwise_or.reduce(self.matrix, axis=0)
        self.low, self.high = int(sizes.min()), int(sizes.max())
        self.fewest = int(np.bitwise_count(self.matrix).sum(axis=1).min())
        self.component = components[0] if (components == components[0]).all() else None

    def at(self, words):
        if self.matrix.shape[1] == words:
            return self.matrix
        return np.bitwise_or.reduce(self.matrix.reshape(len(self.places), -1, words), axis=1)


class Node:
    """OR of the bitmaps below, range of sizes, least number of set bits, component if only one, whether any asks."""

    def __init__(self, items):
        words = min(len(x.bits) for x in items)
        self.bits = np.bitwise_or.reduce([fold(x.bits, words) for x in items])
        self.low, self.high = min(x.low for x in items), max(x.high for x in items)
        # Counted at one width only; folding loses set bits.
        same = all(len(x.bits) == words for x in items)
        self.fewest = min(x.fewest for x in items) if same else 0
        found = {x.component for x in items}
        self.component = found.pop() if len(found) == 1 else None
        self.asks = any(x.asks for x in items)
        self.items = items


def tree(sizes, bits, components, sides, shared, needed, asks):
    """Nodes over leaves of classes in the order of their sizes.

    Classes that ask come first, and among them and the others the largest component.
    """
    common, held = np.unique(components, return_counts=True)
    order = np.lexsort((sizes, components != common[held.argmax()], ~asks))
    level = []
    for lo in range(0, len(order), LEAF_ROWS):
        at = order[lo : lo + LEAF_ROWS]
        columns = (x[at] for x in (components, sides, shared, needed, asks))
        level.append(Leaf(at, sizes[at], [bits[i] for i in at], *columns))
    while len(level) > 1:
        level = [Node(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def _possible(a, b):
    """Whether some pair below two nodes can be similar enough, with a smaller side that asks."""
    if not (a.asks or b.asks):
        return False
    if a.component is not None and a.component == b.component:
        return False
    low, high = (a, b) if a.low <= b.low else (b, a)
    if not enough(min(low.high, high.low), min(low.high, high.low), high.low):
        return False
    words = min(len(a.bits), len(b.bits))
    both = count(fold(a.bits, words) & fold(b.bits, words))
    most = min(a.high, b.high)
    for x in (a, b):
        if len(x.bits) == words:
            most = min(most, x.high - max(0, x.fewest - both))
    return enough(most, a.low, b.low)


def _compared(a, b):
    """Pairs of classes of two leaves whose bitmaps and counts leave room for a link."""
    words = min(a.matrix.shape[1], b.matrix.shape[1])
    x, y = a.at(words), b.at(words)
    # One row against all of the other leaf at a time bounds the memory by the bitmaps themselves.
    both = np.stack([np.bitwise_count(row & y).sum(axis=1, dtype=np.int64) for row in x])
    n, m = a.sizes[:, None], b.sizes[None, :]
    lacking = np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None] - both
    other = np.bitwise_count(y).sum(axis=1, dtype=np.int64)[None, :] - both
    good = enough(np.minimum(n - lacking, m - other), n, m)
    p, q = a.needed[:, None], b.needed[None, :]
    needed = np.where(n < m, p, np.where(m < n, q, np.minimum(p, q)))
    good &= np.minimum(a.shared[:, None], b.shared[None, :]) >= needed
    good &= a.components[:, None] != b.components[None, :]
    good &= (a.sides[:, None] != b.sides[None, :]) | (a.sides[:, None] < 0)
    p, q = a.asking[:, None], b.asking[None, :]
    good &= np.where(n < m, p, np.where(m < n, q, p | q))
    if a is b:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    share = np.minimum(n - lacking, m - other)[i, j] / np.maximum(n, m)[i, j]
    return a.places[i], b.places[j], share


def pairs(root):
    """Pairs of classes of different components that may be similar enough, by dual traversal.

    For each pair of leaves that holds any: two arrays of their places, and the greatest share of the
    larger set that they can have in common.
    """
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if a.items is None and b.items is None:
            found = _compared(a, b)
            if len(found[0]):
                yield found
        elif a is b:
            stack.extend(
                (x, y)
                for i, x in enumerate(a.items)
                for y in a.items[i:]
                if (x is y and x.component is None and x.asks) or (x is not y and _possible(x, y))
            )
        elif b.items is None or (a.items is not None and a.high >= b.high):
            stack.extend((x, b) for x in a.items if _possible(x, b))
        else:
            stack.extend((a, y) for y in b.items if _possible(a, y))


# --- steps over frames ---------------------------------------------------------------


def _keys(row, hashes, rows):
    """Two hashes of each row's set."""
    key, again = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(key, row, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    np.add.at(again, row, mix(hashes + np.uint64(0x14057B7EF767814F)))
    return key, again


def _profiles(batch):
    columns = {"key": [], "again": [], "n": [], "low": []}
    for part in slices(batch):
        words = Words(part.column("text"), lower=True)
        row, hashes = shingles(words)
        n = np.bincount(row, minlength=part.num_rows)
        key, again = _keys(row, hashes, len(n))
        columns["key"].append(signed(key))
        columns["again"].append(signed(again))
        columns["n"].append(n)
        columns["low"].append(np.bincount(row[hashes < LOWEST], minlength=part.num_rows))
    joined = {k: np.concatenate(v) for k, v in columns.items()}
    return {"doc": batch.column("doc"), "hash": batch.column("hash"), **joined}


def _bitmaps(batch):
    """Bitmaps of texts, each of which has a shingle."""
    bits = []
    for part in slices(batch):
        row, hashes = shingles(Words(part.column("text"), lower=True))
        hashes = hashes[np.argsort(row, kind="stable")]
        edge = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
        bits += [bitmap(hashes[a:b], width(b - a)).tobytes() for a, b in zip(edge, edge[1:])]
    return {"key": batch.column("key"), "n": batch.column("n"), "text": batch.column("text"), "bits": pa.array(bits, pa.binary())}


def _prefixes(frequent, clashes):
    schema = pa.schema(
        [("deal", pa.int64()), ("shingle", pa.int64()), ("key", pa.int64()), ("hot", pa.bool_()),
         ("low", pa.bool_())]
    )

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                row, hashes = shingles(words)
                n = np.bincount(row, minlength=part.num_rows)
                key, again = _keys(row, hashes, len(n))
                key = np.where(np.isin(key, clashes), again, key)
                fresh = [k not in seen and not seen.add(k) for k in key.tolist()]
                wanted = (np.array(fresh, bool) & (n > 0))[row]
                row, hashes = row[wanted], hashes[wanted]
                hot = np.isin(hashes, frequent)
                order = np.lexsort((hashes, hot, row))
                row, hashes, hot = row[order], hashes[order], hot[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                low = hashes < LOWEST
                first = (rank < prefix_size(n)[row]) | low
                low = low[first]
                row, hashes, hot = row[first], hashes[first], hot[first]
                deal = np.where(hot, mix(hashes ^ mix(key[row])), hashes)
                yield pa.RecordBatch.from_arrays(
                    [signed(deal), signed(hashes), signed(key)[row], pa.array(hot), pa.array(low)],
                    schema=schema,
                )

    return run


def _sets(batches):
    schema = pa.schema([("shingle", pa.int64())])
    for batch in batches:
        for part in slices(batch):
            _, hashes = shingles(Words(part.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([signed(hashes)], schema=schema)


def _frequent(rows):
    """The most frequent shingles of a bounded sample of texts, counted by the executors."""
    sample = rows.select("doc", "hash").orderBy(F.xxhash64("doc", "hash")).limit(SAMPLE_DOCUMENTS)
    # At most SAMPLE_DOCUMENTS rows.
    texts = rows.join(F.broadcast(sample.distinct()), ["doc", "hash"]).select("text")
    counts = texts.mapInArrow(_sets, "shingle long").groupBy("shingle").count()
    found = counts.where(F.col("count") >= FREQUENT_IN).orderBy(F.desc("count"), "shingle")
    found = found.limit(FREQUENT_SHINGLES).select("shingle").toArrow()["shingle"].to_numpy()
    return np.ascontiguousarray(found).view(np.uint64)


def _bounded(batch):
    """Pairs whose bitmaps leave room for enough common shingles."""
    n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
    bits_a, bits_b = batch.column("bits_a"), batch.column("bits_b")
    keep = [
        may_link(a, np.frombuffer(x.as_py(), np.uint64), b, np.frombuffer(y.as_py(), np.uint64))
        for a, x, b, y in zip(n_a, bits_a, n_b, bits_b, strict=True)
    ]
    kept = batch.filter(pa.array(keep, pa.bool_()))
    return {"a": kept.column("a"), "b": kept.column("b")}


_MEMBERS = ("key", "n", "bits", "component", "side", "shared", "needed", "asks")


def _cells(best):
    """Candidate pairs of every cell; the rows of a cell follow each other.

    ``best`` keeps for each class only the one that may have the most in common with it.
    """

    def search(rows):
        keys, n, bits, *rest = zip(*rows, strict=True)
        keys, bits = np.array(keys), [np.frombuffer(x, np.uint64) for x in bits]
        found = pairs(tree(np.array(n), bits, *map(np.array, rest)))
        if not best:
            for i, j, _ in found:
                yield keys[i], keys[j]
            return
        top, with_ = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for i, j, share in found:
            for x, y in ((i, j), (j, i)):
                better = np.flatnonzero(share > top[x])
                better = better[np.argsort(share[better], kind="stable")]
                top[x[better]], with_[x[better]] = share[better], y[better]
        x = np.flatnonzero(top)
        if len(x):
            yield keys[x], keys[with_[x]]

    def cells(batches):
        cell, rows = None, []
        for batch in batches:
            data = [batch.column(c).to_pylist() for c in ("pivot", "level", "i", "j", *_MEMBERS)]
            for values in zip(*data, strict=True):
                if values[:4] != cell:
                    yield rows
                    cell, rows = values[:4], []
                rows.append(values[4:])
        yield rows

    def run(batches):
        held, size = [], 0
        for rows in cells(batches):
            for a, b in search(rows) if len(rows) > 1 else ():
                held.append((np.minimum(a, b), np.maximum(a, b)))
                size += len(a)
                if size >= PAIRS_AT_ONCE:
                    yield _pair_batch(held)
                    held, size = [], 0
        yield _pair_batch(held)

    return run


def _pair_batch(held):
    none = [(np.zeros(0, np.int64),) * 2]
    a, b = (np.concatenate(x) for x in zip(*(held or none), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _verified(batch):
    a, b = [], []
    for part in slices(batch, "text_a"):
        sets = [shingles(Words(part.column(c), lower=True)) for c in ("text_a", "text_b")]
        sizes = [np.bincount(row, minlength=part.num_rows) for row, _ in sets]
        keys = [in_row(hashes, row) for row, hashes in sets]
        _, at, _ = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        both = np.bincount(sets[0][0][at], minlength=part.num_rows)
        good = enough(both, *sizes)
        a.append(part.column("a").to_numpy()[good])
        b.append(part.column("b").to_numpy()[good])
    return {"a": np.concatenate(a), "b": np.concatenate(b)}


def _links(steps, candidates, texts):
    """The candidate pairs whose texts are similar enough."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = candidates.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return steps.store(both.mapInArrow(in_arrow(_verified), "a long, b long"), "links")


def _level(n):
    """Size class of a set; similar sets lie in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / PERCENT + 1e-9))).cast("int")


def _met(rows):
    """Rows in cells of a least class and a size class: those of the size class and of the next one."""
    own = rows.withColumn("asks", F.col("shared") >= F.col("needed"))
    above = rows.withColumn("level", F.col("level") - 1).withColumn("asks", F.lit(False))
    return own.union(above)


def _held(steps, cells):
    """Rows of cells with several components and a possible smaller side that asks.

    Of those with the same rows one stays, and in it only rows that share as much as the least
    demanding needs.
    """
    sizes = cells.groupBy("pivot", "level").agg(
        F.count("*").alias("rows"), F.count_if("asks").alias("asking"),
        F.min(F.when(F.col("asks"), F.col("needed"))).alias("least"),
        F.min("component").alias("one"), F.max("component").alias("other"),
        *[F.bit_xor(F.xxhash64("key", "asks", F.lit(i))).alias(f"set{i}") for i in (0, 1)],
    )
    sizes = sizes.where("least IS NOT NULL AND one < other")
    # Of cells with the same members one finds all pairs.
    sizes = sizes.groupBy("level", "rows", "asking", "least", "set0", "set1").agg(
        F.min("pivot").alias("pivot")
    ).drop("set0", "set1")
    return cells.join(steps.store(sizes, "cells"), ["pivot", "level"]).where("shared >= least")


def _asked(rows):
    """The groups in which each possible smaller side asks: ``shingle``, ``level``, ``key``, ``pivot``.

    Of the shingles that a set shares with other components, all but ``needed - 1`` are enough to meet
    each link, so it asks in that many of the smallest groups. A set that may share no low shingle
    with a link asks in all groups.
    """
    groups = rows.groupBy("shingle", "level").agg(
        F.count("*").alias("rows"), F.max("possible").alias("possible"),
        F.min("component").alias("one"), F.max("component").alias("other"),
    )
    # A set meets those of its size class and of the next one.
    at = F.array(
        F.struct("level", "possible"),
        F.struct((F.col("level") - 1).alias("level"), F.lit(False).alias("possible")),
    )
    groups = groups.select("shingle", "rows", "one", "other", F.explode(at).alias("at"))
    groups = groups.groupBy("shingle", F.col("at.level").alias("level")).agg(
        F.sum("rows").alias("rows"), F.max("at.possible").alias("possible"),
        F.min("one").alias("one"), F.max("other").alias("other"),
    )
    groups = groups.where("possible AND one < other").select("shingle", "level", "rows")
    found = rows.where("possible AND (low OR needed <= 0)").join(groups, ["shingle", "level"])
    of_set = Window.partitionBy("key")
    found = found.withColumns({
        "held": F.sum(F.col("low").cast("long")).over(of_set),
        "place": F.row_number().over(of_set.orderBy("rows", "shingle")),
    })
    found = found.where("held >= needed AND (needed <= 0 OR place <= held - needed + 1)")
    return found.select("shingle", "level", "key", "pivot")


def _cell_rows(steps, shared, sized):
    """Rows of the cells of groups that are asked, and which of them ask."""
    own = sized.select("key", "level", "needed", "component", (F.col("shared") >= F.col("needed")).alias("possible"))
    rows = steps.store(shared.join(own, "key"), "sized")
    asked = steps.store(_asked(rows), "asked")
    groups = asked.select("shingle", "level").distinct()
    levels = F.explode(F.array("level", F.col("level") - 1)).alias("level")
    met = rows.join(groups.select("shingle").distinct(), "shingle", "left_semi")
    met = met.select("shingle", "pivot", "key", levels).join(groups, ["shingle", "level"], "left_semi")
    cells = met.select("pivot", "level", "key", F.lit(False).alias("asks"))
    cells = cells.union(asked.select("pivot", "level", "key", F.lit(True)))
    cells = cells.groupBy("pivot", "level", "key").agg(F.max("asks").alias("asks"))
    found = steps.store(
        cells.join(sized.select("key", "n", "component", "shared", "needed"), "key"), "members"
    )
    steps.drop(rows, asked)
    return found


def _dealt(steps, cells):
    """The rows of all cells that may hold a link.

    A cell of more than ``CELL_ROWS`` rows is dealt into parts by key, those that ask by themselves,
    and every part of these has a cell with every part of all rows.
    """
    cells = _held(steps, cells)
    parts = [F.ceil(F.col(c) / CELL_ROWS).cast("int") for c in ("asking", "rows")]
    part = [F.pmod(F.xxhash64("key"), p).cast("int") for p in parts]

    def place(i, j, side, asks):
        return F.struct(
            i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"), asks.alias("asks")
        )

    whole = F.array(place(F.lit(0), F.lit(0), -1, F.col("asks")))
    member = F.transform(F.sequence(F.lit(0), parts[0] - 1), lambda i: place(i, part[1], 1, F.lit(False)))
    asking = F.transform(F.sequence(F.lit(0), parts[1] - 1), lambda j: place(part[0], j, 0, F.lit(True)))
    places = F.when(F.col("rows") <= CELL_ROWS, whole).when(F.col("asks"), F.concat(member, asking)).otherwise(member)
    return cells.select(
        "pivot", "level", "key", "n", "component", "shared", "needed", F.inline(places)
    )


def _shared(steps, rows, clashes):
    """Sent shingles that several classes have: ``shingle``, ``key``, ``low`` and the least key."""
    frequent = _frequent(rows)
    prefix = rows.mapInArrow(_prefixes(frequent, clashes), "deal long, shingle long, key long, hot boolean, low boolean")
    # One dealing serves the count and the join, so both read all columns of it. Very frequent shingles are known to be shared:
    # their rows are dealt by shingle and key, so that none fills a partition.
    dealt = prefix.repartition("deal")
    least = dealt.groupBy("deal").agg(
        F.min("key").alias("pivot"), F.max("key").alias("high"), F.max("hot").alias("any"),
        F.min(F.struct("shingle", "low")).alias("_same"),
    )
    least = least.where("(pivot < high OR any) AND _same IS NOT NULL").select("deal", "pivot")
    found = dealt.join(least, "deal").select("shingle", "key", "pivot", "hot", "low").distinct()
    found = steps.store(found, "shared")
    if not len(frequent):
        return found.drop("hot")
    hot = found.where("hot").select("shingle", "key", "low")
    # At most FREQUENT_SHINGLES rows.
    pivots = F.broadcast(hot.groupBy("shingle").agg(F.min("key").alias("pivot")))
    cold = found.where("NOT hot").select("shingle", "key", "low", "pivot")
    return cold.union(hot.join(pivots, "shingle").select("shingle", "key", "low", "pivot"))


def _joined_bits(pairs, texts):
    for side in ("a", "b"):
        names = [F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")]
        pairs = pairs.join(texts.select(*names), side)
    return pairs


def links(rows, sets, clashes=()):
    """Links ``a``, ``b`` between classes that join all classes that any links join."""
    steps = Steps()
    shared = _shared(steps, rows, np.array(clashes, np.int64).view(np.uint64))
    counts = shared.groupBy("key").agg(F.count_if("low").alias("shared"))
    needed = least_shared(F.col("low"), F.col("n"))
    facts = steps.store(
        counts.join(sets.select("key", "n", "low"), "key").select(
            "key", "n", "shared", needed.cast("long").alias("needed")
        ),
        "facts",
    )
    # A class meets the others of its groups' least classes, its own included.
    met = steps.store(shared.select("pivot", "key").distinct(), "met")

    sized = facts.withColumn("level", _level(F.col("n")))
    alone = met.select("pivot", "key", F.col("key").alias("component")).join(sized, "key")
    # Only texts of sets that may have a link with another set of their cells, one of each class.
    wanted = _held(steps, _met(alone)).select("key").distinct().join(sets.select("key", "n", "first"), "key")
    wanted = wanted.select("key", "n", F.col("first.doc").alias("doc"), F.col("first.hash").alias("hash"))
    texts = rows.join(wanted, ["doc", "hash"]).groupBy("key", "n").agg(F.first("text").alias("text"))
    texts = texts.mapInArrow(in_arrow(_bitmaps), "key long, n long, text string, bits binary")
    texts = steps.store(texts, "texts")

    candidates = met.where("pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    for side in ("a", "b"):
        named = facts.select(
            F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "shared", "needed")]
        )
        candidates = candidates.join(named, side)
    # The smaller side shares enough, and so does the other with it.
    needs = F.when(F.col("n_a") <= F.col("n_b"), F.col("needed_a")).otherwise(F.col("needed_b"))
    possible = F.least("shared_a", "shared_b") >= F.when(
        F.col("n_a") == F.col("n_b"), F.least("needed_a", "needed_b")
    ).otherwise(needs)
    near_sizes = enough(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"))
    candidates = candidates.where(possible & near_sizes).select("a", "b")
    candidates = _joined_bits(candidates, texts)
    candidates = steps.store(candidates.mapInArrow(in_arrow(_bounded), "a long, b long"), "candidates")
    first = _links(steps, candidates, texts)

    # First each class meets the one most like it in another component, which ties nearly all that
    # have a link; then all pairs that are left.
    found = [first]
    for best in (True, False):
        found.append(_searched(steps, reduce(DataFrame.union, found), shared, sized, texts, best))
    found = stored(reduce(DataFrame.union, found), "links")
    steps.close()
    return found


def _searched(steps, known, shared, sized, texts, best):
    """Links between the components of the known links, by signature trees over the cells."""
    tied = components(known).withColumnRenamed("node", "key")
    open_ = sized.join(tied, "key", "left").withColumn("component", F.coalesce("root", "key")).drop("root")
    open_ = steps.store(open_, "open")
    members = _cell_rows(steps, shared, open_)
    cells = _dealt(steps, members).join(texts.select("key", "bits"), "key")
    cell = ["pivot", "level", "i", "j"]
    cells = cells.repartition(*cell).sortWithinPartitions(*cell)
    pairs_ = steps.store(cells.mapInArrow(_cells(best), "a long, b long").distinct(), "candidates")
    steps.drop(open_, members)
    return _links(steps, pairs_, texts)


def _members(rows):
    """Set and class of every row, and the least id of each class's component."""
    profile = stored(
        rows.mapInArrow(in_arrow(_profiles), "doc long, hash long, key long, again long, n long, low long"),
        "profiles",
    )
    sets = profile.where("n > 0 AND doc IS NOT NULL").groupBy("key", "again", "n").agg(
        F.min(F.struct("doc", "hash")).alias("first"), F.first("low").alias("low")
    )
    sets = stored(sets, "sets")
    # Different sets with one key, about three for 10**10 sets, take their other hash as key.
    clashes = [r["key"] for r in sets.groupBy("key").count().where("count > 1").select("key").collect()]
    own = F.when(F.col("key").isin(clashes), F.col("again")).otherwise(F.col("key")) if clashes else F.col("key")
    profile, sets = profile.withColumn("key", own).drop("again"), sets.withColumn("key", own).drop("again")
    found = components(links(rows.where("doc IS NOT NULL"), sets, clashes)).withColumnRenamed("node", "key")
    roots = sets.join(found, "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), F.col("first.doc").alias("doc")
    )
    least = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    component = stored(roots.join(least, "root").select("key", "component_id"), "components")
    return profile, component


def classes(docs, id_column="doc_id", text_column="text"):
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id that links reach, of every row.

    Texts are compared with A-Z lower-cased. With fewer words than a shingle the whole sequence is
    the only one; null texts and texts without words have no shingles and no links. Rows without an
    id have no component. Rows that share an id are one document in the components.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc"),
        F.col(text_column).alias("text"),
        F.xxhash64(text_column).alias("hash"),
    )
    # All that passes texts through Python is stored here; the frame returned only joins.
    with text_batches(docs.sparkSession):
        profile, component = _members(rows)
    joined = profile.drop("low").join(component, "key", "left")
    own = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id"))
    return joined.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce(own, "doc").alias("component_id"),
    )
