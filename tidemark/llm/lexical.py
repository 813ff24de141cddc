"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector over the items' terms: the term's weight times a share that grows with
its occurrences and falls with the document's length, all in integers. An item is the 0/1 vector of
its terms, so a score is an inner product. Documents are indexed once, whole texts in one pass. Each
task then builds ball trees over its rows: nodes have a centroid and radii, one for each of some
groups of terms, and no vector below a node can have a greater product with an item than

    <item, centroid> + sum over groups of sqrt(the item's terms in the group) * radius.

Subtrees are opened best first and left once that bound, rounded up, is below the item's k-th score
so far, or that among a part of the rows that is searched first; leaves are scored in exact integers. Bounds only decide what is not looked at, and the
margin for their rounding is far above what 64-bit floats can lose, so results are exact.

Items are taken in blocks with a bounded number of terms, as these travel with every task.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored
from tidemark.llm.words import Words, column_bytes, signed, slices

#: Terms of all items of one block; a single longer item is a block of its own.
BLOCK_TERMS = 20_000
LEAF_ROWS, TREE_ROWS, TREE_POSTINGS, GROUP_TERMS = 16, 1024, 1_000_000, 2
#: One of so many rows is searched first, for scores that an item's results reach at least.
FIRST = 16
#: Share by which radii and bounds are rounded up; products of 10**7 terms lose less than 1e-8.
SLACK = 1e-7
#: Partial rankings of an item are merged in so many tasks before the last one.
MERGES = 64

# Bytes of terms: ASCII letters and digits, and everything beyond ASCII; A-Z lower-cased.
_TERM = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _TERM[_b] = _b + 32 if 65 <= _b < 91 else _b


class Terms(Words):
    """The terms of a text column, as words of the text with all other characters blanked."""

    def __init__(self, column):
        data, offsets = column_bytes(column)
        blanked = pa.LargeStringArray.from_buffers(
            len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_TERM[data])
        )
        super().__init__(blanked)


def item_terms(items):
    """Distinct ``item``, ``h0``, ``h1`` (two hashes of a term) of the items' texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                terms = Terms(part.column("text"))
                item = part.column("item").take(pa.array(terms.row_of(np.arange(len(terms.starts)))))
                hashes = [signed(terms.hashes(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([item, *map(pa.array, hashes)], ["item", "h0", "h1"])

    return items.mapInArrow(run, "item long, h0 long, h1 long").distinct()


class Vocabulary:
    """The terms of a block of items, numbered in the order of their hashes."""

    def __init__(self, items, h0, h1):
        pairs, place = np.unique(np.stack([h0, h1], axis=1).view(np.uint64), axis=0, return_inverse=True)
        place = place.ravel()
        self.h0, self.h1 = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        if len(np.unique(self.h0)) < len(self.h0):
            raise ValueError("two terms of the items have one hash")
        order = np.lexsort((place, items))
        self.items, first = np.unique(items[order], return_index=True)
        self.terms = np.split(place[order], first[1:])

    def __len__(self):
        return len(self.h0)

    def postings(self, part):
        """Row, term and occurrences of the vocabulary's terms, and the number of terms of each row."""
        terms = Terms(part.column("text"))
        hashes = terms.hashes(0)
        at = np.minimum(np.searchsorted(self.h0, hashes), len(self) - 1)
        hit = np.flatnonzero(self.h0[at] == hashes)
        hit = hit[self.h1[at[hit]] == terms.hashes(1)[hit]]
        keys, tf = np.unique(terms.row_of(hit) * len(self) + at[hit], return_counts=True)
        return keys // len(self), keys % len(self), tf, terms.counts


def indexed(docs, vocabulary):
    """``doc``, ``n`` and the numbers and occurrences of the vocabulary's terms, for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, term, tf, n = vocabulary.postings(part)
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                packed = [
                    pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
                    for x in (term.astype(np.int32), tf.astype(np.int32))
                ]
                columns = [part.column("doc"), pa.array(n.astype(np.int64)), *packed]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc long, n long, terms binary, tf binary")


def document_frequencies(index, size):
    """Rows that hold each term, by one partial count per task."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            held = b"".join(batch.column("terms").drop_null().to_pylist())
            df += np.bincount(np.frombuffer(held, np.int32), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    counts = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counts.toArrow()  # at most one row for each term of the block
    df = np.zeros(size, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def weights(df, documents):
    """Integer weights of terms by the number of documents that hold them."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Vectors:
    """Sparse rows: ``terms`` and ``values`` of row i are at ``edges[i]:edges[i + 1]``."""

    def __init__(self, docs, edges, terms, values):
        self.docs, self.edges, self.terms, self.values = docs, edges, terms, values

    def __len__(self):
        return len(self.docs)

    def take(self, rows):
        sizes = np.diff(self.edges)[rows]
        edges = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=edges[1:])
        at = np.arange(edges[-1]) + np.repeat(self.edges[rows] - edges[:-1], sizes)
        return Vectors(self.docs[rows], edges, self.terms[at], self.values[at])

    def sums(self, values):
        """Sum over each row; rows are not empty."""
        return np.add.reduceat(values, self.edges[:-1])

    def dense(self, row, size):
        out = np.zeros(size)
        lo, hi = self.edges[row], self.edges[row + 1]
        out[self.terms[lo:hi]] = self.values[lo:hi]
        return out


def vectors(batch, weight, documents, occurrences):
    """The rows of an index batch that hold a term, as vectors of exact integer values."""
    kept = [i for i, x in enumerate(batch.column("terms").to_pylist()) if x]
    batch = batch.take(pa.array(kept, pa.int64()))
    terms, tf = (batch.column(c).to_pylist() for c in ("terms", "tf"))
    edges = np.zeros(len(kept) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in terms], out=edges[1:])
    terms, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (terms, tf))
    n = batch.column("n").to_numpy()
    m = 10 + (90 * n * documents) // occurrences
    share = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(edges)))
    return Vectors(batch.column("doc").to_numpy(), edges, terms, weight[terms] * share)


class BallTree:
    """Nodes over ranges of rows: centroids, radii by group of terms, children; leaves hold rows."""

    def __init__(self, rows, size):
        self.size, self.groups = size, -(-size // GROUP_TERMS)
        self.centroids, self.radii, self.children, self.leaves = [], [], [], {}
        self._add(rows)
        self.centroids, self.radii = np.array(self.centroids), np.array(self.radii)

    def _radii(self, rows, centroid, v, c):
        """The greatest distance of a row from the centroid, for each group of neighbouring terms."""
        group = rows.terms // GROUP_TERMS
        cell = np.repeat(np.arange(len(rows)), np.diff(rows.edges)) * self.groups + group
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        group = group[first]
        inner = np.add.reduceat(centroid**2, np.arange(0, self.size, GROUP_TERMS))
        # Squared distances, and the squares they are differences of, from which rounding is bounded.
        held, both = np.add.reduceat(v * v, first), np.add.reduceat(v * c, first)
        apart = held - 2 * both + inner[group] + SLACK * (held + inner[group])
        # Rows without a term of the group are at its centroid's distance from zero.
        radii = np.where(np.bincount(group, minlength=self.groups) < len(rows), inner * (1 + SLACK), 0.0)
        np.maximum.at(radii, group, apart)
        return np.sqrt(radii)

    def _add(self, rows):
        node = len(self.children)
        self.children.append(None)
        centroid = np.bincount(rows.terms, weights=rows.values, minlength=self.size) / len(rows)
        v, c = rows.values.astype(float), centroid[rows.terms]
        self.centroids.append(centroid)
        self.radii.append(self._radii(rows, centroid, v, c))
        if len(rows) <= LEAF_ROWS:
            self.leaves[node] = rows
            return node
        # Two rows far apart; every row goes to the nearer one.
        norm = rows.sums(v * v)
        far = int((norm - 2 * rows.sums(v * c)).argmax())
        one = rows.dense(far, self.size)
        other = rows.dense(int((norm - 2 * rows.sums(v * one[rows.terms])).argmax()), self.size)
        side = rows.sums(v * (one - other)[rows.terms]) - ((one**2).sum() - (other**2).sum()) / 2
        order = np.argsort(side, kind="stable")
        least = len(rows) // 8
        cut = min(max(int(np.searchsorted(side[order], 0.0)), least), len(rows) - least)
        self.children[node] = tuple(self._add(rows.take(x)) for x in (order[:cut], order[cut:]))
        return node

    def bounds(self, terms):
        """What no score below each node exceeds, for an item of these terms."""
        group, counts = np.unique(terms // GROUP_TERMS, return_counts=True)
        most = self.centroids[:, terms].sum(axis=1) + self.radii[:, group] @ np.sqrt(counts)
        return most * (1 + SLACK) + 1


class Best:
    """The best ``top`` documents of an item so far, by score and then by id; none below ``floor``."""

    def __init__(self, top, floor=1):
        self.top, self.floor = top, floor
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self):
        return max(int(self.scores[-1]), self.floor) if len(self.scores) == self.top else self.floor

    def add(self, docs, scores):
        good = scores >= self.least
        if good.any():
            docs = np.concatenate([self.docs, docs[good]])
            scores = np.concatenate([self.scores, scores[good]])
            order = np.lexsort((docs, -scores))[: self.top]
            self.docs, self.scores = docs[order], scores[order]


def search_tree(tree, terms, best):
    """Add the best documents of a tree to those of an item; returns the number of leaves scored."""
    bound = tree.bounds(terms)
    wanted = np.zeros(tree.size, np.int64)
    wanted[terms] = 1
    heap, scored = [(-bound[0], 0)], 0
    while heap:
        most, node = heapq.heappop(heap)
        if -most < best.least:
            break
        if tree.children[node] is None:
            rows = tree.leaves[node]
            best.add(rows.docs, rows.sums(rows.values * wanted[rows.terms]))
            scored += 1
        else:
            for child in tree.children[node]:
                if bound[child] >= best.least:
                    heapq.heappush(heap, (-bound[child], child))
    return scored


def _runs(rows):
    """Rows in runs of bounded rows and postings, one tree each."""
    at = 0
    while at < len(rows):
        end = int(np.searchsorted(rows.edges, rows.edges[at] + TREE_POSTINGS, side="right")) - 1
        end = min(max(end, at + 1), at + TREE_ROWS, len(rows))
        yield rows.take(np.arange(at, end))
        at = end


def _searched(vocabulary, weight, documents, occurrences, top, floors):
    def run(batches):
        found = [Best(top, floor) for floor in floors]
        for batch in batches:
            for rows in _runs(vectors(batch, weight, documents, occurrences)):
                tree = BallTree(rows, len(vocabulary))
                for best, terms in zip(found, vocabulary.terms, strict=True):
                    search_tree(tree, terms, best)
        item = np.repeat(vocabulary.items, [len(b.docs) for b in found])
        columns = [item, np.concatenate([b.docs for b in found]), np.concatenate([b.scores for b in found])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc", "score"])

    return run


def _ranked(rows, top):
    """The best rows of each item: first within parts of its rows, then among what is left."""
    order = [F.desc("score"), F.col("doc")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(MERGES)))
    for keys in (["item", "part"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.select("item", "rank", "doc", "score")


def search(docs, items, top=10, id_column="doc_id", item_column="item_id", text_column="text"):
    """``item``, ``rank`` (from 1), ``doc`` and ``score`` of each item's ``top`` documents above 0.

    Equal scores are ranked by ascending id. Null texts and texts without a term hold none: they are
    no documents, or items without results. Rows without an id count in the statistics of documents
    and are not ranked; items without an id are left out. Rows that share an id are documents on
    their own; items that share one are one item with the terms of all. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text"))
    terms = stored(item_terms(items.where("item IS NOT NULL AND text IS NOT NULL")), "item_terms")
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    blocks = -(-terms.count() // BLOCK_TERMS)
    found = []
    for block in range(blocks):
        held = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if not held.num_rows:
            continue
        vocabulary = Vocabulary(*(held[c].to_numpy() for c in ("item", "h0", "h1")))
        index = stored(indexed(rows, vocabulary), "lexical_index")
        size = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not size[0]:
            break
        weight = weights(document_frequencies(index, len(vocabulary)), size[0])

        def best(rows, floors):
            run = _searched(vocabulary, weight, *size, top, floors)  # noqa: B023
            return _ranked(rows.mapInArrow(run, "item long, doc long, score long"), top)

        index = index.where("doc IS NOT NULL")
        floors = np.ones(len(vocabulary.items), np.int64)
        part = index.where(F.pmod(F.xxhash64("doc"), F.lit(FIRST)) == 0)
        reached = best(part, floors).where(F.col("rank") == top).toArrow()  # a row for each item
        floors[np.searchsorted(vocabulary.items, reached["item"].to_numpy())] = reached["score"].to_numpy()
        found.append(best(index, floors))
    if not found:
        return spark.createDataFrame([], "item long, rank int, doc long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
