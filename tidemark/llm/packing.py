"""Packing of token pieces into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces go, longest first, to the open sequence that meets every constraint and in which
the weighted norm of what stays free is least; without one, a new sequence is opened.

A piece's demand follows from its length alone, so sequences that have received the same lengths
are alike. The plan is therefore made for counts of pieces by length, at most ``capacity`` numbers
whatever the size of the corpus: alike sequences are kept as ranges of numbers and filled many at a
time, with the outcome of placing the pieces one by one. Spark then numbers the pieces of each
length and looks up the range that each number falls in.
"""

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, text_batches
from tidemark.llm.tokens import encoded_rows


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; the defaults of documents and cost never bind."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    weights: tuple = (1.0, 0.01, 0.01)

    def vector(self):
        limits = (self.tokens, self.documents or self.tokens, self.cost or self.tokens**2)
        return np.array(limits, np.int64)


@dataclass
class _Bins:
    """Alike sequences: what each has free, and ranges of their numbers."""

    free: np.ndarray
    ranges: list = field(default_factory=list)

    def count(self):
        return sum(hi - lo for lo, hi in self.ranges)

    def take(self, n):
        taken = []
        while n:
            lo, hi = self.ranges.pop()
            m = min(n, hi - lo)
            taken.append((lo, lo + m))
            if lo + m < hi:
                self.ranges.append((lo + m, hi))
            n -= m
        return taken


def plan(counts, capacity):
    """Rows (length, rank_from, rank_to, sequence, per_sequence, offset) that place all pieces.

    The pieces of a length with ranks from ``rank_from`` on fill the sequences from ``sequence``
    on, ``per_sequence`` in each, beginning at ``offset``.
    """
    limits, weights = capacity.vector(), np.array(capacity.weights)
    open_bins, rows, opened = {}, [], 0

    def put(length, rank, bins, free, each):
        for lo, hi in bins:
            n = (hi - lo) * each
            rows.append((length, rank, rank + n, lo, each, int(limits[0] - free[0])))
            rank += n
        left = free - each * need
        if left[0] > 0 and left[1] > 0 and left[2] > 0:
            open_bins.setdefault(tuple(left), _Bins(left)).ranges.extend(bins)
        return rank

    for length in sorted(counts, reverse=True):
        need, total, rank = np.array([length, 1, length * length], np.int64), counts[length], 0
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        keys = list(open_bins)
        frees = np.array(keys, np.int64).reshape(-1, 3)
        fits = np.flatnonzero((frees >= need).all(axis=1))
        norms = ((((frees[fits] - need) / limits) ** 2) * weights).sum(axis=1)
        # Bins that this length fills no longer take it, so one order serves all its pieces.
        for key in [keys[i] for i in fits[np.argsort(norms, kind="stable")]]:
            if rank == total:
                break
            bins = open_bins.pop(key)
            most = int((bins.free // need).min())
            n = min(bins.count(), (total - rank) // most)
            rank = put(length, rank, bins.take(n), bins.free, most)
            if bins.ranges and rank < total:
                rank = put(length, rank, bins.take(1), bins.free, total - rank)
            if bins.ranges:
                open_bins.setdefault(key, _Bins(bins.free)).ranges.extend(bins.ranges)
        most = int((limits // need).min())
        n, rest = divmod(total - rank, most)
        if n:
            rank = put(length, rank, [(opened, opened + n)], limits, most)
            opened += n
        if rest:
            put(length, rank, [(opened, opened + 1)], limits, rest)
            opened += 1
    return rows


def _pieces(tokenizer, end_id, most):
    schema = pa.schema(
        [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
    )

    def run(batches):
        number = TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            for part, ids, sizes in encoded_rows(batch, tokenizer, end_id):
                n = -(-sizes // most)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(sizes[row] - start, most)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [
                    zlib.crc32(data[a * 4 : b * 4])
                    for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)
                ]
                # Place among the pieces of the same length of this partition.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                run_start = np.searchsorted(ordered, ordered)
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - run_start + seen[ordered]
                seen += np.bincount(length, minlength=most + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(row)), pa.array(piece, pa.int32()),
                        pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                        pa.array(np.full(len(row), number), pa.int32()), pa.array(place),
                    ],
                    schema=schema,
                )

    return run


def pack_documents(
    docs, tokenizer, capacity=None, end_id=0, id_column="doc_id", text_column="text"
):
    """Place all documents in few sequences; only those longer than a sequence are cut.

    Returns one row per piece: ``id``, ``piece``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``. A null or empty text is the end id
    alone. Rows without an id and repeated rows are packed like any other.
    """
    capacity = capacity or Capacity()
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    pieces = rows.mapInArrow(
        _pieces(tokenizer, end_id, capacity.tokens),
        "id long, piece int, start long, length long, ids_crc32 long, part int, place long",
    )
    with text_batches(docs.sparkSession):
        pieces = stored(pieces, "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    counts = stored(counts, "piece_counts")
    # At most one row per possible length.
    totals = counts.groupBy("length").agg(F.sum("rows")).collect()
    rows = plan({length: n for length, n in totals}, capacity)
    names = ("length", "rank_from", "rank_to", "first", "each", "begin")
    # As an Arrow table, which Spark reads without further Python workers.
    table = np.array(rows, np.int64).reshape(-1, len(names)).T
    placed = docs.sparkSession.createDataFrame(pa.table({k: pa.array(v) for k, v in zip(names, table)}))
    ranked = pieces.join(counts.drop("rows"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("before"))
    # The plan's size depends on the capacity, not on the number of pieces.
    inside = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    found = ranked.join(F.broadcast(placed.withColumnRenamed("length", "_length")),
                        (F.col("length") == F.col("_length")) & inside)
    within = F.col("rank") - F.col("rank_from")
    return found.select(
        "id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("begin") + within % F.col("each") * F.col("length")).alias("offset"),
    )
