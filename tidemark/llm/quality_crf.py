"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word is good or bad. A line's score comes from its own statistics and from
those of the lines before and after; neighbouring labels are tied by one weight. The chain is fitted
on lines that take the label of their document. A document's score is the mean of its lines'
forward-backward marginals of being good, weighted by line length.

With two labels the messages are single log odds: passing one on along a tie of weight t turns log
odds a into log((exp(a + t) + 1) / (exp(a) + exp(t))).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import linestats
from tidemark.llm.shared import in_arrow, stored
from tidemark.llm.words import Words, slices

OWN = 12


def line_features(words):
    """Lines, a matrix of their statistics, and each line's number of characters."""
    data, lines = words.data, linestats.Lines(words)
    first, upper = linestats.character_masks(data)
    lo, hi = lines.starts, lines.ends
    chars = np.maximum(linestats.sums(first, lo, hi), 1)
    n = lines.last - lines.first
    share = lambda mask: np.sqrt(linestats.sums(mask, lo, hi) / chars)
    hashes = words.hashes()
    # Equal neighbours and different words, within each line.
    line_of = np.searchsorted(lines.first, np.arange(len(hashes)), side="right") - 1
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    distinct = np.zeros(len(hashes), bool)
    distinct[np.unique(linestats.in_row(hashes, line_of), return_index=True)[1]] = True
    repeated = linestats.repeated_words(words)
    last = data[hi - 1] if len(hi) else np.zeros(0, np.uint8)
    return lines, np.column_stack(
        [
            np.log1p(chars), np.log1p(n), np.log(chars / np.maximum(n, 1)),
            share(upper), share(linestats._IS_DIGIT[data]), share(linestats._IS_PUNCT[data]),
            share(linestats._IS_SYMBOL[data]), share(data == 0x21),
            linestats.sums(twin, lines.first, lines.last) / np.maximum(n, 1),
            linestats.sums(distinct, lines.first, lines.last) / np.maximum(n, 1),
            linestats.sums(repeated, lines.first, lines.last) / np.maximum(n, 1),
            np.isin(last, list(b".!?")),
        ]
    ).astype(float), chars


def with_neighbours(x, row):
    """Own statistics and squares, those of the lines before and after, and flags for the ends."""
    same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    ends = np.ones((len(x), 2))
    ends[1:, 0][same] = 0
    ends[:-1, 1][same] = 0
    return np.column_stack([x, x**2, before, after, ends])


def _pass(a, tie):
    return np.logaddexp(a + tie, 0) - np.logaddexp(a, tie)


def marginals(unary, row, tie):
    """Probability of being good for every line, and of equal labels for every neighbouring pair."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros(0)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    forward, backward = unary.copy(), np.zeros(n)
    for step in range(1, size[0]):
        at = first[: np.searchsorted(-size, -step)] + step
        forward[at] += _pass(forward[at - 1], tie)
    for step in range(size[0] - 2, -1, -1):
        at = first[: np.searchsorted(-size, -(step + 1))] + step
        backward[at] = _pass(unary[at + 1] + backward[at + 1], tie)
    good = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    pair = np.flatnonzero(row[1:] == row[:-1])
    a, b = forward[pair], (unary + backward)[pair + 1]
    same = np.logaddexp(a + b, 0) + tie
    return good, np.exp(same - np.logaddexp(same, np.logaddexp(a, b)))


@dataclass
class Chain:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    tie: float
    prior: float

    def unary(self, x, row):
        return with_neighbours((x - self.mean) / self.scale, row) @ self.weights + self.bias

    def score(self, column):
        """Score of every row; rows without a line get the share of good training documents."""
        words = Words(column)
        lines, x, chars = line_features(words)
        good, _ = marginals(self.unary(x, lines.row), lines.row, self.tie)
        n = len(column)
        total = np.bincount(lines.row, weights=chars, minlength=n)
        held = np.bincount(lines.row, weights=chars * good, minlength=n)
        return np.where(total > 0, held / np.maximum(total, 1), self.prior)


def fit(texts, labels, steps=200, rate=0.08, decay=1e-3, tie_decay=0.05):
    """Fit a chain to labelled texts by gradient ascent (Adam); every document weighs the same."""
    labels = np.asarray(labels, float)
    prior = float(labels.mean()) if len(labels) else 0.5
    parts, done = [(np.zeros(0, np.int64), np.zeros((0, OWN)))], 0
    for part in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})):
        lines, found, _ = line_features(Words(part.column("text")))
        parts.append((lines.row + done, found))
        done += part.num_rows
    row, x = map(np.concatenate, zip(*parts, strict=True))
    mean = x.mean(axis=0) if len(x) else np.zeros(OWN)
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(OWN)
    width = 4 * OWN + 2
    chain = Chain(mean, scale, np.zeros(width), 0.0, 0.5, prior)
    if not len(x) or prior in (0.0, 1.0):
        chain.bias = 0.0 if not len(x) else 20.0 * (prior - 0.5)
        return chain
    y = labels[row]
    z = with_neighbours((x - mean) / scale, row)
    each = 1 / np.bincount(row, minlength=len(texts))[row]
    pair = np.flatnonzero(row[1:] == row[:-1])
    total = each.sum()
    theta = np.zeros(width + 2)
    theta[-1] = 0.5
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, same = marginals(z @ theta[:width] + theta[width], row, theta[-1])
        error = each * (y - good)
        slope = np.append(
            z.T @ error / total - decay * theta[:width],
            [error.sum() / total, (each[pair] * (1 - same)).sum() / total - tie_decay * theta[-1]],
        )
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    chain.weights, chain.bias, chain.tie = theta[:width], float(theta[width]), float(theta[-1])
    return chain


def sample_ids(labelled, label, most):
    """At most ``most`` rows of each label, those with the least hashes of ``id``; only these columns.

    Rows beyond a share of the hash range that holds ``most`` of their label and some more are left
    out where they are read, so that what meets in one task does not grow with the table.
    """
    rows = labelled.select("id", label)
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size")).withColumnRenamed(label, "_label")
    place = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    wanted = (most + 8 * most**0.5 + 64) / F.col("_size")
    near = rows.join(sizes, F.col(label) == F.col("_label")).where(place <= wanted)
    near = near.select("id", label).distinct()
    order = Window.partitionBy(label).orderBy(F.xxhash64("id"), "id")
    ranked = near.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def sampled_texts(docs, sample, on):
    """Texts of a bounded sample of ids, on the driver: of rows that share an id the least text."""
    sample = stored(sample, "sample")
    # The sample has a fixed number of rows for each label.
    found = docs.join(F.broadcast(sample), on)
    names = [c for c in found.columns if c != "text"]
    found = found.groupBy(*names).agg(F.min("text").alias("text"))
    return found.orderBy(F.xxhash64("id"), "id", *[n for n in names if n != "id"]).toPandas()


def train(docs, labels, most=1500):
    """Fit the chain on at most ``most`` documents of each label (0 or 1); other labels are left out.

    ``docs`` has ``id`` and ``text``, ``labels`` has ``id`` and ``label``. The sample is drawn from
    the labels, is bounded, and is fitted on the driver. Null texts in it are left out.
    """
    sample = sample_ids(labels.where("label IN (0, 1)"), "label", most)
    sample = sampled_texts(docs.where("text IS NOT NULL"), sample, ["id"])
    return fit(sample["text"].tolist(), sample["label"].tolist())


def score(docs, chain, text_column="text"):
    """``row`` (a struct of all given columns but the text) and ``score`` of every document.

    Null and empty texts get the share of good training documents. Repeated rows score alike.
    """
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(text_column).alias("text"),
    )
    kind = rows.schema["row"].dataType.simpleString()

    def run(batch):
        parts = [chain.score(part.column("text")) for part in slices(batch)]
        return {"row": batch.column("row"), "score": pa.array(np.concatenate(parts))}

    return rows.mapInArrow(in_arrow(run), f"row {kind}, score double")
