"""Toxicity from boosted trees over dense features of a text, with isotonic calibration.

Words are compared after undoing disguises: digits and signs that stand for letters, signs within a
word, and stretched letters. The lexicon is learned: words, and beginnings of words, of which most of
the documents that hold them are labelled toxic. It is counted over all labelled documents;
near copies count once. Features are densities of the lexicon's words, how near they stand to a
second person, shares of capitals and punctuation, and rates of disguised words.

Trees learn from features whose lexicon comes from the other half of the documents, so they learn how
far to trust it on texts it has not seen; the calibration learns from scores of trees that were
fitted on the other half.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import linestats
from tidemark.llm.shared import in_arrow, stored
from tidemark.llm.words import BYTE_KEYS, Words, column_bytes, mix, ranges_hash, signed, slices

#: Lengths of beginnings of words that can be in the lexicon.
STEMS = (4, 5, 6)
#: A term needs so many toxic documents, and a share of them of which the lower bound is this.
LEAST_TOXIC, LEAST_SHARE, DEVIATIONS = 2, 0.5, 1.28
#: Terms of a lexicon, those with the highest lower bounds; bounds the model's size.
MOST_TERMS = 20_000
#: Words on either side in which a second person counts as near.
NEAR = 5
FEATURES = (
    "words", "lexicon_words", "lexicon_density", "stems", "stem_density", "strongest", "weight_density",
    "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "questions",
    "punctuation", "disguised", "disguised_lexicon", "listed",
)

#: Words for the second person in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos ti usted ustedes vosotros vuestro vuestra"
).split()
#: Words known as insults, without learning.
INSULTS = (
    "idiot idiots moron morons stupid dumb dumbass fool loser losers scum trash garbage worthless "
    "pathetic disgusting clown creep freak jerk pig filth bastard bitch asshole "
    "idiotin dummkopf trottel arschloch abschaum versager widerlich blödmann "
    "imbécile crétin connard salope débile ordure "
    "idiota imbécil estúpido estúpida basura escoria inútil payaso"
).split()

#: Digits and signs that stand for letters.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_IS_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
for _sign, _letter in _STANDS_FOR.items():
    _LETTER[ord(_sign)] = ord(_letter)
_IS_STAND_IN = np.isin(np.arange(256), [ord(c) for c in _STANDS_FOR])


class PlainWords(Words):
    """The words of a text column without disguises; ``disguised`` says which had one.

    ASCII signs and other digits are left out, stretches of three or more equal letters are one.
    A-Z and capitals of Latin-1 are lower-cased. Apostrophes and the punctuation of Latin-1 and of
    the general punctuation block part words. A sign counts as a letter only before another one.
    """

    def __init__(self, column):
        data, offsets = column_bytes(column)
        n = len(data)
        plain = _LETTER[data]
        after, before = np.append(data[1:], 0x20), np.append(0x20, data[:-1]).astype(np.uint8)
        plain[(before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
        # The lead byte of a parting sign becomes a space, its other bytes go.
        long_sign = (data == 0xE2) & ((after == 0x80) | (after == 0x81))
        sign = long_sign | ((data == 0xC2) & (after >= 0xA0)) | (data == ord("'"))
        plain[sign] = 0x20
        rest = np.zeros(n + 2, bool)
        rest[1 : n + 1] = sign & (data != ord("'"))
        rest[2:] |= long_sign
        rest = rest[:n]
        parted = _IS_SPACE[plain] | rest
        follows = _IS_LETTER[after] | (_IS_STAND_IN[after] & (after != ord("!")))
        stand_in = _IS_STAND_IN[data] & (follows | ~np.isin(data, list(b"!$@")))
        kept = (_IS_LETTER[data] | _IS_SPACE[plain] | stand_in) & ~rest
        run = np.flatnonzero(np.append(True, plain[1:] != plain[:-1])) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(run, n))
        stretched = np.repeat(length >= 3, length) & (plain < 128) & _IS_LETTER[plain]
        stretched[run] = False
        kept &= ~stretched
        # A letter with something left out before it, which counts unless its word begins there.
        skipped = np.append(False, ~kept[:-1] & ~parted[:-1])[:n]
        edges = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=edges[1:])
        blanked = pa.LargeStringArray.from_buffers(
            len(column), pa.py_buffer(edges[offsets]), pa.py_buffer(np.ascontiguousarray(plain[kept]))
        )
        super().__init__(blanked)
        self.disguised = linestats.sums(stand_in[kept], self.starts, self.ends) > 0
        self.disguised |= linestats.sums(skipped[kept], self.starts + 1, self.ends) > 0


def stem_hashes(words, size):
    """Words of more than ``size`` characters, and the hashes of their beginnings."""
    begun = np.flatnonzero((words.data & 0xC0) != 0x80)
    first = np.searchsorted(begun, words.starts)
    end = np.searchsorted(begun, words.ends)
    long = np.flatnonzero(end - first > size)
    stops = begun[first[long] + size]
    hashes = ranges_hash(BYTE_KEYS[0][words.data], words.starts[long], stops, 0)
    return long, mix(hashes + np.uint64(size))


def terms(words):
    """All terms of a batch as word, hash of 62 bits and whether it is a beginning."""
    at, hashes, stem = [np.arange(len(words.starts))], [words.hashes()], [np.zeros(len(words.starts), bool)]
    for size in STEMS:
        long, found = stem_hashes(words, size)
        at.append(long)
        hashes.append(found)
        stem.append(np.ones(len(long), bool))
    return np.concatenate(at), np.concatenate(hashes) >> np.uint64(2), np.concatenate(stem)


def _hashes_of(listed):
    return np.sort(PlainWords(pa.array([" ".join(listed)])).hashes())


def _within(hashes, known):
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes, at


@dataclass
class Lexicon:
    """Hashes of terms in ascending order, and the lower bound of each one's toxic share."""

    hashes: np.ndarray
    shares: np.ndarray

    def features(self, column):
        """The features of every text, zeros for texts without a word."""
        words, rows = PlainWords(column), len(column)
        row_of = words.row_of(np.arange(len(words.starts)))
        n = np.maximum(words.counts, 1)
        total = lambda values: np.bincount(row_of, weights=values, minlength=rows)
        at, hashes, stem = terms(words)
        hit, place = _within(hashes, self.hashes)
        share = np.where(hit, self.shares[place] if len(self.shares) else 0.0, 0.0)
        # The strongest term of each word, and the same for whole words and beginnings alone.
        best, whole, begun = (np.zeros(len(words.starts)) for _ in range(3))
        np.maximum.at(best, at, share)
        np.maximum.at(whole, at[~stem], share[~stem])
        np.maximum.at(begun, at[stem], share[stem])
        strongest = np.zeros(rows)
        np.maximum.at(strongest, row_of, best)
        person = _within(words.hashes(), _SECOND)[0]
        listed = _within(words.hashes(), _LISTED)[0]
        bad = (best > 0) | listed
        edge = np.zeros(len(person) + 1, np.int64)
        np.cumsum(person, out=edge[1:])
        spot = np.arange(len(person))
        lo = np.maximum(spot - NEAR, words.first[row_of])
        hi = np.minimum(spot + NEAR + 1, words.first[row_of + 1])
        near = bad & (edge[hi] > edge[lo])

        data, offsets = column_bytes(column)
        raw, bounds = Words(column), (offsets[:-1], offsets[1:])
        first, upper = linestats.character_masks(data)
        chars = np.maximum(linestats.sums(first, *bounds), 1)
        letters = np.maximum(linestats.sums(first & (_IS_LETTER[data]), *bounds), 1)
        capital = linestats.sums(upper, raw.starts, raw.ends)
        lengths = linestats.sums(first & _IS_LETTER[data], raw.starts, raw.ends)
        shouted = (capital == lengths) & (lengths >= 3)
        raw_row = raw.row_of(np.arange(len(raw.starts)))
        return np.column_stack(
            [
                np.log1p(words.counts),
                np.log1p(total(whole > 0)), total(whole > 0) / n,
                np.log1p(total(begun > 0)), total(begun > 0) / n,
                strongest, total(best) / n,
                np.log1p(total(near)), total(person) / n,
                linestats.sums(upper, *bounds) / letters,
                np.bincount(raw_row, weights=shouted, minlength=rows) / np.maximum(raw.counts, 1),
                linestats.sums(data == ord("!"), *bounds) / chars,
                linestats.sums(data == ord("?"), *bounds) / chars,
                linestats.sums(linestats._IS_PUNCT[data], *bounds) / chars,
                total(words.disguised) / n, np.log1p(total(words.disguised & bad)),
                np.log1p(total(listed)),
            ]
        )


_SECOND, _LISTED = _hashes_of(SECOND_PERSON), _hashes_of(INSULTS)
NO_TERMS = Lexicon(np.zeros(0, np.uint64), np.zeros(0))


def lower_bound(toxic, clean):
    """Lower bound of the toxic share of a term's documents (Wilson's interval), as a column."""
    n, z2 = toxic + clean, DEVIATIONS**2
    p = toxic / n
    return (p + z2 / (2 * n) - DEVIATIONS * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def lessons(docs, labels):
    """Labelled texts, one of each group of near copies: ``id``, ``text``, ``label``, ``half``, ``order``.

    Near copies share the least hash of their five-word shingles; of each label's the one with the
    least hash of id and text stays. Copies are combined before the shuffle, so a group may be of any size.
    """

    def keyed(batch):
        keys = []
        for part in slices(batch):
            words = Words(part.column("text"), lower=True)
            hashes, at = words.windows(5)
            least = words.whole()
            row = words.row_of(at)
            if len(row):
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                least[row[begin]] = np.minimum.reduceat(hashes, begin)
            keys.append(signed(least))
        return {**{c: batch.column(c) for c in ("id", "text", "label")}, "near": np.concatenate(keys)}

    # Labels grow with the documents, so they are merged by id whatever their number is now.
    known = labels.where("label IN (0, 1)").hint("merge")
    labelled = docs.where("text IS NOT NULL").join(known, "id")
    labelled = labelled.select("id", "text", F.col("label").cast("int").alias("label"))
    labelled = labelled.mapInArrow(in_arrow(keyed), "id long, text string, label int, near long")
    first = F.struct(F.xxhash64("id", "text").alias("order"), "id", "text")
    one = labelled.groupBy("near", "label").agg(F.min(first).alias("one")).select("label", "one.*")
    return stored(one.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "order"), F.lit(2)).cast("int")), "lessons")


def lexicons(rows):
    """The lexicons of the first half, of the second and of all lessons.

    Every task sends one row for each different term of its texts, in bounded parts.
    """
    kinds = 4  # half and label

    def counted(batches):
        keys, counts, held = [], [], 0

        def sums():
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            return every, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)

        def sent(every, n):
            terms_, place = np.unique(every >> np.uint64(2), return_inverse=True)
            table = np.zeros((len(terms_), kinds), np.int64)
            np.add.at(table, (place, (every & np.uint64(3)).astype(np.int64)), n)
            columns = [signed(terms_), *table.T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["term", "n0", "n1", "n2", "n3"])

        for batch in batches:
            for part in slices(batch):
                words = PlainWords(part.column("text"))
                at, hashes, _ = terms(words)
                row = words.row_of(at)
                _, once = np.unique(linestats.in_row(hashes, row), return_index=True)
                half, label = (part.column(c).to_numpy() for c in ("half", "label"))
                kind = (2 * half + label)[row[once]].astype(np.uint64)
                every, n = np.unique((hashes[once] << np.uint64(2)) | kind, return_counts=True)
                keys.append(every)
                counts.append(n)
                held += len(every)
                if held > 4_000_000:
                    every, n = sums()
                    keys, counts, held = [every], [n], len(every)
                    if held > 2_000_000:
                        yield sent(every, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield sent(*sums())

    counts = rows.mapInArrow(counted, "term long, n0 long, n1 long, n2 long, n3 long")
    counts = counts.groupBy("term").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(kinds)])
    counts = stored(counts.where(F.col("n1") + F.col("n3") >= LEAST_TOXIC), "terms")

    def lexicon(clean, toxic):
        found = counts.select("term", toxic.alias("toxic"), lower_bound(toxic, clean).alias("share"))
        found = found.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("share") >= LEAST_SHARE))
        found = found.orderBy(F.desc("share"), "term").limit(MOST_TERMS).toArrow()
        hashes = np.ascontiguousarray(found["term"].to_numpy()).view(np.uint64)
        order = np.argsort(hashes)
        return Lexicon(hashes[order], found["share"].to_numpy()[order])

    n = [F.col(f"n{i}") for i in range(kinds)]
    return lexicon(n[0], n[1]), lexicon(n[2], n[3]), lexicon(n[0] + n[2], n[1] + n[3])


def sampled(rows, most):
    """At most ``most`` lessons of each label, those with the least ``order``, and each one's weight.

    Rows that cannot be among them are left out by the number of rows first, so that no task gets
    more than a few deviations above ``most``.
    """
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two labels
    share = F.pmod(F.xxhash64(F.lit(2), "order"), F.lit(1 << 30)) / (1 << 30)
    kept = F.lit(False)
    for label, n in sizes.items():
        kept |= (F.col("label") == label) & (share <= (most + 8 * most**0.5 + 8) / n)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("order", "id", "text"))
    rows = rows.where(kept).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    rows = stored(rows, "sample")
    held = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.lit(1.0)
    for label, n in held.items():
        weight = F.when(F.col("label") == label, sizes[label] / n).otherwise(weight)
    return rows.withColumn("weight", weight), sizes


def _features(rows, keep, lexicon):
    """The columns ``keep`` and the vector ``features`` of every text."""
    rows = rows.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batch):
        found = np.concatenate([lexicon.features(part.column("text")) for part in slices(batch)])
        edges = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        values = pa.ListArray.from_arrays(edges, pa.array(found.ravel()))
        return {**{c: batch.column(c) for c in keep}, "features": values}

    found = rows.mapInArrow(in_arrow(run), f"{kept}, features array<double>")
    return found.withColumn("features", array_to_vector("features"))


@dataclass
class Model:
    """A lexicon, trees and their calibration; without trees every text gets ``prior``."""

    lexicon: Lexicon
    trees: object
    calibration: object
    prior: float


def train(docs, labels, most=2000, trees=20, depth=3):
    """Fit on ``id``, ``text`` and ``id``, ``label`` (0 or 1; 1 is toxic).

    The lexicon is counted over all labelled texts; trees and calibration are fitted on at most
    ``most`` of each label. Null texts and other labels are left out. Labels of one kind only give
    their share as every score, none at all give 0.
    """
    rows = lessons(docs, labels)
    sample, sizes = sampled(rows, most)
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return Model(NO_TERMS, None, None, prior)
    first, second, every = lexicons(rows)
    keep = ["order", "label", "weight", "half"]
    halves = [_features(sample.where(F.col("half") == half), keep, lexicon) for half, lexicon in ((0, second), (1, first))]
    known = stored(halves[0].union(halves[1]), "features")
    known = known.withColumn("label", F.col("label").cast("double"))
    # A bounded sample in one sorted partition: every run fits the same rows in the same order.
    known = known.coalesce(1).sortWithinPartitions("order")
    booster = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, weightCol="weight", featuresCol="features",
        labelCol="label", minInstancesPerNode=2,
    )
    margins = []
    for half in (0, 1):
        learnt = known.where(F.col("half") != half)
        if learnt.select("label").distinct().count() < 2:
            learnt = known
        fitted = booster.fit(learnt)
        scored = fitted.transform(known.where(F.col("half") == half))
        margins.append(scored.select("label", "weight", vector_to_array("probability")[1].alias("margin")))
    seen = stored(margins[0].union(margins[1]), "margins")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(seen.coalesce(1))
    return Model(every, booster.fit(known), calibration, prior)


def score(docs, model, text_column="text"):
    """``row`` (a struct of all given columns but the text) and ``score`` (0 to 1) of every document.

    Null and empty texts score as a text without words. Repeated rows score alike. Whole texts are
    read, one batch of about half a megabyte or one long text at a time.
    """
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(text_column).alias("text"),
    )
    if model.trees is None:
        return rows.select("row", F.lit(float(model.prior)).alias("score"))
    found = model.trees.transform(_features(rows, ["row"], model.lexicon))
    found = found.select("row", vector_to_array("probability")[1].alias("margin"))
    found = model.calibration.transform(found)
    return found.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("score"))
