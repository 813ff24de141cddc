"""Language by a string kernel: blended n-gram presence, Nyström landmarks, ridge regression.

The kernel of two texts is the weighted number of n-grams of one to three symbols that both hold,
divided by the geometric mean of their own numbers. Symbols are all letters that landmarks hold, of
any script, one symbol for all other letters, and one for everything between words. N-grams that no
landmark holds are the same for all texts and left out.

Landmarks span the feature space (Nyström): a text's features are its kernels with the landmarks,
whitened by the landmarks' own kernel matrix. One ridge regression per language against the rest
gives its score. As all of this is linear in the presence vector, the scores of a batch are one
matrix product of presences and folded weights.
"""

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.quality_crf import sample_ids, sampled_texts
from tidemark.llm.words import slices

#: N-grams numbered in a table up to this many possible ones, and else found by bisection.
TABLE_GRAMS = 1 << 22
ORDERS = ((1, 0.3), (2, 0.7), (3, 1.0))
ROWS_AT_ONCE = 256
#: Code points whose n-grams are numbered at once; each takes some 100 bytes meanwhile.
POINTS_AT_ONCE = 1 << 16

_letter = []


def _is_letter():
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _letter[0]


def code_points(texts):
    """Code points of lower-cased texts, each followed by a line feed, and the row of each."""
    lowered = [(text or "").lower() for text in texts]
    joined = "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(texts)), [len(text) + 1 for text in lowered])


class Alphabet:
    """Symbols of code points: 0 between words, 1 for letters of no own symbol, 2 on for the rest."""

    def __init__(self, letters):
        self.table = _is_letter().astype(np.int32)
        self.table[letters] = np.arange(2, len(letters) + 2)
        self.size = len(letters) + 2

    def grams(self, points, row):
        """Numbers of all n-grams of all orders, with their rows."""
        symbols = self.table[points].astype(np.int64)
        base, found = 0, []
        for order, _ in ORDERS:
            n = len(symbols) - order + 1
            number = np.zeros(max(n, 0), np.int64)
            for step in range(order):
                number = number * self.size + symbols[step : step + n]
            inside = row[: max(n, 0)] == row[order - 1 :]
            found.append((base + number[inside], row[: max(n, 0)][inside]))
            base += self.size**order
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def gram_count(self):
        return sum(self.size**order for order, _ in ORDERS)


@dataclass
class Classifier:
    languages: list
    letters: list
    grams: np.ndarray
    gram_weights: np.ndarray
    folded: np.ndarray
    bias: np.ndarray

    def _ready(self):
        if not hasattr(self, "_alphabet"):
            self._alphabet = Alphabet(self.letters)
            self._table = None
            if self._alphabet.gram_count() <= TABLE_GRAMS:
                self._table = np.full(self._alphabet.gram_count(), len(self.grams), np.int32)
                self._table[self.grams] = np.arange(len(self.grams))
        return self._alphabet

    def _columns(self, number):
        """The column of each n-gram; that after the last one for those that no landmark holds."""
        if self._table is not None:
            return self._table[number]
        if not len(self.grams):
            return np.zeros(len(number), np.int64)
        at = np.minimum(np.searchsorted(self.grams, number), len(self.grams) - 1)
        return np.where(self.grams[at] == number, at, len(self.grams))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def presence(self, points, row, rows):
        alphabet = self._ready()
        held = np.zeros((rows, len(self.grams) + 1), np.float32)
        for lo in range(0, len(points), POINTS_AT_ONCE):
            # Up to the end of the longest n-gram that begins here; one met twice is held all the same.
            here = slice(lo, lo + POINTS_AT_ONCE + len(ORDERS) - 1)
            number, at = alphabet.grams(points[here], row[here])
            held[at, self._columns(number)] = 1
        return held[:, :-1]

    def scores(self, texts):
        """Scores of all languages for each text, and whether the text holds a letter."""
        points, row = code_points(texts)
        letter = np.bincount(row, weights=_is_letter()[points], minlength=len(texts)) > 0
        held = self.presence(points, row, len(texts))
        norm = np.sqrt(np.maximum(held @ self.gram_weights, 1e-9))
        return held @ self.folded / norm[:, None] + self.bias, letter

    def predict(self, texts):
        """Language and score between 0 and 1; ``und`` and 0 for texts without a letter, and for all
        texts where no language was learned."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        scores, letter = self.scores(texts)
        best = scores.argmax(axis=1)
        found = [self.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
        top = scores[np.arange(len(texts)), best]
        return found, np.where(letter, np.clip((top + 1) / 2, 0, 1), 0.0)


def fit(texts, langs, landmarks=40, ridge=1e-2):
    """Fit the classifier; the first ``landmarks`` texts of each language are its landmarks."""
    languages = sorted(set(langs))
    chosen = [i for lang in languages for i in [k for k, v in enumerate(langs) if v == lang][:landmarks]]
    points, row = code_points([texts[i] for i in chosen])
    counts = Counter(points[_is_letter()[points]].tolist())
    letters = sorted(counts)
    alphabet = Alphabet(letters)
    grams = np.unique(alphabet.grams(points, row)[0]) if len(chosen) else np.zeros(0, np.int64)
    edges = np.cumsum([alphabet.size**order for order, _ in ORDERS])
    weights = np.array([w for _, w in ORDERS], np.float32)[np.searchsorted(edges, grams, side="right")]
    model = Classifier(languages, letters, grams, weights, np.zeros((len(grams), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    marks = model.presence(points, row, len(chosen))
    marks = marks / np.sqrt(np.maximum(marks @ weights, 1e-9))[:, None] * weights
    parts = []
    for lo in range(0, len(texts), ROWS_AT_ONCE):
        part = texts[lo : lo + ROWS_AT_ONCE]
        held = model.presence(*code_points(part), len(part))
        parts.append(held @ marks.T / np.sqrt(np.maximum(held @ weights, 1e-9))[:, None])
    kernel = np.concatenate(parts).astype(float)
    value, vector = np.linalg.eigh(kernel[chosen])
    whiten = vector / np.sqrt(np.maximum(value, 1e-6))
    features = kernel @ whiten
    wanted = np.where(np.array(langs)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # Every language weighs the same.
    each = np.array([1 / langs.count(lang) for lang in languages])[[languages.index(v) for v in langs]]
    each = each / each.mean()
    center = np.average(features, axis=0, weights=each)
    mean = np.average(wanted, axis=0, weights=each)
    inner = features - center
    gram = inner.T @ (inner * each[:, None]) + ridge * len(texts) * np.eye(inner.shape[1]) * 1e-1
    solved = np.linalg.solve(gram, inner.T @ ((wanted - mean) * each[:, None]))
    model.folded = (marks.T @ (whiten @ solved)).astype(np.float32)
    model.bias = (mean - center @ solved).astype(np.float32)
    return model


def train(docs, most=300, **options):
    """Fit on at most ``most`` texts of each language (``id``, ``text``, ``lang``), on the driver.

    Null languages and texts without a letter are left out.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = sampled_texts(rows, sample_ids(rows, "lang", most), ["id", "lang"])
    return fit(sample["text"].tolist(), sample["lang"].tolist(), **options)


def predict(docs, model, text_column="text"):
    """``row`` (a struct of all given columns but the text), ``text``, ``lang_pred`` and ``score``.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows are alike.
    """
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(text_column).alias("text"),
    )
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            # Passed on slice by slice, so that Spark holds no second copy of a batch's texts.
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                langs, scores = [], []
                for lo in range(0, len(texts), ROWS_AT_ONCE):
                    found, score = model.predict(texts[lo : lo + ROWS_AT_ONCE])
                    langs.extend(found)
                    scores.append(score)
                yield pa.RecordBatch.from_pydict({
                    "row": part.column("row"), "text": part.column("text"),
                    "lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.concatenate(scores), pa.float64()),
                })

    return rows.mapInArrow(run, f"row {kind}, text string, lang_pred string, score double")
