"""Quality rules, and robust multivariate outliers by minimum covariance determinant.

Every text becomes a vector of transformed statistics. For each language and source, location and
scatter are those of the share ``COVERAGE`` of rows whose scatter has a small determinant, reached by
concentration steps: measure all rows by the present estimate, keep the nearest share, estimate
anew. Each step is one aggregation over all rows: sums by group and by narrow ranges of distance,
added up to the wanted share. A row is rejected if its Mahalanobis distance is too large.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import linestats
from tidemark.llm.shared import in_arrow, stored
from tidemark.llm.words import Words, slices

COVERAGE = 0.75
STEPS = 10
BINS_PER_UNIT, BINS = 24, 480
#: Statistics and the least standard deviation that each is taken to have.
FLOORS = {
    "log_words": 0.4, "log_word_length": 0.06, "symbols": 0.06, "dup_lines": 0.15,
    "repeats": 0.15, "upper": 0.05, "punctuation": 0.06, "digits": 0.1,
}
NAMES = tuple(FLOORS)
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(batches):
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            rows, lo, hi = part.num_rows, words.offsets[:-1], words.offsets[1:]
            data = words.data
            first, upper = linestats.character_masks(data)
            solid = first & (data != 0x20) & ~((data >= 9) & (data <= 13))
            n, chars = words.counts, linestats.sums(solid, lo, hi)
            symbols = linestats.sums(linestats._IS_SYMBOL[data], lo, hi)
            dup = linestats.Lines(words).duplicates(rows)
            repeat = linestats.sums(linestats.repeated_words(words), words.first[:-1], words.first[1:])
            share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
            lines = linestats.sums(data == 0x0A, lo, hi) + 1
            values = (
                np.log1p(n), np.log(np.maximum(chars, 1) / np.maximum(n, 1)), share(symbols, chars),
                share(dup, lines), share(repeat, n),
                share(linestats.sums(upper, lo, hi), chars),
                share(linestats.sums(linestats._IS_PUNCT[data], lo, hi), chars),
                share(linestats.sums(linestats._IS_DIGIT[data], lo, hi), chars),
            )
            columns = {"row": part.column("row"), "lang": part.column("lang"), "source": part.column("source")}
            for name, column in zip(_COUNTS, (n, chars, symbols, dup, repeat), strict=True):
                columns[name] = pa.array(column, pa.int64())
            for name, column in zip(NAMES, values, strict=True):
                columns[name] = pa.array(column, pa.float64())
            yield pa.RecordBatch.from_pydict(columns)


def chi_square(p, df):
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def _groups(rows, least):
    """Each row's ``group``, whose estimate judges it, and ``groups``, whose estimates it is part of.

    Only rows that meet the base rules count. The group is the row's language and source, where these
    have few rows all rows of its language, and where it has few too the whole table.
    """
    key = lambda *of: F.xxhash64(F.to_json(F.array(*of)))
    counts = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    counts = stored(counts, "counts")
    langs = counts.groupBy("lang").agg(
        F.sum("n").alias("in_lang"), F.bool_or(F.col("n") < least).alias("lang_used")
    ).withColumnRenamed("lang", "l")
    whole = langs.agg(F.bool_or(F.col("lang_used") & (F.col("in_lang") < least)).alias("all_used"))
    # Null-safe: null languages and sources are groups like others.
    counts = counts.join(langs, F.col("lang").eqNullSafe(F.col("l"))).crossJoin(whole)
    few, few_in_lang = F.col("n") < least, F.col("in_lang") < least
    own, lang, all_ = key(F.lit("source"), "lang", "source"), key(F.lit("lang"), "lang"), key(F.lit("all"))
    member = F.array_compact(
        F.array(
            F.when(~few, own),
            F.when(F.col("lang_used") & ~few_in_lang, lang),
            F.when(F.col("all_used"), all_),
        )
    )
    counts = counts.select(
        F.to_json(F.struct("lang", "source")).alias("of"),
        F.when(~few, own).when(~few_in_lang, lang).otherwise(all_).alias("group"),
        member.alias("groups"),
    )
    return rows.withColumn("of", F.to_json(F.struct("lang", "source"))).join(counts, "of").drop("of")


def _distances(batch):
    """Statistics of a batch as a matrix, and their squared Mahalanobis distances."""
    x = np.column_stack([batch.column(n).to_numpy() for n in NAMES])
    y = x - _matrix(batch.column("m"))
    p, total = _matrix(batch.column("p")), np.zeros(len(x))
    for at, (i, j) in enumerate(_PAIRS):
        total += y[:, i] * y[:, j] * p[:, at] * (1 if i == j else 2)
    return x, total


def _matrix(column):
    return column.flatten().to_numpy().reshape(len(column), -1)


_SUMS = [f"s{k}" for k in range(len(NAMES) + len(_PAIRS))]


def _binned(batches):
    """Sums of the statistics and of their products, by group and range of distance."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, distance = _distances(batch)
        bin_ = np.minimum(np.log1p(np.maximum(distance, 0)) * BINS_PER_UNIT, BINS).astype(np.int64)
        keys = np.rec.fromarrays([batch.column("group").to_numpy(), bin_])
        found, which, rows = np.unique(keys, return_inverse=True, return_counts=True)
        terms = [x[:, i] for i in range(len(NAMES))] + [x[:, i] * x[:, j] for i, j in _PAIRS]
        columns = {"group": found["f0"], "bin": found["f1"], "rows": rows.astype(float)}
        for name, term in zip(_SUMS, terms, strict=True):
            columns[name] = np.bincount(which, weights=term, minlength=len(found))
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


_ESTIMATE = "group long, n double, m array<double>, p array<double>, logdet double, size double"


def _estimates(batches):
    """Centre, inverse scatter and log determinant from the sums of each group."""
    for batch in batches:
        sums = np.array(batch.column("sums").to_pylist(), float).reshape(batch.num_rows, -1)
        size, d = np.array(batch.column("kept").to_pylist(), float), len(NAMES)
        mean = sums[:, :d] / size[:, None]
        scatter = np.zeros((len(sums), d, d))
        for at, (i, j) in enumerate(_PAIRS):
            value = sums[:, d + at] / size - mean[:, i] * mean[:, j]
            scatter[:, i, j] = scatter[:, j, i] = value
        scatter += np.diag(np.square(list(FLOORS.values())))
        inverse = np.linalg.inv(scatter)
        packed = np.stack([inverse[:, i, j] for i, j in _PAIRS], axis=1)
        yield pa.RecordBatch.from_pydict(
            {
                "group": batch.column("group"), "n": batch.column("n"),
                "m": pa.array(mean.tolist()), "p": pa.array(packed.tolist()),
                "logdet": pa.array(np.linalg.slogdet(scatter)[1]), "size": batch.column("size"),
            }
        )


def _concentrate(rows, estimates):
    """Estimates from the nearest ``COVERAGE`` of each group's rows by the given estimates."""
    joined = rows.select("group", *NAMES).join(estimates.select("group", "m", "p"), "group")
    schema = "group long, bin long, rows double" + "".join(f", {s} double" for s in _SUMS)
    sums = joined.mapInArrow(_binned, schema).groupBy("group", "bin").agg(
        *[F.sum(c).alias(c) for c in ("rows", *_SUMS)]
    )
    # At most BINS + 1 rows for each group.
    whole = Window.partitionBy("group")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("n", F.sum("rows").over(whole))
    sums = sums.withColumn("below", F.coalesce(F.sum("rows").over(below), F.lit(0.0)))
    kept = sums.where(F.col("below") < COVERAGE * F.col("n"))
    return kept.groupBy("group").agg(
        F.first("n").alias("n"), F.sum("rows").alias("kept"),
        F.array(*[F.sum(s) for s in _SUMS]).alias("sums"),
        F.expm1((F.max("bin") + 0.5) / BINS_PER_UNIT).alias("size"),
    ).mapInArrow(_estimates, _ESTIMATE)


def estimate(rows):
    """Concentrated estimates for each ``group`` of rows with the statistics columns."""
    middle = [F.percentile_approx(n, 0.5, 1000).alias(f"{n}_") for n in NAMES]
    start = stored(rows.groupBy("group").agg(*middle), "medians")
    spread = [F.percentile_approx(F.abs(F.col(n) - F.col(f"{n}_")), 0.5, 1000).alias(n) for n in NAMES]
    start = start.withColumnRenamed("group", "g").join(
        rows.join(start, "group").groupBy("group").agg(*spread), F.col("g") == F.col("group")
    )
    center = F.array(*[F.col(f"{n}_") for n in NAMES])
    inverse = F.array(
        *[
            1 / (F.pow(1.4826 * F.col(NAMES[i]), 2) + FLOORS[NAMES[i]] ** 2) if i == j else F.lit(0.0)
            for i, j in _PAIRS
        ]
    )
    now = stored(start.select("group", center.alias("m"), inverse.alias("p")), "mcd")
    before = None
    for _ in range(STEPS):
        now = stored(_concentrate(rows, now), "mcd")
        if before is not None:
            change = now.select("group", "logdet").join(
                before.select("group", F.col("logdet").alias("was")), "group"
            ).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
            if change is None or change < 0.01:
                break
        before = now
    return now


def judge(
    docs, confidence=0.9999, slack=1.2, least_rows=200, least_words=10,
    text_column="text", lang_column="lang", source_column="source",
):
    """Judge every document by base rules and as an outlier of its language and source.

    Returns ``row`` (a struct of all given columns but the text), ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``distance`` (squared, in
    units of the estimate) and ``kept``. A document stays if it meets the base rules and its
    distance is at most ``slack`` times the chi-square quantile at ``confidence``.

    Null or empty texts have no words and fail the base rules. Null languages and sources are
    groups like others. A language and source in which less than ``least_rows`` rows meet the base
    rules is judged by the estimate of all rows of its language, large sources included, and where
    these are few too by that of the whole table; only where less than ``least_rows`` rows of the
    whole table meet the base rules is there no ``distance``.
    """
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(source_column).cast("string").alias("source"),
        F.col(text_column).alias("text"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, lang string, source string"
    schema += "".join(f", {c} long" for c in _COUNTS) + "".join(f", {n} double" for n in NAMES)
    rows = stored(rows.mapInArrow(_statistics, schema), "statistics")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stored(_groups(rows.withColumn("base_failed", failed), least_rows), "grouped")

    # Rows that the base rules refuse are no model of their source.
    model = rows.where(~F.col("base_failed"))
    found = estimate(model.select(F.explode("groups").alias("group"), *NAMES))
    scale = chi_square(COVERAGE, len(NAMES))
    limit = slack * chi_square(confidence, len(NAMES))

    def measure(batch):
        _, distance = _distances(batch)
        distance /= np.maximum(batch.column("size").to_numpy() / scale, 1)
        small = batch.column("n").to_numpy() < least_rows
        return {
            **{c: batch.column(c) for c in ("row", *_COUNTS, "base_failed")},
            "distance": pa.array(distance, mask=small),
        }

    # There is no estimate where no row of the whole table met the base rules.
    empty = F.array(*[F.lit(0.0)] * len(NAMES)), F.array(*[F.lit(0.0)] * len(_PAIRS))
    judged = rows.join(found.select("group", "n", "m", "p", "size"), "group", "left").withColumns(
        {
            "n": F.coalesce("n", F.lit(0.0)), "size": F.coalesce("size", F.lit(1.0)),
            "m": F.coalesce("m", empty[0]), "p": F.coalesce("p", empty[1]),
        }
    )
    counts = "".join(f", {c} long" for c in _COUNTS)
    judged = judged.select("row", *_COUNTS, "base_failed", *NAMES, "n", "m", "p", "size").mapInArrow(
        in_arrow(measure), f"row {kind}{counts}, base_failed boolean, distance double"
    )
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return judged.select("row", *_COUNTS, "base_failed", "distance", kept.alias("kept"))
