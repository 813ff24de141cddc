"""Removal of passages that stand in an earlier document too, found by level-wise doubling.

Lengths double up to the wanted window: for 13 words they are 7 and 13. A window of one length
can only repeat if the shorter windows in it do, so each level looks at the windows around those
that repeated at the level before, and the search ends when none is left.

The first level does not need every short window. Of the short windows inside a full one, the one
with the least hash is chosen; that choice depends on the words alone, so both places of a repeated
passage choose the same one. About a quarter of the positions remain.
"""

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tidemark.llm.shared import stored
from tidemark.llm.words import Words, mix, signed, slices

_HUGE = np.uint64(0xFFFFFFFFFFFFFFFF)


def lengths(window, least=7):
    """Lengths of the levels: halves of the window, rounded up, down to ``least`` or less; two at least."""
    found = [window]
    while found[0] > least or len(found) < 2:
        found.insert(0, (found[0] + 1) // 2)
    return found


def chosen(words, size, window):
    """Positions of the short windows that full windows choose, and all short hashes."""
    n = len(words.starts)
    hashes = np.full(n, _HUGE, np.uint64)
    found, at = words.windows(size)
    hashes[at] = found
    room = np.repeat(words.first[1:], words.counts) - np.arange(n)
    begin = np.flatnonzero(room >= window)
    least, best = hashes[begin], begin
    for step in range(1, window - size + 1):
        other = hashes[begin + step]
        less = other < least
        least, best = np.where(less, other, least), np.where(less, begin + step, best)
    picked = np.zeros(n, bool)
    picked[best] = True
    return np.flatnonzero(picked), hashes


def _first_level(size, window):
    schema = pa.schema([("hash", pa.int64()), ("key", pa.int64())])

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch):
                keys = part.column("key").to_numpy()
                fresh = np.array([k not in seen and not seen.add(k) for k in keys.tolist()])
                words = Words(part.column("text"))
                at, hashes = chosen(words, size, window)
                row = np.repeat(np.arange(len(keys)), words.counts)[at]
                at, row = at[fresh[row]], row[fresh[row]]
                # A window that a text repeats is one row: only sets of hashes are asked for.
                found = signed(hashes[at])
                order = np.lexsort((found, row))
                found, row = found[order], row[order]
                first = np.ones(len(found), bool)
                first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([found[first], keys[row[first]]], schema=schema)

    return run


def _next_level(size, window):
    """Hashes of the full windows around marked short ones, with the document they stand in."""
    schema = pa.schema([("hash", pa.int64()), ("more", pa.int32()), ("doc", pa.int64())])

    def run(batches):
        for batch in batches:
            own = pc.equal(batch.column("doc"), batch.column("first")).fill_null(False)
            batch = batch.filter(pc.and_(own, pc.is_valid(batch.column("marks"))))
            for part in slices(batch):
                words = Words(part.column("text"))
                marks, row = _listed(part.column("marks"))
                short, at = words.windows(size)
                hit = np.zeros(len(words.starts) + 1, np.int64)
                hit[at + 1] = np.isin(_in_row(short, words.row_of(at)), _in_row(marks, row))
                held = np.cumsum(hit)
                n = len(words.starts)
                room = np.repeat(words.first[1:], words.counts) - np.arange(n)
                begin = np.flatnonzero(room >= window)
                begin = begin[held[begin + window - size + 1] > held[begin]]
                full, more = words.hash_at(begin, window, 0), words.hash_at(begin, window, 1)
                docs = part.column("first").to_numpy()[words.row_of(begin)]
                found = np.unique(
                    np.rec.fromarrays([signed(full), more.astype(np.uint32).view(np.int32), docs])
                )
                # Passed on slice by slice: the windows of a whole batch can be many times its text.
                columns = [np.ascontiguousarray(found[name]) for name in found.dtype.names]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _listed(column):
    """Values of a column of lists, and the row of each."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _in_row(hashes, row):
    return mix(hashes.view(np.uint64) ^ mix(row.astype(np.uint64)))


def _rebuilt(window, with_text):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                gone = _gone(words, part, window)
                removed, digests, kept = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    lost = gone[words.first[i] : words.first[i + 1]]
                    left = (text or "").encode().split()
                    if lost.any():
                        left = itertools.compress(left, (~lost).tolist())
                    left = b" ".join(left)
                    removed.append(int(lost.sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if removed[-1] else text)
                columns = {
                    "row": part.column("row"),
                    "n_words": pa.array(words.counts, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string()),
                }
                if with_text:
                    columns["kept_text"] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _gone(words, part, window):
    """Which words are covered by a window of an earlier document."""
    marks, row = _listed(part.column("repeats"))
    full, at = words.windows(window)
    at = at[np.isin(_in_row(full, words.row_of(at)), _in_row(marks, row))]
    doc, first = part.column("doc"), part.column("first")
    copy = pc.greater(doc, first).fill_null(False).to_numpy(zero_copy_only=False)
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    gone |= np.repeat(copy & (words.counts >= window), words.counts)
    # The marks are those of the text's first document; a row without an id has none.
    return gone & np.repeat(doc.is_valid().to_numpy(zero_copy_only=False), words.counts)


def remove_repeated(docs, window=13, id_column="doc_id", text_column="text", with_text=True):
    """Take out every word covered by a window of words that an earlier document has as well.

    Earlier means a smaller id. Windows are judged on the texts as given. Returns ``row`` (a
    struct of all given columns but the text, so that no name can clash), ``n_words``,
    ``n_removed``, ``kept_sha256`` (of the words that stay, joined by one space) and with
    ``with_text`` also ``kept_text``: these joined words, or the text as it was if none went.

    Null or empty texts have no words. Texts shorter than the window, rows without an id and rows
    that share an id and text lose nothing to each other. An exact copy of an earlier text of at
    least one window loses all its words.
    """
    size, *rest = lengths(window)
    text = F.col(text_column)
    base = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(id_column).cast("long").alias("doc"),
        text.alias("text"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(text, F.lit("again")).alias("again"),
    )
    texts = base.groupBy("key", "again").agg(F.min("doc").alias("first"))

    anchors = base.select("key", "text").mapInArrow(
        _first_level(size, rest[0]), "hash long, key long"
    )
    shared = anchors.groupBy("hash").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = shared.where("low < high").select("hash")
    marks = anchors.join(shared, "hash").groupBy("key").agg(F.collect_set("hash").alias("marks"))
    texts = stored(texts.join(marks, "key", "left"), "texts")

    # No id of a text is below its first one. Copies need no hashes, which would come once a copy.
    first_row = F.col("doc") <= F.col("first")
    repeats = None
    while rest:
        longer = rest.pop(0)
        joined = base.join(texts, ["key", "again"], "left")
        joined = joined.withColumn("text", F.when(first_row, F.col("text")))
        joined = joined.withColumn("marks", F.when(first_row, F.col("marks")))
        windows = joined.mapInArrow(_next_level(size, longer), "hash long, more int, doc long")
        size = longer
        spread = windows.groupBy("hash", "more").agg(
            F.min("doc").alias("low"), F.max("doc").alias("high")
        )
        found = windows.join(spread.where("low < high"), ["hash", "more"])
        if rest:
            found = found.groupBy(F.col("doc").alias("first")).agg(
                F.collect_set("hash").alias("marks")
            )
            texts = stored(texts.drop("marks").join(found, "first", "left"), "texts")
        else:
            repeats = found.where("low < doc").groupBy(F.col("doc").alias("first"))
            repeats = repeats.agg(F.collect_set("hash").alias("repeats"))

    placed = base.join(
        texts.select("key", "again", "first").join(repeats, "first", "left"),
        ["key", "again"],
        "left",
    ).withColumn("repeats", F.when(first_row, F.col("repeats")))
    row = base.schema["row"].dataType.simpleString()
    result = f"row {row}, n_words long, n_removed long, kept_sha256 string"
    result += ", kept_text string" if with_text else ""
    return placed.mapInArrow(_rebuilt(window, with_text), result)
