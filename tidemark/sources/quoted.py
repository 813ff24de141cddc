"""Delimited text with line breaks inside quotes, read in many tasks.

Whether a line begins inside a quoted value depends on all lines before it. But what a run of lines
does to that state is a function of two possible states, and such functions compose: every input split
gives its own, one row each, and composing them in the order of a file's splits says which splits begin
inside quotes. With that, every task puts the records of its splits together alone; only a record that
crosses the end of a split travels, in pieces.
"""

import re
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F


class UnclosedQuote(ValueError):
    """A quote that is open at the end of a file."""


class LineStates:
    """What a line does to the state: 0 outside and 1 inside a quoted value."""

    def __init__(self, options):
        quote, escape = options.get("quote", '"'), options.get("escape", '"')
        separator = re.escape(options.get("sep", options.get("delimiter", ",")))
        self.quote = quote
        q, e = re.escape(quote), re.escape(escape)
        escaped = f"{q}{q}" if escape == quote else f"{e}.|{q}{q}"
        body = f"[^{q}{e}]*+(?:(?:{escaped})[^{q}{e}]*+)*+"
        rest = f"(?:(?!{separator}).)*+"
        field = f"(?:{q}{body}{q}{rest}|(?!{q}){rest})"
        closed = f"(?:{separator}{field})*+"
        # A line leaves no value open if all of it is fields; inside, after the end of the open one.
        self._outside = re.compile(f"{field}{closed}", re.DOTALL)
        self._inside = re.compile(f"{body}{q}{rest}{closed}", re.DOTALL)

    def after(self, state, line):
        pattern = self._inside if state else self._outside
        return 0 if pattern.fullmatch(line) else 1


def _lines(spark, path):
    # Lines end in a line feed alone, so that what stands inside a value stays as it is.
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def may_hold_line_breaks(spark, path, options):
    """Whether some line holds an odd number of quotes: without one, no value goes on in the next."""
    quote = F.lit(options.get("quote", '"'))
    value = F.col("value")
    if options.get("escape", '"') != options.get("quote", '"'):
        value = F.replace(value, F.concat(F.lit(options["escape"]), quote), F.lit(""))
    quotes = F.length(value) - F.length(F.replace(value, quote, F.lit("")))
    return bool(_lines(spark, path).agg(F.coalesce(F.max(quotes % 2), F.lit(0))).first()[0])


def _runs(batches):
    """Lines of one split that follow each other: file, block, lines, and which of them hold a quote."""
    for batch in batches:
        files, blocks = (batch.column(c).to_pylist() for c in ("file", "block"))
        lo = 0
        for hi in range(1, len(files) + 1):
            if hi == len(files) or (files[hi], blocks[hi]) != (files[lo], blocks[lo]):
                yield files[lo], blocks[lo], batch.column("value").slice(lo, hi - lo)
                lo = hi


def split_functions(spark, path, options):
    """``file``, ``block``, ``out0``, ``out1``: the state after a split that begins outside or inside,
    and ``breaks``: whether a value goes on in the next line, for a split that begins outside."""
    states = LineStates(options)

    def run(batches):
        split, out, breaks = None, [0, 1], False

        def row():
            columns = [[split[0]], [split[1]], [out[0]], [out[1]], [breaks]]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "out0", "out1", "breaks"]
            )

        for file, block, values in _runs(batches):
            if (file, block) != split:
                if split is not None:
                    yield row()
                split, out, breaks = (file, block), [0, 1], False
            quoted = values.filter(pc.match_substring(values, states.quote))
            for line in quoted.to_pylist():
                after = {state: states.after(state, line) for state in set(out)}
                out = [after[out[0]], after[out[1]]]
                breaks |= bool(out[0])
        if split is not None:
            yield row()

    return _lines(spark, path).mapInArrow(run, "file string, block long, out0 int, out1 int, breaks boolean")


def inside_splits(spark, path, options):
    """Splits that begin inside a quoted value as ``{(file, block)}``, or None if no value has a line break.

    One row for each split of the input comes to the driver.
    """
    rows = split_functions(spark, path, options).collect()
    inside, opened, state, last = set(), False, 0, None
    for row in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if row["file"] != last:
            if state:
                raise UnclosedQuote(f"a quote is not closed in {unquote(last)}")
            last, state = row["file"], 0
        if state:
            inside.add((row["file"], row["block"]))
        opened |= row["breaks"] or bool(state)
        state = row["out1"] if state else row["out0"]
    if state:
        raise UnclosedQuote(f"a quote is not closed in {unquote(last)}")
    return inside if opened else None


_PIECES = pa.schema(
    [
        ("file", pa.string()), ("block", pa.int64()), ("piece", pa.int64()), ("text", pa.string()),
        ("starts", pa.bool_()), ("ends", pa.bool_()), ("first", pa.bool_()),
    ]
)


def _pieces(spark, path, options, inside):
    """Records, and the pieces of those that cross the end of a split."""
    states = LineStates(options)

    def run(batches):
        split, state, piece, held, starts, rows = None, 0, 0, [], True, []

        def put(ends):
            rows.append((*split, piece, "\n".join(held), starts, ends, split[1] == 0 and piece == 0))

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES, strict=True)], schema=_PIECES
            )

        for file, block, values in _runs(batches):
            if (file, block) != split:
                if held:
                    put(False)
                split, piece, held = (file, block), 0, []
                state = int(split in inside)
                starts = not state
            quoted = pc.match_substring(values, states.quote).to_pylist()
            for line, has_quote in zip(values.to_pylist(), quoted, strict=True):
                held.append(line)
                if has_quote:
                    state = states.after(state, line)
                if not state:
                    put(True)
                    piece, held, starts = piece + 1, [], True
            if rows:
                yield batch()
                rows.clear()
        if held:
            put(False)
            yield batch()

    kinds = "file string, block long, piece long, text string, starts boolean, ends boolean, first boolean"
    return _lines(spark, path).mapInArrow(run, kinds)


def records(spark, path, options, inside):
    """``text`` of every record and ``first``: whether it is the first one of its file.

    Pieces of a record meet by the number of the record among those of its file that cross splits;
    there are at most two pieces for each split.
    """
    pieces = _pieces(spark, path, options, inside)
    whole = pieces.where("starts AND ends").select("text", "first")
    parts = pieces.where("NOT (starts AND ends)")
    order = Window.partitionBy("file").orderBy("block", "piece")
    parts = parts.withColumn("record", F.sum(F.col("starts").cast("int")).over(order))
    joined = parts.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "piece", "text"))).alias("parts"),
        F.bool_or("first").alias("first"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return whole.unionByName(joined.select(text.alias("text"), "first"))
