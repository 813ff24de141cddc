"""Fill-in-middle: texts cut at two line ends, their parts reordered behind marks, and restored.

A whole Arrow batch is reordered at once. Its bytes are one array; scanning it for line feeds gives
the cuts of every row. Each part of a row moves by one displacement, which is written as differences
at the parts' first bytes; their running sum is the displacement of every byte, and one scatter
builds all outputs. Restoring finds the marks and gathers the bytes with the inverse displacements.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.linestats import sums
from tidemark.llm.words import column_bytes, slices

#: Marks of prefix, suffix and middle, and the forms; fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
MARK = len(PREFIX)
_MIDDLE_BYTE = np.isin(np.arange(256), [PREFIX[1], SUFFIX[1], MIDDLE[1]])


def draws(id_column, seed):
    """Four numbers below 2**32 for each row, from the hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def marks(data, offsets):
    """Positions at which one of the three marks begins within a row, and these rows."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = (data[:-2] == PREFIX[0]) & _MIDDLE_BYTE[data[1:-1]] & (data[2:] == PREFIX[2])
    at = np.flatnonzero(opened)
    row = np.searchsorted(offsets, at, side="right") - 1
    whole = at + MARK <= offsets[row + 1]
    return at[whole], row[whole]


def line_cuts(data, offsets):
    """Number of lines of every row, and a function that gives the end of the k-th of each."""
    breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(breaks, offsets)
    ended = np.diff(before)
    lo, hi = offsets[:-1], offsets[1:]
    last = np.zeros(len(lo), np.uint8)
    filled = hi > lo
    last[filled] = data[hi[filled] - 1]
    lines = ended + (filled & (last != 0x0A))

    def end(k):
        at = np.minimum(before[:-1] + np.maximum(k - 1, 0), max(len(breaks) - 1, 0))
        within = breaks[at] + 1 if len(breaks) else lo
        return np.where(k == 0, lo, np.where(k <= ended, within, hi))

    return lines, end


def displacements(starts, moves, size):
    """For every position the move of its part: ``starts`` ascend, equal ones are empty parts."""
    jump = np.zeros(size + 1, np.int64)
    np.add.at(jump, starts, np.diff(moves, prepend=0))
    return np.cumsum(jump[:-1])


def _interleaved(*columns):
    return np.column_stack(columns).ravel()


def scatter(data, offsets, first, second, form):
    """Output bytes and offsets of rows whose middle is ``first:second``; ``form`` 0 plain, 1 psm, 2 spm."""
    lo, hi = offsets[:-1], offsets[1:]
    marked = form > 0
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(hi - lo + 3 * MARK * marked, out=out[1:])
    base = out[:-1]
    p, s = first - lo, hi - second
    psm = form == 1
    to_p = np.where(psm, base + MARK, base + 2 * MARK + s)
    to_s = np.where(psm, base + 2 * MARK + p, base + MARK)
    to_m = base + 3 * MARK + p + s
    plain = base - lo
    moves = _interleaved(
        np.where(marked, to_p - lo, plain),
        np.where(marked, to_m - first, plain),
        np.where(marked, to_s - second, plain),
    )
    moved = displacements(_interleaved(lo, first, second), moves, len(data))
    built = np.empty(out[-1], np.uint8)
    built[np.arange(len(data)) + moved] = data
    for mark, at in ((PREFIX, to_p), (SUFFIX, to_s), (MIDDLE, to_m)):
        built[(at[marked] - MARK)[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    return built, out


def gather(data, offsets, form):
    """Texts' bytes and offsets from outputs and their forms."""
    lo, hi = offsets[:-1], offsets[1:]
    marked = np.flatnonzero(form > 0)
    at, row = marks(data, offsets)
    at, row = at[form[row] > 0], row[form[row] > 0]
    if not np.array_equal(row, np.repeat(marked, 3)):
        raise ValueError("an output that is not plain must hold each mark once")
    at = at.reshape(-1, 3)
    psm = form[marked] == 1
    kinds = np.where(psm[:, None], list(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2]), list(SUFFIX[1:2] + PREFIX[1:2] + MIDDLE[1:2]))
    if not np.array_equal(data[at + 1], kinds):
        raise ValueError("marks do not follow the form")
    ends = np.column_stack([at[:, 1:], hi[marked]])
    begins, sizes = at + MARK, ends - at - MARK
    order = np.where(psm, 0, 1)  # the prefix is the first or the second part of an output
    each = np.arange(len(marked))
    p_from, p = begins[each, order], sizes[each, order]
    s_from = begins[each, 1 - order]
    m_from, m = begins[:, 2], sizes[:, 2]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(hi - lo - 3 * MARK * (form > 0), out=out[1:])
    base = out[:-1]
    starts, moves = np.column_stack([base] * 3), np.column_stack([lo - base] * 3)
    own = base[marked]
    starts[marked] = np.column_stack([own, own + p, own + p + m])
    moves[marked] = np.column_stack([p_from, m_from, s_from]) - starts[marked]
    moved = displacements(starts.ravel(), moves.ravel(), int(out[-1]))
    return data[np.arange(out[-1]) + moved], out


def _texts(data, offsets):
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _transformed(part, rate, spm_rate):
    data, offsets = column_bytes(part.column("text"))
    h = [part.column(f"h{i}").to_numpy() for i in range(4)]
    lines, end = line_cuts(data, offsets)
    a, b = h[0] % (lines + 1), h[1] % (lines + 1)
    first, second = end(np.minimum(a, b)), end(np.maximum(a, b))
    lo, hi = offsets[:-1], offsets[1:]
    held = np.zeros(len(lo), bool)
    held[marks(data, offsets)[1]] = True
    plain = (lo == hi) | held | (h[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_rate, 2, 1))
    built, out = scatter(data, offsets, first, second, form)
    begun = (data & 0xC0) != 0x80
    chars = [pa.array(sums(begun, *pair), pa.int64(), mask=plain) for pair in ((lo, first), (first, second))]
    forms = pa.array(np.array([PLAIN, PSM, SPM], object)[form], pa.string())
    columns = [part.column("row"), pa.array(lines, pa.int64()), forms, *chars, _texts(built, out).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["row", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs, seed=7, rate=100, spm_rate=50, id_column="doc_id", text_column="text"):
    """Every text with its middle moved to the end.

    ``rate`` of 100 rows are transformed, ``spm_rate`` of 100 of these with the suffix first; the
    rest, empty and null texts, and texts that hold a mark stay plain. Cuts fall on line ends and
    depend on ``seed`` and the id alone; rows without an id are drawn as if it were empty, so
    repeated rows are alike. Returns ``row`` (a struct of all given columns but the text), ``n``
    (lines), ``form``, ``prefix_chars`` and ``middle_chars`` (code points, null if plain) and
    ``output``. Whole texts are moved in numpy, one batch of about half a megabyte or one long text
    at a time.
    """
    numbers = [h.alias(f"h{i}") for i, h in enumerate(draws(id_column, seed))]
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text_column]).alias("row"),
        F.col(text_column).alias("text"),
        *numbers,
    )

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield _transformed(part, rate, spm_rate)

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(frame, output_column="output", form_column="form"):
    """The frame with ``restored``, the exact text of each output; null outputs count as empty.

    Outputs whose marks do not fit their form are refused.
    """
    known = {PLAIN: 0, PSM: 1, SPM: 2}

    def run(batches):
        for batch in batches:
            for part in slices(batch, output_column):
                data, offsets = column_bytes(part.column(output_column))
                form = np.array([known[f] for f in part.column(form_column).to_pylist()], np.int64)
                texts = _texts(*gather(data, offsets, form)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{fields}, restored string")
