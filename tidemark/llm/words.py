"""Words, windows and hashes of whole Arrow batches in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; as these are ASCII, working on UTF-8 bytes gives the words of the text. A null text counts
as empty. Batches are cut by bytes, so that memory follows the longest text and not the batch.
"""

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base, n, known={}):
    have = known.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:  # those of a very long text are not kept
            known[base] = have
    return have[:n]


#: Odd bases with their inverses modulo 2**64, one pair for each of two independent hashes.
_BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
BYTE_KEYS = tuple(
    np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64)
    for seed in (11, 12)
)


def mix(x):
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges_hash(values, starts, ends, which):
    """Hash of values[starts:ends] for each range, from one running sum."""
    base, inverse = _BASES[which]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(inverse, len(values) + 1)[starts])


def column_bytes(column):
    """Bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch, text="text", limit=SLICE_BYTES):
    """The batch in runs of rows that hold about ``limit`` bytes of text each."""
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


class Words:
    """The words of a text column.

    ``starts`` and ``ends`` are byte positions; words ``first[i]:first[i + 1]`` belong to row i.
    """

    def __init__(self, column, lower=False):
        data, self.offsets = column_bytes(column)
        self.data = _LOWER[data] if lower else data
        space = _IS_SPACE[data]
        solid = ~space
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        filled = self.offsets[:-1][self.offsets[1:] > self.offsets[:-1]]
        begin[filled] = solid[filled]
        last = self.offsets[1:][self.offsets[1:] > self.offsets[:-1]] - 1
        end[last] = solid[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._hashes = {}

    def hashes(self, which=0):
        """64-bit hash of every word."""
        if which not in self._hashes:
            values = BYTE_KEYS[which][self.data]
            self._hashes[which] = ranges_hash(values, self.starts, self.ends, which)
        return self._hashes[which]

    def windows(self, size, which=0):
        """Hashes of all runs of ``size`` words within one row, and the word each begins at."""
        n = len(self.starts)
        room = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(room >= size)
        return ranges_hash(self.hashes(which), at, at + size, which), at

    def hash_at(self, at, size, which=0):
        """Hashes of the runs of ``size`` words that begin at the given words."""
        return ranges_hash(self.hashes(which), at, at + size, which)

    def whole(self, which=0):
        """Hash of all words of every row."""
        return ranges_hash(self.hashes(which), self.first[:-1], self.first[1:], which)

    def row_of(self, word):
        return np.searchsorted(self.first, word, side="right") - 1


def signed(x):
    """Unsigned hashes as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
