"""Counts of texts and of their lines, for whole Arrow batches."""

import numpy as np

from tidemark.llm.words import BYTE_KEYS, mix, ranges_hash

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_PUNCT = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])
_IS_DIGIT = np.array([48 <= i < 58 for i in range(256)])
_IS_UPPER = np.array([65 <= i < 91 for i in range(256)])


def sums(mask, bounds_lo, bounds_hi):
    """Number of set values within each range."""
    held = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=held[1:])
    return held[bounds_hi] - held[bounds_lo]


def character_masks(data):
    """Characters (their first bytes), and among them upper-case letters of ASCII and Latin-1."""
    first = (data & 0xC0) != 0x80
    upper = _IS_UPPER[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        upper[:-1] |= latin
    return first, upper


def in_row(hashes, row):
    return mix(hashes ^ mix(row.astype(np.uint64)))


def repeated_words(words, size=5):
    """Which words lie in a run of ``size`` words that its text holds twice or more."""
    hashes, at = words.windows(size)
    keys = in_row(hashes, words.row_of(at))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.starts) + 1, np.int64)
    edge[at[twice]] += 1
    np.add.at(edge, at[twice] + size, -1)
    return np.cumsum(edge[:-1]) > 0


class Lines:
    """The lines that hold a word: byte range, row, and hash of the whole line."""

    def __init__(self, words):
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 0x0A)
        self.starts = np.union1d(breaks + 1, offsets[:-1])
        self.starts = self.starts[self.starts < len(data)]
        row = np.searchsorted(offsets, self.starts, side="right") - 1
        following = np.append(breaks, len(data))[np.searchsorted(breaks, self.starts)]
        self.ends = np.minimum(following, offsets[row + 1])
        first = np.searchsorted(words.starts, self.starts)
        last = np.searchsorted(words.starts, self.ends)
        filled = last > first
        self.starts, self.ends = self.starts[filled], self.ends[filled]
        self.first, self.last = first[filled], last[filled]
        self.row = row[filled]
        self.hashes = ranges_hash(BYTE_KEYS[0][data], self.starts, self.ends, 0)

    def duplicates(self, rows):
        """Lines of each row that equal an earlier one."""
        distinct = np.unique(in_row(self.hashes, self.row), return_index=True)[1]
        again = np.ones(len(self.row), bool)
        again[distinct] = False
        return np.bincount(self.row[again], minlength=rows)
