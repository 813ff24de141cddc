"""Token ids of whole texts, and files that hold ids in the fewest bits of the vocabulary.

Encoding. A tokenizer's text is cut into pieces at places where its own pattern always cuts: before
white space that follows a solid character, and between a letter or digit and punctuation. The
tokenizers library encodes each different piece of a slice; a worker remembers those that it met
in an earlier slice too, up to a bounded number, as most pieces come once. They are found by hash
and compared by bytes, all of a slice at once. Rows that hold a special token's text are encoded
whole. The ids are those of the whole text.

Files. Each file has blocks of ``BLOCK_IDS`` ids packed at a fixed width, then a footer with the
rows (id, first token) and the byte offset of every block, then a trailer of fixed size. A reader
finds any row's ids from the footer and unpacks only the blocks that hold them.
"""

import itertools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_path, text_batches
from tidemark.llm.words import BYTE_KEYS, column_bytes, ranges_hash, slices

BLOCK_IDS = 1 << 14
MAGIC = b"IDBITS01"
TRAILER = struct.Struct("<8sQQ")
MEMO_PIECES = 600_000
#: Pieces of one call of the tokenizers library, whose results take about 1 KB each.
PIECES_AT_ONCE = 4_000
ENCODED_BYTES = 1 << 20
#: Marks of pieces met before, by hash; two pieces with one mark are remembered a slice sooner.
MARKS = 1 << 22

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACE_OR_LINE = np.zeros(256, bool)
_SPACE_OR_LINE[[0x20, 0x0A]] = True
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_PUNCT = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])
#: First bytes of the UTF-8 characters among which there is white space beyond ASCII.
_SPACE_LEADS = np.zeros(256, bool)
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _lead(data, at):
    """First byte of the character that ends just before each position."""
    lead = data[at - 1]
    for step in (2, 3, 4):
        inner = (lead & 0xC0) == 0x80
        if not inner.any():
            break
        lead = np.where(inner, data[np.maximum(at - step, 0)], lead)
    return lead


def piece_bounds(data, offsets, drop_space):
    """Where pieces begin; with ``drop_space`` also where the white space between them begins."""
    space = (_ASCII_SPACE if drop_space else _SPACE_OR_LINE)[data]
    bound = np.zeros(len(data) + 1, bool)
    if drop_space:
        bound[1:-1] = space[1:] != space[:-1]
    else:
        at = np.flatnonzero(space[1:] & ~_ASCII_SPACE[data[:-1]]) + 1
        before, lead = data[at - 1], _lead(data, at)
        solid = np.where(before < 128, (before > 32) & (before < 127), ~_SPACE_LEADS[lead])
        bound[at[solid]] = True
    at = np.flatnonzero(_PUNCT[data[1:]] & ~_PUNCT[data[:-1]] & ~space[:-1]) + 1
    before = data[at - 1]
    # Letters from U+00C0 to U+00FF: all but the two signs for times and divided by.
    latin = (_lead(data, at) == 0xC3) & (before != 0x97) & (before != 0xB7)
    bound[at[np.where(before < 128, _ALNUM[before], latin)]] = True
    bound[offsets] = True
    return np.flatnonzero(bound), space


class Encoder:
    """A tokenizer of the tokenizers library with a memory of pieces."""

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A tokenizer that drops white space can be cut on both sides of it.
        normalizer = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.drop_space = any(
            step.get("type") == "Lowercase" for step in normalizer.get("normalizers", [normalizer])
        )
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content.encode() for token in special]
        self._forget()

    def _forget(self):
        self.n, self.used, self.met = 0, 0, np.zeros(MARKS, bool)
        # Of each remembered piece, by number: where its ids begin and how many, where its bytes end.
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ends, self.bytes = np.zeros((1 << 16) + 1, np.int64), np.zeros(1 << 19, np.uint8)
        self.pool = np.zeros(1 << 18, np.uint32)
        # The hashes in ascending order, and the number of the piece that has each.
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _grown(self, array, n):
        if n <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(n - len(array), len(array) // 2), array.dtype)])

    def _pieces(self):
        """The bytes of all remembered pieces, by number."""
        buffers = [None, pa.py_buffer(self.ends), pa.py_buffer(self.bytes)]
        return pa.Array.from_buffers(pa.large_binary(), self.n, buffers)

    @property
    def known(self):
        """The remembered pieces with their numbers."""
        return {piece: number for number, piece in enumerate(self._pieces().to_pylist())}

    def _find(self, pieces, hashes):
        """The number of the remembered piece with each hash, -1 if there is none; whether it is
        the piece itself."""
        if not self.n:
            return np.full(len(hashes), -1), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        number = np.where(self.hashes[place] == hashes, self.numbers[place], -1)
        same = number >= 0
        at = np.flatnonzero(same)
        equal = pc.equal(self._pieces().take(pa.array(number[at])), pieces.take(pa.array(at)))
        same[at] = equal.to_numpy(zero_copy_only=False)
        return number, same

    def _encode(self, pieces):
        """Put the ids of pieces into the pool after those in use; the number of ids of each."""
        sizes, used = [np.zeros(0, np.int64)], self.used
        for lo in range(0, len(pieces), PIECES_AT_ONCE):
            texts = pieces.slice(lo, PIECES_AT_ONCE).cast(pa.large_string()).to_pylist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            n = int(sizes[-1].sum())
            self.pool = self._grown(self.pool, used + n)
            self.pool[used : used + n] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, n)
            used += n
        return np.concatenate(sizes)

    def _remember(self, pieces, hashes, sizes):
        """Remember pieces whose ids come first in the pool after those in use."""
        data, offsets = column_bytes(pieces)
        n, at = self.n + len(sizes), self.ends[self.n]
        self.begin, self.size = self._grown(self.begin, n), self._grown(self.size, n)
        self.begin[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.ends, self.bytes = self._grown(self.ends, n + 1), self._grown(self.bytes, at + len(data))
        self.ends[self.n + 1 : n + 1] = at + offsets[1:]
        self.bytes[at : at + len(data)] = data
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.numbers = np.insert(self.numbers, place, self.n + order)
        self.n, self.used = n, self.used + int(sizes.sum())

    def _met(self, hashes):
        """Whether pieces came in an earlier slice; marks them."""
        at = (hashes % np.uint64(MARKS)).astype(np.int64)
        met = self.met[at]
        self.met[at] = True
        return met

    def encode(self, column):
        """Ids of all rows in one array, and the number of ids of each row; null is empty."""
        data, offsets = column_bytes(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        raw = data.tobytes()
        whole = np.zeros(rows, bool)
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        bounds, space = piece_bounds(data, offsets, self.drop_space)
        begin, end = bounds[:-1], bounds[1:]
        row = np.searchsorted(offsets, begin, side="right") - 1
        wanted = ~whole[row]
        if self.drop_space:
            wanted &= ~space[begin]
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]
        ).filter(pa.array(wanted))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        if self.n + len(distinct) > MEMO_PIECES:
            self._forget()
        data, ends = column_bytes(distinct)
        hashes = ranges_hash(BYTE_KEYS[0][data], ends[:-1], ends[1:], 0)
        number, known = self._find(distinct, hashes)
        new = np.flatnonzero(~known)
        # A piece whose hash another one has is not remembered, but encoded anew.
        again = self._met(hashes[new]) & (number[new] < 0)
        new = np.concatenate([new[again], new[~again]])
        fresh = self._encode(distinct.take(pa.array(new)))
        first, size = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        first[known], size[known] = self.begin[number[known]], self.size[number[known]]
        first[new], size[new] = self.used + np.cumsum(fresh) - fresh, fresh
        n = np.count_nonzero(again)
        if n:
            self._remember(distinct.take(pa.array(new[:n])), hashes[new[:n]], fresh[:n])
        code = coded.indices.to_numpy()
        sizes = size[code]
        ends = np.cumsum(sizes)
        ids = self.pool[
            np.repeat(first[code] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        ]
        counts = np.bincount(row[wanted], weights=sizes, minlength=rows).astype(np.int64)
        return (ids, counts) if not whole.any() else self._with_whole(column, whole, ids, counts)

    def _with_whole(self, column, whole, ids, counts):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for at in np.flatnonzero(whole).tolist():
            text = column[at].as_py()
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            parts[at] = np.array(found, np.uint32)
        return np.concatenate(parts), np.array([len(part) for part in parts], np.int64)


_encoders = {}


def encoder(path):
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_rows(batch, path, end_id):
    """For each slice of a batch: the slice, all ids with ``end_id`` after each row, row sizes."""
    coder = encoder(path)
    for part in slices(batch, limit=ENCODED_BYTES):
        ids, counts = coder.encode(part.column("text"))
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = ids
        yield part, out, counts + 1


# --- bit packing ---------------------------------------------------------------------


def bits_for(vocabulary):
    """Least width that holds the ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids, bits):
    """Ids at ``bits`` bits each; 64 ids fill ``bits`` words of 64 bits."""
    groups = -(-len(ids) // 64)
    table = np.zeros((groups, 64), np.uint64)
    table.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), "<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= table[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= table[:, i] >> np.uint64(64 - shift)
    return words.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data, bits, n):
    """The ``n`` ids of packed bytes."""
    groups = -(-n // 64)
    words = np.frombuffer(data.ljust(groups * bits * 8, b"\0"), "<u8").reshape(groups, bits)
    table = np.zeros((groups, 64), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        table[:, i] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            table[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    mask = np.uint64((1 << bits) - 1)
    return (table.reshape(-1)[:n] & mask).astype(np.uint32)


class TokenFileWriter:
    """Writes one file of packed ids; it appears under its name only when it is complete."""

    def __init__(self, uri, bits):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.bits = bits
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else os.getpid()
        folder, name = os.path.split(self.path)
        self.partial = f"{folder}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.partial)
        self.blocks, self.at, self.rest = [], 0, np.zeros(0, np.uint32)
        self.ids, self.nulls, self.sizes = [], [], []

    def add(self, row_ids, ids, sizes):
        self.ids.append(row_ids.fill_null(0).to_numpy())
        self.nulls.append(row_ids.is_null().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes)
        rest = np.concatenate([self.rest, ids])
        full = len(rest) // BLOCK_IDS * BLOCK_IDS
        for lo in range(0, full, BLOCK_IDS):
            self._block(rest[lo : lo + BLOCK_IDS])
        self.rest = rest[full:]

    def _block(self, ids):
        data = pack(ids, self.bits)
        self.out.write(data)
        self.blocks.append(self.at)
        self.at += len(data)

    def close(self):
        if len(self.rest):
            self._block(self.rest)
        ids, nulls, sizes = map(np.concatenate, (self.ids, self.nulls, self.sizes))
        ends = np.cumsum(sizes)
        footer = struct.pack("<QQQQQ", self.bits, BLOCK_IDS, len(ids), len(self.blocks), ends[-1])
        footer += ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes()
        footer += (ends - sizes).astype("<u8").tobytes()
        footer += np.array(self.blocks, "<u8").tobytes()
        self.out.write(footer)
        self.out.write(TRAILER.pack(MAGIC, self.at, len(footer)))
        self.out.close()
        self.fs.move(self.partial, self.path)
        return len(ids), int(ends[-1])


class TokenFile:
    """Random access to the ids of a file's rows."""

    def __init__(self, uri):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        magic, at, size = TRAILER.unpack(self.file.read_at(TRAILER.size, end - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        footer = self.file.read_at(size, at)
        self.bits, self.block, rows, blocks, self.total = struct.unpack_from("<QQQQQ", footer)
        at = 40
        self.row_ids = np.frombuffer(footer, "<i8", rows, at)
        self.nulls = np.frombuffer(footer, "u1", rows, at + 8 * rows).astype(bool)
        self.starts = np.frombuffer(footer, "<u8", rows, at + 9 * rows).astype(np.int64)
        self.blocks = np.frombuffer(footer, "<u8", blocks, at + 17 * rows)
        self.ends = np.append(self.starts[1:], self.total).astype(np.int64)

    def ids(self, start, end):
        """The ids at positions ``start`` to ``end``."""
        first = start // self.block
        last = max(first, (end - 1) // self.block)
        parts = []
        for block in range(first, min(last + 1, len(self.blocks))):
            n = min(self.block, self.total - block * self.block)
            data = self.file.read_at(-(-n * self.bits // 8), int(self.blocks[block]))
            parts.append(unpack(data, self.bits, n))
        found = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return found[start - first * self.block : end - first * self.block]

    def row(self, number):
        return self.ids(int(self.starts[number]), int(self.ends[number]))


def _crcs(ids, sizes):
    data, at = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(sizes) * 4])
    return [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def write_tokens(docs, tokenizer, uri, end_id=0, id_column="doc_id", text_column="text"):
    """Write the ids of all texts in files below ``uri``, in ascending order of ids.

    Every row ends with ``end_id``. Rows are dealt by range of their id; one partition makes one
    file, written under a hidden name and renamed when complete, so a task that runs again leaves
    the same file. Returns a frame with one row per file: ``file``, ``n_rows``, ``n_ids``. A null
    text is empty. Rows without an id come first; rows that share an id stand next to each other.
    """
    from tokenizers import Tokenizer

    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    order = ["id", F.xxhash64("text")]
    schema = pa.schema([("file", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        name = f"part-{TaskContext.get().partitionId():08d}.bits"
        writer = None
        for batch in batches:
            for part, ids, sizes in encoded_rows(batch, tokenizer, end_id):
                writer = writer or TokenFileWriter(f"{uri}/{name}", bits)
                writer.add(part.column("id"), ids, sizes)
        if writer:
            n_rows, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "n_rows": [n_rows], "n_ids": [n_ids]}, schema=schema
            )

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = dealt.mapInArrow(run, "file string, n_rows long, n_ids long")
    index = f"{uri}/index.parquet"
    with text_batches(docs.sparkSession):
        files.write.parquet(index)
    return docs.sparkSession.read.parquet(index)


def read_tokens(files, uri):
    """One row per stored row: ``id``, ``start`` (ids before it in all files), ``n_tokens``,
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers)."""
    # One row per file: the running sum is over file sizes only.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # One task for each file, which holds one partition of the rows.
    files = files.repartition(max(files.count(), 1), "file")
    schema = pa.schema(
        [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches):
        for batch in batches:
            for name, before in zip(
                batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True
            ):
                file = TokenFile(f"{uri}/{name}")
                lo = 0
                while lo < len(file.starts):
                    hi = int(np.searchsorted(file.ends, file.starts[lo] + (1 << 20), side="right"))
                    hi = max(hi, lo + 1)
                    ids = file.ids(int(file.starts[lo]), int(file.ends[hi - 1]))
                    sizes = file.ends[lo:hi] - file.starts[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.row_ids[lo:hi], mask=file.nulls[lo:hi]),
                            pa.array(file.starts[lo:hi] + before),
                            pa.array(sizes),
                            pa.array(_crcs(ids, sizes), pa.int64()),
                        ],
                        schema=schema,
                    )
                    lo = hi

    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark):
    """A new folder for token files on the shared storage."""
    return fresh_path(spark, "tokens")
