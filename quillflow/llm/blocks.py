"""Vectorised views of Arrow text columns.

An Arrow string column is one byte buffer plus offsets.  The helpers here find
words, hash spans and gather ragged ranges over that buffer with numpy, so that
no operator loops over words in Python.  Texts are taken in blocks of about
``BLOCK_BYTES``, always whole rows, which bounds the memory of a task by its
longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

U64 = np.uint64
_LENGTH, _PLACE, _JOIN = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xA24BAED4963EE407)
#: Sets the second hash apart from the first.
_ALTERNATE = U64(0x9FB21C651E98DF25)
#: Keeps the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans: true for the bytes that part words."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are ``[^\x20\x09-\x0D]+``.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xCA5A826395121157)
    h ^= h >> U64(32)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in this order."""
    return mix(a * _JOIN + b)


class Spans:
    """Hash of any span ``[s, e)`` of bytes.

    The sum of a span's words of 8 bytes, each mixed with its place; no step is
    linear in the bytes.  A span of up to 8 bytes is mixed one to one.
    """

    def __init__(self, data: np.ndarray, alternate: bool = False):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.words = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
        self.seed = _ALTERNATE if alternate else U64(0)

    def _rest(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of spans longer than 8 bytes: which they are, where each one's further words begin, each word's offset in its span, and its mask."""
        long = np.flatnonzero(n > 8)
        more = (n[long] - 1) >> 3
        first = np.cumsum(more) - more
        offset = (ragged(np.zeros(len(long), dtype=np.int64), more) + 1) << 3
        return long, first, offset, _FIRST_BYTES[np.minimum(np.repeat(n[long], more) - offset, 8)]

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        out = mix((self.words[starts] & _FIRST_BYTES[np.minimum(n, 8)]) ^ (n.astype(U64) * _LENGTH + self.seed))
        long, first, offset, mask = self._rest(n)
        if len(long):
            at = np.repeat(starts[long], (n[long] - 1) >> 3) + offset
            parts = mix((self.words[at] & mask) + offset.astype(U64) * _PLACE ^ self.seed)
            out[long] = joined(out[long], np.add.reduceat(parts, first))
        return out

    def equal(self, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes of another."""
        n = ends - starts
        out = (n == other_ends - others) & ((self.words[starts] ^ self.words[others]) & _FIRST_BYTES[np.minimum(n, 8)] == 0)
        own = np.flatnonzero(out & (n > 8))
        long, first, offset, mask = self._rest(n[own])
        if len(long):
            more = (n[own] - 1) >> 3
            unlike = (self.words[np.repeat(starts[own], more) + offset] ^ self.words[np.repeat(others[own], more) + offset]) & mask
            out[own] = np.bitwise_or.reduceat(unlike, first) == 0
        return out


def byte_hash(data: np.ndarray, alternate: bool = False) -> Spans:
    return Spans(data, alternate)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one span of each different string of bytes, and the place in that list of every span's string.

    Hashes propose the groups and bytes decide: a span that is unlike the one
    that stands for its group gets a group of its own bytes.
    """
    spans = byte_hash(data)
    _, example, inverse = np.unique(spans.span(starts, ends), return_index=True, return_inverse=True)
    which = example[inverse]
    wrong = np.flatnonzero(~spans.equal(starts, ends, starts[which], ends[which])).tolist()
    own: dict[bytes, int] = {}
    extra = []
    for i in wrong:
        word = data[starts[i] : ends[i]].tobytes()
        if word not in own:
            own[word] = len(example) + len(own)
            extra.append(i)
        inverse[i] = own[word]
    return np.concatenate([example, np.array(extra, dtype=example.dtype)]), inverse


class Sequence:
    """Hash of any span ``[s, e)`` of one or more hashes.

    A run of a power of two is hashed from its two halves, level by level; a
    span by the two such runs that cover it, and its length.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(joined(below[: max(0, len(below) - half)], below[half:]))
        return self.levels[k]

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        size = np.frexp(n.astype(np.float64))[1] - 1
        out = np.empty(len(n), dtype=U64)
        for k in np.unique(size).tolist():
            own, level = np.flatnonzero(size == k), self._level(k)
            out[own] = joined(level[starts[own]] ^ n[own].astype(U64), level[ends[own] - (1 << k)])
        return out

    def runs(self, n: int) -> np.ndarray:
        """``span(i, i + n)`` for every i, up to a factor that all share."""
        k = n.bit_length() - 1
        level, rest = self._level(k), n - (1 << k)
        return joined(level[: len(level) - rest], level[rest:]) if rest else level


class Block:
    """Whole rows ``lo .. hi`` of a batch: bytes and their row offsets."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words; ``first[r]`` is row r's first word."""
        inside = ~table[self.data]
        n = len(inside)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.rows + 1, dtype=np.int64)
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        edges = self.offsets[:-1]
        before[edges[edges < n]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        edges = self.offsets[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[r]:first[r + 1]]`` for every row r."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def row_of(first: np.ndarray) -> np.ndarray:
    """Row of every element, given the bounds of the rows."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def squeezed(values: np.ndarray, kind: type) -> bytes:
    """Bytes of numbers, by planes, compressed."""
    raw = np.ascontiguousarray(values, dtype=kind)
    return pa.compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes(), "zstd", asbytes=True) if len(raw) else b""


def released(data: bytes, kind: type, n: int) -> np.ndarray:
    """The ``n`` numbers that were ``squeezed``."""
    if not n:
        return np.zeros(0, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
