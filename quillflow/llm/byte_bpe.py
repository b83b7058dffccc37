"""Byte-level BPE by a rank file: encoding and decoding.

A text is parted into pre-tokens (``PreTokens``), then each distinct pre-token
of a block is resolved on one of two tiers:

1. a minimal perfect hash over the vocabulary (``PerfectHash``) gives the one
   token that it can be; length and bytes are compared, so a hit is exact;
2. misses are merged by rank with a heap over the linked bytes of the
   pre-token (``merge``), in O(n log n) for one of any length.

A bounded memo keeps the ids of misses seen before.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, byte_hash, distinct, ragged, text_blocks

MEMO_TOKENS = 200_000


# ------------------------------------------------------------------ pre-tokens

_LETTER, _NUMBER, _BLANK, _OTHER = range(4)


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = _LETTER
        elif kind == "N":
            out[code] = _NUMBER
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    return out


class PreTokens:
    """Spans that the pattern of the byte-level vocabularies matches.

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

    Runs of one class are matches.  A blank before a run belongs to it.  White
    space before something else leaves its last character to a match of its
    own.  A contraction counts where a match can begin at its apostrophe: after
    a letter or number, after white space other than a blank, or at the start.
    """

    def __init__(self):
        self.classes = _classes()

    def _kinds(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Class of each byte's character, and whether the byte begins one."""
        data = block.data
        kinds = self.classes[data]
        lead = (data & 0xC0) != 0x80
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
            b0, b1, b2, b3 = (padded[high + k] for k in range(4))
            two = (b0 & 0x1F) << 6 | b1 & 0x3F
            three = (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
            four = (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F
            size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
            code = np.where(size == 2, two, np.where(size == 3, three, four))
            kind = self.classes[np.minimum(code, 0x10FFFF)]
            kinds[high] = kind
            for k in (1, 2, 3):
                more = (size > k) & (high + k < len(data))
                kinds[high[more] + k] = kind[more]
        return kinds, lead

    def spans(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens, and the rows' bounds in them."""
        data, n = block.data, len(block.data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(block.rows + 1, dtype=np.int64)
        kinds, lead = self._kinds(block)
        row_start = np.zeros(n + 1, dtype=bool)
        row_start[block.offsets] = True
        change = np.empty(n + 1, dtype=bool)
        change[0] = change[n] = True
        change[1:n] = kinds[1:] != kinds[:-1]
        change |= row_start
        blank = kinds == _BLANK
        # The last character of a run of white space before something else of the same row.
        run_end = np.flatnonzero(change[1:] & blank) + 1
        run_end = run_end[(run_end < n) & ~row_start[run_end]]
        last = run_end - 1
        while (back := ~lead[last]).any():
            last = last - back
        cut = change.copy()
        cut[last] = True
        cut[run_end[data[last] == 0x20]] = False
        # Contractions.
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            before = np.maximum(quote - 1, 0)
            free = row_start[quote] | (kinds[before] == _LETTER) | (kinds[before] == _NUMBER) | (blank[before] & (data[before] != 0x20))
            quote = quote[free]
            row_end = block.offsets[np.searchsorted(block.offsets, quote, side="right")]
            padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)) & (quote + 1 < row_end)
            long = ((one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & (quote + 2 < row_end)
            for mask, size in ((short, 2), (long, 3)):
                at = quote[mask]
                cut[at] = True
                for k in range(1, size):
                    cut[at + k] = False
                cut[at + size] = True
        edges = np.flatnonzero(cut)
        lo, hi = edges[:-1], edges[1:]
        return lo, hi, np.searchsorted(lo, block.offsets)


# ---------------------------------------------------------------- the two tiers


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by hash and displace.

    Keys fall into buckets of four on average.  Largest bucket first, the least
    displacement is sought that sends all its keys to free slots; as many slots
    as keys, so every slot ends up taken.
    """

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // 4))
        self.displacement = np.zeros(self.buckets, dtype=np.uint64)
        own = self._bucket(keys)
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(self.n, dtype=bool)
        self.slot_key = np.zeros(self.n, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            members = order[bounds[b] : bounds[b + 1]]
            tries = np.arange(64, dtype=np.uint64)
            while True:
                slots = self._slot(keys[members][None, :], tries[:, None])
                good = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    break
                tries = np.arange(int(tries[-1]) + 1, 4 * int(tries[-1]) + 4, dtype=np.uint64)[: 1 << 16]
            self.displacement[b] = tries[k]
            taken[slots[k]] = True
            self.slot_key[slots[k]] = members

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        h = (keys ^ displacement * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        return (h % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Index of the only key that each of ``keys`` can be."""
        return self.slot_key[self._slot(keys, self.displacement[self._bucket(keys)])]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always the pair of least rank, the leftmost first.

    ``after`` and ``before`` link the parts by the index of their first byte.
    A heap entry holds rank and index; it is stale once ``pair[index]`` has
    another rank.
    """
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    pair = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        rank, i = divmod(pop(heap), n)
        if pair[i] != rank:
            continue
        j = after[i]
        k = after[j]
        after[i], pair[j] = k, -1
        if k < n:
            before[k] = i
            pair[i] = rank = get(word[i : after[k]], -1)
            if rank >= 0:
                push(heap, rank * n + i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = rank = get(word[h:k], -1)
            if rank >= 0:
                push(heap, rank * n + h)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[word[i:j]])
        i = j
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        used = np.flatnonzero(self.lengths)
        self.keys = byte_hash(self.bytes).span(self.offsets, self.offsets + self.lengths)
        self.hash = PerfectHash(self.keys[used])
        self.used = used
        self.pre = PreTokens()
        decimals = [f"{i} ".encode() for i in range(size)]
        self.decimal_lengths = np.array([len(x) for x in decimals], dtype=np.int64)
        width = int(self.decimal_lengths.max())
        self.decimals = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in decimals), dtype=np.uint8).reshape(size, width)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.memo_ids = np.zeros(1 << 16, dtype=np.int32)
        self.memo_bounds = np.zeros(1 << 14, dtype=np.int64)

    def _misses(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths of the merged words."""
        memo, known = self.memo, len(self.memo)
        new = [w for w in words if w not in memo]
        if new:
            got = [merge(w, self.ranks) for w in new]
            memo.update(zip(new, range(known, known + len(new)), strict=True))
            ends = self.memo_bounds[known] + np.cumsum([len(x) for x in got])
            while len(self.memo_bounds) <= len(memo):
                self.memo_bounds = np.concatenate([self.memo_bounds, np.zeros_like(self.memo_bounds)])
            while len(self.memo_ids) < ends[-1]:
                self.memo_ids = np.concatenate([self.memo_ids, np.zeros_like(self.memo_ids)])
            self.memo_ids[self.memo_bounds[known] : ends[-1]] = np.concatenate([np.array(x, dtype=np.int32) for x in got])
            self.memo_bounds[known + 1 : len(memo) + 1] = ends
        slots = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
        lengths = self.memo_bounds[slots + 1] - self.memo_bounds[slots]
        return self.memo_ids[ragged(self.memo_bounds[slots], lengths)].astype(np.int64), np.cumsum(lengths) - lengths, lengths

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and the rows' bounds in them."""
        lo, hi, first = self.pre.spans(block)
        if not len(lo):
            return np.zeros(0, dtype=np.int64), first
        if len(self.memo) > MEMO_TOKENS or self.memo_bounds[len(self.memo)] > 8 * MEMO_TOKENS:
            self.forget()
        example, inverse = distinct(block.data, lo, hi)
        starts, lengths = lo[example], (hi - lo)[example]
        keys = byte_hash(block.data).span(starts, starts + lengths)
        token = self.used[self.hash.lookup(keys)]
        hit = (self.keys[token] == keys) & (self.lengths[token] == lengths)
        at = np.flatnonzero(hit)
        same = block.data[ragged(starts[at], lengths[at])] == self.bytes[ragged(self.offsets[token[at]], lengths[at])]
        if not same.all():
            hit[at[np.unique(np.repeat(np.arange(len(at)), lengths[at])[~same])]] = False
        miss = np.flatnonzero(~hit)
        raw = block.data.tobytes()
        ids, own_starts, own_lengths = self._misses([raw[s : s + n] for s, n in zip(starts[miss].tolist(), lengths[miss].tolist(), strict=True)])
        # One table of ids: those of the misses, then those of the hits.
        pool = np.concatenate([ids, token[at]])
        from_ = np.empty(len(keys), dtype=np.int64)
        count = np.ones(len(keys), dtype=np.int64)
        from_[at] = len(ids) + np.arange(len(at))
        from_[miss], count[miss] = own_starts, own_lengths
        counts = count[inverse]
        total = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=total[1:])
        return pool[ragged(from_[inverse], counts)], total[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.offsets[ids], self.lengths[ids])]

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id in decimal and a blank, as bytes, and their lengths."""
        lengths = self.decimal_lengths[ids]
        width = self.decimals.shape[1]
        return self.decimals[ids][np.arange(width) < lengths[:, None]], lengths


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


# --------------------------------------------------------------- the operators


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` and a column ``ids``: the ids of each whole text, as an array of int.

    A null or empty text has an empty array.  Every row is encoded by itself,
    so repeated rows and ties come out alike; an empty table stays empty.  A
    column that is named like ``ids`` is replaced.
    """
    kept = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                got, bounds = c.encode(block)
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(block.lo, block.rows).columns, column], [*batch.schema.names, ids])

    from pyspark.sql import types as T

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with its ids replaced by the bytes that they stand for."""
    from pyspark.sql import types as T

    kept = [f for f in encoded.schema.fields if f.name not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw, ends = c.decode(flat), np.concatenate([[0], np.cumsum(c.lengths[flat])])[bounds]
            blob = pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), blob], [*(f.name for f in kept), out])

    return encoded.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", intact: str = "intact") -> DataFrame:
    """``docs`` with ``ids`` in place of the text, and ``intact``: whether the ids decode to its bytes.

    Both directions in one worker, which needs the vocabulary once.  Null and
    empty texts have no ids and are intact.
    """
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in (text, ids, intact)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                got, bounds = c.encode(block)
                ends = np.concatenate([[0], np.cumsum(c.lengths[got])])[bounds]
                raw, own = c.decode(got), block.data
                fine = [n == b - a and np.array_equal(raw[x:y], own[a:b]) for x, y, n, a, b in zip(ends[:-1], ends[1:], np.diff(ends), block.offsets[:-1], block.offsets[1:], strict=True)]
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(block.lo, block.rows) for f in kept), column, pa.array(fine, pa.bool_())], [*(f.name for f in kept), ids, intact])

    return docs.select(*(f.name for f in kept), text).mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(intact, T.BooleanType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, and the digests of the ids and of the bytes decoded from them.

    Null and empty texts have no ids.  Rows are taken one by one: repeats and
    ties come out alike, an empty table stays empty, and only ``doc_id`` and
    ``text`` are read.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                ids, bounds = c.encode(block)
                text, width = c.decimal(ids)
                at = np.concatenate([[0], np.cumsum(width)])[bounds].tolist()
                raw = c.decode(ids)
                end = np.concatenate([[0], np.cumsum(c.lengths[ids])])[bounds].tolist()
                text, raw = text.tobytes(), raw.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(block.lo, block.rows), "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_sha256": [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)],
                    "decoded_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(end, end[1:], strict=False)],
                })

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
