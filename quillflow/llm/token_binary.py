"""Token ids as patched frame-of-reference segments.

A *segment* is one self-contained binary image that holds whole documents:

========================  ====================================================
magic ``PFR1``            4 bytes
documents, values, blocks three unsigned 64-bit integers
exceptions                one unsigned 64-bit integer
document ids              int64 each, then a byte each: 1 if the id is null
document lengths          uint64 each (ids of the document, end id included)
block minima              uint32 each
block widths              uint8 each
block starts              uint64 each, in 64-bit words from the packed area
exception starts          uint64 each, and one more for the end
exception positions       uint8 each, within the block
exception values          uint32 each (value minus block minimum)
packed area               ``2 * width`` 64-bit words for each block
========================  ====================================================

All little-endian.  A block has 128 values.  Its minimum is subtracted and the
rest is packed at the bit width of its 90th percentile; values that need more
bits are exceptions.  Within a block the even and the odd values form two
lanes of 64, each packed from the low bits up, so that a block starts at a
whole word and can be read alone (``read_block``).

Segments are rows of a Parquet table in the shared folder.  Spark's commit
protocol then makes the output whole when executors are lost, and any store
that Spark can write will do.  The rows are dealt by range of ``doc_id``:
shard after shard, and segment after segment within a shard, documents come in
ascending ``doc_id`` order (nulls first; equal ids by a hash of the text).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLANKS, LOWER, Block, distinct, ragged, text_blocks
from .tables import shared_dir, shuffle_width

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
END_ID = 2

MEMO_RUNS = 300_000


# ---------------------------------------------------------------- the format


def _lanes(w: int) -> Iterator[tuple[int, int, int]]:
    for j in range(64):
        yield j, (j * w) >> 6, (j * w) & 63


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 128) values below 2**w to (blocks, 2 * w) words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64, 2).transpose(1, 0, 2)).astype(np.uint64)
    out = np.zeros((w, len(values), 2), dtype=np.uint64)
    for j, word, shift in _lanes(w):
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(values), 2 * w)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 2 * w) words to (blocks, 128) values."""
    lanes = np.ascontiguousarray(words.reshape(-1, w, 2).transpose(1, 0, 2))
    out = np.empty((64, len(words), 2), dtype=np.uint32)
    mask = np.uint64((1 << w) - 1)
    for j, word, shift in _lanes(w):
        got = lanes[word] >> np.uint64(shift)
        if shift + w > 64:
            got = got | lanes[word + 1] << np.uint64(64 - shift)
        out[j] = got & mask
    return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(words), BLOCK)


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    """The image of a segment; ``lengths`` add up to ``len(values)``."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, values[-1] if n else 0, dtype=np.uint32)
    grid[:n] = values
    grid = grid.reshape(blocks, BLOCK)
    minima = grid.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    grid = grid - minima[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    common = np.partition(grid, at, axis=1)[:, at] if blocks else minima
    widths = np.frexp(common.astype(np.float64))[1].astype(np.int64)
    limit = np.left_shift(np.uint64(1), widths.astype(np.uint64))
    outlier = grid >= limit[:, None]
    block_of, position = np.nonzero(outlier)
    exceptions = grid[outlier]
    starts = np.concatenate([[0], np.cumsum(2 * widths)])
    packed = np.zeros(int(starts[-1]), dtype=np.uint64)
    for w in np.unique(widths).tolist():
        if w:
            own = np.flatnonzero(widths == w)
            packed[(starts[own][:, None] + np.arange(2 * w)).ravel()] = _pack(grid[own] & np.uint32((1 << w) - 1), w).ravel()
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
    parts = [
        np.array([0 if x is None else x for x in doc_ids], dtype="<i8"), nulls, lengths.astype("<u8"),
        minima.astype("<u4"), widths.astype("u1"), starts[:-1].astype("<u8"),
        np.searchsorted(block_of, np.arange(blocks + 1)).astype("<u8"), position.astype("u1"), exceptions.astype("<u4"), packed.astype("<u8"),
    ]
    return b"PFR1" + struct.pack("<4Q", len(doc_ids), n, blocks, len(exceptions)) + b"".join(x.tobytes() for x in parts)


class Segment:
    """Reader of one segment image."""

    def __init__(self, image: bytes):
        if image[:4] != b"PFR1":
            raise ValueError("not a PFR1 segment")
        docs, self.n, blocks, exceptions = struct.unpack_from("<4Q", image, 4)
        at = 36

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if gone else x for x, gone in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.minima, self.widths, self.starts = take("<u4", blocks), take("u1", blocks), take("<u8", blocks).astype(np.int64)
        self.exception_starts = take("<u8", blocks + 1).astype(np.int64)
        self.positions, self.exceptions = take("u1", exceptions), take("<u4", exceptions)
        self.packed = take("<u8", int(2 * self.widths.astype(np.int64).sum()))

    def _blocks(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BLOCK), dtype=np.uint32)
        widths = self.widths[which]
        for w in np.unique(widths).tolist():
            if w:
                own = np.flatnonzero(widths == w)
                out[own] = _unpack(self.packed[self.starts[which[own]][:, None] + np.arange(2 * w)], w)
        lo, count = self.exception_starts[which], np.diff(self.exception_starts)[which]
        at = ragged(lo, count)
        out[np.repeat(np.arange(len(which)), count), self.positions[at]] = self.exceptions[at]
        return out + self.minima[which][:, None]

    def read_block(self, k: int) -> np.ndarray:
        return self._blocks(np.array([k]))[0][: self.n - k * BLOCK]

    def values(self) -> np.ndarray:
        return self._blocks(np.arange(len(self.minima))).ravel()[: self.n]


# -------------------------------------------------------------- tokenization


#: Classes of bytes: letters, marks whose runs are one match, and bytes whose words are left whole.
_SEP, _LETTER, _MARKS, _WHOLE = 0, 1, 2, 3
_CLASS = np.full(256, _WHOLE, dtype=np.uint8)
_CLASS[0x21:0x7F] = _MARKS
_CLASS[ord("'")] = _WHOLE
_CLASS[0x30:0x3A] = _WHOLE
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[BLANKS] = _SEP
_SIMPLE = re.compile(rb"[a-z]+|[!-&(-/:-@\[-`{-~]+")


class WordTokenizer:
    """The library's ids of every text of a block.

    The tokenizer drops white space, never matches across it and lowers case.
    So the ids of a text are those of its words in order, and in a word of
    ASCII letters and marks those of its runs of either, unless it has ``<|``,
    with which added tokens begin.  The library gets each distinct run once (its
    model, as normalising would change nothing) and each distinct word of
    another kind once (whole).  A bounded memo keeps the ids
    of what was seen before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 18, dtype=np.int64)
        self.lengths = np.zeros(1 << 18, dtype=np.int64)
        self.used = 0

    def _learn(self, runs: list[bytes]) -> None:
        known, model = len(self.slots), self.library.model.tokenize
        plain = [_SIMPLE.fullmatch(w) is not None for w in runs]
        whole = [w.decode("utf-8", "replace") for w, p in zip(runs, plain, strict=True) if not p]
        encoded = iter(self.library.encode_batch_fast(whole, add_special_tokens=False))
        flat: list[int] = []
        lengths: list[int] = []
        for w, p in zip(runs, plain, strict=True):
            ids = [t.id for t in model(w.decode())] if p else next(encoded).ids
            flat += ids
            lengths.append(len(ids))
        self.slots.update(zip(runs, range(known, known + len(runs)), strict=True))
        while known + len(runs) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), dtype=np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        own = np.array(lengths, dtype=np.int64)
        self.lengths[known : known + len(runs)] = own
        self.starts[known : known + len(runs)] = self.used + np.cumsum(own) - own
        self.used += len(flat)

    @staticmethod
    def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with case lowered where that is the tokenizer's, and starts, ends and row bounds of the runs."""
        starts, ends, first = block.words(BLANKS)
        kind = _CLASS[block.data]
        whole = np.zeros(len(kind) + 1, dtype=np.int64)
        np.cumsum(kind == _WHOLE, out=whole[1:])
        odd = whole[ends] > whole[starts]
        # A word that may hold an added token, which is matched inside words too, is the library's.
        opening = np.flatnonzero((block.data[:-1] == 0x3C) & (block.data[1:] == 0x7C))
        odd[np.searchsorted(starts, opening, side="right") - 1] = True
        kind[ragged(starts[odd], (ends - starts)[odd])] = _WHOLE
        data = np.where(kind == _WHOLE, block.data, LOWER[block.data])
        cut = np.zeros(len(kind) + 1, dtype=bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[starts] = cut[ends] = True
        edges = np.flatnonzero(cut)
        lo, hi = edges[:-1], edges[1:]
        inside = kind[lo] != _SEP if len(lo) else np.zeros(0, dtype=bool)
        lo, hi = lo[inside], hi[inside]
        return data, lo, hi, np.searchsorted(lo, block.offsets)

    def encode(self, block: Block, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and the number for each row."""
        data, starts, ends, first = self.runs(block)
        if len(self.slots) > MEMO_RUNS or self.used > 8 << 20:
            self.forget()
        example, inverse = distinct(data, starts, ends)
        raw = data.tobytes()
        runs = [raw[s:e] for s, e in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        new = [w for w in runs if w not in self.slots]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, runs), dtype=np.int64, count=len(runs))[inverse]
        lengths = self.lengths[slots]
        total = np.zeros(len(slots) + 1, dtype=np.int64)
        np.cumsum(lengths, out=total[1:])
        ids = self.ids[ragged(self.starts[slots], lengths)]
        counts = total[first[1:]] - total[first[:-1]]
        if end_id is not None:
            ids = np.insert(ids, total[first[1:]], np.uint32(end_id))
            counts = counts + 1
        return ids, counts


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# ------------------------------------------------------------ the operators

SEGMENT_SCHEMA = "shard int, shard_start long, n_docs long, n_ids long, image binary"


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``text`` of every row and write segments in ``doc_id`` order.

    A null text counts as empty (only the end id is written), a null id comes
    first, rows that repeat are written as often as they stand.  An empty table
    gives no segment.  Only ``doc_id`` and ``text`` are read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        docs_: list[int | None] = []
        written = held = 0

        def segment() -> pa.RecordBatch:
            values, lengths = np.concatenate(ids), np.concatenate(counts)
            image = write_segment(docs_, lengths, values)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "shard_start": pa.array([written], pa.int64()), "n_docs": pa.array([len(docs_)], pa.int64()),
                "n_ids": pa.array([len(values)], pa.int64()), "image": pa.array([image], pa.binary()),
            })

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for block in text_blocks(batch.column("text")):
                got, n = tokenizer.encode(block, end_id)
                ids.append(got)
                counts.append(n)
                docs_ += names[block.lo : block.hi]
                held += len(got)
                if held >= segment_ids:
                    yield segment()
                    written, held = written + held, 0
                    ids, counts, docs_ = [], [], []
        if docs_:
            yield segment()

    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = own.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Documents of a written table: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (binary, little-endian uint32).

    One row for each document that was written, null ids, empty texts and
    repeated rows included; none for a table without segments.
    What is gathered on the driver is one count for each shard.
    """
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    total, base = 0, {}
    for shard, n in sorted(map(tuple, table.groupBy("shard").agg(F.sum("n_ids")).collect())):
        base[shard] = total
        total += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, image in zip(*(batch.column(c).to_pylist() for c in ("shard", "shard_start", "image")), strict=True):
                segment = Segment(image)
                values = segment.values().astype("<u4", copy=False)
                ends = np.cumsum(segment.lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(segment.doc_ids, pa.int64()), "start": pa.array(base[shard] + before + ends - segment.lengths, pa.int64()),
                    "n_tokens": pa.array(segment.lengths, pa.int64()),
                    "ids": pa.array([values[e - n : e].tobytes() for e, n in zip(ends.tolist(), segment.lengths.tolist(), strict=True)], pa.binary()),
                })

    return table.select("shard", "shard_start", "image").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_file(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the segments of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer_path, path)
    return read_ids(spark, path)


def digests(read: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
