"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every word from the two words on either
side of it; the conditional log-probabilities of a text's words, summed, score
it.

*Vocabulary.*  Words are counted over all texts, and every counted word has a
probability of its own.  The counts stay a distributed table, which grows with
the corpus: texts are packed into blocks once, each block's different words are
dealt out to shards by hash, summed there, and dealt back to their blocks
(``totals``).  Each word has one of ``CLASSES`` classes: the most frequent words one each, others
by hash.

*Pairs.*  How often each pair of neighbouring words stands in all texts is
counted in the same way; the end of a text counts as a word here.  These counts
tell the words of a class apart by their neighbours.  A word's probability is
the mean of what its left and what its right neighbour say: ``(k + PRIOR * q) /
(m + PRIOR)``, with k how often the neighbour stands beside this word elsewhere,
m how often it stands elsewhere at all, and q what the network says.  So the
place that is predicted never counts itself, and a pair that stands only once
says nothing and isn't dealt back.

*Network.*  The classes of the four neighbours are embedded, one table for each
place, added, and passed through tanh; a softmax gives the class in the middle.
q is the class's probability times the word's share of the class in the
counts.  The network is trained in numpy by passes over *all* words: in each,
every partition trains from the same weights, and the outcomes are averaged by
the words that made them (``PASSES``, with falling rates).  So everything that is
learnt from the corpus covers all of it, and only sums of fixed size come to the
driver.  As each partition trains by itself, weights, and with them scores,
depend a little on how the rows are dealt to partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLANKS, LOWER, Block, byte_hash, mix, row_of, text_blocks
from .blocks import released as _released
from .blocks import squeezed as _squeezed
from .tables import Bucketed, dropped, staged
from .training import summed as summed_vectors

CLASSES = 128
SINGLE = 64
HIDDEN = 24
OFFSETS = (-2, -1, 1, 2)
#: Of the network, against a neighbour's pairs, in places.
PRIOR = 20.0
#: For words that no text of the corpus has.
LETTER_COST = 3.3
#: Learning rate of each pass over all words.
PASSES = (0.1,)
BATCH = 4096
#: The exponentials of as many classes add up to less than the largest float32.
MOST_LOGIT = np.float32(80)
#: Rows of a matrix product at a time: small enough for one thread, as the other cores have tasks of their own.
STRIP = 64
PACKED_BYTES = 2 << 20
#: Shards of keys: so many at least, and none of many more entries than this.
LEAST_SHARDS = 8
SHARD_ENTRIES = 1 << 19
#: Bits of a pair's key beside those that name its shard: of a shard's entries, one in two million meets another.
PAIR_BITS = 40
_SLOTS = 1 << 17
_END = np.uint64(0x5EED0FE2D0F7E875)


class Counts(NamedTuple):
    """Statistics of the whole corpus by class; of fixed size, while words' own counts stay distributed."""

    keys: np.ndarray  # hashes of the words listed here, sorted
    counts: np.ndarray
    classes: np.ndarray  # class of each of these words
    totals: np.ndarray  # words of each class
    rare: np.ndarray  # of these, words that aren't listed


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and letters of every word with case lowered, and the rows' bounds."""
    data = LOWER[block.data]
    starts, ends, first = Block(block.lo, block.hi, data, block.offsets).words(BLANKS)
    leads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return byte_hash(data).span(starts, ends), leads[ends] - leads[starts], first


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n``: how often each word stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text"), 4 << 20):
                key, n = np.unique(_words(block)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashed_class(keys: np.ndarray) -> np.ndarray:
    return SINGLE + (keys >> np.uint64(20)).astype(np.int64) % (CLASSES - SINGLE)


def packed(docs: DataFrame) -> DataFrame:
    """Texts in blocks of about ``PACKED_BYTES``: ids, words of each row, the block's different words with their counts, and which of them stands where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in text_blocks(batch.column("text"), PACKED_BYTES):
                keys, _, first = _words(block)
                words, at, n = np.unique(keys, return_inverse=True, return_counts=True)
                rank = np.empty(len(words), dtype=np.int32)
                rank[_by_count(n)] = np.arange(len(words))  # small places are frequent, which packs well
                ids = pa.ListArray.from_arrays(pa.array([0, block.rows], pa.int32()), batch.column("doc_id").slice(block.lo, block.rows))
                parts = [_squeezed(np.diff(first), np.int32), words.tobytes(), _squeezed(n, np.int32), _squeezed(rank[at], np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([len(keys)]), pa.array([np.count_nonzero(np.diff(first))]), *(pa.array([x]) for x in parts)], ["block", "ids", "length", "ends", "rows", "words", "n", "at"])
                number += 1

    return docs.mapInArrow(run, "block long, ids array<long>, length long, ends long, rows binary, words binary, n binary, at binary")


def _by_count(n: np.ndarray) -> np.ndarray:
    return np.argsort(-n, kind="stable")


class Packed:
    """A row of ``packed``: bounds of the texts, different words (hashes, sorted) and which of them stands where."""

    COLUMNS = ("ids", "length", "rows", "words", "n", "at")

    def __init__(self, batch: pa.RecordBatch, r: int):
        own = {c: batch.column(c)[r] for c in self.COLUMNS}
        self.words = np.frombuffer(own["words"].as_py(), dtype=np.uint64)
        n = _released(own["n"].as_py(), np.int32, len(self.words))
        self.at = _by_count(n)[_released(own["at"].as_py(), np.int32, own["length"].as_py())]
        self.ids = own["ids"].values
        self.first = np.concatenate([[0], np.cumsum(_released(own["rows"].as_py(), np.int32, len(self.ids)), dtype=np.int64)])


def shard_bits(blocks: DataFrame) -> int:
    """So many upper bits of a key name its shard."""
    positions = blocks.agg(F.sum("length")).collect()[0][0] or 0
    return max(LEAST_SHARDS, positions // SHARD_ENTRIES).bit_length()


def sharded(block: int, keys: np.ndarray, n: np.ndarray, bits: int, width: int = 64) -> pa.RecordBatch:
    """A block's sorted different keys, of which the upper ``width`` bits count, and their numbers, a row for each shard.

    Keys are written as differences, compressed.
    """
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]
    own = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
    short = keys >> np.uint64(64 - width)
    steps = [_squeezed(np.diff(short[lo:hi], prepend=np.uint64(0)), np.uint64) for _, lo, hi in own]
    columns = [[k for k, _, _ in own], [block] * len(own), [hi - lo for _, lo, hi in own], steps, [_squeezed(n[lo:hi], np.int32) for _, lo, hi in own]]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["shard", "block", "size", "keys", "n"])


ENTRIES = "shard int, block long, size int, keys binary, n binary"


def word_entries(blocks: DataFrame, bits: int) -> DataFrame:
    """Every different word of every block, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, n in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "n")), strict=True):
                keys = np.frombuffer(words, dtype=np.uint64)
                yield sharded(number, keys, _released(n, np.int32, len(keys)), bits)

    return blocks.select("block", "words", "n").mapInArrow(run, ENTRIES)


class Pairs:
    """Neighbouring words of a packed block, ends of texts included.

    ``keys`` are the different pairs, sorted, without those that can't stand
    twice as one of their words stands once; ``left[i]`` and ``right[i]`` are
    places in it of word i with its neighbours (its length: not in it).  Keys
    have ``PAIR_BITS`` beside the ``bits`` of the shard.
    """

    def __init__(self, own: Packed, times: np.ndarray, bits: int):
        end = len(own.words)
        self.words = np.full(len(own.at) + len(own.first), end, dtype=np.int64)
        self.place = np.arange(len(own.at)) + row_of(own.first) + 1
        self.words[self.place] = own.at
        once, hashes = np.append(times < 2, False), np.append(own.words, _END)
        a, b = self.words[:-1], self.words[1:]
        may = np.flatnonzero(~(once[a] | once[b] | ((a == end) & (b == end))))
        keys = mix(hashes[a[may]] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes)[b[may]])
        keys &= ~np.uint64((1 << max(0, 64 - bits - PAIR_BITS)) - 1)
        self.keys, inverse, self.n = np.unique(keys, return_inverse=True, return_counts=True)
        which = np.full(len(a), len(self.keys), dtype=np.int64)
        which[may] = inverse
        self.left, self.right = which[self.place - 1], which[self.place]


def pair_entries(texts: DataFrame, bits: int) -> DataFrame:
    """Every different pair of every block, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = Packed(batch, r)
                pairs = Pairs(own, _released(batch.column("word_total")[r].as_py(), np.int64, len(own.words)), bits)
                yield sharded(batch.column("block")[r].as_py(), pairs.keys, pairs.n, bits, min(64, bits + PAIR_BITS))

    return texts.select("block", *Packed.COLUMNS, "word_total").mapInArrow(run, ENTRIES)


def mixed(own: Packed, times: np.ndarray, pairs: Pairs, pair_times: np.ndarray, ends: int, network: np.ndarray) -> np.ndarray:
    """Log-probability of every word, given the network's."""
    prior, seen, m = PRIOR * np.exp(network), np.append(pair_times, 1) - 1, np.append(times, ends) - 1
    before, after = m[pairs.words[pairs.place - 1]], m[pairs.words[pairs.place + 1]]
    return np.log(((seen[pairs.left] + prior) / (before + PRIOR) + (seen[pairs.right] + prior) / (after + PRIOR)) / 2)


def _runs(batches: Iterator[pa.RecordBatch], by: str, *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that follow each other and agree in ``by``."""
    held, own = [], None
    for batch in batches:
        for k, *row in zip(*((x.as_py() for x in batch.column(c)) for c in (by, *columns)), strict=True):
            if held and k != own:
                yield own, held
                held = []
            own = k
            held.append(row)
    if held:
        yield own, held


def summed(entries: DataFrame, bits: int, keep: bool = True) -> DataFrame:
    """How often the keys of each block and shard stand in all blocks; under a null block, if kept, a shard's different keys and their totals.

    A shard is one task's work at a time; there are more of them for more
    entries, so a shard's size is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _runs(batches, "shard", "block", "size", "keys", "n"):
            keys = np.concatenate([np.cumsum(_released(r[2], np.uint64, r[1])) for r in rows])
            own, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([_released(r[3], np.int32, r[1]) for r in rows])).astype(np.int64)
            cuts = np.cumsum([0] + [r[1] for r in rows])
            each = [_squeezed(total[inverse[lo:hi]], np.int64) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            columns = [[r[0] for r in rows] + [None], [shard] * (len(rows) + 1), np.append(np.diff(cuts), len(own)), each + [_squeezed(total, np.int64)], [None] * len(rows) + [own.tobytes()]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x if keep else x[:-1], kind) for x, kind in zip(columns, kinds, strict=True)], ["block", "shard", "size", "total", "keys"])

    # As many partitions as shards, so that a task's share is bounded too.
    return entries.repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(run, "block long, shard int, size int, total binary, keys binary")


def totals(sums: DataFrame, name: str) -> DataFrame:
    """``name`` of every block: how often each of its keys, in their order, stands in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _runs(batches, "block", "size", "total"):
            every = np.concatenate([_released(total, np.int64, size) for size, total in rows])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_squeezed(every, np.int64)])], ["block", name])

    dealt = sums.filter("block is not null").select("block", "shard", "size", "total").repartition("block")
    return dealt.sortWithinPartitions("block", "shard").mapInArrow(run, f"block long, {name} binary")


def listed(sums: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, total, keys in zip(*(batch.column(c).to_pylist() for c in ("size", "total", "keys")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, dtype=np.int64)), pa.array(_released(total, np.int64, size))], ["word", "n"])

    return sums.filter("block is null").select("size", "total", "keys").mapInArrow(run, "word long, n long")


def corpus_counts(docs: DataFrame, vocabulary: int = SINGLE, counts: DataFrame | None = None) -> Counts:
    """The words with a class of their own (at least) and class totals; sums of bounded size come to the driver."""
    counts = counts or staged(word_counts(docs), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    keys = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
    n = np.array([r.n for r in top], dtype=np.float64)
    classes = np.where(np.arange(len(keys)) < SINGLE, np.arange(len(keys)), hashed_class(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            word, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n"))
            total += np.bincount(hashed_class(word.view(np.uint64)), weights=times, minlength=CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], ["class", "n"])

    by_hash = np.zeros(CLASSES)
    for k, total in counts.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n")).collect():
        by_hash[k] = total
    # Rare words are in the class of their hash: all of it but the listed words that fall there.
    rare = by_hash - np.bincount(hashed_class(keys), weights=n, minlength=CLASSES) if len(keys) else by_hash
    totals = rare + np.bincount(classes, weights=n, minlength=CLASSES) if len(keys) else by_hash
    order = np.argsort(keys)
    return Counts(keys[order], n[order], classes[order], totals, rare)


class Lexicon:
    """Class and within-class log-probability of words, by an open table of hashes."""

    def __init__(self, counts: Counts):
        self.counts = counts
        slot = (counts.keys >> np.uint64(47)).astype(np.int64)  # the upper 17 bits
        self.bounds = np.searchsorted(slot, np.arange(_SLOTS + 1))
        self.reach = int(np.diff(self.bounds).max()) if len(slot) else 0
        with np.errstate(divide="ignore"):
            self.log_share = np.log(counts.counts) - np.log(counts.totals[counts.classes]) if len(slot) else np.zeros(0)
            self.log_rare = np.log(counts.rare + 1) - np.log(counts.totals + 1)

    def classes(self, keys: np.ndarray) -> np.ndarray:
        return self(keys, np.zeros(len(keys)))[0]

    def __call__(self, keys: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        classes = hashed_class(keys)
        inside = self.log_rare[classes] - LETTER_COST * letters
        slot = (keys >> np.uint64(47)).astype(np.int64)
        low, high = self.bounds[slot], self.bounds[slot + 1]
        for k in range(self.reach):
            at = np.flatnonzero(low + k < high)
            at = at[self.counts.keys[low[at] + k] == keys[at]]
            own = low[at] + k
            classes[at] = self.counts.classes[own]
            inside[at] = self.log_share[own]
        return classes, inside


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``, some rows at a time."""
    out = np.empty((len(a), b.shape[1]), dtype=a.dtype)
    whole = len(a) // STRIP * STRIP
    np.matmul(a[:whole].reshape(-1, STRIP, a.shape[1]), b, out=out[:whole].reshape(-1, STRIP, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``, some rows at a time."""
    whole = len(a) // STRIP * STRIP
    parts = np.matmul(a[:whole].reshape(-1, STRIP, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, STRIP, b.shape[1]))
    return parts.sum(axis=0) + a[whole:].T @ b[whole:]


class Network:
    """Tables for the neighbours' classes, hidden bias, output weights and bias, in one vector."""

    SIZE = len(OFFSETS) * (CLASSES + 1) * HIDDEN + HIDDEN + HIDDEN * CLASSES + CLASSES

    def __init__(self, vector: np.ndarray):
        self.vector = np.array(vector, dtype=np.float32)
        cut = np.cumsum([len(OFFSETS) * (CLASSES + 1) * HIDDEN, HIDDEN, HIDDEN * CLASSES])
        tables, self.bias, output, self.out_bias = np.split(self.vector, cut)
        self.tables = tables.reshape(len(OFFSETS), CLASSES + 1, HIDDEN)
        self.output = output.reshape(HIDDEN, CLASSES)
        self.squares = np.full_like(self.vector, 1e-4)

    @classmethod
    def start(cls, totals: np.ndarray) -> Network:
        rng = np.random.default_rng(1)
        net = cls(rng.normal(0, 0.1, cls.SIZE))
        net.out_bias[:] = np.log(np.maximum(totals, 0.5)) - np.log(max(totals.sum(), 1))
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.take(self.tables[0], around[0], axis=0)
        for k in range(1, len(OFFSETS)):
            total += np.take(self.tables[k], around[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def exponentials(self, h: np.ndarray) -> np.ndarray:
        """Of the logits, each cut at a size that float32 holds."""
        logits = _product(h, self.output)
        logits += self.out_bias
        np.minimum(logits, MOST_LOGIT, out=logits)
        return np.exp(logits, out=logits)

    def log_probabilities(self, around: np.ndarray, middle: np.ndarray) -> np.ndarray:
        e = self.exponentials(self.hidden(around))
        return np.log(np.maximum(e[np.arange(len(middle)), middle], 1e-30)) - np.log(e.sum(axis=1))

    def learn(self, around: np.ndarray, middle: np.ndarray, rate: float) -> None:
        """One AdaGrad step on a batch of positions."""
        n = len(middle)
        h = self.hidden(around)
        p = self.exponentials(h)
        p *= (1 / (n * p.sum(axis=1)))[:, None]
        p[np.arange(n), middle] -= np.float32(1 / n)
        back = _product(p, np.ascontiguousarray(self.output.T))
        back *= 1 - h * h
        gradient = np.empty_like(self.vector)
        tables, bias, output, out_bias = np.split(gradient, np.cumsum([self.tables.size, HIDDEN, self.output.size]))
        tables = tables.reshape(self.tables.shape)
        for k in range(len(OFFSETS)):
            own = around[k].astype(np.uint8)
            order = np.argsort(own, kind="stable")
            begin = np.flatnonzero(np.diff(own[order], prepend=np.uint8(CLASSES + 1)))
            tables[k] = 0
            tables[k][own[order[begin]]] = np.add.reduceat(np.take(back, order, axis=0), begin)
        bias[:], output[:], out_bias[:] = back.sum(axis=0), _crossed(h, p).ravel(), p.sum(axis=0)
        self.squares += gradient * gradient
        self.vector -= rate * gradient / np.sqrt(self.squares)


def neighbours(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes around every word; ``CLASSES`` stands for the end of the text."""
    n = len(classes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(OFFSETS), n), CLASSES, dtype=np.int64)
    for k, o in enumerate(OFFSETS):
        a, b = max(0, -o), min(n, n - o)
        if a < b:
            same = row[a:b] == row[a + o : b + o]
            out[k, a:b][same] = classes[a + o : b + o][same]
    return out


def _packed_positions(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            own = Packed(batch, r)
            classes = lexicon.classes(own.words)[own.at]
            yield neighbours(classes, own.first), classes


def _pass(net: Network, positions: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> int:
    n = 0
    for around, middle in positions:
        order = np.random.default_rng(len(middle)).permutation(len(middle))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            net.learn(around[:, own], middle[own], rate)
        n += len(middle)
    return n


def train(blocks: DataFrame, counts: Counts) -> np.ndarray:
    """Weights of the network: after each pass over all words, the mean of the partitions' weights by their words."""
    weights = Network.start(counts.totals).vector
    for rate in PASSES:

        def vectors(batches: Iterator[pa.RecordBatch], start: np.ndarray = weights, rate: float = rate) -> Iterator[np.ndarray]:
            net, lexicon = Network(start), Lexicon(counts)
            n = _pass(net, _packed_positions(batches, lexicon), rate)
            yield np.append(net.vector.astype(np.float64) * n, n)

        total = summed_vectors(blocks.select(*Packed.COLUMNS), Network.SIZE + 1, vectors)
        weights = (total[:-1] / total[-1]).astype(np.float32) if total[-1] else weights
    return weights


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_prob`` (sum over the words) and ``perplexity`` of every row.

    A null or empty text has no words, ``log_prob`` 0 and a null perplexity.
    Rows that repeat score alike; an empty table stays empty.  Only ``doc_id``
    and ``text`` are read.  Another partitioning of the rows gives slightly other
    scores, as each partition trains by itself.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bucketed, so that totals come to the texts and not the other way.
    blocks = Bucketed(packed(own), "blocks", "block").read()
    bits = shard_bits(blocks)
    sums = staged(summed(word_entries(blocks, bits), bits), "word-sums")
    dropped()
    words = staged(listed(sums), "word-counts")
    counts = corpus_counts(own, counts=words)
    # A block without a word has no totals.
    texts = blocks.join(Bucketed(totals(sums, "word_total"), "word-totals", "block").read(), "block", "left")
    dropped(sums, words)
    ends = blocks.agg(F.sum("ends")).collect()[0][0] or 0
    weights = train(blocks, counts)
    pair_sums = staged(summed(pair_entries(texts, bits), bits, keep=False), "pair-sums")
    dropped()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, lexicon = Network(weights), Lexicon(counts)
        for batch in batches:
            for r in range(batch.num_rows):
                own = Packed(batch, r)
                times = _released(batch.column("word_total")[r].as_py(), np.int64, len(own.words))
                pairs = Pairs(own, times, bits)
                pair_times = _released(batch.column("pair_total")[r].as_py(), np.int64, len(pairs.keys))
                kinds = lexicon.classes(own.words)
                middle, inside = kinds[own.at], (np.log(times) - np.log(counts.totals[kinds]))[own.at]
                around = neighbours(middle, own.first)
                parts = [net.log_probabilities(around[:, i : i + BATCH], middle[i : i + BATCH]) for i in range(0, len(middle), BATCH)]
                total = _sums(mixed(own, times, pairs, pair_times, ends, np.concatenate(parts) + inside) if parts else inside, own.first)
                n = np.diff(own.first)
                perplexity = np.exp(np.minimum(-total / np.maximum(n, 1), 700))
                yield pa.RecordBatch.from_arrays([own.ids, pa.array(n), pa.array(total), pa.array(perplexity, mask=n == 0)], ["doc_id", "n_words", "log_prob", "perplexity"])

    whole = texts.join(totals(pair_sums, "pair_total"), "block", "left").select(*Packed.COLUMNS, "word_total", "pair_total")
    return whole.mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
