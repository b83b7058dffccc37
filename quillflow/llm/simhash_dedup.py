"""SimHash near-duplicates by vantage-point trees.

Fingerprints of 64 bits link at ``RADIUS`` = 3 or fewer differing bits.  Of two
such, one 32-bit half differs in at most 1 bit, so both halves get a tree of
their own, in which pairs at half-distance 1 or less must meet.

*Shards.*  Level k of a half's tree has a vantage point ``v``; a fingerprint at
distance ``d`` from it goes left if ``d <= t`` and right otherwise, ``t`` being
the median distance of all distinct fingerprints.  By the triangle inequality a
pair at distance 1 has distances from ``v`` that differ by at most 1; so only
those at ``d = t + 1`` can have a partner on the other side, and they go to
both.  The path through the levels is the shard.  The tree gets a level more
for each doubling of the input: shards stay near ``SHARD_SIZE``.

*Inside a shard*, ``local_links`` goes on splitting around vantage points taken
from the data, now by the distance of all 64 bits, and compares what is left
directly.  It emits one edge for each fingerprint that has a link, not all
pairs.

*Large shards* (near copies in great numbers) of up to ``BLOCKS`` blocks are
dealt over blocks, each pair of blocks being a task of its own.  Larger ones are
first worked on by the cluster, each with a vantage point of its own (``parted``): by turns that of its
fingerprints which is nearest to the majority of their bits, and any one.  Its
distances are counted, and what leaves the fewest pairs is done.  Either the
shard is split at a distance, again with those within ``RADIUS`` of it on both
sides.  Or the fingerprints within ``RADIUS`` of the vantage point are linked to
it and need no comparison among themselves: they meet only those at up to twice
that distance, and the others go on as a shard without them.  After ``ROUNDS``
what is left is dealt over blocks all the same.

Exact copies share a fingerprint and are one node.  Components are those of
``components``.  Every step is exact: no bucket is cut or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLANKS, LOWER, Block, mix, ragged, row_of, text_blocks
from .components import components
from .tables import carried, row_key, shuffle_width, staged

RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD_SIZE = 160
BLOCK_SIZE = 4096
BLOCKS = 4
ROUNDS = 8
#: A step must leave at most this share of a shard's pairs.
MOST_LEFT = 0.75

_SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], dtype=np.uint64)


# --------------------------------------------------------------- fingerprints


def shingle_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of every row, and the rows' bounds in them."""
    from xxhash import xxh64_intdigest

    starts, ends, first = Block(block.lo, block.hi, block.data, block.offsets).words(BLANKS)
    lengths = ends - starts
    size = lengths + 1
    joined = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    own = np.cumsum(size) - size
    joined[ragged(own, lengths)] = LOWER[block.data[ragged(starts, lengths)]]
    words = np.diff(first)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    head = ragged(first[:-1], count)
    tail = head + np.repeat(np.minimum(words, SHINGLE) - 1, count)
    raw = joined.tobytes()
    lo, hi = own[head].tolist(), (own + lengths)[tail].tolist()
    return np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(lo, hi, strict=True)), dtype=np.uint64, count=len(lo)), bounds


def fold(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of every row: the bits set in over half of its hashes."""
    count = np.diff(bounds)
    pieces = -(-count // 255)  # byte counters hold 255 at most
    piece_bounds = np.concatenate([[0], np.cumsum(pieces)])
    cuts = np.repeat(bounds[:-1], pieces) + 255 * (ragged(np.zeros(len(pieces), dtype=np.int64), pieces))
    out = np.zeros(len(count), dtype=np.uint64)
    if not len(cuts):
        return out
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    own = row_of(piece_bounds)
    some = np.flatnonzero(count)
    for k in range(8):
        counters = np.add.reduceat(_SPREAD[lanes[:, k]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.zeros((len(count), 8), dtype=np.int64)
        np.add.at(total, own, counters)
        bits = (2 * total[some] > count[some][:, None]).astype(np.uint64)
        out[some] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``node`` (``fp`` mixed, so that its order is random) and the row's key, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                fp = fold(*shingle_hashes(block))
                ids, *keys = (batch.column(c).slice(block.lo, block.rows) for c in ("doc_id", "key_id", "key_text"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64)), pa.array(mix(fp).view(np.int64)), *keys], ["doc_id", "fp", "node", "key_id", "key_text"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key())
    return own.mapInArrow(run, "doc_id long, fp long, node long, key_id long, key_text long")


# --------------------------------------------------------------------- shards


def vantage_points(levels: int, half: int) -> np.ndarray:
    return (mix(np.arange(1, levels + 1, dtype=np.uint64) + np.uint64(1000 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint64)


def _half(fp: np.ndarray, half: int) -> np.ndarray:
    return fp >> np.uint64(32) if half else fp & np.uint64(0xFFFFFFFF)


def thresholds(nodes: DataFrame, levels: int) -> list[list[int]]:
    """Median distance from each vantage point, by counts over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, levels, 33), dtype=np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                for k, v in enumerate(vantage_points(levels, half)):
                    total[half, k] += np.bincount(np.bitwise_count(_half(fp, half) ^ v), minlength=33)
        at = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in at), pa.array(total.ravel())], ["half", "level", "d", "n"])

    total = np.zeros((2, levels, 33), dtype=np.int64)
    for half, k, d, n in nodes.select("fp").mapInArrow(run, "half int, level int, d int, n long").groupBy("half", "level", "d").agg(F.sum("n")).collect():
        total[half, k, d] = n
    passed = np.cumsum(total, axis=2)
    return [[int(np.argmax(2 * row >= row[-1])) for row in half] for half in passed]


def paths(fp: np.ndarray, half: int, medians: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index of a fingerprint and a shard that it goes to, for all its shards."""
    index, path, own = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64), _half(fp, half)
    for v, t in zip(vantage_points(len(medians), half), medians, strict=True):
        d = np.bitwise_count(own[index] ^ v)
        both = np.flatnonzero(d == t + 1)
        path = np.concatenate([2 * path + (d > t), 2 * path[both]])
        index = np.concatenate([index, index[both]])
    return index, path


def shards(nodes: DataFrame, levels: int) -> DataFrame:
    """``shard``, ``fp``: every fingerprint in each shard where a partner can be."""
    medians = thresholds(nodes, levels) if levels else [[], []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                index, path = paths(fp, half, medians[half])
                yield pa.RecordBatch.from_arrays([pa.array(2 * path + half), pa.array(fp[index].view(np.int64))], ["shard", "fp"])

    return nodes.select("fp").mapInArrow(run, "shard long, fp long")


def _near(fp: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ others[None, :]) <= RADIUS


def local_links(fp: np.ndarray, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that join the distinct fingerprints ``fp`` as all their links do."""
    if len(fp) > 512 and depth < 24:
        d = np.bitwise_count(fp ^ fp[mix(np.array([depth], dtype=np.uint64))[0] % np.uint64(len(fp))]).astype(np.int64)
        t = int(np.median(d))
        left, right = d <= t + RADIUS, d > t
        if left.sum() + right.sum() <= 1.5 * len(fp):
            yield from local_links(fp[left], depth + 1)
            yield from local_links(fp[right], depth + 1)
            return
    step = max(1, (1 << 18) // max(1, len(fp)))
    degree = np.concatenate([_near(fp[i : i + step], fp).sum(axis=1) for i in range(0, len(fp), step)]) if len(fp) else np.zeros(0)
    rest = fp[degree > 1]
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            found = np.zeros(len(rest), dtype=bool)
            step = max(1, (1 << 18) // len(rest))
            for i in range(0, len(front), step):
                found |= _near(front[i : i + step], rest).any(axis=0)
            front, rest = rest[found], rest[~found]
            yield front, np.full(len(front), root, dtype=np.uint64)


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[np.ndarray]:
    """Fingerprints of each group of a partition that is sorted by ``keys``."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(fp)], strict=True):
            key = tuple(c[lo] for c in columns)
            if key != last and held:
                yield np.concatenate(held)
                held = []
            held.append(fp[lo:hi])
            last = key
    if held:
        yield np.concatenate(held)


def _dealt(rows: DataFrame, blocks: Column, of: str, others: Column, before: bool) -> DataFrame:
    """Rows of one side of many pairs of blocks, once for each block of the other side."""
    own, other = F.pmod(F.xxhash64("fp", F.lit(of)), blocks).cast("int"), F.explode(F.sequence(F.lit(0), (others - 1).cast("int")))
    cut = rows.withColumn("own", own).withColumn("other", other)
    return cut.select("shard", "fp", *(F.col(x).alias(y) for x, y in zip(("own", "other") if before else ("other", "own"), "ij", strict=True)))


def _centres(rows: DataFrame) -> DataFrame:
    """``shard``, ``n`` and ``v``: the fingerprint that is nearest to the majority of bits in its shard."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    bit = lambda b: F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit((1 << b) - (b == 63) * (1 << 64)).cast("long")).otherwise(0)
    majority = rows.groupBy("shard", "n").agg(*ones).select("shard", reduce(Column.bitwiseOR, [bit(b) for b in range(64)]).alias("centre"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    return rows.join(majority, "shard").groupBy("shard", "n").agg(F.min_by("fp", F.struct(distance, "fp")).alias("v"))


def parted(placed: DataFrame, block_size: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """``shard``, ``fp``, ``i``, ``j``: groups of about two blocks in which all partners meet, and the edges (``a``, ``b``: fingerprints) that need no group."""
    settled: list[DataFrame] = []
    groups: list[DataFrame] = []
    edges: list[DataFrame] = []
    for r in range(rounds):
        large = staged(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(r))).alias("v")).filter(F.col("n") > BLOCKS * block_size), "large-shards")
        if large.isEmpty():
            break
        placed = staged(placed, "placed") if not r else placed
        settled.append(placed.join(large, "shard", "left_anti"))
        if r % 2 == 0:
            large = staged(_centres(placed.join(large.select("shard", "n"), "shard")), "centres")
        seen = placed.join(large, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))))
        # A few rows for each large shard: what each distance would leave on either side.
        by_d = Window.partitionBy("shard").orderBy("d")
        counts = seen.groupBy("shard", "n", "d").agg(F.count(F.lit(1)).alias("c"))
        left = F.sum("c").over(by_d.rangeBetween(Window.unboundedPreceding, RADIUS)).cast("double")
        right = (F.col("n") - F.sum("c").over(by_d.rangeBetween(Window.unboundedPreceding, 0))).cast("double")
        cost = (left * left + right * right) / (F.col("n").cast("double") * F.col("n"))
        within = lambda low, high: F.sum(F.when(F.col("d").between(low, high), F.col("c")).otherwise(0))
        choice = counts.withColumn("cost", cost).groupBy("shard", "n").agg(F.min_by("d", F.struct("cost", "d")).alias("t"), F.min("cost").alias("cost"), within(0, RADIUS).alias("core"), within(RADIUS + 1, 2 * RADIUS).alias("fringe"))
        share = lambda x: F.col(x).cast("double") / F.col("n")
        taken = 2 * share("core") * share("fringe") + (1 - share("core")) * (1 - share("core"))
        kind = F.when(F.least("cost", taken) > MOST_LEFT, "keep").when(taken <= F.col("cost"), "absorb").otherwise("split")
        choice = staged(choice.withColumn("kind", kind).drop("n"), "choices")
        chosen = seen.join(choice, "shard")
        split, absorbed, kept = (chosen.filter(F.col("kind") == k) for k in ("split", "absorb", "keep"))
        near, far = absorbed.filter(F.col("d") <= RADIUS), absorbed.filter(F.col("d") > RADIUS)
        edges.append(near.filter("fp <> v").select(F.col("fp").alias("a"), F.col("v").alias("b")))
        named = lambda df, side: df.select(F.xxhash64("shard", F.lit(2 * r + side)).alias("shard"), "fp")
        met = near.withColumn("shard", F.xxhash64("shard", F.lit(-1 - r))), far.filter(F.col("d") <= 2 * RADIUS).withColumn("shard", F.xxhash64("shard", F.lit(-1 - r)))
        cores, fringes = (F.ceil(F.col(x) / block_size) for x in ("core", "fringe"))
        groups += [_dealt(met[0].filter("fringe > 0"), cores, "core", fringes, True), _dealt(met[1], fringes, "fringe", cores, False)]
        following = [named(split.filter(F.col("d") <= F.col("t") + RADIUS), 0), named(split.filter(F.col("d") > F.col("t")), 1), named(far, 0), kept.select("shard", "fp")]
        placed = staged(reduce(DataFrame.unionByName, following), "placed")
    settled.append(placed)
    groups.append(_in_blocks(reduce(DataFrame.unionByName, settled), block_size))
    return reduce(DataFrame.unionByName, groups), reduce(DataFrame.unionByName, edges) if edges else None


def _in_blocks(placed: DataFrame, block_size: int) -> DataFrame:
    """``shard``, ``fp``, ``i``, ``j``: shards, those of over ``block_size`` over all pairs of their blocks."""
    large = staged(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_size), "large-shards")
    if large.isEmpty():
        return placed.select("shard", "fp", F.lit(0).alias("i"), F.lit(0).alias("j"))
    cut = placed.join(large, "shard", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block_size), F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut.select("shard", "fp", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"))


def links(nodes: DataFrame, shard_size: int = SHARD_SIZE, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``a``, ``b`` (mixed fingerprints): edges with the components of all links."""
    spark = nodes.sparkSession
    n = nodes.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / shard_size))))
    groups, edges = parted(shards(nodes, levels), block_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _by_group(batches, ["shard", "i", "j"]):
            for a, b in local_links(np.unique(fp)):
                yield pa.RecordBatch.from_arrays([pa.array(mix(a).view(np.int64)), pa.array(mix(b).view(np.int64))], ["a", "b"])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [mix(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

    dealt = groups.repartition(shuffle_width(spark), "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    found = dealt.mapInArrow(run, "a long, b long")
    return found if edges is None else found.unionByName(edges.mapInArrow(renamed, "a long, b long"))


def near_duplicates(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the least ``doc_id`` that links reach; null only if all
    those ids are null.  A null text has no words, as an empty one: fingerprint
    zero, which links like any other.  Repeated rows and equal texts share a
    fingerprint and so a component.  Only ``doc_id`` and ``text`` are read.
    ``keyed`` adds the row's key and the root of its component.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    nodes = staged(prints.groupBy("fp", "node").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes))
    rooted = staged(nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "rooted")
    classes = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "classes")
    named = staged(rooted.join(classes, "root").select("node", "root", "component_id"), "named")
    return prints.join(named, "node").select("doc_id", "fp", "component_id", *["root", "key_id", "key_text"][: 3 * keyed])


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least ``doc_id``.

    Where rows repeat that id, one of them stays.  Rows of components without
    any id are kept as one row too.
    """
    keyed = carried(docs).drop("text")
    names = near_duplicates(docs, keyed=True)
    own = names.groupBy("component_id", "root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "key_id", "key_text")).alias("least"))
    chosen = staged(own.select("least.key_id", "least.key_text").distinct(), "chosen")
    one = keyed.join(chosen, ["key_id", "key_text"], "left_semi").dropDuplicates(["key_id", "key_text"])
    return one.select("row.*")


def digests(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 hexadecimal digits; one row for each row of ``docs``, null and empty texts included (all zeros)."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
