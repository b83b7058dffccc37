"""Bounded samples of labelled rows, models fitted to them in one task, and sums over all rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, released, squeezed, text_blocks
from .tables import staged

#: Labelled rows that a model is fitted to: so many at most, of so many bytes in all.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16 << 20
#: Vectors that come to the driver from one sum over all rows.
FAN = 4
LONG = 100_000


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of labelled rows: those whose id has the least hash, at most ``rows`` of them and ``size`` bytes.

    Whole texts only; one of more than an eighth of ``size`` is not taken into
    the sample.  Rows with equal id, text and label count once.  The tables are
    read in parallel and the bounds are applied after the join, so an id that
    many rows have takes no more than its share.
    """
    wanted = labels.filter(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    ids = staged(wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows), "sample-ids")
    key = ["doc_id", "label", "key", "bytes"]
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(ids), "doc_id").withColumns({"key": F.xxhash64("text"), "bytes": F.octet_length("text")}).filter(F.col("bytes") <= size // 8)
    found = staged(texts.dropDuplicates(key), "sample-texts")
    order = [F.xxhash64("doc_id"), "doc_id", "label", "key"]
    least = found.select(*key).orderBy(*order).limit(rows)
    # A window over at most ``rows`` rows.
    within = least.withColumn("upto", F.sum("bytes").over(Window.orderBy(*order))).filter(F.col("upto") <= size).drop("upto")
    return staged(found.join(F.broadcast(staged(within, "sample-keys")), key).select("doc_id", "text", "label"), "sample")


def fitted(sample: DataFrame, fit: Callable[[list[Block], list[int | None]], object]):
    """What ``fit`` makes of a staged, bounded sample, in a single task that sees it in a fixed order.

    ``fit`` gets the texts as blocks, and the labels.  Only the model goes to
    the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = []
        labels: list[int | None] = []
        for batch in batches:
            blocks += text_blocks(batch.column("text"))
            labels += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(blocks, labels))], pa.binary())})

    one = sample.select("doc_id", "text", "label").coalesce(1).sortWithinPartitions("doc_id", "label", F.xxhash64("text"))
    found = staged(one.mapInArrow(run, "model binary"), "model").collect()
    return pickle.loads(found[0][0]) if found else fit([], [])


def summed(df: DataFrame, size: int, vectors: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum of the vectors (``size`` doubles) that ``vectors`` makes of the batches of each partition.

    A partition adds up its own; the sums meet in a tree, some ``FAN ** 2`` in a
    task, until the driver adds ``FAN`` vectors, whatever the number of
    partitions.  They travel compressed, long ones with the seven digits of
    float32.
    """
    kind = np.float64 if size < LONG else np.float32

    def total(arrays: Iterator[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(size), False
        for x in arrays:
            out += x
            some = True
        if some:  # however many partitions have nothing
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % parts], pa.int32()), pa.array([squeezed(out, kind)])], ["part", "sums"])

    def again(parts: int) -> Callable:
        return lambda batches: total((released(x.as_py(), kind, size) for batch in batches for x in batch.column("sums")), parts)

    schema, n = "part int, sums binary", df._jdf.queryExecution().toRdd().getNumPartitions()
    width = max(FAN, n // FAN**2)
    sums = df.mapInArrow(lambda batches: total(vectors(batches), width), schema)
    while True:
        following = max(FAN, width // FAN**2)
        sums = sums.repartition(width, "part").mapInArrow(again(following), schema)
        if width <= FAN:
            break
        width = following
    return np.sum([released(bytes(r.sums), kind, size) for r in sums.collect()] or [np.zeros(size)], axis=0, dtype=np.float64)
