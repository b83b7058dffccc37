"""Embeddings behind a function that a caller plugs in; one model for each worker."""

from __future__ import annotations

import threading
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

DIMENSIONS = 384

#: Texts to a matrix of a row each.
Embed = Callable[[list[str]], np.ndarray]

_models: dict[tuple, Embed] = {}
_lock = threading.Lock()


def hashed_words(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A stand-in without a model: signed counts of hashed words and pairs."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for row, text in enumerate(texts):
        words = text.lower().split()
        for gram in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))):
            h = zlib.crc32(gram.encode())
            out[row, h % dimensions] += 1 if h >> 31 else -1
    return out


def offline() -> Embed:
    return hashed_words


def normalised(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, as float32; a row of zeros stays."""
    matrix = np.asarray(matrix, dtype=np.float32)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1)


def client(make: Callable[[], Embed], dimensions: int = DIMENSIONS) -> Embed:
    """The worker's one model: made at the first call, tried on a text, kept for later tasks."""
    key = (make.__module__, make.__qualname__, dimensions)
    with _lock:
        if key not in _models:
            model = make()
            shape = np.shape(model(["kiểm tra kết nối"]))
            if shape != (1, dimensions):
                raise ValueError(f"a text's embedding has shape {shape}, not {(1, dimensions)}")
            _models[key] = model
        return _models[key]


def embedded(rows: DataFrame, make: Callable[[], Embed] = offline, text: str = "text", out: str = "embedding", dimensions: int = DIMENSIONS, batch: int = 256) -> DataFrame:
    """``rows`` with the embedding of their text, of length one; a null text counts as empty."""
    kept = rows.drop(out)
    schema = StructType([*kept.schema.fields, StructField(out, ArrayType(FloatType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for lo in range(0, own.num_rows, batch):
                part = own.slice(lo, batch)
                matrix = normalised(client(make, dimensions)([x or "" for x in part.column(text).to_pylist()]))
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, dimensions), pa.int32()), pa.array(matrix.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    return kept.mapInArrow(run, schema)
