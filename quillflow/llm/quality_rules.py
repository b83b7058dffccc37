"""Quality rules: fixed base rules and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed character n-grams (1 to 4
bytes), word n-grams (1 and 2 words) and a few counts, trained on labelled
rows.  Platt scaling on rows kept out of the training turns its scores into
probabilities, which Arrow batches of whole texts are held against fixed
thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, text_blocks
from .features import DENSE, WEIGHTS, Counts, Matrix, descend, linear, platt, sigmoid
from .training import SAMPLE_ROWS, fitted, fold, labelled_sample

KEEP_AT = 0.5
MIN_WORDS = 20
REPEAT_PERCENT = 30
STEPS = 60


def fit(blocks: list[Block], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float, tuple[float, float]]:
    """Weights of the classifier, and its calibration from every fifth row."""
    if not labels:
        return np.zeros(WEIGHTS, dtype=np.float32), np.zeros(DENSE), 0.0, (1.0, 0.0)
    matrix, y = Matrix(iter(blocks)), np.array(labels, dtype=np.float64)
    apart = np.arange(len(y)) % 5 == 4
    share = np.where(apart, 0.0, 1.0) / max(1, (~apart).sum())
    weights, dense_weights, bias = descend(matrix, lambda s, _: (sigmoid(s) - y) * share, STEPS)
    scores = matrix.scores(weights, dense_weights, bias)
    return weights.astype(np.float32), dense_weights, bias, platt(scores[apart], y[apart])


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows: int = SAMPLE_ROWS):
    """A model from at most ``rows`` rows of ``labels.quality``; none gives probability one half."""
    allowed = F.lit(True) if allowed is None else allowed
    return fitted(labelled_sample(docs, labels, "quality", allowed, rows), fit)


def probabilities(counts: Counts, model) -> np.ndarray:
    weights, dense_weights, bias, (slope, intercept) = model
    return sigmoid(slope * linear(counts, weights, dense_weights, bias) + intercept)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def quality_rules(docs: DataFrame, model, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, verdict of the base rules, probability and verdict of every row.

    A null text has no words and fails the base rules, as an empty one does.
    Every row is judged by itself: repeats and ties come out alike, an empty
    table stays empty, and only ``doc_id`` and ``text`` are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                c = Counts(block)
                failed = (c.words < MIN_WORDS) | (100 * c.repeat_words > REPEAT_PERCENT * c.words)
                p = probabilities(c, model)
                columns = [c.words, c.word_chars, c.symbols, c.dup_lines, c.repeat_words, failed, ~failed & (p >= keep_at), p]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.lo, block.rows), *map(pa.array, columns)], OUT.replace(",", "").split()[::2])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, OUT)


def learn_from() -> Column:
    """The rows whose labels the query may learn from; the rest is for held-out tests."""
    return fold(4) != 2
