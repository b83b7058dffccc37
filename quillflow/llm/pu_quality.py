"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; all documents are the
unlabelled text.  A linear model over hashed n-grams minimises the non-negative
unbiased risk

    prior * E_p[l(s)] + max(0, E_u[l(-s)] - prior * E_p[l(-s)])

with the logistic loss.  Where the second term is negative its gradient is
reversed, which takes back the overfitting that made it so.

E_p is the mean over a bounded sample of labelled rows, E_u that over all
documents, in three steps:

1. ``begin``: in one task, a first model from the sample alone, whose texts
   stand for the unlabelled ones too (labels hidden), and two models that tell
   positives from the rest, each blind to one half of all texts (by a hash);
2. ``over_all``: one pass over all documents sums the gradient of E_u at the
   first model, and counts scores by the model that is blind to the text, from
   which ``class_prior`` estimates the prior;
3. ``finish``: in one task, the risk is minimised anew, with the sample's E_u
   tilted so that its value and gradient at the first model are those of all
   documents (the communication-efficient surrogate likelihood).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, byte_hash, text_blocks
from .features import DENSE, WEIGHTS, Counts, Matrix, descend, grams, linear, sigmoid, slope_sums
from .training import SAMPLE_BYTES, SAMPLE_ROWS, fitted, fold, labelled_sample, summed

PREDICT_AT = 0.7
STEPS = 100
PRIOR_STEPS = 40
#: Bins of scores from -16 to 16.
BINS = 2048

Weights = tuple[np.ndarray, np.ndarray, float]


class Start(NamedTuple):
    blind: tuple[Weights, Weights]  # the model k hasn't seen texts of half k
    positives: np.ndarray  # of each bin of scores
    model: Weights


def _half(block: Block) -> np.ndarray:
    """0 or 1 by a hash of the text, so that copies of a text are in one half."""
    return (byte_hash(block.data).span(block.offsets[:-1], block.offsets[1:]) >> np.uint64(7) & np.uint64(1)).astype(np.int64)


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.clip((scores + 16) * (BINS / 32), 0, BINS - 1).astype(np.int64)


def class_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from the numbers of either in bins of rising scores.

    Among thresholds that at least a fifth of the positives pass, the least
    ratio of the unlabelled share above it to the positive share, with a margin
    for chance, bounds the prior from above most tightly (best bin estimate).
    """
    n, m = positives.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    p, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positives, unlabelled))
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    best = np.argmin(np.where(p >= 0.2, (u + margin) / np.maximum(p, 1e-9), np.inf))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def pu_slope(positive: np.ndarray, prior: float, extra: Callable[[list], float] = lambda theta: 0.0) -> Callable:
    """Slope of the risk at every row; all rows are unlabelled, and the positive ones trusted besides.

    ``extra`` is added to E_u before its sign counts.
    """
    n, n_p = max(1, len(positive)), max(1, int(positive.sum()))

    def slope(scores: np.ndarray, theta: list) -> np.ndarray:
        down, loss = sigmoid(scores), np.logaddexp(0, scores)  # of l(-s)
        rest = loss.sum() / n + extra(theta) - prior * loss[positive].sum() / n_p
        sign = 1.0 if rest >= 0 else -1.0
        slope.sign = sign
        return sign * (down / n - np.where(positive, prior * down / n_p, 0)) + np.where(positive, prior * (down - 1) / n_p, 0) * (sign > 0)

    slope.sign = 1.0
    return slope


def begin(blocks: list[Block], labels: list[int]) -> Start:
    nothing = (np.zeros(WEIGHTS, dtype=np.float32), np.zeros(DENSE), 0.0)
    if not labels:
        return Start((nothing, nothing), np.zeros(BINS), nothing)
    matrix, positive, half = Matrix(blocks), np.array([x == 1 for x in labels]), np.concatenate([_half(b) for b in blocks])
    blind, scores = [], np.zeros(matrix.n)
    for k in (0, 1):
        seen = half != k
        weight = np.where(positive, 1 / max(1, (seen & positive).sum()), 1 / max(1, (seen & ~positive).sum())) * seen
        model = descend(matrix, lambda s, _, w=weight: (sigmoid(s) - positive) * w, PRIOR_STEPS)
        blind.append((model[0].astype(np.float32), *model[1:]))
        scores = np.where(half == k, matrix.scores(*model), scores)
    counts = np.bincount(_bins(scores[positive]), minlength=BINS)
    prior = class_prior(counts, np.bincount(_bins(scores), minlength=BINS))
    model = descend(matrix, pu_slope(positive, prior), STEPS)
    return Start(tuple(blind), counts, (model[0].astype(np.float32), *model[1:]))


def over_all(docs: DataFrame, start: Start) -> tuple[np.ndarray, float, np.ndarray]:
    """Numbers of all rows in each bin of scores, and E_u and its gradient at the first model."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                counts, half = Counts(block), _half(block)
                found = [*grams(counts)]
                scores = np.where(half == 0, linear(counts, *start.blind[0], found), linear(counts, *start.blind[1], found))
                own = linear(counts, *start.model, found)
                yield np.concatenate([np.bincount(_bins(scores), minlength=BINS), [np.logaddexp(0, own).sum()], slope_sums(counts, sigmoid(own), found)])

    total = summed(docs.select(F.col("text").cast("string").alias("text")), BINS + 1 + WEIGHTS + DENSE + 1, vectors)
    n = max(1.0, total[:BINS].sum())
    return total[:BINS], total[BINS] / n, total[BINS + 1 :] / n


def finish(blocks: list[Block], labels: list[int], start: Start, prior: float, loss: float, gradient: np.ndarray) -> Weights:
    if not labels:
        return start.model
    matrix, positive = Matrix(blocks), np.array([x == 1 for x in labels])
    scores = matrix.scores(*start.model)
    g = matrix.gradient(sigmoid(scores) / matrix.n)
    known = np.bincount(matrix.columns, minlength=WEIGHTS) > 0
    # A bucket that the sample doesn't have stays as it is.
    tilt = [np.where(known, gradient[:WEIGHTS] - g[0], 0), gradient[WEIGHTS:-1] - g[1], np.array([gradient[-1] - g[2]])]
    origin = [start.model[0].astype(np.float64), start.model[1], np.array([start.model[2]])]
    shift = loss - np.logaddexp(0, scores).mean()
    slope = pu_slope(positive, prior, lambda theta: shift + sum(float(t @ (x - o)) for t, x, o in zip(tilt, theta, origin, strict=True)))
    weights, dense_weights, bias = descend(matrix, slope, STEPS // 2, rate=0.1, start=start.model, tilt=lambda theta: [slope.sign * t for t in tilt])
    return weights.astype(np.float32), dense_weights, bias


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[Weights, float]:
    """A model and the class prior, from at most ``rows`` labelled rows (of ``size`` bytes) and all of ``docs``.

    Labels come only from rows whose id is not in the held-out fold.  Without
    labels all scores are one half.
    """
    sample = labelled_sample(docs, labels, "quality", fold(4) != 2, rows, size)
    start = fitted(sample, begin)
    bins, loss, gradient = over_all(docs, start)
    prior = class_prior(start.positives, bins)
    return fitted(sample, lambda blocks, own: finish(blocks, own, start, prior, loss, gradient)), prior


def scores(docs: DataFrame, model: Weights) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row.

    A null text is scored as an empty one; a null id is in no fold
    (``held_out`` false).  Rows are scored one by one, so repeats and ties come
    out alike and an empty table stays empty.  Only ``doc_id`` and ``text`` are
    read, and ``doc_id`` only for the fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                p = sigmoid(linear(Counts(block), *model))
                ids, held = (batch.column(c).slice(block.lo, block.rows) for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
