"""Counts and hashed n-gram features of whole texts, in numpy.

A text's value in a bucket is the share of its n-grams of one kind that fall
into it, so a linear score is a sum of means and needs no sparse matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .blocks import BLANKS, LOWER, Block, Sequence, byte_hash, mix, row_of, sums_by_row

BITS = 16
CHAR_ORDERS = (1, 2, 3, 4)
WORD_ORDERS = (1, 2)
KINDS = len(CHAR_ORDERS) + len(WORD_ORDERS)
WEIGHTS = KINDS << BITS
#: Bucket of a pair of equal words, whatever they are.
REPEAT = 0
REPEAT_WINDOW = 8

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b".,;:!?", dtype=np.uint8)] = True


class Counts:
    """Word and line counts of every row of a block."""

    def __init__(self, block: Block):
        self.block = block
        self.starts, self.ends, first = block.words(BLANKS)
        self.first = first
        self.words = np.diff(first)
        data, offsets = block.data, block.offsets
        self.hash = byte_hash(data)
        self.word_hash = self.hash.span(self.starts, self.ends)
        inside = ~BLANKS[data]
        self.word_chars = sums_by_row(inside & ((data & 0xC0) != 0x80), offsets)
        self.symbols = sums_by_row(SYMBOLS[data], offsets)
        self.lines, self.dup_lines = self._lines(inside)
        self.repeat_words = self._repeats()
        self.dense: np.ndarray | None = None

    def _lines(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line of the row."""
        data, offsets = self.block.data, self.block.offsets
        breaks = np.flatnonzero(data == 0x0A)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        starts = starts[starts < len(data)]
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        ends = ends - ((ends > starts) & (data[ends - 1] == 0x0A)) if len(starts) else ends
        count = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(inside, out=count[1:])
        some = count[ends] > count[starts]
        starts, ends = starts[some], ends[some]
        row = np.searchsorted(offsets, starts, side="right") - 1
        key = mix(self.hash.span(starts, ends) ^ mix(row.astype(np.uint64) + np.uint64(1)))
        _, example = np.unique(key, return_index=True)
        n = np.bincount(row, minlength=self.block.rows)
        return n, n - np.bincount(row[example], minlength=self.block.rows)

    def _repeats(self) -> np.ndarray:
        """Words inside windows of ``REPEAT_WINDOW`` words that stand twice or more in their row."""
        window, first, total = REPEAT_WINDOW, self.first, len(self.starts)
        at = np.arange(max(0, total - window + 1))
        row = row_of(first)
        if not len(at):
            return np.zeros(self.block.rows, dtype=np.int64)
        at = at[row[at] == row[at + window - 1]]
        key = mix(Sequence(self.word_hash).runs(window)[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(total + 1, dtype=np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + window, -1)
        return np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=self.block.rows)


DENSE = 10


def dense(counts: Counts) -> np.ndarray:
    """``DENSE`` numbers for every row, each of about unit size."""
    if counts.dense is not None:
        return counts.dense
    block = counts.block
    data, offsets = block.data, block.offsets
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(counts.words, 1)
    equal = np.zeros(len(counts.word_hash), dtype=bool)
    equal[1:] = counts.word_hash[1:] == counts.word_hash[:-1]
    out = np.stack([
        np.log1p(counts.words) / 5, counts.word_chars / words / 8, np.minimum(counts.symbols / words, 2), sums_by_row(_UPPER[data], offsets) / size * 4,
        sums_by_row(_DIGIT[data], offsets) / size * 4, sums_by_row(_MARK[data], offsets) / words * 2, counts.dup_lines / np.maximum(counts.lines, 1) * 2,
        counts.repeat_words / words * 2, sums_by_row(equal, counts.first) / words * 2, (counts.words < 20) * 1.0,
    ], axis=1)
    counts.dense = out
    return out


def grams(counts: Counts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, bucket of every n-gram of that kind, and the rows' bounds in them."""
    block, first = counts.block, counts.first
    data, offsets = block.data, block.offsets
    size = np.diff(offsets)
    code = np.zeros(len(data), dtype=np.uint64)
    for kind, order in enumerate(CHAR_ORDERS):
        shifted = data[order - 1 :].astype(np.uint64) << np.uint64(8 * (order - 1))
        code[: len(shifted)] |= shifted
        bucket = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
        kept = np.maximum(size - order + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(kept)])
        inside = np.ones(len(data), dtype=bool)
        for k in range(1, order):
            ends = offsets[1:] - k
            inside[ends[ends >= offsets[:-1]]] = False
        yield kind, bucket[inside], bounds
    lowered = byte_hash(LOWER[data]).span(counts.starts, counts.ends)
    yield len(CHAR_ORDERS), (lowered >> np.uint64(64 - BITS)).astype(np.int64), first
    pair = np.zeros(len(lowered), dtype=np.int64)
    pair[1:] = mix(lowered[:-1] * np.uint64(3) ^ lowered[1:]) >> np.uint64(64 - BITS)
    pair[1:][lowered[1:] == lowered[:-1]] = REPEAT
    inside = np.ones(len(lowered), dtype=bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    yield len(CHAR_ORDERS) + 1, pair[inside], np.concatenate([[0], np.cumsum(np.maximum(counts.words - 1, 0))])


Grams = list[tuple[int, np.ndarray, np.ndarray]]


def linear(counts: Counts, weights: np.ndarray, dense_weights: np.ndarray, bias: float, found: Grams | None = None) -> np.ndarray:
    """Linear score of every row; ``found`` are the block's n-grams, if they are known already."""
    out = bias + dense(counts) @ dense_weights
    for kind, bucket, bounds in grams(counts) if found is None else found:
        total = np.zeros(len(bucket) + 1)
        np.cumsum(np.take(weights[kind << BITS : (kind + 1) << BITS], bucket), out=total[1:])
        out += (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    return out


def slope_sums(counts: Counts, slope: np.ndarray, found: Grams | None = None) -> np.ndarray:
    """Gradient of a block's loss: of all weights, of the dense ones and of the bias, in one vector."""
    out = np.zeros(WEIGHTS + DENSE + 1)
    for kind, bucket, bounds in grams(counts) if found is None else found:
        n = np.diff(bounds)
        out[kind << BITS : (kind + 1) << BITS] = np.bincount(bucket, np.repeat(slope / np.maximum(n, 1), n), minlength=1 << BITS)
    out[WEIGHTS:-1], out[-1] = dense(counts).T @ slope, slope.sum()
    return out


class Matrix:
    """Sparse feature rows for training: 8 bytes an entry, in runs of one row each."""

    STEP = 1 << 21

    def __init__(self, blocks: Iterable[Block]):
        columns, values, rows, lengths, dense_rows = [], [], [], [], []
        n = 0
        for block in blocks:
            counts = Counts(block)
            dense_rows.append(dense(counts))
            for kind, bucket, bounds in grams(counts):
                key, times = np.unique(row_of(bounds) << BITS | bucket, return_counts=True)
                row = key >> BITS
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                rows.append(row[begin] + n)
                lengths.append(np.diff(np.append(begin, len(row))))
                columns.append(((key & ((1 << BITS) - 1)) + (kind << BITS)).astype(np.int32))
                values.append((times / np.diff(bounds)[row]).astype(np.float32))
            n += block.rows

        def all_of(parts: list[np.ndarray], kind: type) -> np.ndarray:
            return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, dtype=kind)

        self.n = n
        self.columns, self.values = all_of(columns, np.int32), all_of(values, np.float32)
        self.rows, self.lengths = all_of(rows, np.int64), all_of(lengths, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.dense = np.concatenate(dense_rows) if dense_rows else np.zeros((0, DENSE))
        # Runs are taken some at a time, which bounds what a step holds besides.
        cuts = np.searchsorted(self.bounds, np.arange(0, int(self.bounds[-1]) + self.STEP, self.STEP))
        self.pieces = [(lo, hi) for lo, hi in zip(np.unique(cuts).tolist(), np.unique(cuts).tolist()[1:], strict=False)] if len(self.rows) else []
        if self.pieces:
            self.pieces[-1] = (self.pieces[-1][0], len(self.rows))

    def scores(self, weights: np.ndarray, dense_weights: np.ndarray, bias: float) -> np.ndarray:
        out = self.dense @ dense_weights + bias
        for lo, hi in self.pieces:
            own = slice(self.bounds[lo], self.bounds[hi])
            sums = np.add.reduceat(self.values[own] * weights[self.columns[own]], self.bounds[lo:hi] - self.bounds[lo])
            out += np.bincount(self.rows[lo:hi], sums, minlength=self.n)
        return out

    def gradient(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        out = np.zeros(WEIGHTS)
        for lo, hi in self.pieces:
            own = slice(self.bounds[lo], self.bounds[hi])
            out += np.bincount(self.columns[own], self.values[own] * np.repeat(residual[self.rows[lo:hi]], self.lengths[lo:hi]), minlength=WEIGHTS)
        return out, self.dense.T @ residual, float(residual.sum())


def descend(matrix: Matrix, loss_slope, steps: int, rate: float = 0.3, decay: float = 1e-6, start=None, tilt=None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by full-batch Adam; ``loss_slope(scores, theta)`` is d loss / d score of every row.

    ``start`` is where it begins and what decay pulls to; ``tilt(theta)`` is
    added to the gradient.
    """
    theta = [np.zeros(WEIGHTS), np.zeros(DENSE), np.zeros(1)] if start is None else [start[0].astype(np.float64), start[1].copy(), np.array([start[2]])]
    origin = [x.copy() for x in theta]
    rates = [rate * 10, rate, rate]  # shares are small numbers
    first = [np.zeros_like(x) for x in theta]
    second = [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        g = matrix.gradient(loss_slope(matrix.scores(theta[0], theta[1], theta[2][0]), theta))
        more = tilt(theta) if tilt else (0, 0, 0)
        for k, gradient in enumerate((g[0] + more[0] + decay * (theta[0] - origin[0]), g[1] + more[1] + 1e-4 * (theta[1] - origin[1]), np.array([g[2]]) + more[2])):
            first[k] += 0.1 * (gradient - first[k])
            second[k] += 0.01 * (gradient**2 - second[k])
            size = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9
            theta[k] -= rates[k] * (1 - step / (steps + 1)) * first[k] / (1 - 0.9**step) / size
    return theta[0], theta[1], float(theta[2][0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into calibrated log-odds (Newton steps, smoothed targets)."""
    if not len(labels):
        return 1.0, 0.0
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    w = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(100):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
