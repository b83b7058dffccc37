"""Toxicity by weak supervision.

*Voters.*  Each is a word of a lexicon or a pattern (words that begin with a
given run of letters) and votes "toxic" where it occurs, else abstains; that it
occurs at all is one voter, that it occurs once or again and as a notable share
of the words or not is another.  They are mined from a bounded sample of
labelled rows: words and beginnings that many more toxic than other rows have.
All that pass the limits of evidence vote; those that occur in the very same
labelled rows (a word and its beginnings, mostly) are one voter, which votes
where any of them does.

*Label model.*  A generative model says how often each voter votes in either
class.  Expectation and maximisation fit these rates and the class share to
*all* documents, from a start that the labelled rows give.  Voters are not
independent (a word and its beginning vote together), so their correlations
within the classes are estimated too, and the weight of a vote is divided by
the number of votes that it goes along with.  A voter that abstains says
nothing; that all of them do counts as a vote of its own.  The documents' votes
are found once and kept as a table of patterns with counts (``patterns``); a
round sums statistics of fixed size over it.

*Classifier.*  A linear model over votes, their rate and the text's length is
trained on the posteriors of the labelled sample's texts; it alone scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, Block, byte_hash, mix, row_of, separators, text_blocks
from .features import sigmoid
from .tables import staged
from .training import SAMPLE_BYTES, SAMPLE_ROWS, fitted, fold, labelled_sample, summed

PREDICT_AT = 0.7
#: Letters of the beginnings that patterns may have.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: In nats: a token of no meaning gets as far once in e**12 = 160,000 times.
MIN_EVIDENCE = 12.0
#: Of the rates in toxic and in clean rows.
MIN_RATIO = 50.0
DENSE_SHARE = 0.005
ROUNDS = 12
#: Rounds that estimate the correlations.
CORRELATED = (1, 4)
#: Keys that mining holds at a time.
MINED_KEYS = 1 << 23

#: Words are runs of letters, digits and all that isn't ASCII.
_MARKS = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Model(NamedTuple):
    tokens: np.ndarray  # sorted keys of the words and beginnings that voters look at
    keys: np.ndarray  # sorted; of what voters look for
    voters: np.ndarray  # voter of each key
    prior: float  # posterior share of toxic texts
    toxic_rate: np.ndarray
    clean_rate: np.ndarray
    weights: np.ndarray  # of each voter, of all votes, of their rate and of the length
    bias: float


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of every word and beginning of a word, and the words of each row.

    A key is the hash of the letters and of which it is: 0 for a whole word,
    the number of letters for a beginning.
    """
    data = LOWER[block.data]
    starts, ends, first = Block(block.lo, block.hi, data, block.offsets).words(_MARKS)
    row, h = row_of(first), byte_hash(data)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    rank = np.searchsorted(leads, starts)
    rows, keys = [row], [mix(h.span(starts, ends))]
    for size in PREFIXES:
        at = rank + size
        long = at < len(leads)
        stop = np.full(len(starts), len(data) + 1, dtype=np.int64)
        stop[long] = leads[at[long]]
        inside = np.flatnonzero(stop < ends)  # a proper beginning
        rows.append(row[inside])
        keys.append(mix(h.span(starts[inside], stop[inside]) ^ np.uint64(size)))
    return np.concatenate(rows), np.concatenate(keys), np.diff(first)


def voter_keys(row: np.ndarray, key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and voter of every different token of a row.

    Each has two voters: that it occurs, and the same with whether it stands
    there again and whether it is ``DENSE_SHARE`` of the words.
    """
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(key)))
    row, key = row[begin], key[begin]
    level = (np.minimum(times, 2) + 2 * (times >= DENSE_SHARE * words[row])).astype(np.uint64)
    return np.tile(row, 2), np.tile(key, 2), np.concatenate([mix(key), mix(key + level)])


def _counted(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of all parts and their numbers; parts are merged as they come."""
    keys, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for part in parts:
        own, times = np.unique(part, return_counts=True)
        every = np.concatenate([keys, own])
        keys, inverse = np.unique(every, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n, times]), minlength=len(keys)).astype(np.int64)
    return keys, n


def mine(toxic: list[Block], clean: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and keys, both sorted, the voter of each key, and the voters' rates in toxic and in clean labelled rows.

    Evidence asks for a number of toxic rows, so those come first, a range of
    keys at a time; of the clean ones only the keys that are left count.  Memory
    thus follows ``MINED_KEYS`` and the largest block, not the texts.
    """
    n_toxic, n_clean = (max(1, sum(b.rows for b in x)) for x in (toxic, clean))
    share = n_toxic / (n_toxic + n_clean)
    least = max(2, int(np.ceil(MIN_EVIDENCE / -np.log(share))))
    # A word has at most 7 tokens, each of two voters.
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, 7 * sum(len(b.data) for b in toxic) / MINED_KEYS)))))
    found = []
    for k in range(ranges):
        own = _counted(v[(v >> np.uint64(1)) % np.uint64(ranges) == k] if ranges > 1 else v for v in (voter_keys(*tokens(b))[2] for b in toxic))
        found.append((own[0][own[1] >= least], own[1][own[1] >= least]))
    keys, up = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys)
    keys, up = keys[order], up[order]
    down = np.zeros(len(keys), dtype=np.int64)
    for block in clean:
        at, there = _find(keys, voter_keys(*tokens(block))[2])
        down += np.bincount(at[there], minlength=len(keys))
    token = np.zeros(len(keys), dtype=np.uint64)  # that each key looks at
    rows, base = np.zeros(len(keys), dtype=np.uint64), 0  # sum of the hashes of a key's rows
    for block in toxic + clean:
        row, own, voter = voter_keys(*tokens(block))
        at, there = _find(keys, voter)
        token[at[there]] = own[there]
        np.add.at(rows, at[there], mix((base + row[there] + 1).astype(np.uint64)))
        base += block.rows
    a, b = (up + 0.5) / (n_toxic + 1), (down + 0.5) / (n_clean + 1)
    # Log-likelihood ratio against a token that knows nothing of the classes.
    strength = up * np.log(up / ((up + down) * share)) + down * np.log(np.maximum(down, 1) / ((up + down) * (1 - share)))
    good = np.flatnonzero((strength >= MIN_EVIDENCE) & (a / b >= MIN_RATIO))
    _, example, voters = np.unique(rows[good], return_index=True, return_inverse=True)
    return np.unique(token[good]), keys[good], voters, a[good][example], b[good][example]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def votes(block: Block, known: np.ndarray, keys: np.ndarray, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of votes (rows by voters), tokens with a voter, and words of each row."""
    row, key, words = tokens(block)
    hit = _find(known, key)[1]
    row, key = row[hit], key[hit]
    out = np.zeros((block.rows, int(voters.max(initial=-1)) + 1), dtype=bool)
    own, _, voter = voter_keys(row, key, words)
    at, there = _find(keys, voter)
    out[own[there], voters[at[there]]] = True
    return out, np.bincount(row, minlength=block.rows), words


class Rates(NamedTuple):
    """Parameters of the label model."""

    prior: float
    toxic: np.ndarray  # how often each voter votes in toxic texts
    clean: np.ndarray
    mute: tuple[float, float]  # how often none does, in either
    along: np.ndarray  # votes that each goes along with, itself included

    @classmethod
    def start(cls, toxic: np.ndarray, clean: np.ndarray, prior: float) -> Rates:
        return cls(prior, np.clip(toxic, 1e-4, 0.99), np.clip(clean, 1e-5, 0.5), (0.05, 0.9), np.ones(len(toxic)))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Of the toxic class, for rows of votes."""
        weight = np.log(self.toxic / self.clean) / self.along
        none = np.log(self.mute[0] / self.mute[1])
        return sigmoid(np.log(self.prior / (1 - self.prior)) + np.where(x.any(axis=1), x @ weight, none))


def statistics(x: np.ndarray, n: np.ndarray, rates: Rates, pairs: bool) -> np.ndarray:
    """Sums over rows of votes (each standing ``n`` times): texts, mute texts, votes and, if asked, pairs of votes, by the posterior of either class."""
    q, mute = rates.posterior(x), ~x.any(axis=1)
    out = []
    for weight in (q * n, (1 - q) * n):
        own = [weight.sum(), weight @ mute, *(weight @ x)]
        out.append(np.concatenate([own, ((x * weight[:, None]).T @ x).ravel()]) if pairs else np.array(own))
    return np.concatenate(out)


def improved(rates: Rates, sums: np.ndarray, k: int, pairs: bool, seen: Rates) -> Rates:
    """The next round's parameters.  Weak pseudo-counts hold each voter to where the labelled rows saw it (``seen``)."""
    (mass, mute, votes, both), (clean_mass, clean_mute, clean_votes, clean_both) = ((x[0], x[1], x[2 : 2 + k], x[2 + k :]) for x in np.split(sums, 2))
    along = rates.along
    if pairs:
        along = np.ones(k)
        for total, one, two in ((mass, votes, both), (clean_mass, clean_votes, clean_both)):
            if total > 20:
                mean = one / total
                cov = two.reshape(k, k) / total - np.outer(mean, mean)
                deviation = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                correlation = np.clip(cov / np.outer(deviation, deviation), 0, 1)
                np.fill_diagonal(correlation, 0)
                along = np.maximum(along, 1 + np.where(correlation > 0.5, correlation, 0).sum(axis=1))
    return Rates(
        float(np.clip((mass + 1) / (mass + clean_mass + 10), 1e-3, 0.5)), np.clip((votes + 100 * seen.toxic) / (mass + 100), 1e-4, 0.99), np.clip((clean_votes + 100 * seen.clean) / (clean_mass + 100), 1e-6, 0.5),
        ((mute + 1) / (mass + 20), (clean_mute + 20) / (clean_mass + 20)), along,
    )


def label_model(start: Rates, sums: Callable[[Rates, bool], np.ndarray]) -> Rates:
    """Rates by expectation and maximisation; ``sums`` are the ``statistics`` of all texts."""
    rates, k = start, len(start.toxic)
    for r in range(ROUNDS if k else 0):
        pairs = r in CORRELATED
        new = improved(rates, sums(rates, pairs), k, pairs, start)
        done = abs(new.prior - rates.prior) < 1e-6 and np.abs(np.log(new.toxic / rates.toxic)).max() < 1e-3
        rates = new
        if done and r > CORRELATED[-1]:
            break
    return rates


def _inputs(fired: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    share = total / np.maximum(words, 1)
    return np.concatenate([fired.astype(np.float64), np.stack([np.log1p(total), np.minimum(100 * share, 10) / 3, np.log1p(words) / 5], axis=1)], axis=1)


def train_linear(x: np.ndarray, q: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors, by full-batch Adam with a little decay."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for step in range(1, steps + 1):
        g = x.T @ (sigmoid(x @ w) - q) / max(1, len(x)) + 1e-4 * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (1 - step / (steps + 1)) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


class Mined(NamedTuple):
    """What the labelled sample gives: voters, their rates there, and the sample's votes."""

    tokens: np.ndarray
    keys: np.ndarray
    voters: np.ndarray
    start: Rates
    fired: np.ndarray  # rows by voters, packed to bits
    total: np.ndarray
    words: np.ndarray


def fit(blocks: list[Block], labels: list[int]) -> Mined:
    """Voters from labelled texts; memory follows the votes, a bit for each text and voter."""
    marks, base = np.array([x == 1 for x in labels], dtype=bool), 0
    toxic: list[Block] = []
    clean: list[Block] = []
    for block in blocks:
        own = marks[base : base + block.rows]
        base += block.rows
        for into, wanted in ((toxic, own), (clean, ~own)):
            if wanted.any():
                data = block.data[np.repeat(wanted, np.diff(block.offsets))]
                into.append(Block(0, int(wanted.sum()), data, np.concatenate([[0], np.cumsum(np.diff(block.offsets)[wanted])])))
    if not toxic:
        none = np.zeros(0)
        return Mined(none.astype(np.uint64), none.astype(np.uint64), none.astype(np.int64), Rates.start(none, none, 0.01), np.zeros((0, 0), dtype=np.uint8), none, none)
    looked_at, keys, voters, a, b = mine(toxic, clean)
    parts = [votes(block, looked_at, keys, voters) for block in toxic + clean]
    total, words = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    share = float(np.clip(marks.mean(), 1e-3, 0.5))
    return Mined(looked_at, keys, voters, Rates.start(a, b, share), np.concatenate([np.packbits(p[0], axis=1) for p in parts]), total, words)


def patterns(docs: DataFrame, mined: Mined) -> DataFrame:
    """``votes`` (a bit for each voter) and ``n``: how many rows vote like that; one row for each pattern in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                bits = np.packbits(votes(block, mined.tokens, mined.keys, mined.voters)[0], axis=1)
                each, n = np.unique(bits, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in each], pa.binary()), pa.array(n)], ["votes", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "votes binary, n long")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``rows`` labelled rows (of ``size`` bytes) and the votes over all of ``docs``.

    Labels come only from rows whose id is not in the held-out fold.  Without
    toxic labels no voter is found, and nothing is predicted to be toxic.
    """
    mined = fitted(labelled_sample(docs, labels, "toxic", fold(3) != 1, rows, size), fit)
    k = len(mined.start.toxic)
    if not k:
        return Model(mined.tokens, mined.keys, mined.voters, 0.0, mined.start.toxic, mined.start.clean, np.zeros(3), -5.0)
    seen = staged(patterns(docs, mined), "votes")

    def sums(rates: Rates, pairs: bool) -> np.ndarray:
        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                bits = np.frombuffer(b"".join(batch.column("votes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                for i in range(0, batch.num_rows, 2048):
                    x = np.unpackbits(bits[i : i + 2048], axis=1, count=k).astype(np.float64)
                    yield statistics(x, batch.column("n").to_numpy(zero_copy_only=False)[i : i + 2048], rates, pairs)

        return summed(seen, 2 * (2 + k + (k * k if pairs else 0)), vectors)

    rates = label_model(mined.start, sums)
    fired = np.unpackbits(mined.fired, axis=1, count=k).astype(bool)
    weights, bias = train_linear(_inputs(fired, mined.total, mined.words), rates.posterior(fired.astype(np.float64)))
    return Model(mined.tokens, mined.keys, mined.voters, rates.prior, rates.toxic, rates.clean, weights, bias)


def probabilities(block: Block, model: Model) -> np.ndarray:
    return sigmoid(_inputs(*votes(block, model.tokens, model.keys, model.voters)) @ model.weights + model.bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row.

    A null text is scored as an empty one; a null id is in no fold
    (``held_out`` false).  Rows are scored one by one, so repeats and ties come
    out alike and an empty table stays empty.  Only ``doc_id`` and ``text`` are
    read, and ``doc_id`` only for the fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                p = probabilities(block, model)
                ids, held = (batch.column(c).slice(block.lo, block.rows) for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic; the others stay as they are.

    A null text counts as empty, so it stays; rows that repeat stay or go
    together.  All columns are carried along, whatever their names; an empty
    table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                yield batch.slice(block.lo, block.rows).filter(pa.array(probabilities(block, model) < PREDICT_AT))

    return docs.mapInArrow(run, docs.schema)
