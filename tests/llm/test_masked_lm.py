import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quillflow.llm import masked_lm as M
from quillflow.llm.blocks import text_blocks


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    net = M.Network(rng.normal(0, 0.3, M.Network.SIZE))
    around, middle = rng.integers(0, M.CLASSES + 1, (4, 50)), rng.integers(0, M.CLASSES, 50)
    before = -net.log_probabilities(around, middle).mean()
    old = net.vector.copy()
    net.squares[:] = 1.0  # so that a step is nearly rate * gradient
    net.learn(around, middle, 1e-2)
    moved = (net.vector - old).astype(np.float64)
    after = -M.Network(net.vector).log_probabilities(around, middle).mean()
    assert math.isclose(after - before, -(moved**2).sum() / 1e-2, rel_tol=0.05)


def test_probabilities_add_up_to_one():
    net = M.Network(np.random.default_rng(3).normal(0, 0.5, M.Network.SIZE))
    around = np.repeat(np.array([[1], [2], [M.CLASSES], [5]]), M.CLASSES, axis=1)
    assert math.isclose(np.exp(net.log_probabilities(around, np.arange(M.CLASSES))).sum(), 1, rel_tol=1e-4)


def test_neighbours_stay_in_their_text():
    got = M.neighbours(np.array([10, 11, 12, 20]), np.array([0, 3, 3, 4]))
    c = M.CLASSES
    assert got.T.tolist() == [[c, c, 11, 12], [c, 10, 12, c], [10, 11, c, c], [c, c, c, c]]


def test_lexicon_is_a_distribution(spark):
    rows = [(i, " ".join(f"w{random.Random(i * 31 + k).randrange(300)}" for k in range(50))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = M.corpus_counts(docs, vocabulary=200)
    assert counts.totals.sum() == 5000 and len(counts.keys) == 200
    assert counts.rare.sum() == 5000 - counts.counts.sum()
    words = sorted({w for _, t in rows for w in t.split()})
    block = next(iter(text_blocks(pa.array([" ".join(words)]))))
    keys, letters, _ = M._words(block)
    classes, inside = M.Lexicon(counts)(keys, letters)
    known = np.isin(keys, counts.keys)
    share = np.bincount(classes[known], weights=np.exp(inside[known]), minlength=M.CLASSES)
    want = np.divide(counts.totals - counts.rare, counts.totals, out=np.zeros(M.CLASSES), where=counts.totals > 0)
    assert np.allclose(share, want)


def test_scores_tell_order_from_noise(spark):
    rng = random.Random(8)
    phrase = [f"p{k}" for k in range(20)]
    rows = [(i, " ".join((phrase[j:] + phrase[:j]) * 5)) for i in range(120) for j in [rng.randrange(20)]]
    shuffled = [(1000 + i, " ".join(rng.sample(phrase * 5, 100))) for i in range(20)]
    edges = [(None, "p1 p2"), (2000, None), (2001, ""), (2002, "never seen words"), (2003, "p1 " * 20_000), (1, rows[1][1])]
    docs = spark.createDataFrame([(t, i, 0.0) for i, t in rows + shuffled + edges], "text string, doc_id long, log_prob double").repartition(4)
    got = M.scores(docs).collect()
    assert len(got) == len(rows) + len(shuffled) + len(edges)
    mean = lambda f: np.mean([r.log_prob / r.n_words for r in got if r.n_words and f(r.doc_id)])
    assert mean(lambda d: d is not None and d < 1000) > mean(lambda d: d is not None and 1000 <= d < 2000) + 0.5
    by = {r.doc_id: r for r in got}
    assert (by[2000].n_words, by[2000].log_prob, by[2000].perplexity) == (0, 0.0, None)
    assert all(math.isfinite(r.log_prob) for r in got)
    twins = [r.log_prob for r in got if r.doc_id == 1]
    assert len(twins) == 2 and math.isclose(*twins, rel_tol=1e-9)


def test_every_counted_word_has_its_own_count(spark, monkeypatch):
    monkeypatch.setattr(M, "PACKED_BYTES", 1 << 16)
    text = [" ".join(f"w{k}" for k in range(i * 1000, i * 1000 + 2000)) for i in range(25)]  # 26,000 words
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(3)
    blocks = M.staged(M.packed(docs), "blocks")
    sums = M.staged(M.summed(M.word_entries(blocks, M.shard_bits(blocks)), M.shard_bits(blocks)), "sums")
    seen = {}
    for r in blocks.join(M.totals(sums, "word_total"), "block").collect():
        words = np.frombuffer(r.words, np.uint64)
        seen |= dict(zip(words.tolist(), M._released(bytes(r.word_total), np.int64, len(words)).tolist(), strict=True))
    assert {r.word & (1 << 64) - 1: r.n for r in M.listed(sums).collect()} == seen
    keys = M._words(next(iter(text_blocks(pa.array([" ".join(f"w{k}" for k in range(26_000))])))))[0]
    assert [seen[k] for k in keys.tolist()] == [1] * 1000 + [2] * 24_000 + [1] * 1000


def test_long_words_are_not_spelt_out(spark):
    # Beyond 20,000 words, a word's own count scores it, not its length.
    rare = [" ".join(f"{'x' * 200 * long}r{i:02d}q{k:04d}" for k in range(1000)) for long in (0, 1) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(rare)), "doc_id long, text string").repartition(2)
    by = {r.doc_id: r.log_prob / r.n_words for r in M.scores(docs).collect()}
    assert abs(np.mean([by[i] for i in range(12)]) - np.mean([by[i] for i in range(12, 24)])) < 2


def test_neighbours_tell_words_of_a_class_apart(spark):
    # Each partner follows its own word only; swapped partners have the same classes, counts and lengths wherever their hashes share a bucket.
    words = [f"v{k:05d}" for k in range(4000)]
    keys = M._words(next(iter(text_blocks(pa.array([" ".join(words)])))))[0]
    bucket = [w for w, c in zip(words, M.hashed_class(keys).tolist(), strict=True) if c == M.SINGLE + 5]
    heads, tails = bucket[:20], bucket[20:40]
    filler = [f"f{k}" for k in range(M.SINGLE)]  # have the classes of their own
    rng = random.Random(4)

    def text(shift):
        return " ".join(f"{' '.join(rng.sample(filler, 4))} {heads[k]} {tails[(k + shift) % 20]}" for k in rng.sample(range(20), 20))

    rows = [(i, text(0)) for i in range(60)] + [(1000 + i, text(7 + i)) for i in range(3)]
    by = {r.doc_id: r.log_prob / r.n_words for r in M.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert min(by[i] for i in range(60)) > max(by[1000 + i] for i in range(3)) + 0.3


def test_words_probabilities_add_up(spark):
    texts = ["a b a c", "b a", "", "c c a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    batch = M.packed(docs).toArrow().to_batches()[0]
    own = M.Packed(batch, 0)
    times = np.bincount(own.at)
    pairs = M.Pairs(own, np.full(3, 2), 6)  # as if no word stood once, so that every pair is there
    flat = [["^", *t.split(), "^"] for t in texts if t]
    count = lambda a, b: sum(x == a and y == b for t in flat for x, y in zip(t, t[1:], strict=False))
    got = np.exp(M.mixed(own, times, pairs, pairs.n, 3, np.log(np.full(len(own.at), 1 / 3))))
    alone = {"^": 3} | {w: sum(t.split().count(w) for t in texts) for w in "abc"}

    def want(left, w, right, word):
        l, r = count(left, w) - (w == word), count(w, right) - (w == word)
        return ((l + M.PRIOR / 3) / (alone[left] - 1 + M.PRIOR) + (r + M.PRIOR / 3) / (alone[right] - 1 + M.PRIOR)) / 2

    places = [(t[i - 1], t[i], t[i + 1]) for t in flat for i in range(1, len(t) - 1)]
    assert np.allclose(got, [want(a, w, b, w) for a, w, b in places])
    # Over all words and the end of a text, which the network never predicts, this is one.
    left, word, right = places[0]
    rest = (count(left, "^") / (alone[left] - 1 + M.PRIOR) + count("^", right) / (alone[right] - 1 + M.PRIOR)) / 2
    assert math.isclose(sum(want(left, w, right, word) for w in "abc") + rest, 1, rel_tol=1e-9)


def test_scores_are_those_of_the_formula(spark, monkeypatch):
    """Every log-probability by plain loops over words, from the same weights."""
    rng = random.Random(12)
    vector = np.random.default_rng(1).normal(0, 0.4, M.Network.SIZE).astype(np.float32)
    monkeypatch.setattr(M, "train", lambda *_: vector)
    vocabulary = [f"W{k}" for k in range(150)] + ["É", "a\x00b"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(30))) for _ in range(60)] + ["", "once", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_prob for r in M.scores(docs).collect()}

    lowered = "".join(chr(c + 32) if 65 <= c < 91 else chr(c) for c in range(256))
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lowered)) if w] for t in texts]
    n = Counter(w for words in split for w in words)
    hashed = lambda w: int(M._words(next(iter(text_blocks(pa.array([w])))))[0][0])
    key = {w: hashed(w) for w in n}
    ranked = sorted(n, key=lambda w: (-n[w], key[w] - (1 << 64) * (key[w] >> 63)))
    classes = {w: k if k < M.SINGLE else int(M.hashed_class(np.array([key[w]], dtype=np.uint64))[0]) for k, w in enumerate(ranked)}
    totals = Counter()
    for w in n:
        totals[classes[w]] += n[w]
    net, ends = M.Network(vector), sum(map(bool, split))
    pairs = Counter(x for words in split if words for x in zip(["^", *words], [*words, "^"], strict=True))
    alone = {**n, "^": ends}
    for i, words in enumerate(split):
        want = 0.0
        for j, w in enumerate(words):
            hidden = net.bias.astype(np.float64)
            for table, o in zip(net.tables, M.OFFSETS, strict=True):
                hidden = hidden + table[classes[words[j + o]] if 0 <= j + o < len(words) else M.CLASSES]
            logits = np.tanh(hidden) @ net.output + net.out_bias
            q = np.exp(logits[classes[w]]) / np.exp(logits).sum() * n[w] / totals[classes[w]]
            left, right = words[j - 1] if j else "^", words[j + 1] if j + 1 < len(words) else "^"
            sides = ((pairs[left, w] - 1, alone[left] - 1), (pairs[w, right] - 1, alone[right] - 1))
            want += math.log(sum((k + M.PRIOR * q) / (m + M.PRIOR) for k, m in sides) / 2)
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-6), i


def test_passes_over_all_words_learn(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(200) for w in rng.choice((("a", "b"), ("c", "d"))))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = M.staged(M.packed(docs), "blocks")
    counts = M.corpus_counts(docs)
    around, middle = next(M._packed_positions(blocks.toArrow().to_batches(), M.Lexicon(counts)))
    before = M.Network.start(counts.totals).log_probabilities(around, middle).mean()
    assert M.Network(M.train(blocks, counts)).log_probabilities(around, middle).mean() > before + 0.2


def test_empty_table(spark):
    assert M.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
