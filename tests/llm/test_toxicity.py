import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillflow.llm import toxicity, training
from quillflow.llm.blocks import text_blocks

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


def em(fired, toxic, clean, prior):
    x, k = fired.astype(float), fired.shape[1]
    rates = toxicity.label_model(toxicity.Rates.start(np.full(k, toxic), np.full(k, clean), prior), lambda r, pairs: toxicity.statistics(x, np.ones(len(x)), r, pairs))
    return rates.posterior(x), rates


def test_label_model_weighs_voters_that_vote_together_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    base = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.05)
    other = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.05)
    alone = em(np.stack([base, other], axis=1), 0.5, 0.05, 0.2)[0]
    copies = em(np.stack([base] * 9 + [other], axis=1), 0.5, 0.05, 0.2)[0]
    assert np.abs(alone - copies)[base & ~other].mean() < 0.1
    assert ((alone > 0.5) == y).mean() > 0.85


def test_label_model_learns_rates():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.15
    fired = np.where(y[:, None], rng.random((20_000, 6)) < 0.4, rng.random((20_000, 6)) < 0.01)
    posterior, rates = em(fired, 0.35, 0.02, 0.2)
    assert np.abs(rates.toxic - 0.4).max() < 0.1 and rates.clean.max() < 0.02
    assert ((posterior > 0.5) == y).mean() > 0.93


def test_statistics_add_up_over_patterns():
    rng = np.random.default_rng(2)
    fired = rng.random((500, 4)) < 0.2
    rates = toxicity.Rates.start(np.full(4, 0.4), np.full(4, 0.02), 0.1)
    each, n = np.unique(fired, axis=0, return_counts=True)
    whole = toxicity.statistics(fired.astype(float), np.ones(500), rates, True)
    assert np.allclose(whole, toxicity.statistics(each.astype(float), n, rates, True))
    assert np.isclose(whole[0] + whole[len(whole) // 2], 500)


def test_mining_in_ranges_of_keys_finds_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    toxic = [" ".join([*rng.choice(words, 60), *rng.choice(["swine", "scum", "rotten"], 2)]) for _ in range(60)]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    toxic, clean = (list(text_blocks(pa.array(x), 3000)) for x in (toxic, clean))
    whole = toxicity.mine(toxic, clean)
    monkeypatch.setattr(toxicity, "MINED_KEYS", 1000)
    assert len(whole[1]) > 3 and len(whole[3]) < len(whole[1]) and all(np.array_equal(a, b) for a, b in zip(whole, toxicity.mine(toxic, clean), strict=True))


def test_memory_of_long_texts(spark):
    # 4,000 labelled texts of 20,000 words each: 500 MB, of which the sample takes a bounded part.
    import tracemalloc

    rng = np.random.default_rng(4)
    words = np.array([f"{a}{b}" for a in ("th", "en", "re", "ing") for b in range(2500)])
    texts = [" ".join(rng.choice(words, 20_000)) for _ in range(100)]
    rows = texts[: training.SAMPLE_BYTES // max(map(len, texts))]
    blocks = list(text_blocks(pa.array(rows)))
    tracemalloc.start()
    toxicity.fit(blocks, [i % 5 == 0 for i in range(len(rows))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20


def test_on_unseen_rows(tables, model):
    docs, labels = tables
    got = toxicity.scores(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    for lang in {r.lang for r in got}:
        own = [r.predicted for r in toxic if r.lang == lang]
        assert sum(own) >= 0.75 * len(own), lang


def test_clean_keeps_whole_rows(tables, model):
    docs, _ = tables
    scored = toxicity.scores(docs, model).filter("predicted = 0").select("doc_id")
    kept = toxicity.clean(docs, model)
    assert kept.schema == docs.schema
    assert kept.exceptAll(docs.join(scored, "doc_id").select(docs.columns)).count() == 0 and kept.count() == scored.count()


def test_edge_rows(spark, model):
    rows = [(None, None, 1.0), (1, None, None), (2, "", None), (2, "", None), (3, "É" * 100_000, None), (4, "idiot moron scum trash clown", None)]
    got = toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in got) == [("1", 0), ("2", 0), ("2", 0), ("3", 0), ("4", 1), ("None", 0)]
    empty, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(empty, toxicity.train(empty, none)).collect() == []


def test_tokens_are_words_and_their_beginnings():
    block = next(iter(text_blocks(pa.array(["Äöüß-abcd", "abcde"]))))
    row, key, words = toxicity.tokens(block)
    assert words.tolist() == [2, 1]
    # Äöü of the first word, abc of the second; abc and abcd of the third
    assert np.bincount(row).tolist() == [4, 3] and len(np.intersect1d(key[row == 0], key[row == 1])) == 1


def test_scores_are_those_of_the_formula(tables, model):
    """Votes and scores of whole texts by plain loops over words, from the same model."""
    import math
    import re
    from collections import Counter

    def key(text, kind):
        block = next(iter(text_blocks(pa.array([text]))))
        own = toxicity.tokens(block)[1]
        return int(own[0]) if not kind else int(toxicity.mix(toxicity.byte_hash(toxicity.LOWER[block.data]).span(np.array([0]), np.array([len(block.data)])) ^ np.uint64(kind))[0])

    docs, _ = tables
    known = {int(t) for t in model.tokens}
    voter_of = dict(zip(model.keys.tolist(), model.voters.tolist(), strict=True))
    cache = {}
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", "Scum scum SCUM, idiot!"]
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        seen = Counter()
        for w in words:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            if low not in cache:
                cache[low] = [k for k in [key(low, 0), *(key(low[:size], size) for size in toxicity.PREFIXES if size < len(low))] if k in known]
            seen.update(cache[low])
        fired = set()
        for token, times in seen.items():
            level = min(times, 2) + 2 * (times >= toxicity.DENSE_SHARE * len(words))
            at = np.array([token], dtype=np.uint64)
            fired |= {voter_of[k] for k in (int(toxicity.mix(at)[0]), int(toxicity.mix(at + np.uint64(level))[0])) if k in voter_of}
        total = sum(seen.values())
        share = 100 * total / max(len(words), 1)
        logit = model.bias + sum(model.weights[v] for v in fired) + float(np.dot(model.weights[-3:], [math.log1p(total), min(share, 10) / 3, math.log1p(len(words)) / 5]))
        (got,) = toxicity.probabilities(next(iter(text_blocks(pa.array([text or ""])))), model)
        assert math.isclose(got, 1 / (1 + math.exp(-logit)), rel_tol=1e-9, abs_tol=1e-12)
