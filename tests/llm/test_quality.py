import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillflow.llm import blocks, features, pu_quality, quality_rules, training
from tests.llm import thue_morse

DATA = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def rows():
    rng = random.Random(1)
    vocab = ["a", "b", "é", "日本", "#x", "\xa0"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\n\n", "\t", "\r\n"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += [None, "", "\n", " \n \n", "x\n\nx\nx ", "one two three four five six seven eight " * 3, "w " * 30_000, "a\na\n", "a\n", *("\n".join(thue_morse(n)) for n in (1024, 4096))]
    return [(t, i, "s") for i, t in enumerate(texts)] + [("twice", None, None)] * 2


@pytest.fixture(scope="module")
def nothing(spark):
    return quality_rules.fit([], [])


def test_counts(spark, nothing):
    data = rows()
    docs = spark.createDataFrame(data, "text string, doc_id long, kept string").repartition(3)
    got = quality_rules.quality_rules(docs, nothing).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, ((i, *brute(t)) for t, i, _ in data)))
    assert all(not (r.kept and r.base_failed) for r in got)


def test_rules_on_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels, quality_rules.learn_from(), rows=300)
    got = quality_rules.quality_rules(docs, model).join(labels, "doc_id").filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2").collect()
    right = [(r.probability >= 0.5) == (r.quality == 1) for r in got]
    assert len(right) > 50 and sum(right) / len(right) > 0.9
    # Calibrated: the Brier score is far below that of the mean, and the mean probability is near it.
    share = sum(r.quality for r in got) / len(got)
    assert sum((r.probability - r.quality) ** 2 for r in got) / len(got) < 0.3 * share * (1 - share)
    assert abs(sum(r.probability for r in got) / len(got) - share) < 0.05


def blocks_of(texts):
    return list(blocks.text_blocks(pa.array(texts), 4000))


def test_linear_scores_are_those_of_the_matrix():
    texts = [t or "" for t, _, _ in rows()[:160]]
    rng = np.random.default_rng(2)
    weights, dense, bias = rng.normal(size=features.WEIGHTS), rng.normal(size=features.DENSE), 0.3
    matrix = features.Matrix(blocks_of(texts))
    want = np.concatenate([features.linear(features.Counts(b), weights, dense, bias) for b in blocks_of(texts)])
    assert np.allclose(matrix.scores(weights, dense, bias), want, rtol=1e-4, atol=1e-4)
    slope = rng.normal(size=len(texts))
    whole = np.concatenate([np.atleast_1d(x) for x in matrix.gradient(slope)])
    base, total = 0, 0
    for b in blocks_of(texts):
        total = total + features.slope_sums(features.Counts(b), slope[base : base + b.rows])
        base += b.rows
    assert np.allclose(whole, total, rtol=1e-4, atol=1e-4)


def test_slope_is_that_of_the_risk():
    rng = np.random.default_rng(5)
    positive = rng.random(40) < 0.4
    for prior, shift in ((0.5, 0.0), (0.9, 0.0), (0.5, -9.0)):
        scores = rng.normal(size=40)
        positives, loss = np.flatnonzero(positive), lambda s: np.log1p(np.exp(s))

        def risk(s, prior=prior, shift=shift, positives=positives, loss=loss):
            rest = loss(s).mean() + shift - prior * loss(s)[positives].mean()
            # Where the rest is negative, what goes down is its negative alone.
            return prior * loss(-s)[positives].mean() + rest if rest >= 0 else -rest

        got = pu_quality.pu_slope(positive, prior, lambda _, shift=shift: shift)(scores, [])
        steps = np.eye(40) * 1e-6
        assert np.allclose(got, [(risk(scores + e) - risk(scores - e)) / 2e-6 for e in steps], atol=1e-6)


def test_class_prior():
    rng = np.random.default_rng(6)
    up, down = rng.normal(3, 1, 20_000), rng.normal(-3, 1, 20_000)
    counts = lambda x: np.bincount(pu_quality._bins(x), minlength=pu_quality.BINS)
    for share in (0.1, 0.5, 0.9):
        mixed = np.concatenate([up[: int(20_000 * share)], down[: int(20_000 * (1 - share))]])
        assert abs(pu_quality.class_prior(counts(rng.normal(3, 1, 5000)), counts(mixed)) - share) < 0.03


def test_positive_unlabelled_on_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model, prior = pu_quality.train(docs, labels, rows=400)
    assert 0.6 < prior < 0.97
    got = pu_quality.scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    ups, downs = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    wins = sum((u > d) + (u == d) / 2 for u in ups for d in downs) / (len(ups) * len(downs))
    assert wins > 0.9
    assert sum(r.predicted == 1 for r in got if r.quality == 1) > 0.95 * len(ups)


def test_sample_is_bounded(spark):
    # One id that 50,000 rows have, one long text, and labels that repeat.
    docs = spark.range(50_000).selectExpr("cast(7 as long) as doc_id", "concat('copy ', cast(id % 3 as string)) as text")
    docs = docs.unionByName(spark.range(100, 200).selectExpr("id as doc_id", "repeat('x', 500) as text")).unionByName(spark.createDataFrame([(8, "y" * 5000)], "doc_id long, text string"))
    labels = spark.range(300).selectExpr("id % 150 + 7 as doc_id", "cast(id % 2 as int) as quality").unionByName(spark.createDataFrame([(7, 0)] * 20, "doc_id long, quality int"))
    got = training.labelled_sample(docs, labels, "quality", F.lit(True), rows=1000, size=20_000).collect()
    assert sum(len(r.text) for r in got) <= 20_000 and 8 not in {r.doc_id for r in got}
    assert sorted(r.text for r in got if r.doc_id == 7) in ([], [f"copy {k}" for k in range(3)])
    few = training.labelled_sample(docs, labels, "quality", F.lit(True), rows=10)
    assert few.count() <= 10


def test_no_task_reads_the_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    sample = training.labelled_sample(docs, labels, "quality", F.lit(True), rows=50)
    plan = sample.coalesce(1)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Join" not in plan


def test_edge_rows(spark):
    model = pu_quality.begin([], []).model
    docs = spark.createDataFrame([(None, None, 1.0), (1, None, None), (2, "", None), (2, "", None), (3, "x" * 200_000, None)], "doc_id long, text string, score double")
    got = pu_quality.scores(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"]
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert pu_quality.scores(empty, pu_quality.train(empty, none)[0]).collect() == []
    assert quality_rules.quality_rules(empty, quality_rules.train(empty, none)).collect() == []
