import hashlib
import random
import re
from collections import Counter

import pytest

from quillflow.llm import substring_dedup
from quillflow.llm.substring_dedup import Index, deduplicate, digests, entries
from quillflow.llm.tables import carried
from tests.llm import thue_morse


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "日本"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([34, 35, 36, 50, 90]))] for _ in range(12)]
    out = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages)[rng.choice([0, 0, 1, 5]) :] if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randrange(60))]
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    near = [rng.choice(vocab) for _ in range(300)]
    for i in range(40):  # many near copies
        copy = list(near)
        copy[rng.randrange(300)] = f"edit{i}"
        out.append(" ".join(copy))
    out += [" ".join(text[i : i + 64] for i in range(0, len(text), 64)) for n in (1024, 4096) for text in thue_morse(n)]
    out += [" ".join(text) for text in thue_morse(64)] + [f"{x} " * 20 + " ".join(map(str, range(30))) for x in thue_morse(1024)]
    return out + [None, "", " ", "same " * 500, "one two"] + [out[0]] * 5 + ["a b " * 400]


@pytest.mark.parametrize(("window", "anchor", "batches"), [(35, 12, 2), (35, 12, 4), (5, 2, 1), (3, 3, 2)])
def test_against_brute_force(spark, window, anchor, batches):
    data = texts(window)
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate(data)], "text string, doc_id long, lo string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(docs, window, anchor, batches).collect()}
    assert [got[i] for i in range(len(data))] == brute(data, window)


def test_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"start\n{passage} end", "a"), (2, f"{passage}\tother", "b"), (3, "left\n as  it is", None), (4, None, "d"), (None, "no id", "e"), (5, passage, "f"), (5, passage, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = deduplicate(docs)
    assert got.schema == docs.schema
    assert Counter(map(tuple, got.collect())) == Counter([(1, "start end", "a"), (2, "other", "b"), rows[2], rows[3], rows[4], (5, "", "f"), (5, "", "f")])


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"p{i}" for i in range(40))
    twice = spark.createDataFrame([(1, text)] * 2 + [(2, "short text")] * 2, "doc_id long, text string")
    assert sorted(r.n_removed for r in digests(twice).collect()) == [0, 0, 40, 40]
    assert digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_reopened_index(spark, tmp_path, monkeypatch):
    """Batch after batch, each to an index that is opened anew: after each, brute force over all so far."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 20)
    rng, phrase = random.Random(9), " ".join(f"hot{i}" for i in range(34))
    data = texts(35) + [f"{' '.join(f'l{rng.randrange(10**6)}' for _ in range(30))} {phrase} {' '.join(f'r{rng.randrange(10**6)}' for _ in range(30))}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    keyed = carried(docs).selectExpr("key_id", "key_text", "coalesce(text, '') as text", "row.doc_id as doc_id")
    size = -(-len(data) // 5)
    for b in range(5):
        index = Index(spark, str(tmp_path / "index"))
        assert index.version >= b
        own, seen = keyed.filter(f"doc_id between {b * size} and {(b + 1) * size - 1}"), keyed.filter(f"doc_id < {(b + 1) * size}")
        index.add(entries(own), seen)
        assert len(index.runs) < 3 and len({r.level for r in index.runs}) == len(index.runs)
        hits = entries(seen).join(Index(spark, str(tmp_path / "index")).marks(), ["anchor", "span"]).join(seen.select("key_id", "key_text", "doc_id"), ["key_id", "key_text"]).collect()
        gone = {}
        for r in hits:
            for i in range(r.n):
                if r.mask >> i & 1:
                    gone.setdefault(r.doc_id, set()).update(range(r.lo + i, r.lo + i + 35))
        want = {k: w[1] for k, w in enumerate(brute(data[: (b + 1) * size], 35)) if w[1]}
        assert {k: len(x) for k, x in gone.items()} == want
    assert max(r.hot_anchors for r in index.runs) > 0


def test_history_is_merge_joined_where_it_lies(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    keyed = carried(spark.createDataFrame(list(enumerate(texts(1))), "doc_id long, text string")).selectExpr("key_id", "key_text", "coalesce(text, '') as text")
    index.add(entries(keyed), keyed)
    with_join = index.having(index.runs[0], index.read(index.runs[0]).select("anchor").distinct().hint("merge"))
    plan = with_join._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") <= 2
