import hashlib
import random
import re

import pytest

from quillflow.llm.decontaminate import contamination, decontaminated, digests


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window):
    wins = {}
    for item_id, text in items:
        w = words(text)
        if item_id is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[i : i + window]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if ids := wins.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def data(seed, single):
    rng = random.Random(seed)
    vocab = ["the", "of", "a", "É", "x1", "日", *(f"w{i}" for i in range(200))]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 5, 7, 8, 9, 30, 60])))) for i in range(40)]
    items += [(3, items[7][1]), (99, None), (98, ""), (97, "..."), (None, "w1 w2 w3"), (50, "of the of the of the of the of")]
    items += [(60, "W5")] if single else []
    docs = []
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(5)):
            w = rng.choice(items)[1]
            w = re.sub(" ", lambda _: rng.choice([" ", "\n", "-", "! "]), w or "")
            parts.append(rng.choice([w, w.upper(), " ".join(w.split()[2:]), " ".join(rng.choice(vocab) for _ in range(20))]))
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "of the " * 3000), (None, items[20][1]), (7, docs[7][1]), (103, items[0][1].split()[0])]
    return docs, items


@pytest.mark.parametrize(("single", "few"), [(False, 10**6), (True, 10**6), (False, 0), (True, 0)])
def test_against_brute_force(spark, single, few):
    docs, items = data(5, single)
    d = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, words string, size int").repartition(4)
    b = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, doc_id string")
    from pyspark.sql import functions as F

    got = contamination(d, b, broadcast_windows=few)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", "items"), 256), "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 8)
    if few and single:
        clean = decontaminated(d, b)
        assert clean.columns == d.columns
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in brute(docs, items, 8) if not r[5])


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert digests(none_d, none_b).collect() == []
    assert [tuple(r)[:4] for r in digests(d, none_b).collect()] == [(1, 2, 0, 0)]
