import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quillflow.llm import simhash_dedup as S
from quillflow.llm.simhash_dedup import digests, fingerprints, links, local_links, representatives


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(set(fps))
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


def rows():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(500)] + ["Ä", "É", "\xa0", "AB"]
    out = []
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        out.append(" ".join(words))
        if i % 3 == 0:
            out.append("\n".join(words).upper())
            words[len(words) // 2] = "changed"
            out.append(" ".join(words))
    out += [None, "", " \t", "x", "x y", "long " * 30_000, "a b c"] + ["a b c"] * 4
    return list(enumerate(out))


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(t, i, 0, "n") for i, t in data] + [("a b c", None, 0, "n")], "text string, doc_id long, fp int, node string").repartition(7)
    got = {r.doc_id: r for r in digests(docs).collect()}
    fps = {i: brute_fp(t) for i, t in data}
    roots = brute_roots(fps.values())
    least = {}
    for i in sorted(fps):
        least.setdefault(roots[fps[i]], i)
    assert len(got) == len(data) + 1
    for i, f in fps.items():
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == least[roots[f]]
    kept = [r.doc_id for r in representatives(docs).collect()]
    assert sorted(kept) == sorted(set(least.values()))
    assert representatives(docs).columns == docs.columns


@pytest.mark.parametrize("block_size", [4096, 40])
def test_links_have_all_components(spark, block_size):
    """Clusters of every tightness, chains over shard borders, and hot shards."""
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    x = rng.getrandbits(64)
    fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)] + [0, 1, 2**64 - 1]
    fps = sorted(set(fps))
    signed = [(f - (f >> 63 << 64),) for f in fps]
    edges = links(spark.createDataFrame(signed, "fp long"), shard_size=20, block_size=block_size)
    from quillflow.llm.blocks import mix
    from quillflow.llm.components import components

    mixed = dict(zip(mix(np.array(fps, dtype=np.uint64)).view(np.int64).tolist(), fps, strict=True))
    found = {mixed[r.node]: mixed[r.root] for r in components(edges).collect()}
    want = brute_roots(fps)
    groups = lambda d: sorted(sorted(f for f in fps if d(f) == r) for r in {d(f) for f in fps})
    assert groups(lambda f: found.get(f, f)) == groups(want.get)


def test_a_dense_shard_is_not_dealt_over_all_pairs_of_blocks(spark):
    """Near copies in great numbers and a wide cloud in one shard: far fewer rows than blocks times rows, and the same components."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    ball = {centre} | {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}
    cloud = {rng.getrandbits(64) for _ in range(1500)}
    fps = sorted(ball | cloud)
    signed = [(7, f - (f >> 63 << 64)) for f in fps]
    groups, edges = S.parted(spark.createDataFrame(signed, "shard long, fp long"), 200)
    dealt = groups.collect()
    assert len(dealt) < 7 * len(fps)  # pairs of blocks: 18 times
    assert max(Counter((r.shard, r.i, r.j) for r in dealt).values()) < 700
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = lambda x: x & (1 << 64) - 1
    for r in edges.collect():
        root[find(own(r.a))] = find(own(r.b))
    members = {}
    for r in dealt:
        members.setdefault((r.shard, r.i, r.j), set()).add(own(r.fp))
    for group in members.values():
        for a, b in local_links(np.array(sorted(group), dtype=np.uint64)):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                root[find(x)] = find(y)
    want = brute_roots(fps)
    assert len({find(f) for f in fps}) == len(set(want.values())) and len({find(f) for f in ball}) == 1


def test_local_links_splits():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << k) for k in range(8)]))
    want = brute_roots(fp.tolist())
    root = {f: f for f in fp.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in local_links(fp):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[find(x)] = find(y)
    assert len({find(f) for f in root}) == len(set(want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digests(docs).collect() == [] and representatives(docs).collect() == []
    assert fingerprints(docs).count() == 0 and S.RADIUS == 3
