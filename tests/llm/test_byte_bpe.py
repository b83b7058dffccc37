import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quillflow.llm.blocks import text_blocks
from quillflow.llm.byte_bpe import PerfectHash, codec, decode, digests, encode, round_trip
from tests.llm import thue_morse

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


POOL = ["don't", "'s", "'ve", "'v", "''ll", "'", " '", "\n'd", " 't", "I'm", "x'RE", "1's", "!'s", " ", "  ", "   ", "\n", "\t", "\r\n", "　", " ", "é", "日本語", "🙂", "a", "Zwölf", "123", "²", "٣", "_", "%%%", "<|endoftext|>", "thanedbleation", "́", "\x00", "\x1f", "\x85"]


def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", *thue_morse(1024), *thue_morse(4096), " ".join(thue_morse(2048)), "x" * 20_000, " " * 5000, "ab'" * 3000]


def test_ids_are_the_library_s(library):
    own, c, found = texts(), codec(PATH), []
    for block in text_blocks(pa.array(own), 5000):
        ids, bounds = c.encode(block)
        assert c.decode(ids).tobytes() == block.data.tobytes()
        found += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert found == [library.encode_ordinary(t) for t in own]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 3001).astype(np.uint64))
    h = PerfectHash(keys)
    assert (h.lookup(keys) == np.arange(len(keys))).all()
    assert sorted(h.slot_key.tolist()) == list(range(len(keys)))


def test_digests_and_round_trip(spark, library):
    rows = [(i, t, "c") for i, t in enumerate(texts()[:300])] + [(None, "no id", None), (7, None, None), (8, "twice", ""), (8, "twice", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in digests(docs, PATH).collect()) == want
    back = decode(encode(docs, PATH), PATH).select("text", "bytes").collect()
    assert len(back) == len(rows) and all(bytes(r[1]) == (r[0] or "").encode() for r in back)


def test_round_trip_in_one_pass(spark, library):
    rows = [(i, t, True) for i, t in enumerate(texts()[:100])] + [(None, None, None)]
    got = round_trip(spark.createDataFrame(rows, "doc_id long, text string, intact boolean"), PATH).collect()
    assert all(r.intact for r in got)
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t or "") for i, t, _ in rows}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digests(docs, PATH).collect() == [] and encode(docs, PATH).collect() == []
