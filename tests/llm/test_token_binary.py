import random
import zlib

import numpy as np
import pytest

from quillflow.llm import blocks
from quillflow.llm.token_binary import BLOCK, Segment, digests, token_file, write_segment
from tests.llm import thue_morse

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 7, 49_407, 2**32 - 1])
def test_segment_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
    values[rng.random(n) < 0.03] = top
    lengths = np.array([n // 3, n - n // 3, 0])
    segment = Segment(write_segment([5, None, -7], lengths, values))
    assert segment.doc_ids == [5, None, -7]
    assert (segment.lengths == lengths).all() and (segment.values() == values).all()
    for k in range(-(-n // BLOCK)):
        assert (segment.read_block(k) == values[k * BLOCK : (k + 1) * BLOCK]).all()


def test_outliers_do_not_widen_a_block():
    values = np.full(BLOCK, 3, dtype=np.uint32)
    values[5] = 2**31
    segment = Segment(write_segment([0], np.array([BLOCK]), values))
    assert segment.widths.tolist() == [0] and segment.positions.tolist() == [5]


def expected(rows):
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_like_the_library(spark):
    rng = random.Random(3)
    pool = ["don't", "It's", "<|endoftext|>", "\x01", "a\x01b", "é", "é", "́", "12345", "x" * 3000, "　", " ", "Ärger!!", "\n", "%%%", "Σ", "ΑΣ", "日本語", "🙂🙂", "\x00", "\x1f", "\u0085", "we'LL", "''s"]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(800 + i, t) for i, t in enumerate(thue_morse(1024) + thue_morse(4096))]
    rows += [(810, "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|x <|endoftext |> y<|"), (811, "<"), (812, "|endoftext|>")]
    rows += [(None, "no id"), (900, None), (901, ""), (902, "word " * 40_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(t, i, "x", -1) for i, t in rows], "text string, doc_id long, ids string, start long").repartition(5)
    got = digests(token_file(docs, P.path("word_bpe_49k.json"))).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_file(docs, P.path("word_bpe_49k.json")).collect() == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    got = sorted(tuple(r) for r in digests(token_file(docs, P.path("word_bpe_49k.json"))).collect())
    assert [r[1] for r in got] == [0, got[0][2], 2 * got[0][2]]


def test_bytes_decide_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(blocks.Spans, "span", lambda self, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    data = np.frombuffer(b"one two one twofold two threefold_ threefold-", dtype=np.uint8)
    starts, ends, _ = blocks.Block(0, 1, data, np.array([0, len(data)])).words(blocks.BLANKS)
    example, which = blocks.distinct(data, starts, ends)
    words = data.tobytes().split()
    assert [words[i] for i in example[which].tolist()] == words and len(example) == len(set(words))
