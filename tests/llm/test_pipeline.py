import base64
import re
from collections import Counter

import pytest
import tiktoken

from quillflow.llm import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash_dedup import brute_fp, brute_roots

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def cut(texts, window=35):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    times = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else texts[k]
    return out


def test_against_brute_force(spark):
    docs, labels, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs, labels)
    bad = {r.doc_id for r in toxicity.scores(docs, model).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in bad}
    prints = {i: brute_fp(t) for i, t in texts.items()}
    roots = brute_roots(prints.values())
    least = {}
    for i in sorted(texts):
        least.setdefault(roots[prints[i]], i)
    texts = cut({i: texts[i] for i in least.values()})
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    hit = {r[0] for r in contaminated(list(texts.items()), items, 8) if r[5]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(t or "") for i, t in texts.items() if i not in hit}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.intact and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some text", "en", "s", 9), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert "some text" in [r.text for r in out.collect()], name


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, row int"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, name):
    """Empty tables, long texts, repeated rows, and extra columns with the operators' own names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, DATA).collect() == []
    passage = " ".join(f"passage{i}" for i in range(40))
    rows = [(1, "long " * 50_000, "en", "s", 1, 0.5, "x", 7), (2, f"{passage} two", "en", "s", 2, None, None, None), (2, f"{passage} two", "en", "s", 2, None, None, None), (None, None, None, None, None, None, None, None), (3, "word " + "w" * 100_000, "de", "s", 3, 0.1, "y", 1)]
    got = stage(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()
    copies = sum(r.doc_id == 2 for r in got)
    assert {r.doc_id for r in got} == {None, 1, 2, 3} and copies == (1 if name == "simhash near-dedup" else 2)
    if name != "byte-level BPE":
        by = {r.doc_id: r for r in got}
        assert (by[3].score, by[3].spans, by[3].row) == (0.1, "y", 1) and by[None].text is None
        assert by[2].text == ("" if name == "substring dedup" else f"{passage} two")
    else:
        assert all(r.intact for r in got)
