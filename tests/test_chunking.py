import random
import re

from pyspark.sql import functions as F

from quillflow.operators import chunking as c


def merged(sizes, low):
    groups, open_, total = [], [], 0
    for i, s in enumerate(sizes):
        if s >= low:
            if open_:
                groups.append(open_)
            groups.append([i])
            open_, total = [], 0
            continue
        open_.append(i)
        total += s
        if total >= low:
            groups.append(open_)
            open_, total = [], 0
    if open_ and groups:
        groups[-1] += open_
    elif open_:
        groups.append(open_)
    return [k for k, g in enumerate(groups) for _ in g]


def packed(sizes, header, high):
    out, part, total, n = [], 0, header, 0
    for s in sizes:
        if total + s > high and n:
            part, total, n = part + 1, header, 0
        out.append(part)
        total, n = total + s, n + 1
    return out


def test_folds(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice([0, 1, 5, 20, 99, 100, 300]) for _ in range(rng.randrange(1, 25))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s array<int>")
    got = df.select("i", c.merge_short(F.col("s"), 100).alias("m"), c.pack(F.col("s"), F.lit(7), 120).alias("p")).collect()
    for r in got:
        assert r.m == merged(rows[r.i][1], 100) and r.p == packed(rows[r.i][1], 7, 120)


TEXT = """mở đầu
Chương I. Chung
Mục 1. Một
Điều 1. Phạm vi
1. Khoản một dài.
2. Khoản hai.
Chương II
Điều 2: Đối tượng
nội dung
Điều 3.
Điều 4. bị nuốt
hết"""


def test_articles(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no headings"), (3, None)], "id int, text string")
    got = {r.id: r.articles for r in c.articles(df).collect()}
    own = got[1]
    want = re.findall(r"^(Điều\s+\d+[\.:]\s*.*)", TEXT, flags=re.MULTILINE)
    assert [a.number for a in own] == [1, 2, 3] and len(want) == 3
    assert [a.title for a in own] == ["Phạm vi", "Đối tượng", "Điều 4. bị nuốt"]
    assert [a.chapter for a in own] == ["Chương I. Chung", "Chương II\nĐiều 2: Đối tượng", "Chương II\nĐiều 2: Đối tượng"]
    assert [a.section for a in own] == ["Mục 1. Một"] * 3
    assert own[0].text.endswith("Chương II") and own[0].chars == len(own[0].text)
    assert [(a.number, a.title, a.text) for a in got[2]] == [(0, "(Toàn văn)", "no headings")]
    assert got[3][0].text == ""


def test_chunks(spark):
    body = "".join(f"Điều {i}. Tên {i}\n" + "".join(f"{k}. Câu {k} của điều. Câu nữa.\n" for k in range(1, 2 + 12 * (i % 4 == 0))) for i in range(1, 13))
    df = spark.createDataFrame([("L1", "Luật Doanh nghiệp 2020", body), ("L2", "Văn bản", "không có điều")], "law_id string, name string, text string")
    sizes = c.Sizes(30, 60, 10)
    rows = sorted(c.chunks(df, ["law_id"], "name", sizes).collect(), key=lambda r: (r.law_id, r.position))
    one = [r for r in rows if r.law_id == "L1"]
    assert [r.position for r in one] == list(range(len(one))) and len({r.chunk_id for r in rows}) == len(rows)
    assert not one[0].metadata.has_overlap and all(r.metadata.has_overlap for r in one[1:])
    assert one[1].text.startswith(c.OVERLAP_BEGIN) and one[0].chunk_id.startswith("ldn2020_dieu_001")
    bare = "\n".join(r.text.split(c.OVERLAP_END)[-1] for r in one)
    assert all(f"Điều {i}. Tên {i}" in bare for i in range(1, 13))
    assert any("_p2" in r.chunk_id for r in one) and rows[-1].chunk_id.endswith("chunk_0001")
    flat = c.chunks(df, ["law_id"], "name", sizes).select("metadata.*")
    stats = {r.law_id: r for r in c.statistics(flat, "law_id", "estimated_tokens", "has_overlap", sizes).collect()}
    assert stats[None].chunks == len(rows) == stats["L1"].chunks + stats["L2"].chunks and stats[None].laws == 2


def test_sentence_suffix(spark):
    df = spark.createDataFrame([("One. Two two! Three?",), ("short",), ("x" * 50,)], "x string")
    assert [r[0] for r in df.select(c.sentence_suffix(F.col("x"), 15)).collect()] == ["Two two! Three?", "short", "x" * 50]
