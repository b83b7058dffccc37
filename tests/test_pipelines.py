import json

from pyspark.sql import functions as F

from quillflow.operators import audit, chunking, health, models
from quillflow.plans import pipelines


def test_chunk_corpus(spark):
    body = "1. Câu một của điều.\n2. Câu hai."
    records = spark.createDataFrame([("L1", f"L1__{i}", f"Điều {i}. Tên", body) for i in (10, 2, 1)] + [("L2", "L2__1", "", "khác")], "law_id string, article_id string, title string, text string")
    laws = spark.createDataFrame([("L1", "Luật Doanh nghiệp 2020"), ("L9", "Không có")], "law_id string, law_name string")
    chunks, stats, missing = pipelines.chunk_corpus(records, laws, chunking.Sizes(5, 100, 5))
    got = sorted(chunks.collect(), key=lambda r: r.position)
    assert [r.chunk_id for r in got] == ["ldn2020_dieu_001", "ldn2020_dieu_002", "ldn2020_dieu_010"]
    assert {r.law_id: r.chunks for r in stats.collect()} == {"L1": 3, None: 3} and [r.law_id for r in missing.collect()] == ["L9"]


def test_discover_and_scrape(spark):
    hits = spark.createDataFrame([
        (0, "https://thuvienphapluat.vn/van-ban/a.aspx", "Luật Doanh nghiệp 2020 59/2020/QH14", "Hiệu lực 01/01/2021"),
        (1, "https://www.thuvienphapluat.vn/van-ban/a.aspx", "Luật Doanh nghiệp 2020 59/2020/QH14", "Hiệu lực 01/01/2021 thêm"),
        (2, "https://congbao.chinhphu.vn/van-ban/b-123.htm", "Luật Doanh nghiệp 67/VBHN-VPQH", ""),
        (3, "https://thuvienphapluat.vn/tin-tuc/c", "Luật Doanh nghiệp", ""),
    ], "ord int, link string, title string, snippet string")
    none = spark.createDataFrame([], "url string, discovered_at string")
    found = pipelines.discover(hits, none, F.lit("2026-01-01").cast("timestamp"), 2026)
    assert sorted(r.ord for r in found.collect()) == [1, 2]
    page = "<div class='content1'>" + "<p>Điều 1. Nội dung</p>" * 400 + "</div>"
    lines = "".join(f"<p>Điều 1. Nội dung số {i}</p>" for i in range(400))
    fetch = lambda df: df.withColumn("html", F.when(F.col("source_domain") == "thuvienphapluat.vn", f"<div class='content1'>{lines}</div>"))
    content, outcome, done = pipelines.scrape(found, fetch)
    got = {r.law: r for r in outcome.collect()}
    assert got["Luật Doanh nghiệp"].success and got["Luật Doanh nghiệp"].fallback_level == 1
    assert [r.has_structure for r in content.collect()] == [True] and done.count() == 2 and page
    # The chain skips the amendment, for which there is no link: the second candidate is place 1, though it is the third rule's.
    assert pipelines.scrape(found, fetch, ["luat doanh nghiep"])[1].count() == 1 and pipelines.scrape(found, fetch, ["luat nha o"])[1].count() == 0


def test_audit(spark):
    contracts = spark.createDataFrame([(1, "Điều 1. góp vốn và cổ phần\nĐiều 2. cổ đông"), (2, "  "), (3, "Điều 1. x\nĐiều 2. fail")], "contract_id int, text string")
    answer = json.dumps([{"clause": "c", "violation": "v", "reference_law": "Luật 1", "suggested_fix": "s"}, {"clause": "incomplete"}])

    class Fake:
        def __call__(self, prompt):
            if "fail" in prompt or "Điều 1. x" in prompt:
                raise ValueError("no")
            return f"Here: {answer}"

    retrieve = lambda df: df.withColumn("result", F.lit("context"))
    got = {r.contract_id: r for r in pipelines.audit_contracts(spark, contracts, retrieve, Fake, "now").collect()}
    assert (got[1].domain, got[1].confidence, got[1].error) == ("Doanh nghiệp", 1.0, None) and "### Vi phạm 2" in got[1].report
    assert got[2].error == "contract is empty" and "**Lỗi pipeline:** contract is empty" in got[2].report
    assert got[3].error == "2/2 clauses failed" and got[3].confidence == 0.0


def test_several_findings_of_a_clause_are_one_clause(spark):
    text = "\n".join(f"Điều {i}. góp vốn cổ phần {'fail' if i > 1 else ''}" for i in range(1, 5))
    finding = {"clause": "c", "violation": "v", "reference_law": "Luật 1", "suggested_fix": "s"}

    class Fake:
        def __call__(self, prompt):
            if "fail" in prompt.split("Clause:")[-1]:
                raise ValueError("no")
            return json.dumps([finding] * 5)

    (got,) = pipelines.audit_contracts(spark, spark.createDataFrame([(1, text)], "contract_id int, text string"), lambda df: df.withColumn("result", F.lit("")), Fake, "now").collect()
    assert (got.error, got.confidence) == ("3/4 clauses failed", 0.0)


def test_models_fill_in_where_patterns_fail(spark):
    calls = []

    class Fake:
        def __call__(self, prompt):
            calls.append(prompt)
            if prompt.startswith("Name the field"):
                return '{"domain": "Lao động", "reason": "r"}'
            if prompt.startswith("Cut the contract"):
                return '{"clauses": ["một", "hai", "ba"]}'
            if prompt.startswith("Write a report"):
                return "# của mô hình"
            return json.dumps([{"clause": "c", "violation": "v", "reference_law": "L", "suggested_fix": "s"}])

    contracts = spark.createDataFrame([(1, "không rõ {clause}"), (2, "")], "contract_id int, text string")
    got = {r.contract_id: r for r in pipelines.audit_contracts(spark, contracts, lambda df: df.withColumn("result", F.lit("luật")), Fake, "now", write_reports=True).collect()}
    assert (got[1].domain, got[1].confidence, got[1].report) == ("Lao động", 1.0, "# của mô hình")
    assert got[2].domain is None and "contract is empty" in got[2].report


def test_gazette_pages(spark):
    body = "<div class=text>menu</div><section class='x box-section--main'><p class='text'>A<span class=ads>kept</span></p><nav class=text>B</nav><div class=text><script>no</script>C</div></section>"
    pages = spark.createDataFrame([("congbao.chinhphu.vn", body), ("congbao.chinhphu.vn", "<div class=text>menu</div>"), ("congbao.chinhphu.vn", "<div class=box-section--main>only <a href=x.PDF>it</a></div>")], "source_domain string, html string")
    assert [r.content for r in models.page_text(pages).collect()] == ["A\nkept\nB\nC", None, None]


def test_hybrid_context(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "vec_id long, text string")
    edges = spark.createDataFrame([(1, 3), (3, 0)], "a long, b long")
    got = audit.hybrid_context(vectors.filter("vec_id = 0"), vectors, texts, edges, k=1).collect()
    assert [(r.query_id, r.result) for r in got] == [(0, "text 1\ntext 3")]


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("three")
    got = {r.table: (r.n, r.status) for r in health.catalog(spark).collect()}
    assert got["three"] == (3, "healthy")
    assert {r.table: r.status for r in health.counts({"gone": health.readable(lambda: spark.table("no_such_table"))}, spark).collect()} == {"gone": "error"}
    spark.catalog.dropTempView("three")


def test_paced_calls(spark):
    rows = spark.range(4)
    got = models.asked(rows, F.col("id").cast("string"), models.Offline, parallel=1, pace=0.05)
    assert got.rdd.getNumPartitions() == 1 and [r.answer for r in got.collect()] == ["[]"] * 4


def test_command_lines(spark, tmp_path, capsys):
    from quillflow.__main__ import main

    (tmp_path / "c.txt").write_text("Điều 1. góp vốn\nĐiều 2. cổ phần", encoding="utf-8")
    assert main(["audit", str(tmp_path / "c.txt"), "--output", str(tmp_path / "r.md")]) == 0 and "Báo cáo" in (tmp_path / "r.md").read_text()
    assert main(["audit", str(tmp_path / "none.txt")]) == 1 and main(["audit", str(tmp_path / "c.doc")]) == 1
    (tmp_path / "c.json").write_text(json.dumps({"target_laws": [{"name": "Luật Doanh nghiệp"}], "query_templates": [{"id": "t", "template": "{law_name}", "priority": 1}]}))
    answers = {"Luật Doanh nghiệp": [{"link": "https://thuvienphapluat.vn/van-ban/a.aspx", "title": "Luật Doanh nghiệp 2020 59/2020/QH14"}]}
    argv = ["discover", str(tmp_path / "c.json"), "--output", str(tmp_path / "found"), "--option", f"answers={json.dumps(answers)}"]
    assert main(argv) == 0 and main(argv) == 0
    assert len(list((tmp_path / "found").glob("*.jsonl"))) == 1  # the second run finds nothing new
    records = spark.createDataFrame([("L1", f"L1__{i}", f"Điều {i}. Tên", "1. Một.") for i in (1, 2)], "law_id string, article_id string, title string, text string")
    records.write.parquet(str(tmp_path / "corpus"))
    assert main(["chunk", str(tmp_path / "corpus"), "--law", "L1=Luật Doanh nghiệp 2020", "--output", str(tmp_path / "chunks")]) == 0
    assert spark.read.json(str(tmp_path / "chunks" / "chunks")).count() == 1


def test_retry():
    waits, tries = [], []

    def busy(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise models.RetryLater
        return "done"

    assert models.with_retry(busy, "p", sleep=waits.append) == "done" and waits == [2.0, 4.0]
