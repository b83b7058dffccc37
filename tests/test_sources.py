import datetime
import io
import json
import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from quillflow.operators import audit, chunking, discovery, embedding, scraping
from quillflow.plans import config
from quillflow.sinks import writers
from quillflow.sources import fetch, readers, search
from quillflow.streaming import links as stream


def test_corpus_and_tiers(spark, tmp_path):
    one = spark.createDataFrame([("L1", "L1__1", "t", "x"), ("L2", "L2__1", "t", "y")], readers.RECORD)
    one.write.json(str(tmp_path / "a"))
    one.limit(1).write.json(str(tmp_path / "b"))
    both = readers.corpus(spark, str(tmp_path / "a"), str(tmp_path / "b"), format="json")
    assert both.count() == 3
    laws = spark.createDataFrame([("L1", "Law"), ("L9", "None")], "law_id string, law_name string")
    found, missing = readers.select_laws(both, laws)
    assert found.count() == 2 and [r.law_id for r in missing.collect()] == ["L9"]
    second = spark.createDataFrame([("L1", "L1__9", "n", "z")], readers.RECORD)
    assert sorted(r.article_id for r in readers.override(one, second).collect()) == ["L1__9", "L2__1"]


def test_law_text(spark, tmp_path):
    (tmp_path / "law.txt").write_text("lời nói đầu\nĐiều 1. Phạm vi\nnội dung &amp; một\nĐiều 2. Hai\nb", encoding="utf-8")
    got = sorted(map(tuple, readers.law_text(spark, str(tmp_path / "law.txt"), "X", "Luật X").collect()))
    assert got == [("X", "X__1", "Điều 1. Phạm vi", "nội dung & một", "Luật X"), ("X", "X__2", "Điều 2. Hai", "b", "Luật X")]


def test_queue_history_and_upsert(spark, tmp_path):
    rows = [{"url": "https://a.vn/1", "is_processed": False}, {"url": "https://a.vn/2"}, {"url": "https://a.vn/3", "is_processed": True}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(r.url for r in readers.queue(spark, str(tmp_path / "q.jsonl")).collect()) == ["https://a.vn/1", "https://a.vn/2"]
    assert readers.history(spark, str(tmp_path / "*.jsonl"), str(tmp_path / "q.jsonl")).count() == 0
    whole = spark.read.schema(readers.LINK).json(str(tmp_path / "q.jsonl"))
    done = spark.createDataFrame([("https://a.vn/2",), ("https://a.vn/3",)], "url string")
    marked = discovery.mark_processed(whole, done, F.lit("2026-01-01"))
    assert [r.url for r in marked.filter("updated").collect()] == ["https://a.vn/2"]
    path = str(tmp_path / "table")
    assert writers.read_table(spark, path, readers.LINK).count() == 0
    first = writers.replace_table(spark, whole, path)
    again = discovery.mark_processed(writers.read_table(spark, path, readers.LINK), done, F.lit("2026-01-01")).drop("updated")
    second = writers.replace_table(spark, again, path)
    got = writers.read_table(spark, path, readers.LINK)
    assert got.filter("not is_processed").count() == 1 and writers.current_version(spark, path) == second
    assert spark.read.json(first).count() == 3  # the backup
    third = writers.replace_table(spark, got, path, backup=False)
    assert not os.path.exists(second) and os.path.exists(third) and os.path.exists(first)


def test_a_reader_always_finds_the_table(spark, tmp_path):
    path, stop, misses = str(tmp_path / "table"), threading.Event(), []
    writers.replace_table(spark, spark.range(1), path)

    def look():
        while not stop.is_set():
            if not os.path.exists(f"{path}/current") or len(open(f"{path}/current").read()) != 34:
                misses.append(1)

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(2, 6):
        writers.replace_table(spark, spark.range(n), path)
    stop.set()
    reader.join()
    assert not misses and writers.read_table(spark, path, "id long").count() == 5


def test_contracts(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Điều 1. A</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(data.getvalue())
    (tmp_path / "c.txt").write_text("text\nhere")
    assert readers.contract(spark, str(tmp_path / "c.docx")).collect()[0].text == "Điều 1. A\nbc"
    assert readers.contract(spark, str(tmp_path / "c.txt")).collect()[0].text == "text\nhere"
    with pytest.raises(ValueError):
        readers.contract(spark, "x.doc")


def test_search_source(spark):
    search.register(spark)
    answers = {"q1": [{"link": "https://a.vn/1", "title": "T"}, {"link": ""}, {"link": "https://a.vn/2"}], "q2": []}
    read = spark.read.format("websearch").option("queries", json.dumps(["q1", "q2"])).option("answers", json.dumps(answers))
    got = read.load().collect()
    assert sorted((r.task, r.link, r.title) for r in got) == [(0, "https://a.vn/1", "T"), (0, "https://a.vn/2", "No Title")]
    assert read.option("limit", "1").load().count() == 1
    assert search.domain_locked("q", ["a", "b"]) == "q (site:a OR site:b)"


ALLOWED = {"thuvienphapluat.vn": ["/van-ban/"], "congbao.chinhphu.vn": ["/van-ban/"]}


@pytest.mark.parametrize(("url", "kept"), [
    ("https://thuvienphapluat.vn/van-ban/Doanh-nghiep/x.aspx", True), ("https://thuvienphapluat.vn/hoi-dap/x", False), ("https://congbao.chinhphu.vn/van-ban/a/b/c.htm", True),
    ("https://example.com/van-ban/x", False), ("https://www.thuvienphapluat.vn/van-ban/x", True), ("https://thuvienphapluat.vn/tin-tuc/van-ban/x", False),
])
def test_allowlist(spark, url, kept):
    df = spark.createDataFrame([(url,)], "url string")
    assert (df.filter(discovery.on_allowed_path("url", ALLOWED)).count() == 1) == kept
    assert df.filter(discovery.on_allowed_path("url", {})).count() == 1


def test_second_run_finds_nothing_new(spark, tmp_path):
    links = spark.createDataFrame([(1, "https://a.vn/x/", "T", "s"), (2, "https://www.a.vn/x", "T", "longer"), (3, "https://a.vn/y", "T", "s")], "ord int, url string, title string, snippet string")
    best = discovery.best_of_batch(links)
    assert sorted(r.ord for r in best.collect()) == [2, 3]
    now = F.lit("2026-01-02").cast("timestamp")
    history = best.withColumn("discovered_at", F.lit("2026-01-01 00:00:00"))
    assert not discovery.append_new(discovery.unseen(best, history, now, 7), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    old = best.withColumn("discovered_at", F.lit("2025-01-01 00:00:00"))
    assert discovery.append_new(discovery.unseen(best, old, now, 7), str(tmp_path / "some")) and spark.read.json(str(tmp_path / "some")).count() == 2


def test_cleaner(spark):
    raw = "Trang chủ\r\nĐiều 1. Phạm vi\n\n\nĐiều 1. Phạm vi\n  khoản   1 \nChia sẻ Facebook\n\xa0\nhết phần"
    df = spark.createDataFrame([(raw,), (None,)], "x string")
    assert [r[0] for r in df.select(scraping.clean_lines("x")).collect()] == ["Điều 1. Phạm vi\n\nkhoản 1\n\nhết phần", ""]


def test_findings_in_prose():
    assert audit.first_list('x [{"a": [1]}] y [2]') == [{"a": [1]}] and audit.first_list("none") == [] and audit.first_list('{"findings": [1]}') == [1]
    assert audit.first_list("[broken") == [] and audit.first_list('["a]"]') == ["a]"] and audit.first_list(None) == []


def test_streams(spark, tmp_path):
    rows = [("https://a.vn/x", "2026-01-01 00:00:00"), ("https://www.a.vn/x/", "2026-01-01 01:00:00"), ("https://a.vn/y", "2026-01-01 02:00:00")]
    schema = "url string, discovered_at string"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    found = stream.first_seen(spark.readStream.schema(schema).json(str(tmp_path / "in")), 7)
    seen: list = []
    stream.work_queue(found, str(tmp_path / "checkpoint"), lambda batch, _: seen.extend(r.dedup_key for r in batch.collect())).awaitTermination(120)
    assert sorted(seen) == ["https://a.vn/x", "https://a.vn/y"]
    stream.work_queue(found, str(tmp_path / "checkpoint"), lambda batch, _: seen.extend(r.dedup_key for r in batch.collect())).awaitTermination(120)
    assert len(seen) == 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sightings_of_a_finished_table(spark):
    days = [1, 3, 9, 12, 30, None]
    rows = [("https://a.vn/x", f"2026-01-{d:02d} 00:00:00" if d else "?") for d in days] + [("https://www.a.vn/x/", "2026-01-30 00:00:00")]
    got = stream.first_seen(spark.createDataFrame(rows, "url string, discovered_at string"), 7).collect()
    # 3 and 9 are within seven days of the one before; 12 of 9; 30 comes later, twice.
    assert sorted(str(r.discovered_at) for r in got) == ["2026-01-01 00:00:00", "2026-01-30 00:00:00", "None"]


def test_fetch_tries_again_and_decodes(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no")
        return "<p>Điều</p>".encode("utf-8" if "utf" in url else "utf-16"), None

    links = spark.createDataFrame([("https://utf",), ("https://bad",), ("https://wide",), (None,)], "url string")
    got = {r.url: r.html for r in fetch.fetched(links, get, wait=0.0).collect()}
    assert got == {"https://utf": "<p>Điều</p>", "https://bad": None, "https://wide": "<p>Điều</p>", None: None}
    assert fetch.decoded("<meta charset='iso-8859-1'>é".encode("latin-1")) == "<meta charset='iso-8859-1'>é"


def test_search_service_rotates_keys():
    calls, waits = [], []

    def post(url, headers, payload):
        calls.append((headers["X-API-KEY"], payload["q"]))
        if headers["X-API-KEY"] == "a":
            raise search.Refused("429")
        return {"organic": [{"link": "https://x"}, {"title": "no link"}]}

    service = search.Http({"keys": '["a", "b"]', "domains": '["s.vn"]', "delay": "1", "calls_per_key": "2"}, post, waits.append)
    assert service.search("q", 5) == [{"link": "https://x"}]
    assert calls == [("a", "q (site:s.vn)"), ("b", "q (site:s.vn)")] and waits == [1.0, 1.0, 1.0]
    service.search("q", 5)
    service.search("q", 5)  # b has had its calls; a is refused, b again
    assert [k for k, _ in calls[2:]] == ["b", "a", "b"]
    always = search.Http({"keys": '["a"]'}, post, waits.append)
    assert always.search("q", 5) == []
    with pytest.raises(ValueError):
        search.Http({})
    assert config.keys_in_order({"K_2": "y", "K_1": "x", "K_3": " "}, "K_") == ["x", "y"] and config.keys_in_order({"S": "z"}, "K_", "S") == ["z"]


def test_search_results_carry_their_task(spark):
    tasks = spark.createDataFrame([(2, "q2", 2), (1, "q1", 1)], "task int, query string, priority int")
    answers = {"q1": [{"link": "https://a.vn/1"}], "q2": [{"link": "https://a.vn/1", "snippet": "longer"}]}
    got = search.results(spark, tasks, "recorded", {"answers": json.dumps(answers)})
    assert sorted((r.task, r.priority, r.link) for r in got.collect()) == [(1, 1, "https://a.vn/1"), (2, 2, "https://a.vn/1")]
    assert [r.task for r in discovery.first_of_tasks(got.withColumnRenamed("link", "url")).collect()] == [1]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("target_laws:\n- name: Luật A\n  aliases: [a]\nquery_templates:\n- {id: t, template: 'x {law_name}', priority: 1}\n", encoding="utf-8")
    own = config.load(str(tmp_path / "c.yaml"))
    plan = discovery.tasks(config.law_table(spark, own), config.template_table(spark, own)).collect()
    assert [(r.query, r.priority) for r in plan] == [("x Luật A", 1)]
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert config.nested(config.load(str(tmp_path / "c.json")), "a", "b") == 1 and config.nested({"a": 1}, "a", "b", default=7) == 7
    env = {"OLD": "1"}
    assert config.read_env("# c\nOLD=2\nNEW = 'x'\nbroken\nQ=\"y=z\"", env) == {"NEW": "x", "Q": "y=z"} and env["OLD"] == "1"
    merged = config.source_settings({"timeout": 5, "headers": {"A": "1"}}, {"headers": {"B": "2"}}, {"retry_attempts": 9})
    assert merged == {"timeout": 5, "retry_limit": 9, "delay_between_retries_sec": 2, "headers": {"A": "1", "B": "2", "User-Agent": "Mozilla/5.0"}}
    log = config.daily_log(str(tmp_path / "logs"), "run.log")
    assert config.daily_log(str(tmp_path / "logs"), "run.log") is log and len(log.handlers) == 1
    log.handlers.clear()


def test_writers(spark, tmp_path):
    laws = spark.createDataFrame([("Luật Nhà ở: 2023", 1, "một\nhai"), ("Khác", 2, "x")], "law_name string, tier int, text string")
    writers.save_texts(laws, str(tmp_path / "texts"))
    files = [f for f in (tmp_path / "texts").rglob("*.txt")]
    assert [f.parent.name for f in files] == ["file=Luật_Nhà_ở_2023"] and files[0].read_text() == "một\nhai\n"
    writers.save_contents(spark.createDataFrame([("Luật Đất đai", "t", "<p>")], "law string, clean_text string, raw_html string"), str(tmp_path / "c"), raw_html=False)
    (found,) = (tmp_path / "c").rglob("part-*")
    assert found.parent.name == "file=luat_dat_dai.json" and json.loads(found.read_text()) == {"law_name": "Luật Đất đai", "clean_text": "t"}
    chunks = spark.createDataFrame([("L", 1, "b"), ("L", 0, "a")], "law_id string, position int, text string")
    (row,) = writers.envelope(chunks, ["law_id"], "now").collect()
    assert json.loads(row.json) == {"law_id": "L", "generated_at": "now", "total_chunks": 2, "chunks": [{"text": "a"}, {"text": "b"}]}
    audited = spark.createDataFrame([("rapport", None)], "report string, error string")
    assert writers.save_report(spark, audited, str(tmp_path / "r.md")) == (0, "rapport") and (tmp_path / "r.md").read_text() == "rapport"
    assert writers.save_report(spark, audited.withColumn("error", F.lit("no")))[0] == 2 and writers.save_report(spark, audited.limit(0))[0] == 1
    writers.save_health(spark, {"overall": 1}, str(tmp_path / "h.json"), "now")
    assert json.loads((tmp_path / "h.json").read_text()) == {"timestamp": "now", "overall": 1}
    at = datetime.datetime(2026, 1, 15, 9, 30)
    assert (writers.run_stamp(at), writers.minute_stamp(at)) == ("20260115_093000", "2026-01-15 09:30 UTC")


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in embedding.embedded(rows).collect()}
    assert len(got[1]) == 384 and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[2]) == {0.0}
    with pytest.raises(ValueError):
        embedding.client(embedding.offline, 99)


def test_long_laws_are_cut_in_linear_time(spark):
    import time

    def seconds(n):
        law = "\n".join(f"Điều {i}. Tên\n1. {'một câu ngắn. ' * 5}" for i in range(1, n + 1))
        docs = spark.createDataFrame([(1, "Luật X 2020", law)], "doc_id int, name string, text string")
        began = time.time()
        assert chunking.chunks(docs, ["doc_id"], "name", chunking.Sizes(10, 40, 5)).count() >= n / 3
        return time.time() - began

    seconds(100)
    assert seconds(20_000) < 30


def test_many_lines_are_cleaned_in_linear_time(spark):
    import time

    df = spark.createDataFrame([("\n".join(f"dòng {i // 2} có chữ" for i in range(40_000)),)], "x string")
    began = time.time()
    assert df.select(F.size(F.split(scraping.clean_lines("x"), "\n"))).first()[0] == 20_000
    assert time.time() - began < 15
