import pytest
from pyspark.sql import functions as F

from quillflow.functions import markup
from quillflow.functions import text as t


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_fold(spark):
    assert values(spark, t.fold, "ĐIỀU Khoản", "Chương", "é́x", None) == ["dieu khoan", "chuong", "ex", ""]
    assert t.fold_text("Đăng ký") == "dang ky"


def test_strip_tokens_words(spark):
    assert values(spark, t.strip, "　 a b \n", None) == ["a b", ""]
    assert values(spark, t.tokens, "x" * 7, "x" * 13, "") == [2, 3, 0]
    assert values(spark, t.words, " a  b\n　c ", "") == [3, 0]
    assert values(spark, t.line, "  a \t b  ") == ["a b"]


SAME = [
    ("https://thuvienphapluat.vn/van-ban/Doanh-nghiep/", "https://thuvienphapluat.vn/van-ban/Doanh-nghiep", True),
    ("https://www.thuvienphapluat.vn/van-ban/law", "https://thuvienphapluat.vn/van-ban/law", True),
    ("https://congbao.chinhphu.vn/van-ban/luat-so-91-2015-qh13-18397.htm", "https://congbao.chinhphu.vn/van-ban/luat-so-91-2015-qh13-18397.html", True),
    ("https://congbao.chinhphu.vn/van-ban/luat-so-59-2020-qh14-31674/31830.htm", "https://congbao.chinhphu.vn/van-ban/luat-so-59-2020-qh14-31674.html", True),
    ("https://thuvienphapluat.vn/van-ban", "https://thuvienphapluat.vn/van-ban/index.html", False),
    ("http://a.vn/x", "https://a.vn/x", False),
    ("https://a.vn/x?q=1#f", "https://a.vn/x", True),
    ("https://a.vn/index.html", "https://a.vn/", True),
    ("https://a.vn:81/x", "https://a.vn/x", False),
]


@pytest.mark.parametrize(("a", "b", "same"), SAME)
def test_canonical_url(spark, a, b, same):
    x, y = values(spark, t.canonical_url, a, b)
    assert (x == y) == same


def test_domain_and_path(spark):
    assert values(spark, t.domain, "https://www.A.vn:8/x", "no url") == ["A.vn:8", ""]
    assert values(spark, t.path, "https://a.vn/van-ban/x?y=/z") == ["/van-ban/x"]


def test_law_id(spark):
    got = values(spark, t.law_id, "Luật số 59/2020/QH14", "văn bản 67/VBHN-VPQH", "1234/2015/QH13", "12/2020/NĐ-CP", "none")
    assert got == ["59/2020/QH14", "67/VBHN-VPQH", "234/2015/QH13", "12/2020/ND-CP", None]


def test_effective_date(spark):
    got = values(spark, lambda c: t.effective_date(c, 2026), "Hiệu lực: 01/07/2021", "ngày 5 tháng 9 năm 2020", "Ban hành 3/4/2019", "Hiệu lực 1/1/1900 rồi 2/3/2018", "31/02/2020", "năm 2015 có", "1999", "nothing", "hiệu lực 1/1/2099")
    assert got == ["2021-07-01", "2020-09-05", "2019-04-03", None, "2020-02-31", "2015-??-??", None, None, None]


def test_date_key(spark):
    assert values(spark, t.date_key, "2020-01-02", "2020-??-??", "2020", None, "2020-01-02T03") == ["20200102", "20200000", "20200000", "00000000", "20200102T03"]


def test_names(spark):
    assert values(spark, t.document_prefix, "Bộ luật Dân sự 2015", "Luật Trọng tài thương mại 2010", "Luật Thương mại", "Nghị định 15 về Giá 2024") == ["blds2015", "lttm2010", "ltm", "nđvg2024"]
    df = spark.createDataFrame([("a", 1, 3, 2, 0, 1), ("a", 1234, 1234, 1, 2, 1), ("a", 0, 0, 1, 0, 7)], "p string, f int, l int, c int, s int, i int")
    got = [r[0] for r in df.select(t.chunk_id(*(F.col(x) for x in "pflcsi"))).collect()]
    assert got == ["a_dieu_001_to_003", "a_dieu_1234_p2", "a_chunk_0007"]
    assert values(spark, t.safe_name, "Luật: A/B c-d ") == ["Luật_AB_c-d"]


def test_markup(spark):
    assert values(spark, markup.clean_markup, "&amp;lt;b&amp;gt;x &amp; y\r\n\r\n\r\n\r\nz", "<p>a</p>  <b>b</b>", None) == ["x & y\n\nz", "a b", ""]
    page = "<html><body><div class='x content1'>A<br>B<script>no</script><div class='ads'>no<p>no</div><p>C &amp; D</div>out</body></html>"
    assert markup.content(page, ["content1"]) == "A\nB\nC & D"
    assert markup.content(page, ["missing"]) is None and markup.content(page, ["missing", "<body>"]).endswith("out")
    assert values(spark, markup.extract_content("content1"), page, None) == ["A\nB\nC & D", None]
