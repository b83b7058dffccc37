"""Law-shaped inputs made from the test tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a law: its lines are articles, ten of them a chapter."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def article(x, i):
        chapter = F.when(i % 10 == 0, F.concat(F.lit("Chương "), (F.floor(i / 10) + 1).cast("string"), F.lit(". Phần\n"))).otherwise("")
        return F.concat(chapter, F.lit("Điều "), (i + 1).cast("string"), F.lit(". "), F.left(x, F.lit(30)), F.lit("\n1. "), x, F.lit("\n2. "), F.left(x, F.lit(80)))

    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.lit("Luật Doanh nghiệp 2020").alias("name"), F.array_join(F.transform(lines, article), "\n").alias("text"))


LAWS_SQL = r"""laws AS (
  SELECT doc_id, source, lang, 'Luật Doanh nghiệp 2020' AS name,
         array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
           (CASE WHEN (i - 1) % 10 = 0 THEN 'Chương ' || ((i - 1) // 10 + 1) || '. Phần' || chr(10) ELSE '' END) || 'Điều ' || i || '. ' || left(x, 30) || chr(10) || '1. ' || x || chr(10) || '2. ' || left(x, 80)), chr(10)) AS text
  FROM documents
)"""

_TITLES = [
    "Bộ luật Dân sự 2015 số 91/2015/QH13", "Văn bản hợp nhất Luật Doanh nghiệp 67/VBHN-VPQH", "Luật sửa đổi Luật Doanh nghiệp 03/2022/QH15", "Luật Doanh nghiệp 2020 số 59/2020/QH14",
    "Luật Trọng tài thương mại 2010 số 54/2010/QH12", "Thông tin khác", "",
]
_SNIPPETS = ["Hiệu lực từ ngày: 01/01/2021", "ban hành ngày 5 tháng 6 năm 2019", "", "Ban hành 17/6/2010", "có năm 2015 trong đó"]
_HOSTS = ["https://thuvienphapluat.vn/van-ban", "https://www.congbao.chinhphu.vn/van-ban/luat-so-", "http://thuvienphapluat.vn/tin-tuc"]


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a search hit, found within twenty days."""
    pages = read(spark, sf_dir, "pages")
    third = F.expr("page_id div 3")
    tail = F.regexp_extract("url", r"^[a-z]+://[^/]*(.*)$", 1)
    gazette = F.concat(F.lit(_HOSTS[1]), F.expr("cast(page_id div 6 as string)"), F.lit("0.htm"))
    url = F.when(F.pmod("page_id", F.lit(4)) == 3, F.col("url")).when(F.pmod("page_id", F.lit(4)) == 1, gazette).otherwise(F.concat(_pick([_HOSTS[0], _HOSTS[2]], "page_id"), tail))
    return pages.select(
        F.col("page_id").alias("ord"), url.alias("link"), _pick(_TITLES, "page_id").alias("title"), F.element_at(F.array(*map(F.lit, _SNIPPETS)), (F.pmod(third, F.lit(len(_SNIPPETS))) + 1).cast("int")).alias("snippet"),
        F.concat(F.lit("2026-01-"), F.lpad((F.pmod("page_id", F.lit(20)) + 1).cast("string"), 2, "0"), F.when(F.pmod("page_id", F.lit(11)) == 0, "?").otherwise(" 00:00:00")).alias("discovered_at"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LINKS_SQL = rf"""links AS (
  SELECT page_id AS ord,
         CASE page_id % 4 WHEN 3 THEN url WHEN 1 THEN '{_HOSTS[1]}' || (page_id // 6) || '0.htm'
              ELSE {_list([_HOSTS[0], _HOSTS[2]])}[page_id % 2 + 1] || regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) END AS link,
         {_list(_TITLES)}[page_id % {len(_TITLES)} + 1] AS title, {_list(_SNIPPETS)}[(page_id // 3) % {len(_SNIPPETS)} + 1] AS snippet,
         '2026-01-' || lpad(CAST(page_id % 20 + 1 AS VARCHAR), 2, '0') || CASE WHEN page_id % 11 = 0 THEN '?' ELSE ' 00:00:00' END AS discovered_at
  FROM pages
)"""
NOW = "2026-01-15 00:00:00"

_PHRASES = ["người lao động", "tiền lương", "góp vốn", "cổ phần", "hàng hóa", "thừa kế", "bảo lãnh", "xuất khẩu"]


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a clause: ``conv_id``, ``position`` (from 1), ``text``.

    A turn's phrases follow from its ids, so that every field of law comes up.
    """
    turns = read(spark, sf_dir, "conversations")
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.pmod(F.col("conv_id") + F.expr("turn div 2"), F.lit(len(_PHRASES))) + 1).cast("int"))
    body = F.concat(F.lit("Điều "), (F.col("turn") + 1).cast("string"), F.lit(". "), phrase, F.lit("\n"), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", (F.col("turn") + 1).cast("int").alias("position"), body.alias("text"), "role")


CONTRACTS_SQL = rf"""clauses AS (
  SELECT conv_id, CAST(turn + 1 AS INTEGER) AS position, role,
         'Điều ' || (turn + 1) || '. ' || {_list(_PHRASES)}[(conv_id + turn // 2) % {len(_PHRASES)} + 1] || chr(10) || coalesce(text, '') AS text
  FROM conversations
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a law: its lines are articles, some without a number, some without a body."""
    line, law = F.col("l_linenumber").cast("string"), F.concat(F.lit("L"), F.col("l_orderkey").cast("string"))
    article = F.concat(law, F.lit("__"), F.when(F.col("l_linenumber") % 7 == 0, F.concat(F.lit("x"), line)).otherwise(line))
    body = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("1. "), F.col("l_linestatus"), F.lit("<br/>"), F.col("l_partkey").cast("string")))
    return read(spark, sf_dir, "lineitem").select(law.alias("law_id"), article.alias("article_id"), F.concat(F.lit("Điều "), line, F.lit(". "), F.col("l_returnflag")).alias("title"), body.alias("text"))


RECORDS_SQL = """records AS (
  SELECT 'L' || l_orderkey AS law_id, CASE WHEN l_linenumber % 7 = 0 THEN 0 ELSE l_linenumber END AS n, 'L' || l_orderkey || '__' || CASE WHEN l_linenumber % 7 = 0 THEN 'x' ELSE '' END || l_linenumber AS article_id,
         'Điều ' || l_linenumber || '. ' || l_returnflag || CASE WHEN l_partkey % 5 > 0 THEN chr(10) || '1. ' || l_linestatus || ' ' || l_partkey ELSE '' END AS part
  FROM lineitem
)"""


def law_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a page of one of two sites, or of neither; some have no content, or only a PDF."""
    i, x = F.col("item_id"), F.trim(F.regexp_replace("text", "[^a-zA-Z ]", ""))
    day = F.lpad((F.pmod(i, F.lit(28)) + 1).cast("string"), 2, "0")
    join = lambda *parts: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in parts))
    library = join("<title> Luật &amp; số ", i.cast("string"), "</title><body>Số 59/2020/QH14<p>Ngày ", (F.pmod(i, F.lit(28)) + 1).cast("string"), " tháng 6 năm 2019</p><p>có hiệu lực thi hành từ ngày 1 tháng 12 năm 2020</p>")
    year = F.when(F.pmod(i, F.lit(4)) == 0, "1900").otherwise("2020")
    gazette = join("<h1>Khác</h1><title>Trang</title><h1 class='big title'>Tên <b>", i.cast("string"), "</b></h1><p>Ban hành: ", day, "/06/2019</p> Hiệu lực: 01/07/", year)
    kind = F.pmod(i, F.lit(6))
    html = (
        F.when(kind == 0, join(library, '<div class="x content1"><p>', x, '</p><script>no</script><div class="ads">no</div><p> b </p></div><p>out</p>'))
        .when(kind == 1, join(library, "<p>", x, "</p>"))
        .when(kind == 2, join(gazette, '<div class="text">menu</div><div class="box-section--main"><div class="text"><p>', x, '</p><nav>no</nav><div class="ads">kept</div></div><div class="text">c</div></div>'))
        .when(kind == 3, join(gazette, '<div class="box-section--main wide"><p>', x, "</p><style>no</style></div>"))
        .when(kind == 4, join(gazette, '<div class="box-section--main"><a href="/a.PDF">file</a></div>'))
        .otherwise(join("<title>Other</title><div class='content1'>", x, "</div>"))
    )
    domain = F.when(kind < 2, "thuvienphapluat.vn").when(kind < 5, "congbao.chinhphu.vn").otherwise("example.org")
    url = join("https://", domain, "/van-ban/", F.when(kind.between(2, 4), "67/VBHN-VPQH/").otherwise(""), i.cast("string"))
    link_law = F.when(F.pmod(i, F.lit(5)) == 0, "LINK/1").when(F.pmod(i, F.lit(5)) == 1, "")
    return read(spark, sf_dir, "benchmark").select(i.alias("page_id"), domain.alias("source_domain"), url.alias("url"), html.alias("html"), link_law.alias("law_id"), F.when(F.pmod(i, F.lit(3)) == 0, "2018-01-01").alias("effective_date"))


LAW_PAGES_SQL = """law_pages AS (
  SELECT item_id AS i, item_id % 6 AS kind, trim(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) AS x, CASE item_id % 5 WHEN 0 THEN 'LINK/1' WHEN 1 THEN '' END AS link_law, CASE WHEN item_id % 3 = 0 THEN '2018-01-01' END AS link_date FROM benchmark
), meta AS (
  SELECT i, link_law, link_date, CASE WHEN kind < 2 THEN 'Luật & số ' || i WHEN kind < 5 THEN 'Tên ' || i END AS title, CASE WHEN kind < 2 THEN '59/2020/QH14' WHEN kind < 5 THEN '67/VBHN-VPQH' END AS law,
         CASE WHEN kind < 5 THEN '2019-06-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') END AS published, CASE WHEN kind < 2 THEN '2020-12-01' WHEN kind < 5 AND i % 4 > 0 THEN '2020-07-01' END AS effective FROM law_pages
)"""
