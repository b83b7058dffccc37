"""Metadata of law pages: titles, numbers and dates, as column expressions over markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t

_ENTITIES = (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags go, the usual entities are read."""
    out = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, letter in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return out


def _element(html: t.Text, head: str, tag: str) -> Column:
    """Text of the first such element, stripped; null where the page has none."""
    pattern = rf"(?is)<{tag}{head}>(.*?)</{tag}\s*>"
    return F.when(F.regexp_like(t.text(html), F.lit(pattern)), t.strip(plain(F.regexp_extract(t.text(html), pattern, 1))))


def document_title(html: t.Text) -> Column:
    """``<title>``, else ``<h1>``."""
    return F.coalesce(_element(html, r"(?:\s[^>]*)?", "title"), _element(html, r"(?:\s[^>]*)?", "h1"))


def gazette_title(html: t.Text) -> Column:
    """``<h1>`` of class ``title``, else any ``<h1>``, else ``<title>``."""
    classed = r"""\s(?:[^>]*\s)?class\s*=\s*["']?(?:[^"'>]*\s)?title(?:\s[^"'>]*)?["'][^>]*"""
    return F.coalesce(_element(html, classed, "h1"), _element(html, r"(?:\s[^>]*)?", "h1"), _element(html, r"(?:\s[^>]*)?", "title"))


def page_words(html: t.Text) -> Column:
    """All text of a page, its pieces stripped and parted by single blanks."""
    pieces = F.split(F.regexp_replace(t.text(html), r"(?s)<!--.*?-->|<[^>]*>", "\x01"), "\x01")
    return F.array_join(F.filter(F.transform(pieces, lambda x: t.strip(plain(x))), lambda x: x != ""), " ")


# How the two sites write dates, on folded text.
PUBLISHED_LONG = r"ngay\s*(\d{1,2})\s*thang\s*(\d{1,2})\s*nam\s*(\d{4})"
EFFECTIVE_LONG = r"co\s*hieu\s*luc\s*thi\s*hanh\s*tu\s*ngay\s*(\d{1,2})\s*thang\s*(\d{1,2})\s*nam\s*(\d{4})"
PUBLISHED_LABEL = r"ban\s*hanh:\s*(\d{2})/(\d{2})/(\d{4})"
EFFECTIVE_LABEL = r"hieu\s*luc:\s*(\d{2})/(\d{2})/(\d{4})"


def _date(folded: Column, pattern: str) -> Column:
    """First match as ``YYYY-MM-DD``, day and month with two digits; null without one."""
    day, month, year = (F.regexp_extract(folded, pattern, k) for k in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def library_dates(folded: Column) -> tuple[Column, Column]:
    """Published and effective date, both spelt out."""
    return _date(folded, PUBLISHED_LONG), _date(folded, EFFECTIVE_LONG)


def gazette_dates(folded: Column) -> tuple[Column, Column]:
    """Published and effective date after their labels; an effective date of 1900 is none."""
    effective = _date(folded, EFFECTIVE_LABEL)
    return _date(folded, PUBLISHED_LABEL), F.when(~F.startswith(effective, F.lit("1900-")), effective)


#: Title and dates by site.
SITES: dict[str, tuple[Callable, Callable]] = {"thuvienphapluat.vn": (document_title, library_dates), "congbao.chinhphu.vn": (gazette_title, gazette_dates)}


def with_metadata(pages: DataFrame, sites: dict[str, tuple[Callable, Callable]] = SITES) -> DataFrame:
    """``pages`` (``source_domain``, ``url``, ``html``) and what they say: ``page_title``, ``page_law_id``, ``published_at``, ``page_effective_date``.

    The law's number is sought in title, text and address, in this order.  Pages
    of other sites have none of these.
    """
    by_site = lambda value: _cases({d: value(*of) for d, of in sites.items()})
    read = pages.withColumn("page_title", by_site(lambda title, _: title("html")))
    known = F.col("source_domain").isin(*sites)
    read = read.withColumn("_all", F.when(known, F.concat_ws("\n", t.text("page_title"), page_words("html"), t.text("url"))))
    read = read.withColumn("_folded", t.fold("_all"))
    dates = lambda k: by_site(lambda _, of: of(F.col("_folded"))[k])
    number = F.when(known, F.upper(t.found(F.upper(F.col("_folded")), t.LAW_ID_ON_PAGE)))
    return read.withColumns({"page_law_id": number, "published_at": dates(0), "page_effective_date": dates(1)}).drop("_all", "_folded")


def _cases(values: dict[str, Column]) -> Column:
    out = None
    for domain, value in values.items():
        case = F.col("source_domain") == domain
        out = F.when(case, value) if out is None else out.when(case, value)
    return out if out is not None else F.lit(None).cast("string")


def filled_in(content: DataFrame) -> DataFrame:
    """``law_id`` and ``effective_date`` of scraped content: the link's number, else the page's, else "unknown"; the page's date, else the link's."""
    number = F.coalesce(t.present("law_id"), t.present("page_law_id"), F.lit("unknown"))
    return content.withColumns({"law_id": number, "effective_date": F.coalesce(t.present("page_effective_date"), t.present("effective_date"))})
