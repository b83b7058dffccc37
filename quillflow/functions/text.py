"""Column expressions over text, URLs and dates.

All are built-in expressions: they stay in generated code and need no Python
worker.  Missing values count as empty text unless stated otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = str | Column


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Text) -> Column:
    return F.coalesce(col(c), F.lit(""))


def present(c: Text) -> Column:
    """Null for null and for empty text."""
    return F.nullif(col(c), F.lit(""))


@cache
def _accents() -> tuple[str, str]:
    """Letters with accents, and the bare letters at the same places, from the Unicode tables."""
    plain = {"đ": "d", "Đ": "D"}
    for code in range(0xC0, sys.maxunicode + 1):
        letter = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or code > 0xFFFF:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if base != letter and len(base) == 1:
            plain[letter] = base
    return "".join(plain), "".join(plain.values())


def fold(c: Text) -> Column:
    """Lower case without accents, for matching."""
    source, target = _accents()
    return F.lower(F.translate(F.regexp_replace(text(c), r"\p{Mn}", ""), source, target))


def fold_text(value: str) -> str:
    """``fold`` of a constant, by the same table: letters that it leaves alone stay here too."""
    source, target = _accents()
    return "".join(c for c in value if unicodedata.category(c) != "Mn").translate(str.maketrans(source, target)).lower()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collected(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str, finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """Array of what ``step(state, item)`` puts out for each item, besides the next state.

    Values gather in short arrays inside a long one, so that appending to a long
    result doesn't copy all of it each time.  ``finish(state, array)`` may change
    the whole.
    """
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def struct(**fields: Column) -> Column:
        return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))

    def add(acc: Column, item: Column) -> Column:
        following, out = step(acc, item)

        def put(part: Column) -> Column:
            full = F.size(part) >= 256
            return struct(**following, part=F.when(full, empty).otherwise(part), done=F.when(full, F.array_append(acc["done"], part)).otherwise(acc["done"]))

        return let(F.array_append(acc["part"], out), put)

    def end(acc: Column) -> Column:
        whole = F.flatten(F.array_append(acc["done"], acc["part"]))
        return finish(acc, whole) if finish else whole

    return F.aggregate(items, struct(**state, part=empty, done=F.expr(f"cast(array() as array<array<{kind}>>)")), add, end)


#: White space as Unicode has it.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Text) -> Column:
    """Without white space, of any script, at either end; only the ends are looked at."""
    return F.btrim(text(c), F.lit(BLANKS))


def line(c: Text) -> Column:
    """A line with its ends stripped and runs of blanks made one."""
    return F.regexp_replace(strip(c), r"[ \t]+", " ")


def tokens(c: Text, chars_per_token: float = 3.5) -> Column:
    """Estimated tokens: length over ``chars_per_token``, cut to a whole number."""
    return F.floor(F.length(text(c)) / F.lit(chars_per_token)).cast("int")


def words(c: Text) -> Column:
    """Runs of anything but white space."""
    return F.size(F.regexp_extract_all(text(c), F.lit(r"(?U)\S+"), F.lit(0)))


def found(c: Text, pattern: str, group: int = 1) -> Column:
    """First match of a pattern; null if there is none."""
    return present(F.regexp_extract(text(c), pattern, group))


# ------------------------------------------------------------------------ URLs

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def domain(url: Text) -> Column:
    """Authority without any ``www.``; port and case stay."""
    return F.replace(F.regexp_extract(text(url), _AUTHORITY, 1), F.lit("www."), F.lit(""))


def path(url: Text) -> Column:
    return F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Text) -> Column:
    """Key under which two addresses count as one document.

    The scheme stays; the host is lower-case without ``www.``; parameters, query
    and fragment go, and so do slashes at the end and index pages of the root.
    On ``congbao.chinhphu.vn`` ``.htm`` is ``.html`` and a page number after the
    document's number goes.
    """
    scheme = F.lower(F.regexp_extract(text(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.replace(F.lower(F.regexp_extract(text(url), _AUTHORITY, 1)), F.lit("www."), F.lit(""))
    own = F.regexp_replace(path(url), r"/*(;[^/]*)?$", "")
    own = F.when(F.lower(own).isin("/index.html", "/index.htm", "/default.aspx"), "").otherwise(own)
    gazette = own
    for pattern, to in ((r"(?i)\.htm$", ".html"), (r"(?i)(-\d{2,7})/\d+\.html?$", "$1.html"), (r"(?i)(-\d{2,7})/\d+$", "$1")):
        gazette = F.regexp_replace(gazette, pattern, to)
    return F.when(scheme == "", F.lower(text(url))).otherwise(F.concat(scheme, F.lit("://"), host, F.when(host == "congbao.chinhphu.vn", gazette).otherwise(own)))


# --------------------------------------------------------------- laws and dates

# The forms of law numbers, on folded text.
LAW_ID = r"(?i)(?:so\s*)?(\d{1,4}/VBHN-[A-Z]{2,6}|\d{1,3}/\d{4}/QH\d{1,2}|\d{1,3}/\d{4}/(?:ND|NĐ)-CP|\d{1,3}/\d{4}/[A-ZĐ]{2,4}(?:-[A-ZĐ]{2,4})?)"
LAW_ID_ON_PAGE = r"(?i)(\d{1,4}/VBHN-[A-Z]{2,6}|\d{1,3}/\d{4}/QH\d{1,2}|\d{1,3}/\d{4}/(?:ND|NĐ)-CP)"


def law_id(c: Text, pattern: str = LAW_ID) -> Column:
    """Number of a law in a text, in upper case; null if there is none."""
    return F.upper(found(fold(c), pattern))


def _full_date(c: Column, pattern: str, last_year: int, first_year: int = 2000) -> Column:
    """Date of the first match of a pattern (day, month, year); null if its year is out of range.  Day and month aren't checked."""
    day, month, year = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    fine = year.try_cast("int").between(first_year, last_year)
    return F.when(fine, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


# How dates are written, on folded text.
LABELLED = r"hieu\s*luc\s*(?:ke\s*tu\s*)?(?:ngay\s+)?[:\-\s]*(\d{1,2})\s*(?:thang)?[/\-\s]+(\d{1,2})\s*(?:nam)?[/\-\s]+(\d{4})"
SPELT_OUT = r"ngay\s+(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})"
ISSUED = r"ban\s*hanh\s+"
BARE = r"(?i)(?<![A-Z0-9/])(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})(?![A-Z0-9/\-])"
ANY = r"(?:ngay\s+)?(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
YEAR = r"(?<![A-Z0-9/])(\d{4})(?![A-Z0-9/\-])"


def effective_date(c: Text, this_year: int) -> Column:
    """Date as ``YYYY-MM-DD``, or ``YYYY-??-??`` where only a year is known; a string, since its day may not exist.

    In order: after an "effective" label, spelt out, after an "issued" label
    (labelled, then bare), any date, any year.  Each step tries its first match
    only and falls through if the year is before 2000 or after the next one.
    """
    last = this_year + 1

    def ladder(folded: Column) -> Column:
        tail = F.when(F.regexp_like(folded, F.lit(ISSUED)), F.get(F.split(folded, ISSUED, 2), F.lit(1)))
        year = F.regexp_extract(folded, YEAR, 1)
        return F.coalesce(
            _full_date(folded, LABELLED, last), _full_date(folded, SPELT_OUT, last), _full_date(tail, LABELLED, last), _full_date(tail, BARE, last), _full_date(folded, ANY, last),
            F.when(year.try_cast("int").between(2000, last), F.concat(year, F.lit("-??-??"))),
        )

    return let(fold(c), ladder)


def date_key(c: Text, missing: str = "00000000") -> Column:
    """Eight digits to sort partial dates by: dashes go, ``?`` counts as 0."""
    digits = F.translate(F.coalesce(present(c), F.lit(missing)), "?-", "0")
    return F.when(F.length(digits) >= 8, digits).otherwise(F.rpad(digits, 8, "0"))


# ---------------------------------------------------------------------- names

# Short names of laws, tried in this order.
PREFIXES = [
    ("blds", ["dân sự"]), ("ldn", ["doanh nghiệp"]), ("lttm", ["trọng tài"]), ("ltm", ["thương mại"]), ("blld", ["lao động"]),
    ("lno", ["nhà ở"]), ("lkdbds", ["bất động sản", "kinh doanh bds"]),
]


def document_prefix(name: Text) -> Column:
    """Short name of a document: a known one or the initials of its words, and the first four digits in a row."""
    lowered = F.lower(text(name))
    initials = F.array_join(F.filter(F.transform(F.regexp_extract_all(lowered, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.left(w, F.lit(1))), lambda x: F.regexp_like(x, F.lit(r"(?U)\p{L}"))), "")
    short = None
    for prefix, keys in PREFIXES:
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.contains(lowered, F.lit(key))
        short = F.when(hit, prefix) if short is None else short.when(hit, prefix)
    return F.concat(short.otherwise(initials), F.regexp_extract(text(name), r"(\d{4})", 1))


def chunk_id(prefix: Column, first: Column, last: Column, count: Column, part: Column, position: Column) -> Column:
    """``prefix_dieu_001_to_003_p2``, or ``prefix_chunk_0001`` for a chunk without article number."""
    named = F.concat(F.format_string("dieu_%03d", first), F.when(count > 1, F.format_string("_to_%03d", last)).otherwise(""), F.when(part > 0, F.format_string("_p%d", part)).otherwise(""))
    return F.concat(prefix, F.lit("_"), F.when(first > 0, named).otherwise(F.format_string("chunk_%04d", position)))


def safe_name(name: Text) -> Column:
    """A file's name: word characters and dashes, blanks as underscores."""
    return F.replace(strip(F.regexp_replace(text(name), r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_"))
