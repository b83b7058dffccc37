"""Text out of markup, where Spark has no built-in: Arrow-batched functions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def clean(value: str | None) -> str:
    """Plain text of a field: entities (escaped twice at most), tags, control characters, line ends and blanks put right."""
    if not value:
        return ""
    value = unicodedata.normalize("NFC", re.sub(r"<[^>]+>", " ", html.unescape(html.unescape(value))))
    value = _CONTROL.sub("", value).replace("\r\n", "\n").replace("\r", "\n")
    value = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in re.sub(r"\n{3,}", "\n\n", value).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", value).strip()


@F.pandas_udf(StringType())
def clean_markup(values: pd.Series) -> pd.Series:
    return values.map(clean)


class Selector(NamedTuple):
    """Elements of a class (or ``<tag>``), inside an element of another class if one is named: the first, or every one."""

    wanted: str
    inside: str | None = None
    every: bool = False


class _Extractor(HTMLParser):
    """Texts of the elements that a selector means, without some elements in them.

    An element that is inside another such element has its text in both.
    """

    def __init__(self, selector: Selector, dropped: frozenset[str], dropped_classes: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.selector, self.dropped, self.dropped_classes = selector, dropped, dropped_classes
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, and whether it opens an element, is left out, is what others must be inside of
        self.open: list[list[str]] = []
        self.around = self.skipped = 0
        self.texts: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        s = self.selector
        starts = (s.wanted in classes or s.wanted == f"<{tag}>") and (s.inside is None or self.around > 0) and (s.every or not self.texts)
        drop = bool(self.open) and (tag in self.dropped or not self.dropped_classes.isdisjoint(classes))
        around = s.inside in classes if s.inside else False
        self.stack.append((tag, starts, drop, around))
        self.around += around
        self.skipped += drop
        if starts:
            self.texts.append([])
            self.open.append(self.texts[-1])

    def handle_endtag(self, tag: str) -> None:
        if not any(own[0] == tag for own in self.stack):
            return
        while self.stack:
            name, started, drop, around = self.stack.pop()
            self.around -= around
            self.skipped -= drop
            if started:
                self.open.pop()
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.skipped and data.strip():
            for parts in self.open:
                parts.append(data.strip())


# What is left out of a page's content.
DROPPED_TAGS = ("script", "style", "nav", "footer", "noscript", "iframe")
DROPPED_CLASSES = ("box-comment", "tools", "social-share", "advertisement", "ads", "banner")


def content(page: str | None, selectors: Iterable[Selector | str], dropped_classes: Iterable[str] = DROPPED_CLASSES) -> str | None:
    """Text of the first selector that the page has elements for; None if it has none.  A string is a class or ``<tag>``."""
    for selector in selectors:
        parser = _Extractor(selector if isinstance(selector, Selector) else Selector(selector), frozenset(DROPPED_TAGS), frozenset(dropped_classes))
        parser.feed(page or "")
        parser.close()
        if parser.texts:
            return "\n".join("\n".join(parts) for parts in parser.texts if parts)
    return None


def extract_content(*selectors: Selector | str, dropped_classes: Iterable[str] = DROPPED_CLASSES):
    """Column function: ``content`` by the given selectors, in that order."""
    left_out = tuple(dropped_classes)

    @F.pandas_udf(StringType())
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: content(page, selectors, left_out))

    return extract
