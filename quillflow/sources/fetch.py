"""Pages over HTTP, in tasks."""

from __future__ import annotations

import re
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: An address to the bytes of its answer and the character set that its header names, if any.
Get = Callable[[str], tuple[bytes, str | None]]

_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w-]+)""", re.IGNORECASE)


def http_get(timeout: float = 30, headers: dict[str, str] | None = None) -> Get:
    def get(url: str) -> tuple[bytes, str | None]:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:
            return answer.read(), answer.headers.get_content_charset()

    return get


def decoded(data: bytes, charset: str | None = None) -> str:
    """Text of an answer: by a byte order mark, as UTF-8 if it is that, by the character set that page or header names, and at last as Windows text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    named = _META.search(data[:4096])
    for name in ("utf-8", named.group(1).decode("ascii") if named else None, charset, "cp1258"):
        if name:
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
    return data.decode("utf-8", "replace")


def fetched(links: DataFrame, get: Get, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``links`` (``url``) with ``html``; null after so many failed attempts, ``wait`` seconds apart.

    A task works on its links one after another, and one link's failure leaves
    the others alone.
    """
    schema = StructType([*(f for f in links.schema.fields if f.name != "html"), StructField("html", StringType())])

    def page(url: str | None) -> str | None:
        for k in range(attempts if url else 0):
            try:
                return decoded(*get(url))
            except Exception:
                if k + 1 < attempts:
                    sleep(wait)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(html=[page(u) for u in batch["url"]])

    return links.drop("html").mapInPandas(run, schema)
