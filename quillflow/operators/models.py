"""Models and page readers that a caller plugs in, behind small protocols."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.markup import DROPPED_CLASSES, Selector, extract_content


class Model(Protocol):
    """A chat model: a prompt in, an answer out; ``RetryLater`` when it is busy."""

    def __call__(self, prompt: str) -> str: ...


class RetryLater(Exception):
    """The service asked to come back later."""


def with_retry(call: Callable[[str], str], prompt: str, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Answer of a call that may ask to be repeated; the wait doubles each time."""
    for k in range(attempts):
        try:
            return call(prompt)
        except RetryLater:
            if k == attempts - 1:
                raise
            sleep(wait * 2**k)
    raise AssertionError


def asked(rows: DataFrame, prompt: Column, make: Callable[[], Model], out: str = "answer", wait: float = 2.0, parallel: int | None = None, pace: float = 0.0, failure: str = "error", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with a model's ``answer`` and, where it failed, null and the ``error``.

    The model is made once for each task.  One row's failure leaves the others
    alone.  Give this only the rows that need a model: it runs for all it gets.
    At most ``parallel`` calls run at a time (one: strictly in turn), and each
    task rests ``pace`` seconds between two calls.
    """
    schema = StructType([*rows.schema.fields, StructField(out, StringType()), StructField(failure, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, calls = make(), 0
        for batch in batches:
            answers, errors = [], []
            for text in batch["_prompt"]:
                if calls and pace:
                    sleep(pace)
                calls += 1
                try:
                    answers.append(with_retry(model, text, wait=wait))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield batch.drop(columns="_prompt").assign(**{out: answers, failure: errors})

    ready = rows.withColumn("_prompt", prompt)
    return (ready.repartition(parallel) if parallel else ready).mapInPandas(run, schema)


class Offline:
    """A stand-in without a network: the same answer to everything."""

    def __init__(self, answer: str = "[]"):
        self.answer = answer

    def __call__(self, prompt: str) -> str:
        return self.answer


#: Selectors of a site's content, the first that is found counts, and classes that are left out, by domain.  Fixed values.
PAGE_READERS: dict[str, tuple[tuple[Selector, ...], tuple[str, ...]]] = {
    "thuvienphapluat.vn": ((Selector("content1"),), DROPPED_CLASSES),
    "congbao.chinhphu.vn": ((Selector("text", inside="box-section--main", every=True), Selector("box-section--main", every=True)), ()),
}


def page_text(pages: DataFrame, readers: dict[str, tuple[tuple[Selector, ...], tuple[str, ...]]] = PAGE_READERS) -> DataFrame:
    """``pages`` (``source_domain``, ``html``) with ``content`` by their site's reader; null where there is none.

    A gazette page of under 200 characters that only links a PDF has no content.
    """
    parts = [pages.filter(F.col("source_domain") == d).withColumn("content", extract_content(*selectors, dropped_classes=dropped)("html")) for d, (selectors, dropped) in readers.items()]
    rest = pages.filter(~F.coalesce(F.col("source_domain").isin(*readers), F.lit(False))).withColumn("content", F.lit(None).cast("string"))
    every = reduce(DataFrame.unionByName, parts, rest)
    only_pdf = (F.col("source_domain") == "congbao.chinhphu.vn") & (F.length("content") < 200) & F.regexp_like("html", F.lit(r"(?i)\.pdf"))
    return every.withColumn("content", F.when(~F.coalesce(only_pdf, F.lit(False)), F.col("content")))
