"""Readers of corpora, texts, queues and contracts; schemas are declared, never inferred."""

from __future__ import annotations

import io
import os
import re
import zipfile
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as t

RECORD = "law_id string, article_id string, title string, text string"
LINK = "url string, title string, source_domain string, search_query string, discovered_at string, snippet string, is_processed boolean, query_id string, law_id string, effective_date string, processed_at string"


def corpus(spark: SparkSession, *paths: str, format: str = "parquet") -> DataFrame:
    """All splits of a dataset, one after another."""
    return reduce(DataFrame.unionByName, [spark.read.schema(RECORD).format(format).load(p) for p in paths])


def article_number(article_id: t.Text) -> Column:
    """Number after the last ``__`` of an article's id; 0 without one."""
    return F.coalesce(F.element_at(F.split(t.col(article_id), "__"), -1).try_cast("int"), F.lit(0))


def select_laws(records: DataFrame, laws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the laws asked for (``law_id``, ``law_name``), and the laws that have none."""
    return records.join(laws, "law_id"), laws.join(records, "law_id", "left_anti")


def override(first: DataFrame, second: DataFrame, key: str = "law_id") -> DataFrame:
    """Records of both tiers; a law that the second has is taken from there alone."""
    return first.join(second.select(key).distinct(), key, "left_anti").unionByName(second)


def law_text(spark: SparkSession, path: str, law_id: str, law_name: str) -> DataFrame:
    """Articles of a text file as records; none if it has no article heading."""
    from ..functions.markup import clean_markup
    from ..operators.chunking import articles

    whole = spark.read.text(path, wholetext=True).select(clean_markup("value").alias("text"))
    each = articles(whole).select(F.explode("articles").alias("a")).filter("a.number > 0")
    body = F.regexp_replace("a.text", r"^[^\n]*\n?", "")
    heading = F.regexp_extract("a.text", r"^[^\n]*", 0)
    return each.select(F.lit(law_id).alias("law_id"), F.concat(F.lit(f"{law_id}__"), F.col("a.number").cast("string")).alias("article_id"), heading.alias("title"), body.alias("text"), F.lit(law_name).alias("law_name"))


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Links of a JSON-lines queue that aren't processed; a missing flag means no."""
    return spark.read.schema(LINK).json(path).filter(~F.coalesce("is_processed", F.lit(False)))


def history(spark: SparkSession, glob: str, current: str | None = None) -> DataFrame:
    """Links of all earlier runs but the current file; corrupt files and lines are skipped.  Without any file, none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(glob)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(target):
        return spark.createDataFrame([], LINK)
    read = spark.read.schema(LINK).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(glob)
    return read if current is None else read.filter(F.col("_metadata.file_name") != os.path.basename(current))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processor file, one to a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(x.text or "" for x in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def contract(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of contracts: ``.docx`` by paragraphs, ``.doc`` refused, anything else as text."""
    if re.search(r"\.doc$", path, re.IGNORECASE):
        raise ValueError("convert .doc files to .docx first")
    if re.search(r"\.docx$", path, re.IGNORECASE):

        @F.pandas_udf(StringType())
        def text(values: pd.Series) -> pd.Series:
            return values.map(docx_text)

        return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
