"""Writers: texts and records by law, envelopes, reports, health, and tables that are replaced whole.

Everything is written by tasks; what a driver writes is a pointer or a report of
one contract.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


def run_stamp(now: datetime) -> str:
    """``20260115_093000``."""
    return now.strftime("%Y%m%d_%H%M%S")


def minute_stamp(now: datetime) -> str:
    """``2026-01-15 09:30 UTC``."""
    return now.strftime("%Y-%m-%d %H:%M UTC")


def stamped(now: Column, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """``run_stamp`` of a column."""
    return F.date_format(now, pattern)


# ---------------------------------------------------------------- files by law


def file_name(law: t.Text, names: dict[str, str] | None = None) -> Column:
    """A law's file: the configured one, else its folded name with underscores and ``.json``."""
    out = F.concat(F.replace(t.fold(law), F.lit(" "), F.lit("_")), F.lit(".json"))
    for name, configured in (names or {}).items():
        out = F.when(t.col(law) == name, configured).otherwise(out)
    return out


def _written(spark: SparkSession, path: str, data: bytes) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write(bytearray(data))
    out.close()


def save_texts(documents: DataFrame, path: str, name: str = "law_name", text: str = "text", tier: str | None = "tier") -> None:
    """Text of each law under its safe name, one directory a law; with a ``tier``, only those of the first."""
    own = documents.filter(F.col(tier) == 1) if tier and tier in documents.columns else documents
    own.select(t.safe_name(name).alias("file"), F.col(text).alias("value")).repartition("file").write.mode("overwrite").option("lineSep", "\n").partitionBy("file").text(path)


def save_contents(contents: DataFrame, path: str, names: dict[str, str] | None = None, raw_html: bool = True) -> None:
    """Content of each law (``law``) as JSON under its file's name, replacing what was there; ``raw_html`` may be left out."""
    own = contents if raw_html else contents.drop("raw_html")
    fields = [c for c in own.columns if c != "law"]
    rows = own.select(F.to_json(F.struct(F.col("law").alias("law_name"), *fields), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"), file_name("law", names).alias("file"))
    rows.repartition("file").write.mode("overwrite").option("compression", "none").partitionBy("file").text(path)


def envelope(chunks: DataFrame, keys: list[str], now: str) -> DataFrame:
    """One row for each document: ``keys`` and ``json``, its chunks in order under a head with their number and the time.

    A document's chunks are a bounded group; the corpus is never one value.
    """
    body = F.array_sort(F.collect_list(F.struct("position", F.struct(*[c for c in chunks.columns if c not in (*keys, "position")]).alias("chunk"))))
    each = chunks.groupBy(*keys).agg(body.alias("b"), F.count(F.lit(1)).alias("total_chunks"))
    whole = F.struct(*keys, F.lit(now).alias("generated_at"), "total_chunks", F.transform("b", lambda x: x["chunk"]).alias("chunks"))
    return each.select(*keys, F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


# ------------------------------------------------------- reports and health


EXIT_FINE, EXIT_UNREADABLE, EXIT_PIPELINE = 0, 1, 2


def save_report(spark: SparkSession, audited: DataFrame, path: str | None = None) -> tuple[int, str]:
    """Report of one audited contract, to a file if a path is given; exit code and report.

    0: fine; 1: there is no contract; 2: the pipeline failed (its report is written all the same).
    """
    found = audited.select("report", "error").head(1)
    if not found:
        return EXIT_UNREADABLE, ""
    report = found[0].report or "_(no report generated)_"
    if path:
        _written(spark, path, report.encode())
    return EXIT_PIPELINE if found[0].error else EXIT_FINE, report


def save_reports(audited: DataFrame, path: str) -> None:
    """Reports of many contracts, a directory each."""
    audited.select(F.col("contract_id").alias("contract"), F.col("report").alias("value")).repartition("contract").write.mode("overwrite").partitionBy("contract").text(path)


def save_health(spark: SparkSession, health: dict, path: str, now: str) -> None:
    """Health of the stores as one JSON file."""
    _written(spark, path, json.dumps({"timestamp": now, **health}, ensure_ascii=False, indent=2).encode())


# --------------------------------------------------- tables that are replaced

_POINTER = "current"


def _context(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return target, target.getFileSystem(conf), hadoop.FileContext.getFileContext(target.toUri(), conf)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Directory that the table's pointer names; None if there is no such table."""
    pointer, fs, _ = _context(spark, f"{path}/{_POINTER}")
    return f"{path}/{spark.read.text(pointer.toString()).first()[0]}" if fs.exists(pointer) else None


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as its last replacement left it; empty if there was none."""
    own = current_version(spark, path)
    return spark.read.schema(schema).json(own) if own else spark.createDataFrame([], schema)


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make the pointer name a version: a file beside it takes its place in one rename."""
    pointer, fs, context = _context(spark, f"{path}/{_POINTER}")
    if fs.getUri().getScheme() == "file":
        # Hadoop's local file system deletes before it renames.
        own = pointer.toUri().getPath()
        draft = os.path.join(os.path.dirname(own), f".{version}")
        with open(draft, "w", encoding="utf-8") as f:
            f.write(version)
        os.replace(draft, own)
        return
    _written(spark, f"{path}/.{version}", version.encode())
    draft, _, _ = _context(spark, f"{path}/.{version}")
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(draft, pointer, options)


def replace_table(spark: SparkSession, rows: DataFrame, path: str, backup: bool = True) -> str:
    """Replace a table: its rows go to a directory of their own, then the pointer to it is swapped in one atomic step.

    A reader sees the old state or the new one, never none, and rows may be made
    from the table itself.  The old directory stays as a backup if asked.
    """
    before = current_version(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{version}")
    _point(spark, path, version)
    if before and not backup:
        old, fs, _ = _context(spark, before)
        fs.delete(old, True)
    return f"{path}/{version}"
