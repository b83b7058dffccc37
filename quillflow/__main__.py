"""Command lines: python -m quillflow chunk|discover|scrape|audit|health ..."""

from __future__ import annotations

import argparse
import datetime
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import discovery, health, models
from .plans import config, pipelines
from .plans import settings as s
from .sinks import writers
from .sources import fetch, readers, search


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillflow")
    out.add_argument("--env", help="file of KEY=VALUE lines")
    commands = out.add_subparsers(dest="command", required=True)
    chunk = commands.add_parser("chunk", help="chunks of the laws in a corpus")
    chunk.add_argument("corpus", nargs="+")
    chunk.add_argument("--law", action="append", required=True, metavar="ID=NAME")
    chunk.add_argument("--format", default="parquet")
    chunk.add_argument("--output", required=True)
    discover = commands.add_parser("discover", help="new links from a web search")
    discover.add_argument("config")
    discover.add_argument("--engine", default="recorded")
    discover.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
    discover.add_argument("--output", required=True, help="folder of the JSON lines of all runs")
    scrape = commands.add_parser("scrape", help="content of the laws that a queue has links for")
    scrape.add_argument("queue")
    scrape.add_argument("--law", action="append", help="only this law; may be repeated")
    scrape.add_argument("--output", required=True)
    audit = commands.add_parser("audit", help="report on a contract (.txt or .docx)")
    audit.add_argument("contract")
    audit.add_argument("--output", help="file of the report; else it is printed")
    checked = commands.add_parser("health", help="counts of the session's tables")
    checked.add_argument("--database")
    checked.add_argument("--output")
    return out


def _chunk(spark: SparkSession, args: argparse.Namespace, now: datetime.datetime) -> int:
    laws = spark.createDataFrame([tuple(x.split("=", 1)) for x in args.law], "law_id string, law_name string")
    chunks, stats, missing = pipelines.chunk_corpus(readers.corpus(spark, *args.corpus, format=args.format), laws)
    pipelines.save_chunks(chunks, stats, args.output, writers.minute_stamp(now))
    return 1 if missing.count() == len(args.law) else 0


def _discover(spark: SparkSession, args: argparse.Namespace, now: datetime.datetime) -> int:
    own = config.load(args.config)
    plan = discovery.tasks(config.law_table(spark, own), config.template_table(spark, own))
    hits = search.results(spark, plan, args.engine, dict(x.split("=", 1) for x in args.option))
    found = pipelines.discover(hits, readers.history(spark, f"{args.output}/*"), F.lit(now).cast("timestamp"), now.year)
    record = found.select("url", "title", "snippet", "source_domain", "law_id", "effective_date", F.lit(now.isoformat()).alias("discovered_at"), F.lit(False).alias("is_processed"))
    discovery.append_new(record, f"{args.output}/discovery_{writers.run_stamp(now)}.jsonl")
    return 0


def _scrape(spark: SparkSession, args: argparse.Namespace, now: datetime.datetime) -> int:
    links = readers.queue(spark, args.queue).withColumn("ord", F.monotonically_increasing_id())
    content, outcome, _ = pipelines.scrape(links, lambda df: fetch.fetched(df, fetch.http_get()), args.law)
    writers.save_contents(content.select("law", "law_id", "url", "source_domain", "title", "raw_html", "clean_text", "effective_date", "published_at", "char_count", "word_count", "has_structure"), args.output)
    return 0 if outcome.filter("not success").isEmpty() else 2


def _audit(spark: SparkSession, args: argparse.Namespace, now: datetime.datetime) -> int:
    if re.search(r"\.doc$", args.contract, re.IGNORECASE) or not os.path.exists(args.contract):
        return writers.EXIT_UNREADABLE
    contracts = readers.contract(spark, args.contract).select(F.col("path").alias("contract_id"), "text")
    empty = lambda df: df.withColumn("result", F.lit(""))
    code, report = writers.save_report(spark, pipelines.audit_contracts(spark, contracts, empty, models.Offline, writers.minute_stamp(now)), args.output)
    if not args.output:
        print(report)
    return code


def _health(spark: SparkSession, args: argparse.Namespace, now: datetime.datetime) -> int:
    counted = health.catalog(spark, args.database)
    tables = {r.table: {"count": r.n, "status": r.status} for r in counted.collect()}
    whole = health.overall(counted).first().asDict()
    if args.output:
        writers.save_health(spark, {"tables": tables, "overall": whole}, args.output, now.isoformat())
    else:
        print({"tables": tables, "overall": whole})
    return 0 if whole["healthy"] else 2


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.env:
        config.load_env(args.env)
    spark = SparkSession.builder.appName("quillflow").getOrCreate()
    run = {"chunk": _chunk, "discover": _discover, "scrape": _scrape, "audit": _audit, "health": _health}[args.command]
    return run(spark, args, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))


if __name__ == "__main__":
    sys.exit(main())
