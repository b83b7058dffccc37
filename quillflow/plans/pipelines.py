"""The four pipelines from end to end: chunk a corpus, discover links, scrape them, audit contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages
from ..functions import text as t
from ..functions.markup import clean_markup
from ..operators import audit, chunking, discovery, models, scraping
from ..sinks import writers
from ..sources import readers
from . import prompts
from . import settings as s


def law_documents(records: DataFrame) -> DataFrame:
    """Full text of each law: its records, cleaned, in the order of the number that ends their id; ``law_id``, ``text``.

    A law has at most some hundreds of articles, so its text is one value.
    """
    own = records.select("law_id", "article_id", readers.article_number("article_id").alias("n"), clean_markup("title").alias("title"), clean_markup("text").alias("body"))
    part = F.concat_ws("\n", t.present("title"), t.present("body"))
    parts = F.sort_array(F.collect_list(F.struct("n", "article_id", part.alias("part"))))
    return own.groupBy("law_id").agg(F.array_join(F.filter(F.transform(parts, lambda x: x["part"]), lambda x: x != ""), "\n\n").alias("text"))


def chunk_corpus(records: DataFrame, laws: DataFrame, sizes: chunking.Sizes = chunking.Sizes()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, statistics by law and in all, and the laws that weren't found."""
    found, missing = readers.select_laws(records, laws)
    texts = law_documents(found).join(F.broadcast(laws), "law_id")
    chunks = chunking.chunks(texts, ["law_id"], "law_name", sizes)
    flat = chunks.select("law_id", "metadata.estimated_tokens", "metadata.has_overlap")
    return chunks, chunking.statistics(flat, "law_id", "estimated_tokens", "has_overlap", sizes), missing


def save_chunks(chunks: DataFrame, statistics: DataFrame, path: str, now: str = "") -> None:
    """Chunks, each law's chunks in an envelope, and statistics as JSON, replacing what was there."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    writers.envelope(chunks, ["law_id"], now).select("json").write.mode("overwrite").text(f"{path}/envelopes")
    statistics.write.mode("overwrite").json(f"{path}/statistics")


def discover(hits: DataFrame, history: DataFrame, now: Column, this_year: int) -> DataFrame:
    """New links among search hits: filtered, read, one for each document, and not in recent history."""
    names = [x for name, aliases, _ in s.LAWS for x in (name, *aliases)]
    found = discovery.found_links(hits, s.ALLOWED, s.DENIED, names, s.SOURCES, this_year)
    return discovery.unseen(discovery.best_of_batch(found), history, now, s.REFRESH_DAYS)


def priority_chains(links: DataFrame, rules: dict[str, list[dict]] = s.RULES) -> DataFrame:
    """Candidates of each ``law``, first to last (``place``): the winners of its rules, or by the heuristic where it has none."""
    by_rule = scraping.rule_chains(links, rules, s.SOURCES).drop("rule")
    rest = links.join(by_rule.select("law").distinct(), "law", "left_anti")
    return by_rule.unionByName(scraping.heuristic_chain(rest, s.SOURCES))


def scrape(links: DataFrame, fetch: Callable[[DataFrame], DataFrame], only: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted content of each law, the outcome of each law, and the links that are done.

    ``fetch`` adds ``html``; all candidates of a law are fetched, in parallel,
    and the first that is accepted counts.  ``only`` names the laws that are
    wanted, without regard to case and accents; links of no law are done if all
    laws are.
    """
    pairs = [(name, aliases) for name, aliases, _ in s.LAWS]
    grouped = links.withColumn("law", scraping.canonical_law("title", pairs))
    wanted = grouped.filter("law is not null")
    if only:
        wanted = wanted.filter(t.fold("law").isin([t.fold_text(x) for x in only]))
    read = pages.with_metadata(models.page_text(fetch(priority_chains(wanted))))
    ready = pages.filled_in(read).withColumns({"title": F.col("page_title"), "clean_text": scraping.clean_lines("content", s.BLACKLIST)})
    tried = scraping.scraped(ready, s.MIN_CHARS, s.REQUIRED_KEYWORDS, s.BLACKLIST)
    outcome = scraping.first_success(tried.select("law", "place", "url", "success", "error"))
    content = tried.join(outcome.filter("success").select("law", "url"), ["law", "url"], "left_semi")
    done = wanted.join(outcome.filter("success").select("law"), "law", "left_semi").select("url")
    return content, outcome, done if only else done.unionByName(grouped.filter("law is null").select("url"))


def audit_contracts(spark: SparkSession, contracts: DataFrame, retrieve: Callable[[DataFrame], DataFrame], make: Callable[[], models.Model], now: str, pace: float = 0.0, write_reports: bool = False) -> DataFrame:
    """``contract_id``, ``domain``, ``confidence``, ``error`` and ``report`` of every contract (``contract_id``, ``text``).

    ``retrieve`` adds ``result`` to clauses (``contract_id``, ``position``,
    ``clause``).  The model that ``make`` gives names fields and clauses where
    patterns can't, judges each clause with ``pace`` seconds between two, and
    writes the reports, if asked, of contracts with findings and a confidence of
    0.3 or more; others, and those that it fails on, are filled into a template.
    """

    def ask(frame: DataFrame, about: str) -> DataFrame:
        prompt = prompts.filled(prompts.ROUTE if about == "domain" else prompts.SPLIT, contract=F.left("text", F.lit(prompts.CONTRACT_CHARS)))
        return models.asked(frame, prompt, make, failure="failure")

    routed = audit.routed(contracts, ask)
    each = routed.filter("error is null").select("contract_id", "domain", F.posexplode_outer("clauses").alias("p", "clause")).withColumn("position", F.col("p") + 1).drop("p")
    sections = audit.unique_context(retrieve(each).withColumn("result", F.left("result", F.lit(1000))), ["contract_id"])
    ready = audit.context_for_clauses(each, sections, ["contract_id"])
    answers = models.asked(ready, prompts.filled(prompts.JUDGE, clause="clause", legal_context="context"), make, pace=pace)
    found = audit.findings(answers.filter("error is null"))
    base = answers.select("contract_id", "position", F.col("error").isNotNull().alias("failed"))
    rows = base.join(found.select("contract_id", "position", "finding"), ["contract_id", "position"], "left")
    scored = audit.judged(rows.withColumn("reference_law", F.col("finding.reference_law")), ["contract_id"]).drop("clauses", "findings", "failed")
    listed = rows.filter("finding is not null").groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("position", "finding.*"))).alias("found"))
    none = "cast(array() as array<struct<position:int,clause:string,violation:string,reference_law:string,suggested_fix:string>>)"
    whole = routed.withColumnRenamed("error", "refused").join(scored, "contract_id", "left").join(listed, "contract_id", "left")
    confidence, n = F.coalesce("confidence", F.lit(0.0)), F.coalesce(F.greatest(F.size("clauses"), F.lit(0)), F.lit(0))
    whole = whole.select("contract_id", "domain", confidence.alias("confidence"), F.coalesce("refused", "error").alias("error"), n.alias("n"), F.coalesce("found", F.expr(none)).alias("found"))
    template = audit.report(F.col("domain"), F.col("confidence"), F.col("n"), F.col("found"), F.col("error"), now)
    if not write_reports:
        return whole.withColumn("report", template).drop("n", "found")
    rich = (F.col("confidence") >= 0.3) & (F.size("found") > 0) & F.col("error").isNull()
    listed_json = F.to_json(F.transform("found", lambda f: f.dropFields("position")), {"pretty": "true"})
    written = models.asked(whole.filter(rich), prompts.filled(prompts.REPORT, domain="domain", findings_json=listed_json), make, failure="failure")
    both = written.select(*whole.columns, "answer").unionByName(whole.filter(~rich).withColumn("answer", F.lit(None).cast("string")))
    return both.withColumn("report", F.coalesce("answer", template)).drop("n", "found", "answer")
