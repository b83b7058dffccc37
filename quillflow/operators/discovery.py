"""Discovery of sources: search tasks, filters, deduplication and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def tasks(laws: DataFrame, templates: DataFrame) -> DataFrame:
    """Search tasks in the order in which they run: laws (``ord``, ``name``, ``keywords``) by templates (``ord``, ``id``, ``template``, ``priority``), then each law's own keywords.

    Both tables are configuration of a few rows.  Own keywords have priority 2.
    """
    made = laws.crossJoin(templates.withColumnRenamed("ord", "_t")).select(
        F.col("ord"), F.col("_t").alias("sub"), F.lit(0).alias("kind"), F.replace("template", F.lit("{law_name}"), F.col("name")).alias("query"), F.col("id").alias("query_id"), "priority", "name",
    )
    own = laws.select("ord", F.posexplode("keywords").alias("sub", "query"), "name").select(
        "ord", "sub", F.lit(1).alias("kind"), "query", F.lit("keyword").alias("query_id"), F.lit(2).alias("priority"), "name",
    )
    order = F.row_number().over(Window.orderBy("priority", "ord", "kind", "sub"))
    return made.unionByName(own).select(order.alias("task"), "query", "query_id", "priority", F.col("name").alias("target_law_name"))


def on_allowed_path(url: str, allowed: dict[str, list[str]]) -> Column:
    """The path begins as its domain's list allows; an empty table allows all, a domain that isn't in it nothing."""
    if not allowed:
        return F.lit(True)
    hit = F.lit(False)
    for domain, prefixes in allowed.items():
        starts = F.lit(False)
        for prefix in prefixes:
            starts = starts | F.startswith(t.path(url), F.lit(prefix))
        hit = hit | ((t.domain(url) == domain) & starts)
    return hit


def on_denied_path(url: str, denied: list[str]) -> Column:
    """One of the strings is anywhere in the URL."""
    hit = F.lit(False)
    for part in denied:
        hit = hit | F.contains(t.text(url), F.lit(part))
    return hit


def names_law(title: str, snippet: str, names: list[str]) -> Column:
    """Title or snippet has one of the names, without regard to case and accents; no names: true."""
    if not names:
        return F.lit(True)

    def any_name(folded: Column) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | F.contains(folded, F.lit(t.fold_text(name)))
        return hit

    return t.let(t.fold(F.concat_ws(" ", t.text(title), t.text(snippet))), any_name)


def found_links(hits: DataFrame, allowed: dict[str, list[str]], denied: list[str], names: list[str], source_order: list[str], this_year: int) -> DataFrame:
    """Search hits (``link``, ``title``, ``snippet``, ``ord``) that pass all filters, with what their text says, by rank of their source."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, source_order)), t.domain("link")), F.lit(0)) - 1, F.lit(len(source_order)))
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    kept = hits.filter(t.text("link") != "").filter(on_allowed_path("link", allowed)).filter(~on_denied_path("link", denied)).filter(names_law("title", "snippet", names))
    return kept.select(
        F.col("link").alias("url"), F.coalesce(t.present("title"), F.lit("No Title")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), t.domain("link").alias("source_domain"),
        t.law_id(both).alias("law_id"), t.effective_date(both, this_year).alias("effective_date"), rank.cast("int").alias("source_rank"), "ord",
    )


def best_of_batch(links: DataFrame) -> DataFrame:
    """One link for each canonical URL: that of the longest snippet, the first of such (``ord``).

    The minimum is taken before the shuffle, so a URL that is found everywhere costs one row for each task.
    """
    best = F.min_by(F.struct(*links.columns), F.struct(-F.length(t.text("snippet")), F.col("ord")))
    return links.groupBy(t.canonical_url("url").alias("dedup_key")).agg(best.alias("_b")).select("dedup_key", "_b.*")


def fresh(history: DataFrame, now: Column, days: int) -> DataFrame:
    """Keys of links found in the last ``days`` days; a time that can't be read counts as long ago."""
    seen = F.try_to_timestamp(F.col("discovered_at"))
    return history.filter(seen >= now - F.make_interval(days=F.lit(days))).select(t.canonical_url("url").alias("dedup_key")).distinct()


def unseen(links: DataFrame, history: DataFrame, now: Column, days: int) -> DataFrame:
    """Links of a batch (with ``dedup_key``) that recent history hasn't."""
    return links.join(fresh(history, now, days), "dedup_key", "left_anti")


def diagnostics(history: DataFrame, now: Column, days: int) -> DataFrame:
    """One row: links in all, recent, stale, and without a readable time."""
    seen = F.try_to_timestamp(F.col("discovered_at"))
    recent = F.coalesce(seen >= now - F.make_interval(days=F.lit(days)), F.lit(False))
    return history.agg(F.count(F.lit(1)).alias("links"), F.count_if(recent).alias("recent"), F.count_if(seen.isNotNull() & ~recent).alias("stale"), F.count_if(seen.isNull()).alias("unreadable"))


def append_new(links: DataFrame, path: str) -> bool:
    """Append links as JSON lines; nothing is created where there are none.  True if something was written."""
    if links.isEmpty():
        return False
    links.write.mode("append").json(path)
    return True


def mark_processed(queue: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The queue with ``is_processed`` and ``processed_at`` set for links in ``done`` (``url``) that weren't processed, and ``updated`` where that happened."""
    keys = done.select("url").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)) & ~F.coalesce("is_processed", F.lit(False))
    joined = queue.join(keys, "url", "left")
    return joined.withColumns({"updated": hit, "processed_at": F.when(hit, now).otherwise(F.col("processed_at")), "is_processed": F.coalesce("is_processed", F.lit(False)) | hit}).drop("_hit")


def updated_rows(marked: DataFrame) -> DataFrame:
    """One row: links in all, and how many ``mark_processed`` changed."""
    return marked.agg(F.count(F.lit(1)).alias("links"), F.count_if("updated").alias("updated"))


def in_source_order(found: DataFrame) -> DataFrame:
    """``found_links`` in the order of their source's rank, as found within a source."""
    return found.orderBy("source_rank", "ord")


def first_of_tasks(results: DataFrame) -> DataFrame:
    """One link for each canonical URL over the results of many tasks (``task``, ``priority``, ``ord``): of the longest snippet in the first task that found it.

    Tasks end in any order; their place in the plan decides.
    """
    best = F.min_by(F.struct(*results.columns), F.struct("priority", "task", -F.length(t.text("snippet")), "ord"))
    return results.groupBy(t.canonical_url("url").alias("dedup_key")).agg(best.alias("_b")).select("dedup_key", "_b.*")


def totals(raw: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: results found, and links that were new."""
    both = raw.select(F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(saved.select(F.lit(0).alias("r"), F.lit(1).alias("s")))
    return both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("raw"), F.coalesce(F.sum("s"), F.lit(0)).alias("saved"))


def content_hash(*fields: str) -> Column:
    """Digest of some fields, stripped and in lower case; nulls are left out."""
    return F.md5(F.concat_ws(" ", *(F.when(F.col(f).isNotNull(), F.lower(t.strip(F.col(f).cast("string")))) for f in fields)))


def aliased_rank(domain: t.Text, order: list[str], aliases: dict[str, str]) -> Column:
    """Place of a domain in a list of sources that may go by an alias; the list's length if it isn't there."""
    at = F.array_position(F.array(*(F.lit(aliases.get(x, x)) for x in order)), t.text(domain))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")
