"""From links to accepted content: grouping, priorities, fallback, cleaning, validation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Folded phrases of a page's furniture.
ARTIFACTS = [
    "trang chu", "quay lai", "in trang", "chia se", "facebook", "twitter", "zalo", "email", "dang nhap", "dang ky", "quang cao", "lien he", "menu", "luoc do",
    "thuoc tinh", "hoi dap", "tin tuc",
]
STRUCTURE = ["dieu 1", "khoan 1", "chuong i"]


def has_any(folded: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(folded, F.lit(phrase))
    return hit


def is_artifact(folded: Column, phrases: list[str]) -> Column:
    """A folded line is furniture: hardly a word, one of the phrases, or a short download link."""
    return (F.length(folded) < 3) | has_any(folded, phrases) | (F.startswith(folded, F.lit("tai ve")) & (F.length(folded) < 120))


def clean_lines(text: t.Text, blacklist: list[str] = ()) -> Column:
    """Text without furniture and repeated lines.

    Lines are stripped and their blanks made one; artifacts go, as does a line
    equal to the last line kept, blank ones between or not.  Of blank lines in a
    row one stays, none at either end.  All within the row.
    """
    phrases = list(dict.fromkeys([*ARTIFACTS, *map(t.fold_text, blacklist)]))
    normal = F.replace(F.regexp_replace(t.text(text), r"\r\n?", "\n"), F.lit("\xa0"), F.lit(" "))

    def cut(whole: Column) -> Column:
        # Folding changes no line end, so the whole text is folded once and both are cut alike.
        lines, folded = F.transform(F.split(whole, "\n"), t.line), F.transform(F.split(t.fold(whole), "\n"), t.line)
        kept = F.filter(F.zip_with(lines, folded, lambda x, f: F.named_struct(F.lit("x"), x, F.lit("f"), f)), lambda p: (p["x"] == "") | ~is_artifact(p["f"], phrases))
        return F.transform(kept, lambda p, i: F.named_struct(F.lit("i"), i, F.lit("x"), p["x"]))

    def joined(placed: Column) -> Column:
        # A blank line doesn't come between two equal ones: lines with words are compared among themselves, then all are put in order.
        def unlike_before(some: Column) -> Column:
            before = F.concat(F.array(F.lit("")), F.transform(some, lambda p: p["x"]))
            pairs = F.zip_with(some, F.slice(before, F.lit(1), F.size(some)), lambda p, x: F.when(p["x"] != x, p))
            return F.filter(pairs, lambda p: p.isNotNull())

        with_words = t.let(F.filter(placed, lambda p: p["x"] != ""), unlike_before)
        every = F.array_sort(F.concat(with_words, F.filter(placed, lambda p: p["x"] == "")))
        return F.array_join(F.transform(every, lambda p: p["x"]), "\n")

    whole = t.let(t.let(normal, cut), joined)
    return t.strip(F.regexp_replace(F.regexp_replace(whole, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def is_valid(text: t.Text, min_length: int, required: list[str], blacklist: list[str]) -> Column:
    """Not empty, long enough, with one of the required phrases and none of the others, case and accents aside."""
    own = t.text(text)
    wanted, barred = ([t.fold_text(x) for x in xs] for xs in (required, blacklist))
    return (own != "") & (F.length(own) >= min_length) & t.let(t.fold(text), lambda folded: (has_any(folded, wanted) if wanted else F.lit(True)) & ~has_any(folded, barred))


def has_structure(text: t.Text) -> Column:
    return t.let(t.fold(text), lambda folded: has_any(folded, STRUCTURE))


def canonical_law(title: t.Text, laws: list[tuple[str, list[str]]]) -> Column:
    """First law, in the order of the configuration, whose name or alias the title has; null if none."""

    def first(folded: Column) -> Column:
        out = None
        for name, aliases in laws:
            hit = has_any(folded, [t.fold_text(x) for x in (name, *aliases)])
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out if out is not None else F.lit(None).cast("string")

    return t.let(t.fold(title), first)


def source_rank(domain: t.Text, order: list[str]) -> Column:
    """Place of a domain in a list; the list's length if it isn't there."""
    at = F.array_position(F.array(*map(F.lit, order)), t.text(domain))
    return F.when(at > 0, at - 1).otherwise(len(order))


def _regex(c: str, pattern: str) -> Column:
    return F.regexp_like(t.text(c), F.lit(f"(?iu){pattern}"))


def matches_rule(rule: dict) -> Column:
    """A link's number and title match the rule's patterns and not its exclusion; a rule without both patterns matches nothing."""
    if not rule.get("law_id_pattern") or not rule.get("title_pattern"):
        return F.lit(False)
    fine = _regex("law_id", rule["law_id_pattern"]) & _regex("title", rule["title_pattern"])
    if rule.get("exclude_pattern"):
        fine = fine & ~F.regexp_like(F.concat_ws(" ", t.text("law_id"), t.text("title")), F.lit(f"(?iu){rule['exclude_pattern']}"))
    return fine


def _order(rule: dict, sources: list[str]) -> Column:
    """Sort key of a rule's candidates: by date and source, either way round together, or by source and address."""
    rank = source_rank("source_domain", sources).cast("int")
    date = F.coalesce(t.date_key(rule["sort_by"]).try_cast("long"), F.lit(0)) if rule.get("sort_by") else F.lit(0).cast("long")
    way = 0 if not rule.get("sort_by") else -1 if rule.get("sort_order", "desc") == "desc" else 1
    return F.struct((way * date).alias("date"), (rank if way < 1 else -rank).alias("rank"), (t.text("url") if way == 0 else F.lit("")).alias("url"), F.col("ord").alias("ord"))


def rule_chains(links: DataFrame, rules: dict[str, list[dict]], sources: list[str]) -> DataFrame:
    """Winner of each rule of each law: ``links``' columns, ``type``, ``rule`` and ``place``, its place among its law's winners.

    ``links`` have ``law``, ``url``, ``title``, ``law_id``, ``source_domain``,
    ``effective_date`` and ``ord``.  A rule's candidates are sorted by date and
    source; the first that no earlier rule took wins, but among such of the
    winner's number the best source decides.

    Earlier rules take no more addresses than there are rules, so that many
    candidates of each rule, and of each number there, are enough to name all
    winners: they are cut before the shuffle, whatever the number of links, and
    the winners follow from a law's few.
    """
    columns = [c for c in links.columns if c not in ("type", "rule", "place")]
    most = max(map(len, rules.values()), default=0)
    if not most:
        return links.select(*columns).limit(0).withColumns({"type": F.lit("").cast("string"), "rule": F.lit(0), "place": F.lit(0)})

    def by_rule(value: Callable[[dict], Column]) -> Column:
        out = None
        for law, own in rules.items():
            for k, rule in enumerate(own):
                case = (F.col("law") == law) & (F.col("rule") == k)
                out = F.when(case, value(rule)) if out is None else out.when(case, value(rule))
        return out

    fits = [reduce(Column.__or__, [(F.col("law") == law) & matches_rule(own[k]) for law, own in rules.items() if len(own) > k]) for k in range(most)]
    matched = F.filter(F.array(*(F.when(fit, k) for k, fit in enumerate(fits))), lambda k: k.isNotNull())
    row = F.struct(*columns, by_rule(lambda rule: F.lit(rule["type"])).alias("type"), "rule")
    each = links.select(*columns).withColumn("rule", F.explode_outer(matched)).filter("rule is not null")
    each = each.select("law", "rule", "url", "law_id", row.alias("row"), by_rule(lambda rule: _order(rule, sources)).alias("order"), F.struct(source_rank("source_domain", sources).cast("int").alias("rank"), "url", "ord").alias("source"))

    def leading(of: list[str], order: str) -> DataFrame:
        one = each.groupBy("law", "rule", *of, "url").agg(F.min_by("row", order).alias("row"), F.min(order).alias("order"))
        place = F.row_number().over(Window.partitionBy("law", "rule", *of).orderBy("order"))
        return one.withColumn("place", place).filter(F.col("place") <= most).select("law", *of, "rule", F.struct("rule", *of, "place", "row").alias("c"))

    first, same = leading([], "order"), leading(["law_id"], "source")
    numbers = first.select("law", "rule", F.col("c.row.law_id").alias("law_id")).filter(t.text("law_id") != "").distinct()
    same = same.join(numbers, ["law", "rule", "law_id"], "left_semi")
    both = first.groupBy("law").agg(F.array_sort(F.collect_list("c")).alias("first")).join(same.groupBy("law").agg(F.array_sort(F.collect_list("c")).alias("same")), "law", "left")

    def free(c: Column, k: int) -> Column:
        return reduce(Column.__and__, [~F.coalesce(F.col(f"w{j}.url") == c["row"]["url"], F.lit(False)) for j in range(k)], c["rule"] == k)

    def first_free(candidates: str, k: int, of: Callable[[Column], Column] = lambda c: F.lit(True)) -> Column:
        return F.get(F.filter(candidates, lambda c: free(c, k) & of(c)), F.lit(0))["row"]

    for k in range(most):
        both = both.withColumn("f", first_free("first", k))
        both = both.withColumn("b", first_free("same", k, lambda c: c["law_id"] == F.col("f.law_id")))
        both = both.withColumn(f"w{k}", F.coalesce("b", "f"))
    won = F.filter(F.array(*(f"w{k}" for k in range(most))), lambda w: w.isNotNull())
    return both.select(F.posexplode_outer(won).alias("place", "w")).filter("w is not null").select("w.*", "place")


def heuristic_chain(links: DataFrame, sources: list[str]) -> DataFrame:
    """Links of each ``law``, best first (``place``): consolidated ones, then by date, then by source; and the ``type`` of each."""
    consolidated = F.contains(F.upper(t.text("law_id")), F.lit("VBHN"))
    order = [F.desc(consolidated), F.desc(t.date_key("effective_date", "1900-01-01")), F.asc(source_rank("source_domain", sources)), F.asc("ord")]
    kind = F.when(consolidated, "VBHN").when(F.contains(F.lower(t.text("title")), F.lit("sửa đổi")), "AMENDMENT").otherwise("ORIGINAL")
    return links.withColumns({"type": kind, "place": F.row_number().over(Window.partitionBy("law").orderBy(*order)) - 1})


def first_success(attempts: DataFrame) -> DataFrame:
    """Outcome of each ``law`` from attempts (``place``, ``url``, ``success``, ``error``): the first that succeeded, or a failure with the first address.

    Minima are taken before the shuffle.
    """
    tried = F.struct("place", "url")
    best, first = F.min(F.when(F.col("success"), tried)), F.min(tried)
    failed = F.concat(F.lit("All "), F.col("attempts").cast("string"), F.lit(" URLs failed"))
    return attempts.groupBy("law").agg(best.alias("_b"), first.alias("_f"), F.count(F.lit(1)).alias("attempts")).select(
        "law", F.col("_b").isNotNull().alias("success"), F.coalesce("_b.url", "_f.url").alias("url"), F.coalesce("_b.place", F.lit(0)).alias("fallback_level"), "attempts",
        F.when(F.col("_b").isNull(), failed).alias("error"),
    )


def grouped_links(links: DataFrame, fields: list[str]) -> DataFrame:
    """``law`` and ``urls``: its links with some of their fields, as found.  A law's links are a bounded list; an unbounded one stays rows."""
    own = F.array_sort(F.collect_list(F.struct("ord", *fields)))
    return links.groupBy("law").agg(F.transform(own, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("urls"))


def summary(outcome: DataFrame) -> DataFrame:
    """One row: laws that succeeded, that failed, and all."""
    return outcome.agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("fail_count"), F.count(F.lit(1)).alias("group_count"))


def scraped(pages: DataFrame, min_length: int, required: list[str], blacklist: list[str]) -> DataFrame:
    """``pages`` (``html``, ``clean_text``, ``title``, ``law_id``) as scraped content: counts, structure, and the first thing that is wrong."""
    error = (
        F.when(F.col("html").isNull(), "fetch failed").when(t.text("clean_text") == "", "no content")
        .when(~is_valid("clean_text", min_length, required, blacklist), "validation failed")
    )
    return pages.withColumns({
        "raw_html": F.left("html", F.lit(5000)), "title": F.coalesce(t.present("title"), F.lit("Unknown")), "law_id": F.coalesce(t.present("law_id"), F.lit("unknown")),
        "char_count": F.length(t.text("clean_text")), "word_count": t.words("clean_text"), "has_structure": has_structure("clean_text"), "error": error, "success": error.isNull(),
    })
