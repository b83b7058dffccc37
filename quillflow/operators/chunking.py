"""Structure-aware chunking of legal texts.

A document is one row.  Its articles are an array, so segmenting, carrying
headings forward, merging short articles and packing long ones are expressions
within the row: no shuffle, whatever the number of documents, and no group that
grows with the corpus.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Headings at the start of a line, and the wrapper of an overlap.
ARTICLE = r"(?mUd)^(Điều\s+\d+[\.:]\s*.*)"
CHAPTER = r"(?mUd)^(Chương\s+[IVXLCDM\d]+[\.:]*\s*.*)"
SECTION = r"(?mUd)^(Mục\s+\d+[\.:]*\s*.*)"
CLAUSE = r"(?mUd)^(\s*\d+\.\s+)"
OVERLAP_BEGIN, OVERLAP_END = "[...overlap...]\n", "\n[...end overlap...]\n\n"
WHOLE_TEXT = "(Toàn văn)"

_MARK = "\x01"


def record(**fields: Column) -> Column:
    """A struct whose field names hold inside lambdas too."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


class Sizes(NamedTuple):
    """Target sizes of chunks, in estimated tokens."""

    low: int = 800
    high: int = 1200
    overlap: int = 100
    chars_per_token: float = 3.5

    def chars(self, n: int) -> int:
        return int(n * self.chars_per_token)


def pieces(c: Column, pattern: str) -> Column:
    """A text cut before each match of a pattern; what is before the first match is element 0."""
    return F.split(F.regexp_replace(F.replace(c, F.lit(_MARK), F.lit("")), pattern, _MARK + "$1"), _MARK)


def _last_heading(c: Column, pattern: str) -> Column:
    """Last heading in a text; null if it has none.  Most texts don't have its first word and need no pattern."""
    word = re.search(r"\w+", pattern.split("(", 2)[2]).group()
    return F.when(F.contains(c, F.lit(word)), F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1)))


def carried(texts: Column, pattern: str) -> Column:
    """For each of an array of texts, the last heading in it or in those before; empty where there is none yet.

    Each heading is repeated for as many texts as it holds.
    """
    found = F.transform(texts, lambda x, i: record(i=i, h=F.nullif(t.strip(_last_heading(x, pattern)), F.lit(""))))

    def held(own: Column) -> Column:
        starts = F.concat(F.transform(own, lambda x: x["i"]), F.array(F.size(texts)))
        until = F.slice(starts, F.lit(2), F.size(own))
        runs = F.zip_with(own, until, lambda x, end: F.array_repeat(x["h"], end - x["i"]))
        return F.flatten(F.concat(F.array(F.array_repeat(F.lit(""), F.get(starts, F.lit(0)))), runs))

    return t.let(F.filter(found, lambda x: x["h"].isNotNull()), held)


def articles(docs: DataFrame, text: str = "text", out: str = "articles") -> DataFrame:
    """``docs`` and an array of its articles: ``ord``, ``number``, ``title``, ``text``, ``chapter``, ``section``, ``chars``.

    An article lasts until the next one begins; text before the first is left
    out.  One whose heading has no number gets that of its place.  A chapter or section holds until the next of its kind, and a section
    isn't ended by a chapter.  A text without articles is one of number 0.
    """
    cut = docs.withColumn("_pieces", pieces(t.text(text), ARTICLE))
    body = F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0)))
    # A heading without words of its own goes on over the next line, which may be the article's.
    following = F.slice("_pieces", F.lit(2), F.size("_pieces"))
    reach = F.zip_with("_pieces", following, lambda p, after: F.concat(p, F.coalesce(F.regexp_extract(after, r"^[^\n]*", 0), F.lit(""))))
    # Headings inside piece i come before article i + 1.
    held = F.zip_with(carried(reach, CHAPTER), carried(reach, SECTION), lambda c, s: record(chapter=c, section=s))
    held = F.slice(held, F.lit(1), F.greatest(F.size("_pieces") - 1, F.lit(0)))
    heading = lambda x: F.regexp_extract(x, ARTICLE, 1)

    def article(piece: Column, above: Column) -> Column:
        def of(x: Column) -> Column:
            number, title = F.regexp_extract(x["head"], r"(?U)Điều\s+(\d+)", 1).cast("int"), t.strip(F.regexp_extract(x["head"], r"(?U)Điều\s+\d+[\.:]\s*(.*)", 1))
            return record(number=number, title=title, text=x["own"], chapter=above["chapter"], section=above["section"], chars=F.length(x["own"]))

        return t.let(record(head=t.strip(heading(piece)), own=t.strip(piece)), of)

    # Arrays meet by zip_with: a lambda that refers to another array would compute it anew for each element.
    numbered = F.transform(F.zip_with(body, held, article), lambda x, i: record(ord=i, number=F.coalesce(x["number"], i + 1), **{k: x[k] for k in ("title", "text", "chapter", "section", "chars")}))
    whole = F.array(record(ord=F.lit(0), number=F.lit(0), title=F.lit(WHOLE_TEXT), text=t.text(text), chapter=F.lit(""), section=F.lit(""), chars=F.length(t.text(text))))
    return cut.withColumn(out, F.when(F.size("_pieces") > 1, numbered).otherwise(whole)).drop("_pieces")


def merge_short(sizes: Column, low: int) -> Column:
    """Group number, from 0, of each of an array of sizes.

    One of ``low`` or more ends the open group and stands alone; smaller ones
    gather until their sum is ``low``.  What is left over at the end joins the
    last group, if there is one.
    """
    state = {"next": F.lit(0), "open": F.lit(False), "sum": F.lit(0)}

    def step(acc: Column, size: Column) -> tuple[dict[str, Column], Column]:
        long = size >= low
        group = F.when(long & acc["open"], acc["next"] + 1).otherwise(acc["next"])
        closes = long | (acc["sum"] + size >= low)
        return {"next": F.when(closes, group + 1).otherwise(group), "open": ~closes, "sum": F.when(closes, 0).otherwise(acc["sum"] + size)}, group

    def finish(acc: Column, groups: Column) -> Column:
        return F.when(acc["open"] & (acc["next"] > 0), F.transform(groups, lambda g: F.least(g, acc["next"] - 1))).otherwise(groups)

    return t.collected(sizes, state, step, "int", finish)


def pack(sizes: Column, header: Column, high: int) -> Column:
    """Part number, from 0, of each of an array of sizes: a part starts with ``header`` and is closed before it exceeds ``high``."""
    def step(acc: Column, size: Column) -> tuple[dict[str, Column], Column]:
        full = (acc["sum"] + size > high) & (acc["count"] > 0)
        part = F.when(full, acc["no"] + 1).otherwise(acc["no"])
        return {"no": part, "count": F.when(full, 1).otherwise(acc["count"] + 1), "sum": F.when(full, header + size).otherwise(acc["sum"] + size)}, part

    return t.collected(sizes, {"no": F.lit(0), "count": F.lit(0), "sum": header}, step, "int")


def clause_parts(c: Column, high: int) -> Column:
    """A long article as an array of texts: its clauses packed, each part under the article's heading.  With one clause or none it stays whole."""
    cut = pieces(c, CLAUSE)
    header = t.strip(F.get(cut, F.lit(0)))
    clauses = F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), t.strip)

    def texts(own: Column) -> Column:
        part = pack(F.transform(own, F.length), F.length(header), high)
        starts = t.let(part, lambda ps: F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: (i == 0) | (F.get(ps, i) != F.get(ps, i - 1))))
        until = lambda xs: F.concat(F.slice(xs, F.lit(2), F.size(xs)), F.array(F.size(own)))
        one = lambda lo, hi: t.strip(F.concat_ws("\n", header, F.array_join(F.slice(own, lo + 1, hi - lo), "\n")))
        return t.let(starts, lambda xs: F.zip_with(xs, until(xs), one))

    return F.when(F.size(cut) <= 2, F.array(c)).otherwise(t.let(clauses, texts))


def raw_chunks(docs: DataFrame, keys: list[str], sizes: Sizes = Sizes(), text: str = "text", by: list[str] | None = None) -> DataFrame:
    """One row for each chunk before overlaps: ``keys``, ``position`` (from 0), ``text``, ``articles`` (numbers), ``chapter``, ``section``, ``title``, ``part``.

    ``keys`` tell the documents apart.  Articles become rows, of which a group
    holds a few; one shuffle by ``keys`` serves the groups and their order.
    ``by`` are those of the keys to shuffle by: a constant among them, or one
    that a later window leaves out, would make Spark shuffle again.
    """
    low, high = sizes.chars(sizes.low), sizes.chars(sizes.high)
    read = articles(docs, text).select(*keys, "articles")
    grouped = read.withColumn("_group", merge_short(F.transform("articles", lambda a: a["chars"]), low))
    # Outer, as there is always an article: for others Spark would infer a filter that computes them all once more.
    rows = grouped.select(*keys, F.inline_outer(F.zip_with("articles", "_group", lambda a, g: record(_g=g, a=a))))
    each = rows.repartition(*(by or keys)).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list("a")).alias("_own"))
    joined = F.array_join(F.transform("_own", lambda a: a["text"]), "\n\n")
    first = F.get("_own", F.lit(0))
    kind = "text string, articles array<int>, chapter string, section string, title string, part int"
    together = F.array(record(text=joined, articles=F.transform("_own", lambda a: a["number"]), chapter=first["chapter"], section=first["section"], title=F.when(F.size("_own") == 1, first["title"]).otherwise(""), part=F.lit(0)))

    shape = f"array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in kind.split(', '))}>>"

    def parts_of(a: Column) -> Column:
        # The number of parts is known once they are there: a lone part loses its number after the fact.
        made = F.transform(clause_parts(a["text"], high), lambda x, j: record(text=x, articles=F.array(a["number"]), chapter=a["chapter"], section=a["section"], title=a["title"], part=j + 1))
        alone = lambda xs: F.transform(xs, lambda x: record(text=x["text"], articles=x["articles"], chapter=x["chapter"], section=x["section"], title=x["title"], part=F.lit(0)))
        return F.aggregate(F.array(made), F.expr(f"cast(array() as {shape})"), lambda _, xs: F.when(F.size(xs) > 1, xs.cast(shape)).otherwise(alone(xs).cast(shape)))

    chunks = F.when(F.length(joined) > high, F.flatten(F.transform("_own", parts_of)).cast(shape)).otherwise(together.cast(shape))
    # Groups of a document are in order in their row; the position within the document follows from the group and the place in it.
    made = each.select(*keys, "_g", F.posexplode_outer(chunks).alias("_i", "c"))
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy(*keys).orderBy("_g", "_i")) - 1
    return made.select(*keys, position.alias("position"), "c.*")


def sentence_suffix(c: Column, budget: int, most: int | None = None) -> Column:
    """Sentences from the end of a text that fit a budget of characters, at least one; a text within it as it is.

    A sentence ends at ``.``, ``!`` or ``?`` before white space.  Without any
    sentence, the last characters.  With ``most``, no more sentences than that,
    whether others would fit or not.
    """
    sentences = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), t.strip), lambda x: x != "")
    start = record(sum=F.lit(0), full=F.lit(False), out=F.expr("cast(array() as array<string>)"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["full"] | ((acc["sum"] + F.length(s) > budget) & (F.size(acc["out"]) > 0))
        return record(sum=F.when(full, acc["sum"]).otherwise(acc["sum"] + F.length(s)), full=full, out=F.when(full, acc["out"]).otherwise(F.array_prepend(acc["out"], s)))

    ends = F.reverse(sentences) if most is None else F.slice(F.reverse(sentences), 1, most)
    suffix = F.aggregate(ends, start, step, lambda acc: F.when(F.size(acc["out"]) > 0, F.array_join(acc["out"], " ")).otherwise(F.right(c, F.lit(budget))))
    return F.when(F.length(c) <= budget, c).otherwise(suffix) if most is None else suffix


def chunks(docs: DataFrame, keys: list[str], name: str, sizes: Sizes = Sizes(), text: str = "text", sentences: int | None = None) -> DataFrame:
    """Chunks with overlap, id and metadata: ``keys``, ``position``, ``document_name``, ``chunk_id``, ``text``, ``metadata``.

    With ``sentences``, an overlap has no more of them than that.
    """
    from pyspark.sql import Window

    own = raw_chunks(docs, [*keys, name] if name not in keys else keys, sizes, text, keys)
    before = F.lag("text").over(Window.partitionBy(*keys).orderBy("position"))
    overlap = sentence_suffix(before, sizes.chars(sizes.overlap), sentences)
    has = F.coalesce(overlap != "", F.lit(False))
    own = own.withColumn("has_overlap", has).withColumn("text", F.when(has, F.concat(F.lit(OVERLAP_BEGIN), overlap, F.lit(OVERLAP_END), F.col("text"))).otherwise(F.col("text")))
    first, last = F.coalesce(F.get("articles", F.lit(0)), F.lit(0)), F.coalesce(F.get(F.reverse("articles"), F.lit(0)), F.lit(0))
    chunk = t.chunk_id(t.document_prefix(name), first, last, F.size("articles"), F.col("part"), F.col("position") + 1)
    metadata = record(law_id=F.col(keys[0]), article_number=first, article_title=F.col("title"), chapter=F.col("chapter"), section=F.col("section"), estimated_tokens=t.tokens("text", sizes.chars_per_token), has_overlap=F.col("has_overlap"))
    return own.select(*keys, "position", F.col(name).alias("document_name"), chunk.alias("chunk_id"), "text", metadata.alias("metadata"))


POINT = r"(?mUd)^\s*([a-zđ])\)\s+"


def headings(docs: DataFrame, keys: list[str], text: str = "text", chars: int = 2000) -> DataFrame:
    """Debug listing: every heading of each ``kind`` in the first ``chars`` characters, with its ``place`` there (from 0)."""
    own = docs.select(*keys, F.left(t.text(text), F.lit(chars)).alias("_t"))
    kinds = {"article": ARTICLE, "chapter": CHAPTER, "section": SECTION, "clause": CLAUSE, "point": POINT}

    def listed(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
        # Each match begins where the text between it and the one before ends.
        between = F.split("_t", pattern)
        start = record(at=F.lit(0), out=F.expr("cast(array() as array<struct<kind:string,place:int,heading:string>>)"))

        def step(acc: Column, x: Column) -> Column:
            place = acc["at"] + F.length(x["b"])
            return record(at=place + F.length(x["m"]), out=F.array_append(acc["out"], record(kind=F.lit(kind), place=place, heading=t.strip(x["m"]))))

        pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: record(m=m, b=b))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return own.select(*keys, F.inline_outer(F.concat(*(listed(k, p) for k, p in kinds.items())))).filter("kind is not null")


def document_log(chunked: DataFrame, keys: list[str], tokens: str, overlap: str, sizes: Sizes = Sizes()) -> DataFrame:
    """What a run says of each document: chunks, least and most tokens, their floored mean and the floored percentage in range, and chunks with an overlap."""
    n, total = F.count(F.lit(1)), F.sum(tokens)
    inside = F.count_if(F.col(tokens).between(sizes.low, sizes.high))
    return chunked.groupBy(*keys).agg(
        n.alias("chunks"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.floor(total / n).alias("avg_tokens"), F.floor(100 * inside / n).alias("pct_in_range"), F.count_if(overlap).alias("overlaps")
    )


def statistics(chunked: DataFrame, by: str, tokens: str, overlap: str, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks and tokens for each value of ``by``, and in all (``by`` null), in one pass."""
    n, total = F.count(F.lit(1)), F.sum(tokens)
    return chunked.rollup(by).agg(
        n.alias("chunks"), total.alias("total_tokens"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.floor(total / n).alias("avg_tokens"),
        F.round(100.0 * F.count_if(F.col(tokens).between(sizes.low, sizes.high)) / n, 1).alias("pct_in_range"), F.count_if(F.col(overlap)).alias("chunks_with_overlap"),
        F.count_distinct(by).alias("laws"),
    )
