"""Benchmark decontamination by a prefix-filtered set join, in built-in functions only.

An item's windows are its runs of ``WINDOW`` words (of an item with fewer, all
its words).  A document is hit where a window occurs in it.

The shingles of a window are its pairs of adjacent words (its word, if it has
one).  To contain a window a document must contain all its shingles, so one
necessary shingle is enough of a prefix: the rarest by its count over all
documents.  Documents' shingles are joined with those prefixes alone.  What
joins must then pass, in this order, the positional bound (the window can't
begin before the text), the length bound (nor end after it) and a comparison of
the words themselves, so hashes decide nothing.

The windows are broadcast if counts prove that they are few and that their words
and items are small (``BROADCAST_WINDOWS``, ``BROADCAST_BYTES``); otherwise the same join is shuffled, with the words
around each shingle in place of the whole text, after places whose shingle is no
prefix went by a broadcast of the prefixes' keys alone, if a count proves that
those fit (``BROADCAST_KEYS``).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import carried, row_key, staged

WINDOW = 8
BROADCAST_WINDOWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Of 8 bytes each.
BROADCAST_KEYS = 4_000_000
MIN_ITEMS = 2

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z; null: none."""
    lowered = F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``words``, ``size`` and ``items`` (ids that have it) of every different window."""
    read = items.filter(F.col("item_id").isNotNull()).select("item_id", words_of("text").alias("all")).filter(F.size("all") > 0)
    n = F.size("all")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    each = read.select("item_id", "all", F.explode(starts).alias("start"))
    return each.select("item_id", F.slice("all", F.col("start"), window).alias("words")).groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("size", F.size("words"))


def _shingle(word: Column, following: Column) -> Column:
    """Key of a pair, or of a word that nothing follows."""
    return F.xxhash64(word, following)


def window_shingles(found: DataFrame, window: int) -> DataFrame:
    """Every shingle of every window: its ``shingle`` key and its ``offset``."""
    at = F.sequence(F.lit(0), F.greatest(F.col("size") - 2, F.lit(0)))
    each = found.select("*", F.explode(at).alias("offset"))
    return each.withColumn("shingle", _shingle(F.get("words", F.col("offset")), F.get("words", F.col("offset") + 1)))


def text_shingles(texts: DataFrame, singles: bool) -> DataFrame:
    """Every shingle of every text.  A last one of no word stands for the text itself."""
    each = texts.select("*", F.posexplode(F.concat("text_words", F.array(F.lit("")))).alias("pos", "word"))
    pair = _shingle(F.col("word"), F.get("text_words", F.col("pos") + 1))
    if not singles:
        return each.withColumn("shingle", pair)
    # A last word's pair has the key of the word alone, and so has the word of no text.
    both = F.when((F.col("word") == "") | (F.col("pos") + 1 >= F.size("text_words")), F.array(pair)).otherwise(F.array(pair, F.xxhash64("word")))
    return each.withColumn("shingle", F.explode(both))


def rarest(found: DataFrame, texts: DataFrame, singles: bool, broadcast: bool, window: int) -> DataFrame:
    """Windows with the ``shingle`` that the fewest documents' places have, and its ``offset``."""
    shingles = window_shingles(found, window)
    keys = shingles.select("shingle").distinct()
    counts = text_shingles(texts, singles).select("shingle").join(F.broadcast(keys) if broadcast else keys, "shingle").groupBy("shingle").count()
    ranked = shingles.join(staged(counts, "shingle-counts"), "shingle", "left")
    order = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "shingle")
    return ranked.groupBy("words").agg(F.min(order).alias("prefix"), F.first("items").alias("items"), F.first("size").alias("size")).select("words", "items", "size", "prefix.offset", "prefix.shingle")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each different row of ``docs``: its key, ``doc_id``, ``n_words``, ``copies`` (how often it stands), ``hits`` (start and size of the windows in it) and ``items``."""
    found = staged(windows(items, window), "windows")
    size = F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words") + F.octet_length(F.array_join(F.col("items").cast("array<string>"), " ")) + 16 * F.size("items"))
    n, total = found.agg(F.count(F.lit(1)), size).first()
    few = n <= broadcast_windows and (total or 0) <= BROADCAST_BYTES
    singles = not found.filter("size = 1").isEmpty()
    texts = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("text_words"))
    prefixes = staged(rarest(found, texts, singles, few, window), "prefixes")
    begin = F.col("pos") - F.col("offset")
    each = text_shingles(texts, singles).withColumn("n", F.size("text_words"))
    base = ["key_id", "key_text", "doc_id", "n"]
    fits = (begin >= 0) & (begin + F.col("size") <= F.col("n"))
    if few:
        end = found.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("shingle"))
        table = prefixes.unionByName(end, allowMissingColumns=True)
        same = F.slice("text_words", F.greatest(begin, F.lit(0)) + 1, F.greatest("size", F.lit(1))) == F.col("words")
        joined = each.join(F.broadcast(table), "shingle").filter(F.col("words").isNull() & (F.col("word") == "") | F.col("words").isNotNull() & fits & same)
        rows = joined.select(*base, "size", "items", begin.alias("start"))
    else:
        low = F.greatest(F.col("pos") - window, F.lit(0))
        keys = staged(prefixes.select("shingle").distinct(), "prefix-keys")
        held = each.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "shingle", "left_semi")
        near = held.filter("word <> ''").select(*base, "pos", "shingle", low.alias("low"), F.slice("text_words", low + 1, 2 * window + 1).alias("near"))
        same = F.slice("near", F.greatest(begin - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("words")
        joined = near.join(prefixes, "shingle").filter(fits & same).select(*base, "size", "items", begin.alias("start"))
        own = texts.select("key_id", "key_text", "doc_id", F.size("text_words").alias("n"))
        rows = joined.unionByName(own, allowMissingColumns=True)
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "size"))
    return rows.groupBy(*base).agg(
        F.sum(F.when(F.col("start").isNull(), 1).otherwise(0)).alias("copies"),
        F.collect_set(hit).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    ).withColumnRenamed("n", "n_words")


def _n_hit(hits: Column) -> Column:
    """Words inside any hit: the length of the union of the intervals."""
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["start"]))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(hits), none, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``contaminated``, and the row's key, of every row.

    Null and empty texts have no words and no hit; items without an id or
    without words have no window, and ids that repeat count once.  Rows of
    ``docs`` that repeat come out as often as they stand.  Only ``doc_id``,
    ``text`` and ``item_id`` are read.  Empty tables are fine on either side.
    """
    found = occurrences(docs, items, window, broadcast_windows)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    every = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return every.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), _n_hit(F.col("hits")).cast("long").alias("n_hit"), names.alias("items"), (F.size("items") >= min_items).alias("contaminated"), "key_id", "key_text"
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` without the rows that are contaminated.

    Null and empty texts are clean, so their rows stay; rows that repeat stay or
    go together.  Columns that clash with an operator's own are carried along
    untouched.  Without items nothing goes; an empty table stays empty.
    """
    bad = staged(contamination(docs, items, window, min_items).filter("contaminated").select("key_id", "key_text").distinct(), "contaminated")
    return carried(docs).drop("text").join(bad, ["key_id", "key_text"], "left_anti").select("row.*")


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contamination`` in numbers and a digest of the items; one row for each row of ``docs``, whatever its text."""
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: The same rows in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, size, w[s : s + size - 1] AS win
  FROM (SELECT item_id, w, least(len(w), 8) AS size, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM win
), dw AS (
  SELECT rid, size, s, w[s : s + size - 1] AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT DISTINCT dw.rid, dw.s, dw.size, win.item_id FROM dw JOIN win ON dw.size = win.size AND dw.win = win.win
), n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT rid, s, size FROM hit)) GROUP BY rid
), m AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(m.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
