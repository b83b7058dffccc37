"""Substring dedup by a log-structured index of window fingerprints.

A window is ``WINDOW`` = 35 consecutive words of one document.  A word is
removed if a window that covers it has the same words as a window that starts
anywhere else.

*Fingerprints.*  Each window has an anchor: of the ``WINDOW - ANCHOR + 1``
runs of ``ANCHOR`` words in it, that of the least hash (the leftmost of equal
ones).  Equal windows have equal anchors at equal places, and successive windows
mostly share one.  So the index holds an entry for each anchor that was chosen,
not for each window: ``anchor`` (hash of its words), ``span`` (hash of all words
that the windows which chose it cover, and of where the anchor lies in them),
``n`` copies, and one place where it stands.

*Runs.*  The index is a set of immutable runs (``Index``): Parquet tables that
are bucketed by anchor and sorted by anchor and span, one row for each span.  A
manifest lists them, so an index can be opened again.  ``add`` takes a batch:

1. the batch becomes a run of its own;
2. its anchors are merge-joined with every run of the history, whose rows stay
   where they are, and rows with an anchor that stands more than once, in the
   batch or there, are the candidates;
3. candidates are verified, which gives the spans, of the batch and of the
   history, that now have repeated windows (``marks``);
4. runs of a like size are compacted into one, so there are few.

The entries of all documents are then joined with the marks, so a document of an
earlier batch loses what a later one repeats.

*Verification.*  A span with two copies or more has only repeated windows.  An
anchor with two different spans may have some: their windows are hashed one by
one from the texts, from one place for each span, and the hashes counted, with
a second, independent hash at their side (128 bits in all).  A bit mask over the
windows of a span then says which ones repeat.

The hash of a window never stands for a shortened text.  Copies of a span (a
passage in a third of all documents) are counted before the shuffle; an anchor
with many different spans (a phrase in many contexts) is salted over several
buckets of a run; no group of equal keys is gathered in one place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLANKS, Block, Sequence, byte_hash, mix, ragged, row_of, text_blocks
from .tables import carried, dropped, shared_dir, shuffle_width, staged

WINDOW = 35
ANCHOR = 12
BATCHES = 3
FAN_IN = 2
#: Rows of a bucket of a run, about; rows from which on an anchor is salted over several.
BUCKET_ROWS = 1 << 20
HOT_ROWS = 50_000
#: Parts of an anchor's candidates.
SALTS = 16
#: Hot anchors that are broadcast; more are joined.
BROADCAST_HOT = 100_000

KEY = ["key_id", "key_text"]
ENTRY = "key_id long, key_text long, anchor long, span long, lo int, n int"
RUN = "anchor long, salt int, span long, copies long, key_id long, key_text long, lo int, n int"
MARKS = "anchor long, span long, mask long"


# ------------------------------------------------------------------- windows


class Words:
    """Word hashes of a block, two independent ones, and the rows' bounds."""

    def __init__(self, block: Block):
        self.starts, self.ends, self.first = block.words(BLANKS)
        self.a = Sequence(byte_hash(block.data).span(self.starts, self.ends))
        self.b = Sequence(byte_hash(block.data, alternate=True).span(self.starts, self.ends))


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, anchor's word, and number of windows, of each run of windows with one anchor.

    Places are word indices of the block.
    """
    first = words.first
    count = np.maximum(np.diff(first) - window + 1, 0)
    at = ragged(first[:-1], count)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    total = len(words.starts)
    runs, h = np.arange(total - anchor + 1), words.a.runs(anchor)
    # Least hash of the next `width` runs, with its place: doubling, the left one on ties.
    width, reach = window - anchor + 1, 1
    best = runs
    while 2 * reach <= width:
        left, right = best[: len(best) - reach], best[reach:]
        best = np.where(h[right] < h[left], right, left)
        reach *= 2
    if reach < width:
        left, right = best[: len(best) - (width - reach)], best[width - reach :]
        best = np.where(h[right] < h[left], right, left)
    best = best[at]
    row = np.repeat(np.arange(len(count)), count)
    new = np.empty(len(at), dtype=bool)
    new[0] = True
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], at[begin], best[begin], np.diff(np.append(begin, len(at)))


def entries(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Index entries of every row: the row's key, ``anchor``, ``span``, ``lo`` (first window) and ``n`` (windows, up to ``window - anchor + 1``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
            for block in text_blocks(batch.column("text")):
                words = Words(block)
                row, lo, best, n = anchors(words, window, anchor)
                place = ((best - lo) * 64 + n).astype(np.uint64)
                span = mix(words.b.span(lo, lo + n - 1 + window) ^ mix(place + np.uint64(1)))
                columns = [*(k[block.lo + row] for k in keys), words.a.span(best, best + anchor).view(np.int64), span.view(np.int64), (lo - words.first[row]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEY, "anchor", "span", "lo", "n"])

    if window - anchor + 1 > 63 or anchor > window:
        raise ValueError("a span has at most 63 windows, and an anchor lies in its window")
    return docs.select(*KEY, "text").mapInArrow(run, ENTRY)


# --------------------------------------------------------------------- index


class Run(NamedTuple):
    """A run of level k holds ``FAN_IN ** k`` batches.  ``hot`` is a table of anchors and over how many salts each one's spans are dealt."""

    level: int
    path: str
    buckets: int
    hot: str
    hot_anchors: int


class Index:
    """Immutable sorted runs in the shared folder; an existing ``path`` is opened as its manifest says."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.version, self.runs, self.marked = 0, [], []
        self._tables: dict[str, str] = {}
        found = self._manifests()
        if found:
            self.version = found[-1]
            read = json.loads(spark.read.text(self._manifest(self.version), wholetext=True).first()[0])
            self.runs, self.marked = [Run(*r) for r in read["runs"]], read["marks"]

    # The manifest: one small file for each version, complete before it has its name.

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}"

    def _manifests(self) -> list[int]:
        target, fs = self._hadoop(f"{self.path}/manifest-*")
        names = [x.getPath().getName() for x in (fs.globStatus(target) or [])]
        return sorted(int(x.removeprefix("manifest-")) for x in names)

    def _commit(self) -> None:
        self.version += 1
        draft, fs = self._hadoop(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"runs": self.runs, "marks": self.marked}).encode()))
        out.close()
        target, _ = self._hadoop(self._manifest(self.version))
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"{self.path} was changed by another writer")

    def _deleted(self, *paths: str) -> None:
        for path in paths:
            if path in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(path)}")
            target, fs = self._hadoop(path)
            fs.delete(target, True)

    # Runs.

    def _write(self, rows: DataFrame, level: int) -> Run:
        path, name = f"{self.path}/level-{level}-{uuid.uuid4().hex}", f"fingerprints_{uuid.uuid4().hex}"
        hot = rows.groupBy("anchor").count().filter(F.col("count") > HOT_ROWS).select("anchor", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("salts"))
        hot.write.parquet(f"{path}-hot")
        run = Run(level, path, max(shuffle_width(self.spark), -(-rows.count() // BUCKET_ROWS)), f"{path}-hot", self._hot(f"{path}-hot").count())
        merged = _merged(rows)
        if run.hot_anchors:
            merged = merged.join(self._salts(run), "anchor", "left").withColumn("salt", F.pmod("span", F.coalesce("salts", F.lit(1))).cast("int"))
        else:
            merged = merged.withColumn("salt", F.lit(0))
        dealt = merged.select(*(x.split()[0] for x in RUN.split(", "))).repartition(run.buckets, "anchor", "salt")
        dealt.write.format("parquet").bucketBy(run.buckets, "anchor", "salt").sortBy("anchor", "salt", "span").option("path", path).saveAsTable(name)
        self._tables[path] = name
        return run

    def _hot(self, path: str) -> DataFrame:
        return self.spark.read.schema("anchor long, salts int").parquet(path)

    def _salts(self, run: Run) -> DataFrame:
        hot = self._hot(run.hot)
        return F.broadcast(hot) if run.hot_anchors <= BROADCAST_HOT else hot

    def read(self, run: Run) -> DataFrame:
        """A run as a bucketed table."""
        if run.path not in self._tables:
            name = f"fingerprints_{uuid.uuid4().hex}"
            columns = RUN.replace(" long", " BIGINT").replace(" int", " INT")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (anchor, salt) SORTED BY (anchor, salt, span) INTO {run.buckets} BUCKETS LOCATION '{run.path}'")
            self._tables[run.path] = name
        return self.spark.table(self._tables[run.path])

    def having(self, run: Run, anchors: DataFrame) -> DataFrame:
        """Rows of a run whose anchor is among ``anchors`` (distinct): a merge join that leaves the run where it is."""
        if run.hot_anchors:
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
            wanted = anchors.join(self._salts(run), "anchor", "left").select("anchor", salts.alias("salt"))
        else:
            wanted = anchors.select("anchor", F.lit(0).alias("salt"))
        return self.read(run).join(wanted, ["anchor", "salt"], "left_semi").drop("salt")

    def add(self, batch: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
        """Index the entries of a batch; the marks that it brings.

        ``texts`` (the rows' keys and ``text``) has every text of the index, the
        batch's included; only those with candidates are looked at.
        """
        run = self._write(batch.withColumn("copies", F.lit(1).cast("long")), 0)
        own = self.read(run).groupBy("anchor").agg(F.sum("copies").alias("copies"))
        none = self.spark.createDataFrame([], RUN).drop("salt")
        history = staged(reduce(DataFrame.unionByName, [self.having(r, own.select("anchor")) for r in self.runs], none), "history-matches")
        twice = own.filter("copies > 1").select("anchor").unionByName(history.select("anchor")).distinct()
        candidates = staged(_merged(self.having(run, staged(twice, "repeated-anchors")).unionByName(history)), "candidates")
        marks = f"{self.path}/marks-{uuid.uuid4().hex}"
        verified(candidates, texts, window).write.parquet(marks)
        self.runs, self.marked = [*self.runs, run], [*self.marked, marks]
        self._commit()
        dropped(history, candidates)
        self.compact()
        return self.spark.read.schema(MARKS).parquet(marks)

    def compact(self) -> None:
        """Merge ``FAN_IN`` runs of one level into one of the next, for as long as there are so many."""
        while True:
            levels = [r.level for r in self.runs]
            full = next((k for k in sorted(set(levels)) if levels.count(k) >= FAN_IN), None)
            if full is None:
                return
            old = [r for r in self.runs if r.level == full]
            new = self._write(reduce(DataFrame.unionByName, [self.read(r).drop("salt") for r in old]), full + 1)
            self.runs = [r for r in self.runs if r.level != full] + [new]
            self._commit()
            self._deleted(*(p for r in old for p in (r.path, r.hot)))

    def marks(self) -> DataFrame:
        """``anchor``, ``span``, ``mask``: the windows of each span that stand anywhere else, of all batches."""
        every = self.spark.read.schema(MARKS).parquet(*self.marked) if self.marked else self.spark.createDataFrame([], MARKS)
        return every.groupBy("anchor", "span").agg(F.bit_or("mask").alias("mask"))

    def drop(self) -> None:
        self._deleted(*(p for r in self.runs for p in (r.path, r.hot)), self.path)


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each anchor and span: copies added up, one place kept."""
    merged = rows.groupBy("anchor", "span").agg(F.sum("copies").alias("copies"), F.min(F.struct(*KEY, "lo")).alias("at"), F.first("n").alias("n"))
    return merged.select("anchor", "span", "copies", "at.key_id", "at.key_text", "at.lo", "n")


def verified(candidates: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """Marks of the candidates: spans whose windows, or some of them, stand more than once."""
    known = candidates.groupBy("anchor").agg(F.count("*").alias("spans")).filter("spans > 1").select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    whole = candidates.filter("copies > 1").select("anchor", "span", F.lit((1 << 63) - 1).cast("long").alias("mask"))
    single = hashed_windows(candidates.withColumn("salt", F.pmod("span", F.lit(SALTS)).cast("int")).join(known, ["anchor", "salt"], "left_semi"), texts, window)
    counts = single.groupBy("h1", "h2").agg(F.sum("copies").alias("times")).filter("times > 1").select("h1", "h2")
    hits = single.filter("copies = 1").join(counts, ["h1", "h2"], "left_semi")
    return whole.unionByName(hits.groupBy("anchor", "span").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")))


def hashed_windows(spans: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """One row for each window of ``spans``: two hashes of its words, its span, and ``i``, its place there."""
    wanted = spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "n", "anchor", "span", "copies")).alias("spans"))
    # One row for each key, once those without candidates are gone.
    joined = docs.join(wanted, KEY).groupBy(*KEY).agg(F.first("text").alias("text"), F.first("spans").alias("spans")).select("text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            fields = dict(zip(("lo", "n", "anchor", "span", "copies"), column.flatten().flatten(), strict=True))
            fields = {k: v.to_numpy(zero_copy_only=False).astype(np.int64) for k, v in fields.items()}
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            for block in text_blocks(batch.column("text")):
                words = Words(block)
                own = slice(bounds[block.lo], bounds[block.hi])
                lo = fields["lo"][own] + np.repeat(words.first[:-1], np.diff(bounds[block.lo : block.hi + 1]))
                n = fields["n"][own]
                at = ragged(lo, n)
                columns = [words.a.span(at, at + window).view(np.int64), words.b.span(at, at + window).view(np.int64), *(np.repeat(fields[k][own], n) for k in ("anchor", "span", "copies")), ragged(np.zeros(len(n), dtype=np.int64), n).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "anchor", "span", "copies", "i"])

    return staged(joined.mapInArrow(run, "h1 long, h2 long, anchor long, span long, copies long, i int"), "windows")


# ------------------------------------------------------------- the operators


def marked(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """Key, ``text`` and whole ``row`` of every row, and ``spans``: the repeated windows as (``lo``, ``n``, ``mask``), null where there are none.

    The rows go into the index in ``batches`` batches, then all are looked up.
    """
    spark = docs.sparkSession
    keyed = carried(docs)
    texts = keyed.select(*KEY, F.coalesce("text", F.lit("")).alias("text"))
    found = staged(entries(texts, window, anchor), "entries")
    index, part = Index(spark), F.pmod("key_text", F.lit(batches))
    for b in range(batches):
        index.add(found.filter(part == b), texts.filter(part <= b), window)
    masks = staged(index.marks(), "repeated")
    index.drop()
    hits = found.join(masks, ["anchor", "span"]).select(*KEY, "lo", "mask", "n")
    own = hits.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "n", "mask")).alias("spans"))
    return keyed.join(own, KEY, "left")


def _covered(block: Block, spans: pa.Array, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block (starts, ends, row bounds), and which of them go."""
    starts, ends, first = block.words(BLANKS)
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    lo, n, mask = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64)[bounds[block.lo] : bounds[block.hi]] for k in range(3))
    lo = lo + np.repeat(first[:-1], np.diff(bounds[block.lo : block.hi + 1]))
    at, shift = ragged(lo, n), ragged(np.zeros(len(n), dtype=np.int64), n)
    at = at[(np.repeat(mask, n) >> shift) & 1 == 1]
    np.add.at(gone, at, 1)
    np.add.at(gone, at + window, -1)
    return starts, ends, first, np.cumsum(gone[:-1]) > 0


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, Block, np.ndarray, np.ndarray, list[bytes]]]:
    """Batch, block, words and removed words of each row, and its kept words joined by a blank."""
    for batch in batches:
        column = batch.column("spans")
        bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = column.flatten()
        for block in text_blocks(batch.column("text")):
            starts, ends, first, gone = _covered(block, flat, bounds, window)
            row = row_of(first)
            words, removed = np.diff(first), np.bincount(row[gone], minlength=block.rows)
            s, size = starts[~gone], (ends - starts)[~gone] + 1
            blob = np.full(int(size.sum()), 0x20, dtype=np.uint8)
            own = np.cumsum(size) - size
            blob[ragged(own, size - 1)] = block.data[ragged(s, size - 1)]
            cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(words - removed)])].tolist()
            raw = blob.tobytes()
            yield batch, block, words, removed, [raw[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:], strict=False)]


def digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row.

    Null and empty texts have no words; texts of under ``window`` words lose
    none.  Rows that repeat are each other's copies.  Only ``doc_id`` and
    ``text`` are read; an empty table stays empty.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, words, removed, kept in _texts(parts, window):
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(block.lo, block.rows), "n_words": pa.array(words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            })

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return marked(own, window, anchor, batches).select("row.doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``.

    A text that loses nothing stays as it is; of another, the words that are
    left are joined by one blank.  A text may end up empty; its row stays.
    Null texts stay null and have no words; texts of under ``window`` words
    have no window.  Rows that repeat are each other's copies and lose all
    their windows.  Other columns are untouched; an empty table stays empty.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, _, removed, kept in _texts(parts, window):
            text = batch.column("text").slice(block.lo, block.rows).to_pylist()
            text = [k.decode("utf-8", "replace") if n else t for t, n, k in zip(text, removed.tolist(), kept, strict=True)]
            row = batch.column("row").slice(block.lo, block.rows).flatten()
            columns = [pa.array(text, pa.string()) if f.name == "text" else c for f, c in zip(schema.fields, row, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return marked(docs, window, anchor, batches).select("text", "row", "spans").mapInArrow(run, schema)


#: The same rows in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT rid, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM win JOIN twice USING (h)
), words AS (
  SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
