"""Streams of discovered links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def first_seen(links: DataFrame, days: int, at: str = "discovered_at", url: str = "url") -> DataFrame:
    """Links whose canonical URL wasn't seen in the ``days`` days before.

    In a stream, state holds one entry for each URL, from its first sighting
    until the watermark has passed.  In a finished table the sightings
    themselves decide, in order of time (of equal ones, one stays); those
    without a readable time count as one long ago.  Sightings are first
    summed up by URL and span of ``days``, so a URL that is found everywhere
    costs a row for each span.
    """
    keyed = links.withColumn("dedup_key", t.canonical_url(url)).withColumn(at, F.col(at).try_cast("timestamp"))
    if links.isStreaming:
        return keyed.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(["dedup_key"])
    span = days * 86_400
    seconds = F.coalesce(F.unix_micros(at) / 1e6, F.lit(-1e12))
    own = F.struct(*keyed.columns)
    # Only the first sighting in a span can come more than a span after the one before it.
    each = keyed.groupBy("dedup_key", F.floor(seconds / span).alias("_span")).agg(F.min(seconds).alias("_first"), F.max(seconds).alias("_last"), F.min_by(own, F.struct(seconds, F.xxhash64(own))).alias("_row"))
    before = F.lag("_last").over(Window.partitionBy("dedup_key").orderBy("_span"))
    return each.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > span)).select("_row.*")


def work_queue(links: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run ``handle`` on each batch of new links, once for each; a restart goes on where the checkpoint ends."""
    return links.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events in each window of time; later ones than ``late`` are dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")
