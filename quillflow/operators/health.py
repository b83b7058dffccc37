"""Health of the stores: counts, histograms, status."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame | None], spark: SparkSession | None = None) -> DataFrame:
    """``table``, ``n`` and ``status`` of every store; null and "error" for one that can't be read."""
    one = lambda name, df: (df.agg(F.count(F.lit(1)).alias("n"))).select(F.lit(name).alias("table"), "n")
    spark = spark or next(df for df in tables.values() if df is not None).sparkSession
    missing = spark.createDataFrame([(name, None) for name, df in tables.items() if df is None], "table string, n long")
    every = reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items() if df is not None], missing)
    return every.withColumn("status", F.when(F.col("n").isNull(), "error").when(F.col("n") > 0, "healthy").otherwise("empty"))


def readable(read: Callable[[], DataFrame]) -> DataFrame | None:
    """A store that can be opened; None for one that can't."""
    try:
        found = read()
        found.schema
        return found
    except Exception:
        return None


def catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``counts`` of every table of the session's catalog; a table that can't be read is an error of its own."""
    names = sorted(x.name for x in (spark.catalog.listTables(database) if database else spark.catalog.listTables()))
    if not names:
        return spark.createDataFrame([], "table string, n long, status string")
    return counts({name: readable(lambda name=name: spark.table(f"{database}.{name}" if database else name)) for name in names}, spark)


def collections(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """Points and dimensions of each vector collection, and in all (``by`` null)."""
    return vectors.rollup(by).agg(F.count(F.lit(1)).alias("points"), F.max(F.size(vector)).alias("dimensions"))


def graph(nodes: DataFrame, edges: DataFrame, id_: str = "id") -> DataFrame:
    """One row: nodes, edges, and the node of the least id as a sample."""
    own = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.min_by(F.to_json(F.struct(*nodes.columns)), id_).alias("sample"))
    both = own.withColumn("edges", F.lit(0).cast("long")).unionByName(edges.agg(F.count(F.lit(1)).alias("edges")).withColumns({"nodes": F.lit(0).cast("long"), "sample": F.lit(None).cast("string")}))
    return both.agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.max("sample").alias("sample"))


def overall(counted: DataFrame) -> DataFrame:
    """One row: stores, records in all (errors aside), and whether every store is healthy."""
    return counted.agg(F.count(F.lit(1)).alias("stores"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.every(F.col("status") == "healthy").alias("healthy"))


def histogram(rows: DataFrame, label: str, top: int = 10) -> DataFrame:
    """The most frequent labels and their counts; ties by label.  A top-k report."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(top)
