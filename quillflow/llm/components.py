"""Connected components of an edge list, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``: long).

    Each round, every node hooks to the least node among itself and its
    neighbours, and edges are renamed by the hooks; loops and repeats go.  Nodes
    that are no local minimum vanish, so with ids in random order the rounds
    grow as the logarithm of the longest chain.  Hooks and edges are written to
    the shared folder after each round.  A node with many edges costs no more
    than its edges: minima are taken before the shuffle, and the joins are
    plain equi-joins whose large partitions Spark can split.
    """
    edges = staged(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "hooks")
        if labels is None:
            labels = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = staged(labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        a, b = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"to_{x}")) for x in "ab")
        renamed = edges.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = staged(renamed.filter("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
