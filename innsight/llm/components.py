"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.util import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): ``root`` is the smallest node reachable.

    Alternating large-star and small-star steps: each keeps connectivity and
    pulls nodes to smaller neighbours, until nothing changes (a few rounds, as
    links shrink to stars).  Minima are partially aggregated; each round is
    written, so plans stay short and lost executors cost one round.
    """
    edges = written(_pairs(links.select("a", "b")), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))  # a < b
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select("b", "a", "m")
        edges = _pairs(small.select(F.col("a"), F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = written(edges, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == before:
            break
        before = now
    root = edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
    return written(root.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root")), "roots")


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
