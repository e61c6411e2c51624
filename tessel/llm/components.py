"""Connected components by alternating large-star and small-star steps, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges(a, b)`` (longs) with the smallest node that it reaches.

    Returns ``node, component`` for nodes that have a link to another node; a self link or an empty table adds
    nothing. Null ends are ignored. Each round is a few equi-joins whose one side has a row per key, and is written to
    the shared folder, which cuts the lineage. Rounds grow with the logarithm of the longest path.
    """
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, mark = _settle(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low2, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _settle(moved.union(low2.select("u", F.col("m").alias("v"))).distinct(), e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def _settle(e: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, tuple]:
    e = cut(e, old)
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return e, (row[0], row[1])
