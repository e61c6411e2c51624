"""Edges that arrive as a stream, kept as additive partial products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_spmv(edges: DataFrame, x: DataFrame) -> DataFrame:
    """``A x`` over a stream of edges ``i, j, v``: a stream-static join, then a running sum by row (complete or update
    mode). The static vector is ``j, x``."""
    return edges.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def streaming_degree(edges: DataFrame) -> DataFrame:
    """Row degrees of a stream of edges."""
    return edges.groupBy("i").agg(F.count("*").alias("deg"))
