"""Array and reporting expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessel.operators.products import leaky_relu, relu, vec_dot


def vec_axpy(a: Column, x: Column, y: Column) -> Column:
    """``a x + y`` elementwise."""
    return F.zip_with(x, y, lambda p, q: a * p + q)


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))


def exact_median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def gflops_spmm(nnz: Column, width: Column, seconds: Column) -> Column:
    return 2 * nnz * width / 1e9 / seconds


def gflops_gcn(nnz: Column, m: Column, n: Column, c: Column, seconds: Column) -> Column:
    return (2 * nnz * n + 2 * m * n * c) / 1e9 / seconds


def register(spark: SparkSession) -> None:
    """``vec_dot(a, b)`` and ``vec_axpy(s, x, y)`` as SQL functions, expanded into built-in expressions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, t) -> s + t)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_axpy(s DOUBLE, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN zip_with(x, y, (p, q) -> s * p + q)")


__all__ = ["exact_median", "geometric_mean", "gflops_gcn", "gflops_spmm", "leaky_relu", "register", "relu", "vec_axpy", "vec_dot"]
