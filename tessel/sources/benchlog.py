"""Benchmark logs: reading, merging and writing of wide CSV rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """IO16: logs merged by column name; both spellings of the matrix name are accepted."""
    out = None
    for p in paths:
        one = spark.read.option("header", "true").option("inferSchema", "true").csv(p)
        if "Matrix Name" in one.columns:
            one = one.withColumnRenamed("Matrix Name", "MatrixName")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_log(df: DataFrame, path: str, header: bool = True) -> None:
    """IO15."""
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)
