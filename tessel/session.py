"""Session defaults and lineage cutting for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "tessel", **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` keys use __ for dots."""
    b = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the folder that the cluster names for checkpoints (a local one only where it names none) and
    read it back: lineage ends, and sizes known to the optimizer are those of the files. ``old``, a frame that an
    earlier call returned and that is needed no longer, is deleted."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(sc, "_tessel_checkpoints", None) or "file://" + tempfile.mkdtemp(prefix="tessel-checkpoints-")
        sc._tessel_checkpoints = base
    path = f"{base.rstrip('/')}/tessel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessel_path = path
    if old is not None and getattr(old, "_tessel_path", None):
        p = sc._jvm.org.apache.hadoop.fs.Path(old._tessel_path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return out
