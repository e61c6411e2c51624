"""Session helpers: shipping this package to executors, cutting lineage, and shared files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes handed to Python at once; texts can be long, so batches stay small.
ARROW_ROWS = 512
ARROW_BYTES = 64 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Make executors able to import this package, and keep Arrow batches small."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    sc = spark.sparkContext
    if getattr(sc, "_tessel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessel-")) / "tessel_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._tessel_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a folder of this machine, if there is
    no other machine; on a cluster that is an error, as its executors would not see each other's files."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master.split("[")[0] == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_tessel_shared", None):
        sc._tessel_shared = "file://" + tempfile.mkdtemp(prefix="tessel-shared-")
        sc.setCheckpointDir(sc._tessel_shared)
    return sc._tessel_shared


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"
    # nothing else runs ``df``, so the files of its shuffles can go as soon as the table is there; otherwise they stay on
    # the executors' disks until the driver's garbage collector comes upon them
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessel_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for tables that no plan needs any longer."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(t._tessel_path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``written`` for a loop: ``old``, what an earlier round wrote and no plan needs any longer, is deleted. Plans over
    files have the files' sizes; sizes guessed over a checkpoint would grow with every round."""
    out = written(df, "round")
    if old is not None:
        discard(old)
    return out


class SharedFiles:
    """A folder of files that tasks write once and other tasks map into memory.

    Where the shared folder is a mounted file system, readers map the files in place. Elsewhere they copy
    a file to the executor's temporary folder, map it and unlink it at once, so that nothing stays behind.
    """

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, name: str) -> "SharedFiles":
        return cls(f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}")

    def _local(self) -> str | None:
        u = urlparse(self.uri)
        return u.path if u.scheme in ("", "file") else None

    def write(self, name: str, data: bytes) -> None:
        """Atomic: a repeated or speculative attempt replaces the file by the same bytes."""
        local = self._local()
        if local is not None:
            os.makedirs(local, exist_ok=True)
            tmp = f"{local}/.{name}.{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(data)
            os.replace(tmp, f"{local}/{name}")
            return
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path, recursive=True)
        tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(tmp) as f:
            f.write(data)
        store.move(tmp, f"{path}/{name}")

    def map(self, name: str):
        """A read-only byte view of a file (a NumPy array); empty files give an empty array."""
        import numpy as np

        local = self._local()
        if local is not None:
            p = f"{local}/{name}"
            return np.memmap(p, dtype=np.uint8, mode="r") if os.path.getsize(p) else np.empty(0, np.uint8)
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        fd, tmp = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as out, store.open_input_stream(f"{path}/{name}") as src:
                while block := src.read(1 << 22):
                    out.write(block)
            return np.memmap(tmp, dtype=np.uint8, mode="r") if os.path.getsize(tmp) else np.empty(0, np.uint8)
        finally:
            os.unlink(tmp)
