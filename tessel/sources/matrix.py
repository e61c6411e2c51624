"""Readers and writers of matrix files.

Headers are read on the driver, entries as DataFrames. Line numbers come from the place of a line in its file block and
the lines in the blocks before it, so no single task sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.structure import make_full


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, line``: the lines of a text file, numbered from 0."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("block"), F.monotonically_increasing_id().alias("m"))
    blocks = raw.groupBy("block").agg(F.count("*").alias("c"), F.min("m").alias("m0"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", "m0", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return raw.join(base, "block").select((F.col("base") + F.col("m") - F.col("m0")).alias("n"), "line")


def _first_file(spark: SparkSession, path: str) -> str:
    """The file itself, or the first part of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isFile():
        return path
    return min(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName()[0] not in "._")


def _header(spark: SparkSession, path: str) -> tuple[str, list[int]]:
    """The banner, and the numbers of the first line that is no comment, however many comments stand before it."""
    lines = spark.read.text(_first_file(spark, path))
    banner = (lines.first() or [""])[0].lower()
    size = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    if size is None:
        raise ValueError(f"{path} has no size line")
    return (banner if banner.startswith("%%") else ""), [int(x) for x in size[0].split()]


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """IO1: a MatrixMarket coordinate file as edges and its shape. Patterns have value 1; symmetric files are mirrored;
    duplicate coordinates are summed."""
    banner, (m, n, *_) = _header(spark, path)
    if "array" in banner:
        raise ValueError("an array file; use read_mtx_array")
    lines = numbered_lines(spark, path).where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    size = lines.agg(F.min("n").alias("h"))
    p = F.split(F.trim("line"), r"\s+")
    value = F.lit(1.0) if "pattern" in banner else F.get(p, 2).cast("double")
    e = lines.join(F.broadcast(size)).where("n > h").select((p[0].cast("long") - 1).alias("i"), (p[1].cast("long") - 1).alias("j"), value.alias("v"))
    e = e.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return (make_full(e) if "symmetric" in banner else e), (m, n)


def read_mtx_array(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """IO2: a dense MatrixMarket file, values column by column, as ``j, k, x``."""
    _, (m, n, *_rest) = _header(spark, path)
    lines = numbered_lines(spark, path).where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    first = lines.agg(F.min("n").alias("h"))
    at = lines.join(F.broadcast(first)).where("n > h").select((F.col("n") - F.col("h") - 1).alias("r"), F.trim("line").cast("double").alias("x"))
    return at.select((F.col("r") % m).alias("j"), F.floor(F.col("r") / m).alias("k"), "x"), (m, n)


def read_smtx(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """IO3: header ``rows, cols, nnz``, then row pointers, then column ids; every value is 1.

    Pointers and ids are one line each: they are split where they are read and exploded with positions; the row of a
    position is that of the pointers around it, by an explode of each row's range.
    """
    lines = numbered_lines(spark, path)
    m, n, nnz = (int(x) for x in lines.where("n = 0").first()["line"].replace(",", " ").split())
    tokens = lines.where("n > 0").select("n", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("p", "t")).where("t <> ''")
    per = tokens.groupBy("n").agg(F.count("*").alias("c"))
    base = per.select("n", F.coalesce(F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    flat = tokens.join(base, "n").select((F.col("base") + F.col("p")).alias("at"), F.col("t").cast("long").alias("t"))
    ptr = flat.where(F.col("at") <= m)
    nxt = ptr.select((F.col("at") - 1).alias("at"), F.col("t").alias("hi"))
    rows = ptr.join(nxt, "at").where("t < hi").select(F.col("at").alias("i"), F.explode(F.sequence(F.col("t"), F.col("hi") - 1)).alias("pos"))
    ids = flat.where(F.col("at") > m).select((F.col("at") - m - 1).alias("pos"), F.col("t").alias("j"))
    return rows.join(ids, "pos").select("i", "j", F.lit(1.0).alias("v")), (m, n)


def read_matrix(spark: SparkSession, path: str):
    """Dispatch by extension; an unknown one is an error (IO4)."""
    if path.endswith(".mtx"):
        banner, _ = _header(spark, path)
        return read_mtx_array(spark, path) if "array" in banner else read_mtx(spark, path)
    if path.endswith(".smtx"):
        return read_smtx(spark, path)
    raise ValueError(f"unsupported matrix file: {path}")


def _one_file(df: DataFrame, path: str) -> None:
    """Header and entries as one folder of text in which the header's part comes first."""
    df.write.mode("overwrite").text(path)


def write_mtx(e: DataFrame, path: str, shape: tuple[int, int], pattern: bool = False) -> None:
    """IO13: coordinate format, 1-based. The folder's first part holds the header."""
    spark = e.sparkSession
    kind = "pattern" if pattern else "real"
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} general\n{shape[0]} {shape[1]} {e.count()}",)], "value string").coalesce(1)
    i, j = (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string")
    row = F.concat_ws(" ", i, j) if pattern else F.concat_ws(" ", i, j, F.col("v").cast("string"))
    _one_file(head.union(e.select(row.alias("value"))), path)


def write_mtx_array(x: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """A dense ``j, k, x`` column by column."""
    spark = x.sparkSession
    head = spark.createDataFrame([(f"%%MatrixMarket matrix array real general\n{shape[0]} {shape[1]}",)], "value string").coalesce(1)
    _one_file(head.union(x.repartitionByRange("k", "j").sortWithinPartitions("k", "j").select(F.col("x").cast("string").alias("value"))), path)


def write_smtx(rows: DataFrame, n: int, cols: int, path: str) -> None:
    """CSR rows ``i, cols`` of a matrix of driver size."""
    have = {r["i"]: list(r["cols"]) for r in rows.collect()}
    ptr, ids = [0], []
    for i in range(n):
        ids += have.get(i, [])
        ptr.append(len(ids))
    text = f"{n}, {cols}, {len(ids)}\n{' '.join(map(str, ptr))}\n{' '.join(map(str, ids))}"
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def list_matrices(spark: SparkSession, folder: str, pattern: str = "*.smtx") -> DataFrame:
    """IO18: ``path, bytes`` of matrix files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def catalogue(df: DataFrame, nnz: tuple[int, int] = (100_000, 100_000_000), rows: tuple[int, int] | None = None) -> DataFrame:
    """IO17: real, positive definite, square matrices in bounds of entries (and rows)."""
    out = df.where(F.col("nnz").between(*nnz) & F.col("isspd") & (F.col("dtype") == "real") & (F.col("rows") == F.col("cols")))
    return out.where(F.col("rows").between(*rows)) if rows else out


def shards(lst: DataFrame, files: int = 10, order: str = "name") -> DataFrame:
    """At most ``files`` lists of ceil(lines / files) names each: ``file, name``."""
    n = lst.count()
    size = max(1, -(-n // files))
    return lst.select(F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).alias("file"), order)
