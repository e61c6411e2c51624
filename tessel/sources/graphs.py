"""Readers and converters of graph data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.schedule import ranked

from .matrix import numbered_lines


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """``key, id``: distinct keys numbered in the order in which they are first seen."""
    first = df.groupBy(key).agg(F.min(order).alias("_at"))
    return ranked(first, "_at").select(key, F.col("rank").cast("long").alias("id"))


def read_cora(spark: SparkSession, content: str, cites: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO9: nodes ``i, y, label``, features ``i, k, x`` (only ones) and undirected, distinct edges.

    ``content`` lines are id, flags, label; ``cites`` lines are cited, citing. Ids and labels are numbered as first seen.
    """
    rows = numbered_lines(spark, content).select("n", F.split("line", "\t").alias("p"))
    rows = rows.select(F.col("n").alias("i"), F.col("p")[0].alias("paper"), F.element_at("p", -1).alias("label"), F.expr("slice(p, 2, size(p) - 2)").alias("flags"))
    labels = first_seen(rows, "label", "i").withColumnRenamed("id", "y")
    nodes = rows.join(labels, "label").select("i", "y", "label")
    feats = rows.select("i", F.posexplode("flags").alias("k", "f")).select("i", F.col("k").cast("long").alias("k"), F.col("f").cast("double").alias("x")).where("x <> 0")
    ids = rows.select("paper", "i")
    pair = spark.read.option("sep", "\t").schema("cited string, citing string").csv(cites)
    one = pair.join(ids.select(F.col("paper").alias("cited"), F.col("i").alias("a")), "cited").join(ids.select(F.col("paper").alias("citing"), F.col("i").alias("b")), "citing").select("a", "b")
    e = one.union(one.select("b", "a")).distinct().select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1.0).alias("v"))
    return nodes, feats, e


def read_pubmed(spark: SparkSession, nodes: str, cites: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO10: the tab format with ``feat=value`` tokens: nodes ``i, y``, features ``i, k, x``, undirected edges.

    The node file's second line names the features in order (``numeric:name:0``); a node's label is ``label=c``, kept
    less 1; edge lines have two ``paper:id`` tokens. Two header lines go before either.
    """
    lines = numbered_lines(spark, nodes)
    names = [t.split(":")[1] for t in lines.where("n = 1").first()["line"].split("\t") if t.startswith("numeric:")]
    vocab = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "name string, k long")
    rows = lines.where("n > 1 and trim(line) <> ''").select((F.col("n") - 2).alias("i"), F.split("line", "\t").alias("p"))
    token = rows.select("i", F.explode(F.expr("slice(p, 2, size(p))")).alias("t")).select("i", F.split("t", "=").alias("q")).select("i", F.col("q")[0].alias("name"), F.col("q")[1].alias("value"))
    y = token.where("name = 'label'").select("i", (F.col("value").cast("long") - 1).alias("y"))
    feats = token.join(vocab, "name").select("i", "k", F.col("value").cast("double").alias("x"))
    ids = rows.select(F.col("p")[0].alias("paper"), "i")
    pair = numbered_lines(spark, cites).where("n > 1 and trim(line) <> ''").select(F.regexp_extract_all("line", F.lit(r"paper:(\S+)"), 1).alias("q"))
    one = pair.join(ids.select(F.col("paper").alias("_a"), F.col("i").alias("a")), F.col("q")[0] == F.col("_a")).join(ids.select(F.col("paper").alias("_b"), F.col("i").alias("b")), F.col("q")[1] == F.col("_b")).select("a", "b")
    e = one.union(one.select("b", "a")).distinct().select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1.0).alias("v"))
    return y, feats, e


def role_edges(e: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO11: from ``roles(i, role)`` with tr, va, te: edges with both ends in training; and these with all edges neither
    end of which is in test."""
    tr = roles.where("role = 'tr'").select("i")
    te = roles.where("role = 'te'").select("i")
    col = lambda d: d.withColumnRenamed("i", "j")
    train = e.join(tr, "i", "left_semi").join(col(tr), "j", "left_semi").select("i", "j", "v")
    val = e.join(te, "i", "left_anti").join(col(te), "j", "left_anti").select("i", "j", "v")
    return train, train.union(val).distinct()


def heterogeneous(sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """IO12: one block matrix from ``sizes(type, n)`` and ``edges(src_type, dst_type, i, j)``; types are stacked in order."""
    before = Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select("type", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    a, b = off.select(F.col("type").alias("src_type"), F.col("off").alias("_a")), off.select(F.col("type").alias("dst_type"), F.col("off").alias("_b"))
    return edges.join(F.broadcast(a), "src_type").join(F.broadcast(b), "dst_type").select((F.col("i") + F.col("_a")).alias("i"), (F.col("j") + F.col("_b")).alias("j"), F.lit(1.0).alias("v"))


def class_map(labels: DataFrame) -> DataFrame:
    """IO14: ``i, y`` with NaN and null as -1."""
    return labels.select("i", F.when(F.col("y").isNull() | F.isnan(F.col("y").cast("double")), F.lit(-1)).otherwise(F.col("y")).cast("int").alias("y"))


def write_json(df: DataFrame, path: str) -> None:
    """IO14: role and class files as JSON lines."""
    df.write.mode("overwrite").json(path)
