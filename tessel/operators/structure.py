"""Structural operators on edge tables.

An edge table is a DataFrame ``i long, j long, v double`` in which an absent pair is 0. ``n`` is the number of rows
(and columns, for square matrices) where a result needs it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.session import cut


def edges(df: DataFrame, i: str = "i", j: str = "j", v: str | None = "v") -> DataFrame:
    """COO constructor: duplicate coordinates are summed; without a value column every entry counts 1."""
    value = F.coalesce(F.col(v).cast("double"), F.lit(1.0)) if v else F.lit(1.0)
    return df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), value.alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def pattern(df: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Unit-weight edges, duplicates removed."""
    return df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).distinct().withColumn("v", F.lit(1.0))


def csr_rows(e: DataFrame) -> DataFrame:
    """Row view: ``i, cols, vals`` with columns in order. Only for rows that fit a cell."""
    packed = e.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
    return packed.select("i", F.col("r.j").alias("cols"), F.col("r.v").alias("vals"))


def csc_columns(e: DataFrame) -> DataFrame:
    packed = e.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    return packed.select("j", F.col("c.i").alias("rows"), F.col("c.v").alias("vals"))


def expand_rows(rows: DataFrame) -> DataFrame:
    """Row view back to edges: the row index of every entry."""
    return rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def lower_half(e: DataFrame) -> DataFrame:
    """Lower triangle with the diagonal."""
    return e.where("i >= j")


def make_full(e: DataFrame) -> DataFrame:
    """Mirror a stored triangle."""
    return e.union(transpose(e.where("i <> j")))


def symmetrise(e: DataFrame) -> DataFrame:
    """Pattern of E or its transpose, unit weights."""
    both = e.select("i", "j").union(e.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return both.distinct().withColumn("v", F.lit(1.0))


def row_degree(e: DataFrame) -> DataFrame:
    return e.groupBy("i").agg(F.count("*").alias("deg"))


def normalised_row_sums(e: DataFrame) -> DataFrame:
    """Row sums over the greatest absolute row sum; ``x`` is null if that is 0."""
    sums = e.groupBy("i").agg(F.sum("v").alias("s"))
    top = sums.agg(F.max(F.abs("s")).alias("top"))
    return sums.join(F.broadcast(top)).select("i", F.try_divide("s", "top").alias("x"))


def max_abs(e: DataFrame) -> DataFrame:
    return e.agg(F.max(F.abs("v")).alias("max_abs"))


def zero_rows(e: DataFrame, n: int | Column) -> DataFrame:
    n = F.lit(n) if isinstance(n, int) else n
    return e.agg((n - F.countDistinct("i")).alias("zero_rows"))


def bandwidth(e: DataFrame) -> DataFrame:
    """Greatest distance of the last from the first column of a row."""
    return e.groupBy("i").agg((F.max("j") - F.min("j")).alias("w")).agg(F.max("w").alias("bandwidth"))


def density(e: DataFrame, m: int, n: int) -> DataFrame:
    return e.agg(F.count("*").alias("nnz"), (F.count("*") / F.lit(float(m) * n)).alias("density"))


def apply_permutation(e: DataFrame, perm: DataFrame, rows: bool = True, cols: bool = True) -> DataFrame:
    """Renumber by ``perm(old, new)``."""
    if rows:
        p = perm.select(F.col("old").alias("i"), F.col("new").alias("_ni"))
        e = e.join(p, "i").select(F.col("_ni").alias("i"), "j", "v")
    if cols:
        p = perm.select(F.col("old").alias("j"), F.col("new").alias("_nj"))
        e = e.join(p, "j").select("i", F.col("_nj").alias("j"), "v")
    return e


def permutation_of_schedule(schedule: DataFrame) -> DataFrame:
    """Numbers rows in the order of a schedule; counts by level and part keep the window inside a part."""
    sizes = schedule.groupBy("level", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("level", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = schedule.withColumn("at", F.row_number().over(Window.partitionBy("level", "part").orderBy("pos")) - 1)
    return inside.join(base, ["level", "part"]).select(F.col("id").alias("old"), (F.col("base") + F.col("at")).alias("new"))


def reorder_rows(e: DataFrame, schedule: DataFrame) -> DataFrame:
    """Rows rewritten in schedule order; ``old_i`` keeps where they came from."""
    p = permutation_of_schedule(schedule)
    return e.join(p, e.i == p.old).select(F.col("new").alias("i"), "j", "v", F.col("old").alias("old_i"))


def reverse_cuthill_mckee(e: DataFrame, n: int) -> DataFrame:
    """A permutation ``old, new`` by breadth-first levels with degree ties, reversed.

    Each component starts at its least-degree vertex; vertices of a level are ordered by the least-placed parent, then
    degree, then id. Levels are joins, each written to a folder of its own, until no component has another; only
    whether a level is empty reaches the driver. Vertices of a level are numbered inside buckets of their parents'
    places, and buckets by their counts, so no task orders a whole level.
    """
    spark = e.sparkSession
    sym = symmetrise(e.where("i <> j")).select("i", "j").persist()
    deg = spark.range(n).select(F.col("id").alias("i")).join(row_degree(sym.withColumn("v", F.lit(1.0))), "i", "left").select("i", F.coalesce("deg", F.lit(0)).alias("deg")).persist()
    comp = label_components(sym, n)
    seed = comp.join(deg, "i").groupBy("comp").agg(F.min(F.struct("deg", "i")).alias("s")).select(F.col("s.i").alias("i"), "comp")
    front = cut(seed.select("comp", "i", F.lit(0).alias("level"), F.lit(0).cast("long").alias("rank")))
    levels = [front]
    while True:
        # a neighbour of a level lies in it, in the one before or in the next
        known = levels[-1].select("i") if len(levels) == 1 else levels[-1].select("i").union(levels[-2].select("i"))
        reached = front.join(sym, "i").select("comp", F.col("j").alias("i"), "rank").join(known, "i", "left_anti")
        nxt = cut(reached.groupBy("comp", "i").agg(F.min("rank").alias("parent")).join(deg, "i").withColumn("_b", F.floor(F.col("parent") / 4096)))
        if nxt.isEmpty():
            break
        sizes = nxt.groupBy("comp", "_b").agg(F.count("*").alias("_n"))
        base = sizes.select("comp", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("comp").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        inside = nxt.withColumn("_r", F.row_number().over(Window.partitionBy("comp", "_b").orderBy("parent", "deg", "i")))
        front = cut(inside.join(base, ["comp", "_b"]).select("comp", "i", F.lit(len(levels)).alias("level"), (F.col("_base") + F.col("_r")).cast("long").alias("rank")), nxt)
        levels.append(front)
    sym.unpersist()
    deg.unpersist()
    placed = spark.read.schema(front.schema).parquet(*(x._tessel_path for x in levels))
    # ranks are 1..n in a level, so counts by level place every vertex without one sort of all
    sizes = placed.groupBy("comp", "level").agg(F.count("*").alias("m"))
    before = Window.orderBy(F.desc("comp"), F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("comp", "level", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    at = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.col("m") - F.col("rank"))
    return placed.join(base, ["comp", "level"]).select(F.col("i").alias("old"), (F.col("base") + at).cast("long").alias("new"))


def label_components(sym: DataFrame, n: int, max_rounds: int = 1_000) -> DataFrame:
    """``i, comp``: the least vertex reachable, by spreading minima and jumping along labels."""
    spark = sym.sparkSession
    lab, old = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("comp")), None
    for _ in range(max_rounds):
        near = sym.join(lab.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min("comp").alias("m"))
        new = lab.join(near, "i", "left").select("i", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("was"))
        jump = new.select(F.col("i").alias("comp"), F.col("comp").alias("up"))
        new = cut(new.join(jump, "comp").select("i", F.col("up").alias("comp"), "was"), old)
        if new.where("comp <> was").isEmpty():
            return new.select("i", "comp")
        lab, old = new.select("i", "comp"), new
    raise RuntimeError("components did not settle")


def metis_reordering(*_args, **_kwargs):
    """The reordering that needs an external partitioner is not offered."""
    raise NotImplementedError("unsupported: an external graph partitioner is needed")


def padded_dims(m: int, n: int) -> tuple[int, int]:
    """Dimensions raised to powers of two."""
    up = lambda x: 1 << max(0, math.ceil(math.log2(x))) if x > 0 else 0
    return up(m), up(n)


def set_diagonal(e: DataFrame, n: int, value: float = 1.0) -> DataFrame:
    """Overwrite the diagonal (adds self loops)."""
    diag = e.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(value).alias("v"))
    return e.where("i <> j").select("i", "j", "v").union(diag)


def mask_rows(e: DataFrame, rows: DataFrame) -> DataFrame:
    """Keep the rows in ``rows(i)``; the shape stays."""
    return e.join(rows.select("i").distinct(), "i", "left_semi")


def merge_graphs(graphs: list[tuple[DataFrame, int]]) -> DataFrame:
    """Stack graphs side by side: graph g's indices move by the rows of those before it."""
    out, off = None, 0
    for e, n in graphs:
        part = e.select((F.col("i") + off).alias("i"), (F.col("j") + off).alias("j"), "v")
        out, off = part if out is None else out.union(part), off + n
    return out


def split_diagonal(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diagonal ``i, d``; off-diagonal edges)."""
    return e.where("i = j").select("i", F.col("v").alias("d")), e.where("i <> j")


def identity(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(value).alias("v"))


def banded(spark: SparkSession, n: int, width: int) -> DataFrame:
    """Unit band: columns from max(0, int(i-h)) to min(n, int(i+h+1)) with h = (width-1)/2; an even width leans left."""
    h = (width - 1) / 2
    lo, hi = F.greatest(F.lit(0), (F.col("id") - h).cast("long")), F.least(F.lit(n), (F.col("id") + h + 1).cast("long"))
    band = spark.range(n).withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    return band.select(F.col("id").alias("i"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("j"), F.lit(1.0).alias("v"))


def replayable(*terms: Column, seed: int) -> Column:
    """A hash of longs below 2**31 - 1 by integer arithmetic alone, which any SQL engine can repeat: for each term a step
    of a multiplicative generator modulo that prime and the fifth power, which is a bijection there."""
    prime = (1 << 31) - 1
    out = F.lit((seed * 48271 + 11) % prime).cast("long")
    for t in terms:
        out = ((out + t % prime + 1) * 16807) % prime
        square = out * out % prime
        out = square * square % prime * out % prime
    return out


def random_sparse(spark: SparkSession, n: int, density: float, seed: int = 0) -> DataFrame:
    """IO5: about ``density * n * n`` unit entries at hashed places: the same for the same seed, without n*n work."""
    k = min(max(0, round(density * n * n)), (1 << 31) - 1)  # places are hashed from numbers modulo this prime, and so repeat beyond it
    i, j = (replayable(F.col("id"), F.lit(t), seed=seed) % n for t in (1, 2))
    # a place is one number; it goes to one of so many tasks that each holds a million, and none are summed before that
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-k // 1_000_000))
    at = spark.range(0, k, 1, max(spark.sparkContext.defaultParallelism, -(-k // 2_000_000))).select((i * n + j).alias("_at")).repartition(parts, "_at").distinct()
    return at.select(F.expr(f"_at div {n}").alias("i"), (F.col("_at") % n).alias("j"), F.lit(1.0).alias("v"))


def random_dense(spark: SparkSession, n: int, k: int, seed: int = 0) -> DataFrame:
    """IO6: long form ``j, k, x`` with x in (-1, 1), hashed from place and seed."""
    x = replayable(F.col("j"), F.col("k"), seed=seed) / float(1 << 30) - 1
    return spark.range(n).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("k")).withColumn("x", x)
