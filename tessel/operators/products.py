"""Sparse and dense products: an equi-join on the contracted index, then a sum by the free ones.

Operands: edges ``i, j, v``; dense matrices in long form ``j, k, x`` or row form ``j, x array<double>``; vectors
``j, x``; weights ``k, c, w`` (in by out). Results are sparse: a missing cell is 0. ``dense_rows`` fills them.
Variants of a product that differ in tiling, vectorising or threading are the same logical operator here; ``hint``
carries what a caller may want to say about the physical side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hint:
    """Physical wishes. ``salt`` > 1 spreads the rows of hub indices; ``small_right`` asks for a broadcast of the dense
    operand, which is made if the plan's own bound of its size is below ``max_broadcast_bytes``."""

    salt: int = 1
    small_right: bool = False
    max_broadcast_bytes: int = 64 << 20


def _right(x: DataFrame, hint: Hint) -> DataFrame:
    if hint.small_right and int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= hint.max_broadcast_bytes:
        return F.broadcast(x)
    return x


def _joined(e: DataFrame, x: DataFrame, hint: Hint) -> DataFrame:
    """Edges with the operand's rows on j. Salting copies the operand's row to each salt of its index."""
    if hint.salt > 1:
        salts = F.explode(F.sequence(F.lit(0), F.lit(hint.salt - 1)))
        e = e.withColumn("_s", F.pmod(F.xxhash64("i", "j"), F.lit(hint.salt)).cast("int"))
        return e.join(x.withColumn("_s", salts), ["j", "_s"]).drop("_s")
    return e.join(_right(x, hint), "j")


def packed_cells(x: DataFrame, *keys: str) -> DataFrame:
    """Long form with one row per ``keys``: its columns ``_k`` and values ``_x``. A missing cell stays missing."""
    r = x.groupBy(*keys).agg(F.collect_list(F.struct("k", "x")).alias("_r"))
    return r.select(*keys, F.col("_r.k").alias("_k"), F.col("_r.x").alias("_x"))


def unpacked_cells(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "_k", F.posexplode("_x").alias("_p", "x")).select(*keys, F.get("_k", F.col("_p")).alias("k"), "x")


def cells_by_row(e: DataFrame, x: DataFrame, hint: Hint = Hint()) -> DataFrame:
    """Each entry of ``i, j, v`` with the cells of its operand row, ``i, _s, v, k, x``, dealt out by i (and the salt _s): a
    task holds the sums of its own rows only, where sums taken before a shuffle by i are of nearly every row in each task."""
    salt = F.pmod(F.xxhash64("j"), F.lit(hint.salt)).cast("int")
    there = _joined(e, packed_cells(x, "j"), hint).select("i", salt.alias("_s"), "v", "_k", "_x")
    return unpacked_cells(there.repartition(*(["i", "_s"] if hint.salt > 1 else ["i"])), "i", "_s", "v")


def spmm(e: DataFrame, x: DataFrame, hint: Hint = Hint()) -> DataFrame:
    """M1: ``C[i,k] = sum_j A[i,j] X[j,k]`` in long form (``i, k, x``)."""
    c = cells_by_row(e, x, hint)
    if hint.salt > 1:
        return c.groupBy("i", "_s", "k").agg(F.sum(F.col("v") * F.col("x")).alias("x")).groupBy("i", "k").agg(F.sum("x").alias("x"))
    return c.groupBy("i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def spmm_rows(e: DataFrame, x: DataFrame, width: int, hint: Hint = Hint(), block: int = 128) -> DataFrame:
    """M1 in row form: one row per i shuffles after partial sums of all ``width`` columns. Rows wider than ``block`` are
    summed in blocks of columns, one row per i and block, so that generated code keeps its size; a second grouping by i,
    of sums only, puts a row's blocks together."""
    c = _joined(e, x, hint)
    sums = [F.sum(F.col("v") * F.get("x", F.lit(k))).alias(f"_{k}") for k in range(min(width, block))]
    row = F.array(*[f"_{k}" for k in range(min(width, block))])
    if width <= block:
        return c.groupBy("i").agg(*sums).select("i", row.alias("x"))
    parts = F.array(*(F.slice("x", at + 1, min(block, width - at)) for at in range(0, width, block)))
    blocks = c.select("i", "v", F.posexplode(parts).alias("_b", "x")).groupBy("i", "_b").agg(*sums)
    packed = blocks.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("_b", row.alias("x")))).alias("_r"))
    return packed.select("i", F.slice(F.flatten("_r.x"), 1, width).alias("x"))


def as_operand(c: DataFrame) -> DataFrame:
    """A result ``i, ...`` as the right operand ``j, ...`` of a next product."""
    return c.withColumnRenamed("i", "j")


def spmm_spmm(a: DataFrame, b: DataFrame, x: DataFrame, transpose_second: bool = False, hint: Hint = Hint()) -> DataFrame:
    """M2: ``D = B (A X)``; ``transpose_second`` scatters through the columns of B instead, ``Bᵀ (A X)``."""
    if transpose_second:
        b = b.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return spmm(b, as_operand(spmm(a, x, hint)), hint)


def spmm_spmm_rows(a: DataFrame, b: DataFrame, x: DataFrame, width: int, hint: Hint = Hint()) -> DataFrame:
    return spmm_rows(b, as_operand(spmm_rows(a, x, width, hint)), width, hint)


def spmm_spmm_tile_fused(a: DataFrame, x: DataFrame, tile: int) -> DataFrame:
    """M2 with B = A, by tiles of rows: a row of an operand is copied once to each tile that needs it, whole, with the
    tile's entries for it, and the tile takes its sums there. Rows of the first product are made once, by their own tile,
    and copied like those of X: making halo rows again in each tile multiplies A's entries by the tiles that need them."""
    t = F.floor(F.col("i") / tile).alias("_t")
    uses = a.groupBy(t, "j").agg(F.collect_list(F.struct("i", "v")).alias("_u"))

    def sums(rows: DataFrame) -> DataFrame:
        there = uses.join(rows, "j").repartition("_t").select("_t", F.explode("_u").alias("_u"), "_k", "_x")
        cells = unpacked_cells(there.select("_t", "_u.i", "_u.v", "_k", "_x"), "_t", "i", "v")
        return cells.groupBy("_t", "i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("x"))

    made = packed_cells(sums(packed_cells(x, "j")), "_t", "i").select(F.col("i").alias("j"), "_k", "_x")
    return sums(made).select("i", "k", "x")


def spmv(e: DataFrame, x: DataFrame, hint: Hint = Hint()) -> DataFrame:
    """M3: ``y = A x`` as ``i, x``."""
    return _joined(e, x, hint).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def spmv_segmented(e: DataFrame, x: DataFrame) -> DataFrame:
    """M3 as elementwise products, then a sum over each row's segment."""
    return e.join(x, "j").withColumn("prod", F.col("v") * F.col("x")).groupBy("i").agg(F.sum("prod").alias("x"))


def spmv_spmv(a: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """M4: ``d = B (A x)``."""
    return spmv(b, as_operand(spmv(a, x)))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gemm(x: DataFrame, w: DataFrame, weight_layout: str = "in_out", activation: str | None = None, hint: Hint = Hint(small_right=True)) -> DataFrame:
    """M5: ``X W`` for X in long form ``j, k, x`` and weights ``k, c, w``; the result is ``j, k, x`` again.

    ``weight_layout="out_in"`` reads the weights' first index as the output column.
    """
    if weight_layout == "out_in":
        w = w.select(F.col("c").alias("k"), F.col("k").alias("c"), "w")
    elif weight_layout != "in_out":
        raise ValueError(weight_layout)
    y = x.join(_right(w, hint), "k").groupBy("j", "c").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    value = leaky_relu(F.col("x")) if activation == "leaky_relu" else relu(F.col("x")) if activation == "relu" else F.col("x")
    return y.select("j", F.col("c").alias("k"), value.alias("x"))


def gemm_rows(x: DataFrame, weights: list[list[float]]) -> DataFrame:
    """M5 on rows ``j, x`` with small in-by-out weights held as literals: a projection, no shuffle."""
    out = [vec_dot(F.col("x"), F.array(*(F.lit(float(w)) for w in col))) for col in zip(*weights)]
    return x.select("j", F.array(*out).alias("x"))


def gemm_spmm(a: DataFrame, x: DataFrame, w: DataFrame, weight_layout: str = "in_out", hint: Hint = Hint()) -> DataFrame:
    """M6: ``A (X W)``."""
    return spmm(a, gemm(x, w, weight_layout), hint)


def spmm_gemm(a: DataFrame, x: DataFrame, w: DataFrame, weight_layout: str = "in_out", hint: Hint = Hint()) -> DataFrame:
    """M6': ``(A X) W``, the same product."""
    return gemm(as_operand(spmm(a, x, hint)), w, weight_layout).withColumnRenamed("j", "i")


def triple_product(a: DataFrame, x: DataFrame, w: DataFrame) -> DataFrame:
    """M6d, unfactored: one sum over both contracted indices after both joins."""
    return a.join(x, "j").join(w, "k").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("x") * F.col("w")).alias("x")).withColumnRenamed("c", "k")


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def _sampled(s: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    left = u.select(F.col("j").alias("i"), F.col("x").alias("_u"))
    right = v.select("j", F.col("x").alias("_v"))
    return s.join(left, "i").join(right, "j").withColumn("_d", vec_dot(F.col("_u"), F.col("_v")))


def sddmm(s: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """M7: ``S[i,j] <U[i], V[j]>`` on the pattern of S; dense rows are ``j, x array``."""
    return _sampled(s, u, v).select("i", "j", (F.col("v") * F.col("_d")).alias("v"))


def sampled_addmm(s: DataFrame, u: DataFrame, v: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """``beta S[i,j] + alpha <U[i], V[j]>`` on the pattern of S."""
    return _sampled(s, u, v).select("i", "j", (F.col("v") * beta + F.col("_d") * alpha).alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """M8: elementwise product of two sparse matrices."""
    return a.join(b.withColumnRenamed("v", "_w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_w")).alias("v"))


def dense_rows(c: DataFrame, n: int, k: int) -> DataFrame:
    """Fill the missing cells of ``i, k, x`` with 0, for n rows and k columns."""
    grid = c.sparkSession.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("k"))
    return grid.join(c, ["i", "k"], "left").select("i", "k", F.coalesce("x", F.lit(0.0)).alias("x"))


def rows_of(x: DataFrame, index: str = "j") -> DataFrame:
    """Long form to row form; absent columns must not occur."""
    return x.groupBy(index).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("r")).select(index, F.col("r.x").alias("x"))


def long_of(x: DataFrame, index: str = "j") -> DataFrame:
    return x.select(index, F.posexplode("x").alias("k", "x")).select(index, F.col("k").cast("long").alias("k"), "x")
