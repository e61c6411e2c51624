"""Jacobi iteration on edge tables. Vectors and blocks of vectors are long form ``i, c, x``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import cut

from .structure import normalised_row_sums, split_diagonal


def rhs_from_row_sums(e: DataFrame, columns: int) -> DataFrame:
    """Normalised row sums, the same in each column."""
    cols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")))
    return normalised_row_sums(e).select("i", cols.alias("c"), "x")


def jacobi_step(off: DataFrame, diag: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """``(b - R x) / d``; rows whose R is empty get ``b / d``."""
    rx = off.join(x.select(F.col("i").alias("j"), "c", "x"), "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("x")).alias("rx"))
    return b.join(diag, "i").join(rx, ["i", "c"], "left").select("i", "c", ((F.col("x") - F.coalesce("rx", F.lit(0.0))) / F.col("d")).alias("x"))


def residual(a: DataFrame, b: DataFrame) -> DataFrame:
    """Infinity norm of the difference; a missing cell is 0."""
    both = a.select("i", "c", F.col("x").alias("_a")).join(b.select("i", "c", F.col("x").alias("_b")), ["i", "c"], "full")
    return both.agg(F.coalesce(F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("residual"))


def jacobi_steps(e: DataFrame, b: DataFrame, steps: int) -> DataFrame:
    """A fixed number of steps from x = 0, as one lazy plan."""
    diag, off = split_diagonal(e)
    x = b.join(diag, "i").select("i", "c", (F.col("x") / F.col("d")).alias("x"))
    for _ in range(steps - 1):
        x = jacobi_step(off, diag, b, x)
    return x


def jacobi_solve(e: DataFrame, b: DataFrame, eps: float = 1e-30, max_iter: int = 1000, fused: bool = False) -> tuple[DataFrame, int]:
    """One step from 0, then up to ``max_iter`` more until successive iterates differ by less than eps.

    Returns the iterate and the number of the step after which it settled (0 if it did not). ``fused`` runs two steps
    for each test, and so settles at an even count of them.
    """
    columns = sorted(r["c"] for r in b.select("c").distinct().collect())
    if not columns:
        return b.select("i", "c", "x"), 2 if max_iter > 0 else 0
    at = range(len(columns))
    diag, off = split_diagonal(e)
    # entries are dealt out once, by the row of the iterate that they meet; such a row holds all columns of the block
    off = off.select("i", "j", "v").repartition(max(1, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "j").persist()
    rhs = F.array(*(F.max(F.when(F.col("c") == F.lit(c), F.col("x"))) for c in columns)).alias("b")
    fixed = b.join(diag, "i").groupBy("i").agg(F.first("d").alias("d"), rhs)
    first = F.transform("b", lambda r: r / F.col("d"))
    state = cut(fixed.select("i", "d", "b", first.alias("x"), first.alias("was")))

    def step(s: DataFrame) -> DataFrame:
        """One more iterate; cells that the right-hand side lacks stay null."""
        met = off.join(s.select(F.col("i").alias("j"), F.col("x").alias("_x")), "j")
        rx = met.groupBy("i").agg(F.array(*(F.sum(F.col("v") * F.get("_x", F.lit(k))) for k in at)).alias("_rx"))
        now = F.transform("b", lambda r, k: (r - F.coalesce(F.get("_rx", k), F.lit(0.0))) / F.col("d"))
        return s.join(rx, "i", "left").select("i", "d", "b", now.alias("_now"), F.col("x").alias("was")).withColumnRenamed("_now", "x")

    apart = F.array_max(F.zip_with("x", "was", lambda p, q: F.abs(p - q)))
    done, i = 0, 0
    while i < max_iter:
        # the iterate and the one before it are written together, so that neither is made again for the residual
        state = cut(step(step(state)) if fused else step(state), state)
        i += 2 if fused else 1
        if state.agg(F.coalesce(F.max(apart), F.lit(0.0))).first()[0] < eps:
            done = i if fused else i + 1
            break
    off.unpersist()
    cells = F.explode(F.array(*(F.struct(F.lit(c).cast(b.schema["c"].dataType).alias("c"), F.get("x", F.lit(k)).alias("x")) for k, c in zip(at, columns))))
    x = state.select("i", cells.alias("_c")).select("i", "_c.c", "_c.x").where("x is not null")
    return x, done
