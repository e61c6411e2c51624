"""Relational reports over benchmark logs (``MatrixName``, ``Implementation Name``, ``NNZ``, ``bCols``, ``MTile``, trial
columns ``Trial{k} Subregion0 Executor`` and fused counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX, IMPL = "MatrixName", "Implementation Name"
KEYS = [MATRIX, IMPL, "bCols", "MTile"]


def where(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of equalities; a list means one of. Underscores in names stand for spaces where no such column is."""
    for k, v in equal.items():
        c = F.col(f"`{k if k in df.columns else k.replace('_', ' ')}`")
        df = df.where(c.isin(v) if isinstance(v, list) else c == v)
    return df


def trials(df: DataFrame) -> DataFrame:
    """Wide to long: ``time`` for each trial."""
    cols = [c for c in df.columns if c.startswith("Trial") and c.endswith("Subregion0 Executor")]
    return df.unpivot([c for c in df.columns if c not in cols], cols, "trial", "time").where("time is not null")


def medians(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Exact median over the trials of all rows of a key."""
    return trials(df).groupBy(*keys).agg(F.percentile("time", 0.5).alias("median"))


def row_medians(df: DataFrame) -> DataFrame:
    """Median of each row's trials as ``median``."""
    cols = [c for c in df.columns if c.startswith("Trial") and c.endswith("Subregion0 Executor")]
    s = F.array_sort(F.filter(F.array(*[F.col(f"`{c}`") for c in cols]), lambda x: x.isNotNull()))
    n = F.size(s)
    return df.withColumn("median", (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)


def complete_matrices(df: DataFrame, params: list[str]) -> DataFrame:
    """Relational division: matrices that have every combination of implementation and parameters."""
    of = [F.col(f"`{c}`") for c in params]
    total = df.select(*of).distinct().agg(F.count("*").alias("_total"))
    have = df.select(MATRIX, *of).distinct().groupBy(MATRIX).agg(F.count("*").alias("_have"))
    return have.join(F.broadcast(total), F.col("_have") == F.col("_total")).select(MATRIX)


def best(times: DataFrame, keys: list[str]) -> DataFrame:
    """Least median over the remaining parameters."""
    return times.groupBy(*keys).agg(F.min("median").alias("median"))


def best_fused(df: DataFrame, by: str = "Number of Fused nnz0") -> DataFrame:
    """For each matrix the row with most fused entries; ties go to the least tile."""
    pick = F.max(F.struct(F.col(f"`{by}`").alias("fused"), (-F.col("MTile")).alias("tile"), F.col("NNZ").alias("nnz"))).alias("b")
    return df.groupBy(MATRIX).agg(pick).select(MATRIX, F.col("b.fused").alias("fused_nnz"), (-F.col("b.tile")).alias("MTile"), F.try_divide(F.col("b.fused").cast("double"), F.col("b.nnz")).alias("ratio"))


def speedup(times: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """``speedup`` of each implementation over the baseline with the same keys."""
    base = times.where(F.col(IMPL) == baseline).select(*keys, F.col("median").alias("base"))
    return times.where(F.col(IMPL) != baseline).join(base, keys).withColumn("speedup", F.col("base") / F.col("median"))


def speedup_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Geometric mean, extremes and share above 1."""
    s = F.col("speedup")
    return df.groupBy(*by).agg(F.exp(F.avg(F.log(s))).alias("gmean"), F.max(s).alias("best"), F.min(s).alias("worst"), F.avg((s > 1).cast("double")).alias("share_faster"))


def timing_matrix(times: DataFrame, impls: list[str]) -> DataFrame:
    """Matrices by implementations."""
    return times.groupBy(MATRIX).pivot(IMPL, impls).agg(F.min("median"))


def cost_nnz(nnz: Column, width: Column, fused: Column) -> Column:
    """Reads saved by fusion: ``4 nnz b / (4 (nnz - fused) b)``."""
    return F.try_divide((4 * nnz * width).cast("double"), 4 * (nnz - fused) * width)


def active_data(tile: Column, width: Column) -> Column:
    """``(tile + band) b``, the band being the number before the first underscore of the matrix name."""
    return (tile + F.split(MATRIX, "_")[0].cast("long")) * width


def cost_correlation(df: DataFrame) -> DataFrame:
    """Correlation of ``cost`` and ``speedup`` for each matrix; null where either does not vary."""
    spread = F.stddev_pop("cost") * F.stddev_pop("speedup")
    return df.groupBy(MATRIX).agg(F.try_divide(F.covar_pop("cost", "speedup"), F.when(spread > 0, spread)).alias("corr"))


def slow_report(best_speedup: DataFrame, df: DataFrame, below: float = 0.8) -> DataFrame:
    """Matrices whose best speed-up is below the bound, with their most fused entries."""
    most = df.groupBy(MATRIX).agg(F.max("Number of Fused nnz0").alias("max_fused"))
    return best_speedup.where(F.col("speedup") < below).join(most, MATRIX)


def tile_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("MTile").agg(F.count("*").alias("n"))


def large_only(df: DataFrame, least: int = 50_000, suffix: str | None = None) -> DataFrame:
    """Matrices with enough entries, without names that end in the suffix."""
    out = df.where(F.col("NNZ") >= least)
    return out.where(~F.col(MATRIX).endswith(suffix)) if suffix else out


def gflops(nnz: Column, width: Column, seconds: Column) -> Column:
    return 2 * nnz * width / 1e9 / seconds


def configured(df: DataFrame, config: dict) -> DataFrame:
    """A report from a plain configuration: ``baseline``, ``implementations`` as ``{name: {params, tuned}}``: tuned ones
    take their best parameters."""
    out = None
    times = medians(df)
    for name, c in config["implementations"].items():
        one = where(times, **{IMPL: name}, **c.get("params", {}))
        one = best(one, [MATRIX, IMPL, "bCols"])
        out = one if out is None else out.union(one)
    return speedup(out, config["baseline"], [MATRIX, "bCols"])
