"""Reports over the benchmark log."""

from pyspark.sql import functions as F

from tessel import reports as R
from tessel.sources.matrix import shards

from . import query, r6, s6
from .fixtures import IMPLS

K = '"Implementation Name"'
_SPEED = f"sp AS (SELECT a.MatrixName, a.{K}, a.bCols, a.MTile, a.median, b.median / a.median AS speedup FROM med a JOIN med b ON a.MatrixName = b.MatrixName AND a.bCols = b.bCols AND a.MTile = b.MTile AND b.{K} = 'UnFusedParallel' WHERE a.{K} <> 'UnFusedParallel')"


def speedups(f):
    return R.speedup(R.medians(f.log), "UnFusedParallel", ["MatrixName", "bCols", "MTile"])


@query("log_filter", f"SELECT MatrixName, MTile, NNZ FROM log WHERE {K} = 'MKL' AND MTile IN (16, 64)")
def _(f):
    return R.where(f.log, Implementation_Name="MKL", MTile=[16, 64]).select("MatrixName", "MTile", "NNZ")


@query("log_large_only", "SELECT DISTINCT MatrixName, NNZ FROM log WHERE NNZ >= 50000 AND NOT MatrixName LIKE '%3000'")
def _(f):
    return R.large_only(f.log, suffix="3000").select("MatrixName", "NNZ").distinct()


@query("log_medians", "SELECT * FROM med")
def _(f):
    return R.medians(f.log)


@query("log_row_medians", f"SELECT MatrixName, {K}, MTile, median FROM med")
def _(f):
    return R.row_medians(f.log).select("MatrixName", "Implementation Name", "MTile", "median")


@query("log_complete_matrices", f"SELECT MatrixName FROM log GROUP BY MatrixName HAVING count(DISTINCT ({K}, MTile)) = (SELECT count(DISTINCT ({K}, MTile)) FROM log)")
def _(f):
    return R.complete_matrices(f.log, ["Implementation Name", "MTile"])


@query("log_group_min", f"SELECT MatrixName, {K}, bCols, min(median) AS median FROM med GROUP BY ALL")
def _(f):
    return R.best(R.medians(f.log), ["MatrixName", "Implementation Name", "bCols"])


@query("log_best_fused", f"SELECT MatrixName, max(\"Number of Fused nnz0\") AS fused_nnz, arg_min(MTile, (-\"Number of Fused nnz0\", MTile)) AS MTile, {s6('max(\"Number of Fused nnz0\") / any_value(NNZ)::DOUBLE', 'ratio')} FROM log GROUP BY MatrixName")
def _(f):
    return R.best_fused(f.log).select("MatrixName", "fused_nnz", "MTile", r6("ratio", "ratio"))


@query("log_speedup", f"SELECT MatrixName, {K}, MTile, {s6('speedup', 'speedup')} FROM sp", _SPEED)
def _(f):
    return speedups(f).select("MatrixName", "Implementation Name", "MTile", r6("speedup", "speedup"))


@query("log_speedup_summary", f"SELECT {K}, {s6('exp(avg(ln(speedup)))', 'gmean')}, {s6('max(speedup)', 'best')}, {s6('min(speedup)', 'worst')}, {s6('avg((speedup > 1)::INTEGER)', 'share_faster')} FROM sp GROUP BY {K}", _SPEED)
def _(f):
    return R.speedup_summary(speedups(f), ["Implementation Name"]).select("Implementation Name", *[r6(c, c) for c in ("gmean", "best", "worst", "share_faster")])


@query("log_timing_matrix", "SELECT MatrixName, " + ", ".join(f"min(median) FILTER ({K} = '{x}') AS \"{x}\"" for x in IMPLS) + " FROM med GROUP BY MatrixName")
def _(f):
    return R.timing_matrix(R.medians(f.log), IMPLS)


@query("log_cost_model", f"SELECT MatrixName, MTile, {s6('(4 * NNZ * bCols)::DOUBLE / (4 * (NNZ - \"Number of Fused nnz0\") * bCols)', 'cost')}, (MTile + split_part(MatrixName, '_', 1)::BIGINT) * bCols AS active FROM log WHERE {K} = 'FusedParallel'")
def _(f):
    c = R.where(f.log, Implementation_Name="FusedParallel")
    return c.select("MatrixName", "MTile", r6(R.cost_nnz(F.col("NNZ"), F.col("bCols"), F.col("Number of Fused nnz0")), "cost"), R.active_data(F.col("MTile"), F.col("bCols")).alias("active"))


@query("log_cost_correlation", "SELECT MatrixName, CASE WHEN stddev_pop(\"Number of Fused nnz0\") * stddev_pop(speedup) > 0 THEN round(covar_pop(\"Number of Fused nnz0\", speedup) / (stddev_pop(\"Number of Fused nnz0\") * stddev_pop(speedup)), 4) + 0.0 END AS corr FROM sp JOIN log USING (MatrixName, \"Implementation Name\", MTile) GROUP BY MatrixName HAVING count(*) > 3", _SPEED)
def _(f):
    both = speedups(f).join(f.log.select("MatrixName", "Implementation Name", "MTile", F.col("Number of Fused nnz0").alias("cost")), ["MatrixName", "Implementation Name", "MTile"])
    enough = both.groupBy("MatrixName").count().where("count > 3").select("MatrixName")
    return R.cost_correlation(both.join(enough, "MatrixName")).select("MatrixName", (F.round("corr", 4) + F.lit(0.0)).alias("corr"))


@query("log_tile_frequency", "SELECT MTile, count(*) AS n FROM (SELECT MatrixName, arg_min(MTile, (-\"Number of Fused nnz0\", MTile)) AS MTile FROM log GROUP BY MatrixName) GROUP BY MTile")
def _(f):
    return R.tile_frequency(R.best_fused(f.log))


@query("log_slow_report", f"SELECT MatrixName, {s6('speedup', 'speedup')}, max_fused FROM (SELECT MatrixName, max(speedup) AS speedup FROM sp WHERE {K} = 'FusedParallel' GROUP BY MatrixName) JOIN (SELECT MatrixName, max(\"Number of Fused nnz0\") AS max_fused FROM log GROUP BY MatrixName) USING (MatrixName) WHERE speedup < 0.8", _SPEED)
def _(f):
    b = speedups(f).where(F.col("Implementation Name") == "FusedParallel").groupBy("MatrixName").agg(F.max("speedup").alias("speedup"))
    return R.slow_report(b, f.log).select("MatrixName", r6("speedup", "speedup"), "max_fused")


@query("log_gflops", f"SELECT MatrixName, {K}, MTile, round(2 * NNZ * bCols / 1e9::DOUBLE / median * 1e6, 6) AS mflops FROM log JOIN med USING (MatrixName, {K}, bCols, MTile)")
def _(f):
    return R.row_medians(f.log).select("MatrixName", "Implementation Name", "MTile", F.round(R.gflops(F.col("NNZ"), F.col("bCols"), F.col("median")) * 1e6, 6).alias("mflops"))


@query("log_configured_report", f"SELECT MatrixName, {K}, {s6('b.median / a.median', 'speedup')} FROM (SELECT MatrixName, {K}, min(median) AS median FROM med WHERE {K} = 'FusedParallel' GROUP BY ALL) a JOIN (SELECT MatrixName, median FROM med WHERE {K} = 'MKL' AND MTile = 64) b USING (MatrixName)")
def _(f):
    conf = {"baseline": "MKL", "implementations": {"FusedParallel": {}, "MKL": {"params": {"MTile": 64}}}}
    return R.configured(f.log, conf).select("MatrixName", "Implementation Name", r6("speedup", "speedup"))


@query("log_list_shards", "SELECT (row_number() OVER (ORDER BY name) - 1) // ceil(count(*) OVER () / 10.0)::BIGINT AS file, name FROM (SELECT DISTINCT MatrixName AS name FROM log)")
def _(f):
    return shards(f.log.select(F.col("MatrixName").alias("name")).distinct())


@query("log_distinct_sorted", "SELECT DISTINCT NNZ FROM log ORDER BY NNZ")
def _(f):
    return f.log.select("NNZ").distinct().orderBy("NNZ")
