"""Graph, feature and log tables derived from the test tables, in Spark and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.structure import banded, symmetrise

DIM, OUT = 64, 8
IMPLS = ["UnFusedParallel", "FusedParallel", "MKL"]
TILES = [16, 64, 256]
TRIALS = 7


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def e_rand(self) -> DataFrame:
        li = self.table("lineitem").where("l_linenumber = 1")
        return li.select((F.col("l_partkey") % self.n).alias("i"), (F.col("l_orderkey") % self.n).alias("j")).distinct().withColumn("v", F.lit(1.0))

    @cached_property
    def e_hole(self) -> DataFrame:
        return self.e_rand.where("i % 17 <> 5 and j % 19 <> 3")

    @cached_property
    def e_w(self) -> DataFrame:
        return self.e_hole.select("i", "j", (((31 * F.col("i") + 17 * F.col("j")) % 7 + 1) / 8.0).alias("v"))

    @cached_property
    def e_local(self) -> DataFrame:
        near = F.least(64 * F.floor(F.col("i") / 64) + F.col("j") % 64, F.lit(self.n - 1))
        moved = self.e_rand.where("i % 17 <> 5").select("i", F.when(F.col("i") % 3 != 0, near).otherwise(F.col("j")).alias("j"))
        return moved.distinct().withColumn("v", F.lit(1.0))

    @cached_property
    def e_sym(self) -> DataFrame:
        return symmetrise(self.e_hole)

    @cached_property
    def e_solve(self) -> DataFrame:
        """Off-diagonal 1/64 and a unit diagonal: Jacobi converges."""
        off = self.e_hole.where("i <> j").select("i", "j", F.lit(1 / 64).alias("v"))
        return off.union(self.spark.range(self.n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")))

    def band(self, width: int) -> DataFrame:
        return banded(self.spark, self.n, width)

    @cached_property
    def x(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("j"), F.posexplode("embedding").alias("k", "x")).select("j", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))

    @cached_property
    def xv(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("j"), F.col("embedding").cast("array<double>").alias("x"))

    @cached_property
    def vec(self) -> DataFrame:
        return self.spark.range(self.n).select(F.col("id").alias("j"), ((F.col("id") % 5 + 1) / 4.0).alias("x"))

    @cached_property
    def w(self) -> DataFrame:
        k = self.spark.range(DIM).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OUT - 1).cast("long"))).alias("c"))
        return k.withColumn("w", ((13 * F.col("k") + 7 * F.col("c")) % 11 - 5) / 16.0)

    @property
    def weights(self) -> list[list[float]]:
        return [[((13 * k + 7 * c) % 11 - 5) / 16.0 for c in range(OUT)] for k in range(DIM)]

    @cached_property
    def y(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("i"), (F.col("label") % OUT).cast("long").alias("y"))

    @cached_property
    def sampled(self) -> DataFrame:
        return self.spark.range(self.n).select(F.col("id").alias("i")).where("i % 5 = 2")

    @cached_property
    def log(self) -> DataFrame:
        """Wide benchmark log; one (matrix, implementation) is missing, and one lacks a tile size."""
        sup = self.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("sup"))
        base = self.table("nation").join(sup, "n_nationkey", "left").select("n_nationkey", F.coalesce("sup", F.lit(0)).alias("sup"))
        impl = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("name")) for k, x in enumerate(IMPLS)])).alias("impl")
        rows = base.select("*", impl).select("*", F.explode(F.array(*map(F.lit, TILES))).alias("MTile"))
        rows = rows.where("not (n_nationkey = 3 and impl.k = 2) and not (n_nationkey = 5 and impl.k = 1 and MTile = 16)")
        nat = F.col("n_nationkey")
        time = lambda k: (((F.col("sup") * 13 + nat * 7) * (F.col("impl.k") + 1) + F.col("MTile") + 5 * k) % 97 + 1) / 8.0
        return rows.select(
            F.concat((nat % 9 * 2 + 1).cast("string"), F.lit("_banded_"), (nat * 100 + 1000).cast("string")).alias("MatrixName"), F.col("impl.name").alias("Implementation Name"), (nat * 5000 + 20000).cast("long").alias("NNZ"),
            F.lit(32).alias("bCols"), "MTile", *[time(k).alias(f"Trial{k} Subregion0 Executor") for k in range(TRIALS)], ((nat * 371 + F.col("MTile") * (F.col("impl.k") + 1)) % 9000).cast("long").alias("Number of Fused nnz0"),
        )


_TIME = ", ".join(f'(((sup * 13 + n_nationkey * 7) * (ik + 1) + MTile + {5 * k}) % 97 + 1) / 8.0 AS "Trial{k} Subregion0 Executor"' for k in range(TRIALS))

CTE = f"""
  n AS (SELECT count(*) AS n FROM embeddings),
  e_rand AS (SELECT DISTINCT cast(l_partkey % n AS BIGINT) AS i, cast(l_orderkey % n AS BIGINT) AS j, 1.0::DOUBLE AS v FROM lineitem, n WHERE l_linenumber = 1),
  e_hole AS (SELECT * FROM e_rand WHERE i % 17 <> 5 AND j % 19 <> 3),
  e_w AS (SELECT i, j, ((31 * i + 17 * j) % 7 + 1)::DOUBLE / 8.0 AS v FROM e_hole),
  e_local AS (SELECT DISTINCT i, CASE WHEN i % 3 <> 0 THEN least(64 * (i // 64) + j % 64, n - 1) ELSE j END AS j, 1.0::DOUBLE AS v FROM e_rand, n WHERE i % 17 <> 5),
  e_sym AS (SELECT i, j, 1.0::DOUBLE AS v FROM e_hole UNION SELECT j, i, 1.0::DOUBLE FROM e_hole),
  ids AS (SELECT unnest(range(n)) AS i FROM n),
  e_solve AS (SELECT i, j, 1.0::DOUBLE / 64 AS v FROM e_hole WHERE i <> j UNION ALL SELECT i, i, 1.0::DOUBLE FROM ids),
  x AS (SELECT vec_id AS j, k, embedding[k + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range({DIM})) AS k FROM embeddings)),
  vec AS (SELECT i AS j, (i % 5 + 1)::DOUBLE / 4.0 AS x FROM ids),
  w AS (SELECT k, c, ((13 * k + 7 * c) % 11 - 5)::DOUBLE / 16.0 AS w FROM (SELECT unnest(range({DIM})) AS k), (SELECT unnest(range({OUT})) AS c)),
  y AS (SELECT vec_id AS i, (label % {OUT})::BIGINT AS y FROM embeddings),
  sampled AS (SELECT i FROM ids WHERE i % 5 = 2),
  sup AS (SELECT s_nationkey AS n_nationkey, count(*) AS sup FROM supplier GROUP BY 1),
  base AS (SELECT n_nationkey, coalesce(sup, 0) AS sup FROM nation LEFT JOIN sup USING (n_nationkey)),
  impl AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(IMPLS))}) t(ik, iname)),
  tiles AS (SELECT unnest({TILES}) AS MTile),
  log AS (
    SELECT (n_nationkey % 9 * 2 + 1) || '_banded_' || (n_nationkey * 100 + 1000) AS MatrixName, iname AS "Implementation Name", (n_nationkey * 5000 + 20000)::BIGINT AS NNZ, 32 AS bCols, MTile::INTEGER AS MTile,
      {_TIME}, ((n_nationkey * 371 + MTile * (ik + 1)) % 9000)::BIGINT AS "Number of Fused nnz0"
    FROM base, impl, tiles WHERE NOT (n_nationkey = 3 AND ik = 2) AND NOT (n_nationkey = 5 AND ik = 1 AND MTile = 16)),
  long AS (UNPIVOT log ON {", ".join(f'"Trial{k} Subregion0 Executor"' for k in range(TRIALS))} INTO NAME trial VALUE time),
  med AS (SELECT MatrixName, "Implementation Name", bCols, MTile, median(time) AS median FROM long GROUP BY ALL)
"""
