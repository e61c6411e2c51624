"""Structural operators, products and the solver."""

from pyspark.sql import functions as F

from tessel.operators import products as P
from tessel.operators import solver as J
from tessel.operators import structure as S
from tessel.plans import graph_product

from . import query, r6, s6
from .fixtures import DIM, OUT


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("s1_csr_rows", "SELECT i, string_agg(j, ',' ORDER BY j) AS cols, sum(v) AS total FROM e_w GROUP BY i")
def _(f):
    return S.csr_rows(f.e_w).select("i", joined("cols").alias("cols"), F.aggregate("vals", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("s1_csc_columns", "SELECT j, string_agg(i, ',' ORDER BY i) AS rows, sum(v) AS total FROM e_w GROUP BY j")
def _(f):
    return S.csc_columns(f.e_w).select("j", joined("rows").alias("rows"), F.aggregate("vals", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("s2_transpose", "SELECT j AS i, i AS j, v FROM e_w")
def _(f):
    return S.transpose(f.e_w)


@query("s3_lower_half", "SELECT * FROM e_w WHERE i >= j")
def _(f):
    return S.lower_half(f.e_w)


@query("s4_make_full", "SELECT * FROM e_w WHERE i >= j UNION ALL SELECT j, i, v FROM e_w WHERE i > j")
def _(f):
    return S.make_full(S.lower_half(f.e_w))


@query("s4_symmetrise", "SELECT * FROM e_sym")
def _(f):
    return f.e_sym


@query("s5_row_degree", "SELECT i, count(*) AS deg FROM e_w GROUP BY i")
def _(f):
    return S.row_degree(f.e_w)


@query("s6_normalised_row_sums", f"SELECT i, {s6('s / (SELECT max(abs(s)) FROM s)')} FROM s", "s AS (SELECT i, sum(v) AS s FROM e_w GROUP BY i)")
def _(f):
    return S.normalised_row_sums(f.e_w).select("i", r6())


@query("s6_max_abs", "SELECT max(abs(v)) AS max_abs FROM e_w")
def _(f):
    return S.max_abs(f.e_w)


@query("s7_zero_rows", "SELECT n - (SELECT count(DISTINCT i) FROM e_hole) AS zero_rows FROM n")
def _(f):
    return S.zero_rows(f.e_hole, f.n)


@query("s8_bandwidth", "SELECT max(w) AS bandwidth FROM (SELECT max(j) - min(j) AS w FROM e_local GROUP BY i)")
def _(f):
    return S.bandwidth(f.e_local)


@query("s9_density", f"SELECT count(*) AS nnz, {s6('count(*) / (any_value(n)::DOUBLE * any_value(n))', 'density')} FROM e_hole, n")
def _(f):
    return S.density(f.e_hole, f.n, f.n).select("nnz", r6("density", "density"))


# levels are distances from the seed of each component; places in a level follow from those in the level before
_RCM = """sy AS (SELECT i, j FROM e_sym WHERE i <> j), dg AS (SELECT ids.i, count(sy.j) AS deg FROM ids LEFT JOIN sy ON sy.i = ids.i GROUP BY ids.i),
  rch AS (SELECT i AS s, i FROM ids UNION SELECT s, sy.j FROM rch JOIN sy ON sy.i = rch.i), cmp AS (SELECT s AS i, min(i) AS comp FROM rch GROUP BY s),
  sd AS (SELECT comp, arg_min(i, (deg, i)) AS i FROM cmp JOIN dg USING (i) GROUP BY comp),
  lvl AS (SELECT i, 0 AS level FROM sd UNION SELECT sy.j, level + 1 FROM lvl JOIN sy ON sy.i = lvl.i WHERE level < 60), dst AS (SELECT i, min(level) AS level FROM lvl GROUP BY i),
  rk AS (SELECT comp, i, 0 AS level, 0::BIGINT AS rank FROM sd UNION ALL
    SELECT comp, i, level, row_number() OVER (PARTITION BY comp ORDER BY parent, deg, i) FROM (
      SELECT rk.comp, sy.j AS i, rk.level + 1 AS level, min(rk.rank) AS parent, any_value(dg.deg) AS deg
      FROM rk JOIN sy ON sy.i = rk.i JOIN dst ON dst.i = sy.j AND dst.level = rk.level + 1 JOIN dg ON dg.i = sy.j GROUP BY rk.comp, sy.j, rk.level)),
  rcm AS (SELECT i AS old, row_number() OVER (ORDER BY comp DESC, level DESC, rank DESC) - 1 AS new FROM rk)"""


@query("s10_reverse_cuthill_mckee", "SELECT old, new FROM rcm", _RCM)
def _(f):
    return S.reverse_cuthill_mckee(f.e_hole, f.n)


@query("s10_bandwidth_reordered", "SELECT (SELECT max(abs(i - j)) FROM e_sym) AS before, max(abs(p.new - q.new)) AS after FROM e_sym e JOIN rcm p ON p.old = e.i JOIN rcm q ON q.old = e.j", _RCM)
def _(f):
    moved = S.apply_permutation(f.e_sym, S.reverse_cuthill_mckee(f.e_hole, f.n))
    widest = lambda e: e.agg(F.max(F.abs(F.col("i") - F.col("j"))).alias("w"))
    return widest(f.e_sym).withColumnRenamed("w", "before").join(widest(moved).withColumnRenamed("w", "after"))


@query("s12_apply_permutation", "SELECT n - 1 - i AS i, n - 1 - j AS j, v FROM e_w, n")
def _(f):
    return S.apply_permutation(f.e_w, f.spark.range(f.n).select(F.col("id").alias("old"), (F.lit(f.n - 1) - F.col("id")).alias("new")))


_SCHED = """span AS (SELECT i, min(j) AS lo, max(j) AS hi, count(*) AS nnz FROM e_local GROUP BY i),
  fus AS (SELECT ids.i, ids.i // 64 AS tile, coalesce(nnz, 0) AS nnz, coalesce(lo // 64 = ids.i // 64 AND hi // 64 = ids.i // 64, true) AS fused FROM ids LEFT JOIN span USING (i)),
  unf AS (SELECT i, (row_number() OVER (ORDER BY i) - 1) // 64 AS part FROM fus WHERE NOT fused),
  raw AS (SELECT 0 AS level, tile AS part, 0 AS loop, i AS id FROM fus UNION ALL SELECT 0, tile, 1, i FROM fus WHERE fused UNION ALL SELECT 1, part, 1, i FROM unf),
  sched AS (SELECT level, part, row_number() OVER (PARTITION BY level, part ORDER BY loop, id) - 1 AS pos, loop, id FROM raw)"""


@query("s12_reorder_rows", "SELECT p.new AS i, j, v, i AS old_i FROM e_local JOIN p ON i = p.old", _SCHED + ", p AS (SELECT id AS old, row_number() OVER (ORDER BY level, part, pos) - 1 AS new FROM sched WHERE loop = 1)")
def _(f):
    from tessel.operators.schedule import fixed_tile_schedule

    return S.reorder_rows(f.e_local, fixed_tile_schedule(f.e_local, f.n, 64).where("loop = 1"))


@query("s14_set_diagonal", "SELECT i, j, v FROM e_w WHERE i <> j UNION ALL SELECT i, i, 1.0::DOUBLE FROM ids")
def _(f):
    return S.set_diagonal(f.e_w, f.n)


@query("s15_mask_rows", "SELECT * FROM e_w WHERE i IN (SELECT i FROM sampled)")
def _(f):
    return S.mask_rows(f.e_w, f.sampled).select("i", "j", "v")


@query("s16_expand_rows", "SELECT * FROM e_w")
def _(f):
    return S.expand_rows(S.csr_rows(f.e_w))


@query("s17_merge_graphs", "SELECT i, j, v FROM e_w UNION ALL SELECT i + n, j + n, v FROM e_local, n")
def _(f):
    return S.merge_graphs([(f.e_w, f.n), (f.e_local, f.n)])


@query("s18_split_diagonal", "SELECT i, j, v, 'r' AS part FROM e_solve WHERE i <> j UNION ALL SELECT i, j, v, 'd' FROM e_solve WHERE i = j")
def _(f):
    d, r = S.split_diagonal(f.e_solve)
    return r.withColumn("part", F.lit("r")).union(d.select("i", F.col("i").alias("j"), F.col("d").alias("v"), F.lit("d").alias("part")))


@query("coo_duplicates_summed", "SELECT i, j, sum(v) AS v FROM (SELECT i // 2 AS i, j // 2 AS j, v FROM e_w) GROUP BY i, j")
def _(f):
    return S.edges(f.e_w.select(F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j"), "v"))


_M1 = "m1 AS (SELECT i, k, sum(v * x) AS x FROM e_w JOIN x USING (j) GROUP BY i, k)"
_GEMM = "xw AS (SELECT j, c AS k, sum(x * w) AS x FROM x JOIN w USING (k) GROUP BY j, c)"


@query("m1_spmm", f"SELECT i, k, {s6('x')} FROM m1", _M1)
def _(f):
    return P.spmm(f.e_w, f.x).select("i", "k", r6())


@query("m1_spmm_rows", f"SELECT i, k, {s6('x')} FROM m1", _M1)
def _(f):
    return P.long_of(P.spmm_rows(f.e_w, f.xv, DIM), "i").select("i", "k", r6())


@query("m1_spmm_salted", f"SELECT i, k, {s6('x')} FROM m1", _M1)
def _(f):
    return P.spmm(f.e_w, f.x, P.Hint(salt=4)).select("i", "k", r6())


@query("m1_spmm_dense", f"SELECT ids.i, k, {s6('coalesce(m1.x, 0)')} FROM ids CROSS JOIN (SELECT unnest(range({DIM})) AS k) LEFT JOIN m1 USING (i, k)", _M1)
def _(f):
    return P.dense_rows(P.spmm(f.e_w, f.x), f.n, DIM).select("i", "k", r6())


_M2 = f"SELECT e.i, k, {s6('sum(v * x)')} FROM e_w e JOIN m1 ON e.j = m1.i GROUP BY e.i, k"


@query("m2_spmm_spmm", _M2, _M1)
def _(f):
    return P.spmm_spmm(f.e_w, f.e_w, f.x).select("i", "k", r6())


@query("m2_spmm_spmm_rows", _M2, _M1)
def _(f):
    return P.long_of(P.spmm_spmm_rows(f.e_w, f.e_w, f.xv, DIM), "i").select("i", "k", r6())


@query("m2_spmm_spmm_tile_fused", _M2, _M1)
def _(f):
    return P.spmm_spmm_tile_fused(f.e_w, f.x, 64).select("i", "k", r6())


@query("m2_spmm_spmm_scatter", f"SELECT e.j AS i, k, {s6('sum(v * x)')} FROM e_w e JOIN m1 ON e.i = m1.i GROUP BY e.j, k", _M1)
def _(f):
    return P.spmm_spmm(f.e_w, f.e_w, f.x, transpose_second=True).select("i", "k", r6())


_M3 = "m3 AS (SELECT i, sum(v * x) AS x FROM e_w JOIN vec USING (j) GROUP BY i)"


@query("m3_spmv", "SELECT * FROM m3", _M3)
def _(f):
    return P.spmv(f.e_w, f.vec)


@query("m3_spmv_segmented", "SELECT * FROM m3", _M3)
def _(f):
    return P.spmv_segmented(f.e_w, f.vec)


@query("m4_spmv_spmv", "SELECT e.i, sum(v * x) AS x FROM e_w e JOIN m3 ON e.j = m3.i GROUP BY e.i", _M3)
def _(f):
    return P.spmv_spmv(f.e_w, f.e_w, f.vec)


@query("m5_gemm", f"SELECT j, k, {s6('x')} FROM xw", _GEMM)
def _(f):
    return P.gemm(f.x, f.w).select("j", "k", r6())


@query("m5_gemm_rows", f"SELECT j, k, {s6('x')} FROM xw", _GEMM)
def _(f):
    return P.long_of(P.gemm_rows(f.xv, f.weights)).select("j", "k", r6())


@query("m5_gemm_leaky_relu", f"SELECT j, k, {s6('CASE WHEN x >= 0 THEN x ELSE x * 0.01::DOUBLE END')} FROM xw", _GEMM)
def _(f):
    return P.gemm(f.x, f.w, activation="leaky_relu").select("j", "k", r6())


_M6 = f"SELECT i, k, {s6('sum(v * x)')} FROM e_w JOIN xw USING (j) GROUP BY i, k"


@query("m6_gemm_spmm", _M6, _GEMM)
def _(f):
    return P.gemm_spmm(f.e_w, f.x, f.w).select("i", "k", r6())


@query("m6_gemm_spmm_out_in", _M6, _GEMM)
def _(f):
    return P.gemm_spmm(f.e_w, f.x, f.w.select(F.col("c").alias("k"), F.col("k").alias("c"), "w"), "out_in").select("i", "k", r6())


@query("m6_spmm_gemm", _M6, _GEMM)
def _(f):
    return P.spmm_gemm(f.e_w, f.x, f.w).select("i", "k", r6())


@query("m6_triple_product", _M6, _GEMM)
def _(f):
    return P.triple_product(f.e_w, f.x, f.w).select("i", "k", r6())


@query("m6_cheapest_order", _M6, _GEMM)
def _(f):
    return graph_product(f.e_w, f.x, f.w, 20 * f.n, f.n, DIM, OUT).select("i", "k", r6())


_DOT = "dot AS (SELECT e.i, e.j, v, sum(a.x * b.x) AS d FROM e_w e JOIN x a ON a.j = e.i JOIN x b ON b.j = e.j AND a.k = b.k GROUP BY e.i, e.j, v)"


@query("m7_sddmm", f"SELECT i, j, {s6('v * d', 'v')} FROM dot", _DOT)
def _(f):
    return P.sddmm(f.e_w, f.xv, f.xv).select("i", "j", r6("v", "v"))


@query("m7b_sampled_addmm", f"SELECT i, j, {s6('0.5 * v + 2 * d', 'v')} FROM dot", _DOT)
def _(f):
    return P.sampled_addmm(f.e_w, f.xv, f.xv, alpha=2.0, beta=0.5).select("i", "j", r6("v", "v"))


@query("m8_hadamard", "SELECT a.i, a.j, a.v * b.v AS v FROM e_w a JOIN e_local b ON a.i = b.i AND a.j = b.j")
def _(f):
    return P.hadamard(f.e_w, f.e_local)


_B = "bb AS (SELECT i, c, (i % 5 + 1 + c)::DOUBLE / 4.0 AS x FROM ids, (SELECT unnest(range(2)) AS c))"


def _rhs(f):
    return f.spark.range(f.n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("c")).withColumn("x", (F.col("i") % 5 + 1 + F.col("c")) / 4.0)


def _step(k):
    return f"x{k} AS (SELECT bb.i, bb.c, bb.x - coalesce(r.s, 0) AS x FROM bb LEFT JOIN (SELECT e.i, p.c, sum(e.v * p.x) AS s FROM e_solve e JOIN x{k - 1} p ON e.j = p.i WHERE e.i <> e.j GROUP BY e.i, p.c) r ON bb.i = r.i AND bb.c = r.c)"


@query("j1_jacobi_step", f"SELECT i, c, {s6('x')} FROM x1", _B + ", x0 AS (SELECT * FROM bb), " + _step(1))
def _(f):
    d, r = S.split_diagonal(f.e_solve)
    return J.jacobi_step(r, d, _rhs(f), _rhs(f)).select("i", "c", r6())


@query("j2_jacobi_six_steps", f"SELECT i, c, {s6('x')} FROM x5", _B + ", x0 AS (SELECT * FROM bb), " + ", ".join(_step(k) for k in range(1, 6)))
def _(f):
    return J.jacobi_steps(f.e_solve, _rhs(f), 6).select("i", "c", r6())


# every row has a diagonal entry, so each step is one aggregate
_SOLVE = (
    _B
    + """, it AS (SELECT 0 AS t, i, c, x FROM bb UNION ALL SELECT any_value(p.t) + 1, e.i, p.c, any_value(bb.x) - sum(CASE WHEN e.i <> e.j THEN e.v * p.x ELSE 0 END)
    FROM it p JOIN e_solve e ON e.j = p.i JOIN bb ON bb.i = e.i AND bb.c = p.c WHERE p.t < 40 GROUP BY e.i, p.c),
  rs AS (SELECT a.t, max(abs(a.x - b.x)) AS r FROM it a JOIN it b ON b.t = a.t - 1 AND b.i = a.i AND b.c = a.c GROUP BY a.t)"""
)


@query("j2_jacobi_solve", "SELECT i, c, round(x, 4) + 0.0 AS x FROM it WHERE t = (SELECT coalesce(min(t) FILTER (r < 1e-6), 40) FROM rs)", _SOLVE)
def _(f):
    x, _ = J.jacobi_solve(f.e_solve, _rhs(f), eps=1e-6, max_iter=40)
    return x.select("i", "c", (F.round("x", 4) + F.lit(0.0)).alias("x"))


@query("j3_jacobi_two_steps", "SELECT i, c, round(x, 4) + 0.0 AS x FROM it WHERE t = (SELECT coalesce(min(t) FILTER (r < 1e-3), 40) FROM rs WHERE t % 2 = 0)", _SOLVE)
def _(f):
    x, _ = J.jacobi_solve(f.e_solve, _rhs(f), eps=1e-3, max_iter=40, fused=True)
    return x.select("i", "c", (F.round("x", 4) + F.lit(0.0)).alias("x"))


@query("j4_residual", f"SELECT {s6('max(abs(x1.x - x0.x))', 'residual')} FROM x1 JOIN x0 ON x1.i = x0.i AND x1.c = x0.c", _B + ", x0 AS (SELECT * FROM bb), " + _step(1))
def _(f):
    d, r = S.split_diagonal(f.e_solve)
    return J.residual(J.jacobi_step(r, d, _rhs(f), _rhs(f)), _rhs(f)).select(r6("residual", "residual"))


@query("j5_right_hand_side", f"SELECT i, c, {s6('s / (SELECT max(abs(s)) FROM s)')} FROM s, (SELECT unnest(range(3)) AS c)", "s AS (SELECT i, sum(v) AS s FROM e_solve GROUP BY i)")
def _(f):
    return J.rhs_from_row_sums(f.e_solve, 3).select("i", "c", r6())
