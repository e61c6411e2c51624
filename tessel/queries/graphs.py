"""Graph-neural-network operators."""

from pyspark.sql import functions as F

from tessel.functions import gflops_gcn
from tessel.operators import gnn as G
from tessel.operators import products as P
from tessel.operators.schedule import fusion_by_tile_size
from tessel.operators.structure import mask_rows
from tessel.plans import adjacent_fusable

from . import query, r6, replayed, s6
from .fixtures import DIM, OUT

_NORM = """deg AS (SELECT i, count(*) AS d FROM e_sym GROUP BY i),
  nrm AS (SELECT e.i, e.j, e.v / sqrt((a.d * b.d)::DOUBLE) AS v FROM e_sym e JOIN deg a ON a.i = e.i JOIN deg b ON b.i = e.j),
  xw AS (SELECT j, c AS k, sum(x * w) AS x FROM x JOIN w USING (k) GROUP BY j, c),
  layer AS (SELECT n.i AS j, k, sum(v * x) AS x FROM nrm n JOIN xw ON n.j = xw.j GROUP BY n.i, k)"""
_SOFT = ", lsm AS (SELECT j, k, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY j)) AS x FROM (SELECT *, max(x) OVER (PARTITION BY j) AS m FROM layer))"


def norm(f):
    return G.gcn_normalise(f.e_sym)


def layer(f, **kw):
    return G.gcn_layer(norm(f), f.x, f.w, **kw)


@query("g1_gcn_normalise", f"SELECT i, j, {s6('v', 'v')} FROM nrm", _NORM)
def _(f):
    return norm(f).select("i", "j", r6("v", "v"))


@query("g1_gcn_normalise_directed", """SELECT e.i, e.j, CASE WHEN b.d IS NULL THEN 'infinity'::DOUBLE ELSE round(e.v / sqrt((a.d * b.d)::DOUBLE), 6) END AS v
  FROM e_w e JOIN dw a ON a.i = e.i LEFT JOIN dw b ON b.i = e.j""", "dw AS (SELECT i, count(*) AS d FROM e_w GROUP BY i)")
def _(f):
    v = F.col("v")
    return G.gcn_normalise(f.e_w).select("i", "j", F.when(v == float("inf"), v).otherwise(F.round(v, 6)).alias("v"))


@query("g2_gcn_layer", f"SELECT j, k, {s6('x')} FROM layer", _NORM)
def _(f):
    return layer(f).select("j", "k", r6())


@query("g2b_gcn_layer_bias_per_edge", f"SELECT layer.j, k, {s6('x + d * (k + 1) / 8.0::DOUBLE')} FROM layer JOIN deg ON deg.i = layer.j", _NORM)
def _(f):
    return layer(f, bias={k: (k + 1) / 8.0 for k in range(OUT)}, bias_mode="per_edge").select("j", "k", r6())


@query("g3_relu_layer", f"SELECT j, k, {s6('greatest(x, 0)')} FROM layer", _NORM)
def _(f):
    return layer(f, activation="relu").select("j", "k", r6())


@query("g4_log_softmax", f"SELECT j, k, {s6('x')} FROM lsm", _NORM + _SOFT)
def _(f):
    return G.log_softmax(layer(f)).select("j", "k", r6())


def _w2(f):
    return f.w.where(f"k < {OUT}")


_TWO = ", h1 AS (SELECT j, k, {act} AS x FROM layer), hw AS (SELECT j, c AS k, sum(x * w) AS x FROM h1 JOIN w USING (k) GROUP BY j, c), l2 AS (SELECT n.i AS j, k, sum(v * x) AS x FROM nrm n JOIN hw ON n.j = hw.j GROUP BY n.i, k)"


@query("g5_gcn_two_layer", f"SELECT j, k, {s6('x - m - ln(sum(exp(x - m)) OVER (PARTITION BY j))')} FROM (SELECT *, max(x) OVER (PARTITION BY j) AS m FROM l2)", _NORM + _TWO.format(act="greatest(x, 0)"))
def _(f):
    return G.gcn_two_layer(norm(f), f.x, f.w, _w2(f)).select("j", "k", r6())


@query("g5b_two_layer_linear", f"SELECT j, k, {s6('x')} FROM l2", _NORM + _TWO.format(act="x"))
def _(f):
    return G.gcn_two_layer(norm(f), f.x, f.w, _w2(f), activation=None, softmax=False).select("j", "k", r6())


@query("g6_minibatch_gcn", f"SELECT n.i AS j, k, {s6('sum(v * x)')} FROM nrm n JOIN hw ON n.j = hw.j WHERE n.i IN (SELECT i FROM sampled) GROUP BY n.i, k", _NORM + _TWO.format(act="x"))
def _(f):
    return G.minibatch_gcn(norm(f), f.x, f.w, _w2(f), f.sampled).select("j", "k", r6())


_SAMPLE = "near AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY (j * 7919 + i * 104729) % 1000003, j) AS r FROM e_hole) WHERE r <= 5)"


@query("g7_neighbour_mean", f"SELECT e.i, k, {s6('avg(x)')} FROM near e JOIN x USING (j) GROUP BY e.i, k", _SAMPLE)
def _(f):
    return G.mean_aggregate(f.e_hole, f.x, 5).select("i", "k", r6())


@query("g7_neighbour_mean_gcn", f"SELECT e.i, k, {s6('avg(x)')} FROM (SELECT * FROM near UNION SELECT i, i FROM e_hole) e JOIN x ON x.j = e.j GROUP BY e.i, k", _SAMPLE)
def _(f):
    return G.mean_aggregate(f.e_hole, f.x, 5, gcn=True).select("i", "k", r6())


_SAGE = f"""z AS (SELECT j, k, x FROM x UNION ALL SELECT e.i, k + {DIM}, avg(x) FROM e_hole e JOIN x USING (j) GROUP BY e.i, k),
  w2 AS (SELECT k, c, ((13 * k + 7 * c) % 11 - 5)::DOUBLE / 16.0 AS w FROM (SELECT unnest(range({2 * DIM})) AS k), (SELECT unnest(range({OUT})) AS c))"""


@query("g8_sage_layer", f"SELECT j, c AS k, {s6('greatest(sum(x * w), 0)')} FROM z JOIN w2 USING (k) GROUP BY j, c", _SAGE)
def _(f):
    k = f.spark.range(2 * DIM).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OUT - 1).cast("long"))).alias("c"))
    w = k.withColumn("w", ((13 * F.col("k") + 7 * F.col("c")) % 11 - 5) / 16.0)
    return G.sage_layer(f.e_hole, f.x, w, DIM).select("j", "k", r6())


@query("g10_cross_entropy", f"SELECT {s6('-avg(x)', 'loss')} FROM lsm JOIN y ON y.i = lsm.j AND y.y = lsm.k", _NORM + _SOFT)
def _(f):
    return G.cross_entropy(layer(f), f.y).select(r6("loss", "loss"))


@query("g10_cross_entropy_masked", f"SELECT {s6('-avg(x)', 'loss')} FROM lsm JOIN y ON y.i = lsm.j AND y.y = lsm.k WHERE y.i IN (SELECT i FROM sampled)", _NORM + _SOFT)
def _(f):
    return G.cross_entropy(layer(f), f.y, f.sampled).select(r6("loss", "loss"))


@query("g10_loss_gradient_masked", "SELECT j, k, round((exp(x) - (k = y)::INTEGER) / (SELECT count(*) FROM sampled), 8) + 0.0 AS x FROM lsm JOIN y ON y.i = lsm.j WHERE y.i IN (SELECT i FROM sampled)", _NORM + _SOFT)
def _(f):
    return G.loss_gradient(layer(f), f.y, f.sampled).select("j", "k", (F.round("x", 8) + F.lit(0.0)).alias("x"))


@query("g9_supervised_head", f"SELECT j, k, {s6('sum(x * w)')} FROM (SELECT j, x.k AS d, x FROM x) JOIN (SELECT k AS d, c AS k, w FROM w) USING (d) GROUP BY j, k")
def _(f):
    return G.supervised_head(f.x, f.w.select(F.col("c").alias("k"), F.col("k").alias("c"), "w")).select("j", "k", r6())


@query("g14_totally_fused_gcn", f"SELECT j, k, {s6('x')} FROM l2", _NORM + _TWO.format(act="x"))
def _(f):
    return G.totally_fused_gcn(norm(f), f.x, f.w, _w2(f)).select("j", "k", r6())


_GRAD = "g AS (SELECT j, c AS k, sum(x * w) AS x FROM x JOIN w USING (k) GROUP BY j, c)"


@query("g11_weight_gradient", "SELECT ax.k, g.k AS c, round(sum(ax.x * g.x), 4) + 0.0 AS w FROM ax JOIN g ON g.j = ax.i GROUP BY ax.k, g.k", _GRAD + ", ax AS (SELECT e.i, k, sum(v * x) AS x FROM e_w e JOIN x USING (j) GROUP BY e.i, k)")
def _(f):
    return G.weight_gradient(f.e_w, f.x, P.gemm(f.x, f.w)).select("k", "c", (F.round("w", 4) + F.lit(0.0)).alias("w"))


@query("g12_input_gradient", f"SELECT e.j, k, {s6('sum(v * x)')} FROM e_w e JOIN gw ON gw.j = e.i GROUP BY e.j, k", _GRAD + ", gw AS (SELECT g.j, w.k, sum(g.x * w.w) AS x FROM g JOIN w ON w.c = g.k GROUP BY g.j, w.k)")
def _(f):
    return G.input_gradient(f.e_w, P.gemm(f.x, f.w), f.w).select("j", "k", r6())


@query("g13_cached_layer", f"SELECT i AS j, c AS k, {s6('sum(x * w)')} FROM ax JOIN w USING (k) GROUP BY i, c", "ax AS (SELECT e.i, k, sum(v * x) AS x FROM e_w e JOIN x USING (j) GROUP BY e.i, k)")
def _(f):
    return G.cached_layer(P.as_operand(P.spmm(f.e_w, f.x)), f.w, "in_out").select("j", "k", r6())


# weights are 0 at first, so the first logits are 0 and the first gradient is known
_TRAIN = _NORM + f""", axn AS (SELECT n.i AS j, k, sum(v * x) AS x FROM nrm n JOIN x ON n.j = x.j GROUP BY n.i, k),
  gr1 AS (SELECT j, c, (1.0 / {OUT} - (c = y)::INTEGER) / (SELECT count(*) FROM y) AS g FROM (SELECT DISTINCT j FROM axn) JOIN y ON y.i = j, (SELECT unnest(range({OUT})) AS c)),
  tw AS (SELECT k, c, -0.7 * sum(x * g) AS w FROM axn JOIN gr1 USING (j) GROUP BY k, c), lg AS (SELECT j, c, sum(x * w) AS x FROM axn JOIN tw USING (k) GROUP BY j, c),
  ls AS (SELECT j, c, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY j)) AS x FROM (SELECT *, max(x) OVER (PARTITION BY j) AS m FROM lg))"""


@query("g15_training_losses", f"SELECT 0 AS epoch, {s6(f'ln({OUT})', 'loss')} UNION ALL SELECT 1, round(-avg(x), 6) FROM ls JOIN y ON y.i = j AND y.y = c", _TRAIN)
def _(f):
    _, losses = G.train_gcn(norm(f), f.x, f.y, [[0.0] * OUT for _ in range(DIM)], epochs=2)
    return f.spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double").select("epoch", r6("loss", "loss"))


@query("g16_predict", "SELECT j AS i, arg_min(k, (-x, k)) AS pred FROM layer GROUP BY j", _NORM)
def _(f):
    return G.predict(layer(f))


@query("g16_micro_f1", f"SELECT {s6('avg((pred = y)::INTEGER)', 'micro_f1')} FROM (SELECT j AS i, arg_min(k, (-x, k)) AS pred FROM layer GROUP BY j) JOIN y USING (i)", _NORM)
def _(f):
    return G.micro_f1(G.predict(layer(f)), f.y).select(r6("micro_f1", "micro_f1"))


_LINK = "dot AS (SELECT e.i, e.j, sum(a.x * b.x) AS s FROM e_hole e JOIN x a ON a.j = e.i JOIN x b ON b.j = e.j AND a.k = b.k GROUP BY e.i, e.j)"


@query("g17_link_scores", f"SELECT i, j, {s6('s', 'score')} FROM dot", _LINK)
def _(f):
    return G.link_scores(f.e_hole.select("i", "j"), f.xv).select("i", "j", r6("score", "score"))


@query("g17_link_loss", f"SELECT {s6('avg(greatest(s, 0) - s * (i % 2) + ln(1 + exp(-abs(s))))', 'loss')} FROM dot", _LINK)
def _(f):
    return G.binary_cross_entropy(G.link_scores(f.e_hole.select("i", "j", (F.col("i") % 2).alias("label")), f.xv)).select(r6("loss", "loss"))


@query("g18_split_nodes", "SELECT i, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM (SELECT i, n, row_number() OVER (ORDER BY (i * 7919) % 10007, i) - 1 AS r FROM ids, n)")
def _(f):
    return G.split_nodes(f.spark.range(f.n).withColumnRenamed("id", "i"))


@query("g19_one_hop", "SELECT DISTINCT j AS i FROM e_hole WHERE i IN (SELECT i FROM sampled)")
def _(f):
    return G.one_hop(f.e_hole, f.sampled)


@query("g20_sample_edges", "SELECT i, j, v FROM e_w ORDER BY (i * 7919 + j * 104729) % 1000003, i, j LIMIT 300")
def _(f):
    return G.sample_edges(f.e_w, 300)


@query("g21_sample_edges_random", f"SELECT i, j, v * ({replayed('i', 'j', seed=1)} / 2147483647.0::DOUBLE) AS v FROM e_w, n WHERE {replayed('i', 'j', seed=0)} / 2147483647.0::DOUBLE < least(1.0, (n * n // 2) / (n * n)::DOUBLE)")
def _(f):
    return G.sample_edges_random(f.e_w, f.n * f.n // 2, f.n)


@query("g22_sample_rows", "SELECT i FROM ids ORDER BY (i * 7919) % 10007, i LIMIT (SELECT ceil(n * 0.2)::BIGINT FROM n)")
def _(f):
    return G.sample_rows(f.spark.range(f.n).withColumnRenamed("id", "i"), f.n, 0.2)


_W12 = """w2 AS (SELECT i, j FROM e_local WHERE i IN (SELECT i FROM sampled)), w1 AS (SELECT * FROM e_local WHERE i IN (SELECT j FROM w2)),
  made AS (SELECT DISTINCT i FROM w1), need AS (SELECT i, min(j) AS lo, max(j) AS hi FROM w2 WHERE j IN (SELECT i FROM made) GROUP BY i),
  rws AS (SELECT DISTINCT i FROM w2), ts AS (SELECT unnest([16, 64, 256]) AS tile),
  cum AS (SELECT tile, r.i, i // tile * tile AS t, min(lo) OVER w AS a, max(hi) OVER w AS b FROM rws r LEFT JOIN need USING (i), ts WINDOW w AS (PARTITION BY tile, i // tile ORDER BY i ROWS UNBOUNDED PRECEDING))"""


@query("g23_fusion_by_tile_size", f"SELECT tile, count(*) FILTER (t + tile < n AND (a IS NULL OR (a <= t AND b < t + tile))) AS fused, {s6('count(*) FILTER (t + tile < n AND (a IS NULL OR (a <= t AND b < t + tile))) / any_value(n)::DOUBLE', 'ratio')} FROM cum, n GROUP BY tile", _W12)
def _(f):
    w2 = mask_rows(f.e_local, f.sampled)
    w1 = mask_rows(f.e_local, w2.select(F.col("j").alias("i")))
    return fusion_by_tile_size(w1, w2, f.n, [16, 64, 256]).select("tile", "fused", r6("ratio", "ratio"))


@query("g24_max_difference", f"SELECT {s6('max(abs(layer.x - greatest(layer.x, 0)))', 'max_diff')} FROM layer", _NORM)
def _(f):
    a = layer(f)
    return G.max_difference(a, G.relu_table(a), ["j", "k"]).select(r6("max_diff", "max_diff"))


@query("g24_difference_from_given", f"SELECT {s6('max(abs(coalesce(layer.x, 0) - given.x))', 'max_diff')} FROM (SELECT i AS j, k, ((i * 3 + k) % 7 - 3)::DOUBLE / 8.0 AS x FROM ids, (SELECT unnest(range({OUT})) AS k)) given LEFT JOIN layer USING (j, k)", _NORM)
def _(f):
    given = f.spark.range(f.n).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OUT - 1).cast("long"))).alias("k")).withColumn("x", ((F.col("j") * 3 + F.col("k")) % 7 - 3) / 8.0)
    return G.max_difference(layer(f), given, ["j", "k"]).select(r6("max_diff", "max_diff"))


@query("g17_logistic_probe")
def _(f):
    rows = f.xv.join(f.y.select(F.col("i").alias("j"), (F.col("y") % 2).cast("double").alias("y")), "j")
    return G.logistic_probe(rows.where("j % 5 <> 0"), rows.where("j % 5 = 0"), max_iter=20).select("j", "y", "prediction")


@query("c1_adjacent_loops", "SELECT k FROM (SELECT n_nationkey AS k, (n_regionkey + 1) % 5 AS out, lead(n_regionkey) OVER (ORDER BY n_nationkey) AS nxt FROM nation) WHERE out = nxt")
def _(f):
    loops = [(str(r["n_regionkey"]), str((r["n_regionkey"] + 1) % 5)) for r in f.table("nation").orderBy("n_nationkey").collect()]
    return f.spark.createDataFrame([(k,) for k in adjacent_fusable(loops)], "k int")


@query("c5_gflops", f"SELECT MatrixName, MTile, \"Implementation Name\" AS name, {s6('(2.0 * NNZ * 64 + 2.0 * 1000 * 64 * 8) / 1e9 / median', 'gflops')} FROM log JOIN med USING (MatrixName, \"Implementation Name\", bCols, MTile)")
def _(f):
    nnz, sec = F.col("NNZ"), F.expr("array_sort(array({}))[3]".format(", ".join(f"`Trial{k} Subregion0 Executor`" for k in range(7))))
    return f.log.select("MatrixName", "MTile", F.col("Implementation Name").alias("name"), r6(gflops_gcn(nnz, F.lit(1000), F.lit(64), F.lit(8), sec), "gflops"))
