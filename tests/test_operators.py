"""Hand-made matrices, algebraic properties and the sequential operators."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel import plans
from tessel.operators import gnn as G
from tessel.operators import products as P
from tessel.operators import schedule as T
from tessel.operators import solver as J
from tessel.operators import structure as S
from tessel.reports import row_medians
from tessel.sources import matrix as M

#: 6 x 6, not symmetric: row 3 and column 4 are empty, (0, 0) is a self loop, (1, 2) comes twice, row 5 is a hub.
CELLS = [(0, 0, 1.0), (0, 1, 2.0), (1, 2, 1.5), (1, 2, 0.5), (2, 0, -3.0), (4, 5, None), (5, 0, 1.0), (5, 1, 1.0), (5, 2, 1.0), (5, 3, 4.0), (5, 5, 2.0)]
N = 6


def dense(cells):
    a = np.zeros((N, N))
    for i, j, v in cells:
        a[i, j] += 1.0 if v is None else v
    return a


A = dense(CELLS)
X = np.arange(N * 3).reshape(N, 3) / 4.0 - 1


@pytest.fixture(scope="module")
def e(spark):
    return S.edges(spark.createDataFrame(CELLS, "i long, j long, v double"))


def long_x(spark, x, names=("j", "k")):
    return spark.createDataFrame([(i, k, float(x[i, k])) for i in range(x.shape[0]) for k in range(x.shape[1])], f"{names[0]} long, {names[1]} long, x double")


def matrix(df, shape, i="i", k="k", x="x"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[i], r[k]] = r[x]
    return out


def test_products(spark, e):
    x = long_x(spark, X)
    assert np.allclose(matrix(P.spmm(e, x), (N, 3)), A @ X)
    assert np.allclose(matrix(P.spmm_spmm(e, e, x), (N, 3)), A @ A @ X)
    assert np.allclose(matrix(P.spmm_spmm(e, e, x, transpose_second=True), (N, 3)), A.T @ A @ X)
    for tile in (1, 2, 4, 7):
        assert np.allclose(matrix(P.spmm_spmm_tile_fused(e, x, tile), (N, 3)), A @ A @ X)
    assert P.spmm(e, x).where("i = 3").count() == 0 and P.dense_rows(P.spmm(e, x), N, 3).count() == N * 3
    rows = spark.createDataFrame([(i, X[i].tolist()) for i in range(N)], "j long, x array<double>")
    for block in (1, 2, 3, 128):
        assert np.allclose(matrix(P.long_of(P.spmm_rows(e, rows, 3, block=block), "i"), (N, 3)), A @ X)
    wide = np.arange(N * 700).reshape(N, 700) / 64.0
    wide_rows = spark.createDataFrame([(i, wide[i].tolist()) for i in range(N)], "j long, x array<double>")
    assert np.allclose(matrix(P.long_of(P.spmm_rows(e, wide_rows, 700), "i"), (N, 700)), A @ wide)
    s = A != 0
    assert np.allclose(matrix(P.sddmm(e, rows, rows), (N, N), k="j", x="v"), A * (X @ X.T))
    assert np.allclose(matrix(P.sampled_addmm(e, rows, rows), (N, N), k="j", x="v"), (A + X @ X.T) * s)


def test_orders_of_a_product_agree(spark, e):
    w = np.array([[1.0, -1], [0.5, 2], [0, 3]])
    weights = G.weight_table(e, w.tolist())
    x = long_x(spark, X)
    for df in (P.gemm_spmm(e, x, weights), P.spmm_gemm(e, x, weights), P.triple_product(e, x, weights), plans.graph_product(e, x, weights, 10, N, 3, 2)):
        assert np.allclose(matrix(df, (N, 2)), A @ X @ w)
    assert np.allclose(matrix(P.gemm(x, weights, activation="leaky_relu"), (N, 2), i="j"), np.where(X @ w >= 0, X @ w, 0.01 * (X @ w)))
    with pytest.raises(ValueError):
        P.gemm(x, weights, "sideways")


def test_transpose_of_a_product(spark, e):
    b = S.transpose(e)
    left = P.spmm(e, long_x(spark, A))
    right = P.spmm(b, long_x(spark, A.T))
    assert np.allclose(matrix(left, (N, N)), A @ A) and np.allclose(matrix(right, (N, N)), (A @ A).T)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-8, 8), min_size=N, max_size=N), st.lists(st.integers(-8, 8), min_size=N, max_size=N))
def test_spmv_is_linear(spark, e, a, b):
    def run(v):
        return {r["i"]: r["x"] for r in P.spmv(e, spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "j long, x double")).collect()}

    total, x, y = run([p + q for p, q in zip(a, b)]), run(a), run(b)
    assert all(math.isclose(total[i], x[i] + y[i], abs_tol=1e-9) for i in total)


def test_structure(spark, e):
    assert S.zero_rows(e, N).first()[0] == 1 and S.bandwidth(e).first()[0] == 5
    full = matrix(S.make_full(S.lower_half(e)), (N, N), k="j", x="v")
    assert np.allclose(full, np.tril(A) + np.tril(A, -1).T)
    assert np.allclose(matrix(S.set_diagonal(e, N), (N, N), k="j", x="v"), A - np.diag(np.diag(A)) + np.eye(N))
    assert S.padded_dims(5, 8) == (8, 8)
    with pytest.raises(NotImplementedError):
        S.metis_reordering(e)
    perm = S.reverse_cuthill_mckee(e, N)
    assert sorted(r["old"] for r in perm.collect()) == sorted(r["new"] for r in perm.collect()) == list(range(N))


def test_reordering_narrows_a_shuffled_band(spark):
    n = 16
    mixed = spark.range(n).select(F.col("id").alias("old"), (F.col("id") * 7 % n).alias("new"))
    band = S.apply_permutation(S.banded(spark, n, 3), mixed)
    perm = S.reverse_cuthill_mckee(band, n)
    assert S.bandwidth(S.apply_permutation(band, perm)).first()[0] <= 4 < S.bandwidth(band).first()[0]


def test_jacobi_converges(spark):
    a = np.array([[4.0, 1, 0], [1, 5, 2], [0, 2, 6]])
    b = np.array([1.0, 2, 3])
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]], "i long, j long, v double")
    rhs = spark.createDataFrame([(i, 0, float(b[i])) for i in range(3)], "i long, c long, x double")
    for fused in (False, True):
        x, done = J.jacobi_solve(e, rhs, eps=1e-10, max_iter=100, fused=fused)
        got = [r["x"] for r in x.orderBy("i").collect()]
        assert done > 0 and np.allclose(got, np.linalg.solve(a, b))
    assert J.jacobi_solve(e, rhs, eps=1e-30, max_iter=1)[1] == 0


def test_gradients_by_finite_differences(spark, e):
    w = np.array([[0.2, -0.1], [0.4, 0.3], [-0.5, 0.1]])
    x, y = long_x(spark, X), spark.createDataFrame([(i, i % 2) for i in range(N) if i != 3], "i long, y long")

    def loss(w_, x_):
        z = A @ x_ @ w_
        z = z[[i for i in range(N) if i != 3]]
        t = [i % 2 for i in range(N) if i != 3]
        z = z - z.max(1, keepdims=True)
        return -np.mean([z[k, c] - np.log(np.exp(z[k]).sum()) for k, c in enumerate(t)])

    logits = P.spmm_gemm(e, x, G.weight_table(e, w.tolist())).withColumnRenamed("i", "j")
    assert math.isclose(G.cross_entropy(logits, y).first()[0], loss(w, X), rel_tol=1e-9)
    g = G.loss_gradient(logits, y)
    dw = matrix(G.weight_gradient(e, x, g), (3, 2), i="k", k="c", x="w")
    dx = matrix(G.input_gradient(e, g, G.weight_table(e, w.tolist())), (N, 3), i="j")
    h = 1e-6
    for k in range(3):
        for c in range(2):
            d = np.zeros_like(w)
            d[k, c] = h
            assert abs((loss(w + d, X) - loss(w - d, X)) / (2 * h) - dw[k, c]) < 1e-6
    for j in range(N):
        d = np.zeros_like(X)
        d[j, 1] = h
        assert abs((loss(w, X + d) - loss(w, X - d)) / (2 * h) - dx[j, 1]) < 1e-6


def test_training_lowers_the_loss(spark, e):
    y = spark.createDataFrame([(i, i % 2) for i in range(N) if i != 3], "i long, y long")
    for kind in ("sgd", "adam"):
        _, losses = G.train_gcn(e, long_x(spark, X / 4), y, [[0.0, 0.0]] * 3, epochs=3, lr=0.05, optimiser=kind)
        assert losses[-1] < losses[0]


def test_schedules(spark):
    n, tile = 100, 16
    band = S.banded(spark, n, 3)
    f = T.fusibility(band, n, tile)
    assert f.where("fused").count() == n - 2 * (math.ceil(n / tile) - 1)
    s = T.fixed_tile_schedule(band, n, tile)
    assert s.where("loop = 1").count() == s.where("loop = 0").count() == n
    assert T.redundancy(s).first()["redundant"] == 0
    assert T.replicated(band, s).where("loop = 1").count() == n


def test_empty_rows_are_fused(spark, e):
    assert {r["i"]: r["fused"] for r in T.fusibility(e, N, 2).collect()} == {0: True, 1: False, 2: False, 3: True, 4: True, 5: False}


def greedy(weights, parts):
    share, at, out = math.ceil(sum(weights) / parts), 0, []
    for k in range(parts):
        load = 0
        while load < share and at < len(weights):
            load += weights[at]
            out.append(k)
            at += 1
    return out + [None] * (len(weights) - len(out))


@pytest.mark.parametrize("weights,parts", [([1, 5, 1, 1, 9, 2, 2, 1], 3), ([1] * 10, 4), ([7, 7, 7], 5), ([2, 3, 4, 5, 6, 1, 1, 1, 8], 2)])
def test_weighted_parts(spark, weights, parts):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "id long, w double")
    assert [r["part"] for r in T.weighted_parts(df, parts, bucket=3).orderBy("id").collect()] == greedy(weights, parts)


def test_colouring_is_valid(spark):
    c = T.tile_conflicts(S.banded(spark, 60, 9), 60, 5)
    col = T.dsatur(c, list(range(12)))
    assert T.colouring_faults(c, spark.createDataFrame(list(col.items()), "tile long, colour int")).count() == 0
    assert T.lowest_free([0, 1, 3]) == 2 and T.lowest_free([]) == 0


def test_variable_tiles_cover_all_rows(spark):
    e = S.random_sparse(spark, 64, 0.1, 3)
    t = [(r["lo"], r["hi"]) for r in T.variable_tiles(e, 64, 8, 5_000, start=32).collect()]
    assert t[0][0] == 0 and t[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(t, t[1:]))
    g = T.grown_tiles(e, 64, 8, 4, 6_000, 4)
    assert g[0] == 0 and g[-1] == 64 and g == sorted(g)


def test_parts_and_levels(spark):
    line = spark.createDataFrame([(k + 1, k) for k in range(5)], "i long, j long")
    assert [r["level"] for r in T.level_sets(line, spark.range(6).withColumnRenamed("id", "i")).orderBy("i").collect()] == list(range(6))
    with pytest.raises(ValueError):
        T.level_sets(line.union(spark.createDataFrame([(0, 5)], "i long, j long")), spark.range(6).withColumnRenamed("id", "i"), max_levels=8)
    parts = T.bfs_parts(S.banded(spark, 20, 3), [1.0] * 20, 3)
    assert sorted(sum(parts, [])) == list(range(20))
    tiles = T.sparse_tiling(S.banded(spark, 12, 3), 12)
    flat = [x for level in tiles for group in level for x in group]
    assert sorted(flat) == sorted([(k, i) for k in (0, 1) for i in range(12)])


def test_masked_layers_agree_with_the_whole(spark, e):
    x = long_x(spark, X)
    w1, w2 = G.weight_table(e, [[1.0, 0], [0, 1.0], [1.0, 1.0]]), G.weight_table(e, [[1.0], [-1.0]])
    rows = spark.createDataFrame([(1,), (5,)], "i long")
    whole = G.gcn_layer(e, G.gcn_layer(e, x, w1), w2).where("j in (1, 5)")
    part = G.minibatch_gcn(e, x, w1, w2, rows)
    assert np.allclose(matrix(whole, (N, 1), i="j"), matrix(part, (N, 1), i="j"))


def test_files(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.5\n2 1 -1\n3 2 4e0\n")
    e, shape = M.read_matrix(spark, str(p))
    assert shape == (3, 3) and sorted(map(tuple, e.collect())) == [(0, 0, 2.5), (0, 1, -1.0), (1, 0, -1.0), (1, 2, 4.0), (2, 1, 4.0)]
    q = tmp_path / "b.smtx"
    q.write_text("3, 4, 4\n0 2 2 4\n0 3 1 2\n")
    e, shape = M.read_matrix(spark, str(q))
    assert shape == (3, 4) and sorted((r["i"], r["j"]) for r in e.collect()) == [(0, 0), (0, 3), (2, 1), (2, 2)]
    with pytest.raises(ValueError):
        M.read_matrix(spark, "x.bin")


def test_row_medians(spark):
    df = spark.createDataFrame([(4.0, 1.0, 2.0, 3.0), (5.0, 1.0, None, 2.0)], ", ".join(f"`Trial{k} Subregion0 Executor` double" for k in range(4)))
    assert [r["median"] for r in row_medians(df).collect()] == [2.5, 2.0]


def test_streaming_product(spark, tmp_path):
    from tessel.streaming import streaming_spmv

    spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (3, 1, 4.0)], "i long, j long, v double").write.parquet(str(tmp_path / "in"))
    x = spark.createDataFrame([(1, 10.0), (2, 1.0)], "j long, x double")
    q = streaming_spmv(spark.readStream.schema("i long, j long, v double").parquet(str(tmp_path / "in")), x)
    run = q.writeStream.outputMode("complete").format("memory").queryName("y").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("y").collect())) == [(0, 21.0), (3, 40.0)]


def test_sql_functions(spark):
    from tessel.functions import register

    register(spark)
    assert spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_axpy(2D, array(1D), array(5D)) AS a").first() == (11.0, [7.0])


def tiles_of(spark, builder):
    return [(r["lo"], r["hi"]) for r in builder.orderBy("lo").collect()]


def test_grown_tiles_equal_a_walk_row_by_row(spark):
    """Rows are taken one stride after the other, and what they need is counted anew at each."""
    for n, seed, cache, threads, stride in ((90, 3, 4_000, 4, 16), (200, 5, 3_000, 3, 8), (64, 7, 900, 2, 4), (50, 9, 100_000, 5, 16)):
        e = S.random_sparse(spark, n, 0.06, seed)
        cols = {}
        for r in e.collect():
            cols.setdefault(r["i"], set()).add(r["j"])
        want, at, step = [0], 0, stride
        while True:
            for k in range(1, n + 1):
                hi = min(n, at + k * step)
                used = [cols.get(i, set()) for i in range(at, hi)]
                size = T.working_set_gcn(sum(map(len, used)), len(set().union(*used)), 8, 4, hi - at)
                if (step > 1 or hi - at > 1) and not ((size < cache or hi - at <= stride) and hi - at < n / threads):
                    break
                if hi == n:
                    break
            else:
                break
            if k * step + at >= n and ((size < cache or n - at <= stride) and n - at < n / threads or step == 1 and n - at <= 1):
                break
            if k == 1:
                step = max(1, step // 2)
                continue
            at += (k - 1) * step
            want.append(at)
            if hi - want[-2] >= 3 * step:
                step *= 2
        assert T.grown_tiles(e, n, 8, 4, cache, threads, min_stride=stride) == [*want, n]


def test_variable_tiles_equal_halving_one_by_one(spark):
    n = 150
    e = S.random_sparse(spark, n, 0.05, 11)
    edges = [(r["i"], r["j"]) for r in e.collect()]
    span = {}
    for i, j in edges:
        a, b = span.get(i, (j, j))
        span[i] = min(a, j), max(b, j)

    def halved(lo, hi):
        inside = [(i, j) for i, j in edges if lo <= i < hi]
        fused = sum(lo <= a and b < hi for a, b in span.values())
        if T.working_set(len(inside), len({j for _, j in inside}), 8, hi - lo, fused) > 3_000 and hi - lo > 1:
            mid = lo + (hi - lo) // 2
            return halved(lo, mid) + halved(mid, hi)
        return [(lo, hi, fused)]

    want = []
    first, count, extra = 32, n // 32, n % 32
    per, at, given = -(-extra // count), 0, 0
    for _ in range(count):
        more = min(per, extra - given)
        want += halved(at, at + first + more)
        at, given = at + first + more, given + more
    assert sorted(tuple(r) for r in T.variable_tiles(e, n, 8, 3_000, start=32).collect()) == want
    plan = T.variable_tiles(e, n, 8, 3_000, start=32)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert T.variable_tiles(e.limit(0), 0, 8, 3_000).count() == 0


def schedules_of(spark, e, n):
    yield "fixed", T.fixed_tile_schedule(e, n, 8)
    yield "pairing", T.pairing(e, spark.range(n).select("id", F.floor(F.col("id") / 7).alias("part")), n, 3)
    yield "replicated", T.replicated(e, T.fixed_tile_schedule(e, n, 8))
    yield "balanced", T.balanced(e, T.fixed_tile_schedule(e, n, 8))
    yield "tiling", T.tiling_schedule(spark, T.sparse_tiling(e, n))


@pytest.mark.parametrize("width", [3, 9, None])
def test_schedules_make_rows_before_they_are_used(spark, width):
    n = 60
    e = S.banded(spark, n, width) if width else S.random_sparse(spark, n, 0.04, 2)
    v = spark.range(n).select(F.col("id").alias("j"), (F.col("id") % 5 + 1.0).alias("x"))
    z = e.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("z"))
    want = {r["i"]: r["y"] for r in e.join(z.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("z")).alias("y")).collect()}
    for name, s in schedules_of(spark, e, n):
        assert T.order_faults(e, s).count() == 0, name
        assert sorted({r["id"] for r in s.where("loop = 1").collect()}) == list(range(n)), name
        if name not in ("replicated", "balanced"):  # these make rows more than once
            assert {r["i"]: r["x"] for r in T.product_by_schedule(e, v, s).collect()} == want, name
    swapped = T.tiling_schedule(spark, T.sparse_tiling(e, n)[::-1])
    assert T.order_faults(e, swapped).count() > 0


def test_sparse_tiling_takes_what_seeds_need(spark):
    levels = T.sparse_tiling(S.banded(spark, 12, 3), 12)
    assert levels == [[[(0, k) for k in range(5)] + [(1, k) for k in range(4)]], [[(0, k) for k in range(5, 9)] + [(1, k) for k in range(4, 8)]], [[(0, k) for k in range(9, 12)] + [(1, k) for k in range(8, 12)]]]
    lone = spark.createDataFrame([(0, 5, 1.0), (5, 0, 1.0)], "i long, j long, v double")
    assert T.sparse_tiling(lone, 8) == [[[(0, 0), (0, 1), (0, 2), (0, 3), (0, 5), (1, 0)], [(1, k) for k in (1, 2, 3, 4, 6, 7)]], [[(0, 4), (0, 6), (0, 7), (1, 5)]]]


def test_reordering_keeps_every_row_of_a_long_path(spark):
    n = 40  # as many levels as half the rows, from the middle of no cap
    path = S.banded(spark, n, 3)
    perm = S.reverse_cuthill_mckee(path, n)
    assert sorted(r["new"] for r in perm.collect()) == list(range(n))
    assert S.apply_permutation(path, perm).count() == path.count() and S.bandwidth(S.apply_permutation(path, perm)).first()[0] <= 3


def test_samples_take_the_first_by_hash(spark):
    nodes = spark.range(500).withColumnRenamed("id", "i")
    want = sorted(range(500), key=lambda i: (i * 7919 % 10_007, i))
    for k in (0, 1, 37, 499, 500):
        assert sorted(r["i"] for r in G._least(nodes, G.hash_order(), ["i"], k).collect()) == sorted(want[:k])
    tied = spark.range(100).select((F.col("id") % 7).alias("i"), "id")
    assert G._least(tied, F.col("i"), ["id"], 20).count() == 20
    assert "TakeOrdered" not in G.sample_rows(nodes, 500, 0.2)._jdf.queryExecution().executedPlan().toString()


def test_replayable_values_spread(spark):
    e = S.random_sparse(spark, 300, 0.02, 1)
    assert e.count() > 1_700 and e.select("i").distinct().count() > 290


def test_headers_after_many_comments(spark, tmp_path):
    p = tmp_path / "long.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern general\n" + "% words\n" * 3_000 + "2 3 1\n2 3\n")
    e, shape = M.read_matrix(spark, str(p))
    assert shape == (2, 3) and [tuple(r) for r in e.collect()] == [(1, 2, 1.0)]
    (tmp_path / "none.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n")
    with pytest.raises(ValueError):
        M.read_matrix(spark, str(tmp_path / "none.mtx"))


def test_log_softmax_is_one_shuffle(spark, e):
    plan = G.log_softmax(long_x(spark, X))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_weighted_parts_of_uneven_floats(spark):
    rng = np.random.default_rng(0)
    w = rng.random(300) * np.where(rng.random(300) < 0.02, 500, 1)
    df = spark.createDataFrame([(i * 3, float(x)) for i, x in enumerate(w)], "id long, w double")
    assert [r["part"] for r in T.weighted_parts(df, 9, bucket=40).orderBy("id").collect()] == greedy(list(w), 9)
    assert [r["part"] for r in T.weighted_parts(df.withColumn("w", F.lit(0.0)), 3).collect()] == [None] * 300


def test_link_prediction_by_logistic_regression(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0, i / 100], float(i % 2)) for i in range(60)], "j long, x array<double>, y double")
    got = G.logistic_probe(rows.where("j < 40"), rows.where("j >= 40"))
    assert got.count() == 20 and got.where("prediction <> y").count() == 0
