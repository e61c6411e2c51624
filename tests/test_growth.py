"""How the work grows: rows that joins and sums make, and rounds of iterations."""

import numpy as np
from pyspark.sql import functions as F

from tessel import session
from tessel.operators import gnn as G
from tessel.operators import products as P
from tessel.operators import solver as J
from tessel.operators import schedule as T
from tessel.operators import structure as S


def made_rows(df, node):
    """Output rows of each operator of that name in the plan that ran."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        own = [p.metrics().apply("numOutputRows").value()] if node in name else []
        return own + [n for k in range(p.children().size()) for n in walk(p.children().apply(k))]

    return walk(df._jdf.queryExecution().executedPlan())


def dense_edges(spark, n, v=lambda i, j: (i * 3 + j) % 5 / 4.0):
    return spark.createDataFrame([(i, j, v(i, j)) for i in range(n) for j in range(n)], "i long, j long, v double")


def long_x(spark, n, width):
    return spark.createDataFrame([(j, k, (j * 5 + k) % 7 / 2.0) for j in range(n) for k in range(width)], "j long, k long, x double")


def test_tiles_do_not_make_rows_of_the_first_product_again(spark):
    n, width = 24, 3
    e, x = dense_edges(spark, n), long_x(spark, n, width)
    out = P.spmm_spmm_tile_fused(e, x, 2)
    assert max(made_rows(out, "Join")) <= n * n
    a = np.array([[(i * 3 + j) % 5 / 4.0 for j in range(n)] for i in range(n)])
    b = np.array([[(j * 5 + k) % 7 / 2.0 for k in range(width)] for j in range(n)])
    got = {(r["i"], r["k"]): r["x"] for r in out.collect()}
    assert len(got) == n * width and all(abs(got[i, k] - (a @ a @ b)[i, k]) < 1e-9 for i, k in got)


def test_tiles_of_a_sparse_operand(spark):
    """Cells that X lacks stay missing, repeated entries of A add up."""
    e = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (1, 2, 1.0), (2, 0, 5.0)], "i long, j long, v double")
    x = spark.createDataFrame([(1, 0, 1.0), (2, 7, 10.0)], "j long, k long, x double")
    assert sorted(map(tuple, P.spmm_spmm_tile_fused(e, x, 2).collect())) == sorted(map(tuple, P.spmm_spmm(e, e, x).collect())) == [(0, 7, 80.0), (2, 0, 10.0)]


def spread_edges(spark, n):
    """In partitions that each have entries of every row."""
    return dense_edges(spark, n).repartition(4, "j")


def test_a_task_sums_its_own_rows_only(spark):
    n, width = 40, 5
    e, x = spread_edges(spark, n), long_x(spark, n, width)
    assert max(made_rows(P.spmm(e, x), "HashAggregate")) <= n * width
    assert max(made_rows(P.spmm(e, x, P.Hint(salt=3)), "HashAggregate")) <= 3 * n * width


def test_products_of_a_sparse_operand_with_salt(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (1, 2, 1.0), (2, 0, 5.0), (1, 1, 1.0)], "i long, j long, v double")
    x = spark.createDataFrame([(1, 0, 1.0), (2, 7, 10.0)], "j long, k long, x double")
    for salt in (1, 4):
        assert sorted(map(tuple, P.spmm(e, x, P.Hint(salt=salt)).collect())) == [(0, 0, 2.0), (1, 0, 1.0), (1, 7, 40.0)]


def test_a_task_averages_its_own_rows_only(spark):
    n, width = 40, 5
    e, x = spread_edges(spark, n), long_x(spark, n, width)
    assert max(made_rows(G.mean_aggregate(e, x), "HashAggregate")) <= n * width
    sparse = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0), (2, 7, 10.0)], "j long, k long, x double")
    near = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "i long, j long")
    assert sorted(map(tuple, G.mean_aggregate(near, sparse).collect())) == [(0, 0, 2.0), (0, 7, 10.0)]


def test_an_entry_meets_all_columns_of_the_iterate_at_once(spark, monkeypatch):
    n = 12
    e = dense_edges(spark, n, lambda i, j: 1.0 if i == j else 1 / 64)
    b = spark.createDataFrame([(i, c, float(i + c)) for i in range(n) for c in (3, 5) if (i, c) != (4, 5)], "i long, c int, x double")
    seen, cut = [], J.cut
    monkeypatch.setattr(J, "cut", lambda df, *old: seen.append(max(made_rows(df, "Join"))) or cut(df, *old))
    x, done = J.jacobi_solve(e, b, eps=1e-12, max_iter=60)
    assert done > 0 and max(seen) <= n * (n - 1)
    got = {(r["i"], r["c"]): r["x"] for r in x.collect()}
    a = np.full((n, n), 1 / 64) + np.eye(n) * (1 - 1 / 64)
    assert np.allclose([got[i, 3] for i in range(n)], np.linalg.solve(a, np.arange(n) + 3.0))
    own = [i for i in range(n) if i != 4]
    assert len(got) == 2 * n - 1 and np.allclose([got[i, 5] for i in own], np.linalg.solve(a[np.ix_(own, own)], np.array(own) + 5.0))


def test_places_of_a_random_matrix_are_made_once(spark):
    """Numbers beyond the generator's prime repeat, and rows are not summed before they are dealt out."""
    prime = (1 << 31) - 1
    ids = spark.createDataFrame([(k,) for k in (0, 1, 5, 10**6)], "id long")
    for t in (1, 2):
        same = S.replayable(F.col("id"), F.lit(t), seed=7) == S.replayable(F.col("id") + prime, F.lit(t), seed=7)
        assert ids.where(same).count() == 4
    plan = S.random_sparse(spark, 10**6, 0.01, 7)._jdf.queryExecution()
    assert f"Range (0, {prime}," in plan.toString()
    e = S.random_sparse(spark, 40, 0.9, 7)
    assert max(made_rows(e, "HashAggregate")) == e.count() == e.select("i", "j").distinct().count()


def test_level_sets_follow_an_edge_once(spark, monkeypatch):
    n = 14
    dag = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)], "i long, j long")
    seen, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df, *old: seen.append(sum(made_rows(df, "Join"))) or cut(df, *old))
    assert [r["level"] for r in T.level_sets(dag, spark.range(n).withColumnRenamed("id", "i")).orderBy("i").collect()] == list(range(n))
    assert sum(seen) <= 3 * dag.count() + (n + 1) * n
