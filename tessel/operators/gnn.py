"""Graph-neural-network layers, losses, gradients and sampling over edge and feature tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .products import Hint, as_operand, cells_by_row, gemm, relu, spmm, vec_dot
from .structure import mask_rows, replayable, row_degree, transpose


def gcn_normalise(e: DataFrame, with_values: bool = True) -> DataFrame:
    """G1: ``A[i,j] / sqrt(deg(i) deg(j))`` with degrees of stored entries by row; a column that is no row has degree 0
    and gives infinity, as division by zero does. ``with_values=False`` takes every entry as 1."""
    deg = row_degree(e)
    di, dj = deg.select("i", F.col("deg").alias("_di")), deg.select(F.col("i").alias("j"), F.col("deg").alias("_dj"))
    v = F.col("v") if with_values else F.lit(1.0)
    full = e.join(di, "i").join(dj, "j", "left")
    scaled = F.when(F.col("_dj").isNull(), F.lit(float("inf")) * F.signum(v)).otherwise(v / F.sqrt((F.col("_di") * F.coalesce("_dj", F.lit(1))).cast("double")))
    return full.select("i", "j", scaled.alias("v"))


def gcn_layer(norm: DataFrame, h: DataFrame, w: DataFrame, bias: dict[int, float] | None = None, bias_mode: str = "none", activation: str | None = None, weight_layout: str = "in_out", hint: Hint = Hint()) -> DataFrame:
    """``Â H W`` in long form ``j, k, x``. ``bias_mode``: none, per_node, or per_edge (``deg(i)`` times the bias)."""
    out = spmm(norm, gemm(h, w, weight_layout), hint)
    if bias_mode != "none":
        b = _weights(out, {(k, 0): x for k, x in (bias or {}).items()}).select("k", F.col("w").alias("_b"))
        out = out.join(F.broadcast(b), "k", "left").fillna(0.0, ["_b"])
        if bias_mode == "per_edge":
            out = out.join(row_degree(norm), "i").withColumn("_b", F.col("_b") * F.col("deg")).drop("deg")
        elif bias_mode != "per_node":
            raise ValueError(bias_mode)
        out = out.select("i", "k", (F.col("x") + F.col("_b")).alias("x"))
    value = relu(F.col("x")) if activation == "relu" else F.col("x")
    return out.select(F.col("i").alias("j"), "k", value.alias("x"))


def _weights(df: DataFrame, cells: dict[tuple[int, int], float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(k), int(c), float(x)) for (k, c), x in cells.items()], "k long, c long, w double")


def weight_table(df: DataFrame, w: list[list[float]]) -> DataFrame:
    """A small driver-side in-by-out matrix as ``k, c, w``."""
    return _weights(df, {(k, c): x for k, row in enumerate(w) for c, x in enumerate(row)})


def relu_table(x: DataFrame) -> DataFrame:
    return x.withColumn("x", relu(F.col("x")))


def log_softmax(x: DataFrame, node: str = "j") -> DataFrame:
    """Over the classes k of each node: a window by node, so that rows are shuffled once."""
    w = Window.partitionBy(node)
    z = x.withColumn("_z", F.col("x") - F.max("x").over(w))
    return z.select(node, "k", (F.col("_z") - F.log(F.sum(F.exp("_z")).over(w))).alias("x"))


def gcn_two_layer(norm: DataFrame, h: DataFrame, w1: DataFrame, w2: DataFrame, activation: str | None = "relu", softmax: bool = True) -> DataFrame:
    """Two layers with ReLU between, and log-softmax. G5b is ``activation=None, softmax=False``."""
    out = gcn_layer(norm, gcn_layer(norm, h, w1, activation=activation), w2)
    return log_softmax(out) if softmax else out


def totally_fused_gcn(norm: DataFrame, h: DataFrame, w1: DataFrame, w2: DataFrame) -> DataFrame:
    """Two linear layers as one: ``Â (Â (H (W1 W2)))``. The weights are multiplied first, so both sparse products
    work at the width of the result."""
    both = w1.select(F.col("k").alias("_in"), F.col("c").alias("k"), F.col("w").alias("_w")).join(w2, "k").groupBy("_in", "c").agg(F.sum(F.col("_w") * F.col("w")).alias("w"))
    out = spmm(norm, gemm(h, both.withColumnRenamed("_in", "k")))
    return as_operand(spmm(norm, as_operand(out)))


def supervised_head(embeds: DataFrame, w: DataFrame) -> DataFrame:
    """Class scores of embeddings, with weights out by in."""
    return gemm(embeds, w, "out_in")


def one_hop(e: DataFrame, rows: DataFrame) -> DataFrame:
    """Neighbours of sampled rows; a row itself only if adjacent to itself."""
    return mask_rows(e, rows).select(F.col("j").alias("i")).distinct()


def minibatch_gcn(norm: DataFrame, h: DataFrame, w1: DataFrame, w2: DataFrame, rows: DataFrame, activation: str | None = None) -> DataFrame:
    """Layer 2 on the sampled rows, layer 1 on these and their neighbours, each with its masked matrix."""
    need = rows.select("i").union(one_hop(norm, rows)).distinct()
    h1 = gcn_layer(mask_rows(norm, need), h, w1, activation=activation)
    return gcn_layer(mask_rows(norm, rows), h1, w2)


def sample_neighbours(e: DataFrame, num_sample: int | None, seed: int = 0) -> DataFrame:
    """At most ``num_sample`` neighbours of each node, first in a seeded hash order."""
    if num_sample is None:
        return e
    order = Window.partitionBy("i").orderBy(F.pmod(F.col("j") * 7919 + F.col("i") * 104729 + seed, F.lit(1_000_003)), "j")
    return e.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= num_sample).drop("_r")


def mean_aggregate(e: DataFrame, x: DataFrame, num_sample: int | None = None, gcn: bool = False, seed: int = 0) -> DataFrame:
    """Mean of (sampled) neighbours' features, ``i, k, x``; with ``gcn`` the node itself is one of them."""
    near = sample_neighbours(e, num_sample, seed).select("i", "j")
    if gcn:
        near = near.union(e.select("i", F.col("i").alias("j"))).distinct()
    return cells_by_row(near.withColumn("v", F.lit(1.0)), x).groupBy("i", "k").agg(F.avg("x").alias("x"))


def sage_layer(e: DataFrame, x: DataFrame, w: DataFrame, in_dim: int, num_sample: int | None = None, gcn: bool = False, seed: int = 0, activation: str | None = "relu") -> DataFrame:
    """``relu(W [self, mean of neighbours])``, or only the mean with ``gcn``. An isolated node has no mean: its
    neighbour half is missing (0), where a division 0/0 would give NaN."""
    mean = mean_aggregate(e, x, num_sample, gcn, seed)
    if gcn:
        z = as_operand(mean)
    else:
        z = x.select("j", "k", "x").union(mean.select(F.col("i").alias("j"), (F.col("k") + in_dim).alias("k"), "x"))
    return gemm(z, w, activation=activation)


def cross_entropy(logits: DataFrame, target: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Minus the mean log-softmax at the target class ``i, y``, over the masked nodes."""
    if mask is not None:
        target = target.join(mask.select("i").distinct(), "i", "left_semi")
    at = log_softmax(logits).join(target.select(F.col("i").alias("j"), F.col("y").cast("long").alias("k")), ["j", "k"])
    return at.agg((-F.avg("x")).alias("loss"))


def weight_gradient(a: DataFrame, x: DataFrame, g: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """``(A X)ᵀ G`` as ``k, c, w``; ``cached`` is A·X as ``j, k, x`` if already there."""
    ax = cached if cached is not None else as_operand(spmm(a, x))
    grad = g.select("j", F.col("k").alias("c"), F.col("x").alias("_g"))
    return ax.join(grad, "j").groupBy("k", "c").agg(F.sum(F.col("x") * F.col("_g")).alias("w"))


def input_gradient(a: DataFrame, g: DataFrame, w: DataFrame) -> DataFrame:
    """``Aᵀ G Wᵀ`` for ``out = A X W``, right for any A."""
    back = w.select(F.col("c").alias("k"), F.col("k").alias("c"), "w")
    return as_operand(spmm(transpose(a), gemm(g, back)))


def cached_layer(ax: DataFrame, w: DataFrame, weight_layout: str = "out_in") -> DataFrame:
    """A layer on features A·X that were made once."""
    return gemm(ax, w, weight_layout)


def sgd_step(w: list[list[float]], grad: list[list[float]], lr: float = 0.7, decay: float = 0.0) -> list[list[float]]:
    """Weights are small and live on the driver."""
    return [[x - lr * (g + decay * x) for x, g in zip(a, b)] for a, b in zip(w, grad)]


def adam_step(w, grad, state: dict, lr: float = 0.001, decay: float = 0.0, betas=(0.9, 0.999), eps: float = 1e-8):
    """Adam with its moments in ``state``."""
    t = state["t"] = state.get("t", 0) + 1
    zero = [[0.0] * len(r) for r in w]
    m, s = state.get("m", zero), state.get("s", zero)
    g = [[y + decay * x for x, y in zip(a, b)] for a, b in zip(w, grad)]
    m = [[betas[0] * p + (1 - betas[0]) * q for p, q in zip(a, b)] for a, b in zip(m, g)]
    s = [[betas[1] * p + (1 - betas[1]) * q * q for p, q in zip(a, b)] for a, b in zip(s, g)]
    state["m"], state["s"] = m, s
    c1, c2 = 1 - betas[0] ** t, 1 - betas[1] ** t
    return [[x - lr * (p / c1) / (math.sqrt(q / c2) + eps) for x, p, q in zip(a, b, c)] for a, b, c in zip(w, m, s)]


def collect_weights(w: DataFrame, rows: int, cols: int) -> list[list[float]]:
    """A weight-sized table to the driver; its size is that of the layer, never of the graph."""
    out = [[0.0] * cols for _ in range(rows)]
    for r in w.limit(rows * cols).collect():
        out[r["k"]][r["c"]] = r["w"]
    return out


def loss_gradient(logits: DataFrame, target: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Gradient of ``cross_entropy`` by the logits: (softmax - one-hot) / nodes, 0 outside the mask."""
    if mask is not None:
        target = target.join(mask.select("i").distinct(), "i", "left_semi")
    t = target.select(F.col("i").alias("j"), F.col("y").cast("long").alias("_y"))
    n = t.agg(F.count("*").alias("_n"))
    p = log_softmax(logits).join(t, "j").join(F.broadcast(n))
    return p.select("j", "k", ((F.exp("x") - (F.col("k") == F.col("_y")).cast("double")) / F.col("_n")).alias("x"))


def train_gcn(norm: DataFrame, x: DataFrame, target: DataFrame, w: list[list[float]], epochs: int, lr: float = 0.7, optimiser: str = "sgd", decay: float = 0.0, mask: DataFrame | None = None) -> tuple[list[list[float]], list[float]]:
    """A one-layer GCN classifier trained by full-batch steps; A·X is made once. Returns weights and losses."""
    ax = as_operand(spmm(norm, x)).persist()
    losses, state = [], {}
    for _ in range(epochs):
        logits = gemm(ax, weight_table(x, w)).persist()
        losses.append(cross_entropy(logits, target, mask).first()["loss"])
        g = collect_weights(weight_gradient(norm, x, loss_gradient(logits, target, mask), ax), len(w), len(w[0]))
        w = sgd_step(w, g, lr, decay) if optimiser == "sgd" else adam_step(w, g, state, lr, decay)
        logits.unpersist()
    ax.unpersist()
    return w, losses


def predict(scores: DataFrame) -> DataFrame:
    """The class of the greatest score; ties go to the least class."""
    return scores.groupBy("j").agg(F.max(F.struct("x", (-F.col("k")).alias("nk"))).alias("b")).select(F.col("j").alias("i"), (-F.col("b.nk")).alias("pred"))


def micro_f1(pred: DataFrame, target: DataFrame) -> DataFrame:
    """Single-label micro F1, which is accuracy."""
    return pred.join(target, "i").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("micro_f1"))


def link_scores(pairs: DataFrame, z: DataFrame) -> DataFrame:
    """Dot products of the ends' embeddings."""
    a, b = z.select(F.col("j").alias("i"), F.col("x").alias("_a")), z.select("j", F.col("x").alias("_b"))
    return pairs.join(a, "i").join(b, "j").select(*pairs.columns, vec_dot(F.col("_a"), F.col("_b")).alias("score"))


def binary_cross_entropy(scored: DataFrame, label: str = "label") -> DataFrame:
    """Mean BCE with logits, in the form that does not overflow."""
    s, y = F.col("score"), F.col(label).cast("double")
    return scored.agg(F.avg(F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))).alias("loss"))


def logistic_probe(train: DataFrame, test: DataFrame, max_iter: int = 100):
    """Logistic regression on embeddings ``x array, y``; returns the test rows with a prediction."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    fit = LogisticRegression(featuresCol="f", labelCol="y", maxIter=max_iter).fit(train.withColumn("f", array_to_vector("x")))
    return fit.transform(test.withColumn("f", array_to_vector("x"))).drop("f", "rawPrediction", "probability")


def hash_order(col: str = "i", seed: int = 0) -> Column:
    """A seeded order that SQL engines can replay."""
    return F.pmod(F.col(col) * 7919 + seed, F.lit(10_007))


def split_nodes(nodes: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 0) -> DataFrame:
    """Ranks in a hashed order cut into train, val and test. Ranks come from counts by hash value, so that no
    window spans all nodes."""
    h = nodes.select("i", hash_order("i", seed).alias("_h"))
    sizes = h.groupBy("_h").agg(F.count("*").alias("_n"))
    base = sizes.select("_h", F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_t"))
    ranked = h.join(F.broadcast(base), "_h").withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("i")) - 1 + F.col("_b"))
    part = F.when(F.col("_r") < F.floor(F.col("_t") * train), "train").when(F.col("_r") < F.floor(F.col("_t") * (train + val)), "val").otherwise("test")
    return ranked.select("i", part.alias("part"))


def _least(df: DataFrame, order: Column, keys: list[str], k: int) -> DataFrame:
    """The k rows that come first by a hash and then the keys. Counts by hash value tell the last value that is taken
    whole and how many rows of the next one; so only rows of one value are ordered, and none are gathered."""
    hashed = df.withColumn("_h", order)
    sizes = hashed.groupBy("_h").agg(F.count("*").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sizes.select("_h", "_n", upto.alias("_before")).where(F.col("_before") < k).agg(F.max(F.struct("_h", "_before")).alias("_e"))
    near = hashed.join(F.broadcast(edge)).where(F.col("_h") <= F.col("_e._h"))
    whole = near.where(F.col("_h") < F.col("_e._h"))
    last = near.where(F.col("_h") == F.col("_e._h")).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(*keys))).where(F.col("_r") <= k - F.col("_e._before"))
    return whole.select(df.columns).union(last.select(df.columns))


def sample_edges(e: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k edges, first in a hashed order."""
    return _least(e, F.pmod(F.col("i") * 7919 + F.col("j") * 104729 + seed, F.lit(1_000_003)), ["i", "j"], k)


def sample_edges_random(e: DataFrame, k: int, n: int, seed: int = 0, unit: bool = False) -> DataFrame:
    """Product with a random matrix of about k entries; ``unit`` makes these 1 rather than random values."""
    p = min(1.0, k / float(n * n))
    most = float((1 << 31) - 1)
    u = replayable(F.col("i"), F.col("j"), seed=seed) / most
    w = replayable(F.col("i"), F.col("j"), seed=seed + 1) / most
    return e.where(u < p).select("i", "j", (F.col("v") * (F.lit(1.0) if unit else w)).alias("v"))


def sample_rows(nodes: DataFrame, n: int, ratio: float, seed: int = 0) -> DataFrame:
    """ceil(n ratio) rows, first in a hashed order."""
    return _least(nodes.select("i"), hash_order("i", seed), ["i"], math.ceil(n * ratio))


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The infinity norm of a difference; a cell that one side lacks is 0."""
    x = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return x.agg(F.coalesce(F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("max_diff"))
