"""Schedules of row tiles and what they tell, as analytics on the edge table.

A schedule is ``level int, part long, pos long, loop int, id long``. The first loop makes row r of a product; the second
uses rows j of it for each edge (i, j). Row i of the second loop is fused into a tile if the first loop makes all it
needs in the same tile. ``n`` is the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from itertools import accumulate

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rows_of(e: DataFrame, n: int) -> DataFrame:
    return e.sparkSession.range(n).withColumnRenamed("id", "i")


def fusibility(e: DataFrame, n: int, tile: int) -> DataFrame:
    """``i, tile, nnz, fused`` for every row; a row without entries is fused."""
    span = e.groupBy("i").agg(F.min("j").alias("lo"), F.max("j").alias("hi"), F.count("*").alias("nnz"))
    t = F.floor(F.col("i") / tile)
    return rows_of(e, n).join(span, "i", "left").select("i", t.alias("tile"), F.coalesce("nnz", F.lit(0)).alias("nnz"), F.coalesce((F.floor(F.col("lo") / tile) == t) & (F.floor(F.col("hi") / tile) == t), F.lit(True)).alias("fused"))


def ranked(df: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """``df`` with ``rank`` (from 0) by the distinct long ``key``: ranks in buckets of the key, and counts before them."""
    b = df.withColumn("_b", F.floor(F.col(key) / bucket))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    base = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = b.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1)
    return inside.join(base, "_b").withColumn("rank", F.col("_base") + F.col("_r")).drop("_b", "_base", "_r")


def fixed_tile_schedule(e: DataFrame, n: int, tile: int) -> DataFrame:
    """Level 0 has each tile's rows of loop 0, then its fused rows; level 1 has the rest in runs of ``tile``."""
    f = fusibility(e, n, tile)
    first = f.select(F.lit(0).alias("level"), F.col("tile").alias("part"), F.lit(0).alias("loop"), F.col("i").alias("id"))
    fused = f.where("fused").select(F.lit(0).alias("level"), F.col("tile").alias("part"), F.lit(1).alias("loop"), F.col("i").alias("id"))
    rest = ranked(f.where("not fused").select("i"), "i").select(F.lit(1).alias("level"), F.floor(F.col("rank") / tile).alias("part"), F.lit(1).alias("loop"), F.col("i").alias("id"))
    return packed(first.union(fused).union(rest))


def packed(schedule: DataFrame, separated: bool = True) -> DataFrame:
    """P5: positions inside each (level, part): loop by loop, or interleaved by row."""
    order = ["loop", "id"] if separated else ["id", "loop"]
    return schedule.select("level", "part", (F.row_number().over(Window.partitionBy("level", "part").orderBy(*order)) - 1).alias("pos"), "loop", "id")


def fused_statistics(schedule: DataFrame, e: DataFrame) -> DataFrame:
    """Fused rows, their entries, and their share of the second loop."""
    deg = e.groupBy("i").agg(F.count("*").alias("nnz"))
    s = schedule.where("loop = 1").join(deg, F.col("id") == F.col("i"), "left")
    at0 = F.col("level") == 0
    return s.agg(F.sum(at0.cast("long")).alias("fused_rows"), F.sum(F.when(at0, F.coalesce("nnz", F.lit(0))).otherwise(0)).alias("fused_nnz"), (F.sum(at0.cast("double")) / F.count("*")).alias("fused_ratio"))


def pairing(e: DataFrame, parts: DataFrame, n: int, n_parts: int) -> DataFrame:
    """With loop 0 dealt out by ``parts(id, part)``: a row joins its own part if the part makes all that it needs;
    others follow in level 1, evenly cut. Returns a schedule."""
    p = parts.select(F.col("id").alias("i"), F.col("part").alias("_pi"))
    q = parts.select(F.col("id").alias("j"), F.col("part").alias("_pj"))
    ok = e.join(p, "i").join(q, "j", "left").groupBy("i").agg(F.bool_and(F.coalesce(F.col("_pi") == F.col("_pj"), F.lit(False))).alias("ok"))
    rows = p.join(ok, "i", "left").select("i", "_pi", F.coalesce("ok", F.lit(True)).alias("ok"))
    first = parts.select(F.lit(0).alias("level"), F.col("part").cast("long").alias("part"), F.lit(0).alias("loop"), "id")
    fused = rows.where("ok").select(F.lit(0).alias("level"), F.col("_pi").cast("long").alias("part"), F.lit(1).alias("loop"), F.col("i").alias("id"))
    left = ranked(rows.where("not ok").select("i"), "i")
    total = left.agg(F.count("*").alias("_t"))
    size = F.greatest(F.ceil(F.col("_t") / n_parts), F.lit(1))
    rest = left.join(F.broadcast(total)).select(F.lit(1).alias("level"), F.floor(F.col("rank") / size).alias("part"), F.lit(1).alias("loop"), F.col("i").alias("id"))
    return packed(first.union(fused).union(rest))


def even_parts(n: int, parts: int) -> Column:
    """P1 for unit weights: ``id div ceil(n / parts)``."""
    return F.floor(F.col("id") / -(-n // parts))


def weighted_parts(weights: DataFrame, parts: int, targets: list[float] | None = None, bucket: int = 4096) -> DataFrame:
    """``id, part`` for ``weights(id, w)``; each part takes ids in order until it has its even share.

    The greedy cut depends on where the part before it ended, so cuts are found in order on the driver, from the sums of
    buckets of ids, of which there is one for ``bucket`` ids. Of buckets in which a cut falls the running sums are looked
    at: those where cuts would fall if every part took just its share come in one go, others as they are needed. The
    last ids that no part takes have part null.
    """
    b = weights.select("id", "w", F.floor(F.col("id") / bucket).alias("_b"))
    sizes = sorted((r["_b"], r["s"]) for r in b.groupBy("_b").agg(F.sum("w").alias("s")).collect())
    ends = list(accumulate(x for _, x in sizes))
    total = ends[-1] if ends else 0.0
    share = targets or [float(-(-total // parts))] * parts
    held: dict[int, tuple[list[int], list[float]]] = {}

    def look(ks: set[int]) -> None:
        """Ids and running sums of these buckets."""
        rows: dict[int, list] = {k: [] for k in ks}
        index = {sizes[k][0]: k for k in ks}
        for r in b.where(F.col("_b").isin(list(index))).select("_b", "id", "w").collect():
            rows[index[r["_b"]]].append((r["id"], r["w"]))
        for k, xs in rows.items():
            ids, ws = zip(*sorted(xs))
            base = ends[k - 1] if k else 0.0
            held[k] = list(ids), [base + x for x in accumulate(ws)]

    if ends:
        look({min(bisect_left(ends, x), len(ends) - 1) for x in accumulate(share)})
    lasts, at, last = [], 0.0, -(1 << 63)  # the last id of each part
    for target in share:
        if target > 0:
            k = bisect_left(ends, at + target)
            if k == len(ends):
                break
            if k not in held:
                look({k})
            ids, sums = held[k]
            p = min(bisect_left(sums, at + target), len(ids) - 1)
            at, last = sums[p], ids[p]
        lasts.append(last)
    part = F.size(F.filter(F.array(*map(F.lit, lasts)), lambda c: c < F.col("id"))) if lasts else F.lit(0)
    return weights.select("id", F.when(part < len(share), part).cast("int").alias("part"))


def reuse_count(e: DataFrame, schedule: DataFrame) -> DataFrame:
    """Uses of rows made in the same part."""
    made = schedule.where("loop = 0").select("level", "part", F.col("id").alias("j"))
    used = schedule.where("loop = 1").select("level", "part", F.col("id").alias("i"))
    return used.join(e.select("i", "j"), "i").join(made, ["level", "part", "j"]).agg(F.count("*").alias("reuse"))


def redundancy(schedule: DataFrame) -> DataFrame:
    """Scheduled iterations beyond the distinct ones, over all loops, and the distinct ones."""
    by = schedule.groupBy("loop").agg(F.count("*").alias("a"), F.countDistinct("id").alias("u"))
    return by.agg(F.coalesce(F.sum(F.col("a") - F.col("u")), F.lit(0)).alias("redundant"), F.coalesce(F.sum("u"), F.lit(0)).alias("unique"))


def gemm_bounds(e: DataFrame, tile: int) -> DataFrame:
    """``tile, lower, upper``: the rows of the dense product that each row tile needs."""
    return e.groupBy(F.floor(F.col("i") / tile).alias("tile")).agg(F.min("j").alias("lower"), (F.max("j") + 1).alias("upper"))


def gemm_max_width(e: DataFrame, tile: int) -> DataFrame:
    return gemm_bounds(e, tile).agg(F.max(F.col("upper") - F.col("lower")).alias("max_width"))


def last_tile_of_row(e: DataFrame, tile: int) -> DataFrame:
    """P10: the last column tile with an entry in each row (by columns: the last tile that adds to a row)."""
    return e.groupBy("i").agg(F.max(F.floor(F.col("j") / tile)).alias("last"))


def last_needed_tile(e: DataFrame, n: int, tile: int) -> DataFrame:
    """P10: for each column tile the last tile that must be done before its rows are whole (0 for an empty one)."""
    last = last_tile_of_row(e, tile)
    need = e.join(last, "i").groupBy(F.floor(F.col("j") / tile).alias("tile")).agg(F.max("last").alias("need"))
    tiles = e.sparkSession.range(-(-n // tile)).withColumnRenamed("id", "tile")
    return tiles.join(need, "tile", "left").select("tile", F.coalesce("need", F.lit(0)).alias("need"))


def interleaved_tiles(e: DataFrame, n: int, tile: int) -> DataFrame:
    """P10: ``start, type, need, kind`` in running order (need, kind, start): a tile of the first loop (type 0; 2 if it is
    the last and short), then those of the second loop that it completes (type 1 or 3)."""
    short = -(-n // tile) - 1 if n % tile else -1
    tiles = e.sparkSession.range(-(-n // tile)).withColumnRenamed("id", "tile")
    one = tiles.select((F.col("tile") * tile).alias("start"), F.when(F.col("tile") == short, 2).otherwise(0).alias("type"), F.col("tile").alias("need"), F.lit(0).alias("kind"))
    two = last_needed_tile(e, n, tile).select((F.col("tile") * tile).alias("start"), F.when(F.col("tile") == short, 3).otherwise(1).alias("type"), "need", F.lit(1).alias("kind"))
    return one.union(two)


def working_set(nnz, unique_cols, width, tile, fused, size=8):
    """Bytes of a tile of the chained sparse product; plain numbers or columns."""
    return (nnz + unique_cols * width + tile * width + fused * width) * size + nnz * 4


def working_set_gemm(fused_nnz, width, out, tile, fused, size=8):
    return (tile * out + out * width + tile * width + fused * out + fused_nnz) * size + fused_nnz * 4


def working_set_gcn(nnz, unique_cols, width, out, tile, size=8):
    return (out * width * 2 + tile * out + tile * width + unique_cols * width + unique_cols * out) * size + nnz * 4


def initial_tile(width: int, out: int, cache: int, size: int = 8) -> int:
    return (cache // size - width * out) // (width + out)


def variable_tiles(e: DataFrame, n: int, width: int, cache: int, start: int = 4096, size: int = 8, cost: Callable = working_set) -> DataFrame:
    """``lo, hi, fused``: equal tiles of about ``start`` rows, halved while their working set exceeds the cache.

    Which tile an index is in at first follows from arithmetic, so edges and rows carry their tiles, and a round is an
    aggregate of each by tile; all tiles that are too large split in the same round, so rounds are at most the logarithm
    of ``start``. A row is fused into the tile that has its first and its last column.
    """
    from tessel.session import cut

    if not n:
        return e.sparkSession.createDataFrame([], "lo long, hi long, fused long")
    first = min(start, n)
    count, extra = n // first, n % first
    per = -(-extra // count)
    # tile k begins after k tiles of ``first`` rows and the extra rows that these took, ``per`` each while there are any
    begin = lambda k: k * first + F.least(k * per, F.lit(extra))
    full = extra // per if per else 0
    border = full * (first + per)
    odd = border + first + extra - full * per

    def tiled(df: DataFrame, at: str) -> DataFrame:
        i = F.col(at)
        k = F.when(i < border, F.floor(i / (first + per))).when(i < odd, F.lit(full)).otherwise(full + 1 + F.floor((i - odd) / first)).cast("long")
        return df.withColumn("_k", k).select(*df.columns, begin(F.col("_k")).alias("lo"), begin(F.col("_k") + 1).alias("hi"))

    def halved(df: DataFrame, at: str, large: DataFrame) -> DataFrame:
        low = F.col(at) < F.col("mid")
        keep = [c for c in df.columns if c not in ("lo", "hi")]
        return df.join(large, ["lo", "hi"]).select(*keep, F.when(low, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(low, F.col("mid")).otherwise(F.col("hi")).alias("hi"))

    open_ = e.sparkSession.range(count).select(begin(F.col("id")).alias("lo"), begin(F.col("id") + 1).alias("hi"))
    edges = tiled(e.select("i", "j"), "i")
    homes = tiled(e.groupBy("i").agg(F.min("j").alias("a"), F.max("j").alias("b")), "a").where("b < hi").select("a", "b", "lo", "hi")
    done, old = None, (None, None)
    while True:
        stats = edges.groupBy("lo", "hi").agg(F.count("*").alias("nnz"), F.countDistinct("j").alias("cols"))
        fused = homes.groupBy("lo", "hi").agg(F.count("*").alias("fused"))
        got = open_.join(stats, ["lo", "hi"], "left").join(fused, ["lo", "hi"], "left").fillna(0, ["nnz", "cols", "fused"])
        t = F.col("hi") - F.col("lo")
        got = cut(got.select("lo", "hi", "fused", ((cost(F.col("nnz"), F.col("cols"), width, t, F.col("fused"), size) > cache) & (t > 1)).alias("large")))
        small = got.where("not large").select("lo", "hi", "fused")
        done = small if done is None else done.union(small)
        large = got.where("large").select("lo", "hi", (F.floor(t / 2) + F.col("lo")).alias("mid"))
        if large.isEmpty():
            return done
        open_ = large.select(F.explode(F.array(F.struct("lo", F.col("mid").alias("hi")), F.struct(F.col("mid").alias("lo"), "hi"))).alias("t")).select("t.lo", "t.hi")
        edges = cut(halved(edges, "i", large), old[0])
        homes = cut(halved(homes, "a", large).where("b < hi"), old[1])
        old = (edges, homes)


class _RowStream:
    """For each row in order, the rows before it that last used its columns (-1 for none): read as a stream, of which
    only the rows from the last bound on are held."""

    def __init__(self, e: DataFrame, n: int):
        last = F.coalesce(F.lag("i").over(Window.partitionBy("j").orderBy("i")), F.lit(-1))
        self.rows = e.select("i", last.alias("last")).groupBy("i").agg(F.collect_list("last").alias("last")).orderBy("i").toLocalIterator()
        self.n, self.held, self.base, self.next = n, [], 0, next(self.rows, None)

    def block(self, lo: int, hi: int) -> list[np.ndarray]:
        while self.base + len(self.held) < min(hi, self.n):
            i = self.base + len(self.held)
            here = self.next is not None and self.next["i"] == i
            self.held.append(np.array(self.next["last"] if here else [], np.int64))
            if here:
                self.next = next(self.rows, None)
        return self.held[lo - self.base : hi - self.base]

    def forget(self, before: int) -> None:
        self.held, self.base = self.held[before - self.base :], before


def grown_tiles(e: DataFrame, n: int, width: int, out: int, cache: int, threads: int, size: int = 8, min_stride: int = 16) -> list[int]:
    """P11b, growing: tile bounds of a GCN layer.

    From each bound the working set of the rows after it grows with every row, so there is a farthest row that still
    fits: the working set below the cache (or no more than ``min_stride`` rows), and fewer rows than a thread's share.
    A tile ends at the last whole stride that reaches no farther. A stride that is too long itself is halved, down to 1,
    which always fits; after a tile of which the strides, the failing one included, come to three, it is doubled.

    The farthest row is found by prefix sums: a column is new to a tile if the row that last used it lies before the
    tile's bound. Where a tile ends decides where the next one begins, so the search goes in row order on the driver,
    over a stream of rows of which a tile's worth is held.
    """
    rows, share = _RowStream(e, n), n / threads

    def farthest(at: int) -> int:
        """Rows from ``at`` that fit together."""
        nnz = new = taken = 0
        while at + taken < n:
            block = rows.block(at + taken, min(n, at + taken + 4 * min_stride))
            t = taken + 1 + np.arange(len(block))
            entries = nnz + np.cumsum([len(r) for r in block])
            fresh = new + np.cumsum([int((r < at).sum()) for r in block])
            fits = ((working_set_gcn(entries, fresh, width, out, t, size) < cache) | (t <= min_stride)) & (t < share)
            if not fits.all():
                return taken + int(np.argmin(fits))
            nnz, new, taken = int(entries[-1]), int(fresh[-1]), taken + len(block)
        return taken

    bounds, stride = [0], min_stride
    while bounds[-1] < n:
        at = bounds[-1]
        far = farthest(at)
        while stride > max(1, far) and far < n - at:
            stride = max(1, stride // 2)
        far = max(far, 1) if stride == 1 else far
        if far >= n - at:
            break
        whole = far // stride
        bounds.append(at + whole * stride)
        if min(n - at, (whole + 1) * stride) >= 3 * stride:
            stride *= 2
        rows.forget(bounds[-1])
    return [*bounds, n]


def tile_size_statistics(tiles: DataFrame) -> DataFrame:
    """Population mean and deviation of tile sizes."""
    return tiles.agg(F.avg(F.col("hi") - F.col("lo")).alias("mean"), F.stddev_pop(F.col("hi") - F.col("lo")).alias("std"))


def parents(e: DataFrame, schedule: DataFrame, tile: int) -> DataFrame:
    """``part, parent``: the tiles of level 0 that a part of level 1 waits for."""
    s = schedule.where("level = 1").select("part", F.col("id").alias("i"))
    return s.join(e.select("i", "j"), "i").select("part", F.floor(F.col("j") / tile).alias("parent")).distinct()


def check_fusion(w1: DataFrame, w2: DataFrame, n: int, tile: int, mode: str = "compat") -> DataFrame:
    """Rows of the second layer that fuse, given the masked matrices of both layers.

    ``strict``: all needed, non-empty rows of layer 1 lie in the row's tile. ``compat``: needs add up over the rows of a
    tile so far, the least may lie before the tile, the last tile that reaches the end is left out.
    """
    made = w1.select(F.col("i").alias("j")).distinct()
    need = w2.join(made, "j", "left_semi").groupBy("i").agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
    rows = w2.select("i").distinct().join(need, "i", "left").withColumn("t", F.floor(F.col("i") / tile) * tile)
    if mode == "strict":
        return rows.where(F.col("lo").isNull() | ((F.col("lo") >= F.col("t")) & (F.col("hi") < F.col("t") + tile))).select("i")
    so_far = Window.partitionBy("t").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("a", F.min("lo").over(so_far)).withColumn("b", F.max("hi").over(so_far)).where(F.col("t") + tile < n)
    return run.where(F.col("a").isNull() | ((F.col("a") <= F.col("t")) & (F.col("b") < F.col("t") + tile))).select("i")


def fusion_by_tile_size(w1: DataFrame, w2: DataFrame, n: int, sizes: list[int], mode: str = "compat") -> DataFrame:
    """``tile, fused, ratio, ratio_nonzero`` for each tile size."""
    out = None
    nonzero = w2.agg(F.countDistinct("i").alias("nz"))
    for t in sizes:
        one = check_fusion(w1, w2, n, t, mode).agg(F.count("*").alias("fused")).select(F.lit(t).alias("tile"), "fused")
        out = one if out is None else out.union(one)
    return out.join(F.broadcast(nonzero)).select("tile", "fused", (F.col("fused") / F.lit(float(n))).alias("ratio"), F.try_divide(F.col("fused").cast("double"), F.col("nz")).alias("ratio_nonzero"))


def tile_conflicts(e: DataFrame, n: int, tile: int, drop_incomplete: bool = False) -> DataFrame:
    """``a, b`` (a < b): row tiles that a column touches both. Tiles of a column are distinct before they are
    paired, and pairs are distinct before they travel."""
    last = n // tile if drop_incomplete else -(-n // tile)
    t = e.select("j", F.floor(F.col("i") / tile).alias("t")).where(F.col("t") < last).distinct()
    return t.withColumnRenamed("t", "a").join(t.withColumnRenamed("t", "b"), "j").where("a < b").select("a", "b").distinct()


def tile_conflicts_k(e: DataFrame, n: int, tile: int, out: int, k_tile: int, drop_incomplete: bool = False) -> DataFrame:
    """P14 with k tiles: nodes are ``tile * (out div k_tile) + k``; only equal k conflict. Row tiles conflict if they share
    a column index."""
    ks = out // k_tile
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ks - 1).cast("long")))
    return tile_conflicts(e, n, tile, drop_incomplete).withColumn("k", k).select((F.col("a") * ks + F.col("k")).alias("a"), (F.col("b") * ks + F.col("k")).alias("b"))


def lowest_free(colours) -> int:
    """The least colour that no neighbour has."""
    used, c = set(colours), 0
    while c in used:
        c += 1
    return c


def dsatur(conflicts: DataFrame, nodes: list[int]) -> dict[int, int]:
    """Greedy colouring by saturation. The first node has most neighbours; then always the one with most coloured
    neighbours; ties go to the least name read as text. Sequential over tiles, which are few: on the driver."""
    near: dict[int, set[int]] = {v: set() for v in nodes}
    for r in conflicts.toLocalIterator():
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    colour: dict[int, int] = {}
    wanted = {v: 0 for v in nodes}
    left = sorted(nodes, key=str)
    while left:
        v = max(left, key=lambda x: len(near[x])) if not colour else max(left, key=lambda x: wanted[x])
        colour[v] = lowest_free(colour[u] for u in near[v] if u in colour)
        left.remove(v)
        for u in near[v]:
            wanted[u] += 1
    return colour


def colouring_faults(conflicts: DataFrame, colours: DataFrame) -> DataFrame:
    """Conflicting tiles that have the same colour; ``colours`` is ``tile, colour``."""
    a = colours.select(F.col("tile").alias("a"), F.col("colour").alias("_ca"))
    b = colours.select(F.col("tile").alias("b"), F.col("colour").alias("_cb"))
    return conflicts.join(a, "a").join(b, "b").where("_ca = _cb").select("a", "b")


def colour_groups(colours: DataFrame) -> DataFrame:
    """``colour, tiles, start``: tiles of each colour (ordered as text) and where the wavefront begins."""
    g = colours.groupBy("colour").agg(F.transform(F.sort_array(F.collect_list(F.col("tile").cast("string"))), lambda x: x.cast("long")).alias("tiles"))
    before = Window.orderBy("colour").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("colour", "tiles", F.coalesce(F.sum(F.size("tiles")).over(before), F.lit(0)).alias("start"))


def wavefront_schedule(colours: DataFrame, n: int, tile: int, k_tiles: int = 1) -> DataFrame:
    """``colour, pos, tile, size``; with k tiles each tile stands as often in a row."""
    g = colour_groups(colours)
    at = g.select("colour", F.posexplode("tiles").alias("p", "tile")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k_tiles - 1))))
    size = F.least(F.lit(tile), F.lit(n) - F.col("tile") * tile)
    return at.select("colour", (F.col("p") * k_tiles + F.col("k")).alias("pos"), "tile", size.alias("size"))


def combined_schedule(colours: DataFrame, n: int, tile: int, least: int) -> DataFrame:
    """``kind, colour, lo, hi``: colours with at least ``least`` tiles run in parallel, tile by tile; tiles of the
    others go to a sequential region (colour -1) in which neighbours are merged into one tile."""
    w = colours.join(F.broadcast(colours.groupBy("colour").agg(F.count("*").alias("m"))), "colour")
    end = F.least(F.lit(n), (F.col("last") + 1) * tile)
    par = w.where(F.col("m") >= least).select(F.lit("parallel").alias("kind"), "colour", F.col("tile").alias("first"), F.col("tile").alias("last"))
    seq = ranked(w.where(F.col("m") < least).select("tile"), "tile")
    seq = seq.groupBy(F.col("tile") - F.col("rank")).agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
    seq = seq.select(F.lit("sequential").alias("kind"), F.lit(-1).alias("colour"), "first", "last")
    return par.union(seq).select("kind", "colour", (F.col("first") * tile).alias("lo"), end.alias("hi"))


def replicated(e: DataFrame, schedule: DataFrame) -> DataFrame:
    """The first loop of each part becomes all that its second loop needs, whoever else makes it."""
    two = schedule.where("loop = 1").select("level", "part", "loop", "id")
    one = two.join(e.select(F.col("i").alias("id"), "j"), "id").select("level", "part", F.lit(0).alias("loop"), F.col("j").alias("id")).distinct()
    return packed(one.union(two))


def balanced(e: DataFrame, schedule: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The parts of level 1 that need fewest rows get these for themselves and move to level 0: as many as the mean
    number of parts by level times the ratio. Ties go to the lower part."""
    parts = schedule.select("level", "part").distinct()
    levels = parts.groupBy("level").count().collect()
    move = int(sum(r["count"] for r in levels) // len(levels) * ratio)
    need = schedule.where("level = 1 and loop = 1").join(e.select(F.col("i").alias("id"), "j"), "id", "left").groupBy("part").agg(F.countDistinct("j").alias("rows"))
    chosen = need.orderBy("rows", "part").limit(move).select("part")
    top = schedule.where("level = 0").agg(F.coalesce(F.max("part"), F.lit(-1)).alias("_top"))
    stay = schedule.where("level = 0").select("level", "part", "loop", "id")
    later = schedule.where("level = 1").join(chosen, "part", "left_anti").select("level", "part", "loop", "id")
    moved = schedule.where("level = 1 and loop = 1").join(chosen, "part", "left_semi").join(F.broadcast(top)).select(F.lit(0).alias("level"), (F.col("part") + F.col("_top") + 1).alias("part"), "loop", "id")
    made = moved.join(e.select(F.col("i").alias("id"), "j"), "id").select("level", "part", F.lit(0).alias("loop"), F.col("j").alias("id")).distinct()
    return packed(stay.union(later).union(moved).union(made))


def layer_schedule(e1: DataFrame, e2: DataFrame, threads: int) -> DataFrame:
    """Non-empty rows of layer 1 in runs of ceil(rows / threads); a row of layer 2 fuses with the first run that
    makes all it needs; the others are cut alike."""
    r1 = ranked(e1.select("i").distinct(), "i")
    n1 = e1.agg(F.countDistinct("i").alias("_n"))
    first = r1.join(F.broadcast(n1)).select("i", F.floor(F.col("rank") / F.ceil(F.col("_n") / threads)).alias("part"))
    made = first.select(F.col("i").alias("j"), "part")
    spread = e2.select("i", "j").join(made, "j", "left").groupBy("i").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.bool_and(F.col("part").isNotNull()).alias("all"))
    fused = spread.where("all and a = b").select(F.lit(0).alias("level"), F.col("a").alias("part"), F.lit(1).alias("loop"), F.col("i").alias("id"))
    rest = ranked(spread.where("not all or a <> b").select("i"), "i")
    n2 = rest.agg(F.count("*").alias("_n"))
    rest = rest.join(F.broadcast(n2)).select(F.lit(1).alias("level"), F.floor(F.col("rank") / F.ceil(F.col("_n") / threads)).alias("part"), F.lit(1).alias("loop"), F.col("i").alias("id"))
    one = first.select(F.lit(0).alias("level"), "part", F.lit(0).alias("loop"), F.col("i").alias("id"))
    return packed(one.union(fused).union(rest))


def level_sets(dag: DataFrame, nodes: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """``i, level``: the longest path to each vertex of a DAG of edges j -> i. A vertex has its level when all before
    it have theirs, so each edge is followed once, in the round of its start. ValueError on a cycle, whose vertices wait
    for each other."""
    from tessel.session import cut

    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = dag.join(nodes.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j").repartition(parts, "j").persist()
    waits = edges.groupBy("i").agg(F.count("*").alias("waits"))
    open_ = F.coalesce("waits", F.lit(0))
    state = cut(nodes.join(waits, "i", "left").select("i", F.when(open_ == 0, 0).alias("level"), open_.alias("waits")))
    try:
        for at in range(max_levels):
            left, front = state.agg(F.count_if(F.col("level").isNull()), F.count_if(F.col("level") == at)).first()
            if not left:
                return state.select("i", F.coalesce("level", F.lit(0)).alias("level"))
            if not front:
                break
            met = edges.join(state.where(F.col("level") == at).select(F.col("i").alias("j")), "j").groupBy("i").agg(F.count("*").alias("_met"))
            still = F.col("waits") - F.coalesce("_met", F.lit(0))
            level = F.when(F.col("level").isNull() & (still == 0), at + 1).otherwise(F.col("level"))
            state = cut(state.join(met, "i", "left").select("i", level.alias("level"), still.alias("waits")), state)
    finally:
        edges.unpersist()
    raise ValueError("levels do not settle: the graph has a cycle, or paths beyond max_levels")


def lbc(e: DataFrame, n: int, n_parts: int) -> DataFrame:
    """``id, level, part``: a matrix with more entries than rows gets level sets of its lower triangle, each level
    cut evenly; another one gets a single level of consecutive ids."""
    if e.count() > n:
        low = e.where("i > j").select("i", "j")
        lv = level_sets(low, rows_of(e, n))
        w = Window.partitionBy("level").orderBy("i")
        per = F.ceil(F.count("*").over(Window.partitionBy("level")) / n_parts)
        return lv.select(F.col("i").alias("id"), "level", F.floor((F.row_number().over(w) - 1) / per).alias("part"))
    return e.sparkSession.range(n).select("id", F.lit(0).alias("level"), even_parts(n, n_parts).alias("part"))


def bfs_parts(e: DataFrame, weights: dict[int, float] | list[float], parts: int) -> list[list[int]]:
    """Parts grown breadth-first from the least vertex not yet seen; reaching a neighbour queues its neighbours
    too; the queue goes on into the next part and what is left joins the last. Sequential: the adjacency of one graph on
    the driver, for graphs of driver size."""
    n = len(weights)
    near: dict[int, list[int]] = {}
    for r in e.where("i <> j").orderBy("j", "i").toLocalIterator():
        near.setdefault(r["j"], []).append(r["i"])
    share = -(-sum(weights[k] for k in range(n)) // parts)
    seen, out, queue, start = [False] * n, [[] for _ in range(parts)], deque(), 0

    def push(v: int) -> bool:
        if seen[v]:
            return False
        seen[v] = True
        queue.append(v)
        return True

    for part in out:
        load = 0.0
        while load < share:
            if not queue:
                while start < n and seen[start]:
                    start += 1
                if start == n:
                    break
                push(start)
            v = queue.popleft()
            part.append(v)
            load += weights[v]
            for u in near.get(v, ()):
                if push(u):
                    for x in near.get(u, ()):
                        push(x)
    out[-1] += [*queue, *(v for v in range(n) if not seen[v])]
    return out


def sparse_tiling(e: DataFrame, n: int, seeds: int = 4) -> list[list[list[tuple[int, int]]]]:
    """P20: levels of groups of (loop, row).

    Rows are taken ``seeds`` at a time. A group has these rows of the second loop and, of the first, those of them and of
    the columns that they need which no group before has made. It stands in the level after the last of the levels in
    which what it needs was made by others, so whatever a row needs is in its own group or in a level before. Rows of
    the second loop that need nothing are a group of the first level. The level of a group depends on all before it:
    rows are read as a stream and the driver holds a level for each row.
    """
    rows = e.groupBy("i").agg(F.sort_array(F.collect_set("j")).alias("cols")).orderBy("i").toLocalIterator()
    made = np.full(n, -1, np.int64)
    levels: list[list[list[tuple[int, int]]]] = [[]]
    free: list[int] = []
    row = next(rows, None)
    for at in range(0, n, seeds):
        own = list(range(at, min(n, at + seeds)))
        needs, second = set(own), []
        for i in own:
            if row is not None and row["i"] == i:
                needs.update(row["cols"])
                second.append(i)
                row = next(rows, None)
            else:
                free.append(i)
        k = np.array(sorted(needs))
        level = int(made[k].max()) + 1
        new = k[made[k] < 0]
        made[new] = level
        group = [(0, int(v)) for v in new] + [(1, i) for i in second]
        if group:
            levels += [[] for _ in range(level + 1 - len(levels))]
            levels[level].append(group)
    if free:
        levels[0].append([(1, i) for i in free])
    return levels


def tiling_schedule(spark: SparkSession, levels: list[list[list[tuple[int, int]]]]) -> DataFrame:
    """P20 as a schedule: ``level, part, pos, loop, id``."""
    flat = [(a, b, p, k, i) for a, level in enumerate(levels) for b, group in enumerate(level) for p, (k, i) in enumerate(group)]
    return spark.createDataFrame(flat, "level int, part long, pos long, loop int, id long")


def order_faults(e: DataFrame, schedule: DataFrame) -> DataFrame:
    """``i, j``: rows i of the second loop that run before a row j of the first which they need: in the same level but
    another part, in a level before it, or without it."""
    made = schedule.where("loop = 0").select("level", "part", F.col("id").alias("j"))
    used = schedule.where("loop = 1").select(F.col("level").alias("_l"), F.col("part").alias("_p"), F.col("id").alias("i"))
    ready = (F.col("level") < F.col("_l")) | ((F.col("level") == F.col("_l")) & (F.col("part") == F.col("_p")))
    pairs = used.join(e.select("i", "j"), "i").join(made, "j", "left")
    return pairs.groupBy("i", "j", "_l", "_p").agg(F.bool_or(F.coalesce(ready, F.lit(False))).alias("_ok")).where("not _ok").select("i", "j")


def product_by_schedule(e: DataFrame, x: DataFrame, schedule: DataFrame) -> DataFrame:
    """``A (A x)`` as ``i, x``, each row made where the schedule makes it: the second loop adds up only what its own
    part or a level before has made, so that a schedule out of order shows in the result."""
    first = schedule.where("loop = 0").select("level", "part", F.col("id").alias("i"))
    z = first.join(e, "i").join(x, "j").groupBy("level", "part", "i").agg(F.sum(F.col("v") * F.col("x")).alias("z"))
    made = z.select(F.col("level").alias("_l"), F.col("part").alias("_p"), F.col("i").alias("j"), "z")
    second = schedule.where("loop = 1").select("level", "part", F.col("id").alias("i"))
    ready = (F.col("_l") < F.col("level")) | ((F.col("_l") == F.col("level")) & (F.col("_p") == F.col("part")))
    used = second.join(e, "i").join(made, "j").where(ready)
    return used.groupBy("i").agg(F.sum(F.col("v") * F.col("z")).alias("x"))


def partition_dag(e: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between the parts of their ends."""
    a = parts.select(F.col("id").alias("i"), F.col("part").alias("src"))
    b = parts.select(F.col("id").alias("j"), F.col("part").alias("dst"))
    return e.join(a, "i").join(b, "j").select("src", "dst").where("src <> dst").distinct()


def launch_grid(n: int, per_block: int, width: int, per_thread: int = 1) -> tuple[int, int]:
    """Blocks over rows and over columns."""
    return -(-n // per_block), -(-width // per_thread)


def describe(schedule: DataFrame) -> DataFrame:
    """IO19: ``level, part, iterations, loops, order``: the schedule as lines to read, an entry ``loop:id`` for each
    iteration in its order."""
    entry = F.concat_ws(":", "loop", "id")
    g = schedule.groupBy("level", "part").agg(F.count("*").alias("iterations"), F.countDistinct("loop").alias("loops"), F.sort_array(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("all"))
    return g.select("level", "part", "iterations", "loops", F.array_join("all.entry", " ").alias("order"))
