"""Scheduling analytics."""

from pyspark.sql import functions as F

from tessel.operators import schedule as T

from . import query, r6, s6
from .algebra import _SCHED

TILE = 64


def sched(f):
    return T.fixed_tile_schedule(f.e_local, f.n, TILE)


@query("p1_even_parts", "SELECT i AS id, i // ceil(n / 7.0)::BIGINT AS part FROM ids, n")
def _(f):
    return f.spark.range(f.n).select("id", T.even_parts(f.n, 7).alias("part"))


@query("p1_weighted_parts", "SELECT i AS id, (SELECT count(*) FROM rec WHERE k BETWEEN 1 AND 7 AND pos <= cum - w)::INTEGER AS part FROM wt", """wt AS (SELECT i, (i % 5 + 1)::DOUBLE AS w, sum(i % 5 + 1) OVER (ORDER BY i)::DOUBLE AS cum FROM ids), sh AS (SELECT ceil(sum(w) / 7) AS share FROM wt),
  nx AS (SELECT s.cum AS pos, min(t.cum) AS nxt FROM (SELECT cum FROM wt UNION ALL SELECT 0) s, sh JOIN wt t ON t.cum >= s.cum + share GROUP BY s.cum), rec AS (SELECT 0 AS k, 0::DOUBLE AS pos UNION ALL SELECT k + 1, nxt FROM rec JOIN nx USING (pos) WHERE k < 7)""")
def _(f):
    return T.weighted_parts(f.spark.range(f.n).select("id", (F.col("id") % 5 + 1).cast("double").alias("w")), 7)


@query("p3_level_sets", "SELECT i, max(level)::INTEGER AS level FROM lv GROUP BY i", "dag AS (SELECT i, j FROM e_hole WHERE i > j), lv AS (SELECT i, 0 AS level FROM ids UNION SELECT dag.i, level + 1 FROM lv JOIN dag ON dag.j = lv.i)")
def _(f):
    return T.level_sets(f.e_hole.where("i > j").select("i", "j"), T.rows_of(f.e_hole, f.n))


@query(
    "p3_partition",
    "SELECT i AS id, level, (row_number() OVER (PARTITION BY level ORDER BY i) - 1) // ceil(count(*) OVER (PARTITION BY level) / 4.0)::BIGINT AS part FROM (SELECT i, max(level)::INTEGER AS level FROM lv GROUP BY i)",
    "dag AS (SELECT i, j FROM e_hole WHERE i > j), lv AS (SELECT i, 0 AS level FROM ids UNION SELECT dag.i, level + 1 FROM lv JOIN dag ON dag.j = lv.i)",
)
def _(f):
    return T.lbc(f.e_hole, f.n, 4).select("id", "level", F.col("part").cast("long").alias("part"))


@query(
    "p4_pairing",
    """SELECT level, part, loop, id FROM (SELECT 0 AS level, i // 50 AS part, 0 AS loop, i AS id FROM ids UNION ALL SELECT 0, i // 50, 1, i FROM ok WHERE ok
  UNION ALL SELECT 1, (r - 1) // ceil(t / 4.0)::BIGINT, 1, i FROM (SELECT i, row_number() OVER (ORDER BY i) AS r, count(*) OVER () AS t FROM ok WHERE NOT ok))""",
    "ok AS (SELECT ids.i, coalesce(bool_and(e.j // 50 = ids.i // 50), true) AS ok FROM ids LEFT JOIN e_local e ON e.i = ids.i GROUP BY ids.i)",
)
def _(f):
    parts = f.spark.range(f.n).select("id", F.floor(F.col("id") / 50).alias("part"))
    return T.pairing(f.e_local, parts, f.n, 4).select("level", "part", "loop", "id")


@query("p5_packed_interleaved", "SELECT level, part, row_number() OVER (PARTITION BY level, part ORDER BY id, loop) - 1 AS pos, loop, id FROM raw", _SCHED)
def _(f):
    return T.packed(sched(f), separated=False).select("level", "part", F.col("pos").cast("long").alias("pos"), "loop", "id")


@query("p6_fused_statistics", f"SELECT count(*) FILTER (level = 0) AS fused_rows, coalesce(sum(nnz) FILTER (level = 0), 0)::BIGINT AS fused_nnz, {s6('count(*) FILTER (level = 0) / count(*)::DOUBLE', 'fused_ratio')} FROM sched LEFT JOIN (SELECT i, count(*) AS nnz FROM e_local GROUP BY i) d ON d.i = id WHERE loop = 1", _SCHED)
def _(f):
    return T.fused_statistics(sched(f), f.e_local).select("fused_rows", "fused_nnz", r6("fused_ratio", "fused_ratio"))


@query("p6_fused_rows_of_band", "SELECT n - 2 * (ceil(n / 32.0)::BIGINT - 1) AS fused_rows FROM n")
def _(f):
    return T.fusibility(f.band(3), f.n, 32).agg(F.sum(F.col("fused").cast("long")).alias("fused_rows"))


@query("p7_reuse_count", "SELECT count(*) AS reuse FROM sched u JOIN e_local e ON e.i = u.id JOIN sched m ON m.id = e.j AND m.loop = 0 AND m.level = u.level AND m.part = u.part WHERE u.loop = 1", _SCHED)
def _(f):
    return T.reuse_count(f.e_local, sched(f))


_REP = "two AS (SELECT level, part, loop, id FROM sched WHERE loop = 1), rep AS (SELECT * FROM two UNION ALL SELECT DISTINCT level, part, 0, e.j FROM two JOIN e_local e ON e.i = two.id)"


@query("p8_redundancy", "SELECT sum(a - u)::BIGINT AS redundant, sum(u)::BIGINT AS unique FROM (SELECT count(*) AS a, count(DISTINCT id) AS u FROM rep GROUP BY loop)", _SCHED + ", " + _REP)
def _(f):
    return T.redundancy(T.replicated(f.e_local, sched(f)))


@query("p9_gemm_bounds", f"SELECT i // {TILE} AS tile, min(j) AS lower, max(j) + 1 AS upper FROM e_local GROUP BY 1")
def _(f):
    return T.gemm_bounds(f.e_local, TILE)


@query("p9_gemm_max_width", f"SELECT max(u - l) AS max_width FROM (SELECT min(j) AS l, max(j) + 1 AS u FROM e_local GROUP BY i // {TILE})")
def _(f):
    return T.gemm_max_width(f.e_local, TILE)


_NEED = f"tl AS (SELECT unnest(range(ceil(n / {TILE}.0)::BIGINT)) AS tile FROM n), lst AS (SELECT i, max(j // {TILE}) AS last FROM e_local GROUP BY i), nd AS (SELECT tl.tile, coalesce(max(last), 0) AS need FROM tl LEFT JOIN e_local e ON e.j // {TILE} = tl.tile LEFT JOIN lst ON lst.i = e.i GROUP BY tl.tile)"


@query("p10_last_needed_tile", "SELECT * FROM nd", _NEED)
def _(f):
    return T.last_needed_tile(f.e_local, f.n, TILE)


@query("p10_interleaved_tiles", f"SELECT tile * {TILE} AS start, CASE WHEN n % {TILE} <> 0 AND tile = n // {TILE} THEN 2 ELSE 0 END AS type, tile AS need, 0 AS kind FROM tl, n UNION ALL SELECT tile * {TILE}, CASE WHEN n % {TILE} <> 0 AND tile = n // {TILE} THEN 3 ELSE 1 END, need, 1 FROM nd, n", _NEED)
def _(f):
    return T.interleaved_tiles(f.e_local, f.n, TILE)


@query("p11_fixed_tile_schedule", "SELECT * FROM sched", _SCHED)
def _(f):
    return sched(f).withColumn("pos", F.col("pos").cast("long"))


_VAR = f"""sz AS (SELECT n, least(128, n) AS fst, n // least(128, n) AS cnt, n % least(128, n) AS extra FROM n), pr AS (SELECT *, -(-extra // cnt) AS per FROM (SELECT n, fst, cnt, extra FROM sz)),
  st AS (SELECT k * fst + least(k * p, extra) AS lo, (k + 1) * fst + least((k + 1) * p, extra) AS hi FROM (SELECT fst, extra, ceil(extra / cnt::DOUBLE)::BIGINT AS p, unnest(range(cnt)) AS k FROM sz)),
  tl AS (SELECT lo, hi, lo AS plo, hi AS phi, 0 AS depth FROM st UNION ALL
    SELECT CASE WHEN h = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN h = 0 THEN lo + (hi - lo) // 2 ELSE hi END, lo, hi, depth + 1 FROM tl, (VALUES (0), (1)) t(h) WHERE hi - lo > 1),
  spn AS (SELECT min(j) AS a, max(j) AS b FROM e_local GROUP BY i),
  wset AS (SELECT lo, hi, plo, phi, depth, (SELECT count(*) FROM spn WHERE a >= lo AND b < hi) AS fused, (SELECT count(*) FROM e_local WHERE i >= lo AND i < hi) AS nnz, (SELECT count(DISTINCT j) FROM e_local WHERE i >= lo AND i < hi) AS cols FROM tl),
  lrg AS (SELECT lo, hi, plo, phi, depth, fused, (nnz + cols * 32 + (hi - lo) * 32 + fused * 32) * 8 + nnz * 4 > 60000 AND hi - lo > 1 AS large FROM wset),
  alive AS (SELECT * FROM lrg WHERE depth = 0 UNION ALL SELECT c.* FROM alive p JOIN lrg c ON c.depth = p.depth + 1 AND c.plo = p.lo AND c.phi = p.hi WHERE p.large),
  vt AS (SELECT lo, hi, fused FROM alive WHERE NOT large)"""


@query("p11b_variable_tiles", "SELECT * FROM vt", _VAR)
def _(f):
    return T.variable_tiles(f.e_local, f.n, 32, 60_000, start=128)


# the farthest row of every possible bound, then a walk over bounds and strides
_GROWN = """lst AS (SELECT i, coalesce(lag(i) OVER (PARTITION BY j ORDER BY i), -1) AS before FROM e_local),
  near AS (SELECT a.i AS pos, r.i FROM ids a, ids r, n WHERE r.i >= a.i AND r.i - a.i < n),
  cnts AS (SELECT pos, near.i, count(before) AS nnz, count(before) FILTER (before < pos) AS fresh FROM near LEFT JOIN lst ON lst.i = near.i GROUP BY pos, near.i),
  run AS (SELECT pos, i - pos + 1 AS t, sum(nnz) OVER w AS nnz, sum(fresh) OVER w AS fresh FROM cnts WINDOW w AS (PARTITION BY pos ORDER BY i ROWS UNBOUNDED PRECEDING)),
  far AS (SELECT pos, coalesce(min(t) FILTER (NOT (((8 * 16 * 2 + t * 8 + t * 16 + fresh * 16 + fresh * 8) * 8 + nnz * 4 < 60000 OR t <= 16) AND t < n / 4.0)) - 1, max(t)) AS far FROM run, n GROUP BY pos),
  walk AS (SELECT 0::BIGINT AS pos, 16::BIGINT AS stride, false AS cut, false AS fin, 0 AS step UNION ALL
    SELECT CASE WHEN short OR ends THEN pos ELSE pos + m * stride END, CASE WHEN short THEN greatest(1, stride // 2) WHEN NOT ends AND least(n - pos, (m + 1) * stride) >= 3 * stride THEN stride * 2 ELSE stride END, NOT short, ends, step + 1
    FROM (SELECT *, far >= n - pos AS ends, far < n - pos AND stride > far AS short, far // stride AS m
      FROM (SELECT walk.pos, stride, step, n, CASE WHEN stride = 1 THEN greatest(far.far, 1) ELSE far.far END AS far FROM walk JOIN far USING (pos), n WHERE NOT fin))),
  bnd AS (SELECT DISTINCT pos FROM walk)"""


@query("p11b_grown_tiles", "SELECT pos AS lo, coalesce(lead(pos) OVER (ORDER BY pos), n) AS hi FROM bnd, n", _GROWN)
def _(f):
    b = T.grown_tiles(f.e_local, f.n, 16, 8, 60_000, 4)
    return f.spark.createDataFrame(list(zip(b, b[1:])), "lo long, hi long")


@query("p11c_tile_sizes", f"SELECT {s6('avg(hi - lo)', 'mean')}, {s6('stddev_pop(hi - lo)', 'std')} FROM vt", _VAR)
def _(f):
    t = T.tile_size_statistics(T.variable_tiles(f.e_local, f.n, 32, 60_000, start=128))
    return t.select(r6("mean", "mean"), r6("std", "std"))


@query("p12_parents", f"SELECT DISTINCT part, e.j // {TILE} AS parent FROM sched JOIN e_local e ON e.i = id WHERE level = 1", _SCHED)
def _(f):
    return T.parents(f.e_local, sched(f), TILE)


_W12 = """w2 AS (SELECT i, j FROM e_local WHERE i IN (SELECT i FROM sampled)), made AS (SELECT DISTINCT i FROM e_local WHERE i IN (SELECT j FROM w2)),
  need AS (SELECT i, min(j) AS lo, max(j) AS hi FROM w2 WHERE j IN (SELECT i FROM made) GROUP BY i), rws AS (SELECT DISTINCT i FROM w2)"""


def _layers(f):
    w2 = f.e_local.join(f.sampled, "i", "left_semi")
    return f.e_local.join(w2.select(F.col("j").alias("i")).distinct(), "i", "left_semi"), w2


@query("p13_check_fusion_strict", f"SELECT i FROM rws LEFT JOIN need USING (i) WHERE lo IS NULL OR (lo >= i // {TILE} * {TILE} AND hi < i // {TILE} * {TILE} + {TILE})", _W12)
def _(f):
    return T.check_fusion(*_layers(f), f.n, TILE, "strict")


@query("p13_check_fusion_compat", f"SELECT i FROM cum, n WHERE t + {TILE} < n AND (a IS NULL OR (a <= t AND b < t + {TILE}))", _W12 + f", cum AS (SELECT i, i // {TILE} * {TILE} AS t, min(lo) OVER w AS a, max(hi) OVER w AS b FROM rws LEFT JOIN need USING (i) WINDOW w AS (PARTITION BY i // {TILE} ORDER BY i ROWS UNBOUNDED PRECEDING))")
def _(f):
    return T.check_fusion(*_layers(f), f.n, TILE, "compat")


_CONF = "ct AS (SELECT DISTINCT j, i // 64 AS t FROM e_local), cf AS (SELECT DISTINCT p.t AS a, q.t AS b FROM ct p JOIN ct q ON p.j = q.j AND p.t < q.t)"


@query("p14_tile_conflicts", "SELECT * FROM cf", _CONF)
def _(f):
    return T.tile_conflicts(f.e_local, f.n, TILE)


@query("p14_tile_conflicts_k", "SELECT a * 2 + k AS a, b * 2 + k AS b FROM cf, (SELECT unnest(range(2)) AS k)", _CONF)
def _(f):
    return T.tile_conflicts_k(f.e_local, f.n, TILE, 64, 32)


def _colouring(f):
    c = T.tile_conflicts(f.e_local, f.n, TILE)
    return c, f.spark.createDataFrame(list(T.dsatur(c, list(range(-(-f.n // TILE)))).items()), "tile long, colour int")


# one tile is coloured a step: the first has most neighbours, later ones most coloured neighbours; ties by name as text
_DSATUR = """tv AS (SELECT unnest(range(ceil(n / 64.0)::BIGINT)) AS v FROM n), pairs AS (SELECT a AS v, b AS u FROM cf UNION SELECT b, a FROM cf),
  nb AS (SELECT v, coalesce(list(u) FILTER (u IS NOT NULL), []) AS us FROM tv LEFT JOIN pairs USING (v) GROUP BY v),
  ds AS (SELECT 0 AS step, MAP {}::MAP(BIGINT, INTEGER) AS done UNION ALL
    SELECT step + 1, map_concat(done, MAP {v: c}) FROM (
      SELECT step, done, v, list_min(list_filter(range(100), lambda x: NOT list_contains(list_transform(list_filter(us, lambda u: map_contains(done, u)), lambda u: done[u]), x::INTEGER)))::INTEGER AS c,
        row_number() OVER (ORDER BY CASE WHEN step = 0 THEN len(us) ELSE len(list_filter(us, lambda u: map_contains(done, u))) END DESC, v::VARCHAR) AS r
      FROM ds, nb WHERE NOT map_contains(done, v)) WHERE r = 1),
  dsc AS (SELECT unnest(map_entries(done)) AS e FROM (SELECT done FROM ds ORDER BY step DESC LIMIT 1))"""


@query("p15_dsatur", "SELECT e.key AS tile, e.value AS colour FROM dsc", _CONF + ", " + _DSATUR)
def _(f):
    return _colouring(f)[1]


@query("p15_colouring_faults", "SELECT a, b FROM cf JOIN dsc p ON p.e.key = a JOIN dsc q ON q.e.key = b WHERE p.e.value = q.e.value", _CONF + ", " + _DSATUR)
def _(f):
    return T.colouring_faults(*_colouring(f))


@query("p15b_lowest_free", "SELECT v, min(c) AS colour FROM (SELECT tv.v, unnest(range(100)) AS c FROM tv) x WHERE NOT EXISTS (SELECT 1 FROM pairs JOIN dsc ON dsc.e.key = u WHERE pairs.v = x.v AND dsc.e.value = c AND u < x.v) GROUP BY v", _CONF + ", " + _DSATUR)
def _(f):
    c, colours = _colouring(f)
    near = c.join(colours, F.col("a") == F.col("tile")).groupBy("b").agg(F.collect_set("colour").alias("cs"))
    got = {r["b"]: T.lowest_free(r["cs"]) for r in near.collect()}
    return f.spark.createDataFrame([(v, got.get(v, 0)) for v in range(-(-f.n // TILE))], "v long, colour long")


def _colours(f):
    return f.spark.range(-(-f.n // 20)).select(F.col("id").alias("tile"), F.when(F.col("id") % 5 == 0, 2).otherwise(F.col("id") % 2).cast("int").alias("colour"))


_COL = "col AS (SELECT tile, CASE WHEN tile % 5 = 0 THEN 2 ELSE tile % 2 END::INTEGER AS colour FROM (SELECT unnest(range(ceil(n / 20.0)::BIGINT)) AS tile FROM n))"


@query("p16_wavefronts", "SELECT colour, row_number() OVER (PARTITION BY colour ORDER BY tile::VARCHAR, k) - 1 AS pos, tile, least(20, n - tile * 20) AS size FROM col, n, (SELECT unnest(range(2)) AS k)", _COL)
def _(f):
    return T.wavefront_schedule(_colours(f), f.n, 20, 2).select("colour", F.col("pos").cast("long").alias("pos"), "tile", "size")


@query("p17_combined_schedule", """SELECT 'parallel' AS kind, colour, tile * 20 AS lo, least(n, (tile + 1) * 20) AS hi FROM big, n
  UNION ALL SELECT 'sequential', -1, min(tile) * 20, least(any_value(n), (max(tile) + 1) * 20) FROM (SELECT tile, tile - row_number() OVER (ORDER BY tile) AS g FROM small), n GROUP BY g""", _COL + ", cnt AS (SELECT colour, count(*) AS m FROM col GROUP BY colour), big AS (SELECT col.* FROM col JOIN cnt USING (colour) WHERE m >= 6), small AS (SELECT col.* FROM col JOIN cnt USING (colour) WHERE m < 6)")
def _(f):
    return T.combined_schedule(_colours(f), f.n, 20, 6)


@query("p18_replicated", "SELECT level, part, loop, id FROM rep", _SCHED + ", " + _REP)
def _(f):
    return T.replicated(f.e_local, sched(f)).select("level", "part", "loop", "id")


@query("p19_balanced", """SELECT level, part, loop, id FROM sched WHERE level = 0 OR part NOT IN (SELECT part FROM pick) UNION ALL
  SELECT 0, part + top + 1, 1, id FROM mv UNION ALL SELECT DISTINCT 0, part + top + 1, 0, e.j FROM mv JOIN e_local e ON e.i = mv.id""", _SCHED + """, np AS (SELECT level, count(DISTINCT part) AS c FROM sched GROUP BY level),
  pick AS (SELECT part FROM (SELECT s.part, count(DISTINCT e.j) AS r FROM sched s LEFT JOIN e_local e ON e.i = s.id WHERE level = 1 GROUP BY s.part) ORDER BY r, part LIMIT (SELECT floor(sum(c) // count(*) * 0.5)::BIGINT FROM np)),
  mv AS (SELECT s.part, s.id, (SELECT max(part) FROM sched WHERE level = 0) AS top FROM sched s WHERE level = 1 AND part IN (SELECT part FROM pick))""")
def _(f):
    return T.balanced(f.e_local, sched(f)).select("level", "part", "loop", "id")


# the level in which each row was made is the state; groups of four rows are taken in order
_TILING = """gr AS (SELECT ids.i // 4 AS g, list_distinct(list(ids.i) || coalesce(list(e.j) FILTER (e.j IS NOT NULL), [])) AS needs FROM ids LEFT JOIN e_sym e ON e.i = ids.i GROUP BY ids.i // 4),
  tg AS (SELECT -1::BIGINT AS g, -1::BIGINT AS lv, []::BIGINT[] AS made, list_transform(range(n), lambda x: -1::BIGINT) AS lvs FROM n UNION ALL
    SELECT g, lv, list_filter(needs, lambda k: lvs[k + 1] < 0), list_transform(lvs, lambda x, p: CASE WHEN x < 0 AND list_contains(needs, p - 1) THEN lv ELSE x END)
    FROM (SELECT gr.g, needs, lvs, 1 + list_max(list_transform(needs, lambda k: lvs[k + 1])) AS lv FROM tg JOIN gr ON gr.g = tg.g + 1)),
  td AS (SELECT 0 AS loop, g, lv, unnest(made) AS id FROM tg WHERE g >= 0 UNION ALL SELECT 1, g, lv, i FROM tg JOIN ids ON ids.i // 4 = g WHERE i IN (SELECT i FROM e_sym)),
  gp AS (SELECT g, lv, row_number() OVER (PARTITION BY lv ORDER BY g) - 1 AS part FROM (SELECT DISTINCT g, lv FROM td)),
  tile4 AS (SELECT td.lv::INTEGER AS level, part, loop, id FROM td JOIN gp USING (g, lv) UNION ALL SELECT 0, (SELECT count(*) FROM gp WHERE lv = 0), 1, i FROM ids WHERE i NOT IN (SELECT i FROM e_sym))"""


def _tiling(f):
    return T.tiling_schedule(f.spark, T.sparse_tiling(f.e_sym, f.n))


@query("p20_sparse_tiling", "SELECT * FROM tile4", _TILING)
def _(f):
    return _tiling(f).select("level", "part", "loop", "id")


@query("p20_order_faults", "SELECT i, j FROM e_sym WHERE false")
def _(f):
    return T.order_faults(f.e_sym, _tiling(f))


@query("m4b_product_by_schedule", f"SELECT e.i, {s6('sum(e.v * z.z)')} FROM e_sym e JOIN (SELECT i, sum(v * x) AS z FROM e_sym JOIN vec USING (j) GROUP BY i) z ON z.i = e.j GROUP BY e.i")
def _(f):
    return T.product_by_schedule(f.e_sym, f.vec, _tiling(f)).select("i", r6())


@query("io19_describe_schedule", "SELECT level, part, count(*) AS iterations, count(DISTINCT loop) AS loops, string_agg(loop || ':' || id, ' ' ORDER BY pos) AS order FROM sched GROUP BY level, part", _SCHED)
def _(f):
    return T.describe(sched(f))


@query("p22_launch_grid", "SELECT b, ceil(n / b::DOUBLE)::BIGINT AS rows, ceil(64 / 4.0)::BIGINT AS cols FROM (SELECT unnest([8, 32, 128])::BIGINT AS b), n")
def _(f):
    return f.spark.createDataFrame([(b, *T.launch_grid(f.n, b, 64, 4)) for b in (8, 32, 128)], "b long, rows long, cols long")


# a step either opens the next part or a vertex, or looks at one neighbour of the vertex that was taken last
_BFS = """nbr AS (SELECT i AS v, list(j ORDER BY j) AS us FROM e_band WHERE i <> j GROUP BY i),
  bfs AS (SELECT 0 AS step, 0 AS part, 0::BIGINT AS load, []::BIGINT[] AS q, list_transform(range(n), lambda x: false) AS seen, []::BIGINT[] AS work, -1::BIGINT AS took, n, ceil(n / 7.0)::BIGINT AS share FROM n UNION ALL
    SELECT step + 1, part2, CASE WHEN looks THEN load ELSE load2 + 1 END,
      CASE WHEN NOT looks THEN CASE WHEN len(q) > 0 THEN q[2:] ELSE [] END WHEN seen[work[1] + 1] THEN q ELSE q || [work[1]] || list_filter(coalesce(us, []), lambda x: NOT seen[x + 1]) END,
      CASE WHEN NOT looks THEN list_transform(seen, lambda x, p: x OR p - 1 = c.v) WHEN seen[work[1] + 1] THEN seen ELSE list_transform(seen, lambda x, p: x OR p - 1 = work[1] OR list_contains(coalesce(us, []), p - 1)) END,
      CASE WHEN looks THEN work[2:] ELSE coalesce(us, []) END, CASE WHEN looks THEN -1 ELSE c.v END, n, share
    FROM (SELECT b.*, CASE WHEN looks THEN part WHEN load >= share THEN part + 1 ELSE part END AS part2, CASE WHEN load >= share THEN 0 ELSE load END AS load2
      FROM (SELECT bfs.*, len(work) > 0 AS looks, CASE WHEN len(q) > 0 THEN q[1] ELSE list_position(seen, false) - 1 END AS v FROM bfs) b) c
      LEFT JOIN nbr ON nbr.v = CASE WHEN looks THEN c.work[1] ELSE c.v END
    WHERE looks OR (c.v >= 0 AND part2 < 7)),
  took AS (SELECT took AS id, part FROM bfs WHERE took >= 0)"""


@query("p2_bfs_parts", "SELECT id, part FROM took UNION ALL SELECT i, 6 FROM ids WHERE i NOT IN (SELECT id FROM took)", "e_band AS (SELECT i, j FROM (SELECT i, unnest([i - 1, i, i + 1]) AS j FROM ids), n WHERE j >= 0 AND j < n), " + _BFS)
def _(f):
    parts = T.bfs_parts(f.band(3), [1.0] * f.n, 7)
    return f.spark.createDataFrame([(i, p) for p, ids in enumerate(parts) for i in ids], "id long, part int")


@query("p21_layer_schedule", """SELECT 0 AS level, part, 0 AS loop, i AS id FROM fst UNION ALL SELECT 0, a, 1, i FROM spr WHERE a = b AND whole
  UNION ALL SELECT 1, (row_number() OVER (ORDER BY i) - 1) // ceil(count(*) OVER () / 4.0)::BIGINT, 1, i FROM spr WHERE NOT (coalesce(a = b, false) AND whole)""", _W12 + """, e1 AS (SELECT i, j FROM e_local WHERE i IN (SELECT j FROM w2)),
  fst AS (SELECT i, (row_number() OVER (ORDER BY i) - 1) // ceil(count(*) OVER () / 4.0)::BIGINT AS part FROM (SELECT DISTINCT i FROM e1)),
  spr AS (SELECT w2.i, min(part) AS a, max(part) AS b, bool_and(part IS NOT NULL) AS whole FROM w2 LEFT JOIN fst ON fst.i = w2.j GROUP BY w2.i)""")
def _(f):
    return T.layer_schedule(*_layers(f), 4).select("level", "part", "loop", "id")


@query("p23_working_sets", f"SELECT i // {TILE} AS tile, ((count(*) + count(DISTINCT j) * 32 + {TILE} * 32) * 8 + count(*) * 4)::BIGINT AS bytes FROM e_local GROUP BY 1")
def _(f):
    g = f.e_local.groupBy(F.floor(F.col("i") / TILE).alias("tile")).agg(F.count("*").alias("nnz"), F.countDistinct("j").alias("u"))
    return g.select("tile", T.working_set(F.col("nnz"), F.col("u"), 32, TILE, 0).alias("bytes"))


@query("partition_dag", "SELECT DISTINCT i // 50 AS src, j // 50 AS dst FROM e_hole WHERE i // 50 <> j // 50")
def _(f):
    return T.partition_dag(f.e_hole, f.spark.range(f.n).select("id", F.floor(F.col("id") / 50).alias("part")))
