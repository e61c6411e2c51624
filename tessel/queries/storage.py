"""Sources and sinks: what is written and read again must be what was there."""

import tempfile
import uuid

from pyspark.sql import functions as F

from tessel.operators.structure import banded, csr_rows, identity, random_dense, random_sparse
from tessel.sources import benchlog, graphs
from tessel.sources import matrix as M

from . import query, replayed
from .fixtures import OUT


def _place(f) -> str:
    where = f.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{where.rstrip('/') if where else tempfile.mkdtemp(prefix='tessel-files-')}/{uuid.uuid4().hex}"


@query("io1_io13_mtx", "SELECT i, j, v FROM e_w")
def _(f):
    M.write_mtx(f.e_w, p := _place(f) + ".mtx", (f.n, f.n))
    return M.read_matrix(f.spark, p)[0]


@query("io1_mtx_pattern", "SELECT i, j, v FROM e_hole")
def _(f):
    M.write_mtx(f.e_hole, p := _place(f) + ".mtx", (f.n, f.n), pattern=True)
    return M.read_mtx(f.spark, p)[0]


@query("io2_mtx_array", "SELECT k AS j, c AS k, w AS x FROM w")
def _(f):
    M.write_mtx_array(f.w.select(F.col("k").alias("j"), F.col("c").alias("k"), F.col("w").alias("x")), p := _place(f) + ".mtx", (64, OUT))
    return M.read_matrix(f.spark, p)[0]


@query("io3_smtx", "SELECT i, j, v FROM e_hole")
def _(f):
    M.write_smtx(csr_rows(f.e_hole), f.n, f.n, p := _place(f) + ".smtx")
    return M.read_matrix(f.spark, p)[0]


@query("io5_random_sparse", f"SELECT DISTINCT {replayed('k', '1', seed=7)} % n AS i, {replayed('k', '2', seed=7)} % n AS j, 1.0::DOUBLE AS v FROM (SELECT n, unnest(range(round(0.01 * n * n)::BIGINT)) AS k FROM n)")
def _(f):
    return random_sparse(f.spark, f.n, 0.01, 7)


@query("io6_random_dense", f"SELECT i AS j, k, {replayed('i', 'k', seed=7)} / 1073741824.0::DOUBLE - 1 AS x FROM ids, (SELECT unnest(range(4)) AS k)")
def _(f):
    return random_dense(f.spark, f.n, 4, 7)


@query("io7_identity", "SELECT i, i AS j, 1.0::DOUBLE AS v FROM ids")
def _(f):
    return identity(f.spark, f.n)


@query("io8_banded", "SELECT i, unnest(range(greatest(0, i - 2), least(n, i + 3))) AS j, 1.0::DOUBLE AS v FROM ids, n")
def _(f):
    return banded(f.spark, f.n, 5)


@query("io8_banded_even", "SELECT i, unnest(range(greatest(0, trunc(i - 1.5)::BIGINT), least(n, trunc(i + 2.5)::BIGINT))) AS j, 1.0::DOUBLE AS v FROM ids, n")
def _(f):
    return banded(f.spark, f.n, 4)


def _cora(f):
    p = _place(f)
    emb = f.table("embeddings")
    flags = F.array_join(F.transform(F.slice("embedding", 1, 16), lambda x: F.when(x > 0.1, "1").otherwise("0")), "\t")
    emb.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select(F.concat_ws("\t", F.concat(F.lit("p"), F.col("vec_id")), flags, F.concat(F.lit("c"), F.col("label"))).alias("value")).write.text(p + ".content")
    f.e_hole.select(F.concat(F.lit("p"), "i").alias("a"), F.concat(F.lit("p"), "j").alias("b")).write.option("sep", "\t").csv(p + ".cites")
    return graphs.read_cora(f.spark, p + ".content", p + ".cites")


@query("io9_cora_edges", "SELECT i, j, v FROM e_sym")
def _(f):
    return _cora(f)[2]


@query("io9_cora_features", """SELECT v.vec_id AS i, y, k, 1.0::DOUBLE AS x FROM (SELECT vec_id, label, embedding, unnest(range(16)) AS k FROM embeddings) v
  JOIN (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS y FROM embeddings GROUP BY label) l USING (label) WHERE embedding[k + 1]::DOUBLE > 0.1""")
def _(f):
    nodes, feats, _e = _cora(f)
    return feats.join(nodes, "i").select("i", "y", "k", "x")


def _pubmed(f):
    p = _place(f)
    head = "NODE\npaper\ncat=1,2:label\t" + "\t".join(f"numeric:w{k}:0.0" for k in range(3))
    val = [F.when((F.col("i") * 7 + k) % 5 != 0, F.concat(F.lit(f"w{k}="), ((F.col("i") * 7 + k) % 5).cast("double").cast("string"))) for k in range(3)]
    rows = f.y.repartitionByRange(3, "i").sortWithinPartitions("i").select(F.concat_ws("\t", F.concat(F.lit("n"), "i"), F.concat(F.lit("label="), (F.col("y") + 1).cast("string")), *val).alias("value"))
    f.spark.createDataFrame([(head.split("\n", 1)[0],), (head.split("\n", 2)[2],)], "value string").coalesce(1).union(rows).write.text(p + ".nodes")
    edges = f.e_hole.select(F.concat(F.lit("1\tpaper:n"), "i", F.lit("\t|\tpaper:n"), "j").alias("value"))
    f.spark.createDataFrame([("DIRECTED",), ("NO_FEATURES",)], "value string").coalesce(1).union(edges).write.text(p + ".cites")
    return graphs.read_pubmed(f.spark, p + ".nodes", p + ".cites")


@query("io10_pubmed", "SELECT i, y, k, x FROM (SELECT i, y FROM y), (SELECT unnest(range(3)) AS k), LATERAL (SELECT ((i * 7 + k) % 5)::DOUBLE AS x) WHERE x <> 0")
def _(f):
    y, x, _e = _pubmed(f)
    return x.join(y, "i").select("i", "y", "k", "x")


@query("io10_pubmed_edges", "SELECT i, j, v FROM e_sym")
def _(f):
    return _pubmed(f)[2]


_ROLE = "role AS (SELECT i, CASE WHEN i % 10 < 6 THEN 'tr' WHEN i % 10 < 8 THEN 'va' ELSE 'te' END AS role FROM ids)"


@query("io11_role_edges", """SELECT 'train' AS part, e.i, e.j, e.v FROM e_hole e JOIN role a ON a.i = e.i JOIN role b ON b.i = e.j WHERE a.role = 'tr' AND b.role = 'tr'
  UNION ALL SELECT 'val', e.i, e.j, e.v FROM e_hole e JOIN role a ON a.i = e.i JOIN role b ON b.i = e.j WHERE a.role <> 'te' AND b.role <> 'te'""", _ROLE)
def _(f):
    m = F.col("i") % 10
    roles = f.spark.range(f.n).withColumnRenamed("id", "i").withColumn("role", F.when(m < 6, "tr").when(m < 8, "va").otherwise("te"))
    train, val = graphs.role_edges(f.e_hole, roles)
    return train.select(F.lit("train").alias("part"), "*").union(val.select(F.lit("val").alias("part"), "*"))


@query("io12_heterogeneous", """SELECT DISTINCT l_suppkey - 1 AS i, l_partkey - 1 + s AS j, 1.0::DOUBLE AS v FROM lineitem, (SELECT count(*) AS s FROM supplier)
  UNION ALL SELECT DISTINCT l_partkey - 1 + s, l_suppkey - 1, 1.0::DOUBLE FROM lineitem, (SELECT count(*) AS s FROM supplier)""")
def _(f):
    sizes = f.table("supplier").agg(F.count("*").alias("n")).select(F.lit("a_supplier").alias("type"), "n").union(f.table("part").agg(F.count("*").alias("n")).select(F.lit("b_part").alias("type"), "n"))
    one = f.table("lineitem").select((F.col("l_suppkey") - 1).alias("i"), (F.col("l_partkey") - 1).alias("j")).distinct()
    e = one.select(F.lit("a_supplier").alias("src_type"), F.lit("b_part").alias("dst_type"), "i", "j").union(one.select(F.lit("b_part"), F.lit("a_supplier"), "j", "i"))
    return graphs.heterogeneous(sizes, e)


@query("io14_class_map", "SELECT i, CASE WHEN i % 7 = 0 THEN -1 ELSE y END::INTEGER AS y FROM y")
def _(f):
    y = graphs.class_map(f.y.select("i", F.when(F.col("i") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y").cast("double")).alias("y")))
    graphs.write_json(y, p := _place(f))
    return f.spark.read.schema("i long, y int").json(p)


@query("io15_io16_log_files", 'SELECT MatrixName, "Implementation Name", NNZ, MTile, "Trial0 Subregion0 Executor" AS trial0, "Number of Fused nnz0" AS fused FROM log')
def _(f):
    p = _place(f)
    benchlog.write_log(f.log.where("MTile = 16"), p + "/a")
    benchlog.write_log(f.log.where("MTile <> 16").withColumnRenamed("MatrixName", "Matrix Name"), p + "/b")
    d = benchlog.read_logs(f.spark, p + "/a", p + "/b")
    return d.select("MatrixName", "Implementation Name", F.col("NNZ").cast("long").alias("NNZ"), "MTile", F.col("Trial0 Subregion0 Executor").alias("trial0"), F.col("Number of Fused nnz0").cast("long").alias("fused"))


@query("io17_catalogue", "SELECT MatrixName AS name FROM log GROUP BY MatrixName HAVING any_value(NNZ) >= 100000 AND any_value(NNZ) % 3 <> 0")
def _(f):
    c = f.log.select(F.col("MatrixName").alias("name"), F.col("NNZ").alias("nnz"), (F.col("NNZ") % 3 != 0).alias("isspd"), F.lit("real").alias("dtype"), F.lit(1000).alias("rows"), F.lit(1000).alias("cols")).distinct()
    return M.catalogue(c).select("name")


@query("io18_list_matrices", "SELECT count(*) AS files FROM (VALUES (1), (2)) t")
def _(f):
    p = _place(f)
    f.spark.createDataFrame([(1,)], "a int").coalesce(1).write.parquet(p + "/x")
    for k in (1, 2):
        fs = f.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/m{k}.smtx")
        out = fs.getFileSystem(f.spark.sparkContext._jsc.hadoopConfiguration()).create(fs)
        out.write(48)
        out.close()
    return M.list_matrices(f.spark, p).agg(F.count("*").alias("files"))
