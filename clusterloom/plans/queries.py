"""One query for each operator, over ``embeddings`` and ``labels``, and SQL that gives the same rows.

Parameters suit vectors whose nearest similarities are 0.3 to 0.6: ten neighbours, thresholds of 0.30 to 0.40.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clusterloom.functions.scratch import cut, scratch_path, table
from clusterloom.operators import baselines, confidence, gnn, graph, knn, metrics, proposals, training, vectors
from clusterloom.operators.components import connected_components, linked
from clusterloom.plans import pipelines
from clusterloom.sources import io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K = 10


class Inputs:
    """Tables that many queries start from."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir
        raw = table(spark, sf_dir, "embeddings")
        self.raw = raw
        self.feats = vectors.features(raw)
        self.labels = raw.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"))
        self._knn = None

    @property
    def knn(self):
        if self._knn is None:
            self._knn = cut(knn.knn_exact(self.feats, K), "query-knn")
        return self._knn

    def pairs(self, th):
        return knn.undirected_pairs(self.knn, th)

    def groups(self, th=0.35):
        """Components of the pairs at a threshold as proposals."""
        found = connected_components(self.pairs(th), src="u", dst="v")
        return cut(found.select(F.col("component").alias("proposal_id"), F.col("id").alias("node")), "query-groups")

    def predicted(self, th=0.35):
        found = connected_components(self.pairs(th), self.feats.select("id"), src="u", dst="v")
        return found.select("id", F.col("component").alias("label"))


BASE = """WITH RECURSIVE e AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings),
sims AS (SELECT a.id, b.id AS nbr, list_dot_product(a.v, b.v) AS sim FROM e a, e b WHERE a.id <> b.id),
knn AS MATERIALIZED (SELECT id, nbr, sim, 1 - sim AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM sims) WHERE rank <= 10),
edges AS (SELECT id AS src, nbr AS dst, sim AS w FROM knn)"""


def pairs_sql(name, th):
    return f""",
{name} AS MATERIALIZED (SELECT least(id, nbr) AS u, greatest(id, nbr) AS v, arg_min(sim, id * 100 + rank) AS score FROM knn WHERE sim >= {th} GROUP BY ALL)"""


def components_sql(name, links, nodes):
    """``links`` gives u, v; ``nodes`` gives id."""
    return f""",
{name}_l AS MATERIALIZED (SELECT u AS a, v AS b FROM ({links}) UNION SELECT v, u FROM ({links})),
{name}_r AS (SELECT id, id AS c FROM ({nodes}) UNION SELECT r.id, l.b FROM {name}_r r JOIN {name}_l l ON r.c = l.a),
{name} AS MATERIALIZED (SELECT id, min(c) AS component FROM {name}_r GROUP BY id)"""


GROUPS = BASE + pairs_sql("p35", 0.35) + components_sql("cc", "SELECT u, v FROM p35", "SELECT u AS id FROM p35 UNION SELECT v FROM p35") + """,
g AS (SELECT component AS proposal_id, id AS node FROM cc), sz AS (SELECT proposal_id, count(*) AS size FROM g GROUP BY ALL)"""
PRED = BASE + pairs_sql("p35", 0.35) + components_sql("cc", "SELECT u, v FROM p35", "SELECT id FROM e") + """,
ct AS (SELECT e.label AS g, cc.component AS p, count(*)::DOUBLE AS n FROM e JOIN cc USING (id) GROUP BY ALL), pn AS (SELECT p, sum(n) AS pn FROM ct GROUP BY p), gn AS (SELECT g, sum(n) AS gn FROM ct GROUP BY g)"""


def query(name, sql=None, base=BASE):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{base}\n{sql}"
        return f

    return put


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- sources and sinks


@query("s4_features_stored", "SELECT id, len(v)::BIGINT AS dim, round(v[1], 6) AS first FROM e")
def _(i):
    path = scratch_path(i.spark, "features")
    io.write_features(i.feats, path)
    return i.spark.read.parquet(path).select("id", F.size("embedding").cast("long").alias("dim"), r6(F.col("embedding")[0]).alias("first"))


@query("s1_binary_features", "SELECT i AS id, j AS p, round(sin(1 + i * 8 + j)::FLOAT::DOUBLE, 5) AS x FROM (SELECT unnest(range(1500)) AS i), (SELECT unnest(range(8)) AS j)", "")
def _(i):
    """A headerless matrix in the shared folder, by a formula."""
    path = scratch_path(i.spark, "features") + ".bin"
    p = i.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(i.spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(np.sin(1 + np.arange(1500 * 8)).astype("<f4").tobytes()))
    out.close()
    return io.read_features_bin(i.spark, path, 8, rows_a_read=200).select("id", F.posexplode("embedding").alias("p", "x")).select("id", F.col("p").cast("long").alias("p"), F.round("x", 5).alias("x"))


@query("s2_inverse_labels", "SELECT label, count(*) AS n, min(id) AS first, sum(id)::BIGINT AS total FROM e GROUP BY label")
def _(i):
    inv = io.inverse_labels(i.labels)
    return inv.select("label", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_FILL = """, k AS (SELECT id, label FROM e WHERE id % 3 <> 0), h AS (SELECT label, min(id) AS head FROM k GROUP BY label), d AS (SELECT label, dense_rank() OVER (ORDER BY head) - 1 AS n FROM h)
SELECT id, n AS label FROM k JOIN d USING (label) UNION ALL
SELECT id, (SELECT max(n) + 1 FROM d) + row_number() OVER (ORDER BY id) - 1 FROM e WHERE id % 3 = 0"""


@query("s3_write_labels", _FILL)
def _(i):
    path = scratch_path(i.spark, "labels")
    n = i.labels.count()
    io.write_labels(i.labels.where("id % 3 <> 0"), path, n)
    lines = i.spark.read.text(path).select(F.col("value").cast("long").alias("label"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    order = lines.select("label", F.row_number().over(_window("f", "m")).alias("r"))
    return order.select((F.col("r") - 1).cast("long").alias("id"), "label")


def _window(*cols):
    from pyspark.sql.window import Window

    return Window.orderBy(*cols)


@query("p10_fill_labels", _FILL)
def _(i):
    return proposals.fill_labels(i.labels.where("id % 3 <> 0"), i.labels.count())


@query("s5_dump_load", "SELECT id, label FROM e")
def _(i):
    path = scratch_path(i.spark, "dump") + ".json"
    io.dump(i.labels, path)
    io.dump(i.labels.limit(0), path)  # existing output stays
    return io.load(i.spark, path, "id long, label long")


@query("s6_dataset", "SELECT count(*) AS n, max(len(v))::BIGINT AS dim, count(DISTINCT label) AS n_labels FROM e")
def _(i):
    return io.Dataset.from_table(i.raw).info()


@query("s7_saved_proposals", """, inner_edges AS (SELECT DISTINCT a.proposal_id, least(id, nbr) AS u, greatest(id, nbr) AS v FROM knn JOIN g a ON a.node = id JOIN g b ON b.node = nbr AND a.proposal_id = b.proposal_id)
SELECT proposal_id, size AS n_nodes, (SELECT count(*) FROM inner_edges x WHERE x.proposal_id = sz.proposal_id) AS n_edges FROM sz""", GROUPS)
def _(i):
    path = scratch_path(i.spark, "proposals")
    name = io.set_name({"k": K, "th": 0.35})
    io.save_proposals(i.groups().select(F.lit(name).alias("proposal_set"), "proposal_id", "node"), i.knn, path)
    nodes, edges = io.read_proposals(i.spark, path, name)
    n, m = nodes.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n_nodes")), edges.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(m, "proposal_id", "left").select("proposal_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


_KNN = "SELECT id, nbr, rank, round(dist, 6) AS dist FROM knn"


@query("s9_cached_knn", _KNN)
def _(i):
    io.cached_knn(i.feats, K, "query", rebuild=True)
    return io.cached_knn(i.feats, K, "query").select("id", "nbr", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


# ---- vectors


@query("v1_l2_normalize", "SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, 1.0::DOUBLE AS norm FROM e")
def _(i):
    twice = i.feats.withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    return vectors.l2_normalize(twice).select("id", r6(F.col("embedding")[0]).alias("first"), r6(vectors.norm(F.col("embedding"))).alias("norm"))


@query("v2_is_normalized", "SELECT max(abs(list_dot_product(v, v) - 1)) < 1e-4 AS is_normalized, count(*) AS n FROM e")
def _(i):
    return vectors.is_normalized(i.feats)


@query("v3_propagate", ", x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS p FROM e), m AS (SELECT src AS id, p, sum(w * x) AS x FROM edges JOIN x ON x.id = dst GROUP BY ALL) SELECT id, round(sum(x), 6) AS total, round(sum(x * x), 6) AS square FROM m GROUP BY id")
def _(i):
    out = vectors.propagate(i.feats, knn.to_edges(i.knn))
    e = F.col("embedding")
    return out.select("id", r6(F.aggregate(e, F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(vectors.dot(e, e)).alias("square"))


@query("v4_group_mean", ", x AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS p FROM e) SELECT label, p::INT AS p, round(avg(x), 6) AS x FROM x GROUP BY label, p")
def _(i):
    return vectors.group_mean(i.feats, i.labels, "label").select("label", F.posexplode("embedding").alias("p", "x")).select("label", "p", r6("x").alias("x"))


@query("v5_relative", "SELECT k.id, k.nbr, round(list_distance(a.v, b.v), 6) AS d FROM knn k JOIN e a ON a.id = k.id JOIN e b ON b.id = k.nbr WHERE rank = 1")
def _(i):
    rel = vectors.relative(i.feats, i.knn.where("rank = 1").select("id", "nbr"), "id", "nbr")
    return rel.select("id", "nbr", r6(vectors.norm(F.col("embedding"))).alias("d"))


@query("v6_rerank", "SELECT id, nbr, rank, round(dist, 6) AS dist FROM knn WHERE rank <= 3")
def _(i):
    return knn.rerank(i.feats, i.knn.select("id", "nbr"), 3).select("id", "nbr", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query("v7_argmax", "SELECT id, nbr FROM knn WHERE rank = 1")
def _(i):
    return vectors.argmax_ties(i.knn.withColumn("sim", 1 - F.col("dist")), "id", "nbr", "sim")


# ---- neighbours


def _knn_out(df):
    return df.select("id", "nbr", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query("k1_knn_exact", _KNN)
def _(i):
    return _knn_out(knn.knn_exact(i.feats, K))


@query("k1_knn_with_self", "SELECT id, nbr, rank, round(1 - sim, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM (SELECT a.id, b.id AS nbr, CASE WHEN a.id = b.id THEN round(list_dot_product(a.v, b.v), 4) ELSE list_dot_product(a.v, b.v) END AS sim FROM e a, e b)) WHERE rank <= 4")
def _(i):
    return knn.knn_exact(i.feats, 4, include_self=True).select("id", "nbr", F.col("rank").cast("long").alias("rank"), (F.when(F.col("id") == F.col("nbr"), F.round("dist", 4)).otherwise(r6("dist")) + 0.0).alias("dist"))


@query("k2_knn_lsh")
def _(i):
    return _knn_out(knn.knn_lsh(i.feats, K))


@query("k3_knn_ivf_all_cells", _KNN)
def _(i):
    return _knn_out(knn.knn_ivf(i.feats, K, n_cells=8, n_probe=8))


@query("k4_knn_ivf")
def _(i):
    return _knn_out(knn.knn_ivf(i.feats, K, n_cells=16))


@query("k5_approximate_reranked")
def _(i):
    return _knn_out(knn.rerank(i.feats, knn.knn_ivf(i.feats, 2 * K, n_cells=16, n_probe=10), K))


@query("k6_filter_by_similarity", "SELECT id, nbr, rank, round(dist, 6) AS dist FROM knn WHERE sim >= 0.35")
def _(i):
    return _knn_out(knn.filter_by_similarity(i.knn, 0.35))


@query("k7_undirected_pairs", "SELECT u, v, round(score, 6) AS score FROM p30", BASE + pairs_sql("p30", 0.30))
def _(i):
    return i.pairs(0.30).select("u", "v", r6("score").alias("score"))


@query("k8_reorder", _KNN)
def _(i):
    return _knn_out(knn.reorder(i.knn.drop("rank")))


@query("k9_to_edges", "SELECT src, dst, round(w, 6) AS w FROM edges WHERE w >= 0.32")
def _(i):
    return knn.to_edges(i.knn, 0.32).select("src", "dst", r6("w").alias("w"))


@query("k10_to_edges_modes", "SELECT id AS src, nbr AS dst, round(dist, 6) AS w, 1.0::DOUBLE AS filled FROM knn WHERE dist >= 0.65")
def _(i):
    a = knn.to_edges(i.knn, 0.65, use_sim=False, filter_on="dist")
    b = knn.to_edges(i.knn, 0.65, fill=1.0, filter_on="dist").withColumnRenamed("w", "filled")
    return a.join(b, ["src", "dst"]).select("src", "dst", r6("w").alias("w"), "filled")


@query("k11_induced", ", n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM e WHERE id % 2 = 0) SELECT a.n AS src, b.n AS dst, round(sim, 6) AS w FROM knn k JOIN n a ON a.id = k.id JOIN n b ON b.id = k.nbr")
def _(i):
    return knn.induced(i.knn, i.feats.where("id % 2 = 0").select("id")).select("src", "dst", r6("w").alias("w"))


@query("k12_knn_recall", ", c AS (SELECT label, count(*) AS n FROM e GROUP BY label), h AS (SELECT k.id, count(*) AS hit FROM knn k JOIN e a ON a.id = k.id JOIN e b ON b.id = k.nbr WHERE a.label = b.label GROUP BY k.id) SELECT round(avg((coalesce(hit, 0) + 1) / n), 6) AS recall FROM e JOIN c USING (label) LEFT JOIN h USING (id)")
def _(i):
    return knn.knn_recall(i.knn, i.labels).select(r6("recall").alias("recall"))


@query("k13_knn_euclidean", "SELECT id, nbr, rank, round(sqrt(2 * dist), 6) AS d FROM knn")
def _(i):
    return knn.knn_exact(i.feats, K).select("id", "nbr", F.col("rank").cast("long").alias("rank"), r6(F.sqrt(2 * F.col("dist"))).alias("d"))


@query("k14_edge_difference", "SELECT src, dst, round(w, 6) AS w, 1 AS side, false AS same FROM edges WHERE w >= 0.3 AND w < 0.33 UNION ALL SELECT src + 1000000, dst, round(w, 6), 2, false FROM edges WHERE w >= 0.5")
def _(i):
    a = knn.to_edges(i.knn, 0.3)
    b = knn.to_edges(i.knn, 0.33).unionByName(knn.to_edges(i.knn, 0.5).withColumn("src", F.col("src") + 1_000_000)).unionByName(a.withColumn("w", F.lit(0.0)))  # zeros do not count
    return knn.edge_difference(a, b).select("src", "dst", r6("w").alias("w"), "side").crossJoin(knn.same_edges(a, b))  # one row


@query("k14_same_edges", "SELECT count(*) FILTER (WHERE w >= 0.3) AS n, true AS same FROM edges")
def _(i):
    e = knn.to_edges(i.knn, 0.3)
    return e.agg(F.count(F.lit(1)).alias("n")).crossJoin(knn.same_edges(e, e.orderBy(F.desc("dst"))))  # one row


@query("k4_knn_ivf_pq")
def _(i):
    return _knn_out(knn.knn_ivf_pq(i.feats, K, n_cells=16))


# ---- graph


@query("g1_row_normalize", "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM edges")
def _(i):
    return graph.row_normalize(knn.to_edges(i.knn, -1.0)).select("src", "dst", r6("w").alias("w"))


_SYM = ", sym AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY ALL), loops AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM sym UNION ALL SELECT id, id, 1.0 FROM e) GROUP BY ALL)"


@query("g2_symmetrize", _SYM + " SELECT src, dst, round(w, 6) AS w FROM loops")
def _(i):
    return graph.symmetrize(knn.to_edges(i.knn, -1.0), i.feats).select("src", "dst", r6("w").alias("w"))


@query("g4_components", "SELECT id, component FROM cc", PRED)
def _(i):
    return connected_components(i.pairs(0.35), i.feats.select("id"), src="u", dst="v")


@query("g4_components_by_joins", "SELECT id, component FROM cc", PRED)
def _(i):
    own = i.feats.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return linked(i.pairs(0.35).select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(own))


@query("g5_constrained_components", "SELECT id, component, count(*) OVER (PARTITION BY component) <= 20 AS fits FROM cc", GROUPS)
def _(i):
    return graph.constrained_components(i.pairs(0.30), 20, 0.35).join(i.groups().select(F.col("node").alias("id")), "id", "left_semi")


def dynamic_sql(name, pairs, levels=7, max_size=50, step=0.05):
    """Levels written out; every level's threshold moves from the smallest score of the table ``pairs(u, v, score)``. CTEs, and the select of the labels."""
    sql = f""",
{name}d0 AS MATERIALIZED (SELECT u, v, score FROM {pairs}), {name}t0 AS (SELECT min(score) AS th FROM {name}d0), {name}n0 AS (SELECT u AS id FROM {name}d0 UNION SELECT v FROM {name}d0)"""
    for j in range(levels):
        keep = "true" if j == 0 else f"score >= (SELECT th FROM {name}t{j})"
        sql += components_sql(f"{name}c{j}", f"SELECT u, v FROM {name}d{j} WHERE {keep}", f"SELECT id FROM {name}n{j}")
        sql += f""",
{name}s{j} AS MATERIALIZED (SELECT id, component, count(*) OVER (PARTITION BY component) AS n FROM {name}c{j}),
{name}n{j + 1} AS MATERIALIZED (SELECT id, component FROM {name}s{j} WHERE n > {max_size}),
{name}d{j + 1} AS MATERIALIZED (SELECT u, v, score FROM {name}d{j} JOIN {name}n{j + 1} a ON a.id = u JOIN {name}n{j + 1} b ON b.id = v WHERE a.component = b.component),
{name}t{j + 1} AS (SELECT th + (1 - th) * {step} AS th FROM {name}t{j})"""
    return sql, " UNION ALL ".join(f"SELECT id, component AS label FROM {name}s{j} WHERE n <= {max_size}" for j in range(levels))


def _dynamic():
    sql, labels = dynamic_sql("", "p30")
    return BASE + pairs_sql("p30", 0.30) + sql, labels


_DYN, _DYN_LABELS = _dynamic()


@query("g6_dynamic_threshold", _DYN_LABELS, _DYN)
def _(i):
    return graph.dynamic_threshold_clusters(i.pairs(0.30), 50, 0.05)


@query("p1_super_vertices", _DYN_LABELS, _DYN)
def _(i):
    return proposals.super_vertices(i.knn, K, 0.30, 0.05, 50)


@query("p2_basic_proposals", f", l AS ({_DYN_LABELS}) SELECT label AS proposal_id, id AS node FROM l WHERE (SELECT count(*) FROM l x WHERE x.label = l.label) >= 3", _DYN)
def _(i):
    return proposals.basic_proposals(i.feats, k=K, th=0.30, step=0.05, max_size=50, min_size=3, knn=i.knn)


_DENSE = ", h AS (SELECT component, dense_rank() OVER (ORDER BY component) - 1 AS n FROM (SELECT DISTINCT component FROM cc)) SELECT id, n AS label FROM cc JOIN h USING (component)"


@query("g8_component_labels", _DENSE, PRED)
def _(i):
    return graph.component_labels(i.pairs(0.35).select(F.col("u").alias("src"), F.col("v").alias("dst")), i.feats.select("id"))


_DENSITY = ", dens AS (SELECT e.id, coalesce(sum(CASE WHEN dist < 0.65 THEN 1 - dist END), 0) AS conf FROM e LEFT JOIN knn USING (id) GROUP BY e.id)"
_PEAKS = _DENSITY + ", pk AS (SELECT id AS src, nbr AS dst, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS conn_no FROM (SELECT k.* FROM knn k JOIN dens a ON a.id = k.id JOIN dens b ON b.id = k.nbr WHERE b.conf > a.conf))"


def _dens(i):
    return cut(confidence.density(i.knn, i.feats, 0.65), "query-density")


@query("c1_density", _DENSITY + " SELECT id, round(conf, 6) AS conf FROM dens")
def _(i):
    return confidence.density(i.knn, i.feats, 0.65).select("id", r6("conf").alias("conf"))


@query("c1_density_count", "SELECT e.id, coalesce(sum(CASE WHEN dist < 0.65 THEN 1.0::DOUBLE END), 0) AS conf FROM e LEFT JOIN knn USING (id) GROUP BY e.id")
def _(i):
    return confidence.density(i.knn, i.feats, 0.65, use_weight=False)


_AGREE = ", ag AS (SELECT k.id, sum(CASE WHEN a.label = b.label THEN sim ELSE -sim END) AS raw, count(*) AS cnt FROM knn k JOIN e a ON a.id = k.id JOIN e b ON b.id = k.nbr GROUP BY k.id)"


@query("c2_s_nbr", _AGREE + " SELECT id, round(raw / max(abs(raw)) OVER (), 6) AS conf FROM ag")
def _(i):
    return confidence.s_nbr(i.knn, i.labels).select("id", r6("conf").alias("conf"))


@query("c3_s_nbr_size", _AGREE + " SELECT id, round(raw / max(cnt) OVER (), 6) AS conf FROM ag")
def _(i):
    return confidence.s_nbr_size(i.knn, i.labels).select("id", r6("conf").alias("conf"))


@query("c4_s_avg", "SELECT a.id, round(coalesce(avg(list_dot_product(a.v, b.v)), 0), 6) AS conf FROM e a LEFT JOIN e b ON a.label = b.label AND a.id <> b.id GROUP BY a.id")
def _(i):
    return confidence.s_avg(i.feats, i.labels).select("id", r6("conf").alias("conf"))


@query("c4_s_avg_later", "SELECT a.id, round(coalesce(avg(list_dot_product(a.v, b.v)), 0), 6) AS conf FROM e a LEFT JOIN e b ON a.label = b.label AND b.id > a.id GROUP BY a.id")
def _(i):
    return confidence.s_avg(i.feats, i.labels, later_only=True).select("id", r6("conf").alias("conf"))


@query("c5_s_center", "SELECT a.id, round(avg(list_dot_product(a.v, b.v)), 6) AS conf FROM e a JOIN e b ON a.label = b.label GROUP BY a.id")
def _(i):
    return confidence.s_center(i.feats, i.labels).select("id", r6("conf").alias("conf"))


@query("c6_by_name", _AGREE + " SELECT id, round(raw / max(abs(raw)) OVER (), 6) AS conf FROM ag")
def _(i):
    return confidence.confidence("s_nbr", knn=i.knn, labels=i.labels).select("id", r6("conf").alias("conf"))


@query("c7_peaks", _PEAKS + " SELECT src, dst, round(dist, 6) AS dist, conn_no::INT AS conn_no FROM pk WHERE conn_no <= 2")
def _(i):
    return confidence.peaks(i.knn, _dens(i), 2).select("src", "dst", r6("dist").alias("dist"), "conn_no")


@query("c8_peak_accuracy", _PEAKS + ", p1 AS (SELECT * FROM pk WHERE conn_no = 1), n1 AS (SELECT * FROM knn WHERE rank = 1), x AS (SELECT e.id, e.label, coalesce(p1.dst, e.id) AS p, coalesce(n1.nbr, e.id) AS t FROM e LEFT JOIN p1 ON p1.src = e.id LEFT JOIN n1 ON n1.id = e.id) SELECT round(avg((p = t)::INT::DOUBLE), 6) AS peak_match, round(avg((o.label = x.label)::INT::DOUBLE), 6) AS label_match FROM x JOIN e o ON o.id = x.p")
def _(i):
    true = i.knn.where("rank = 1").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "dist", F.lit(1).alias("conn_no"))
    return confidence.peak_accuracy(confidence.peaks(i.knn, _dens(i)), true, i.labels).select(r6("peak_match").alias("peak_match"), r6("label_match").alias("label_match"))


@query("c9_ignore_set", _AGREE + ", c AS (SELECT id, round(raw, 9) AS raw FROM ag) SELECT id FROM c ORDER BY raw, id LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM e)")
def _(i):
    c = confidence.s_nbr(i.knn, i.labels).select("id", F.round("conf", 9).alias("conf"))
    return confidence.ignore_set(c, 0.1)


@query("g9_peaks_to_edges", _PEAKS + " SELECT src, dst FROM pk WHERE conn_no <= 2 AND dist < 0.68")
def _(i):
    return graph.peaks_to_edges(confidence.peaks(i.knn, _dens(i), 2), 0.32)


@query("g10_peaks_to_labels", _PEAKS + components_sql("cc", "SELECT src AS u, dst AS v FROM pk WHERE conn_no = 1 AND dist < 0.7", "SELECT id FROM e") + _DENSE)
def _(i):
    return graph.peaks_to_labels(confidence.peaks(i.knn, _dens(i)), 0.3, i.feats)


# ---- proposals


def iterated_sql(name, k, th, max_size):
    """Base groups ``{name}b(label, id)`` of small size, their mean vectors' neighbours, and the groups of groups ``{name}i(proposal_id, node)``."""
    base, labels = dynamic_sql(f"{name}x", f"{name}p", 12, max_size)
    more, groups = dynamic_sql(f"{name}y", f"{name}q", 14, 8)
    return f""",
{name}p AS MATERIALIZED (SELECT least(id, nbr) AS u, greatest(id, nbr) AS v, arg_min(sim, id * 100 + rank) AS score FROM knn WHERE rank <= {k} AND sim >= {th} GROUP BY ALL){base},
{name}b AS MATERIALIZED ({labels}),
{name}m AS MATERIALIZED (SELECT label AS id, list(x ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS x FROM (SELECT b.label, unnest(e.v) AS x, unnest(range(64)) AS p FROM {name}b b JOIN e USING (id)) GROUP BY ALL) GROUP BY ALL),
{name}k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM (SELECT a.id, b.id AS nbr, list_dot_product(a.v, b.v) AS sim FROM {name}m a, {name}m b WHERE a.id <> b.id)),
{name}q AS MATERIALIZED (SELECT least(id, nbr) AS u, greatest(id, nbr) AS v, arg_min(sim, id * 100 + rank) AS score FROM {name}k WHERE rank <= 5 AND sim >= 0.2 GROUP BY ALL){more},
{name}g AS MATERIALIZED ({groups}),
{name}w AS (SELECT g.label AS proposal_id, b.id AS node FROM {name}g g JOIN {name}b b ON b.label = g.id WHERE (SELECT count(*) FROM {name}g z WHERE z.label = g.label) >= 2),
{name}i AS MATERIALIZED (SELECT proposal_id, node FROM {name}w w WHERE (SELECT count(*) FROM {name}w z WHERE z.proposal_id = w.proposal_id) BETWEEN 3 AND 500)"""


@query("p3_iterated_proposals", "SELECT * FROM ai", BASE + iterated_sql("a", 10, 0.30, 20))
def _(i):
    base = proposals.basic_proposals(i.feats, k=K, th=0.30, step=0.05, max_size=20, knn=i.knn)
    return proposals.iterate_proposals(i.feats, base, k=5, th=0.2, step=0.05)


@query("p4_generated_proposals", f", l AS ({_DYN_LABELS}) SELECT 'k10_th0.3_step0.05_max50_iter0' AS proposal_set, label AS proposal_id, id AS node FROM l WHERE (SELECT count(*) FROM l x WHERE x.label = l.label) >= 3 UNION ALL SELECT 'k5_th0.32_step0.05_max20_iter1', proposal_id, node FROM ai", _DYN + iterated_sql("a", 5, 0.32, 20))
def _(i):
    more = [{"k": 5, "th": 0.2, "step": 0.05}]
    return proposals.generate_proposals(i.feats, [{"k": K, "th": 0.3, "step": 0.05, "max_size": 50, "min_size": 3}, {"k": 5, "th": 0.32, "step": 0.05, "max_size": 20, "iterations": more, "iter0": False}])


@query("p5_induced_edges", "SELECT a.proposal_id, least(id, nbr) AS u, greatest(id, nbr) AS v, round(min(dist), 6) AS dist FROM knn JOIN g a ON a.node = id JOIN g b ON b.node = nbr AND a.proposal_id = b.proposal_id GROUP BY ALL", GROUPS)
def _(i):
    return proposals.induced_edges(i.groups(), i.knn).select("proposal_id", "u", "v", r6("dist").alias("dist"))


@query("p6_set_names", ", s AS (SELECT k, th / 100.0 AS th FROM (SELECT unnest(range(5, 35, 5)) AS k), (SELECT unnest(range(30, 60, 5)) AS th)) SELECT k, th::DOUBLE AS th, (SELECT count(*) FROM knn WHERE rank <= k AND sim >= th) AS n FROM s")
def _(i):
    """Proposal sets of many settings go by name; the names are read back and used."""
    names = [(io.set_name({"k": k, "th": th / 100}),) for k in range(5, 35, 5) for th in range(30, 60, 5)]
    rows = [(n, *(io.parse_set_name(n)[x] for x in ("k", "th"))) for (n,) in names]
    s = i.spark.createDataFrame(rows, "name string, k long, th double")  # 36 settings
    links = i.knn.join(F.broadcast(s), (F.col("rank") <= F.col("k")) & (1 - F.col("dist") >= F.col("th")))
    return s.join(links.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left").select("k", "th", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("p7_size_filter", "SELECT proposal_id, node FROM g JOIN sz USING (proposal_id) WHERE size BETWEEN 3 AND 20", GROUPS)
def _(i):
    return proposals.size_filter(i.groups(), 3, 20)


@query("p8_of_size", "SELECT node FROM g JOIN sz USING (proposal_id) WHERE size = 2", GROUPS)
def _(i):
    return proposals.of_size(i.groups(), 2)


@query("p9_clusters_to_labels", "SELECT id, label FROM e")
def _(i):
    return proposals.to_labels(proposals.to_clusters(i.labels))


#: Proposals of two thresholds, so that they overlap: those of 0.35 have even names, those of 0.32 odd ones.
_TWO = GROUPS + pairs_sql("p32", 0.32) + components_sql("c32", "SELECT u, v FROM p32", "SELECT u AS id FROM p32 UNION SELECT v FROM p32") + """,
o AS MATERIALIZED (SELECT 2 * proposal_id AS proposal_id, node FROM g UNION ALL SELECT 2 * component + 1, id FROM c32),
os AS MATERIALIZED (SELECT proposal_id, count(*) AS n FROM o GROUP BY ALL),
ov AS MATERIALIZED (SELECT pa, pb, inter, inter / a.n AS iop, inter / b.n AS iog, inter / (a.n + b.n - inter) AS iou FROM (SELECT a.proposal_id AS pa, b.proposal_id AS pb, count(*) AS inter FROM o a JOIN o b USING (node) GROUP BY ALL) x JOIN os a ON a.proposal_id = pa JOIN os b ON b.proposal_id = pb),
mj AS (SELECT proposal_id, label, n FROM (SELECT proposal_id, label, count(*) AS n, row_number() OVER (PARTITION BY proposal_id ORDER BY count(*) DESC, label) AS r FROM o JOIN e ON e.id = node GROUP BY proposal_id, label) WHERE r = 1),
cl AS (SELECT label, count(*) AS m FROM e GROUP BY label),
an AS MATERIALIZED (SELECT mj.proposal_id, mj.label, os.n AS size, mj.n / (os.n + m - mj.n) AS iou, mj.n / os.n AS iop, mj.n / m AS iog FROM mj JOIN os USING (proposal_id) JOIN cl USING (label))"""


def _two(i):
    a = i.groups(0.35).select((F.col("proposal_id") * 2).alias("proposal_id"), "node")
    return cut(a.unionByName(i.groups(0.32).select((F.col("proposal_id") * 2 + 1).alias("proposal_id"), "node")), "query-two")


@query("p11_overlaps", "SELECT pa, pb, inter, round(iop, 6) AS iop, round(iog, 6) AS iog, round(iou, 6) AS iou FROM ov", _TWO)
def _(i):
    t = _two(i)
    return proposals.overlaps(t, t).select("pa", "pb", "inter", r6("iop").alias("iop"), r6("iog").alias("iog"), r6("iou").alias("iou"))


@query("p12_majority", "SELECT proposal_id, label FROM mj", _TWO)
def _(i):
    return proposals.majority(_two(i), i.labels)


_AN = "proposal_id, label, size, round(iou, 6) AS iou, round(iop, 6) AS iop, round(iog, 6) AS iog, CASE WHEN iou > 0.05 THEN 'positive' WHEN iou < 0.02 THEN 'negative' END AS kind"


@query("p13_analyze", f"SELECT {_AN} FROM an", _TWO)
def _(i):
    return proposals.analyze(_two(i), i.labels, 0.05, 0.02).select("proposal_id", "label", "size", r6("iou").alias("iou"), r6("iop").alias("iop"), r6("iog").alias("iog"), "kind")


@query("p14_report", "SELECT count(*) AS n_proposals, round(avg(size), 6) AS avg_size, max(size) AS max_size, round(avg(iou * iou), 6) AS mse_0, round(avg((1 - iou) * (1 - iou)), 6) AS mse_1, (SELECT count(DISTINCT node) FROM o) AS covered, (SELECT count(*) FROM e) AS n_ids, round((SELECT count(DISTINCT node) FROM o) / (SELECT count(*) FROM e), 6) AS coverage FROM an", _TWO)
def _(i):
    return proposals.report(_two(i), i.labels).select("n_proposals", r6("avg_size").alias("avg_size"), "max_size", r6("mse_0").alias("mse_0"), r6("mse_1").alias("mse_1"), "covered", "n_ids", r6("coverage").alias("coverage"))


_RANK = ", rk AS MATERIALIZED (SELECT proposal_id, row_number() OVER (ORDER BY iop DESC, proposal_id) - 1 AS rank FROM an)"


@query("p15_nms_no_threshold", _RANK + " SELECT node AS id, min(rank) AS label FROM o JOIN rk USING (proposal_id) GROUP BY node", _TWO)
def _(i):
    t = _two(i)
    order = proposals.analyze(t, i.labels).select("proposal_id", (F.row_number().over(_window(F.desc("iop"), "proposal_id")) - 1).cast("long").alias("rank"))
    return proposals.nms(t, order, 1.0)


#: Each proposal of one threshold lies in one of the other, so chains of overlaps have two links and the greedy rule can be written out.
@query("p15_nms", _RANK + """, pr AS (SELECT pa, pb, a.rank AS ra, b.rank AS rb FROM ov JOIN rk a ON a.proposal_id = pa JOIN rk b ON b.proposal_id = pb WHERE a.rank < b.rank AND iou > 0.6),
k1 AS (SELECT proposal_id FROM rk WHERE proposal_id NOT IN (SELECT pb FROM pr)), x1 AS (SELECT pb FROM pr WHERE pa IN (SELECT proposal_id FROM k1)),
k2 AS (SELECT proposal_id FROM rk WHERE proposal_id NOT IN (SELECT proposal_id FROM k1) AND proposal_id NOT IN (SELECT pb FROM x1) AND proposal_id NOT IN (SELECT pb FROM pr WHERE pa NOT IN (SELECT pb FROM x1))),
kept AS (SELECT * FROM k1 UNION SELECT * FROM k2) SELECT node AS id, min(rank) AS label FROM o JOIN rk USING (proposal_id) WHERE proposal_id IN (SELECT proposal_id FROM kept) GROUP BY node""", _TWO)
def _(i):
    t = _two(i)
    order = proposals.analyze(t, i.labels).select("proposal_id", (F.row_number().over(_window(F.desc("iop"), "proposal_id")) - 1).cast("long").alias("rank"))
    return proposals.nms(t, order, 0.6)


_ASSIGN = "a AS (SELECT node AS id, min(rank) AS r FROM {o} JOIN {rk} USING (proposal_id) GROUP BY node), hd AS (SELECT r, min(id) AS head FROM a GROUP BY r), dn AS (SELECT r, dense_rank() OVER (ORDER BY head) - 1 AS label FROM hd) SELECT id, label FROM a JOIN dn USING (r)"


@query("p16_deoverlap", ", rk AS (SELECT proposal_id, row_number() OVER (ORDER BY iop DESC, proposal_id) - 1 AS rank FROM an WHERE iop >= 0.3), " + _ASSIGN.format(o="o", rk="rk"), _TWO)
def _(i):
    t = _two(i)
    return proposals.deoverlap(t, proposals.analyze(t, i.labels).select("proposal_id", F.col("iop").alias("score")), th_pos=0.3)


_PROB = "CASE WHEN node % 4 = 0 THEN 0.2 ELSE 0.8 END"


@query("p17_split_outliers", f"SELECT proposal_id, node, {_PROB} <= 0.5 AS outlier FROM g", GROUPS)
def _(i):
    g = i.groups()
    return proposals.split_outliers(g, g.withColumn("prob", F.expr(_PROB)), 0.5)


@query("p16_deoverlap_outliers", f""", rk0 AS (SELECT proposal_id, row_number() OVER (ORDER BY iop DESC, proposal_id) - 1 AS rank FROM an), sp AS (SELECT 2 * proposal_id + ({_PROB} <= 0.5)::INT AS proposal_id, proposal_id AS own, node, {_PROB} <= 0.5 AS outlier FROM o),
rk AS (SELECT DISTINCT sp.proposal_id, rank + CASE WHEN outlier THEN (SELECT max(rank) + 1 FROM rk0) ELSE 0 END AS rank FROM sp JOIN rk0 ON rk0.proposal_id = own), """ + _ASSIGN.format(o="sp", rk="rk"), _TWO)
def _(i):
    t = _two(i)
    s = proposals.analyze(t, i.labels).select("proposal_id", F.col("iop").alias("score"))
    return proposals.deoverlap(t, s, probs=t.withColumn("prob", F.expr(_PROB)), th_outlier=0.5)


@query("p18_iop_range", "SELECT proposal_id, node FROM o JOIN an USING (proposal_id) WHERE iop BETWEEN 0.3 AND 0.6", _TWO)
def _(i):
    t = _two(i)
    return proposals.iop_range(t, proposals.analyze(t, i.labels).select("proposal_id", "iop"), 0.3, 0.6)


@query("p19_upper_bound", ", rk AS (SELECT proposal_id, row_number() OVER (ORDER BY iou DESC, proposal_id) - 1 AS rank FROM an WHERE iou > 0.02), " + _ASSIGN.format(o="o", rk="rk"), _TWO)
def _(i):
    return proposals.upper_bound(_two(i), i.labels, 0.02)


@query("p20_partial_overlaps", "SELECT count(*) FILTER (WHERE iop < 1 AND iog < 1) AS n_partial FROM ov WHERE pa < pb", _TWO)
def _(i):
    return proposals.partial_overlaps(_two(i))


# ---- baselines


def _all(i, df):
    return df.select("id", F.col("label").cast("long").alias("label"))


for _name, _run in {
    "b1_kmeans": lambda i: baselines.kmeans(i.feats, 10),
    "b2_mini_batch_kmeans": lambda i: baselines.mini_batch_kmeans(i.feats, 10),
    "b3_spectral": lambda i: baselines.spectral(i.knn, 8, nodes=i.feats),
    "b4_spectral_rbf": lambda i: baselines.spectral(i.knn, 8, gamma=1.0, nodes=i.feats),
    "b5_hierarchy": lambda i: baselines.hierarchy(i.feats, 10),
    "b9_hdbscan": lambda i: baselines.hdbscan(i.feats, 3, 5, 10, 6),
    "b10_meanshift": lambda i: baselines.mean_shift(i.feats, 1.1),
}.items():
    query(_name)(lambda i, f=_run: _all(i, f(i)))


_SYM30 = ", s30 AS MATERIALIZED (SELECT src, dst, max(w) AS w FROM (SELECT * FROM edges WHERE w >= 0.3 UNION ALL SELECT dst, src, w FROM edges WHERE w >= 0.3) GROUP BY ALL), w0 AS (SELECT id, id AS label FROM e)"
for _k in range(6):
    _SYM30 += f""", v{_k} AS (SELECT src AS id, label, sum(w) AS w FROM s30 JOIN w{_k} ON w{_k}.id = dst GROUP BY ALL),
x{_k} AS (SELECT id, label AS best FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM v{_k}) WHERE r = 1),
w{_k + 1} AS MATERIALIZED (SELECT id, CASE WHEN (id * 40503 + {_k} * 26543) % 4294967296 // 32768 % 2 = 0 THEN coalesce(best, label) ELSE label END AS label FROM w{_k} LEFT JOIN x{_k} USING (id))"""


@query("b14_chinese_whispers", _SYM30 + " SELECT id, label FROM w6")
def _(i):
    return baselines.chinese_whispers(graph.symmetrize(knn.to_edges(i.knn, 0.3)), i.feats, 6)


_PAIRS = "SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {}"


@query("b6_single_linkage", "SELECT id, component AS label FROM cc", BASE + components_sql("cc", _PAIRS.format(1 - 1.12**2 / 2), "SELECT id FROM e"))
def _(i):
    return baselines.single_linkage(i.feats, 1.12)


def _dbscan_sql(links, least):
    return BASE + f""",
nb AS MATERIALIZED (SELECT u AS a, v AS b FROM ({links}) UNION SELECT v, u FROM ({links})), core AS MATERIALIZED (SELECT id FROM (SELECT e.id, count(b) + 1 AS n FROM e LEFT JOIN nb ON a = e.id GROUP BY e.id) WHERE n >= {least})""" + components_sql("cc", "SELECT a AS u, b AS v FROM nb JOIN core x ON x.id = a JOIN core y ON y.id = b", "SELECT id FROM core")


_DB = "SELECT e.id, coalesce(cc.component, (SELECT min(c2.component) FROM nb JOIN cc c2 ON c2.id = nb.b WHERE nb.a = e.id), e.id) AS label FROM e LEFT JOIN cc ON cc.id = e.id"


@query("b7_dbscan", _DB, _dbscan_sql(_PAIRS.format(1 - 1.15**2 / 2), 4))
def _(i):
    return baselines.dbscan(i.feats, 1.15, 4)


@query("b8_knn_dbscan", _DB, _dbscan_sql("SELECT id AS u, nbr AS v FROM knn WHERE dist <= 0.66", 3))
def _(i):
    return baselines.knn_dbscan(i.knn, i.feats, 0.66, 3)


_ARO = """, lk AS (SELECT k.id, k.nbr, k.rank - 1 AS oi, b.rank AS oj FROM knn k JOIN knn b ON b.id = k.nbr AND b.nbr = k.id),
rod AS MATERIALIZED (SELECT lk.id, lk.nbr, ((SELECT count(*) FROM knn x WHERE x.id = lk.id AND x.rank <= oi AND x.nbr <> lk.nbr AND x.nbr NOT IN (SELECT y.nbr FROM knn y WHERE y.id = lk.nbr))
 + (SELECT count(*) FROM knn x WHERE x.id = lk.nbr AND x.rank <= oj AND x.nbr <> lk.id AND x.nbr NOT IN (SELECT y.nbr FROM knn y WHERE y.id = lk.id))) / greatest(least(oi, oj), 1) AS d FROM lk)"""


@query("b11_rank_order_distance", _ARO + " SELECT id, nbr, round(d, 6) AS d FROM rod")
def _(i):
    return baselines.rank_order_distance(i.knn).select("id", "nbr", r6("d").alias("d"))


@query("b12_rank_order_clusters", "SELECT id, component AS label FROM cc", BASE + _ARO + components_sql("cc", "SELECT id AS u, nbr AS v FROM rod WHERE d <= 1", "SELECT id FROM e"))
def _(i):
    return baselines.rank_order_clusters(i.knn, i.feats)


@query("b13_rank_order_from_vectors", "SELECT id, component AS label FROM cc", BASE + _ARO + components_sql("cc", "SELECT id AS u, nbr AS v FROM rod WHERE d <= 1", "SELECT id FROM e"))
def _(i):
    return baselines.cluster("aro", i.feats, K)


@query("b15_strongest_neighbour", ", b AS (SELECT id, nbr FROM knn WHERE rank = 1), h2 AS (SELECT b.id, c.nbr FROM b JOIN b c ON c.id = b.nbr), h4 AS (SELECT b.id, c.nbr FROM h2 b JOIN h2 c ON c.id = b.nbr), h5 AS (SELECT h4.id, b.nbr FROM h4 JOIN b ON b.id = h4.nbr) SELECT id, nbr AS label FROM h5")
def _(i):
    return baselines.strongest_neighbour(knn.to_edges(i.knn, -1.0), i.feats, 5)


@query("b16_by_name", "SELECT id, component AS label FROM cc", BASE + components_sql("cc", _PAIRS.format(1 - 1.1**2 / 2), "SELECT id FROM e"))
def _(i):
    return baselines.cluster("fast_hierarchy", i.feats, 1.1)


# ---- learned scoring


@query("l1_ego_networks", """, one AS (SELECT id AS c, nbr AS n FROM knn), nodes AS (SELECT c, n FROM one UNION SELECT one.c, k.nbr FROM one JOIN knn k ON k.id = one.n AND k.rank <= 3 UNION SELECT id, id FROM e),
ed AS (SELECT a.c, k.id AS s, k.nbr AS d FROM knn k JOIN nodes a ON a.n = k.id JOIN nodes b ON b.c = a.c AND b.n = k.nbr WHERE rank <= 3), bo AS (SELECT * FROM ed UNION SELECT c, d, s FROM ed)
SELECT c AS centre, (SELECT count(*) FROM nodes x WHERE x.c = y.c) AS n_nodes, count(*) AS n_edges FROM bo y GROUP BY c""")
def _(i):
    nodes, edges = gnn.ego_networks(i.knn, K, 3, 3)
    return nodes.groupBy("centre").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("centre").agg(F.count(F.lit(1)).alias("n_edges")), "centre")


_ADJ = _SYM + ", adj AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM loops)"


@query("l6_vertex_graph", _ADJ + " SELECT src, dst, round(w, 6) AS w FROM adj")
def _(i):
    return gnn.vertex_graph(i.knn, i.feats, -1.0).select("src", "dst", r6("w").alias("w"))


@query("l4_mean_features", _ADJ + ", x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS p FROM e), m AS (SELECT src AS id, p, sum(w * x) AS x FROM adj JOIN x ON x.id = dst GROUP BY ALL) SELECT id, round(sum(x), 6) AS total, round(sum(x * x), 6) AS square FROM m GROUP BY id")
def _(i):
    out = gnn.mean_features(i.feats, gnn.vertex_graph(i.knn, i.feats, -1.0))
    e = F.col("around")
    return out.select("id", r6(F.aggregate(e, F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(vectors.dot(e, e)).alias("square"))


def _dense_sql(out, x, w_rows, w_cols, keys="id"):
    """One dense layer in long form: ``x(keys, p, x)`` times formula weights."""
    return f", {out} AS MATERIALIZED (SELECT {keys}, c_ AS p, sum(x * sin(1 + p * {w_cols} + c_) / sqrt({w_rows})) AS x FROM {x}, (SELECT unnest(range({w_cols})) AS c_) GROUP BY ALL)"


def stack_sql(name, links, key, widths, dim=64):
    """Convolutions over ``{name}(key, n, p, x)`` along ``links(key, s, d, w)``, and ``{name}prob(key, n, prob)`` of the head."""
    sql, now, keys = "", name, f"{key}, n"
    for i, n in enumerate(widths):
        sql += f""", {name}m{i} AS (SELECT l.{key}, l.s AS n, p + {dim} AS p, sum(l.w * x) AS x FROM {links} l JOIN {now} t ON t.{key} = l.{key} AND t.n = l.d GROUP BY l.{key}, l.s, p),
{name}c{i} AS (SELECT {keys}, p, x FROM {now} UNION ALL SELECT {keys}, p, x FROM {name}m{i})"""
        sql += _dense_sql(f"{name}z{i}", f"{name}c{i}", 2 * dim, n, keys) + f", {name}h{i} AS MATERIALIZED (SELECT {keys}, p, greatest(x, 0) AS x FROM {name}z{i})"
        now, dim = f"{name}h{i}", n
    sql += _dense_sql(f"{name}f", now, dim, dim, keys) + f", {name}r AS (SELECT {keys}, p, CASE WHEN x > 0 THEN x ELSE 0.25 * x END AS x FROM {name}f)" + _dense_sql(f"{name}o", f"{name}r", dim, 2, keys)
    return sql + f", {name}prob AS MATERIALIZED (SELECT {keys}, 1 / (1 + exp(sum(CASE WHEN p = 0 THEN x ELSE -x END))) AS prob FROM {name}o GROUP BY ALL)"


def gcn_sql(name, links, widths, dim):
    """Stacked graph convolutions over ``{name}(proposal_id, n, p, x)``: ``{name}out(proposal_id, n, p, x)`` are the last features. Every node has features; the outer join keeps the engine from an endless join order."""
    sql, now = "", name
    for i, n in enumerate(widths):
        sql += _dense_sql(f"{name}w{i}", now, dim, n, "proposal_id, n")
        sql += f", {name}g{i} AS MATERIALIZED (SELECT l.proposal_id, l.s AS n, p, greatest(sum(l.w * x), 0) AS x FROM {links} l LEFT JOIN {name}w{i} t ON t.proposal_id = l.proposal_id AND t.n = l.d GROUP BY l.proposal_id, l.s, p)"
        now, dim = f"{name}g{i}", n
    return sql + f", {name}out AS (SELECT * FROM {now})"


_GCNV = (
    _ADJ
    + ", x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS p FROM e), m AS (SELECT src AS id, p + 64 AS p, sum(w * x) AS x FROM adj JOIN x ON x.id = dst GROUP BY src, p), cat AS (SELECT id, p, x FROM x UNION ALL SELECT id, p, x FROM m)"
    + _dense_sql("y0", "cat", 128, 16) + ", h0 AS (SELECT id, p, greatest(x, 0) AS x FROM y0)"
    + _dense_sql("y1", "h0", 16, 16) + ", h1 AS (SELECT id, p, CASE WHEN x > 0 THEN x ELSE 0.25 * x END AS x FROM y1)"
    + _dense_sql("y2", "h1", 16, 1)
)


@query("l5_vertex_confidence", _GCNV + " SELECT id, round(x, 6) AS conf FROM y2")
def _(i):
    w = gnn.formula_weights(gnn.vertex_shapes(64, 16))
    return gnn.vertex_confidence(i.feats, gnn.vertex_graph(i.knn, i.feats, -1.0), w).select("id", r6("conf").alias("conf"))


_CAND = _DENSITY + ", up AS MATERIALIZED (SELECT k.id, nbr, dist, count(*) OVER (PARTITION BY k.id) AS n FROM knn k JOIN dens a ON a.id = k.id JOIN dens b ON b.id = k.nbr WHERE b.conf > a.conf)"


#: Hidden features, their neighbours, and the nearest one of higher confidence.
_VERTEX = _GCNV.replace(_dense_sql("y0", "cat", 128, 16), _dense_sql("y0", "cat", 128, 32)).replace(_dense_sql("y1", "h0", 16, 16), _dense_sql("y1", "h0", 32, 32)).replace(_dense_sql("y2", "h1", 16, 1), _dense_sql("y2", "h1", 32, 1)) + """,
hv AS MATERIALIZED (SELECT id, list(x / greatest(nrm, 1e-300) ORDER BY p) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS nrm FROM h0) GROUP BY id),
hk AS MATERIALIZED (SELECT id, nbr, 1 - sim AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS r FROM (SELECT a.id, b.id AS nbr, list_dot_product(a.v, b.v) AS sim FROM hv a, hv b WHERE a.id <> b.id)) WHERE r <= 10),
hp AS (SELECT k.id AS src, nbr AS dst, dist, row_number() OVER (PARTITION BY k.id ORDER BY dist, nbr) AS r FROM hk k JOIN y2 a ON a.id = k.id JOIN y2 b ON b.id = k.nbr WHERE b.x > a.x)"""


@query("l7_vertex_pipeline", _VERTEX + components_sql("cc", "SELECT src AS u, dst AS v FROM hp WHERE r = 1 AND dist < 0.5", "SELECT id FROM e") + _DENSE)
def _(i):
    return _all(i, pipelines.vertex_pipeline(i.feats, gnn.formula_weights(gnn.vertex_shapes(64)), tau=0.5))


@query("l16_built_model", _GCNV + " SELECT id, round(x, 6) AS conf FROM y2")
def _(i):
    model = gnn.build("gcn_v", 64, hidden=16)
    return model(i.feats, gnn.vertex_graph(i.knn, i.feats, -1.0)).select("id", r6("conf").alias("conf"))


@query("l8_candidate_sets", _CAND + " SELECT id, nbr, n = 1 AS direct FROM up")
def _(i):
    ask, direct = gnn.candidate_sets(i.knn, _dens(i))
    return ask.select("id", "nbr", F.lit(False).alias("direct")).unionByName(direct.select("id", "nbr", F.lit(True).alias("direct")))


_WIDTHS = (16, 8)


def _edge_sql(asked):
    """Probabilities ``xprob(id, n, prob)`` of the candidates ``asked(id, nbr, dist)``."""
    return _ADJ + f""", q AS MATERIALIZED ({asked}), la AS (SELECT a.id, src AS s, dst AS d, w FROM adj JOIN q a ON a.nbr = src JOIN q b ON b.id = a.id AND b.nbr = dst), ln AS MATERIALIZED (SELECT id, s, d, w / sum(w) OVER (PARTITION BY id, s) AS w FROM la),
x AS MATERIALIZED (SELECT q.id, q.nbr AS n, unnest(range(64)) AS p, unnest(b.v) - unnest(a.v) AS x FROM q JOIN e a ON a.id = q.id JOIN e b ON b.id = q.nbr)""" + stack_sql("x", "ln", "id", _WIDTHS)


def _edge_weights():
    return gnn.formula_weights(gnn.edge_shapes(64, _WIDTHS))


@query("l9_edge_scores", _CAND + _edge_sql("SELECT id, nbr, dist FROM up WHERE n > 1") + " SELECT q.id, nbr, round(dist, 6) AS dist, round(prob, 6) AS prob FROM q JOIN xprob ON xprob.id = q.id AND xprob.n = nbr")
def _(i):
    ask, _ = gnn.candidate_sets(i.knn, _dens(i))
    return gnn.edge_scores(i.feats, gnn.vertex_graph(i.knn, i.feats, -1.0), ask, _edge_weights()).select("id", "nbr", r6("dist").alias("dist"), r6("prob").alias("prob"))


#: A tenth of the vertices, those of lowest confidence, and single candidates take their nearest link.
_LINKS = """, sk AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY conf, id) AS r FROM dens) WHERE r <= (SELECT floor(count(*) * 0.1) FROM e)),
ur AS MATERIALIZED (SELECT up.*, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS r, n = 1 OR id IN (SELECT id FROM sk) AS direct FROM up)"""
_BEST = """, sel AS MATERIALIZED (SELECT id AS src, nbr AS dst, dist FROM (SELECT q.*, row_number() OVER (PARTITION BY q.id ORDER BY {}) AS r FROM q JOIN xprob ON xprob.id = q.id AND xprob.n = nbr) WHERE r = 1
UNION ALL SELECT id, nbr, dist FROM ur WHERE direct AND r = 1)"""
_ASK = _CAND + _LINKS + _edge_sql("SELECT id, nbr, dist FROM ur WHERE NOT direct")


@query("l10_edge_pipeline", _ASK + _BEST.format("prob DESC, dist, nbr") + components_sql("cc", "SELECT src AS u, dst AS v FROM sel WHERE dist < 0.7", "SELECT id FROM e") + _DENSE)
def _(i):
    return _all(i, pipelines.edge_pipeline(i.feats, _dens(i), _edge_weights(), ignore_ratio=0.1))


@query("l10_random_links", _ASK + _BEST.format("md5('5|' || q.id || '|' || nbr)") + components_sql("cc", "SELECT src AS u, dst AS v FROM sel WHERE dist < 0.7", "SELECT id FROM e") + _DENSE)
def _(i):
    return _all(i, pipelines.edge_pipeline(i.feats, _dens(i), _edge_weights(), ignore_ratio=0.1, random_seed=5))


@query("l10_edge_accuracy", _ASK + _BEST.format("prob DESC, dist, nbr") + """, j AS (SELECT (a.label = b.label)::INT::DOUBLE AS ok, EXISTS (SELECT 1 FROM ur WHERE ur.id = src AND ur.nbr = dst AND r = 1) AS near FROM sel JOIN e a ON a.id = src JOIN e b ON b.id = dst)
SELECT count(*) AS n, round(avg(ok), 6) AS accuracy, count(*) FILTER (WHERE near) AS n_nearest, round(avg(ok) FILTER (WHERE near), 6) AS nearest, round(avg(ok) FILTER (WHERE NOT near), 6) AS others FROM j""")
def _(i):
    conf = _dens(i)
    ask, direct = gnn.candidate_sets(i.knn, conf, confidence.ignore_set(conf, 0.1))
    links = gnn.select_edges(gnn.edge_scores(i.feats, gnn.vertex_graph(i.knn, i.feats, -1.0), ask, _edge_weights()), direct)
    r = gnn.edge_accuracy(links, confidence.peaks(i.knn, conf), i.labels)
    return r.select("n", r6("accuracy").alias("accuracy"), "n_nearest", r6("nearest").alias("nearest"), r6("others").alias("others"))


@query("l10_edge_targets", _CAND + " SELECT up.id, nbr, (a.label = b.label)::INT AS target FROM up JOIN e a ON a.id = up.id JOIN e b ON b.id = nbr WHERE n > 1")
def _(i):
    return gnn.edge_targets(gnn.candidate_sets(i.knn, _dens(i))[0].select("id", "nbr"), i.labels)


_PG = """, ie AS (SELECT a.proposal_id, least(id, nbr) AS u, greatest(id, nbr) AS v, max(sim) AS w FROM knn JOIN g a ON a.node = id JOIN g b ON b.node = nbr AND a.proposal_id = b.proposal_id GROUP BY ALL),
pa AS (SELECT proposal_id, u AS s, v AS d, w FROM ie UNION ALL SELECT proposal_id, v, u, w FROM ie UNION ALL SELECT proposal_id, node, node, 1.0 FROM g), pw AS MATERIALIZED (SELECT proposal_id, s, d, w / sum(w) OVER (PARTITION BY proposal_id, s) AS w FROM pa)"""
_SGC = _PG + """, x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS p FROM e), s1 AS MATERIALIZED (SELECT proposal_id, s AS d, p, sum(w * x) AS x FROM pw JOIN x ON x.id = pw.d GROUP BY proposal_id, s, p),
s2 AS (SELECT a.proposal_id, a.s, b.p, sum(a.w * b.x) AS x FROM pw a JOIN s1 b ON a.proposal_id = b.proposal_id AND a.d = b.d GROUP BY ALL), pl AS (SELECT proposal_id, p, avg(x) AS x FROM s2 GROUP BY ALL)
SELECT proposal_id, round(sum(x * sin(1 + p) / 8), 6) AS score FROM pl GROUP BY proposal_id"""


@query("l15_sgc_scores", _SGC, GROUPS)
def _(i):
    nodes, edges = gnn.proposal_graphs(i.feats, i.groups(), i.knn)
    return gnn.sgc_scores(nodes, edges, gnn.formula_weights({"fc": (64, 1), "fc_bias": (1,)}), degree=2).select("proposal_id", r6("score").alias("score"))


_GCN = _PG + """, x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS p FROM e), xw AS (SELECT id, c AS p, sum(x * sin(1 + p * 8 + c) / 8) AS x FROM x, (SELECT unnest(range(8)) AS c) GROUP BY ALL),
g1 AS (SELECT proposal_id, s, p, greatest(sum(w * x), 0) AS x FROM pw JOIN xw ON xw.id = pw.d GROUP BY proposal_id, s, p), pl AS (SELECT proposal_id, p, avg(x) AS x FROM g1 GROUP BY ALL)
SELECT proposal_id, round(sum(x * sin(1 + p) / sqrt(8)), 6) AS score FROM pl GROUP BY proposal_id"""


@query("l14_gcn_scores", _GCN, GROUPS)
def _(i):
    nodes, edges = gnn.proposal_graphs(i.feats, i.groups(), i.knn)
    return gnn.gcn_scores(nodes, edges, gnn.formula_weights(gnn.gcn_shapes(64, (8,)))).select("proposal_id", r6("score").alias("score"))


def _ego_sql(k1, k2, active):
    """Link probabilities ``zprob(c, n, prob)`` of ego networks with nodes ``en`` and one-hop neighbours ``one``."""
    return f""", one AS (SELECT id AS c, nbr AS n FROM knn WHERE rank <= {k1}), en AS MATERIALIZED (SELECT c, n FROM one UNION SELECT one.c, k.nbr FROM one JOIN knn k ON k.id = one.n AND k.rank <= {k2} UNION SELECT id, id FROM e),
ed AS (SELECT a.c, k.id AS s, k.nbr AS d FROM knn k JOIN en a ON a.n = k.id JOIN en b ON b.c = a.c AND b.n = k.nbr WHERE rank <= {active}), eb AS (SELECT * FROM ed UNION SELECT c, d, s FROM ed),
el AS MATERIALIZED (SELECT c, s, d, 1.0::DOUBLE / count(*) OVER (PARTITION BY c, s) AS w FROM eb),
z AS MATERIALIZED (SELECT c, n, unnest(range(64)) AS p, (unnest(b.v) - unnest(a.v)) / sqrt(1.00001) AS x FROM en JOIN e a ON a.id = c JOIN e b ON b.id = n)""" + stack_sql("z", "el", "c", _WIDTHS)


def _ego_weights():
    """Stored input statistics: means 0, variances 1."""
    return gnn.formula_weights(gnn.edge_shapes(64, _WIDTHS) | {"in_mean": (64,), "in_var": (64,)})


@query("l2_linkage_scores", _ego_sql(10, 3, 3) + " SELECT one.c AS u, one.n AS v, round(prob, 6) AS score FROM one JOIN zprob USING (c, n)")
def _(i):
    return gnn.linkage_scores(i.feats, *gnn.ego_networks(i.knn, K, 3, 3), _ego_weights()).select("u", "v", r6("score").alias("score"))


_L3, _L3_LABELS = dynamic_sql("k", "lk", 5, 50, 0.05)


@query("l3_linkage_pipeline", _ego_sql(10, 5, 5) + ", lk AS MATERIALIZED (SELECT least(c, n) AS u, greatest(c, n) AS v, avg(prob) AS score FROM one JOIN zprob USING (c, n) GROUP BY ALL)" + _L3 + f", ll AS ({_L3_LABELS}) SELECT e.id, coalesce(ll.label, e.id) AS label FROM e LEFT JOIN ll USING (id)")
def _(i):
    return _all(i, pipelines.linkage_pipeline(i.feats, _ego_weights(), step=0.05))


#: Proposals whose size is not limited are components; the models of proposals and of their nodes.
_DET = _PG + """,
x AS MATERIALIZED (SELECT proposal_id, node AS n, unnest(range(64)) AS p, unnest(v) AS x FROM g JOIN e ON e.id = node)""" + gcn_sql("x", "pw", (8, 4), 64) + """,
ds AS MATERIALIZED (SELECT proposal_id, sum(x * sin(1 + p) / 2) AS score FROM (SELECT proposal_id, p, avg(x) AS x FROM xout GROUP BY ALL) GROUP BY ALL)"""
_WHOLE = {"th": 0.35, "max_size": 10**6}
_SEG = _DET + """, dg AS (SELECT g.proposal_id, node, count(u) AS n FROM g LEFT JOIN ie ON ie.proposal_id = g.proposal_id AND (u = node OR v = node) GROUP BY ALL),
sd AS (SELECT proposal_id, node AS seed FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY n DESC, node) AS r FROM dg) WHERE r = 1),
y AS MATERIALIZED (SELECT proposal_id, n, p, x FROM x UNION ALL SELECT proposal_id, node, 64, (node = seed)::INT::DOUBLE FROM g JOIN sd USING (proposal_id))""" + gcn_sql("y", "pw", (8, 4), 65) + _dense_sql("yl", "yout", 4, 2, "proposal_id, n") + """,
yp AS (SELECT proposal_id, n, 1 / (1 + exp(sum(CASE WHEN p = 0 THEN x ELSE -x END))) <= 0.5 AS outlier FROM yl GROUP BY ALL)"""


@query("l17_detection", _DET + ", rk AS (SELECT proposal_id, row_number() OVER (ORDER BY score DESC, proposal_id) AS rank FROM ds WHERE score >= 0.0), " + _ASSIGN.format(o="g", rk="rk"), GROUPS)
def _(i):
    return _all(i, pipelines.detection(i.feats, gnn.formula_weights(gnn.gcn_shapes(64, (8, 4))), th_pos=0.0, neighbours=i.knn, **_WHOLE))


@query("l18_segmentation", _SEG + ", pt AS (SELECT proposal_id, outlier, min(n) AS head FROM yp GROUP BY ALL), pn AS (SELECT *, row_number() OVER (ORDER BY head) - 1 AS label FROM pt) SELECT n AS id, label FROM yp JOIN pn USING (proposal_id, outlier)", GROUPS)
def _(i):
    return _all(i, pipelines.segmentation(i.feats, i.labels, gnn.formula_weights(gnn.gcn_shapes(64, (8, 4))), gnn.formula_weights(gnn.gcn_shapes(65, (8, 4), 2)), **_WHOLE))


@query("l18_node_probabilities", _SEG + " SELECT proposal_id, n AS node, round(1 / (1 + exp(sum(CASE WHEN p = 0 THEN x ELSE -x END))), 6) AS prob FROM yl GROUP BY ALL", GROUPS)
def _(i):
    nodes, edges = gnn.proposal_graphs(i.feats, i.groups(), i.knn)
    return gnn.gcn_scores(gnn.with_seed(nodes, edges), edges, gnn.formula_weights(gnn.gcn_shapes(65, (8, 4), 2)), pool="none").select("proposal_id", "node", r6("prob").alias("prob"))


@query("l11_proposal_graph", _PG + " SELECT proposal_id, s AS src, d AS dst, round(w, 6) AS w FROM pw", GROUPS)
def _(i):
    nodes, edges = gnn.proposal_graphs(i.feats, i.groups(), i.knn)
    both = edges.select(F.col("proposal_id"), F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionByName(edges.select("proposal_id", F.col("v").alias("src"), F.col("u").alias("dst"), "w"))
    both = both.unionByName(nodes.select("proposal_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    from pyspark.sql.window import Window

    return both.select("proposal_id", "src", "dst", r6(F.col("w") / F.sum("w").over(Window.partitionBy("proposal_id", "src"))).alias("w"))


@query("l12_detection_targets", "SELECT proposal_id, round(iou, 6) AS target FROM an", _TWO)
def _(i):
    return gnn.detection_targets(_two(i), i.labels).select("proposal_id", r6("target").alias("target"))


@query("l13_segmentation_targets", _PG + """, dg AS (SELECT g.proposal_id, node, count(u) AS n FROM g LEFT JOIN ie ON ie.proposal_id = g.proposal_id AND (u = node OR v = node) GROUP BY ALL),
sd AS (SELECT proposal_id, node AS seed FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY n DESC, node) AS r FROM dg) WHERE r = 1)
SELECT proposal_id, node, node = seed AS is_seed, (a.label = b.label)::INT AS target FROM g JOIN sd USING (proposal_id) JOIN e a ON a.id = node JOIN e b ON b.id = seed""", GROUPS)
def _(i):
    g = i.groups()
    return gnn.segmentation_targets(g, proposals.induced_edges(g, i.knn), i.labels)


@query("l16_stored_weights", "SELECT 'fc' AS param, p::INT AS row, round(sin(1 + p) / 8, 6) AS value FROM (SELECT unnest(range(64)) AS p)", "")
def _(i):
    path = scratch_path(i.spark, "weights")
    gnn.weights_to_table(i.spark, gnn.formula_weights({"fc": (64, 1)})).write.parquet(path)
    return i.spark.read.parquet(path).select("param", "row", r6(F.col("values")[0]).alias("value"))


@query("l20_samplers", "SELECT id, row_number() OVER (ORDER BY md5('0|1|' || id), id) - 1 AS place, ((row_number() OVER (ORDER BY id) - 1) * 4 // count(*) OVER ())::INT AS part FROM e")
def _(i):
    return training.ranges(training.shuffled(i.feats, 1), 4).select("id", "place", "part")


def _losses(i, name, trained):
    return i.spark.createDataFrame([(name, k, v) for k, v in enumerate(trained[1])], "model string, step int, loss double")


@query("l21_training")
def _(i):
    """Losses of all five models."""
    g, conf, adj = i.groups(), _dens(i), cut(gnn.vertex_graph(i.knn, i.feats), "train-adj")
    w = gnn.formula_weights
    runs = {
        "vertex": lambda: training.train_vertex_model(i.feats, adj, confidence.s_nbr(i.knn, i.labels), w(gnn.vertex_shapes(64, 16)), steps=4),
        "detection": lambda: training.train_detection(i.feats, g, i.knn, i.labels, w(gnn.gcn_shapes(64, (8,))), steps=4),
        "segmentation": lambda: training.train_segmentation(i.feats, g, i.knn, i.labels, w(gnn.gcn_shapes(65, (8,), 2)), steps=4),
        "edge": lambda: training.train_edges(i.feats, adj, gnn.candidate_sets(i.knn, conf)[0], i.labels, w(gnn.edge_shapes(64, (8,))), steps=4),
        "linkage": lambda: training.train_linkage(i.feats, gnn.ego_networks(i.knn, 5, 3, 3), i.labels, w(gnn.edge_shapes(64, (8,))), steps=4),
    }
    out = None
    for name, run in runs.items():
        df = _losses(i, name, run())
        out = df if out is None else out.unionByName(df)
    return out


# ---- metrics

_PW = "one AS (SELECT sum(n) AS nn, sum(n * n) - sum(n) AS t, (SELECT sum(pn * pn) FROM pn) AS ps, (SELECT sum(gn * gn) FROM gn) AS gs FROM ct), pr AS (SELECT t / (ps - nn) AS precision, t / (gs - nn) AS recall FROM one)"


def _prf(df):
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query("m1_pairwise", f", {_PW} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f FROM pr", PRED)
def _(i):
    return _prf(metrics.pairwise(i.labels, i.predicted()))


@query("m2_bcubed", ", b AS (SELECT sum(n * n / pn) / sum(n) AS precision, sum(n * n / gn) / sum(n) AS recall FROM ct JOIN pn USING (p) JOIN gn USING (g)) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f FROM b", PRED)
def _(i):
    return _prf(metrics.bcubed(i.labels, i.predicted()))


@query("m3_nmi", ", t AS (SELECT sum(n) AS nn FROM ct) SELECT round(2 * (SELECT sum(n / nn * ln(n * nn / (pn * gn))) FROM ct JOIN pn USING (p) JOIN gn USING (g), t) / ((SELECT sum(-pn / nn * ln(pn / nn)) FROM pn, t) + (SELECT sum(-gn / nn * ln(gn / nn)) FROM gn, t)), 6) AS nmi", PRED)
def _(i):
    return _prf(metrics.nmi(i.labels, i.predicted()))


@query("m4_m5_m6_binary", "SELECT round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS precision, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS recall, round(avg((quality = toxic)::INT::DOUBLE), 6) AS accuracy FROM labels", "")
def _(i):
    return _prf(metrics.binary(table(i.spark, i.dir, "labels"), "quality", "toxic"))


@query("m8_evaluate", f", {_PW} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f FROM pr", PRED)
def _(i):
    return _prf(metrics.evaluate(i.labels, i.predicted(), "pairwise"))


@query("s11_m8_evaluate_files", f", {_PW} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f FROM pr", PRED)
def _(i):
    """Both labelings go through files of one integer a line."""
    paths = [scratch_path(i.spark, f"labels-{k}") for k in range(2)]
    n = i.labels.count()
    for labels, path in zip((i.labels, i.predicted()), paths, strict=True):
        io.write_labels(labels, path, n)
    return _prf(metrics.evaluate_files(i.spark, *paths))


@query("m9_clustering_report", f""", {_PW}, b AS (SELECT sum(n * n / pn) / sum(n) AS bp, sum(n * n / gn) / sum(n) AS br FROM ct JOIN pn USING (p) JOIN gn USING (g)), t AS (SELECT sum(n) AS nn FROM ct)
SELECT (SELECT count(*) FROM pn) AS n_clusters, nn::BIGINT AS n_ids, 1.0::DOUBLE AS coverage, round(precision, 6) AS pairwise_precision, round(recall, 6) AS pairwise_recall, round(2 * precision * recall / (precision + recall), 6) AS pairwise_f,
 round(bp, 6) AS bcubed_precision, round(br, 6) AS bcubed_recall, round(2 * bp * br / (bp + br), 6) AS bcubed_f,
 round(2 * (SELECT sum(n / nn * ln(n * nn / (pn * gn))) FROM ct JOIN pn USING (p) JOIN gn USING (g)) / ((SELECT sum(-pn / nn * ln(pn / nn)) FROM pn) + (SELECT sum(-gn / nn * ln(gn / nn)) FROM gn)), 6) AS nmi FROM pr, b, t""", PRED)
def _(i):
    r = metrics.clustering_report(i.labels, i.predicted())
    return r.select("n_clusters", "n_ids", *[r6(c).alias(c) for c in r.columns if c not in ("n_clusters", "n_ids")])


def flagship(spark, sf_dir):
    """Neighbours, pairs, components and pairwise quality."""
    return QUERIES["m1_pairwise"](spark, sf_dir)
