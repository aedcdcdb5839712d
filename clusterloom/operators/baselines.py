"""Classic clusterers; all return ``id, label``. Noise and isolated ids are clusters of their own."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.scratch import cut, release
from clusterloom.operators.components import connected_components
from clusterloom.operators.knn import close_links, filter_by_similarity, knn_exact, near_sums, similar_pairs
from clusterloom.operators.vectors import matrix, weighted_sum


def _vec(feats: DataFrame) -> DataFrame:
    return feats.select("id", array_to_vector("embedding").alias("features"))


def _predicted(model, feats: DataFrame) -> DataFrame:
    return model.transform(_vec(feats)).select("id", F.col("prediction").cast("long").alias("label"))


def kmeans(feats: DataFrame, k: int, seed: int = 0, max_iter: int = 20) -> DataFrame:
    return _predicted(KMeans(k=k, seed=seed, maxIter=max_iter).fit(_vec(feats)), feats)


def assign(feats: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, embedding, label``: the nearest of a bounded number of centres, ties to the first."""
    shared = feats.sparkSession.sparkContext.broadcast(centres)  # k vectors

    def run(batches):
        c = shared.value
        half = (c * c).sum(1) / 2
        for b in batches:
            if b.num_rows:
                near = np.concatenate([(matrix(b.column(1).slice(lo, 4096)) @ c.T - half).argmax(1) for lo in range(0, b.num_rows, 4096)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], ["id", "embedding", "label"])

    return feats.select("id", "embedding").mapInArrow(run, "id long, embedding array<double>, label long")


def mini_batch_kmeans(feats: DataFrame, k: int, share: float = 0.3, rounds: int = 5, seed: int = 0) -> DataFrame:
    """Centres start at k rows drawn by a seeded hash. Each round draws another ``share`` of the rows, assigns them and moves
    every centre towards its rows' mean by their share of all rows it has met so far; rows are assigned at the end."""
    drawn = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    first = feats.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).toPandas()
    centres = np.array(first["embedding"].tolist())
    met = np.zeros(len(centres))
    for i in range(rounds):
        rows = cut(assign(feats.where(drawn(i)), centres).withColumn("w", F.lit(1.0)), "mini-batch")
        sums = weighted_sum(rows, "label").join(rows.groupBy(F.col("label").alias("l")).count(), F.col("label") == F.col("l")).select("label", "embedding", "count")
        for r in sums.collect():  # k rows
            met[r["label"]] += r["count"]
            centres[r["label"]] += (np.array(r["embedding"]) - r["count"] * centres[r["label"]]) / met[r["label"]]
        release(rows)
    return assign(feats, centres).select("id", "label")


def spectral(knn: DataFrame, k: int, max_iter: int = 20, gamma: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Power iteration on the neighbour graph (an approximation of spectral clustering); ``gamma`` takes rbf weights.

    Ids without an edge of positive weight are clusters of their own, labelled ``k + id``.
    """
    sim = 1 - F.col("dist")
    w = F.exp(-gamma * 2 * F.col("dist")) if gamma is not None else F.greatest(sim, F.lit(0.0))
    edges = knn.where("id <> nbr").groupBy(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).agg(F.max(w).alias("w")).where("w > 0")
    nodes = knn.select("id") if nodes is None else nodes.select("id")
    out = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="w").assignClusters(cut(edges, "spectral-edges"))
    return nodes.distinct().join(out, "id", "left").select("id", F.coalesce(F.col("cluster").cast("long"), k + F.col("id")).alias("label"))


def hierarchy(feats: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Divisive clustering into k groups, in place of bottom-up Ward linkage, which cannot be distributed."""
    return _predicted(BisectingKMeans(k=k, seed=seed).fit(_vec(feats)), feats)


def single_linkage(feats: DataFrame, distance: float) -> DataFrame:
    """Single linkage cut at a Euclidean distance, for unit vectors: components of the pairs within it."""
    pairs = similar_pairs(feats, 1 - distance * distance / 2)
    return connected_components(pairs, feats.select("id"), src="u", dst="v").select("id", F.col("component").alias("label"))


def _dbscan(pairs: DataFrame, nodes: DataFrame, min_samples: int) -> DataFrame:
    """DBSCAN over neighbour pairs in both directions; a border point goes to its smallest core cluster."""
    both = cut(pairs.select("u", "v").union(pairs.select("v", "u")).distinct().select(F.col("u").alias("id"), F.col("v").alias("nbr")), "dbscan")
    degree = nodes.select("id").join(both.groupBy("id").count(), "id", "left").select("id", (F.coalesce("count", F.lit(0)) + 1).alias("n"))  # with itself
    core = cut(degree.where(F.col("n") >= min_samples).select("id"), "dbscan-core")
    inner = both.join(core, "id").join(core.select(F.col("id").alias("nbr")), "nbr")
    comp = connected_components(inner, core, src="id", dst="nbr")
    border = both.join(core, "id", "left_anti").join(comp.select(F.col("id").alias("nbr"), "component"), "nbr").groupBy("id").agg(F.min("component").alias("component"))
    known = comp.unionByName(border)
    return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def dbscan(feats: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Euclidean DBSCAN of unit vectors; noise points are single."""
    return _dbscan(similar_pairs(feats, 1 - eps * eps / 2), feats, min_samples)


def knn_dbscan(knn: DataFrame, nodes: DataFrame, eps: float, min_samples: int, th: float = 0.0) -> DataFrame:
    """DBSCAN on neighbour lists: pairs with ``dist <= eps`` and similarity of at least ``th``."""
    near = knn.where((F.col("dist") <= eps) & (1 - F.col("dist") >= th) & (F.col("id") != F.col("nbr")))
    return _dbscan(near.select(F.col("id").alias("u"), F.col("nbr").alias("v")), nodes, min_samples)


def hdbscan(feats: DataFrame, min_samples: int = 5, min_size: int = 5, k: int = 30, levels: int = 12) -> DataFrame:
    """Density hierarchy over mutual reachability distances of the k-neighbour graph, taken at ``levels`` distance quantiles.

    From sparse to dense, a component of at least ``min_size`` goes on as the same cluster while it
    is the only such part of its parent, and a parent with several such parts ends in new
    clusters. A cluster's stability is the sum over its levels of members times the gain
    in density. From the leaves up, a cluster is chosen if it is at least as stable as the
    best choice among its descendants; the outermost chosen ones are the result. The root is no choice unless nothing splits.
    """
    knn = cut(knn_exact(feats, max(k, min_samples)), "hdb-knn")
    core = knn.where(F.col("rank") == min_samples).select("id", F.col("dist").alias("c"))
    a, b = core.select("id", F.col("c").alias("ca")), core.select(F.col("id").alias("nbr"), F.col("c").alias("cb"))
    reach = cut(knn.join(a, "id").join(b, "nbr").select("id", "nbr", F.greatest("dist", "ca", "cb").alias("d")), "hdb-reach")
    nodes = feats.select("id")
    cuts = sorted(set(reach.approxQuantile("d", [(i + 1) / levels for i in range(levels)], 0.0)), reverse=True)  # from sparse to dense
    density = [1 / max(d, 1e-9) for d in cuts]
    members, parts = [], []  # per level: ids with their cluster, and clusters with parent and gain
    before = None
    for i, d in enumerate(cuts):
        comp = connected_components(reach.where(F.col("d") <= d), src="id", dst="nbr")
        size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
        comp = cut(comp.join(size, "component"), "hdb-level")
        part = comp.select("component", "n").distinct()
        own = F.col("component") * levels + i  # a name that tells birth level and component
        if before is None:
            part = part.withColumn("cluster", own).withColumn("parent", F.lit(None).cast("long"))
        else:
            up = before.select(F.col("id").alias("component"), F.col("cluster").alias("up"))
            part = part.join(up, "component")  # a component has the name of a member
            part = part.withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("up")))
            part = part.withColumn("cluster", F.when(F.col("twins") > 1, own).otherwise(F.col("up"))).withColumn("parent", F.when(F.col("twins") > 1, F.col("up")))
        gain = density[i] - (density[i - 1] if i else 0.0)
        part = cut(part.select("component", "cluster", "parent", (F.col("n") * gain).alias("gain"), F.lit(i).alias("level")), "hdb-part")
        before = cut(comp.join(part, "component").select("id", "cluster"), "hdb-members")
        members.append(before)
        parts.append(part)
        if before.isEmpty():
            break
    if not parts:
        return nodes.select("id", F.col("id").alias("label"))
    every = functools.reduce(DataFrame.unionByName, parts)
    tree = cut(every.groupBy("cluster").agg(F.max("parent").alias("parent"), F.min("level").alias("born"), F.sum("gain").alias("stable")), "hdb-tree")
    best = None  # cluster, parent, best, chosen of all clusters born at a level or later
    for i in range(len(parts) - 1, -1, -1):
        now = tree.where(F.col("born") == i)
        if best is None:
            done = now.select("cluster", "parent", F.col("stable").alias("best"), F.lit(True).alias("chosen"))
        else:
            below = best.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"))
            done = now.join(below, "cluster", "left").select("cluster", "parent", F.greatest("stable", F.coalesce("below", F.lit(0.0))).alias("best"), (F.col("below").isNull() | (F.col("stable") >= F.col("below"))).alias("chosen"))
        best = cut(done if best is None else best.unionByName(done), "hdb-best")
    if best.where("parent is null").count() == 1:  # one root that holds all
        split = best.where("parent is not null").select("parent").distinct().withColumnRenamed("parent", "cluster")
        best = best.join(split.withColumn("splits", F.lit(True)), "cluster", "left").withColumn("chosen", F.col("chosen") & (F.col("parent").isNotNull() | F.col("splits").isNull()))
    picked = best.where("chosen").select("cluster").join(tree.select("cluster", "born"), "cluster")
    chain = functools.reduce(DataFrame.unionByName, members).distinct().join(picked, "cluster")
    label = chain.groupBy("id").agg(F.min_by("cluster", "born").alias("c"))
    heads = label.groupBy("c").agg(F.min("id").alias("label"))
    return nodes.join(label.join(heads, "c").select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def mean_shift(feats: DataFrame, bandwidth: float, max_rounds: int = 100, merge: float | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Every point moves to the mean of the original points within ``bandwidth`` until it moves less than ``tolerance`` of that; points that end up together are a cluster.

    Points that have come to rest leave the rounds; of points with one set of neighbours, which move together from then on, the
    smallest id goes on for all. More than ``max_rounds`` rounds raise ``RuntimeError``.
    """
    start = cut(feats.select("id", "embedding"), "shift-start")
    row = start.select(F.size("embedding")).take(1)
    if not row:
        return feats.select("id", F.col("id").alias("label"))
    dim, half = row[0][0], bandwidth * bandwidth / 2
    # |a - b|^2 <= h^2 is a.b - |a|^2/2 - |b|^2/2 >= -h^2/2: one inner product with two more components.
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) / 2
    asking, asked = F.concat("embedding", F.array(F.lit(1.0), -norm)), F.concat("embedding", F.array(-norm, F.lit(1.0)))
    fixed, moving, done, links = start.select("id", asked.alias("embedding")), start, None, None
    for _ in range(max_rounds):
        met = near_sums(moving.select("id", asking.alias("embedding")), fixed, -half - 1e-12, dim)
        mean = F.transform(F.slice("embedding", 1, dim), lambda x: x / F.element_at("embedding", dim + 1))
        step = F.sqrt(F.aggregate(F.zip_with("embedding", "old", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        now = met.select("id", mean.alias("embedding"), F.slice("embedding", dim + 2, 4).alias("met")).join(moving.select("id", F.col("embedding").alias("old")), "id")
        now = cut(now.select("id", "embedding", "met", (step < tolerance * bandwidth).alias("rests")), "shift")
        heads = cut(now.groupBy("met", "rests").agg(F.min("id").alias("head")), "shift-heads")
        tied = now.select("id", "met", "rests").join(heads, ["met", "rests"]).where("id <> head").select("id", F.col("head").alias("nbr"))
        links = tied if links is None else links.unionByName(tied)
        now = cut(now.join(heads.select(F.col("head").alias("id")), "id", "left_semi").select("id", "embedding", "rests"), "shift-moved")
        rested = now.where("rests").select("id", "embedding")
        done = rested if done is None else done.unionByName(rested)
        moving = now.where("not rests").select("id", "embedding")
        if moving.isEmpty():
            break
    else:
        raise RuntimeError("mean shift did not settle")
    merge = bandwidth / 2 if merge is None else merge
    last = cut(done, "shift-last")
    close = close_links(last.select("id", asking.alias("embedding")), last.select("id", asked.alias("embedding")), -merge * merge / 2 - 1e-12)
    return connected_components(close.unionByName(links), feats.select("id"), src="id", dst="nbr").select("id", F.col("component").alias("label"))


def rank_order_distance(knn: DataFrame) -> DataFrame:
    """``id, nbr, d`` of neighbours in each other's lists.

    ``O_i`` is the 0-based place of j in i's list and ``O_j`` the 1-based place of i in j's. The distance counts
    the first ``O_i`` neighbours of i that j lacks and the first ``O_j`` of j that i lacks, over the smaller
    (at least 1). Each link is joined with list entries before its place only.
    """
    k = knn.select("id", "nbr", "rank")
    back = k.select(F.col("id").alias("nbr"), F.col("nbr").alias("id"), F.col("rank").alias("rj"))
    link = cut(k.join(back, ["id", "nbr"]).select("id", "nbr", (F.col("rank") - 1).alias("oi"), F.col("rj").alias("oj")), "rank-links")
    lists = k.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda t: t["nbr"]).alias("l"))  # k entries
    a, b = lists.select("id", F.col("l").alias("li")), lists.select(F.col("id").alias("nbr"), F.col("l").alias("lj"))
    missing = lambda x, n, other: F.size(F.array_except(F.slice(x, F.lit(1), n.cast("int")), other))
    return link.join(a, "id").join(b, "nbr").select(
        "id", "nbr",
        ((missing(F.col("li"), F.col("oi"), F.array_append(F.col("lj"), F.col("nbr"))) + missing(F.col("lj"), F.col("oj"), F.array_append(F.col("li"), F.col("id")))) / F.greatest(F.least("oi", "oj"), F.lit(1))).alias("d"),
    )


def rank_order_clusters(knn: DataFrame, nodes: DataFrame, th: float = 0.0) -> DataFrame:
    """Components of links with rank-order distance of at most ``1 - th``."""
    links = rank_order_distance(knn).where(F.col("d") <= 1 - th)
    return connected_components(links, nodes.select("id"), src="id", dst="nbr").select("id", F.col("component").alias("label"))


def chinese_whispers(edges: DataFrame, nodes: DataFrame, rounds: int = 10, seed: int = 0) -> DataFrame:
    """Label propagation: every round each node takes the label of largest summed weight around it; a seeded half of the nodes moves at a time."""
    label = nodes.select("id", F.col("id").alias("label"))
    for i in range(rounds):
        votes = edges.join(label.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new"))
        moves = F.expr(f"shiftright((pmod(id, 4294967296) * 40503 + {seed + i} * 26543) % 4294967296, 15) % 2 = 0")
        label = cut(label.join(best, "id", "left").select("id", F.when(moves & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("label")).alias("label")), "whispers")
    return label


def strongest_neighbour(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """Follow the heaviest edge ``rounds`` times (ties to the smaller id); nodes without edges keep their own label."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    best = edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("src").alias("id"), F.col("dst").alias("to"))
    hop = cut(nodes.select("id").join(best, "id", "left").select("id", F.coalesce("to", "id").alias("to")), "hop")
    at = nodes.select("id", F.col("id").alias("label"))
    n = rounds
    while n:  # binary powers of the hop
        if n & 1:
            at = at.join(hop.select(F.col("id").alias("label"), "to"), "label").select("id", F.col("to").alias("label"))
        n >>= 1
        if n:
            hop = cut(hop.join(hop.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to").select("id", F.col("to2").alias("to")), "hop")
    return at


def rank_order(feats: DataFrame, k: int, th: float = 0.0, knn: DataFrame | None = None, min_sim: float | None = None) -> DataFrame:
    """From vectors, or from neighbours that are there already, to rank-order clusters; ``min_sim`` drops weak neighbours first."""
    near = cut(knn_exact(feats, k), "aro-knn") if knn is None else knn
    return rank_order_clusters(near if min_sim is None else filter_by_similarity(near, min_sim), feats, th)


METHODS = {
    "kmeans": kmeans, "mini_batch_kmeans": mini_batch_kmeans, "spectral": spectral, "hierarchy": hierarchy, "fast_hierarchy": single_linkage, "dbscan": dbscan, "knn_dbscan": knn_dbscan,
    "hdbscan": hdbscan, "meanshift": mean_shift, "aro": rank_order, "knn_aro": rank_order_clusters, "chinese_whispers": chinese_whispers, "chinese_whispers_fast": strongest_neighbour,
}


def cluster(method: str, *args, **kw) -> DataFrame:
    """A clusterer by name; unknown names raise ``KeyError``."""
    return METHODS[method](*args, **kw)
