"""Cluster proposals ``proposal_id, node``: making, measuring, filtering and resolving them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.numbering import numbered
from clusterloom.functions.scratch import cut, release
from clusterloom.operators.graph import dense_labels, dynamic_threshold_clusters
from clusterloom.operators.knn import knn_exact, undirected_pairs
from clusterloom.operators.vectors import group_mean


def super_vertices(knn: DataFrame, k: int, th: float, step: float, max_size: int) -> DataFrame:
    """``id, label`` of size-limited clusters; ids without a pair are absent."""
    return dynamic_threshold_clusters(undirected_pairs(knn, th, k), max_size, step)


def to_clusters(labels: DataFrame) -> DataFrame:
    """``label, members`` (sorted)."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members"))


def to_labels(clusters: DataFrame) -> DataFrame:
    """``id, label`` of clusters that may overlap: the largest label wins."""
    return clusters.select("label", F.explode("members").alias("id")).groupBy("id").agg(F.max("label").alias("label"))


def size_filter(props: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Proposals of ``least`` to ``most`` nodes."""
    n = props.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = n.where(F.col("_n") >= least) if most is None else n.where(F.col("_n").between(least, most))
    return props.join(ok.select("proposal_id"), "proposal_id", "left_semi")


def of_size(props: DataFrame, size: int = 1) -> DataFrame:
    """``node`` of proposals with exactly ``size`` nodes."""
    return size_filter(props, size, size).select("node").distinct()


def fill_labels(labels: DataFrame, n: int, ignore: int | None = None) -> DataFrame:
    """A label for each id below ``n``: dense ones for those given (except ``ignore``), fresh ones for the others in id order."""
    known = labels if ignore is None else labels.where(F.col("label") != ignore)
    dense = dense_labels(known)
    most = dense.agg(F.coalesce(F.max("label") + 1, F.lit(0)).alias("_m"))
    missing = labels.sparkSession.range(n).join(dense, "id", "left_anti")
    fresh = numbered(missing.select("id"), "id", into="_n").crossJoin(most).select("id", (F.col("_m") + F.col("_n")).alias("label"))  # one row on the right
    return dense.unionByName(fresh)


def induced_edges(props: DataFrame, knn: DataFrame, key=("proposal_id",)) -> DataFrame:
    """``key, u, v, dist``: neighbour links inside each proposal, once for each pair."""
    key = list(key)
    a, b = props.select(*key, F.col("node").alias("id")), props.select(*key, F.col("node").alias("nbr"))
    rows = knn.where("id <> nbr").join(a, "id").join(b, [*key, "nbr"])
    return rows.groupBy(*key, F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v")).agg(F.min_by("dist", F.struct("id", "rank")).alias("dist"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pa, pb, inter, iop, iog, iou`` of all proposals of ``a`` and ``b`` that share a node (iop: over a, iog: over b)."""
    left, right = a.select(F.col("proposal_id").alias("pa"), "node"), b.select(F.col("proposal_id").alias("pb"), "node")
    na, nb = left.groupBy("pa").agg(F.count(F.lit(1)).alias("na")), right.groupBy("pb").agg(F.count(F.lit(1)).alias("nb"))
    inter = left.join(right, "node").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("inter"))
    i = F.col("inter")
    return inter.join(na, "pa").join(nb, "pb").select("pa", "pb", "inter", (i / F.col("na")).alias("iop"), (i / F.col("nb")).alias("iog"), (i / (F.col("na") + F.col("nb") - i)).alias("iou"))


def partial_overlaps(props: DataFrame) -> DataFrame:
    """One row: number of proposal pairs that share nodes without one holding the other."""
    o = overlaps(props, props).where("pa < pb")
    return o.agg(F.coalesce(F.sum(((F.col("iop") < 1) & (F.col("iog") < 1)).cast("long")), F.lit(0)).alias("n_partial"))


def majority(props: DataFrame, labels: DataFrame) -> DataFrame:
    """``proposal_id, label``: the most frequent label, ties to the smallest."""
    c = props.join(labels.select(F.col("id").alias("node"), "label"), "node").groupBy("proposal_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("proposal_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def analyze(props: DataFrame, labels: DataFrame, th_pos: float = 0.7, th_neg: float = 0.3) -> DataFrame:
    """``proposal_id, label, size, iou, iop, iog, kind`` against the majority class; kind is positive, negative or none."""
    lab = labels.select(F.col("id").alias("node"), "label")
    c = props.join(lab, "node").groupBy("proposal_id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("proposal_id").agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("t")).select("proposal_id", "t.label", "t.n")
    size, cls = props.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("size")), labels.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    r = top.join(size, "proposal_id").join(cls, "label").withColumn("iou", F.col("n") / (F.col("size") + F.col("m") - F.col("n")))
    kind = F.when(F.col("iou") > th_pos, "positive").when(F.col("iou") < th_neg, "negative")
    return r.select("proposal_id", "label", "size", "iou", (F.col("n") / F.col("size")).alias("iop"), (F.col("n") / F.col("m")).alias("iog"), kind.alias("kind"))


def report(props: DataFrame, labels: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row of statistics: number and sizes of proposals, coverage, squared error of their IoU to 0 and 1."""
    a = analyze(props, labels)
    one = a.agg(F.count(F.lit(1)).alias("n_proposals"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.avg(F.pow(F.col("iou"), 2)).alias("mse_0"), F.avg(F.pow(1 - F.col("iou"), 2)).alias("mse_1"))
    seen = props.select("node").distinct().agg(F.count(F.lit(1)).alias("covered"))
    n = labels.agg(F.count(F.lit(1)).alias("n_ids"))
    return one.crossJoin(seen).crossJoin(n).withColumn("coverage", F.col("covered") / F.col("n_ids"))


def iop_range(props: DataFrame, iop: DataFrame, low: float, high: float) -> DataFrame:
    """Proposals with ``low <= iop <= high`` in ``iop(proposal_id, iop)``."""
    return props.join(iop.where(F.col("iop").between(low, high)).select("proposal_id"), "proposal_id", "left_semi")


def suppressed(props: DataFrame, order: DataFrame, th: float, max_rounds: int = 200) -> DataFrame:
    """``proposal_id, rank`` of what greedy suppression keeps; ``order`` has ``proposal_id, rank``.

    In rank order, a kept proposal removes later ones with ``iou > th``. A round keeps all
    proposals with no undecided or kept overlap before them and removes what those overlap, so
    the result is that of the sequential rule; rounds follow the longest chain of overlaps.
    """
    if th >= 1:
        return order.select("proposal_id", "rank")
    o = overlaps(props, props).where(F.col("iou") > th)
    a, b = order.select(F.col("proposal_id").alias("pa"), F.col("rank").alias("ra")), order.select(F.col("proposal_id").alias("pb"), F.col("rank").alias("rb"))
    over = cut(o.join(a, "pa").join(b, "pb").where("ra < rb").select("pa", "pb"), "nms-pairs")
    state, kept = order.select("proposal_id", "rank"), None
    for _ in range(max_rounds):
        blocked = over.select(F.col("pb").alias("proposal_id")).distinct()
        free = cut(state.join(blocked, "proposal_id", "left_anti"), "nms-kept")
        kept = free if kept is None else kept.unionByName(free)
        gone = over.join(free.select(F.col("proposal_id").alias("pa")), "pa").select(F.col("pb").alias("proposal_id")).distinct()
        done = gone.union(free.select("proposal_id"))
        state = cut(state.join(done, "proposal_id", "left_anti"), "nms-state")
        if state.isEmpty():
            return kept
        old = over
        over = cut(over.join(state.select(F.col("proposal_id").alias("pa")), "pa", "left_semi").join(state.select(F.col("proposal_id").alias("pb")), "pb", "left_semi"), "nms-pairs")
        release(old)
    raise RuntimeError("suppression did not settle")


def nms(props: DataFrame, order: DataFrame, th: float = 1.0) -> DataFrame:
    """``id, label``: each node's first surviving proposal; labels are ranks."""
    rows = props.join(suppressed(props, order, th), "proposal_id")
    return rows.groupBy(F.col("node").alias("id")).agg(F.min("rank").cast("long").alias("label"))


def split_outliers(props: DataFrame, probs: DataFrame, th: float) -> DataFrame:
    """``proposal_id, node, outlier``: nodes with ``prob > th`` stay; the others form a second cluster."""
    return props.join(probs.select("proposal_id", "node", "prob"), ["proposal_id", "node"]).select("proposal_id", "node", (F.col("prob") <= th).alias("outlier"))


def deoverlap(props: DataFrame, scores: DataFrame, *, th_pos: float = -1.0, th_iou: float = 1.0, probs: DataFrame | None = None, th_outlier: float = 0.5) -> DataFrame:
    """``id, label``: proposals with ``score >= th_pos`` by descending score (ties by id), overlaps resolved, densely labelled.

    With ``probs`` each proposal loses its outliers; the clusters of outliers come after all others.
    """
    good = scores.where(F.col("score") >= th_pos)
    ranked = numbered(good.select("proposal_id", "score"), F.desc("score"), "proposal_id", into="rank").select("proposal_id", "rank")
    live = props.join(good.select("proposal_id"), "proposal_id", "left_semi")
    if probs is not None:
        parts = split_outliers(live, probs, th_outlier)
        most = ranked.agg(F.coalesce(F.max("rank") + 1, F.lit(0)).alias("_m"))
        both = parts.select("proposal_id", "outlier").distinct().join(ranked, "proposal_id").crossJoin(most)
        twice = lambda: (2 * F.col("proposal_id") + F.col("outlier").cast("long")).alias("proposal_id")
        ranked = both.select(twice(), (F.col("rank") + F.when(F.col("outlier"), F.col("_m")).otherwise(0)).alias("rank"))
        live = parts.select(twice(), "node")
    return dense_labels(nms(live, ranked, th_iou))


def upper_bound(props: DataFrame, labels: DataFrame, th_pos: float = 0.0, th_iou: float = 1.0) -> DataFrame:
    """De-overlap by the true IoU of proposals above ``th_pos``."""
    a = analyze(props, labels).where(F.col("iou") > th_pos)
    return deoverlap(props, a.select("proposal_id", F.col("iou").alias("score")), th_iou=th_iou)


def basic_proposals(feats: DataFrame, *, k: int, th: float, step: float, max_size: int, min_size: int = 1, knn: DataFrame | None = None) -> DataFrame:
    """``proposal_id, node`` of super vertices with at least ``min_size`` nodes; a proposal is named by its smallest node."""
    knn = knn_exact(feats, k) if knn is None else knn
    labels = super_vertices(knn, k, th, step, max_size)
    return size_filter(labels.select(F.col("label").alias("proposal_id"), F.col("id").alias("node")), min_size)


def iterate_proposals(feats: DataFrame, base: DataFrame, *, k: int, th: float, step: float, sv_min: int = 2, sv_max: int = 8, min_size: int = 3, max_size: int = 500, renormalize: bool = False) -> DataFrame:
    """Proposals of proposals: mean vectors of the groups in ``base`` are clustered, groups of ``sv_min`` or more expand to their nodes."""
    base = cut(base, "prop-base")
    members = base.select(F.col("proposal_id").alias("group"), F.col("node").alias("id"))
    centres = cut(group_mean(feats, members, "group", renormalize).withColumnRenamed("group", "id"), "prop-centres")
    labels = super_vertices(knn_exact(centres, k), k, th, step, sv_max)
    groups = size_filter(labels.select(F.col("label").alias("proposal_id"), F.col("id").alias("node")), sv_min)
    nodes = groups.select("proposal_id", F.col("node").alias("group")).join(members, "group").select("proposal_id", F.col("id").alias("node"))
    return size_filter(nodes, min_size, max_size)


def generate_proposals(feats: DataFrame, params: list[dict]) -> DataFrame:
    """``proposal_set, proposal_id, node`` of several settings; ``iterations`` in a setting adds rounds, ``iter0=False`` leaves the first round out.

    Settings without neighbours of their own share one search, with the largest ``k``.
    """
    asked = [p["k"] for p in params if p.get("knn") is None]
    near = cut(knn_exact(feats, max(asked)), "prop-knn") if asked else None
    out = None
    for p in params:
        p = dict(p)
        if p.get("knn") is None:
            p["knn"] = near
        more, first = p.pop("iterations", []), p.pop("iter0", True)
        level = basic_proposals(feats, **p)
        name = f"k{p['k']}_th{p['th']}_step{p['step']}_max{p['max_size']}_iter"
        levels = [(f"{name}0", level)] if first else []
        for i, q in enumerate(more, 1):
            level = iterate_proposals(feats, level, **q)
            levels.append((f"{name}{i}", level))
        for n, df in levels:
            part = df.select(F.lit(n).alias("proposal_set"), "proposal_id", "node")
            out = part if out is None else out.unionByName(part)
    return out
