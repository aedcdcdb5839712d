"""The clustering pipelines from vectors to labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.scratch import cut
from clusterloom.operators import confidence, gnn, graph, knn, proposals


def detection(feats: DataFrame, weights: dict, *, k=10, th=0.3, step=0.05, max_size=50, min_size=2, th_pos=-1e9, th_iou=0.9, pool="mean", neighbours: DataFrame | None = None) -> DataFrame:
    """``id, label``: proposals, scores of the proposal model, de-overlap; ids outside all proposals are absent."""
    near = cut(knn.knn_exact(feats, k) if neighbours is None else neighbours, "det-knn")
    props = cut(proposals.basic_proposals(feats, k=k, th=th, step=step, max_size=max_size, min_size=min_size, knn=near), "det-props")
    scores = gnn.gcn_scores(*gnn.proposal_graphs(feats, props, near), weights, pool=pool)
    return proposals.deoverlap(props, cut(scores, "det-scores"), th_pos=th_pos, th_iou=th_iou)


def segmentation(feats: DataFrame, labels: DataFrame, det_weights: dict, seg_weights: dict, *, k=10, th=0.3, step=0.05, max_size=50, low=0.0, high=1.0, th_outlier=0.5, split=True) -> DataFrame:
    """As :func:`detection`, for proposals whose IoP lies in a range, with outliers split off. The model of the nodes has the seed's mark as one more input."""
    near = cut(knn.knn_exact(feats, k), "seg-knn")
    props = proposals.basic_proposals(feats, k=k, th=th, step=step, max_size=max_size, min_size=2, knn=near)
    props = cut(proposals.iop_range(props, proposals.analyze(props, labels).select("proposal_id", "iop"), low, high), "seg-props")
    nodes, edges = gnn.proposal_graphs(feats, props, near)
    scores = cut(gnn.gcn_scores(nodes, edges, det_weights), "seg-scores")
    probs = cut(gnn.gcn_scores(gnn.with_seed(nodes, edges), edges, seg_weights, pool="none"), "seg-probs") if split else None
    return proposals.deoverlap(props, scores, probs=probs, th_outlier=th_outlier)


def vertex_pipeline(feats: DataFrame, weights: dict, *, k=10, tau0=0.3, tau=None, max_conn=1) -> DataFrame:
    """``id, label``: vertex confidences, peaks, components; with ``tau`` a second round on hidden features with new neighbours."""
    near = cut(knn.knn_exact(feats, k), "gcnv-knn")
    scored = cut(gnn.vertex_confidence(feats, gnn.vertex_graph(near, feats), weights, hidden=tau is not None), "gcnv-conf")
    if tau is None:
        return graph.peaks_to_labels(confidence.peaks(near, scored, max_conn), tau0, feats)
    hidden = scored.select("id", "embedding")
    return graph.peaks_to_labels(confidence.peaks(knn.knn_exact(hidden, k), scored, max_conn), tau, feats)


def edge_pipeline(feats: DataFrame, conf: DataFrame, weights: dict, *, k=10, tau=0.3, ignore_ratio=0.0, max_conn=1, random_seed: int | None = None) -> DataFrame:
    """``id, label``: candidates of higher confidence, edge scores, best links (or random ones), components."""
    near = cut(knn.knn_exact(feats, k), "gcne-knn")
    conf = cut(conf, "gcne-conf")
    skip = confidence.ignore_set(conf, ignore_ratio) if ignore_ratio else None
    ask, direct = gnn.candidate_sets(near, conf, skip)
    scored = gnn.edge_scores(feats, gnn.vertex_graph(near, feats), ask, weights)
    return graph.peaks_to_labels(gnn.select_edges(scored, direct, max_conn, random_seed=random_seed), tau, feats)


def linkage_pipeline(feats: DataFrame, weights: dict, *, k1=10, k2=5, active=5, max_size=50, step=0.6, pool="avg") -> DataFrame:
    """``id, label``: ego networks, link probabilities, dynamic thresholds; ids without a link are single."""
    near = cut(knn.knn_exact(feats, max(k1, k2, active)), "lgcn-knn")
    links = gnn.linkage_scores(feats, *gnn.ego_networks(near, k1, k2, active), weights)
    labels = graph.dynamic_threshold_clusters(cut(links, "lgcn-links"), max_size, step, pool=pool)
    return feats.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
