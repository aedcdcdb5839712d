"""Hand-made cases, and all queries' SQL on the smallest input."""

import inspect
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, tidy
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clusterloom.functions import scratch
from clusterloom.functions.numbering import numbered
from clusterloom.operators import baselines, components, confidence, gnn, graph, knn, metrics, proposals, training, vectors
from clusterloom.operators.components import connected_components, roots
from clusterloom.plans.queries import ORACLES, QUERIES
from clusterloom.sources import io

PAIRS = "u long, v long, score double"


def clusters(df, key="label", item="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[item])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_two_triangles_split_at_a_higher_threshold(spark):
    rows = [(a, b, 0.9) for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5))] + [(2, 3, 0.5)]
    got = graph.dynamic_threshold_clusters(spark.createDataFrame(rows, PAIRS), 3, 0.05)
    assert clusters(got) == [[0, 1, 2], [3, 4, 5]]


def test_last_level_merges_what_is_left(spark):
    rows = [(a, b, 1.0) for a in range(5) for b in range(a + 1, 5)]
    got = graph.dynamic_threshold_clusters(spark.createDataFrame(rows, PAIRS), 3, 0.05, max_iter=2)
    assert clusters(got) == [[0, 1, 2, 3, 4]]


def test_pruned_nodes_are_single(spark):
    got = graph.dynamic_threshold_clusters(spark.createDataFrame([(0, 1, 0.2), (1, 2, 0.4), (2, 3, 0.6)], PAIRS), 1, 0.3)
    assert clusters(got) == [[0], [1], [2], [3]]


def test_pooling(spark):
    p = spark.createDataFrame([(0, 1, 0.2, 1), (1, 0, 0.8, 2)], PAIRS + ", seq int")
    assert [graph.pool_pairs(p, x).first()["score"] for x in ("avg", "max", None)] == [0.5, 0.8, 0.8]


def test_empty_graph(spark):
    assert graph.dynamic_threshold_clusters(spark.createDataFrame([], PAIRS), 3, 0.05).count() == 0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_components_of_scattered_edges(spark, monkeypatch, coalesce):
    """Stars of one task and of several, hubs, chains, loops, nulls, repeated edges."""
    monkeypatch.setattr(components, "_HELD", 50)
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] * 2 + [(7, None), (5000, 5000)]
    df = spark.createDataFrame(rows, "src long, dst long").repartition(9)
    nodes = spark.createDataFrame([(1,), (9000,), (None,)], "id long")
    label = {x: x for r in rows if None not in r for x in r} | {1: 1, 9000: 9000}
    moved = True
    while moved:
        moved = False
        for a, b in rows:
            if b is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = connected_components(df, nodes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dict(map(tuple, got)) == label and len(got) == len(label)
    assert connected_components(df.limit(0)).count() == 0


def test_shared_folder_is_required_off_one_machine(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_fresh_labels_for_missing_ids(spark):
    got = proposals.fill_labels(spark.createDataFrame([(0, 7), (1, 7), (2, 3), (3, 3)], "id long, label long"), 6)
    assert dict(map(tuple, got.collect())) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


@pytest.mark.parametrize("name", ["k2_knn_lsh", "k4_knn_ivf", "k4_knn_ivf_pq", "k5_approximate_reranked"])
def test_recall_of_approximate_search(spark, name):
    data = DATA.replace("sf0.001", "sf0.1")
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x, ids = np.array(e["embedding"].tolist(), np.float64), e["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    want = {(ids[i], ids[j]) for i, row in enumerate(np.argsort(-sim, axis=1)[:, :10]) for j in row}
    got = {(r["id"], r["nbr"]) for r in QUERIES[name](spark, data).select("id", "nbr").collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_first_direction_counts(spark):
    k = spark.createDataFrame([(1, 2, 1, 0.1), (3, 4, 1, 0.2), (4, 3, 1, 0.3)], "id long, nbr long, rank int, dist double")
    assert sorted((r["u"], r["v"], round(r["score"], 6)) for r in knn.undirected_pairs(k, 0.5).collect()) == [(1, 2, 0.9), (3, 4, 0.8)]


def test_greedy_suppression_follows_rank(spark):
    sets = {0: range(0, 6), 1: range(2, 8), 2: range(4, 10)}  # neighbours overlap by 4 of 8
    props = spark.createDataFrame([(p, n) for p, s in sets.items() for n in s], "proposal_id long, node long")
    order = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "proposal_id long, rank long")
    kept = {r["proposal_id"] for r in proposals.suppressed(props, order, 0.4).collect()}
    assert kept == {0, 2}
    got = dict(map(tuple, proposals.nms(props, order, 0.4).collect()))
    assert got[5] == 0 and got[6] == 2


def test_suppression_against_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    sets = [set(rng.integers(0, 30, 8).tolist()) for _ in range(25)]
    kept = []
    for i, s in enumerate(sets):
        if all(len(s & sets[j]) / len(s | sets[j]) <= 0.3 for j in kept):
            kept.append(i)
    props = spark.createDataFrame([(i, n) for i, s in enumerate(sets) for n in s], "proposal_id long, node long")
    order = spark.createDataFrame([(i, i) for i in range(25)], "proposal_id long, rank long")
    assert sorted(r["proposal_id"] for r in proposals.suppressed(props, order, 0.3).collect()) == kept


def test_majority_ties_go_to_the_smallest_label(spark):
    props = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 3)], "proposal_id long, node long")
    labels = spark.createDataFrame([(0, 5), (1, 5), (2, 2), (3, 2)], "id long, label long")
    assert proposals.majority(props, labels).first()["label"] == 2


def test_metrics_of_equal_and_of_single_clusters(spark):
    gt = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, label long")
    for m in ("pairwise", "bcubed"):
        assert tuple(metrics.evaluate(gt, gt, m).first()) == (1.0, 1.0, 1.0)
    assert abs(metrics.evaluate(gt, gt, "nmi").first()[0] - 1) < 1e-12
    assert metrics.pairwise(gt, gt.selectExpr("id", "id as label")).first()["precision"] is None
    with pytest.raises(KeyError):
        metrics.evaluate(gt, gt, "none")


def test_equal_confidence_is_no_peak(spark):
    k = spark.createDataFrame([(0, 1, 1, 0.1), (0, 2, 2, 0.2)], "id long, nbr long, rank int, dist double")
    c = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "id long, conf double")
    assert [r["dst"] for r in confidence.peaks(k, c).collect()] == [2]


def test_zero_rows_and_lonely_nodes(spark):
    f = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, embedding array<double>")
    assert dict(map(tuple, vectors.l2_normalize(f).collect())) == {0: [0.0, 0.0], 1: [0.6, 0.8]}
    assert knn.knn_exact(f, 10).count() == 2
    assert graph.row_normalize(spark.createDataFrame([(0, 1, 0.0)], "src long, dst long, w double")).first()["w"] == 0.0


def test_noise_and_borders(spark):
    t = np.array([0, 0.05, 0.1, 0.16, 1.5])
    f = spark.createDataFrame([(i, [float(np.cos(x)), float(np.sin(x))]) for i, x in enumerate(t)], "id long, embedding array<double>")
    assert clusters(baselines.dbscan(f, 0.07, 3)) == [[0, 1, 2, 3], [4]]
    assert clusters(baselines.mean_shift(f, 0.3)) == [[0, 1, 2, 3], [4]]
    with pytest.raises(KeyError):
        baselines.cluster("none", f)


def blobs(spark, n=12, lonely=True):
    """Four tight groups of ``n`` mixed by id, and a far point."""
    rng = np.random.default_rng(3)
    centres = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    x = np.concatenate([centres[np.arange(4 * n) % 4] + rng.normal(0, 0.02, (4 * n, 4)), [[-1, -1, -1, -1.0]] if lonely else np.zeros((0, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    return f, [list(range(k, 4 * n, 4)) for k in range(4)] + ([[4 * n]] if lonely else [])


def test_tight_groups_come_apart(spark):
    f, want = blobs(spark)
    assert clusters(baselines.hdbscan(f, 3, 5, 10, 8)) == sorted(want)
    assert clusters(baselines.mean_shift(f, 0.4)) == sorted(want)
    assert clusters(baselines.dbscan(f, 0.3, 3)) == sorted(want)
    near = knn.filter_by_similarity(knn.knn_exact(f, 5), 0.5)
    got = clusters(baselines.spectral(near, 4, nodes=f))
    assert [48] in got and sum(map(len, got)) == 49 and all(len({i % 4 for i in g}) == 1 for g in got if len(g) < 13)
    f, want = blobs(spark, lonely=False)
    assert clusters(baselines.kmeans(f, 4)) == sorted(want)
    assert clusters(baselines.hierarchy(f.where("id % 4 < 2"), 2)) == sorted(want)[:2]


def test_nested_densities(spark):
    """Two dense groups within a looser one, and a third far away: the dense ones are chosen, not what holds them."""
    rng = np.random.default_rng(1)
    angle = np.concatenate([rng.normal(0.0, 0.004, 15), rng.normal(0.12, 0.004, 15), rng.normal(1.5, 0.004, 15)])
    f = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angle)], "id long, embedding array<double>")
    got = clusters(baselines.hdbscan(f, 3, 5, 20, 12))
    assert [g for g in got if len(g) > 1] == [list(range(15)), list(range(15, 30)), list(range(30, 45))]


def test_mini_batches_follow_the_rule(spark):
    """Centres against the same rule in arrays: rows of each round move their centre by their share of all it has met."""
    f, _ = blobs(spark, lonely=False)
    rows = {r["id"]: np.array(r["embedding"]) for r in f.collect()}
    h = {r["id"]: r for r in f.selectExpr("id", "xxhash64(id, 4) AS first", *[f"pmod(xxhash64(id, 4, {i}), 1073741824) AS d{i}" for i in range(3)]).collect()}
    centres = np.array([rows[i] for i in sorted(rows, key=lambda i: (h[i]["first"], i))[:5]])
    met = np.zeros(5)
    near = lambda x: int(np.argmax(centres @ x - (centres**2).sum(1) / 2))
    for i in range(3):
        part = [(near(x), x) for k, x in rows.items() if h[k][f"d{i}"] < int(0.5 * 2**30)]
        for c in range(5):
            own = [x for k, x in part if k == c]
            if own:
                met[c] += len(own)
                centres[c] += (np.sum(own, 0) - len(own) * centres[c]) / met[c]
    got = dict(map(tuple, baselines.mini_batch_kmeans(f, 5, 0.5, 3, seed=4).collect()))
    assert got == {i: near(x) for i, x in rows.items()}


def test_whispers_and_settling(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a != b] + [(4, 5, 0.1), (5, 4, 0.1)], "src long, dst long, w double")
    nodes = spark.range(11)
    assert clusters(baselines.chinese_whispers(edges, nodes, 12)) == [list(range(5)), list(range(5, 10)), [10]]
    with pytest.raises(RuntimeError):
        baselines.mean_shift(blobs(spark)[0], 0.4, max_rounds=1, tolerance=1e-12)


def test_sums_of_vectors(spark):
    """Keys over many batches, two keys, one key on most rows."""
    rng = np.random.default_rng(2)
    k = np.where(rng.random(3000) < 0.6, 7, rng.integers(0, 40, 3000))
    x, w = rng.normal(size=(3000, 3)), rng.random(3000)
    df = spark.createDataFrame([(int(a), int(a) % 3, v.tolist(), float(b)) for a, v, b in zip(k, x, w, strict=True)], "a long, b long, embedding array<double>, w double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r["a"], r["b"]): r["embedding"] for r in vectors.weighted_sum(df, ["a", "b"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(k))
    for (a, _), v in got.items():
        assert np.allclose(v, (w[k == a, None] * x[k == a]).sum(0))
    assert vectors.weighted_sum(df.limit(0), "a").count() == 0


def test_row_numbers(spark):
    rng = np.random.default_rng(3)
    values = [(int(i), float(v)) for i, v in enumerate(rng.integers(0, 9, 500))]
    df = spark.createDataFrame(values, "id long, v double").repartition(7)
    got = {r["id"]: r["number"] for r in numbered(df, F.desc("v"), "id").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(values, key=lambda t: (-t[1], t[0])))}
    assert numbered(df.limit(0), "id").count() == 0


def test_pairs_of_blocks(spark):
    """Close pairs within a table and between two, by any dealing into blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    f = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    want = sorted((i, j) for i in range(90) for j in range(i + 1, 90) if x[i] @ x[j] >= 2)
    for block in (None, 20, 1000):
        assert sorted((r["u"], r["v"]) for r in knn.similar_pairs(f, 2.0, block).collect()) == want
    got = sorted((r["id"], r["nbr"]) for r in knn.close_pairs(f.where("id < 30"), f.where("id >= 30"), 2.0, 25).collect())
    assert got == [(i, j) for i in range(30) for j in range(30, 90) if x[i] @ x[j] >= 2]


def numeric(f, p, name, at, eps=1e-6):
    q = {k: v.copy() for k, v in p.items()}
    q[name].flat[at] += eps
    up = f(q)
    q[name].flat[at] -= 2 * eps
    return (up - f(q)) / (2 * eps)


@pytest.mark.parametrize("kind", ["detection", "segmentation", "link"])
def test_gradients(kind):
    rng = np.random.default_rng(5)
    x, a = rng.normal(size=(6, 3)), gnn.normalized(np.triu(rng.random((6, 6)) < 0.5).astype(float) + np.eye(6))
    if kind == "link":
        shapes, f = gnn.edge_shapes(3, (5, 4)) | {"in_mean": (3,), "in_var": (3,)}, training.link_gradients
    else:
        shapes, f = gnn.gcn_shapes(3, (5, 4), 1 if kind == "detection" else 2), training.detection_gradients if kind == "detection" else training.segmentation_gradients
    p = {k: v + 0.01 * rng.normal(size=v.shape) if not k.startswith("in_") else v for k, v in gnn.formula_weights(shapes).items()}
    y, m = rng.integers(0, 2, 6).astype(float), np.array([1, 0, 1, 1, 0, 1.0])
    _, g, n = f(x, a, y, m, p)
    assert n == {"detection": 1, "segmentation": 6, "link": 4}[kind]
    for name, value in g.items():
        for at in range(0, value.size, max(1, value.size // 5)):
            assert abs(numeric(lambda q: f(x, a, y, m, q)[0], p, name, at) - value.flat[at]) < 1e-5, name


def test_all_models_learn(spark):
    f, want = blobs(spark)
    labels = spark.createDataFrame([(i, k) for k, g in enumerate(want) for i in g], "id long, label long")
    near = knn.knn_exact(f, 6).cache()
    props = spark.createDataFrame([(p, n) for p in range(8) for n in range(p * 6, p * 6 + 6)], "proposal_id long, node long")
    w = gnn.formula_weights
    ask = near.select("id", "nbr", "dist")
    runs = [
        training.train_detection(f, props, near, labels, w(gnn.gcn_shapes(4, (6,))), steps=6, rate=0.2),
        training.train_segmentation(f, props, near, labels, w(gnn.gcn_shapes(5, (6,), 2)), steps=6, rate=0.2),
        training.train_edges(f, gnn.vertex_graph(near, f, -9.0), ask, labels, w(gnn.edge_shapes(4, (6,))), steps=6, rate=0.2),
        training.train_linkage(f, gnn.ego_networks(near, 5, 3, 3), labels, w(gnn.edge_shapes(4, (6,))), steps=6, rate=0.2),
    ]
    for p, losses in runs:
        assert losses[-1] < losses[0] and all(np.isfinite(v).all() for v in p.values())
    assert {"in_mean", "in_var"} <= set(runs[-1][0])


def test_seed_is_an_input(spark):
    nodes = spark.createDataFrame([(1, i, [0.5]) for i in range(4)], "proposal_id long, id long, embedding array<double>")
    edges = spark.createDataFrame([(1, 2, 0, 1.0), (1, 2, 1, 1.0), (1, 2, 3, 1.0)], "proposal_id long, u long, v long, w double")
    assert {r["id"]: r["embedding"] for r in gnn.with_seed(nodes, edges).collect()} == {0: [0.5, 0.0], 1: [0.5, 0.0], 2: [0.5, 1.0], 3: [0.5, 0.0]}


def test_pools_of_the_proposal_model(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 3.0])], "proposal_id long, id long, embedding array<double>")
    edges = spark.createDataFrame([(1, 0, 1, 1.0)], "proposal_id long, u long, v long, w double")
    fc = {"fc": np.array([[1.0], [1.0]]), "fc_bias": np.zeros(1)}
    mixed = np.array([[0.5, 1.5], [0.5, 1.5]])  # one propagation over two nodes with self-loops
    for pool, want in (("mean", mixed.mean(0)), ("sum", mixed.sum(0)), ("max", mixed.max(0))):
        assert abs(gnn.sgc_scores(nodes, edges, fc, pool=pool).first()["score"] - want.sum()) < 1e-12
        eye = {"gc0": np.eye(2), "gc0_bias": np.zeros(2)} | fc
        assert abs(gnn.gcn_scores(nodes, edges, eye, pool=pool).first()["score"] - want.sum()) < 1e-12


def test_vertex_training_lowers_the_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    f = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    adj = gnn.vertex_graph(knn.knn_exact(f, 4), f, -9.0)
    goal = spark.createDataFrame([(i, float(r[0])) for i, r in enumerate(x)], "id long, conf double")
    _, losses = training.train_vertex_model(f, adj, goal, gnn.formula_weights(gnn.vertex_shapes(4, 8)), steps=8, rate=0.05)
    assert losses[-1] < losses[0]


def test_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    x.tofile(tmp_path / "f.bin")
    got = dict(map(tuple, io.read_features_bin(spark, str(tmp_path / "f.bin"), 3).collect()))
    assert got[3] == [9.0, 10.0, 11.0] and len(got) == 4
    (tmp_path / "l.meta").write_text("5\n5\n2\n5\n")
    labels = io.read_labels(spark, str(tmp_path / "l.meta"))
    io.write_labels(labels, str(tmp_path / "out"), 5)
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().split()]
    assert lines == ["0", "0", "1", "0", "2"]
    assert {r["id"]: r["embedding"] for r in io.read_features_bin(spark, str(tmp_path / "f.bin"), 3, rows_a_read=2).collect()} == dict(got)
    with pytest.raises(ValueError):
        io.read_features_bin(spark, str(tmp_path / "f.bin"), 5)
    (tmp_path / "p.meta").write_text("1\n2\n2\n1\n")
    assert metrics.evaluate_files(spark, str(tmp_path / "l.meta"), str(tmp_path / "l.meta")).first()["f"] == 1.0
    assert metrics.evaluate_files(spark, str(tmp_path / "l.meta"), str(tmp_path / "p.meta")).first()["recall"] == 1 / 3
    (tmp_path / "q.meta").write_text("1\n")
    with pytest.raises(ValueError):
        metrics.evaluate_files(spark, str(tmp_path / "l.meta"), str(tmp_path / "q.meta"))
    assert io.Dataset.from_files(spark, str(tmp_path / "f.bin"), 3, str(tmp_path / "l.meta")).info().first()[:] == (4, 3, 2)


def test_proposals_of_any_size_in_the_model(spark):
    """Scores and node probabilities by joins against dense arrays; no proposal is held by one task."""
    rng = np.random.default_rng(6)
    nodes = [(p, p * 100 + i, rng.normal(size=3).tolist()) for p, n in ((1, 7), (2, 1), (3, 40)) for i in range(n)]
    edges = sorted({(p, *sorted(rng.choice([i for q, i, _ in nodes if q == p], 2, replace=False).tolist())) for p in (1, 3) for _ in range(30)})
    edges = [(*e, float(rng.random())) for e in edges]
    n_df = spark.createDataFrame(nodes, "proposal_id long, id long, embedding array<double>")
    e_df = spark.createDataFrame(edges, "proposal_id long, u long, v long, w double")
    one, two = gnn.formula_weights(gnn.gcn_shapes(3, (5, 4))), gnn.formula_weights(gnn.gcn_shapes(3, (5, 4), 2))
    plan = gnn.gcn_scores(n_df, e_df, one)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan
    got = {pool: {r["proposal_id"]: r["score"] for r in gnn.gcn_scores(n_df, e_df, one, pool=pool).collect()} for pool in ("mean", "sum", "max")}
    prob = {r["node"]: r["prob"] for r in gnn.gcn_scores(n_df, e_df, two, pool="none").collect()}
    for p in (1, 2, 3):
        ids = [i for q, i, _ in nodes if q == p]
        x, a = np.array([v for q, _, v in nodes if q == p]), np.eye(len(ids))
        for q, u, v, w in edges:
            if q == p:
                a[ids.index(u), ids.index(v)] = a[ids.index(v), ids.index(u)] = w
        h, k = training._gcn_back(x, gnn.normalized(a), one)[0], training._gcn_back(x, gnn.normalized(a), two)[0]
        for pool, y in (("mean", h.mean(0)), ("sum", h.sum(0)), ("max", h.max(0))):
            assert abs(got[pool][p] - (y @ one["fc"])[0]) < 1e-9
        assert np.allclose([prob[i] for i in ids], gnn._softmax(k @ two["fc"] + two["fc_bias"])[:, 1])


@pytest.mark.parametrize("kind", ["detection", "segmentation"])
def test_training_by_joins(spark, kind):
    """Losses and weights against the gradients of one proposal after another."""
    rng = np.random.default_rng(7)
    ids = {p: [p * 100 + i for i in range(n)] for p, n in ((1, 5), (2, 1), (3, 12))}
    links = [(p, u, v, float(rng.random())) for p, m in ids.items() for u in m for v in m if u < v and rng.random() < 0.5]
    y = {i: float(rng.integers(0, 2)) if kind == "segmentation" else p / 4 for p, m in ids.items() for i in m}
    x = {i: rng.normal(size=3) for i in y}
    nodes = spark.createDataFrame([(p, i, x[i].tolist(), y[i]) for p, m in ids.items() for i in m], "proposal_id long, id long, embedding array<double>, y double")
    edges = spark.createDataFrame(links, "proposal_id long, u long, v long, w double")
    w = {k: v + 0.01 * rng.normal(size=v.shape) for k, v in gnn.formula_weights(gnn.gcn_shapes(3, (5, 4), 2 if kind == "segmentation" else 1)).items()}
    graphs = []
    for p, m in ids.items():
        a = np.eye(len(m))
        for q, u, v, s in links:
            if q == p:
                a[m.index(u), m.index(v)] = a[m.index(v), m.index(u)] = s
        graphs.append((np.concatenate([x[i] for i in m]).tolist(), gnn.normalized(a).ravel().tolist(), [y[i] for i in m], [1.0] * len(m)))
    array = "array<double>"
    f = training.detection_gradients if kind == "detection" else training.segmentation_gradients
    want = training.train_on_graphs(spark.createDataFrame(graphs, f"x {array}, a {array}, y {array}, m {array}"), f, w, steps=3)
    got = training.train_convolutions(nodes, edges, w, per_node=kind == "segmentation", steps=3)
    assert np.allclose(got[1], want[1]) and all(np.allclose(got[0][k], want[0][k]) for k in w)


def dynamic_by_hand(pairs, max_size, step, max_iter):
    """The rule level by level."""
    th, out, level = min(s for *_, s in pairs), {}, 0
    use, rest = None, pairs
    while rest:
        root = {i: i for u, v, _ in rest for i in (u, v)}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v, s in rest:
            if use is None or s >= use:
                a, b = sorted((top(u), top(v)))
                root[b] = a
        size = Counter(map(top, root))
        big = [i for i in root if size[top(i)] > max_size]
        out |= {i: top(i) for i in root if size[top(i)] <= max_size}
        if level >= max_iter:
            return out | {i: min(big) for i in big}
        rest = [(u, v, s) for u, v, s in rest if top(u) == top(v) and size[top(u)] > max_size]
        th = use = th + (1 - th) * step
        level += 1
    return out


@pytest.mark.parametrize("whole", [0, 40, 1 << 18])
def test_levels_in_one_task(spark, monkeypatch, whole):
    """Components finished in one task, in several rounds, or both, against the rule; copies (score 1) stay together to the last level."""
    monkeypatch.setattr(graph, "_WHOLE_EDGES", whole)
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(rng.choice(60, 2, replace=False).tolist())) for _ in range(70)} | {(a, b) for a in range(100, 112) for b in range(a + 1, 112)}
    pairs = [(int(u), int(v), 1.0 if u >= 100 else float(rng.random())) for u, v in sorted(pairs)]
    got = dict(map(tuple, graph.dynamic_threshold_clusters(spark.createDataFrame(pairs, PAIRS), 4, 0.2, max_iter=6).collect()))
    assert got == dynamic_by_hand(pairs, 4, 0.2, 6)


@pytest.mark.parametrize("block", [None, 30])
def test_projection_search_is_exact_within_its_buckets(spark, monkeypatch, block):
    """Rows that share a bucket and are near enough against brute force, in small groups too."""
    if block:
        monkeypatch.setattr(knn, "Q_BLOCK", block)
        monkeypatch.setattr(knn, "R_BLOCK", block)
    x = np.random.default_rng(9).normal(size=(120, 4))
    x[100:] = x[0]  # copies
    f = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    along = np.random.default_rng(3).normal(size=(4, 3))
    codes = np.floor(x @ (along / np.linalg.norm(along, axis=0)) / 0.5)
    want = []
    for i in range(120):
        ok = [j for j in range(120) if j != i and (codes[i] == codes[j]).any() and np.linalg.norm(x[i] - x[j]) < 2.0]
        want += [(i, j, r) for r, j in enumerate(sorted(ok, key=lambda j: (-round(x[i] @ x[j], 9), j))[:5], 1)]
    got = knn.knn_lsh(f, 5, max_dist=2.0, tables=3, bucket=0.5, seed=3).collect()
    assert sorted((r["id"], r["nbr"], r["rank"]) for r in got) == sorted(want)
    assert "approxSimilarityJoin" not in inspect.getsource(knn.knn_lsh)


def test_shifted_sets_are_summed_in_blocks(spark):
    """Dense neighbourhoods against the rule in arrays; rounds hand on no pairs."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(80, 3)) * 0.5, rng.normal(size=(40, 3)) * 0.3 + 4, [[9.0, 9.0, 9.0]]])
    f = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    assert "close_pairs" not in inspect.getsource(baselines.mean_shift)
    at, open_ = x.copy(), np.ones(len(x), bool)
    while open_.any():
        near = (np.linalg.norm(at[open_, None] - x[None], axis=2) <= 2.0).astype(float)
        new = near @ x / near.sum(1, keepdims=True)
        rests = np.linalg.norm(new - at[open_], axis=1) < 2e-3
        at[open_] = new
        open_[np.flatnonzero(open_)[rests]] = False
    i, j = np.nonzero(np.linalg.norm(at[:, None] - at[None], axis=2) <= 1.0)
    root = roots(len(x), i, j)
    assert dict(map(tuple, baselines.mean_shift(f, 2.0).collect())) == dict(enumerate(root.tolist()))
    assert baselines.mean_shift(f.limit(0), 1.0).count() == 0


def test_copies_take_few_steps(spark, monkeypatch):
    """Twelve copies stay together through all hundred levels, but not through hundreds of tables."""
    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": tables.append(name) or scratch.cut(df, name))
    pairs = spark.createDataFrame([(a, b, 0.2 if a == 0 else 1.0) for a in range(12) for b in range(a + 1, 12)], PAIRS)
    assert clusters(graph.dynamic_threshold_clusters(pairs, 4, 0.05)) == [[0], list(range(1, 12))]
    assert len(tables) < 10


def test_settings_share_one_search(spark, monkeypatch):
    """Two sets of proposals search the vectors once and write few tables, with the rows of a search for each."""
    x = np.random.default_rng(11).normal(size=(150, 6))
    f = spark.createDataFrame([(i, (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    first, second, more = {"k": 6, "th": 0.3, "step": 0.05, "max_size": 20, "min_size": 3}, {"k": 3, "th": 0.5, "step": 0.05, "max_size": 8}, {"k": 4, "th": 0.2, "step": 0.05}
    base = proposals.basic_proposals(f, **second)
    want = {("k6_th0.3_step0.05_max20_iter0", *r) for r in proposals.basic_proposals(f, **first).collect()} | {("k3_th0.5_step0.05_max8_iter1", *r) for r in proposals.iterate_proposals(f, base, **more).collect()}
    searched, tables = [], []
    search, keep = proposals.knn_exact, lambda df, name="cut": tables.append(name) or scratch.cut(df, name)
    monkeypatch.setattr(proposals, "knn_exact", lambda feats, k: searched.append(k) or search(feats, k))
    for m in (graph, proposals, components):
        monkeypatch.setattr(m, "cut", keep)
    got = proposals.generate_proposals(f, [first, {**second, "iter0": False, "iterations": [more]}])
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want and len({r[0] for r in rows}) == 2
    assert searched == [6, 4] and len(tables) < 12


def test_large_tables_keep_the_edges_that_thresholds_need(spark, monkeypatch):
    """Thinned edges connect, at every threshold, what all do; equal, null and NaN scores among them. A table of many edges takes one task then, and few tables."""
    rng = np.random.default_rng(12)
    scores = [None, float("nan"), 0.25, 0.5, 0.75, 1.0]
    edges = [(int(a), int(b), scores[rng.integers(len(scores))]) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.7]
    monkeypatch.setattr(graph, "_WHOLE_EDGES", 60)
    monkeypatch.setattr(graph, "_HELD", 100)
    rest, n = graph._thinned(spark.createDataFrame(edges, PAIRS).repartition(3), len(edges))
    thin = [tuple(r) for r in rest.collect()]
    known = {(u, v): repr(s) for u, v, s in edges}
    assert n == len(thin) <= 60 < len(edges) and all(known[u, v] == repr(s) for u, v, s in thin)
    for th in (None, 0.25, 0.5, 0.75, 1.0):
        live = lambda s: th is None or s is not None and (s != s or s >= th)  # noqa: B023, E731
        whole, few = (roots(40, *(np.array([e[i] for e in t if live(e[2])], int) for i in (0, 1))) for t in (edges, thin))
        assert whole.tolist() == few.tolist()
    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": tables.append(name) or scratch.cut(df, name))
    pairs = [(u, v, float(rng.random())) for u, v, _ in edges]
    got = dict(map(tuple, graph.dynamic_threshold_clusters(spark.createDataFrame(pairs, PAIRS), 4, 0.05).collect()))
    assert got == dynamic_by_hand(pairs, 4, 0.05, 100)
    assert tables.count("dyn-done") == 1 and "dyn-level" not in tables
