"""Nearest neighbours by inner product: ``id, nbr, rank, dist`` with ``dist = 1 - sim``.

Exact search deals rows into blocks of bounded size and multiplies block pairs, so memory
is bounded and no vector table is broadcast. Ties go to the smaller neighbour id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.numbering import numbered
from clusterloom.functions.scratch import cut
from clusterloom.operators.components import roots
from clusterloom.operators.vectors import matrix, pair_similarity, weighted_sum

#: Rows of a block at most, on the side of the queries and on the side that is searched.
Q_BLOCK, R_BLOCK = 16_384, 65_536


def _blocks(queries: DataFrame, rows: DataFrame, block: int | None):
    """Both tables dealt into blocks, every pair of blocks a group. Blocks of queries are smaller where fewer pairs would not keep all cores busy."""
    n_rows = rows.count()
    n_queries = n_rows if queries is rows else queries.count()
    nr = max(1, -(-n_rows // (block or R_BLOCK)))
    busy = -(-2 * queries.sparkSession.sparkContext.defaultParallelism // nr)
    nq = max(1, -(-n_queries // block)) if block else max(1, -(-n_queries // Q_BLOCK), min(busy, -(-n_queries // 256)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(deal(nq).alias("qb"), each(nr).alias("rb"), "id", "embedding")
    right = rows.select(each(nq).alias("qb"), deal(nr).alias("rb"), "id", "embedding")
    return left.groupBy("qb", "rb").cogroup(right.toDF(*right.columns).groupBy("qb", "rb"))  # new column ids: both sides may be one table


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "nbr", "rank", (1 - F.col("sim")).alias("dist"))


_NOTHING = {"id": [], "nbr": [], "sim": []}


def _lots(n_queries: int, n_rows: int):
    """Ranges of queries whose similarities to all rows take at most 32 MB."""
    lot = max(1, (1 << 22) // max(n_rows, 1))
    return [(lo, min(n_queries, lo + lot)) for lo in range(0, n_queries, lot)]


def _nearest(q: pd.DataFrame, r: pd.DataFrame, k: int, include_self: bool = False) -> pd.DataFrame:
    """The ``k`` nearest rows of ``r`` for each row of ``q``."""
    if not len(q) or not len(r):
        return pd.DataFrame(_NOTHING)
    return _nearest_of(np.array(q["embedding"].tolist()), q["id"].to_numpy(), np.array(r["embedding"].tolist()), r["id"].to_numpy(), k, include_self)


def _nearest_of(every: np.ndarray, own_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, include_self: bool = False, max_dist: float | None = None) -> pd.DataFrame:
    """As :func:`_nearest`, of arrays; with ``max_dist`` only rows at a smaller Euclidean distance count."""
    out = []
    half, far = ((m * m).sum(1) / 2 for m in (every, x))
    for lo, hi in _lots(len(every), len(x)):
        sim, own = every[lo:hi] @ x.T, own_ids[lo:hi]
        if max_dist is not None:
            sim[sim <= half[lo:hi, None] + (far - max_dist * max_dist / 2)] = -np.inf
        if not include_self:
            sim[own[:, None] == ids[None, :]] = -np.inf
        top = min(k, len(x))
        least = np.partition(sim, len(x) - top, axis=1)[:, len(x) - top]
        a, b = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
        order = np.lexsort((ids[b], -sim[a, b], a))
        a, b = a[order], b[order]
        first = np.searchsorted(a, np.arange(hi - lo))
        keep = np.arange(len(a)) - first[a] < k
        out.append(pd.DataFrame({"id": own[a[keep]], "nbr": ids[b[keep]], "sim": sim[a[keep], b[keep]]}))
    return pd.concat(out)


def knn_exact(feats: DataFrame, k: int, *, queries: DataFrame | None = None, include_self: bool = False, block: int | None = None) -> DataFrame:
    """The min(k, n) largest inner products of every query row."""
    cell = lambda key, q, r: _nearest(q, r, k, include_self)
    return _top(_blocks(feats if queries is None else queries, feats, block).applyInPandas(cell, "id long, nbr long, sim double"), k)


def close_pairs(a: DataFrame, b: DataFrame, min_sim: float, block: int | None = None) -> DataFrame:
    """``id, nbr, sim`` of all rows of ``a`` and ``b`` with ``sim >= min_sim``."""

    def cell(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(_NOTHING)]
        if len(q) and len(r):
            x, ids, every, own = np.array(r["embedding"].tolist()), r["id"].to_numpy(), np.array(q["embedding"].tolist()), q["id"].to_numpy()
            for lo, hi in _lots(len(q), len(r)):
                sim = every[lo:hi] @ x.T
                i, j = np.nonzero(sim >= min_sim)
                out.append(pd.DataFrame({"id": own[lo:hi][i], "nbr": ids[j], "sim": sim[i, j]}))
        return pd.concat(out[1:] or out)

    return _blocks(a, b, block).applyInPandas(cell, "id long, nbr long, sim double")


def near_sums(a: DataFrame, b: DataFrame, min_sim: float, dim: int) -> DataFrame:
    """``id, embedding`` of the rows of ``a``, over all rows of ``b`` with ``sim >= min_sim``: the sum of their first ``dim`` components, their number, and four numbers that tell sets of such rows apart.

    These four are sums of 26 bits of hash of each id, exact up to 2^27 rows. Sums are formed where blocks are multiplied, so no pair leaves its task.
    """

    def cell(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "embedding": []})]
        if len(q) and len(r):
            x, every, own = np.array(r["embedding"].tolist()), np.array(q["embedding"].tolist()), q["id"].to_numpy()
            y = np.hstack([x[:, :dim], np.ones((len(x), 1)), _marks(r["id"].to_numpy())])
            for lo, hi in _lots(len(q), len(r)):
                near = every[lo:hi] @ x.T >= min_sim
                n = near.sum(1)
                any_ = np.flatnonzero(n)
                if n.sum() > 0.02 * near.size:
                    sums = near.astype(float) @ y
                else:
                    sums = np.zeros((hi - lo, y.shape[1]))
                    if len(any_):
                        sums[any_] = np.add.reduceat(y[np.nonzero(near)[1]], (np.cumsum(n) - n)[any_], axis=0)
                out.append(pd.DataFrame({"id": own[lo:hi][any_], "embedding": list(sums[any_])}))
        return pd.concat([f for f in out if len(f)] or out)

    found = _blocks(a, b, None).applyInPandas(cell, "id long, embedding array<double>")
    return weighted_sum(found.withColumn("w", F.lit(1.0)), "id")


def _marks(ids: np.ndarray) -> np.ndarray:
    """Four columns of 26 bits of hash of each id."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        with np.errstate(over="ignore"):
            z = ids.astype(np.int64).view(np.uint64) + np.uint64(seed)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        out += [z >> np.uint64(38), z & np.uint64((1 << 26) - 1)]
    return np.stack(out, 1).astype(float)


def close_links(a: DataFrame, b: DataFrame, min_sim: float) -> DataFrame:
    """``id, nbr``: links that connect what :func:`close_pairs` connects, at most one a row and pair of blocks."""

    def cell(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "nbr": []})
        x, every, ids = np.array(r["embedding"].tolist()), np.array(q["embedding"].tolist()), np.concatenate([q["id"], r["id"]])
        root = np.arange(len(ids))
        for lo, hi in _lots(len(q), len(r)):
            i, j = np.nonzero(every[lo:hi] @ x.T >= min_sim)
            root = roots(len(ids), np.concatenate([np.arange(len(ids)), i + lo]), np.concatenate([root, j + len(q)]))
        tied = root != np.arange(len(ids))
        return pd.DataFrame({"id": ids[tied], "nbr": ids[root[tied]]})

    return _blocks(a, b, None).applyInPandas(cell, "id long, nbr long")


def similar_pairs(feats: DataFrame, min_sim: float, block: int | None = None) -> DataFrame:
    """``u, v, sim`` with u < v of all pairs with ``sim >= min_sim``; each pair of blocks is looked at once."""
    n, cores = feats.count(), feats.sparkSession.sparkContext.defaultParallelism
    nb = max(1, -(-n // block)) if block else max(1, -(-n // Q_BLOCK), min(int((4 * cores) ** 0.5) + 1, -(-n // 256)))
    own, other = F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    dealt = feats.select("id", "embedding", own.alias("own"), other.alias("other"))
    cells = dealt.select(F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), (F.col("own") > F.col("other")).alias("second"), "id", "embedding")

    def cell(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"u": [], "v": [], "sim": []})]
        q, r = (rows, rows) if key[0] == key[1] else (rows[~rows["second"]], rows[rows["second"]])
        if len(q) and len(r):
            x, ids, every, mine = np.array(r["embedding"].tolist()), r["id"].to_numpy(), np.array(q["embedding"].tolist()), q["id"].to_numpy()
            for lo, hi in _lots(len(q), len(r)):
                sim = every[lo:hi] @ x.T
                near = sim >= min_sim
                if key[0] == key[1]:
                    near &= mine[lo:hi, None] < ids[None, :]
                i, j = np.nonzero(near)
                a, b = mine[lo:hi][i], ids[j]
                out.append(pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b), "sim": sim[i, j]}))
        return pd.concat(out[1:] or out)

    return cells.groupBy("s", "t").applyInPandas(cell, "u long, v long, sim double")


def rerank(feats: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Exact distances of candidate ``id, nbr`` pairs, best k of each id."""
    return _top(pair_similarity(feats, candidates.select("id", "nbr").where("id <> nbr").distinct()), k)


def _cells(feats: DataFrame, n_cells: int | None, n_probe: int | None, seed: int, sample: int) -> tuple[DataFrame, np.ndarray]:
    """``id, embedding, cells`` (the nearest cells, nearest first) and the cells' centres."""
    n = feats.count()
    n_cells = n_cells or max(1, min(4096, int(8 * n**0.5), n // 39 or 1))
    n_probe = min(n_probe or 128, n_cells)
    vec = feats.withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=n_cells, seed=seed, maxIter=5, featuresCol="features").fit(vec.sample(min(1.0, sample / max(n, 1)), seed))
    centres = np.stack(model.clusterCenters())  # n_cells <= 4096 vectors
    shared = feats.sparkSession.sparkContext.broadcast(centres)

    def probe(batches):
        c = shared.value
        half = (c * c).sum(1) / 2
        for b in batches:
            if b.num_rows:
                score = matrix(b.column(1)) @ c.T - half
                near = np.argsort(-score, axis=1, kind="stable")[:, :n_probe].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "embedding", "cells"])

    return cut(feats.select("id", "embedding").mapInArrow(probe, "id long, embedding array<double>, cells array<int>"), "ivf-cells"), centres


def _probed(cells: DataFrame, *carried: str):
    """Queries and rows by cell; a cell of more than ``R_BLOCK`` rows is dealt into several groups, each of which its queries visit."""
    sizes = cells.groupBy(F.col("cells")[0].alias("cell")).agg(F.ceil(F.count(F.lit(1)) / R_BLOCK).cast("int").alias("parts"))
    home = cells.select(F.col("cells")[0].alias("cell"), "id", *carried).join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = cells.select("id", "embedding", F.explode("cells").alias("cell")).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = home.select("cell", "part", "id", *carried)
    return asked.select("cell", "part", "id", "embedding").groupBy("cell", "part").cogroup(home.toDF(*home.columns).groupBy("cell", "part"))


def knn_ivf(feats: DataFrame, k: int, *, n_cells: int | None = None, n_probe: int | None = None, seed: int = 0, sample: int = 100_000) -> DataFrame:
    """Inverted-file search: rows in cells of k-means centres, each query looks into its nearest cells and keeps its best k of each, by exact distance."""
    cells, _ = _cells(feats, n_cells, n_probe, seed, sample)
    return _top(_probed(cells, "embedding").applyInPandas(lambda key, q, r: _nearest(q, r, k), "id long, nbr long, sim double"), k)


def train_codebooks(x: np.ndarray, parts: int = 8, codes: int = 256, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Product quantiser [part, code, components] by k-means in each part of the components; the rows are a bounded sample."""
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(x), parts, -1)
    books = x[rng.choice(len(x), codes, replace=len(x) < codes)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(parts):
            near = (x[:, p] @ books[p].T - (books[p] ** 2).sum(1) / 2).argmax(1)
            n = np.bincount(near, minlength=codes)
            total = np.zeros_like(books[p])
            np.add.at(total, near, x[:, p])
            books[p][n > 0] = total[n > 0] / n[n > 0, None]
    return books


def quantise(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Code of each row in each part."""
    x = np.pad(x, ((0, 0), (0, books.shape[0] * books.shape[2] - x.shape[1]))).reshape(len(x), books.shape[0], -1)
    return np.stack([(x[:, p] @ b.T - (b**2).sum(1) / 2).argmax(1) for p, b in enumerate(books)], 1).astype(np.uint8)


def knn_ivf_pq(feats: DataFrame, k: int, *, n_cells: int | None = None, n_probe: int | None = None, parts: int = 8, refine: int = 8, seed: int = 0, sample: int = 20_000) -> DataFrame:
    """Inverted-file search over product-quantised residuals; the best ``refine * k`` of each query by code tables get exact distances.

    Cells hold codes (a byte for each part) in place of vectors, so that is what a search ships.
    """
    cells, centres = _cells(feats, n_cells, n_probe, seed, 5 * sample)
    drawn = cells.select("embedding", F.col("cells")[0].alias("cell")).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).toPandas()
    books = train_codebooks(np.array(drawn["embedding"].tolist()) - centres[drawn["cell"].to_numpy()], parts, seed=seed)
    shared = feats.sparkSession.sparkContext.broadcast((books, centres))

    def code(batches):
        books, centres = shared.value
        for b in batches:
            if b.num_rows:
                home = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)[:, 0]
                codes = quantise(matrix(b.column(1)) - centres[home], books)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "embedding", "cells", "codes"])

    coded = cells.mapInArrow(code, "id long, embedding array<double>, cells array<int>, codes binary")
    keep = refine * k

    def nominate(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame(_NOTHING)
        books, centres = shared.value
        codes, ids, x, own = np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(len(r), -1), r["id"].to_numpy(), np.array(q["embedding"].tolist()), q["id"].to_numpy()
        out = []
        for lo, hi in _lots(len(q), len(r)):
            part = np.pad(x[lo:hi], ((0, 0), (0, books.shape[0] * books.shape[2] - x.shape[1]))).reshape(hi - lo, books.shape[0], -1)
            sim = np.repeat((x[lo:hi] @ centres[key[0]])[:, None], len(r), 1)  # the centre's share, and a table look-up for each part
            for p in range(len(books)):
                sim += (part[:, p] @ books[p].T)[:, codes[:, p]]
            sim[own[lo:hi, None] == ids[None, :]] = -np.inf
            top = min(keep, len(r))
            near = np.argpartition(-sim, top - 1, axis=1)[:, :top]
            out.append(pd.DataFrame({"id": np.repeat(own[lo:hi], top), "nbr": ids[near].ravel(), "sim": np.take_along_axis(sim, near, 1).ravel()}))
        out = pd.concat(out)
        return out[np.isfinite(out["sim"])]

    found = _probed(coded, "codes").applyInPandas(nominate, "id long, nbr long, sim double")
    return rerank(feats, _top(found, keep), k)


def knn_lsh(feats: DataFrame, k: int, *, max_dist: float = 1.3, tables: int = 8, bucket: float = 2.0, seed: int = 0) -> DataFrame:
    """Approximate search by random projections: rows that share a bucket of any table and are nearer than ``max_dist`` are ranked by exact similarity.

    A table's bucket is the place of a row's projection on a random direction, in steps of ``bucket``. A bucket is dealt into groups
    of bounded size, where blocks are multiplied; a pair is looked at in the first table whose bucket it shares only.
    """

    def hashed(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                along = np.random.default_rng(seed).normal(size=(x.shape[1], tables))
                codes = np.floor(x @ (along / np.linalg.norm(along, axis=0)) / bucket).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "embedding", "codes"])

    rows = cut(feats.select("id", "embedding").mapInArrow(hashed, "id long, embedding array<double>, codes array<long>"), "lsh-codes")
    n = F.count(F.lit(1))
    sizes = rows.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").agg(F.ceil(n / Q_BLOCK).cast("int").alias("nq"), F.ceil(n / R_BLOCK).cast("int").alias("nr"))
    placed = rows.select("id", "embedding", "codes", F.posexplode("codes").alias("t", "code")).join(sizes, ["t", "code"])
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kept = ["id", "embedding", F.slice("codes", F.lit(1), F.col("t")).alias("before")]
    left = placed.select("t", "code", deal("nq").alias("qb"), each("nr").alias("rb"), *kept)
    right = placed.select("t", "code", each("nq").alias("qb"), deal("nr").alias("rb"), *kept)

    def cell(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(_NOTHING)]
        if len(q) and len(r):
            x, ids, every, own = np.array(r["embedding"].tolist()), r["id"].to_numpy(), np.array(q["embedding"].tolist()), q["id"].to_numpy()
            met, asked = (np.array(d["before"].tolist(), np.int64).reshape(len(d), -1) for d in (r, q))  # buckets in the tables before
            kinds, kind = np.unique(asked, axis=0, return_inverse=True) if asked.shape[1] else (asked[:1], np.zeros(len(q), int))
            for i, codes in enumerate(kinds):
                mine, new = np.flatnonzero(kind.ravel() == i), np.flatnonzero((met != codes).all(1))
                if len(new):
                    out.append(_nearest_of(every[mine], own[mine], x[new], ids[new], k, max_dist=max_dist))
        return pd.concat([f for f in out if len(f)] or out)

    by = ["t", "code", "qb", "rb"]
    return _top(left.groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInPandas(cell, "id long, nbr long, sim double"), k)


def filter_by_similarity(knn: DataFrame, th: float) -> DataFrame:
    """Neighbours with ``1 - dist >= th``."""
    return knn.where(1 - F.col("dist") >= th)


def undirected_pairs(knn: DataFrame, th: float, k: int | None = None) -> DataFrame:
    """``u, v, score`` with u < v; of two directions the one of the smaller anchor counts."""
    rows = knn if k is None else knn.where(F.col("rank") <= k)
    rows = rows.where((F.col("id") != F.col("nbr")) & (F.col("nbr") >= 0) & (1 - F.col("dist") >= th))
    return rows.groupBy(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v")).agg(F.min_by(1 - F.col("dist"), F.struct("id", "rank")).alias("score"))


def reorder(knn: DataFrame) -> DataFrame:
    """Ranks by ascending distance, ties by neighbour."""
    return knn.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr")))


def to_edges(knn: DataFrame, th: float = 0.0, *, use_sim: bool = True, fill: float | None = None, filter_on: str = "sim") -> DataFrame:
    """``src, dst, w``; the threshold holds for the similarity (or the distance, with ``filter_on``)."""
    sim = 1 - F.col("dist")
    value = F.lit(float(fill)) if fill is not None else sim if use_sim else F.col("dist")
    return knn.where((F.col("nbr") >= 0) & ((sim if filter_on == "sim" else F.col("dist")) >= th)).select(F.col("id").alias("src"), F.col("nbr").alias("dst"), value.alias("w"))


def induced(knn: DataFrame, ids: DataFrame) -> DataFrame:
    """``src, dst, w`` among ``ids``, renumbered from 0 in id order."""
    number = numbered(ids.select("id").distinct(), "id", into="_n")
    a, b = number.select("id", F.col("_n").alias("src")), number.select(F.col("id").alias("nbr"), F.col("_n").alias("dst"))
    return knn.join(a, "id").join(b, "nbr").select("src", "dst", (1 - F.col("dist")).alias("w"))


def knn_recall(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean share of an id's class that is among its neighbours (the id itself counts as found)."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a, b = labels.select("id", F.col("label").alias("la")), labels.select(F.col("id").alias("nbr"), F.col("label").alias("lb"))
    hits = knn.where("id <> nbr").join(a, "id").join(b, "nbr").where("la = lb").groupBy("id").agg(F.countDistinct("nbr").alias("hit"))
    return labels.join(size, "label").join(hits, "id", "left").agg(F.avg((F.coalesce("hit", F.lit(0)) + 1) / F.col("n")).alias("recall"))


def same_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two edge tables hold the same non-zero entries."""
    return edge_difference(a, b).agg((F.count(F.lit(1)) == 0).alias("same"))


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``src, dst, w, side``: non-zero entries that only the first (side 1) or only the second table (side 2) holds, as often as they are missing."""
    a, b = (x.where("w <> 0").select("src", "dst", "w") for x in (a, b))
    return a.exceptAll(b).withColumn("side", F.lit(1)).unionAll(b.exceptAll(a).withColumn("side", F.lit(2)))
