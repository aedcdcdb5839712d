"""Affinity graphs ``src, dst, w`` and clusterings ``id, label`` made from them."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.numbering import numbered
from clusterloom.functions.scratch import cut, release
from clusterloom.operators.components import _HELD, connected_components, roots


def row_normalize(edges: DataFrame) -> DataFrame:
    """Weights divided by their row's sum; a sum of at most 0 counts as 1."""
    s = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", F.col("w") / F.when(s <= 0, 1.0).otherwise(s))


def symmetrize(edges: DataFrame, self_loops: DataFrame | None = None) -> DataFrame:
    """Larger weight of both directions; ``self_loops(id)`` adds 1 on the diagonal."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    out = edges.select("src", "dst", "w").unionByName(back).groupBy("src", "dst").agg(F.max("w").alias("w"))
    if self_loops is not None:
        loops = self_loops.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
        out = out.unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return out


def dense_labels(labels: DataFrame) -> DataFrame:
    """Labels 0, 1, ... in order of each label's smallest id."""
    heads = labels.groupBy("label").agg(F.min("id").alias("head"))
    number = numbered(heads, "head", "label", into="_n").select("label", "_n")
    return labels.join(number, "label").select("id", F.col("_n").alias("label"))


def component_labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Dense component labels of a directed edge list, taken as undirected."""
    return dense_labels(connected_components(edges, nodes).select("id", F.col("component").alias("label")))


def constrained_components(pairs: DataFrame, max_size: int, th: float | None = None) -> DataFrame:
    """``id, component, fits``: components of the pairs with ``score >= th``, and whether each has at most ``max_size`` nodes."""
    nodes = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    live = pairs if th is None else pairs.where(F.col("score") >= th)
    found = connected_components(live, nodes, src="u", dst="v")
    return found.withColumn("fits", F.count(F.lit(1)).over(Window.partitionBy("component")) <= max_size)


def pool_pairs(pairs: DataFrame, pool: str | None = None) -> DataFrame:
    """One score a pair: ``avg``, ``max``, or (None) the last by ``seq`` if there is such a column, else the largest."""
    key = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    if pool == "avg":
        score = F.avg("score")
    elif pool == "max" or "seq" not in pairs.columns:
        score = F.max("score")
    else:
        score = F.max_by("score", "seq")
    return pairs.where("u <> v").groupBy(*key).agg(score.alias("score"))


#: So many edges at most go through their levels in one task.
_WHOLE_EDGES = 1 << 18


def spanning(u: np.ndarray, v: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of edges that form a forest and connect, at every threshold, what all edges connect at it."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    at = np.lexsort((v, u, -score))  # best first; ids settle ties, so that all tasks agree
    a, b, root, kept = ends[: len(u)][at], ends[len(u) :][at], np.arange(len(ids)), []
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
        if not len(a):
            return np.concatenate([np.zeros(0, np.int64), *kept])
        best = np.full(len(ids), len(a))
        for x in (a, b):
            np.minimum.at(best, x, np.arange(len(a)))
        best = np.unique(best[best < len(a)])
        kept.append(at[best])
        root = roots(len(ids), a[best], b[best])


def _forests(batches):
    """The :func:`spanning` edges ``u, v, score`` of a partition. A null score is below all others, NaN above."""
    parts, held = [], 0

    def shrink():
        t = pa.Table.from_batches(parts).combine_chunks()
        u, v, score = (t.column(i).combine_chunks() for i in range(3))
        score = score.fill_null(-np.inf).to_numpy()
        return t.take(spanning(u.to_numpy(), v.to_numpy(), np.where(np.isnan(score), np.inf, score))).to_batches(max_chunksize=100_000)

    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            held += batch.num_rows
            if held > _HELD:
                parts = shrink()
                held = sum(x.num_rows for x in parts)
    if parts:
        yield from shrink()


def _thinned(rest: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Fewer of ``n`` edges, and their number, that connect the same at every threshold: tasks leave out what closes a ring of better edges, as long as that takes a fifth away."""
    while n > _WHOLE_EDGES:
        parts, old, before = n // max(_WHOLE_EDGES, 1), rest, n
        rest = cut(rest.repartition(parts, F.xxhash64("u", "v", F.lit(n))).mapInArrow(_forests, "u long, v long, score double"), "dyn-forest")
        release(old)
        n = rest.count()
        if n > 0.8 * before:
            break
    return rest, n


def _finished(rest: DataFrame, n_edges: int, max_size: int, levels: list[float | None]) -> DataFrame:
    """``id, label`` of whole components, split at the thresholds ``levels`` (None: all edges hold); what is left then has no label."""
    parts = max(rest.sparkSession.sparkContext.defaultParallelism, -(-n_edges // _WHOLE_EDGES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, score = pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["score"].to_numpy()
        out = [pd.DataFrame({"id": u[:0], "label": u[:0]})]
        for level, at in enumerate(levels, 1):
            ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
            a, b = ends[: len(u)], ends[len(u) :]
            live = slice(None) if at is None else score >= at
            root = roots(len(ids), a[live], b[live])
            fits = np.bincount(root, minlength=len(ids))[root] <= max_size
            out.append(pd.DataFrame({"id": ids[fits], "label": ids[root[fits]]}))
            if level == len(levels):
                out.append(pd.DataFrame({"id": ids[~fits], "label": None}))
            inner = (root[a] == root[b]) & ~fits[a]
            u, v, score = u[inner], v[inner], score[inner]
            if not len(u):
                break
        return pd.concat([x for x in out if len(x)] or out).astype({"label": "Int64"})

    return rest.groupBy(F.pmod(F.xxhash64("component"), F.lit(parts))).applyInPandas(run, "id long, label long")


def dynamic_threshold_clusters(pairs: DataFrame, max_size: int, step: float, *, pool: str | None = None, max_iter: int = 100) -> DataFrame:
    """``id, label``: components of at most ``max_size`` nodes; larger ones are split at rising thresholds.

    The threshold starts at the smallest score and moves ``step`` of the way to 1 on each level;
    only nodes of components that are still too large go on, with the edges among
    them. After ``max_iter`` levels what is left becomes one cluster. Edges that no threshold needs
    are left out of large tables. No edge joins two components again, so each goes through its levels
    in one task once it has few enough edges; all of them, if these are few.
    """
    rest = cut(pool_pairs(pairs, pool), "dyn-pairs")
    th, n_all = rest.agg(F.min("score"), F.count(F.lit(1))).first()
    out, left, level, levels = [], [], 0, [None]
    if th is not None:
        for _ in range(max_iter):
            th = th + (1 - th) * step
            levels.append(th)
        rest, n_all = _thinned(rest, n_all)
        if n_all <= _WHOLE_EDGES:
            done = cut(_finished(rest.withColumn("component", F.lit(0)), n_all, max_size, levels), "dyn-done")
            out, left, th = [done.where("label is not null")], [done.where("label is null").select("id")], None
    while th is not None:
        found = cut(constrained_components(rest, max_size, levels[level]), "dyn-level")
        out.append(found.where("fits").select("id", F.col("component").alias("label")))
        big = found.where("not fits").select("id", "component")
        if big.isEmpty():
            break
        if level >= max_iter:
            left.append(big.select("id"))
            break
        # An edge between two components lies below the threshold, and stays below all later ones.
        a, b = big.select(F.col("id").alias("u"), F.col("component")), big.select(F.col("id").alias("v"), F.col("component").alias("_cv"))
        old = rest
        rest = cut(rest.select("u", "v", "score").join(a, "u").join(b, "v").where("component = _cv").select("u", "v", "score", "component"), "dyn-rest")
        release(old)
        level += 1
        sizes = cut(rest.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "dyn-sizes")
        whole = sizes.where(F.col("n") <= _WHOLE_EDGES)
        n, n_all = sizes.agg(F.sum(F.when(F.col("n") <= _WHOLE_EDGES, F.col("n"))), F.sum("n")).first()
        if n:
            done = cut(_finished(rest.join(whole.select("component"), "component", "left_semi"), n, max_size, levels[level:]), "dyn-done")
            out.append(done.where("label is not null"))
            left.append(done.where("label is null").select("id"))
        if n == n_all:
            break
        old = rest
        rest = cut(rest.join(sizes.where(F.col("n") > _WHOLE_EDGES).select("component"), "component", "left_semi"), "dyn-rest")
        release(old)
    if left:
        rows = functools.reduce(DataFrame.unionByName, left)
        least = rows.agg(F.min("id")).first()[0]
        if least is not None:
            out.append(rows.select("id", F.lit(least).cast("long").alias("label")))
    if not out:
        return pairs.select(F.col("u").alias("id"), F.col("u").alias("label")).limit(0)
    return functools.reduce(DataFrame.unionByName, out)


def peaks_to_edges(peaks: DataFrame, tau: float) -> DataFrame:
    """Peak links ``src, dst`` with ``dist < 1 - tau`` that are not loops."""
    return peaks.where((F.col("src") != F.col("dst")) & (F.col("dist") < 1 - tau)).select("src", "dst")


def peaks_to_labels(peaks: DataFrame, tau: float, nodes: DataFrame) -> DataFrame:
    """Dense labels of the components of the peak links."""
    return component_labels(peaks_to_edges(peaks, tau), nodes)
