"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.scratch import cut, release

#: Edges that a task holds before it shrinks them to stars.
_HELD = 1 << 22


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n indices by the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _stars(batches):
    """``v, r``: every node of a partition's edges with the smallest node that these edges connect it to."""
    parts, held = [], 0

    def shrink():
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return ids, ids[roots(len(ids), at[: len(a)], at[len(a) :])]

    for batch in batches:
        if batch.num_rows:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held > _HELD:
                parts = [shrink()]
                held = len(parts[0][0])
    if parts:
        v, r = shrink()
        for lo in range(0, len(v), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 100_000]), pa.array(r[lo : lo + 100_000])], ["v", "r"])


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component``: every node with the smallest node of its component. Ids are integers; edges with a null end do not count.

    Every task shrinks its edges to stars, so that a node costs one row a task however many
    edges it has; after a shuffle by node, tasks shrink what they got again. Where a node
    still has several roots these are tied by :func:`linked`, whose rounds see roots
    only. ``nodes`` (column ``id``) adds nodes that have no edge.
    """
    both = edges.select(F.col(src).cast("long").alias("v"), F.col(dst).cast("long").alias("r"))
    if nodes is not None:
        both = both.union(nodes.select(F.col("id").cast("long").alias("v"), F.col("id").cast("long").alias("r")))
    both = both.where("v is not null and r is not null")
    schema = "v long, r long"
    stars = both.mapInArrow(_stars, schema).repartition("v").mapInArrow(_stars, schema)
    roots_of = stars.groupBy("v").agg(F.min("r").alias("m"), F.collect_set("r").alias("all"))  # a root a task at most
    label = cut(roots_of.select("v", "m", F.array_remove("all", F.col("m")).alias("more")), "cc-label")
    if label.where(F.size("more") > 0).isEmpty():
        return label.select(F.col("v").alias("id"), F.col("m").alias("component"))
    tied = linked(label.select("m", F.explode("more").alias("r")).select(F.least("r", "m").alias("a"), F.greatest("r", "m").alias("b")))
    c = tied.withColumnRenamed("id", "m")
    return label.join(c, "m", "left").select(F.col("v").alias("id"), F.coalesce("component", "m").alias("component"))


def linked(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component`` of the edges ``a, b`` with ``a <= b``, by joins.

    Each round links the roots of two different trees by an edge's smaller root, then
    shortens all trees by pointer jumping, so the number of rounds grows with the
    logarithm of the diameter. Edges inside one tree are dropped as they appear. Minima are
    taken by aggregation with map-side combining, so a hub with very many edges costs
    one row per task.
    """
    live = cut(edges.distinct(), "cc-edges")
    # First labels: the smallest neighbour or the node itself.
    label = live.select(F.col("a").alias("id"), F.col("a").alias("c")).union(live.select(F.col("b").alias("id"), F.col("a").alias("c"))).groupBy("id").agg(F.min("c").alias("c"))
    label = cut(_jump(label), "cc-label")
    for _ in range(max_rounds):
        a, b = label.select(F.col("id").alias("a"), F.col("c").alias("ca")), label.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        old = live
        live = live.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        live = cut(live, "cc-edges")
        release(old)
        if live.isEmpty():
            release(live)
            return label.select("id", F.col("c").alias("component"))
        hook = live.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("id"), "to")
        old = label
        label = label.join(hook, label["c"] == hook["id"], "left").select(label["id"], F.coalesce("to", "c").alias("c"))
        label = cut(_jump(label), "cc-label")
        release(old)
    raise RuntimeError("components did not settle")


def _jump(label: DataFrame) -> DataFrame:
    """Point every node at its label's label, twice."""
    for _ in range(2):
        up = label.select(F.col("id").alias("c"), F.col("c").alias("up"))
        label = label.join(up, "c").select("id", F.col("up").alias("c"))
    return label
