"""Vector arithmetic on ``(id, embedding)`` tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def features(df: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Input rows as ``id, embedding`` in double precision; rows without a vector are dropped."""
    return df.select(F.col(id_col).cast("long").alias("id"), as_double(F.col(vec_col)).alias("embedding")).where("id is not null and embedding is not null")


def l2_normalize(df: DataFrame, col="embedding") -> DataFrame:
    """Rows divided by their norm; a zero row stays zero."""
    n = norm(F.col(col))
    return df.withColumn(col, F.when(n > 0, F.transform(col, lambda x: x / n)).otherwise(F.col(col)))


def is_normalized(df: DataFrame, col="embedding", eps: float = 1e-4) -> DataFrame:
    """One row: whether all rows have unit length."""
    return df.agg((F.coalesce(F.max(F.abs(dot(F.col(col), F.col(col)) - 1)), F.lit(0.0)) < eps).alias("is_normalized"), F.count(F.lit(1)).alias("n"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vector_column(x: np.ndarray) -> pa.Array:
    """Rows of doubles as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _sums(batches, names: list[str], weighted: bool, ordered: bool):
    """Sums of the vectors of equal keys, batch by batch; ``ordered``: keys ascend, and one that goes over batches is summed up whole."""
    k, held = len(names), None

    def batch(keys, x):
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in keys], vector_column(x)], [*names, "v"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, x = [b.column(i).to_numpy() for i in range(k)], matrix(b.column(k))
        if weighted:
            x = x * b.column(k + 1).to_numpy()[:, None]
        if not ordered:
            order = np.lexsort(keys[::-1])
            keys, x = [c[order] for c in keys], x[order]
        fresh = np.ones(len(x), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
        at = np.flatnonzero(fresh)
        keys, x = [c[at] for c in keys], np.add.reduceat(x, at, axis=0)
        if ordered:
            if held is not None:
                if all(c[0] == h for c, h in zip(keys, held[0], strict=True)):
                    x[0] += held[1]
                else:
                    yield batch([np.array([h]) for h in held[0]], held[1][None])
            held = [c[-1] for c in keys], x[-1]
            keys, x = [c[:-1] for c in keys], x[:-1]
        if len(x):
            yield batch(keys, x)
    if held is not None:
        yield batch([np.array([h]) for h in held[0]], held[1][None])


def weighted_sum(rows: DataFrame, key, vec="embedding", weight="w") -> DataFrame:
    """Sum of weighted vectors (of one length) by integer key or keys. Each batch is summed before the shuffle, so a key on very many rows costs one row a batch."""
    keys = [key] if isinstance(key, str) else list(key)
    schema = ", ".join(f"{c} long" for c in keys) + ", v array<double>"
    cast = [F.col(c).cast("long").alias(c) for c in keys]
    parts = rows.select(*cast, as_double(F.col(vec)).alias("v"), F.col(weight).cast("double").alias("_w")).mapInArrow(lambda b: _sums(b, keys, True, False), schema)
    whole = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _sums(b, keys, False, True), schema)
    return whole.withColumnRenamed("v", vec)


def propagate(feats: DataFrame, edges: DataFrame, times: int = 1) -> DataFrame:
    """``adj ** times`` applied to the features; a row without edges becomes zero."""
    for _ in range(times):
        rows = edges.join(feats.withColumnRenamed("id", "dst"), "dst").select("src", "w", "embedding")
        moved = weighted_sum(rows, "src").withColumnRenamed("src", "id").withColumnRenamed("embedding", "_e")
        feats = feats.join(moved, "id", "left").select("id", F.coalesce("_e", F.transform("embedding", lambda x: F.lit(0.0))).alias("embedding"))
    return feats


def group_mean(feats: DataFrame, members: DataFrame, key: str, renormalize: bool = False) -> DataFrame:
    """``key, embedding``: mean vector of each group of ``members(key, id)``."""
    rows = feats.join(members.select(key, "id"), "id").withColumn("w", F.lit(1.0))
    n = members.join(feats.select("id"), "id").groupBy(key).count()
    out = weighted_sum(rows, key).join(n, key).select(key, F.transform("embedding", lambda x: x / F.col("count")).alias("embedding"))
    return l2_normalize(out) if renormalize else out


def relative(feats: DataFrame, pairs: DataFrame, src="src", dst="dst") -> DataFrame:
    """``src, dst, embedding``: the neighbour's vector minus the centre's."""
    a, b = feats.select(F.col("id").alias(src), F.col("embedding").alias("_a")), feats.select(F.col("id").alias(dst), F.col("embedding").alias("_b"))
    return pairs.select(src, dst).join(a, src).join(b, dst).select(src, dst, F.zip_with("_b", "_a", lambda x, y: x - y).alias("embedding"))


def pair_similarity(feats: DataFrame, pairs: DataFrame, src="id", dst="nbr") -> DataFrame:
    """``pairs`` with their exact inner product ``sim``."""
    a, b = feats.select(F.col("id").alias("_i"), F.col("embedding").alias("_a")), feats.select(F.col("id").alias("_j"), F.col("embedding").alias("_b"))
    return pairs.join(a, pairs[src] == F.col("_i")).join(b, pairs[dst] == F.col("_j")).withColumn("sim", dot(F.col("_a"), F.col("_b"))).drop("_i", "_j", "_a", "_b")


def argmax_ties(df: DataFrame, key: str, item: str, value: str, seed: int | None = None) -> DataFrame:
    """The item of largest value by key; ties by a hash with ``seed``, or to the smallest item."""
    tie = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(item).cast("string"))) if seed is not None else -F.col(item)
    return df.groupBy(key).agg(F.max_by(item, F.struct(F.col(value), tie)).alias(item))
