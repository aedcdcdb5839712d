"""Density and confidence of vertices, and links to vertices of higher confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.numbering import numbered
from clusterloom.operators.vectors import dot, group_mean


def density(knn: DataFrame, nodes: DataFrame, radius: float, use_weight: bool = True) -> DataFrame:
    """``id, conf``: summed similarity (or number) of neighbours with ``dist < radius``; 0 without any."""
    value = (1 - F.col("dist")) if use_weight else F.lit(1.0)
    near = knn.where(F.col("dist") < radius).groupBy("id").agg(F.sum(value).alias("conf"))
    return nodes.select("id").join(near, "id", "left").select("id", F.coalesce("conf", F.lit(0.0)).alias("conf"))


def _agreement(knn: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select("id", F.col("label").alias("_la")), labels.select(F.col("id").alias("nbr"), F.col("label").alias("_lb"))
    sim = 1 - F.col("dist")
    return knn.join(a, "id").join(b, "nbr").groupBy("id").agg(F.sum(F.when(F.col("_la") == F.col("_lb"), sim).otherwise(-sim)).alias("raw"), F.count(F.lit(1)).alias("cnt"))


def s_nbr(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """Similarity to neighbours of the same label minus that to others, over the largest absolute value."""
    c = _agreement(knn, labels)
    top = c.agg(F.max(F.abs("raw")).alias("top"))
    return c.crossJoin(top).select("id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0).alias("conf"))


def s_nbr_size(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """As :func:`s_nbr`, over the longest neighbour list."""
    c = _agreement(knn, labels)
    return c.crossJoin(c.agg(F.max("cnt").alias("top"))).select("id", (F.col("raw") / F.col("top")).alias("conf"))


def s_avg(feats: DataFrame, labels: DataFrame, later_only: bool = False) -> DataFrame:
    """Mean similarity to the other members of the class; 0 for a class of one.

    By linearity that is the dot product with the class's vector sum, less the vector's own
    square, so no pair of members is formed. ``later_only`` compares with members of
    larger id alone, through running sums of components from the class's end.
    """
    rows = feats.join(labels, "id")
    if later_only:
        w = Window.partitionBy("label", "_p").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.select("id", "label", F.posexplode("embedding").alias("_p", "_x")).withColumn("_s", F.sum("_x").over(w)).withColumn("_n", F.count("_x").over(w))
        return parts.groupBy("id").agg(F.coalesce(F.sum(F.col("_x") * F.col("_s")) / F.max("_n"), F.lit(0.0)).alias("conf"))
    mean = group_mean(feats, labels, "label").withColumnRenamed("embedding", "_m")
    n = rows.groupBy("label").count()
    e = F.col("embedding")
    return rows.join(mean, "label").join(n, "label").select("id", F.when(F.col("count") > 1, (dot(e, F.col("_m")) * F.col("count") - dot(e, e)) / (F.col("count") - 1)).otherwise(0.0).alias("conf"))


def s_center(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Dot product with the class's mean vector."""
    mean = group_mean(feats, labels, "label").withColumnRenamed("embedding", "_m")
    return feats.join(labels, "id").join(mean, "label").select("id", dot(F.col("embedding"), F.col("_m")).alias("conf"))


def confidence(metric: str, *, feats=None, knn=None, labels=None) -> DataFrame:
    """A confidence by name; unknown names raise ``KeyError``."""
    table = {
        "s_nbr": lambda: s_nbr(knn, labels), "s_nbr_size_norm": lambda: s_nbr_size(knn, labels),
        "s_avg": lambda: s_avg(feats, labels), "s_center": lambda: s_center(feats, labels),
    }
    return table[metric]()


def peaks(knn: DataFrame, conf: DataFrame, max_conn: int = 1) -> DataFrame:
    """``src, dst, dist, conn_no``: of each vertex the nearest ``max_conn`` neighbours of strictly higher confidence."""
    a, b = conf.select("id", F.col("conf").alias("_a")), conf.select(F.col("id").alias("nbr"), F.col("conf").alias("_b"))
    up = knn.join(a, "id").join(b, "nbr").where("_b > _a")
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return up.withColumn("conn_no", F.row_number().over(w)).where(F.col("conn_no") <= max_conn).select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "dist", "conn_no")


def peak_accuracy(pred: DataFrame, true: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: share of vertices with the same first peak, and with a peak of their own label (no peak: its own)."""
    p, t = pred.where("conn_no = 1").select("src", F.col("dst").alias("_p")), true.where("conn_no = 1").select("src", F.col("dst").alias("_t"))
    rows = labels.select(F.col("id").alias("src"), F.col("label").alias("_l")).join(p, "src", "left").join(t, "src", "left").withColumn("_p", F.coalesce("_p", "src")).withColumn("_t", F.coalesce("_t", "src"))
    other = labels.select(F.col("id").alias("_p"), F.col("label").alias("_pl"))
    rows = rows.join(other, "_p")
    return rows.agg(F.avg((F.col("_p") == F.col("_t")).cast("double")).alias("peak_match"), F.avg((F.col("_pl") == F.col("_l")).cast("double")).alias("label_match"))


def ignore_set(conf: DataFrame, ratio: float, smallest: bool = True) -> DataFrame:
    """``id`` of the floor(n * ratio) vertices of lowest (or highest) confidence; ties by id."""
    n = conf.count()
    return numbered(conf.select("id", "conf"), F.col("conf").asc() if smallest else F.col("conf").desc(), "id").where(F.col("number") < int(n * ratio)).select("id")
