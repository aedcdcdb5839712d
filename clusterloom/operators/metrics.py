"""Clustering quality from a contingency table, and binary metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contingency(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """``g, p, n`` of the ids that both ``(id, label)`` tables hold."""
    both = gt.select("id", F.col("label").alias("g")).join(pred.select("id", F.col("label").alias("p")), "id")
    return both.groupBy("g", "p").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _f(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r))


def _sums(c: DataFrame):
    return c.groupBy("p").agg(F.sum("n").alias("pn")), c.groupBy("g").agg(F.sum("n").alias("gn"))


def pairwise(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """``precision, recall, f`` over pairs; a share of nothing is null."""
    c = contingency(gt, pred)
    p, g = _sums(c)
    n = c.agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("t"))
    one = n.crossJoin(p.agg(F.sum(F.col("pn") * F.col("pn")).alias("ps"))).crossJoin(g.agg(F.sum(F.col("gn") * F.col("gn")).alias("gs")))  # three tables of one row
    ratio = lambda s: F.when(F.col(s) - F.col("N") > 0, (F.col("t") - F.col("N")) / (F.col(s) - F.col("N")))
    return one.select(ratio("ps").alias("precision"), ratio("gs").alias("recall")).withColumn("f", _f(F.col("precision"), F.col("recall")))


def bcubed(gt: DataFrame, pred: DataFrame) -> DataFrame:
    c = contingency(gt, pred)
    p, g = _sums(c)
    s = c.join(p, "p").join(g, "g").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("gn")).alias("b"))
    return s.select((F.col("a") / F.col("N")).alias("precision"), (F.col("b") / F.col("N")).alias("recall")).withColumn("f", _f(F.col("precision"), F.col("recall")))


def nmi(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Normalised mutual information, arithmetic mean; two one-cluster labelings score 1."""
    c = contingency(gt, pred)
    p, g = _sums(c)
    total = c.agg(F.sum("n").alias("total"))
    full = c.join(p, "p").join(g, "g").crossJoin(total)
    mi = full.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("pn") * F.col("gn")))).alias("mi"))
    h = lambda t, k, name: t.crossJoin(total).agg(F.sum(-F.col(k) / F.col("total") * F.log(F.col(k) / F.col("total"))).alias(name))
    return mi.crossJoin(h(p, "pn", "hp")).crossJoin(h(g, "gn", "hg")).select(F.when(F.col("hp") + F.col("hg") > 0, 2 * F.col("mi") / (F.col("hp") + F.col("hg"))).otherwise(1.0).alias("nmi"))


def binary(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """``precision, recall, accuracy`` of 0/1 columns."""
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    g, p = F.col(gt) == 1, F.col(pred) == 1
    ratio = lambda a, b: F.when(b > 0, a / b)
    return df.agg(ratio(n(g & p), n(p)).alias("precision"), ratio(n(g & p), n(g)).alias("recall"), F.avg((F.col(gt) == F.col(pred)).cast("double")).alias("accuracy"))


METRICS = {"pairwise": pairwise, "bcubed": bcubed, "nmi": nmi}


def evaluate(gt: DataFrame, pred: DataFrame, metric: str = "pairwise") -> DataFrame:
    """A metric by name; unknown names raise ``KeyError``."""
    return METRICS[metric](gt, pred)


def evaluate_files(spark: SparkSession, gt_path: str, pred_path: str, metric: str = "pairwise") -> DataFrame:
    """A metric by name of two label files with one integer a line; files of different length raise ``ValueError``."""
    from clusterloom.sources.io import read_labels

    gt, pred = read_labels(spark, gt_path), read_labels(spark, pred_path)
    if gt.count() != pred.count():
        raise ValueError("the label files differ in length")
    return evaluate(gt, pred, metric)


def clustering_report(labels: DataFrame, pred: DataFrame, singles: bool = True) -> DataFrame:
    """One row: clusters, ids in them, share of ids covered (by clusters of two or more, unless ``singles``), and all three metrics over the covered ids."""
    size = pred.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    kept = pred if singles else pred.join(size.where("n > 1").select("label"), "label", "left_semi")
    one = kept.agg(F.countDistinct("label").alias("n_clusters"), F.count(F.lit(1)).alias("n_ids")).crossJoin(labels.agg(F.count(F.lit(1)).alias("total")))  # tables of one row
    p, b = (m(labels, kept).toDF(*(f"{name}_{c}" for c in ("precision", "recall", "f"))) for name, m in (("pairwise", pairwise), ("bcubed", bcubed)))
    return one.withColumn("coverage", F.col("n_ids") / F.col("total")).drop("total").crossJoin(p).crossJoin(b).crossJoin(nmi(labels, kept))
