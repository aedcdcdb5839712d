"""Reading and writing features, labels, neighbours and proposals."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions.numbering import numbered
from clusterloom.functions.scratch import shared_dir
from clusterloom.operators.knn import knn_exact
from clusterloom.operators.proposals import fill_labels, induced_edges
from clusterloom.operators.vectors import l2_normalize, vector_column


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_features_bin(spark: SparkSession, path: str, dim: int, dtype: str = "float32", rows_a_read: int = 16_384) -> DataFrame:
    """``id, embedding`` of a headerless row-major matrix.

    The file is split into records of as many whole rows as divide it evenly, at most ``rows_a_read``, and
    each record becomes an Arrow batch. A file that is no whole number of rows raises ``ValueError``.
    """
    width = dim * np.dtype(dtype).itemsize
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size % width:
        raise ValueError(f"{size} bytes are no whole number of rows of {width}")
    n = size // width
    many = max((d for d in range(1, rows_a_read + 1) if n % d == 0), default=1)
    raw = spark.read.format("binaryFile").load(path).select("content") if n <= many else None

    def parse(first, block):
        x = np.frombuffer(block, dtype).astype(np.float64).reshape(-1, dim)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), vector_column(x)], ["id", "embedding"])

    schema = "id long, embedding array<double>"
    if raw is not None:
        return raw.mapInArrow(lambda batches: (parse(0, c) for b in batches for c in b.column(0).to_pylist() if c), schema)
    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, many * width).zipWithIndex().map(lambda t: (t[1], bytearray(t[0]))), "block long, raw binary")
    return records.mapInArrow(lambda batches: (parse(i * many, c) for b in batches for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), schema)


def write_features(df: DataFrame, path: str, force: bool = False) -> None:
    df.select("id", "embedding").write.mode("overwrite" if force else "ignore").parquet(path)


def read_labels(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """``id, label`` of a text file (or a folder of part files) with one integer a line; ids count lines from ``start``."""
    lines = spark.read.text(path).select(F.col("value").cast("long").alias("label"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return numbered(lines, "_f", "_b", "_m", into="id").select((F.col("id") + start).alias("id"), "label")


def inverse_labels(labels: DataFrame) -> DataFrame:
    """``label, ids``."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def write_labels(labels: DataFrame, path: str, n: int, force: bool = False) -> None:
    """Dense labels of ids 0..n-1 as one integer a line in id order; ids without a label get fresh ones."""
    filled = fill_labels(labels, n)
    filled.repartitionByRange("id").sortWithinPartitions("id").select(F.col("label").cast("string").alias("value")).write.mode("overwrite" if force else "ignore").text(path)


def dump(df: DataFrame, path: str, force: bool = False) -> None:
    """Write by suffix: ``.json`` as JSON lines, else Parquet. Without ``force`` existing output stays."""
    w = df.write.mode("overwrite" if force else "ignore")
    w.json(path) if path.endswith(".json") else w.parquet(path)


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """What :func:`dump` wrote."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.json(path) if path.endswith(".json") else r.parquet(path)


@dataclass
class Dataset:
    """Features (normalised or not) and labels of a table or of files."""

    features: DataFrame
    labels: DataFrame | None = None

    @classmethod
    def from_table(cls, df: DataFrame, id_col="vec_id", vec_col="embedding", label_col: str | None = "label", normalize: bool = True) -> Dataset:
        f = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"))
        y = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")) if label_col else None
        return cls(l2_normalize(f) if normalize else f, y)

    @classmethod
    def from_files(cls, spark: SparkSession, features: str, dim: int, labels: str | None = None, normalize: bool = True) -> Dataset:
        f = read_features_bin(spark, features, dim)
        return cls(l2_normalize(f) if normalize else f, read_labels(spark, labels) if labels else None)

    def info(self) -> DataFrame:
        """One row: number of ids, dimension, number of labels."""
        one = self.features.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))
        return one if self.labels is None else one.crossJoin(self.labels.agg(F.countDistinct("label").alias("n_labels")))


def cached_knn(feats: DataFrame, k: int, name: str, *, rebuild: bool = False, method=knn_exact) -> DataFrame:
    """Neighbours kept as a table of the shared folder; rebuilt when the features' fingerprint differs or on request."""
    spark = feats.sparkSession
    mark = feats.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "embedding").cast("decimal(38,0)"))).first()
    path = f"{shared_dir(spark).rstrip('/')}/knn-{name}-{method.__name__}-k{k}-{mark[0]}-{mark[1]}"
    if rebuild or not _exists(spark, f"{path}/_SUCCESS"):
        method(feats, k).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_proposals(props: DataFrame, knn: DataFrame, path: str, force: bool = False) -> None:
    """Nodes and inner edges of ``proposal_set, proposal_id, node``, a folder for each set. With ``force`` both tables are replaced whole."""
    mode = "overwrite" if force else "ignore"
    props.write.mode(mode).partitionBy("proposal_set").parquet(f"{path}/nodes")
    induced_edges(props, knn, ["proposal_set", "proposal_id"]).write.mode(mode).partitionBy("proposal_set").parquet(f"{path}/edges")


def read_proposals(spark: SparkSession, path: str, proposal_set: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; edges without their proposal's nodes are an error."""
    nodes, edges = (spark.read.parquet(f"{path}/{x}") for x in ("nodes", "edges"))
    if proposal_set is not None:
        nodes, edges = (x.where(F.col("proposal_set") == proposal_set) for x in (nodes, edges))
    key = ["proposal_set", "proposal_id"]
    if not edges.select(*key).distinct().join(nodes.select(*key).distinct(), key, "left_anti").isEmpty():
        raise ValueError("edges of unknown proposals")
    return nodes, edges


def set_name(params: dict) -> str:
    """Parameters as the name of a proposal set; :func:`parse_set_name` reads it back."""
    return json.dumps(params, sort_keys=True)


def parse_set_name(name: str) -> dict:
    return json.loads(name)
