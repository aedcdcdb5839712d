"""Tables kept between the steps of an iterative or many-branched plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A local master may leave that setting
    out; then a temporary folder of this machine is used.
    """
    named = spark.conf.get(_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "clusterloom-checkpoints")
        spark.conf.set(_KEY, named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Lineage ends here, so that a lost executor costs a reread and not the whole
    chain, and later uses do not compute ``df`` again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut` that no later step reads; other tables are left alone."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path in _written:
            _written.remove(path)
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear(spark: SparkSession) -> None:
    """Delete every scratch table that this process wrote; for when its results have been read."""
    while _written:
        _delete(spark, _written.pop())
