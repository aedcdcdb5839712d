import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs or full rows, with further columns of clashing names."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(partitions)
        return df.withColumn("size", F.lit(3)).withColumn("rank", F.lit("x")).withColumn("cid", F.lit(1)).withColumn("blob", F.lit(None).cast("string"))

    return build
