"""The corpus pipeline: language, near duplicates, secrets, mix, sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and
returns a DataFrame; ``run`` writes each one's result to the shared folder and reads it
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import mixing, near_join, packing, ppm, secrets
from clusterloom.llm.common import cut, release, table

#: The stages include iterative and learned steps, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


#: A text that every learned language needs twice its bits for (as for letters that none has met) is in none of them. Numbers and names stay below.
MOST_BITS = 16.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language fits, go; a missing ``lang`` is filled in.

    Null, empty and letterless texts go; a long text is scored whole; repeated rows share
    their fate; equal code lengths give the smaller name. Where no row can teach a language,
    every text with a letter stays. An empty table stays empty; all columns are kept, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])  # no column of the input has a name of the result
    text, model = plain.columns[names.index("text")], ppm.train(docs)
    found = ppm.identify(plain, model, text_col=text)
    fits = (F.col("lang_pred") != ppm.UND) & (F.col("bits_per_byte") < MOST_BITS) if model.langs else ppm.lettered(F.col(text))
    lang = lambda c: F.coalesce(c, F.when(F.col("lang_pred") != ppm.UND, F.col("lang_pred")))
    return found.where(fits).select(*[(lang(c) if name == "lang" else F.col(c)).alias(name) for c, name in zip(plain.columns, names, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of the smallest id (null is last), and of its texts there the one of the smallest hash.

    Null, empty and blank texts are one group; long texts are compared whole; of rows
    equal in id and text one stays. An empty table stays empty; all columns are kept, whatever their names.
    """
    return near_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes.

    Null texts stay null, empty ones empty; long texts are scanned whole; repeated rows
    are changed alike; overlapping findings become one mark. An empty table stays empty; all columns are kept, whatever their names.
    """
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out, so that every source reaches its target to the word.

    Null, empty and blank texts stay once; a null source is a source; a long text may be
    cut; repeated rows are mixed one by one. An empty table stays empty; all columns are kept, whatever their names.
    """
    return mixing.sample_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word ranges of documents in sequences.

    Null, empty and blank texts have one row without a sequence; long texts are cut into
    pieces; repeated rows and null ids are packed one by one; equal lengths go by id. An empty table gives an empty result; further columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
