"""Best-fit packing into sequences of several permitted lengths.

Documents are measured in words; one longer than the largest length is cut into pieces,
so that nothing is lost. Pieces are placed by descending length: into the open bin that
they fill best, or else into a new bin. A new bin's length is the permitted one with the
least expected cost per word, given the words of the pieces still to come that could
fill it. At the end each bin shrinks to the smallest permitted length that holds it.

Pieces are dealt by hash into shards of about ``shard_pieces``, each packed on its own,
so work and memory of a task are bounded and shards run side by side. A shard of more
than twice as many (rows that repeat an id) is dealt again by row.

Defined results
    * null or blank text: one row with length 0 and no bin.
    * equal lengths go by id, then piece. Repeated rows and null ids are packed one by one.
    * a very long text is cut into pieces of the largest length, which may lie in different shards.
    * empty table: empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import cut
from clusterloom.llm.mixing import words

LENGTHS = (512, 1024, 2048, 4096)


def cost(length: int, quadratic: float = 1 / 8192) -> float:
    """Cost of one sequence: linear layers plus attention."""
    return length + quadratic * length * length


def pack(sizes, lengths=LENGTHS, cost=cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and place in the bin of each piece (sizes in descending order), and each bin's final length."""
    lengths = sorted(lengths)
    top = lengths[-1]
    mass = np.zeros(top + 1, np.int64)
    np.add.at(mass, np.asarray(sizes, np.int64), np.asarray(sizes, np.int64))
    smaller = np.cumsum(mass).tolist()  # words in pieces of at most so many words
    price = {c: cost(c) for c in lengths}
    free: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by room left
    rooms = 0  # bit r: some open bin has room r
    left = int(mass.sum())
    bins, places, used, opened = [], [], [], []
    for size in sizes:
        left -= size
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = free[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            best = None
            for c in lengths:
                if c >= size:
                    hope = size + min(c - size, left, smaller[min(c - size, size)])
                    rate = price[c] / hope
                    if best is None or rate < best[0]:
                        best = (rate, c)
            room, b = best[1], len(used)
            used.append(0)
            opened.append(room)
        bins.append(b)
        places.append(used[b])
        used[b] += size
        room -= size
        if room:
            free[room].append(b)
            rooms |= 1 << room
    final = [next(c for c in lengths if c >= u) for u in used]
    return bins, places, final


def pack_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", lengths=LENGTHS, shard_pieces: int = 50_000) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_start, bin_length``: word ranges of documents and where they lie."""
    top = max(lengths)
    kind = docs.schema[id_col].dataType.simpleString()
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("size")), "pack-sizes")
    n = sized.agg(F.sum(F.ceil(F.col("size") / top))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_pieces))
    pieces = (
        sized.where("size > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / top).cast("int"))))
        .withColumn("start", F.col("piece").cast("long") * top)
        .withColumn("length", F.least(F.lit(top).cast("long"), F.col("size") - F.col("start")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
        .select("shard", "doc_id", "piece", "start", "length")
    )
    crowded = pieces.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard_pieces).select("shard", F.ceil(F.col("n") / shard_pieces).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1).cast("long")))
    pieces = pieces.join(crowded, "shard", "left").withColumn("shard", F.col("shard") + F.lit(shards) * part).drop("parts")
    permitted = tuple(lengths)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        b, at, final = pack(pdf["length"].tolist(), permitted)
        b = np.array(b, np.int64)
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "bin_id": pdf["shard"].to_numpy() * (1 << 32) + b, "bin_start": np.array(at, np.int64), "bin_length": np.array(final, np.int64)[b]}
        )

    schema = f"doc_id {kind}, piece int, start long, length long, bin_id long, bin_start long, bin_length long"
    packed = pieces.groupBy("shard").applyInPandas(place, schema)
    nothing = F.lit(None).cast("long")
    blank = sized.where("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), nothing.alias("bin_id"), nothing.alias("bin_start"), nothing.alias("bin_length"))
    return packed.unionByName(blank)


def op8_packing(spark, sf_dir):
    """All documents in sequences of 512 to 4096 words."""
    from clusterloom.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
