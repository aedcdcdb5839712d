"""Token ids as Parquet list columns.

Texts are range-partitioned and sorted by id, encoded, and written as one list column
per document beside small metadata columns. Token ids repeat within a vocabulary, so
the list column is dictionary-encoded; row groups and pages are kept small and
column indexes are written, so a reader can take some documents, or the metadata
alone, without reading the rest.

Encoding works on pieces between ASCII white space. The tokenizer drops white space and
no rule of it reaches across, so a text's ids are those of its pieces in order; each
distinct piece is encoded by the tokenizers library once per worker and remembered.

Defined results
    * null text: empty text, so the end id alone. Null ids sort first; equal ids by text.
    * repeated rows are encoded one by one. Empty table: empty result. Extra columns are ignored.
    * a very long text is one row, encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import scratch_path

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_SPACE = re.compile(r"[ \t\n\r]+")
_REMEMBER, _LONGEST = 400_000, 48
_state: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers.

    A piece is remembered once two batches have held it, up to ``_REMEMBER`` of them. Of the others,
    words of plain Latin letters, which the tokenizer's rules only write in lower case and leave in one
    part, go to its model as they are; so does such a word before punctuation, whose ids
    follow. All else is encoded in one call: joined by a sign that is one token and that no piece among them holds.
    """

    SIGN = "\u2605"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine; the library's own threads only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.met: set[str] = set()
        ids = self.tokenizer.encode(self.SIGN, add_special_tokens=False).ids
        self.sign = ids[0] if len(ids) == 1 else None
        self.model = self.tokenizer.model
        # The model reads bytes as letters, as the tokenizer's last rule writes them; only where that holds words go straight to it.
        self.letters = _byte_letters()
        probe = ["Éaß", "word", "ÿĀſµ"]
        self.direct = [list(self.word(w)) for w in probe] == [list(np.array(e.ids, "<u4").tobytes()) for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        self.tails: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of a word of plain letters."""
        word = word.lower()
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if self.direct:
            rest, get = [], self.known.get
            for p in pieces:
                if _plain(p):
                    out[p] = self.word(p)
                elif (m := _TAIL.fullmatch(p)) and _plain(m[1]):
                    tail = self.tails.get(m[2])
                    if tail is None:
                        tail = np.array(self.tokenizer.encode(m[2], add_special_tokens=False).ids, "<u4").tobytes()
                        if len(self.tails) < 10_000:
                            self.tails[m[2]] = tail
                    out[p] = (get(m[1]) or out.get(m[1]) or self.word(m[1])) + tail
                else:
                    rest.append(p)
            pieces = rest
        plain = [p for p in pieces if self.SIGN not in p and "<" not in p] if self.sign is not None else []
        for lo in range(0, len(plain), 20_000):
            lot = plain[lo : lo + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.SIGN} ".join(lot)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.sign)
            if len(at) == len(lot) - 1:
                raw = ids.tobytes()
                starts = [0, *(4 * at + 4).tolist()]
                stops = [*(4 * at).tolist(), len(raw)]
                out.update((p, raw[a:b]) for p, a, b in zip(lot, starts, stops, strict=True))
        rest = [p for p in pieces if p not in out]
        if rest:
            out.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split = [_SPACE.split(t) if ("\t" in t or "\r" in t) else t.replace("\n", " ").split(" ") for t in texts]
        get, found, holes = known.get, [], []
        for pieces in split:
            ids = list(map(get, pieces))
            found.append(ids)
            holes.append([i for i, v in enumerate(ids) if v is None])
        new = {pieces[i] for pieces, hole in zip(split, holes, strict=True) for i in hole}
        fresh = self.encode(list(new))
        out = []
        for pieces, ids, hole in zip(split, found, holes, strict=True):
            for i in hole:
                ids[i] = fresh[pieces[i]]
            out.append(b"".join(ids))
        again = {p for p in new & self.met if len(p) <= _LONGEST} if len(known) < _REMEMBER else set()
        known.update((p, fresh[p]) for p in again)
        if len(self.met) > _REMEMBER // 2:
            self.met.clear()
        self.met |= new
        self.met -= again
        return out


def _plain(piece: str) -> bool:
    """Whether a piece is letters below U+0180 only, whose lower case and composed form nobody disputes."""
    return piece.isalpha() and (piece.isascii() or (max(piece) < "\u0180" and "\u0130" not in piece))


#: Letters, and a run of other signs that no rule of the tokenizer breaks up or ties to letters.
_TAIL = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,./:;=?@\[\]^_`{|}~-]+)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it can be seen, else the next one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives a task."""
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def write_tokens(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, end_id: int | None = END_ID, row_group_mb: int = 16, page_rows: int = 2_000) -> None:
    """Write ``doc_id, part, start_in_part, n_tokens, tokens`` in ascending id order, one file per part."""
    from pyspark import TaskContext

    vocabulary = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def encode(batches):
        enc, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 384):
                rows = b.slice(lo, 384)
                ids = [x + tail for x in enc([t or "" for t in rows.column(1).to_pylist()])]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), lists], ["doc_id", "part", "start_in_part", "n_tokens", "tokens"]
                )
                start += int(sizes.sum())

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, f"doc_id {kind}, part int, start_in_part long, n_tokens long, tokens array<int>")
        .write.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 2 << 20)
        .option("parquet.block.size", row_group_mb << 20).option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns=("doc_id", "n_tokens", "tokens"), low=None, high=None) -> DataFrame:
    """Rows of documents ``low <= doc_id < high``; row groups and pages outside the range and other columns are not read."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") < high)
    return df.select(*columns)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, base``: ids in all parts before, from the metadata columns alone."""
    sums = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias("base"))


def op3_tokens(spark, sf_dir):
    """Encode and write all documents; digests of what the files hold."""
    from clusterloom.llm.common import table

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    stored = read_tokens(spark, path, ("doc_id", "part", "start_in_part", "tokens"))

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    read = stored.mapInArrow(digest, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(part_starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
