"""Language identification by prediction by partial matching.

For every language a tree of byte contexts (orders 0 to ``order``) holds frozen counts
from a training sample; it has the contexts that this language's sample meets often enough,
so a language's code lengths do not depend on which others there are. The code length of a byte in its longest known context is
``-log2 n/(T+D)`` if the context has met it, else ``-log2 D/(T+D)`` (escape: T symbols
seen, D of them distinct) plus its length one order lower; below order 0 all 256 bytes
are equally likely. A text's language is the one with the shortest code for all its
bytes; ``score`` is that language's share of ``2**-bits`` over the languages.

With frozen counts a code length depends on the last ``order`` bytes only, so the
trees of all languages are laid out as one table [context, byte, language], and whole
Arrow batches are scored with array lookups: no step depends on the one before. The
table is sent to the workers; its size is bounded by the sample and checked.

Defined results
    * null text or no letter (a character of a letter category): ``und`` with score 0. Equal code lengths: the smaller language name.
    * null id: scored, never learned from. No language to learn: every text is ``und``.
    * repeated rows are scored one by one, with equal results, and learned from like any other rows.
    * empty table: empty result. Extra columns are kept by :func:`identify`. Texts are scored whole, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_BLOCK = 1 << 19


def has_letter(text: str | None) -> bool:
    """Whether a character of a letter category occurs."""
    return bool(text) and (_ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text))))


def lettered(text):
    """:func:`has_letter` as a column expression."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """Frozen statistics. Node 0 is 'no such context', node 1 the empty context; deeper nodes have larger numbers."""

    langs: list[str]
    order: int
    symbol: np.ndarray  # 256 byte values to symbols; the last symbol stands for bytes never seen
    child: np.ndarray  # [node, symbol] to node
    cost: np.ndarray  # [node * symbols, language] bits

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text [text, language]; text i is ``data[offsets[i]:offsets[i+1]]``."""
        n, sizes = len(data), np.diff(offsets)
        out = np.zeros((len(sizes), len(self.langs)))
        if not n:
            return out
        sym = self.symbol[data]
        width, line = np.int32(self.child.shape[1]), self.symbol[10]
        flat = self.child.ravel()
        before = []
        for k in range(1, self.order + 1):  # the k-th byte before; a text is preceded by line ends
            p = np.empty_like(sym)
            p[k:], p[:k] = sym[:-k] if k < n else sym[:0], line
            for j in range(k):
                at = offsets[:-1][sizes > j] + j
                p[at] = line
            before.append(p)
        owner_edges = offsets[:-1][sizes > 0]
        owners = np.flatnonzero(sizes > 0)
        for lo in range(0, n, _BLOCK):
            hi = min(n, lo + _BLOCK)
            best = np.ones(hi - lo, np.int32)
            cur = best
            for p in before:
                cur = flat[cur * width + p[lo:hi]]
                best = np.maximum(best, cur)
            c = self.cost[best * width + sym[lo:hi]]
            a, b = np.searchsorted(owner_edges, lo, "right") - 1, np.searchsorted(owner_edges, hi, "left")
            edges = np.maximum(owner_edges[a:b], lo) - lo
            out[owners[a:b]] += np.add.reduceat(c, edges, axis=0, dtype=np.float64)
        return out


def fit(texts: dict[str, list[str]], order: int = 4, min_count: int = 80, max_bytes: int = 1 << 29) -> Model:
    """A model of the given texts. A language's contexts are those that its own texts meet at least ``min_count`` times.

    A table of more than ``max_bytes`` raises ``ValueError``.
    """
    langs = sorted(texts)
    pad = b"\n" * order
    data = {k: np.frombuffer(pad + pad.join(t.encode() for t in sorted(texts[k])) + pad, np.uint8) for k in langs}
    seen = np.zeros(256, bool)
    seen[10] = True
    for x in data.values():
        seen[np.unique(x)] = True
    symbol = np.full(256, seen.sum(), np.uint16)
    symbol[seen] = np.arange(seen.sum())
    width = int(seen.sum()) + 1
    syms = {k: symbol[x].astype(np.int64) for k, x in data.items()}

    def contexts(x, k):
        key = np.zeros(len(x) - order, np.int64)
        for j in range(k, 0, -1):  # the nearest byte is the least significant digit
            key = key * width + x[order - j : len(x) - j]
        return key

    def frequent(x, k):
        keys, counts = np.unique(contexts(x, k), return_counts=True)
        return keys[counts >= min_count]

    kept = [np.unique(np.concatenate([frequent(x, k) for x in syms.values()] or [np.zeros(0, np.int64)])) for k in range(1, order + 1)]
    nodes = 2 + sum(map(len, kept))
    if nodes * width * (len(langs) + 1) * 4 > max_bytes:
        raise ValueError(f"a model of {nodes} contexts, {width} bytes and {len(langs)} languages exceeds {max_bytes} bytes: learn from fewer rows or raise min_count")
    child = np.zeros((nodes, width), np.int32)
    parent = np.ones(nodes, np.int32)
    at, last = 2, (np.zeros(1, np.int64), np.ones(1, np.int32))
    for k, keys in enumerate(kept):
        ids = np.arange(at, at + len(keys), dtype=np.int32)
        shorter, digit = keys % width**k, keys // width**k
        up = last[1][np.searchsorted(last[0], shorter)] if len(keys) else ids
        child[up, digit], parent[ids] = ids, up
        last, at = (keys, ids), at + len(keys)

    cost = np.empty((nodes, width, len(langs)), np.float32)
    for i, k in enumerate(langs):
        x = syms[k]
        now, cur = x[order:], np.ones(len(x) - order, np.int32)
        counts = np.bincount(now, minlength=width)[None, :].repeat(2, 0)
        full = np.zeros(nodes * width)
        for j in range(1, order + 1):
            cur = child[cur, x[order - j : len(x) - j]]
            full += np.bincount(cur.astype(np.int64) * width + now, minlength=nodes * width)
        full = full.reshape(nodes, width)
        full[0], full[1] = 0, counts[0]
        total, distinct = full.sum(1), (full > 0).sum(1)
        base = np.full(width, 8.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = -np.log2(full / (total + distinct)[:, None])
            escape = -np.log2(distinct / (total + distinct))
        table = np.empty((nodes, width))
        for node in range(nodes):
            low = base if node < 2 else table[parent[node]]
            own = total[node] >= min_count if node > 1 else total[node] > 0
            table[node] = low if not own else np.where(full[node] > 0, hit[node], escape[node] + low)
        cost[:, :, i] = table
    return Model(langs, order, symbol, child, cost.reshape(nodes * width, len(langs)))


def train(docs: DataFrame, docs_per_lang: int = 300, max_chars: int = 200_000, seed: int = 5, **kw) -> Model:
    """Fit on a bounded sample of labelled rows: about ``docs_per_lang`` of each language, drawn by a hash
    of the id from rows whose ``crc32(doc_id) mod 3`` is not 1, of at most ``max_chars`` characters each.
    Only the sample reaches the driver."""
    rows = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 != 1").where(F.length("text") <= max_chars)
    rows = rows.select("lang", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30)).alias("h"))
    counts = rows.groupBy("lang").count()
    share = counts.select(F.col("lang").alias("l"), F.least(F.lit(1.0), docs_per_lang / F.col("count")).alias("share"))
    picked = rows.join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.col("h") < F.col("share") * (1 << 30)).select("lang", "text")
    texts: dict[str, list[str]] = {}
    for r in picked.toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"])
    return fit(texts, **kw)


def utf8(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_ROWS = 256


def identify(docs: DataFrame, model: Model, *, text_col="text") -> DataFrame:
    """All columns of ``docs``, and ``lang_pred, score, bits_per_byte`` of every row.

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    docs = docs.drop(*[f.name for f in new])
    at = docs.columns.index(text_col)
    names = [*docs.columns, *[f.name for f in new]]

    def score(batches):
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                data, offsets = utf8(b.column(at))
                known = np.array([bool(m.langs) and has_letter(t) for t in b.column(at).to_pylist()], bool)
                if m.langs:
                    bits = m.bits(data, offsets)
                    best = bits.argmin(1)
                    least = bits[np.arange(len(bits)), best]
                    share = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
                else:
                    best, least, share = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows)
                lang = [m.langs[i] if k else UND for i, k in zip(best, known, strict=True)]
                rate = np.where(known, least / np.maximum(np.diff(offsets), 1), 0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(rate)], names)

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *new]))


def op2_language_id(spark, sf_dir):
    """The language of every document."""
    from clusterloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
