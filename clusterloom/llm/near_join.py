"""Similarity join on word shingles with Bayesian candidate pruning.

Two texts are linked if their sets of five-word shingles have Jaccard similarity of at
least 0.8. Words are runs of characters other than ASCII white space; a text of fewer
than five words has one shingle, all its words.

1. Texts with equal sets form a class, found by a set fingerprint of 128 bits; one text stands for it.
2. Each class has ``HASHES`` MinHash values. Bands of four make buckets (a pair at 0.8
   shares none of the 32 with probability 5e-8).
3. Within a bucket MinHash values of all pairs are compared ``STEP`` at a time. With a
   uniform prior, m agreements of n leave the posterior P(J >= 0.8 | m, n); a pair is
   dropped as soon as that is below ``TOLERANCE``. What stays is tied into clusters.
4. Within a cluster the same pruning is followed by exact intersections of the shingle
   sets, so no link rests on an estimate.

Buckets and clusters of any size are dealt in blocks of bounded rows and bytes, and a block
pair gives counts and a spanning forest, not a row for each link: a group of n near
copies costs about n * n / block rows. Copies are counted through their class and never expanded.

Defined results (:func:`near_duplicates`)
    * null, empty or blank text: the empty set. Empty sets are copies of each other and like nothing else.
    * ``class_id`` is the smallest id reached by links; ``n_links`` counts other rows with similarity of 0.8 or more, copies included.
    * null ids take part (a group's smallest non-null id names it). Repeated rows are copies.
    * empty table: empty result. Extra columns are ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import cut
from clusterloom.llm.hashing import RangeHash, blocks, mix64
from clusterloom.llm.ppm import utf8
from clusterloom.operators.components import connected_components, roots

SHINGLE, HASHES, ROWS, STEP = 5, 128, 4, 32
_BLOCK_BYTES = 1 << 24
THRESHOLD, TOLERANCE = 0.8, 1e-9
_BASE = 0x2545F4914F6CDD1D
_FACTORS = mix64(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)
_PLACE = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_MARKS = (np.uint64(1), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> tuple[int, ...]:
    """For n = step, 2 step, ...: the fewest agreements with which a pair stays."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, hashes + 1, step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        p = np.exp(log - log.max(1, keepdims=True))
        tail = p[:, x >= threshold].sum(1) / p.sum(1)
        out.append(int(np.argmax(tail >= tolerance)))
    return tuple(out)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in blocks(offsets, 1 << 20):
        own = offsets[lo : hi + 1] - offsets[lo]
        x = data[offsets[lo] : offsets[hi]]
        if not len(x):
            out += [np.zeros(0, np.uint64)] * (hi - lo)
            continue
        ink = ~_SPACE[x]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        inner = own[:-1][own[:-1] < own[1:]]
        first[inner] = ink[inner]
        last[own[1:][own[:-1] < own[1:]] - 1] = ink[own[1:][own[:-1] < own[1:]] - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        word = mix64(RangeHash(x, _BASE)(start, stop) + (stop - start).astype(np.uint64))
        edges = np.searchsorted(start, own)
        n = len(word)
        if n >= SHINGLE:
            h = word[: n - SHINGLE + 1] * _PLACE[0]
            for k in range(1, SHINGLE):
                h += word[k : n - SHINGLE + 1 + k] * _PLACE[k]
            h = mix64(h)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(h[a : b - SHINGLE + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                out.append(mix64((word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set as two signed numbers; 0 and 0 for the empty set."""
    if not len(s):
        return 0, 0
    return tuple(int(mix64(s * m + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64)) for m in _MARKS)


def signature(s: np.ndarray) -> np.ndarray:
    """16-bit MinHash values."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 1024):
        low = np.minimum(low, (s[lo : lo + 1024, None] * _FACTORS).min(0))
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys [row, band]; the band's number is in the low bits."""
    bands = HASHES // ROWS
    packed = np.ascontiguousarray(sig).view(np.uint64)
    number = np.arange(bands, dtype=np.uint64)
    return ((mix64(packed + number * np.uint64(0x632BE59BD9B4E019)) & ~np.uint64(63)) | number).astype(np.int64)


def _prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs stay after incremental comparison."""
    alive = np.arange(len(a))
    count = np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches()):
        cols = slice(i * STEP, (i + 1) * STEP)
        count = count + (sig[a[alive], cols] == sig[b[alive], cols]).sum(1, dtype=np.int32)
        keep = count >= least
        alive, count = alive[keep], count[keep]
        if not len(alive):
            break
    return alive


def _pairs_of(side: np.ndarray, start: int, stop: int, most: int = 1 << 17):
    """Index pairs of rows start..stop in bounded lots: all within a block, or across two blocks (side 0 and 1)."""
    rows = np.arange(start, stop)
    if (side[start:stop] == 2).all():
        n = stop - start
        at = 0
        while at < n - 1:
            m = max(1, min(n - 1 - at, most // n))
            i, j = np.meshgrid(rows[at : at + m], rows, indexing="ij")
            keep = j > i
            yield i[keep], j[keep]
            at += m
    else:
        left, right = rows[side[start:stop] == 0], rows[side[start:stop] == 1]
        if len(left) and len(right):
            m = max(1, most // len(right))
            for at in range(0, len(left), m):
                i, j = np.meshgrid(left[at : at + m], right, indexing="ij")
                yield i.ravel(), j.ravel()


def _groups(batches, columns: int):
    """Whole groups (equal in the first ``columns`` columns) of sorted batches, many at a time."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        n = t.num_rows
        same = np.ones(n, bool)
        for c in range(columns):
            v = t.column(c).to_numpy()
            same &= v == v[-1]
        cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut_at:
            yield t.slice(0, cut_at).combine_chunks()
        held = t.slice(cut_at)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _edges_of(t: pa.Table, columns: int) -> np.ndarray:
    """Row numbers where groups begin, and the end."""
    change = np.zeros(t.num_rows, bool)
    for c in range(columns):
        v = t.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [t.num_rows]])


def _sig_matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, HASHES)


def sketch(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, h, cid, cid2, bytes, sig``: hash of each text, its set's fingerprint, size and MinHash values."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                data, offsets = utf8(part.column(1))
                known: dict[tuple[int, int], bytes] = {}
                sets = shingles(data, offsets)
                ids = [fingerprint(s) for s in sets]
                for i, s in zip(ids, sets, strict=True):
                    if i not in known:
                        known[i] = signature(s).tobytes()
                one, two = np.array(ids, np.int64).reshape(-1, 2).T
                columns = [part.column(0), part.column(2), pa.array(one), pa.array(two), pa.array(np.diff(offsets)), pa.array([known[i] for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "cid", "cid2", "bytes", "sig"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).mapInArrow(run, f"doc_id {kind}, h long, cid long, cid2 long, bytes long, sig binary")


def told_apart(sketched: DataFrame) -> DataFrame:
    """``sketched`` with a ``cid`` that differs wherever the whole fingerprint does.

    Half of the fingerprint names a set; the few sets that share it get names of their own.
    """
    shared = sketched.groupBy("cid").agg(F.min("cid2").alias("lo"), F.max("cid2").alias("hi")).where("lo <> hi").select("cid")
    if shared.isEmpty():
        return sketched
    pairs = cut(sketched.join(shared, "cid", "left_semi").select("cid", "cid2").distinct(), "near-shared")
    new = pairs.select("cid", "cid2", F.xxhash64("cid", "cid2").alias("new"))
    return sketched.join(new, ["cid", "cid2"], "left").withColumn("cid", F.coalesce("new", "cid")).drop("new")


def _deal(members: DataFrame, key: str, block: int, *more: str) -> DataFrame:
    """Rows ``key, s, t, side, cid`` (and ``more``) of block pairs; ``members`` has ``key, cid, n`` (rows of the key) and perhaps ``volume`` (their bytes)."""
    nb = F.ceil(F.col("n") / block).cast("int")
    if "volume" in members.columns:
        nb = F.greatest(nb, F.ceil(F.col("volume") / _BLOCK_BYTES).cast("int"))
    own = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")
    other = F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))
    return (
        members.withColumn("nb", nb).withColumn("own", own).withColumn("other", F.explode(other))
        .select(key, F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"), "cid", *more)
    )


def candidates(classes: DataFrame, block: int = 1024) -> DataFrame:
    """``src, dst``: a forest over each bucket's pairs that pruning leaves."""

    def bands(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(_sig_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))], ["key", "cid"])

    banded = classes.where("cid <> 0").select("cid", "sig").mapInArrow(bands, "key long, cid long")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = _deal(banded.join(shared, "key"), "key", block)
    rows = dealt.join(classes.select("cid", "sig"), "cid").select("key", "s", "t", "side", "cid", "sig")

    def compare(batches):
        for t in _groups(batches, 3):
            key, side, cid = t.column(0).to_numpy(), t.column(3).to_numpy(), t.column(4).to_numpy()
            sig = _sig_matrix(t.column(5))
            edges = _edges_of(t, 3)
            lots, size = [], 0
            found_a, found_b = [], []

            def flush():
                nonlocal lots, size
                if not lots:
                    return
                a, b = np.concatenate([x[0] for x in lots]), np.concatenate([x[1] for x in lots])
                lots, size = [], 0
                keep = _prune(sig, a, b)
                a, b = a[keep], b[keep]
                # A pair counts in the first bucket that it shares.
                same = (sig[a] == sig[b]).reshape(len(a), HASHES // ROWS, ROWS).all(2)
                mine = same.argmax(1) == (key[a] & 63)
                found_a.append(a[mine])
                found_b.append(b[mine])

            widths = np.diff(edges)
            two = edges[:-1][widths == 2]
            if len(two):  # most buckets have two rows; blocks of other kinds are rarer
                crossing = side[two] != 2
                ok = ~crossing | (side[two] != side[two + 1])
                for lo in range(0, len(two), 1 << 16):
                    m = ok[lo : lo + (1 << 16)]
                    lots.append((two[lo : lo + (1 << 16)][m], two[lo : lo + (1 << 16)][m] + 1))
                    flush()
            for start, stop in zip(edges[:-1][widths > 2].tolist(), edges[1:][widths > 2].tolist(), strict=True):
                for a, b in _pairs_of(side, start, stop):
                    lots.append((a, b))
                    size += len(a)
                    if size >= 1 << 16:
                        flush()
            flush()
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                top = roots(len(used), at[: len(a)], at[len(a) :])
                mine = top != np.arange(len(used))
                src, dst = cid[used[top[mine]]], cid[used[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t").mapInArrow(compare, "src long, dst long").distinct()


def _exact(sets: list[np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have Jaccard similarity of at least the threshold, from bit sets of the shingles that two or more sets share."""
    flat = np.concatenate(sets)
    values, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    m = times[code] > 1
    width = (int((times > 1).sum()) + 63) // 64 or 1
    bits = np.zeros((len(sets), width * 8), np.uint8)
    at = rank[code[m]]
    np.bitwise_or.at(bits, (owner[m], at >> 3), (1 << (at & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    keep = np.zeros(len(a), bool)
    lot = max(1, (1 << 22) // width)
    for lo in range(0, len(a), lot):
        i, j = a[lo : lo + lot], b[lo : lo + lot]
        both = np.bitwise_count(words[i] & words[j]).sum(1, dtype=np.int64)
        keep[lo : lo + lot] = 10 * both >= 8 * (sizes[i] + sizes[j] - both)
    return keep


def links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col="doc_id", text_col="text", block: int = 512) -> DataFrame:
    """``cid, root, n``: for each class and block pair, the rows it is linked to and the smallest class reached there.

    ``classes`` has ``cid, rep, copies``, and ``cid2, bytes, h`` (hash of the text under that id) where ids may be repeated; ``clusters`` has ``id, component``.
    """
    full_name = "cid2" in classes.columns
    named = clusters.select(F.col("component").alias("key"), F.col("id").alias("cid")).join(classes, "cid")
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *([F.sum("bytes").alias("volume")] if full_name else []))
    extra = ["h", "cid2"] if full_name else []
    member = named.select("key", "cid", "rep", "copies", *extra).join(sizes, "key")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if full_name:
        texts = texts.withColumn("h", F.xxhash64("text"))
    on = [texts["doc_id"].eqNullSafe(member["rep"]), *([texts["h"] == member["h"]] if full_name else [])]
    full = texts.join(member, on).select("key", *[c for c in ("n", "volume") if c in sizes.columns], "cid", "copies", "text", (F.col("cid2") if full_name else F.lit(None).cast("long")).alias("mark"))
    dealt = _deal(full, "key", block, "copies", "text", "mark")

    def verify(batches):
        for t in _groups(batches, 3):
            edges = _edges_of(t, 3)
            out = []
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                g = t.slice(start, stop - start)
                cid, side, copies = g.column(4).to_numpy(), g.column(3).to_numpy(), g.column(5).to_numpy()
                sets = shingles(*utf8(g.column(6)))
                mark = g.column(7)
                # An id may be repeated, with the same text or another one; the fingerprint tells.
                _, once = np.unique(cid, return_index=True)
                ok = [i for i in once.tolist() if fingerprint(sets[i])[1] == mark[i].as_py() or not mark[i].is_valid]
                cid, side, copies, sets = cid[ok], side[ok], copies[ok], [sets[i] for i in ok]
                if len(ok) < 2:
                    continue
                size = np.array([len(s) for s in sets], np.int64)
                sig = np.stack([signature(s) for s in sets])
                found_a, found_b = [], []
                for a, b in _pairs_of(side, 0, len(ok)):
                    near = 10 * np.minimum(size[a], size[b]) >= 8 * np.maximum(size[a], size[b])
                    a, b = a[near], b[near]
                    keep = _prune(sig, a, b)
                    found_a.append(a[keep])
                    found_b.append(b[keep])
                a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_a, found_b))
                if not len(a):
                    continue
                good = _exact(sets, size, a, b)
                a, b = a[good], b[good]
                n = np.bincount(a, copies[b], len(ok)) + np.bincount(b, copies[a], len(ok))
                root = roots(len(ok), a, b)
                m = n > 0
                out.append((cid[m], cid[root[m]], n[m].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["cid", "root", "n"])

    return dealt.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t").mapInArrow(verify, "cid long, root long, n long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketch of all rows, and ``cid, rep, h, copies, n, component`` of the different sets: the row that stands for each, and its group."""
    sketched = told_apart(cut(sketch(docs, id_col, text_col), "near-sketch"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    classes = sketched.groupBy("cid").agg(first, F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("cid2").alias("cid2"), F.max("bytes").alias("bytes"))
    classes = cut(classes.select("cid", "cid2", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("h"), "copies", "bytes", "sig"), "near-classes")
    clusters = connected_components(cut(candidates(classes), "near-candidates"))
    found = cut(links(docs, classes, clusters, id_col, text_col), "near-links")
    groups = connected_components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    n = found.groupBy("cid").agg(F.sum("n").alias("n"))
    named = classes.select("cid", "rep", "h", "copies").join(n, "cid", "left").join(groups.select(F.col("id").alias("cid"), "component"), "cid", "left")
    return sketched, named.withColumn("component", F.coalesce("component", "cid"))


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, class_id, n_links`` of every row."""
    sketched, named = _grouped(docs, id_col, text_col)
    head = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    per_class = named.join(head, "component").select("cid", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return sketched.select("doc_id", "cid").join(per_class, "cid").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: of the smallest id (null is last), and of its texts there the one of the smallest hash.

    Columns as in ``docs``, whatever their names. Rows equal in id and text are copies: one of them stays.
    Null, empty and blank texts are one group.
    """
    names = docs.columns
    _, named = _grouped(docs, "doc_id", "text")
    found = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "h")).alias("first")).select(F.col("first.rep").alias("__id"), F.col("first.h").alias("__h"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = F.col(f"c{names.index('doc_id')}")
    hashed = plain.withColumn("hash", F.xxhash64(f"c{names.index('text')}"))
    kept = hashed.join(found, key.eqNullSafe(found["__id"]) & (hashed["hash"] == found["__h"]), "left_semi")
    return kept.dropDuplicates([f"c{names.index('doc_id')}", "hash"]).drop("hash").toDF(*names)


def op5_near_join(spark, sf_dir):
    """Near-duplicate classes of all documents."""
    from clusterloom.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
