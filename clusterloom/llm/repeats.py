"""Exact removal of repeated 100-byte strings, with run-length indexes.

A byte goes if some 100-byte string that covers it also starts earlier: in a document of
smaller id, or earlier in the same one. The work is split so that no task needs the corpus:

1. Every 100-byte window belongs to the 32-byte string in it with the smallest hash (its
   anchor), whatever surrounds it. Consecutive windows with one anchor make a segment.
   Equal windows have equal anchors, so an anchor's segments can be judged on their own.
2. Segments equal to an earlier one are found by hash; all their bytes go. Each batch of
   texts first settles its own copies, so a passage in a third of all documents
   costs one row per batch.
3. Where an anchor has segments that differ, their bytes are fetched. A bucket of anchors
   is settled by halving: a run-length index of the earlier half of every anchor's
   segments is built, the later half is streamed through it as patterns, and matching
   statistics of 100 or more mark windows; then both halves are treated alike.
4. Marked ranges are joined and cut out of the texts.

Defined results (:func:`remove_repeats`)
    * null text is the empty text. Texts under 100 bytes lose nothing.
    * null id: before all others. Rows that repeat an id follow each other by a hash of
      their texts; rows equal in both are one document, each with the same result.
    * empty table: empty result. Extra columns are ignored. Ids are integers. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import cut
from clusterloom.llm.hashing import RangeHash, blocks, mix64
from clusterloom.llm.near_join import _edges_of, _groups
from clusterloom.llm.ppm import utf8
from clusterloom.llm.rindex import SEPARATOR, RunIndex

WINDOW, ANCHOR = 100, 32
_BASE = 0x5851F42D4C957F2D
_BLOCK = 1 << 21
_NULL_ID = -(1 << 63)
#: An anchor with more different segments than this is split by longer contexts.
CROWDED = 8192
_BUCKET_BYTES = 1 << 20


def segments(data: np.ndarray, offsets: np.ndarray):
    """Row, start, windows, anchor hash, segment hash and anchor place of all segments, in order."""
    out = []
    for lo, hi in blocks(offsets, _BLOCK):
        own = offsets[lo : hi + 1]
        if hi - lo == 1 and own[1] - own[0] > 2 * _BLOCK:  # a long text: blocks of windows that overlap
            for a in range(int(own[0]), int(own[1]) - WINDOW + 1, _BLOCK):
                b = min(int(own[1]), a + _BLOCK + WINDOW - 1)
                r = _segments(data[a:b], np.array([0, b - a]))
                out.append((r[0] + lo, r[1] + (a - own[0]), *r[2:]))
        elif own[-1] - own[0] >= WINDOW:
            r = _segments(data[own[0] : own[-1]], own - own[0])
            out.append((r[0] + lo, *r[1:]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e, e
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _segments(x: np.ndarray, offsets: np.ndarray):
    w, n = WINDOW - ANCHOR + 1, len(x)
    hashes = RangeHash(x, _BASE)
    m = n - ANCHOR + 1
    if m < w:
        return (np.zeros(0, np.int64),) * 6
    grams = mix64((hashes.sums[ANCHOR:] - hashes.sums[:m]) * hashes.back[:m])
    low = np.uint64((1 << 23) - 1)  # the place breaks ties: leftmost
    key = (grams & ~low) | np.arange(m, dtype=np.uint64)
    # Sliding minimum from minima of blocks of w, forwards and backwards.
    table = np.concatenate([key, np.full(-m % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    k = m - w + 1
    place = (np.minimum(backward[:k], forward[w - 1 : w - 1 + k]) & low).astype(np.int64)
    valid = np.zeros(k + 1, np.int8)
    sizes = np.diff(offsets)
    full = sizes >= WINDOW
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - WINDOW + 1, -1)
    valid = np.cumsum(valid)[:k].astype(bool)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    first = offsets[:-1][full]
    fresh[first] = True
    last = valid.copy()
    last[:-1] &= ~valid[1:] | fresh[1:]
    start, stop = np.flatnonzero(fresh), np.flatnonzero(last)
    row = np.searchsorted(offsets, start, "right") - 1
    at = place[start]
    seg = mix64(hashes(start, stop + WINDOW) + (stop - start).astype(np.uint64))
    return row, start - offsets[row], stop - start + 1, grams[at].view(np.int64), seg.view(np.int64), at - start


def _joined(row: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Ranges of the same row that touch or overlap become one; input in order of row and start."""
    if not len(row):
        return row, start, size
    stop = start + size
    big = np.int64(1) << 40
    reach = np.maximum.accumulate(row * big + stop)  # rows ascend, so a former row never reaches into this one
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] * big + start[1:] > reach[:-1]
    i = np.flatnonzero(fresh)
    last = np.concatenate([i[1:], [len(row)]]) - 1
    return row[i], start[i], reach[last] - row[i] * big - start[i]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc, sub, text``: ids as numbers, and the place of a row among those that repeat its id; all rows, and one of those that are equal."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    twice = d.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    if twice.isEmpty():
        rows = d.select("doc", F.lit(0).cast("long").alias("sub"), "text")
        return rows, rows
    h = d.withColumn("h", F.xxhash64("text"))
    rank = h.select("doc", "h").join(twice, "doc", "left_semi").groupBy("doc", "h").agg(F.count(F.lit(1)).alias("m")).withColumn("sub", (F.row_number().over(Window.partitionBy("doc").orderBy("h")) - 1).cast("long"))
    rows = h.join(rank, ["doc", "h"], "left").select("doc", F.coalesce("sub", F.lit(0).cast("long")).alias("sub"), "text", F.coalesce("m", F.lit(1)).alias("m"))
    once = rows.where("m = 1").unionByName(rows.where("m > 1").dropDuplicates(["doc", "sub", "text"]))
    return rows.drop("m"), once.drop("m")


def _first_pass(rows: DataFrame) -> DataFrame:
    """``anchor, seg, doc, sub, start, size``: segments that no earlier one of the batch equals, and (seg null) ranges that surely go."""

    def run(batches):
        for b in batches:
            doc, sub = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((sub, doc))  # earlier documents first
            b = b.take(pa.array(order))
            doc, sub = doc[order], sub[order]
            row, start, windows, anchor, seg, _ = segments(*utf8(b.column(2)))
            if not len(row):
                continue
            _, first = np.unique(seg, return_index=True)  # the first of equal ones
            keep = np.zeros(len(seg), bool)
            keep[first] = True
            r, s, z = _joined(row[~keep], start[~keep], windows[~keep] + WINDOW - 1)
            i = np.flatnonzero(keep)
            none = np.zeros(len(r), np.int64)
            spread = mix64(doc[r].astype(np.uint64) + s.astype(np.uint64)).view(np.int64)
            cols = [
                np.concatenate([anchor[i], spread]), np.concatenate([seg[i], none]), np.concatenate([doc[row[i]], doc[r]]), np.concatenate([sub[row[i]], sub[r]]),
                np.concatenate([start[i], s]), np.concatenate([windows[i], -z]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "seg", "doc", "sub", "start", "size"])

    return rows.mapInArrow(run, "anchor long, seg long, doc long, sub long, start long, size long")


def _second_pass(parts: DataFrame) -> DataFrame:
    """``crowd, anchor, doc, sub, start, size``: ranges that go (crowd -1), and first segments of anchors that have several (windows; crowd: how many)."""

    def run(batches):
        for t in _groups(batches, 1):
            anchor, seg, doc, sub, start, size = (t.column(i).to_numpy() for i in range(6))
            sure = size < 0
            i = np.flatnonzero(~sure)
            a, s = anchor[i], seg[i]
            fresh = np.ones(len(i), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
            again = i[~fresh]
            firsts = i[fresh]
            _, which, times = np.unique(anchor[firsts], return_inverse=True, return_counts=True)
            crowd = times[which] if len(firsts) else np.zeros(0, np.int64)
            several = crowd > 1
            firsts, crowd = firsts[several], crowd[several]
            gone = np.concatenate([np.flatnonzero(sure), again])
            sizes = np.concatenate([-size[sure], size[again] + WINDOW - 1, size[firsts]])
            pick = np.concatenate([gone, firsts])
            crowd = np.concatenate([np.full(len(gone), -1, np.int64), crowd.astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (crowd, anchor[pick], doc[pick], sub[pick], start[pick], sizes)], ["crowd", "anchor", "doc", "sub", "start", "size"])

    sorted_ = parts.repartition("anchor").sortWithinPartitions("anchor", "seg", "doc", "sub", "start")
    return sorted_.mapInArrow(run, "crowd long, anchor long, doc long, sub long, start long, size long")


def _fetch(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """``key, doc, sub, start, bytes`` of the segments in ``open_``.

    Segments of a crowded anchor are cut into pieces of at most four windows, keyed by the 97
    bytes that those windows share, so that a bucket holds only strings that are
    nearly equal.
    """
    wanted = open_.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "size", "anchor", "crowd")).alias("want"))

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(2))
            raw = data.tobytes()
            keys, at, owner, out = [], [], [], []
            for i, want in enumerate(b.column(3).to_pylist()):
                base = int(offsets[i])
                for w in want:
                    s, n = w["start"], w["size"]
                    if w["crowd"] <= CROWDED:
                        pieces = [(w["anchor"], s, n)]
                    else:
                        text = data[base + s : base + s + n + WINDOW - 1]
                        place = _segments(text, np.array([0, len(text)]))[5][0]
                        fours: dict[int, list[int]] = {}
                        for lo in range(n):  # windows by the anchor's place in them, in fours
                            fours.setdefault((int(place) - lo) // 4, []).append(lo)
                        pieces = []
                        for four, los in fours.items():
                            middle = base + s + int(place) - 4 * four  # all four windows hold these 97 bytes
                            shared = hashlib.blake2b(raw[middle : middle + WINDOW - 3], digest_size=8).digest()
                            pieces.append((int.from_bytes(shared, "little", signed=True) ^ w["anchor"], s + los[0], len(los)))
                    for key, p, m in pieces:
                        keys.append(key)
                        at.append(p)
                        owner.append(i)
                        out.append(raw[base + p : base + p + m + WINDOW - 1])
            doc, sub = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo in range(0, len(keys), 50_000):
                o = np.array(owner[lo : lo + 50_000], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo : lo + 50_000], pa.int64()), pa.array(doc[o]), pa.array(sub[o]), pa.array(at[lo : lo + 50_000], pa.int64()), pa.array(out[lo : lo + 50_000], pa.binary())], ["key", "doc", "sub", "start", "bytes"]
                )

    return rows.join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "want").mapInArrow(run, "key long, doc long, sub long, start long, bytes binary")


_TAGS = 254


def _symbols(strings: list[bytes], tags: list[int], end: bool) -> np.ndarray:
    """Strings one after another as 16-bit symbols: a byte, and above it the string's tag; if ``end``, each ended by a separator."""
    sizes = np.array([len(x) for x in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.repeat(np.array(tags, np.uint16) << 8, sizes)
    return np.insert(flat, np.cumsum(sizes), SEPARATOR) if end else flat


def settle(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    """For each string of each group, at which places a window starts that an earlier string of the group holds.

    Ranges of one group that are halved at the same time get different tags, so that a string
    meets no later one; equal windows of different groups do not exist.
    """
    marks = [[np.zeros(max(0, len(s) - WINDOW + 1), bool) for s in g] for g in groups]
    level = [(i, 0, len(g)) for i, g in enumerate(groups) if len(g) > 1]
    while level:
        turns: dict[int, list[tuple[int, int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        for i, lo, hi in level:
            k = seen.get(i, 0)
            seen[i] = k + 1
            turns.setdefault(k // _TAGS, []).append((i, lo, (lo + hi) // 2, hi, k % _TAGS))
        for halves in turns.values():
            early = [(groups[i][j], tag) for i, lo, mid, _, tag in halves for j in range(lo, mid)]
            late = [(i, j, tag) for i, _, mid, hi, tag in halves for j in range(mid, hi)]
            index = RunIndex(_symbols(*map(list, zip(*early, strict=True)), end=True))
            patterns = [groups[i][j] for i, j, _ in late]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in patterns])]).astype(np.int64)
            found = index.matching_statistics(_symbols(patterns, [t for *_, t in late], end=False), offsets) >= WINDOW
            for (i, j, _), a in zip(late, offsets[:-1].tolist(), strict=True):
                marks[i][j] |= found[a : a + len(marks[i][j])]
        level = [x for i, lo, hi in level for x in ((i, lo, (lo + hi) // 2), (i, (lo + hi) // 2, hi)) if x[2] - x[1] > 1]
    return marks


def _resolve(pieces: DataFrame) -> DataFrame:
    """``doc, sub, start, size``: ranges of differing segments that go."""

    def run(batches):
        for t in _groups(batches, 1):
            edges = _edges_of(t, 1)
            edges = edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1]
            held, rows, size = [], [], 0
            doc, sub, start = (t.column(i).to_numpy() for i in (1, 2, 3))

            def flush():
                nonlocal held, rows, size
                out = []
                for at, marks in zip(rows, settle(held), strict=True):
                    for r, m in zip(at, marks, strict=True):
                        i = np.flatnonzero(m)
                        if len(i):
                            _, s, z = _joined(np.zeros(len(i), np.int64), i, np.full(len(i), WINDOW))
                            out += [(doc[r], sub[r], start[r] + a, b) for a, b in zip(s.tolist(), z.tolist(), strict=True)]
                held, rows, size = [], [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], ["doc", "sub", "start", "size"])

            again = []
            for lo, hi in zip(edges[0].tolist(), edges[1].tolist(), strict=True):
                seen: dict[bytes, int] = {}
                strings, at = [], []
                for r, s in zip(range(lo, hi), t.column(4).slice(lo, hi - lo).to_pylist(), strict=True):
                    if s in seen:
                        again.append((doc[r], sub[r], start[r], len(s)))
                    else:
                        seen[s] = r
                        strings.append(s)
                        at.append(r)
                if len(strings) > 1:
                    held.append(strings)
                    rows.append(at)
                    size += sum(map(len, strings))
                    if size >= 2 * _BUCKET_BYTES:
                        yield from flush()
            if held:
                yield from flush()
            if again:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*again, strict=True)], ["doc", "sub", "start", "size"])

    return pieces.repartition("key").sortWithinPartitions("key", "doc", "sub", "start").mapInArrow(run, "doc long, sub long, start long, size long")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``doc, sub, start, size``: ranges (they may overlap) whose bytes go."""
    passed = cut(_second_pass(_first_pass(rows)), "repeat-ranges")
    sure = passed.where("crowd < 0").select("doc", "sub", "start", "size")
    # Not cut: in one plan with what follows, the texts are shuffled once for both joins.
    return sure.unionByName(_resolve(_fetch(rows, passed.where("crowd > 0"))))


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``spans, kept``: removed byte ranges and remaining bytes) of every row."""
    rows, once = _numbered(docs, id_col, text_col)
    gone = repeated_ranges(once).groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "size")).alias("gone"))

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            raw, out = raw.tobytes(), []
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            base = int(ends[0]) if len(ends) else 0
            starts, sizes = (flat.field(k).to_numpy() if len(flat) else np.zeros(0, np.int64) for k in (0, 1))
            for i in range(b.num_rows):
                text = raw[int(offsets[i]) : int(offsets[i + 1])]
                lo, hi = int(ends[i]) - base, int(ends[i + 1]) - base
                spans, kept = [], text
                if hi > lo and lists[i].is_valid:
                    o = np.argsort(starts[lo:hi], kind="stable")
                    _, s, z = _joined(np.zeros(hi - lo, np.int64), starts[lo:hi][o], sizes[lo:hi][o])
                    spans = list(zip(s.tolist(), (s + z).tolist(), strict=True))
                    edges = [0, *[e for x in spans for e in x], len(text)]
                    kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in spans] if with_text else None, kept if with_text else None))
            n, r, k, h, sp, kp = zip(*out, strict=True) if out else ([],) * 6
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string()), pa.array(sp, span_type), pa.array(kp, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            )

    joined = rows.join(gone, ["doc", "sub"], "left").select("doc", "text", "gone")
    done = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary")
    id_ = F.when(F.col("doc") != _NULL_ID, F.col("doc")).cast(docs.schema[id_col].dataType).alias("doc_id")
    return done.select(id_, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_text else []))


def op6_repeats(spark, sf_dir):
    """All documents without their repeated 100-byte strings."""
    from clusterloom.llm.common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
