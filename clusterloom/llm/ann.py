"""Approximate maximum-inner-product search with anisotropic quantisation.

Vectors are split into pairs of components; each pair is stored as a 4-bit code. For an
inner-product search the residual parallel to the vector matters more than the residual
across it, so codebooks and codes minimise ``eta * |r_par|^2 + |r_orth|^2`` (eta from the
score threshold of the search). Codes are chosen by coordinate descent on that loss.

Equal vectors are coded and scanned once, for their k + 1 smallest ids: no query needs more
of them. A query scans all codes with its 16-entry tables, and the best ``rerank`` candidates
over all blocks, with all that tie with the last of them, get their exact inner product,
so a reported score is always exact and no choice depends on the order of rows.

Rows are dealt into blocks of bounded size; each (query block, candidate block) pair is
one task group. The scan ships codes only (four bits for two components); the vectors
go to the second step, where they meet the candidates that are left. The codebooks come
from a bounded sample (``sample`` rows); every row is coded and scanned.

Defined results
    * vectors that are null, zero, or hold null or non-finite components take no part;
      nor do those whose length is not the most frequent one (ties: the longer), as they have no inner product with the others.
    * fewer than k candidates: all of them. Equal scores: the smaller id.
    * repeated ids: the row with the smaller vector stays. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import cut

CODES = 16


def eta_for(dim: int, threshold: float) -> float:
    """Weight of the parallel residual for unit vectors and scores above ``threshold``."""
    t2 = threshold * threshold
    return max(1.0, (dim - 1) * t2 / (1 - t2))


def _padded(x: np.ndarray) -> np.ndarray:
    return x if x.shape[1] % 2 == 0 else np.hstack([x, np.zeros((len(x), 1), x.dtype)])


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 3) -> np.ndarray:
    """Codes [row, pair] that minimise the anisotropic loss by coordinate descent."""
    x = _padded(np.asarray(x, np.float32))
    n, pairs = len(x), x.shape[1] // 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sub, dirs = x.reshape(n, pairs, 2), unit.reshape(n, pairs, 2)
    codes = np.empty((n, pairs), np.uint8)
    for p in range(pairs):
        codes[:, p] = ((sub[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1)
    rest = sub - books[np.arange(pairs)[None, :], codes]
    along = (rest * dirs).sum(2)
    total = along.sum(1)
    rows = np.arange(n)
    for _ in range(rounds):
        changed = False
        for p in range(pairs):
            r = sub[:, p, None, :] - books[p][None]  # residual of this pair under each code
            par = (r * dirs[:, p, None, :]).sum(2)
            loss = (r * r).sum(2) + (eta - 1) * ((total - along[:, p])[:, None] + par) ** 2
            best = loss.argmin(1).astype(np.uint8)
            changed |= bool((best != codes[:, p]).any())
            codes[:, p] = best
            total += par[rows, best] - along[:, p]
            along[:, p] = par[rows, best]
        if not changed:
            break
    return codes


def train(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Codebooks [pair, code, 2]: k-means start, then alternating anisotropic codes and centre updates."""
    x = _padded(np.asarray(x, np.float32))
    n, pairs = len(x), x.shape[1] // 2
    sub = x.reshape(n, pairs, 2)
    rng = np.random.default_rng(seed)
    books = np.stack([sub[rng.choice(n, CODES, replace=n < CODES), p] for p in range(pairs)])
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, pairs, 2)
    for i in range(rounds):
        codes = encode(x, books, eta if i >= rounds // 2 else 1.0, 1)
        fitted = books[np.arange(pairs)[None, :], codes]
        total = ((sub - fitted) * unit).sum((1, 2))
        for p in range(pairs):
            gap = total - ((sub[:, p] - fitted[:, p]) * unit[:, p]).sum(1)  # parallel residual of the other pairs
            for c in range(CODES):
                m = codes[:, p] == c
                if not m.any():
                    continue
                u, w = unit[m, p], (eta - 1 if i >= rounds // 2 else 0.0)
                # Minimise sum |s - c|^2 + w (g + u.(s - c))^2 over the centre c.
                a = np.eye(2) * m.sum() + w * (u.T @ u)
                b = sub[m, p].sum(0) + w * ((gap[m] + (u * sub[m, p]).sum(1))[:, None] * u).sum(0)
                books[p, c] = np.linalg.solve(a, b)
    return books


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate scores [query, row]: sums of 4-bit table entries; two codes are read at a time."""
    q = _padded(np.asarray(queries, np.float32))
    pairs = len(books)
    tables = np.einsum("qpd,pcd->pqc", q.reshape(len(q), pairs, 2), books)
    out = np.zeros((len(q), len(codes)), np.float32)
    for p in range(0, pairs - 1, 2):
        both = (tables[p][:, :, None] + tables[p + 1][:, None, :]).reshape(len(q), CODES * CODES)
        out += np.take(both, codes[:, p].astype(np.intp) * CODES + codes[:, p + 1], axis=1)
    if pairs % 2:
        out += np.take(tables[-1], codes[:, -1], axis=1)
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added in order."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows that take part, one per id."""
    v = F.col("v")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(~bad & F.exists(v, lambda e: e != 0)).withColumn("dim", F.size("v"))
    common = rows.groupBy("dim").count().agg(F.max_by("dim", F.struct("count", "dim")).alias("common"))
    first = Window.partitionBy("id").orderBy("v")
    return rows.join(F.broadcast(common), F.col("dim") == F.col("common")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("id", "v")


def _groups(good: DataFrame, most: int) -> DataFrame:
    """``id, ids, v``: each different vector with its smallest id, and its ``most`` smallest ids in order."""
    first = Window.partitionBy("v").orderBy("id")  # limited before the shuffle, so a common vector is no large group
    few = good.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "v")


def _unpacked(codes: list[bytes], pairs: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    return out[:, :pairs]


_STRIPE = 32_768


def best_codes(q: np.ndarray, codes: np.ndarray, books: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of its ``top`` largest approximate scores, with all that tie with the last, and these scores; stripe by stripe."""
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(q)
    for lo in range(0, len(codes), _STRIPE):
        approx = scan(q, codes[lo : lo + _STRIPE], books)
        few = min(top, approx.shape[1])
        least = np.partition(approx, approx.shape[1] - few, axis=1)[:, approx.shape[1] - few]
        for i, row in enumerate(approx):
            near = np.flatnonzero(row >= least[i])
            rows, scores = np.concatenate([kept[i][0], near + lo]), np.concatenate([kept[i][1], row[near]])
            if len(rows) > top:
                m = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
                rows, scores = rows[m], scores[m]
            kept[i] = rows, scores
    return kept


def search(rows: DataFrame, is_query, *, id_col="vec_id", vec_col="embedding", k=20, rerank=800, sample=20_000, threshold=0.3, query_block=None, row_block=262_144, seed=3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each query row among all other rows.

    ``is_query`` is a condition on the column ``id``. ``sample`` bounds the rows that train the codebooks.
    Queries go in blocks of 256 to 4096, as many as keep all cores busy (``query_block`` sets their size).
    """
    spark = rows.sparkSession
    good = cut(valid_vectors(rows, id_col, vec_col), "ann-rows")
    h = F.xxhash64("id", F.lit(seed))
    n, n_queries = good.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    kind = good.schema["id"].dataType.simpleString()
    if not n or not n_queries:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    share = min(1.0, sample / n)
    drawn = good.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("id").select("v").limit(2 * sample).toPandas()
    x = np.array(drawn["v"].tolist() if len(drawn) else good.select("v").limit(1).toPandas()["v"].tolist())
    eta = eta_for(x.shape[1], threshold)
    books = train(x, eta, seed=seed)
    del drawn, x

    blocks_r = -(-n // row_block)
    if query_block is None:
        query_block = max(256, min(4096, -(-n_queries * blocks_r // (2 * spark.sparkContext.defaultParallelism))))
    blocks_q = -(-n_queries // query_block)
    shared = spark.sparkContext.broadcast((books, eta))
    top = rerank + 1  # one of them may be the query itself

    def code(batches):
        books, eta = shared.value
        for pdf in batches:
            if len(pdf):
                c = encode(np.array(pdf["v"].tolist()), books, eta)
                c = c if c.shape[1] % 2 == 0 else np.hstack([c, np.zeros((len(c), 1), np.uint8)])
                yield pdf.assign(codes=[r.tobytes() for r in (c[:, ::2] << 4) | c[:, 1::2]])

    deal = lambda m: F.pmod(h, F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    coded = cut(_groups(good, k + 1).mapInPandas(code, f"id {kind}, ids array<{kind}>, v array<double>, codes binary"), "ann-codes")
    asked = good.where(is_query)

    def nominate(key, qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        books, _ = shared.value
        if not len(qs) or not len(rs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "approx": []})
        q, q_id, r_id, codes = np.array(qs["v"].tolist()), qs["id"].to_numpy(), rs["id"].to_numpy(), _unpacked(rs["codes"].tolist(), len(books))
        out = []
        for lo in range(0, len(q), 64):
            for i, (near, scores) in enumerate(best_codes(q[lo : lo + 64], codes, books, top), lo):
                out.append((np.full(len(near), q_id[i]), r_id[near], scores))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "approx": c})

    left = asked.select(deal(blocks_q).alias("qb"), each(blocks_r).alias("rb"), "id", "v")
    right = coded.select(each(blocks_q).alias("qb"), deal(blocks_r).alias("rb"), "id", "codes")
    nominees = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(nominate, f"query_id {kind}, vec_id {kind}, approx float")
    best = Window.partitionBy("query_id").orderBy(F.desc("approx"))
    chosen = nominees.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= top) if blocks_r > 1 else nominees

    # Second step: candidates meet their vectors, in blocks of rows and of many queries.
    wide = max(1, -(-blocks_q // 16))
    part = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(wide)).cast("int")
    small = max(1, -(-n // 32_768))
    of_row = lambda c: F.pmod(F.xxhash64(c, F.lit(seed + 1)), F.lit(small)).cast("int")
    lists = chosen.select("query_id", "vec_id", of_row("vec_id").alias("rb")).groupBy("query_id", "rb").agg(F.collect_list("vec_id").alias("candidates"))
    lists = lists.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").withColumn("qp", part)
    vectors = coded.select(each(wide).alias("qp"), of_row("id").alias("rb"), "id", "ids", "v")

    def score(key, ls: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(ls) or not len(rs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        order = np.argsort(rs["id"].to_numpy(), kind="stable")
        x, r_id, members = np.array(rs["v"].tolist())[order], rs["id"].to_numpy()[order], rs["ids"].to_numpy()[order]
        out = []
        for q_id, q, candidates in zip(ls["query_id"], ls["q"], ls["candidates"], strict=True):
            at = np.searchsorted(r_id, np.sort(candidates))
            s = exact(np.asarray(q)[None], x[at])
            near = np.lexsort((r_id[at], -s))[: k + 1]  # one of them may be the query alone
            ids, s = np.concatenate(members[at[near]]), np.repeat(s[near], [len(m) for m in members[at[near]]])
            ids, s = ids[ids != q_id], s[ids != q_id]
            near = np.lexsort((ids, -s))[:k]
            out.append((np.full(len(near), q_id), ids[near], s[near]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    found = lists.groupBy("qp", "rb").cogroup(vectors.groupBy("qp", "rb")).applyInPandas(score, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, sf_dir):
    """20 nearest of every vector whose id is divisible by 20."""
    from clusterloom.llm.common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
