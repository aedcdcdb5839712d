import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import tidy
from pyspark.sql import functions as F

from clusterloom.llm import ann, chat, mixing, packing, ppm, secrets
from clusterloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, duck, name):
    assert tidy(queries()[name](spark, DATA).toPandas()) == tidy(duck.execute(oracle_sql()[name]).df())


# ---- nearest neighbours


def test_recall_and_scores(spark):
    got = ann.op7_nearest(spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x, ids = np.array(e["embedding"].tolist(), np.float64), e["vec_id"].to_numpy()
    found = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine["score"]) <= 0).all()
        found += len(set(want) & set(mine["vec_id"]))
    assert found / len(got) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in ann.search(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 6, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 6, 0.5)]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_blocks_of_rows_and_odd_dimension(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))], "vec_id long, embedding array<double>")
    a, b, c = (sorted(tuple(r) for r in ann.search(df, F.col("id") % 20 == 0, k=5, rerank=100, query_block=q, row_block=n).collect()) for q, n in ((4, 30), (1000, 1000), (None, 64)))
    assert a == b == c and len(a) == 50


def test_stripes(monkeypatch):
    """The same candidates whether codes are scanned at once or in stripes, ties included."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(150, 8)).astype(np.float32), 4, 0)
    books = ann.train(x, 2.0)
    codes, q = ann.encode(x, books, 2.0), rng.normal(size=(7, 8))
    whole = [sorted(a.tolist()) for a, _ in ann.best_codes(q, codes, books, 30)]
    monkeypatch.setattr(ann, "_STRIPE", 64)
    assert [sorted(a.tolist()) for a, _ in ann.best_codes(q, codes, books, 30)] == whole
    assert all(30 <= len(a) < 200 for a in whole)


def test_recall_over_several_blocks(spark):
    """40,000 vectors as hard as those of the tables, five blocks, candidates two in a hundred."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(400, 64))
    x = centres[rng.integers(0, 400, 40_000)] * 0.6 + rng.normal(size=(40_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    pdf = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})
    got = ann.search(spark.createDataFrame(pdf), F.col("id") % 400 == 0, row_block=8000, query_block=40, sample=5000).toPandas()
    assert len(got) == 100 * 20
    found = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(np.argsort(-s)[:20].tolist()) & set(part["vec_id"]))
    assert found / len(got) >= 0.95


def test_copies_beyond_the_candidates(spark):
    """More equal vectors, and more of equal codes, than candidates are scored: the smallest ids, the best scores."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(2, 8))
    x = np.concatenate([rng.normal(size=(300, 8)) / 4, np.repeat(base[:1], 1200, 0), base[1] * (1 + 1e-9 * rng.random((900, 1)))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    asked = sorted([*ids[300:1500][::300].tolist(), *ids[1500:][::300].tolist(), int(ids[300:1500].min())])
    got = ann.search(df, F.col("id").isin(asked)).toPandas()
    for q in set(asked):
        s = ann.exact(x[ids == q], x)
        s[ids == q] = -np.inf
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == ids[np.lexsort((ids, -s))[:20]].tolist()


def test_parallel_error_weighs_more():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.train(x, 1.0)
    par = []
    for eta in (1.0, 8.0):
        c = ann.encode(x, books, eta)
        r = (x.reshape(400, 8, 2) - books[np.arange(8)[None], c]).reshape(400, 16)
        par.append(np.abs((r * x).sum(1)).mean())
    assert par[1] < 0.5 * par[0]


# ---- packing


def naive_pack(sizes, lengths, cost):
    """Best fit by looking at every open bin."""
    bins, placed = [], []
    for n, size in enumerate(sizes):
        fit = [(b["room"], -b["turn"], i) for i, b in enumerate(bins) if b["room"] >= size]
        if fit:
            i = min(fit)[2]
        else:
            left = sum(sizes[n + 1 :])
            rate = []
            for c in sorted(lengths):
                if c >= size:
                    small = sum(s for s in sizes if s <= min(c - size, size))
                    rate.append((cost(c) / (size + min(c - size, left, small)), c))
            bins.append({"room": min(rate)[1], "used": 0, "turn": 0})
            i = len(bins) - 1
        placed.append((i, bins[i]["used"]))
        bins[i]["room"] -= size
        bins[i]["used"] += size
        bins[i]["turn"] = n  # of bins with equal room the last one filled is taken
    return [p[0] for p in placed], [p[1] for p in placed], [min(c for c in lengths if c >= b["used"]) for b in bins]


def test_best_fit():
    for seed in range(20):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 120))), reverse=True)
        assert packing.pack(sizes, (16, 32, 64)) == naive_pack(sizes, (16, 32, 64), packing.cost)


def test_packed_documents(make):
    rows = [(1, "w " * 9000), (2, None), (3, " "), (4, "a b c"), (4, "a b c"), (None, "x y")] + [(i, "t " * (i * 7)) for i in range(10, 60)]
    got = packing.pack_documents(make(rows), shard_pieces=20).toPandas()
    words = sum(len((t or "").split()) for _, t in rows)
    assert got["length"].sum() == words and got["bin_id"].isna().sum() == 2
    live = got.dropna(subset=["bin_id"])
    for _, b in live.sort_values("bin_start").groupby("bin_id"):
        assert (b["bin_start"].to_numpy() == np.cumsum(b["length"]) - b["length"]).all()
        assert b["length"].sum() <= b["bin_length"].iloc[0] and b["bin_length"].iloc[0] in packing.LENGTHS
    one = live[live["doc_id"] == 1].sort_values("piece")
    assert one["start"].tolist() == [0, 4096, 8192] and one["length"].sum() == 9000
    assert packing.pack_documents(make(rows).limit(0)).count() == 0


def test_rows_of_one_id_are_spread(make):
    rows = [(7, f"w {'x ' * (i % 50)}") for i in range(300)] + [(None, "a b")] * 200 + [(i, "q r s") for i in range(100)]
    got = packing.pack_documents(make(rows), shard_pieces=20).toPandas()
    assert len(got) == 600 and got["length"].sum() == sum(len(t.split()) for _, t in rows)
    per = (got["bin_id"].astype("int64") // (1 << 32)).value_counts()
    assert per.max() <= 60
    for _, b in got.sort_values("bin_start").groupby("bin_id"):
        assert (b["bin_start"].to_numpy() == np.cumsum(b["length"]) - b["length"]).all()


# ---- mixing


def test_highest_quotients(spark):
    rng = random.Random(3)
    for n, seats in ((1, 5), (4, 7), (6, 100), (9, 3)):
        w = [float(rng.randint(1, 1000)) for _ in range(n)]
        got = [0] * n
        for _ in range(seats):
            i = max(range(n), key=lambda k: (w[k] / (2 * got[k] + 1), -k))
            got[i] += 1
        df = spark.createDataFrame([(k, w[k], seats) for k in range(n)], "k long, w double, m long")
        out = mixing.sainte_lague(df, [], ["k"], "w", "m")
        assert [r["quota"] for r in out.orderBy("k").collect()] == got


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:  # share, cap, share again
        total = sum(weight[k] for k in free)
        over = {k for k in free if left * weight[k] / total >= 2 * sizes[k]}
        if not over:
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        free -= over
    target |= {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
    assert all(abs(got[k] - target[k]) < 1e-6 for k in sizes)


def n_words(text):
    return len(re.findall(mixing.WORD, text or ""))


@pytest.mark.parametrize("shard_words,fan", [(3000, 4096), (500, 3), (10**6, 4096)])
def test_mix(make, monkeypatch, shard_words, fan):
    """Every source takes its target to the word, tiny sources too; no document exceeds twice its size."""
    monkeypatch.setattr(mixing, "FAN", fan)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 400), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(5, None), (5, "w w"), (None, "w w w", "en", "zz")]
    rows += [(1000 + k, "x " * k, "en", f"t{k:02}") for k in range(1, 21)] + [(i, "q w e r t y", "en", "q") for i in (7, 7, 7)] + [(None, "n n n n", "en", "q")] * 3
    rows += [(2000, "long " * 5000, "en", "a")]
    docs = make(rows)
    got = mixing.mix(docs, shard_words=shard_words).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    source = {(i, n_words(t)): s for i, t, _, s in (r if len(r) > 2 else (*r, "en", "s") for r in rows)}
    got["source"] = [repr(source[None if i != i else int(i), n]) for i, n in zip(got["doc_id"], got["size"], strict=True)]
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 1).all() and len(by) == 27
    again = mixing.mix(docs.repartition(7), shard_words=shard_words).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert tidy(got[key]) == tidy(again[key])
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sampled_mix(make):
    """Rows of the mix hold exactly the words that it takes; blank rows stay; columns of any name are kept."""
    rng = random.Random(2)
    rows = [(i, " \n".join(f"w{i}_{j}" for j in range(rng.randint(0, 90))), "en", rng.choice(["a", "a", "b", None])) for i in range(120)]
    rows += [(3, rows[3][1], "en", rows[3][3])] * 2 + [(None, "a b c d", "en", "b")] * 2 + [(200, None), (201, " ")]
    docs = make(rows)
    for c in ("row", "size", "__copies", "__copy", "c0", "part", "p", "target", "pieces"):
        docs = docs.withColumn(c, F.lit(c))
    out = mixing.sample_mix(docs, shard_words=700)
    assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
    got = out.toPandas()
    assert (got["row"] == "row").all() and (got["__copies"] == "__copies").all()
    took = mixing.mix(docs, shard_words=700).toPandas()
    mine = Counter()
    for i, t in zip(got["doc_id"], got["text"], strict=True):
        mine[repr(i)] += n_words(t)
    want = Counter()
    for i, n in zip(took["doc_id"], took["taken"], strict=True):
        want[repr(i)] += n
    assert +mine == +want
    texts = {r[1] for r in rows}
    cut_rows = [(t, n) for t, n in zip(got["text"], got["n_chars"], strict=True) if t not in texts]
    assert 0 < len(cut_rows) <= 2 * 12 and all(n == len(t) for t, n in cut_rows)
    assert all(any(t in " ".join((x or "").split()) for x in texts) for t, _ in cut_rows)
    assert got["doc_id"].tolist().count(200) == 1 and got["doc_id"].tolist().count(201) == 1
    assert mixing.sample_mix(docs.limit(0)).count() == 0
    again = mixing.sample_mix(docs.repartition(5), shard_words=700).select("doc_id", "text").toPandas()
    assert tidy(again) == tidy(got[["doc_id", "text"]])


# ---- chat


def test_reply_tree(spark):
    rows = [
        (1, 10, None, "user", "a <|end|> & &lt;", 0.0), (1, 11, 10, "assistant", "b", 1.0), (1, 12, 10, "assistant", None, 5.0), (1, 13, 11, "user", "c", 9.0), (1, 14, 13, "assistant", "d", None),
        (2, 1, 99, "system", "orphan", 0.0), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (None, 7, None, "user", "n", 0.0), (2, 1, 99, "system", "orphan", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double").withColumn("n_turns", F.lit(1))
    out = chat.format_paths(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    got = {(r["tree_id"], r["leaf_id"]): r for r in out}
    assert set(got) == {(1, 12), (1, 14), (2, 1), (None, 7)}  # the tree that is a circle has no root
    long = got[1, 14]
    assert [tuple(t) for t in long["turns"]] == [("user", "a <|end|> & &lt;"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert [long["formatted"][s["start"] : s["end"]] for s in long["loss_spans"]] == ["b", "d"]
    assert (long["rank"], got[1, 12]["rank"]) == (1, 2) and long["path_score"] == 10.0
    assert [r["leaf_id"] for r in chat.format_paths(df.where("tree_id = 1"), top=1).collect()] == [14]
    assert chat.format_paths(df.limit(0)).count() == 0


def test_long_chains(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i)) for i in range(70)]
    out = chat.format_paths(spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string"))
    r = out.withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [t["text"] for t in r["turns"]] == [str(i) for i in range(70)]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mix", "pack"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = after, stage(spark, after, DATA).cache()
        assert after.columns == docs.columns and after.count() > 0
        if name != "mix":
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, after, DATA)
    assert packed.agg(F.sum("length")).first()[0] == after.agg(F.sum(mixing.words(F.col("text")))).first()[0]


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "123 ½ ²"), (None, "the cat sat on the mat and the dog ran"), (None, None), (5, "the end of the day"), (5, "the end of the day"), (5, "another text of that id"),
    (6, "password=abcdef1 is the word"), (7, "the long road " * 20_000), (8, "the end of the day"), (9, "the start of the day", None), (10, "the start of the night", "en", None),
]
CLASH = ("__copies", "__copy", "__blob", "__b", "lang_pred", "score", "hash", "row", "blob2", "c0", "_0", "piece", "start", "bin_id")


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "secrets", "mix"])
def test_stages_with_odd_rows(make, spark, stage):
    """Nulls in every column, empty and long texts, ties, repeats, clashing names, empty tables."""
    import corpus_pipeline

    docs = make(ODD)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit(f"{c}!"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, DATA)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert all(r[c] == f"{c}!" for r in rows for c in CLASH)
    got = sorted((repr(r["doc_id"]), r["text"]) for r in rows if r["doc_id"] != 7 and r["text"] is not None)
    every = sorted((repr(r[0]), r[1]) for r in ODD if r[0] != 7 and r[1] is not None)
    ids = {repr(r["doc_id"]) for r in rows}
    if stage == "language":
        assert got == [x for x in every if x[0] not in ("2", "3", "4")] and "7" in ids and "1" not in ids
    elif stage == "near_duplicates":
        assert [x for x in got if x[1].strip()] == [x for x in every if x[0] != "8" and x[1].strip() and x != ("5", "the end of the day")] + [("5", "the end of the day")] or sorted(set(x for x in every if x[0] != "8" and x[1].strip())) == [x for x in got if x[1].strip()]
        assert sum(not (r["text"] or "").strip() for r in rows) == 1
    elif stage == "secrets":
        assert len(rows) == len(ODD) and ("6", "[secret] is the word") in got
    else:
        assert {"1", "2", "3"} <= ids and sum(r["text"] is None for r in rows) == 2
    nothing = docs.limit(0)
    assert run(spark, nothing, DATA).count() == 0
    gone = make([(None, None, None, None)])
    assert run(spark, gone, DATA).count() == (0 if stage == "language" else 1)


def test_language_stage_keeps_numbers_and_drops_strange_letters(make, spark):
    import corpus_pipeline

    prose = "the cat sat on the mat and the dog ran to the house, it was a long day at 4451718024887799 "
    rows = [(i, prose * 60, "en") for i in range(30)] + [(100, "4451718024887799 27.65.93.188 Arnold +1 (863) 555-9426"), (101, "слово и дело, дом и сад " * 4, None), (102, "日本語の文章です。" * 5, None), (103, "42 x")]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, make(rows), DATA).collect()}
    assert kept == {*range(30), 100, 103}


def test_last_stage_with_odd_rows(make, spark):
    import corpus_pipeline

    got = corpus_pipeline.pack(spark, make(ODD), DATA).toPandas()
    assert got["length"].sum() == sum(n_words(r[1]) for r in ODD) and got["bin_id"].isna().sum() == 4
    assert corpus_pipeline.pack(spark, make(ODD).limit(0), DATA).count() == 0


def naive_pipeline(docs):
    """What the first three stages keep, and the fourth's targets, by brute force; language and links are compared elsewhere."""
    rows = [r for r in docs if ppm.has_letter(r["text"])]
    sets = []
    for r in rows:
        w = re.findall(mixing.WORD, r["text"])
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))))
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by_shingle[x] if j < i)
        for j, n in shared.items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b, key=lambda k: rows[k]["doc_id"])] = min(a, b, key=lambda k: rows[k]["doc_id"])
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_pipeline_against_brute_force(spark):
    """Kept documents, redacted texts, words of each source and of all sequences."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = naive_pipeline(docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["secrets"](spark, stages["near_duplicates"](spark, stages["language"](spark, docs, DATA), DATA), DATA).cache()
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(got) == {r["doc_id"] for r in kept} and clean.count() == len(got)
    for r in kept:
        spans = sorted((m.start(), m.end()) for rule in secrets.ALL_RULES for m in re.finditer(rule.pattern, r["text"]) if len(m.group(rule.group)) >= rule.least)
        want, at = "", 0
        for a, b in spans:
            if b > at:
                want += r["text"][at:a] + "[secret]" if a >= at else ""
                at = b
        assert got[r["doc_id"]] == want + r["text"][at:]
    size = Counter()
    for r in clean.collect():
        size[r["source"]] += n_words(r["text"])
    taken = Counter()
    for r in stages["mix"](spark, clean, DATA).collect():
        taken[r["source"]] += n_words(r["text"])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]}:
        target |= {s: 2 * size[s] for s in over}
        left, free = 1.5 * sum(size.values()) - sum(target.values()), free - over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert packed["length"].sum() == sum(taken.values())
    for _, b in packed.dropna(subset=["bin_id"]).sort_values("bin_start").groupby("bin_id"):
        assert (b["bin_start"].to_numpy() == np.cumsum(b["length"]) - b["length"]).all() and b["length"].sum() <= b["bin_length"].iloc[0]
