import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.llm import near_join, ppm, repeats, secrets
from clusterloom.llm.rindex import SEPARATOR, RunIndex

DATA = "/root/testdata/sf0.001"


# ---- language


def naive_bits(train, text, order, min_count, langs, lang):
    """Code length by walking down the orders."""
    pad = "\n" * order
    streams = {k: (pad + pad.join(sorted(v)) + pad).encode() for k, v in train.items()}
    total = Counter()
    own = defaultdict(Counter)
    s = streams[lang]
    for i in range(order, len(s)):
        for o in range(order + 1):
            c = s[i - o : i]
            total[c] += o > 0
            own[c][s[i]] += 1
    kept = {c for c, n in total.items() if n >= min_count} | {b""}
    data, bits = (pad + text).encode(), 0.0
    for i in range(order, len(data)):
        best = max((o for o in range(order + 1) if all(data[i - j : i] in kept for j in range(o + 1))), default=0)
        for o in range(best, -1, -1):
            c = own[data[i - o : i]]
            t, d = sum(c.values()), len(c)
            if not t:
                continue
            if c[data[i]]:
                bits -= math.log2(c[data[i]] / (t + d))
                break
            bits -= math.log2(d / (t + d))
        else:
            bits += 8
    return bits


def test_code_lengths():
    train = {"a": ["the cat sat on the mat", "the hat"], "b": ["der hund und die katze", "und der hut é"]}
    m = ppm.fit(train, order=3, min_count=2)
    for text in ("the mat", "katze ß und", "x", "zz\nthe"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = m.bits(raw, np.array([0, len(raw)]))[0]
        for i, lang in enumerate(m.langs):
            assert abs(got[i] - naive_bits(train, text, 3, 2, m.langs, lang)) < 1e-3


def test_a_language_does_not_depend_on_others():
    """Code lengths of a language stay when others are learned beside it; a model beyond its bound is refused."""
    train = {k: [" ".join(random.Random(n).choices([f"{k}{i:x}" for i in range(60)], k=400))] for n, k in enumerate("abcdefgh")}
    some, every = ppm.fit({k: train[k] for k in "ab"}, min_count=3), ppm.fit(train, min_count=3)
    for text in ("a3 b7 a1f", train["a"][0], "b b b b0 1"):
        raw = np.frombuffer(text.encode(), np.uint8)
        one, two = (m.bits(raw, np.array([0, len(raw)]))[0][:2] for m in (some, every))
        assert np.allclose(one, two, atol=1e-3)
    with pytest.raises(ValueError):
        ppm.fit(train, min_count=1, max_bytes=1000)


def test_letters():
    assert all(map(ppm.has_letter, ("a", "1é", "日", "ª", "ß2")))
    assert not any(map(ppm.has_letter, (None, "", "½²①", "123 !?_", "٣", "😀")))


def test_language_held_out(spark):
    out = ppm.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["lang"] == out["lang_pred"])[out["held_out"]].mean() > 0.95
    assert out["score"].between(0, 1).all()


def test_language_odd_rows(make):
    a, b = [i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 3 != 1][:2]  # ids that training may use
    docs = make([(a, "the cat and the dog " * 9, "en"), (b, "le chat et le chien " * 9, "fr"), (3, None, "en"), (5, "", "fr"), (6, "123 !?", None), (None, "the", None), (9, "le chat " * 30_000, None), (9, "le chat " * 30_000, None)])
    got = ppm.identify(docs, ppm.train(docs)).collect()
    assert len(got) == 8
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (3, 5, 6))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 9} == {"fr"}
    empty = docs.limit(0)
    assert ppm.identify(empty, ppm.train(empty)).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(docs, ppm.train(empty)).collect()} == {"und"}


# ---- secrets


def naive_spans(text, n_rules=3):
    kinds = [("assign", 2, 6), ("access", 0, 20), ("hex", 0, 24), ("pem", 0, 1), ("jwt", 0, 30), ("forge", 0, 40)]
    out = []
    for n, (kind, group, least) in enumerate(kinds[:n_rules]):
        for m in re.finditer(secrets.ALL_RULES[n].pattern, text):
            if len(m.group(group)) >= least:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


SECRETS = ['é password = "abcdef" x', "secret:abc token=longenough1", "API_KEY:'k_9.=-/+zz'", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "0123456789abcdef01234567 " * 3, "secret:\"token\"=abcdefgh", "passwd:" + "f" * 30, "日本 apikey=" + "9" * 25, "no", "", "-----BEGIN RSA PRIVATE KEY-----\nx token=ghp_" + "a1" * 20, "é eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl, eyJa.b.c"]


def test_secrets_against_brute_force(make):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(100, None), (101, SECRETS[0]), (None, SECRETS[1]), (0, SECRETS[3]), (102, ("word " * 500 + SECRETS[2] + " ") * 40)]
    got = secrets.find_secrets(make(rows)).collect()
    want = sorted((repr(i), naive_spans(t or "")) for i, t in rows)
    assert sorted((repr(r["path"]), [(f["start"], f["rank"], f["end"], f["kind"]) for f in r["findings"]]) for r in got) == want
    assert secrets.find_secrets(make(rows).limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, make, tmp_path):
    path = str(tmp_path / "ledger")
    first = make([(1, SECRETS[0]), (2, SECRETS[0]), (3, SECRETS[4])])
    assert secrets.update_ledger(first, path).count() == 2 * 3
    more = make([(1, SECRETS[0]), (4, SECRETS[3])])
    ledger = secrets.update_ledger(more, path)
    assert ledger.count() == 3 * 3
    assert secrets.scan_unseen(more, ledger).count() == 0
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]+", 0, 32))
    new = secrets.scan_unseen(first, ledger, newer)
    assert {r["rule"] for r in new.collect()} == {"hex@2"} and new.count() == 2
    assert secrets.attach(first, ledger).where(F.size("findings") > 0).count() == 3


def test_deliveries(spark, make, tmp_path, monkeypatch):
    """Each (blob, rule version) is scanned once over all deliveries; later ones skip what former ones held."""
    rows = [(i, SECRETS[i % len(SECRETS)]) for i in range(60)] + [(100, None), (None, SECRETS[0]), (3, SECRETS[5]), (3, SECRETS[5])]
    scanned = []
    scan = secrets.scan_unseen

    def counted(*a, **k):
        out = scan(*a, **k).cache()
        scanned.append(out.count())
        return out

    monkeypatch.setattr(secrets, "scan_unseen", counted)
    got = secrets.deliver(make(rows), str(tmp_path / "ledger"), deliveries=3).collect()
    want = sorted((repr(i), naive_spans(t or "", 6)) for i, t in rows)
    assert sorted((repr(r["path"]), [(f["start"], f["rank"], f["end"], f["kind"]) for f in r["findings"]]) for r in got) == want
    blobs = len({t or "" for _, t in rows})
    assert len(scanned) == 3 and sum(scanned) == 6 * blobs and 0 < scanned[0] and scanned[2] < scanned[0]
    secrets.deliver(make(rows), str(tmp_path / "ledger"), deliveries=1)
    assert scanned[3:] == [0]
    assert secrets.deliver(make(rows).limit(0), str(tmp_path / "empty")).count() == 0


def test_redaction(make):
    docs = make([(1, SECRETS[0]), (2, None), (3, "plain"), (4, "passwd:" + "f" * 30), (1, SECRETS[0]), (None, "token=abcdef AKIA" + "B" * 16)])
    for c in ("__blob", "__b", "findings", "clean", "c0", "h"):
        docs = docs.withColumn(c, F.lit(c))
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
    got = out.collect()
    assert len(got) == 6 and all(r[c] == c for r in got for c in ("__blob", "__b", "findings", "clean", "c0", "h"))
    by = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got}
    assert by[1] == ('é [secret]" x', 13) and by[2] == (None, None) and by[3] == ("plain", 5) and by[4] == ("[secret]", 8) and by[None] == ("[secret] [secret]", 17)
    assert secrets.redact(docs.limit(0)).count() == 0


# ---- near duplicates


def naive_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    near = [[i != j and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0) for j in range(n)] for i in range(n)]
    top = list(range(n))
    for _ in range(n):
        top = [min([top[i]] + [top[j] for j in range(n) if near[i][j]], key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for i in range(n)]
    return sorted((repr(rows[i][0]), repr(rows[top[i]][0]), sum(near[i])) for i in range(n))


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_brute_force(make):
    rng = random.Random(5)
    texts = variants(rng, [f"w{i}" for i in range(200)], 25, 2) + variants(rng, [f"x{i}" for i in range(60)], 8, 1) + [" ".join(f"{k}y{i}" for i in range(40)) for k in range(20)]
    texts += [texts[0]] * 4 + ["a b c", "a  b\nc", "a b d", "", None, " \n", "q " * 9000 + "end"]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    rows.append((3, "another text under an id that is taken already by one"))
    got = near_join.near_duplicates(make(rows)).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["n_links"]) for r in got) == naive_groups(rows)
    assert near_join.near_duplicates(make(rows).limit(0)).count() == 0


def test_blocks_give_the_same_links(spark, make):
    rng = random.Random(6)
    docs = make([(i, t) for i, t in enumerate(variants(rng, [f"w{i}" for i in range(120)], 40, 1))])
    s = near_join.sketch(docs).cache()
    classes = s.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).cache()
    pairs = [near_join.connected_components(near_join.candidates(classes, block=b)) for b in (1000, 7)]
    assert sorted(pairs[0].collect()) == sorted(pairs[1].collect())
    n = [sorted(tuple(r) for r in near_join.links(docs, classes, pairs[0], block=b).groupBy("cid").agg(F.sum("n")).collect()) for b in (1000, 7)]
    assert n[0] == n[1] and len(n[0]) > 30


def test_sets_that_share_half_a_fingerprint(make, monkeypatch):
    """Sets whose names collide are told apart by the other half."""
    whole = near_join.fingerprint
    monkeypatch.setattr(near_join, "fingerprint", lambda s: (whole(s)[0] % 3, whole(s)[1]))
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(variants(rng, [f"w{i}" for i in range(90)], 8, 1) + [" ".join(f"{k}y{i}" for i in range(9)) for k in range(12)] * 2 + ["", None])]
    got = near_join.near_duplicates(make(rows, 1)).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["n_links"]) for r in got) == naive_groups(rows)


def test_blocks_are_bounded_in_bytes(make, monkeypatch):
    rng = random.Random(10)
    rows = [(i, t) for i, t in enumerate(variants(rng, [f"w{i}" for i in range(300)], 30, 2))]
    want = sorted((repr(r["doc_id"]), r["n_links"]) for r in near_join.near_duplicates(make(rows)).collect())
    monkeypatch.setattr(near_join, "_BLOCK_BYTES", 4000)
    assert sorted((repr(r["doc_id"]), r["n_links"]) for r in near_join.near_duplicates(make(rows)).collect()) == want


def test_pruning_keeps_what_can_reach_the_threshold():
    least = near_join.least_matches()
    assert list(least) == sorted(least) and least[-1] < 0.8 * near_join.HASHES
    rng = np.random.default_rng(0)
    agree = rng.random((20_000, near_join.HASHES)) < 0.8
    kept = np.ones(len(agree), bool)
    for i, m in enumerate(least):
        kept &= agree[:, : (i + 1) * near_join.STEP].sum(1) >= m
    assert kept.all()


def test_keep_one(make):
    docs = make([(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "other words here and more of them")])
    for c in ("__id", "__h", "__text", "hash", "c0", "h", "sig"):
        docs = docs.withColumn(c, F.lit(c))
    assert near_join.keep_one(docs).columns == docs.columns and near_join.keep_one(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in near_join.keep_one(docs).collect()) == [2, 9]


def test_keep_one_with_null_and_repeated_ids(make):
    texts = [" ".join(f"{k}w{i}" for i in range(30)) for k in range(6)]
    near = texts[0] + " more"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, near), (4, texts[2]), (4, texts[3]), (4, texts[3]), (5, texts[2]), (3, texts[4]), (8, texts[4]), (8, texts[5]), (9, None), (9, "")]
    kept = [(r["doc_id"], r["text"] or "") for r in near_join.keep_one(make(rows)).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(None, texts[1]), (4, near), (4, texts[2]), (4, texts[3]), (3, texts[4]), (8, texts[5]), (9, "")]))


# ---- repeated strings


def naive_repeats(rows):
    """Rows in order of id, repeated ids by text hash order given."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                m[j] += 1
                m[j + 100] -= 1
            seen.add(b[j : j + 100])
        c = np.cumsum(m)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, c, strict=True) if not g)
        out.append((repr(i), len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repetitive(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = [(None, passages[0]), (0, None), (1, "")]
    for i in range(2, 40):
        parts = [" ".join(word() for _ in range(rng.randint(1, 40))) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 5))]
        t = " ".join(parts)
        if rng.random() < 0.3 and len(t) > 50:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    return [*rows, (40, "xy" * 400), (41, "z" * 250), (42, rows[5][1]), (43, passages[2][:100] * 3)]


@pytest.mark.parametrize("crowded", [8192, 2])
def test_repeats_against_brute_force(make, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = repetitive(crowded)
    got = repeats.remove_repeats(make(rows, 1 if crowded == 2 else 4)).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == naive_repeats(rows)


def test_repeats_of_ids_and_empty_tables(make):
    t = "".join(random.Random(2).choices("abcdefgh ", k=300))
    got = repeats.remove_repeats(make([(1, t), (1, t + "x" * 5), (2, t), (2, t)]), with_text=True).collect()
    assert sum(r["n_removed"] == 0 for r in got) == 1 and len(got) == 4  # of the two texts of id 1 one comes first
    assert all(r["n_removed"] == 300 for r in got if r["doc_id"] == 2)
    assert repeats.remove_repeats(make([(1, t)]).limit(0)).count() == 0


def test_equal_rows_are_one_document(make):
    rng = random.Random(8)
    t, u = ("".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    rows = [(7, t), (7, t), (None, u), (None, u), (None, u), (8, u), (9, "short"), (9, "short")]
    got = repeats.remove_repeats(make(rows), with_text=True).collect()
    assert sorted((repr(r["doc_id"]), r["n_removed"], bytes(r["kept"]).decode()) for r in got) == sorted([("7", 0, t)] * 2 + [("None", 0, u)] * 3 + [("8", 300, "")] + [("9", 0, "short")] * 2)


def test_long_texts_in_overlapping_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "_BLOCK", 300)
    data = np.frombuffer("".join(random.Random(3).choices("abcdefgh", k=5000)).encode(), np.uint8)
    row, start, windows, *_ = repeats.segments(data, np.array([0, 5000]))
    covered = np.concatenate([np.arange(s, s + w) for s, w in zip(start, windows, strict=True)])
    assert (np.sort(covered) == np.arange(4901)).all()


def test_run_index():
    rng = random.Random(1)
    for trial in range(40):
        base = bytes(rng.choice(b"abcdefgh " if trial % 2 else b"ab") for _ in range(400))

        def variant():
            a = rng.randint(0, 230)
            s = bytearray(base[a : a + rng.randint(1, 168)])
            if rng.random() < 0.6:
                s[rng.randrange(len(s))] = rng.choice(b"xyz")
            return bytes(s)

        strings, patterns = [variant() for _ in range(rng.randint(1, 20))], [variant() for _ in range(5)] + [b""]
        symbols = lambda x: np.frombuffer(x, np.uint8).astype(np.uint16)
        index = RunIndex(np.concatenate([np.append(symbols(s), np.uint16(SEPARATOR)) for s in strings]))
        assert index.runs <= index.n
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in patterns])]).astype(np.int64)
        got = index.matching_statistics(symbols(b"".join(patterns)), offsets)
        for k, p in enumerate(patterns):
            n = 0
            for i in range(len(p)):
                n = max(0, n - 1)
                while i + n < len(p) and any(p[i : i + n + 1] in s for s in strings):
                    n += 1
                assert got[offsets[k] + i] == n
