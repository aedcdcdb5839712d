import hashlib
import random
import zlib

import numpy as np
import pytest

from clusterloom.llm import tokens, webp


padded = webp.padded


@pytest.mark.parametrize("text", [b"", b"a", b"ab" * 99, bytes(range(256)) * 3, b"abc d" * 40, "日本語".encode() * 90, random.Random(1).randbytes(5000), b"z" * 64 * 16384 + b"y", random.Random(2).randbytes(70_000) * 20])
def test_bytes_round_trip(text):
    p = padded(text)
    m = webp.encode_bytes(p)
    assert webp.decode_bytes(m).tobytes() == p
    if len(p) < 10_000:
        img = webp.decode(m)
        assert img[:, :, 0].tobytes()[: len(p)] == p and (img[:, :, 3] == 255).all() and (img[:, :, 0] == img[:, :, 2]).all()


# A writer for all that the reader must undo; pixels are lists of (a, r, g, b).


def put_single(w, s):
    w.put(1 | 0 << 1 | 1 << 2, 3)
    w.put(s, 8)


def put_flat(w, alphabet, used):
    """A prefix code for the used symbols, through the general writer."""
    lengths = [0] * alphabet
    n = max(1, (len(used) - 1).bit_length())
    full = 1 << n
    short = full - len(used)  # so many symbols get one bit less
    for i, s in enumerate(sorted(used)):
        lengths[s] = n - 1 if i < short and n > 1 else n
    webp.put_code(w, lengths if len(used) > 1 else [int(i == used[0]) for i in range(alphabet)])
    codes = webp.reversed_codes(lengths)
    single = len(used) == 1
    return lambda w, s: None if single else w.put(int(codes[s]), lengths[s])


def put_image(w, pixels, main=True, cache_bits=0, refs=None):
    """Literal pixels; ``refs``: {position: (length, distance code prefix, extra)}; cached pixels are written by cache index."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    cache, out, i = {}, [], 0
    while i < len(pixels):
        a, r, g, b = pixels[i]
        value = a << 24 | r << 16 | g << 8 | b
        slot = (webp.CACHE_FACTOR * value & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if refs and i in refs:
            out.append(("ref", *refs[i]))
            step = refs[i][0]
        elif cache_bits and cache.get(slot) == value:
            out.append(("cache", slot))
            step = 1
        else:
            out.append(("lit", a, r, g, b))
            step = 1
        for j in range(i, i + step):
            v = pixels[j][0] << 24 | pixels[j][1] << 16 | pixels[j][2] << 8 | pixels[j][3]
            if cache_bits:
                cache[(webp.CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        i += step
    green = sorted({x[3] if x[0] == "lit" else 256 + x[1] - 1 if x[0] == "ref" else 280 + x[1] for x in out})
    lit = [x for x in out if x[0] == "lit"] or [("lit", 0, 0, 0, 0)]
    dist = sorted({x[2] for x in out if x[0] == "ref"}) or [0]
    pg = put_flat(w, 280 + ((1 << cache_bits) if cache_bits else 0), green)
    pr, pb, pa = (put_flat(w, 256, sorted({x[k] for x in lit})) for k in (2, 4, 1))
    pd = put_flat(w, 40, dist)
    for x in out:
        if x[0] == "lit":
            pg(w, x[3]), pr(w, x[2]), pb(w, x[4]), pa(w, x[1])
        elif x[0] == "ref":
            pg(w, 256 + x[1] - 1)
            pd(w, x[2])
            if x[3] is not None:
                w.put(*x[3])
        else:
            pg(w, 280 + x[1])


def start(width, height):
    w = webp.Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def finish(w):
    return webp.container(w.value.to_bytes((w.n + 7) // 8, "little"))


def picture(width, height, seed=0, colours=40):
    rng = random.Random(seed)
    some = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(colours)]
    return [rng.choice(some) for _ in range(width * height)]


def rgba(pixels, width):
    return np.array([(r, g, b, a) for a, r, g, b in pixels], np.uint8).reshape(-1, width, 4)


def test_literals_cache_and_references():
    p = picture(9, 7)
    w = start(9, 7)
    w.put(0, 1)
    put_image(w, p)
    assert (webp.decode(finish(w)) == rgba(p, 9)).all()
    w = start(9, 7)
    w.put(0, 1)
    put_image(w, p, cache_bits=4)
    assert (webp.decode(finish(w)) == rgba(p, 9)).all()
    p[18:22] = p[9:13]  # from the row above: near distance 1
    p[40:43] = p[39:40] * 3  # from the left: near distance 2, overlapping itself
    p[50:54] = p[20:24]  # 30 back: distance 150, prefix 14, 6 extra bits
    w = start(9, 7)
    w.put(0, 1)
    put_image(w, p, cache_bits=3, refs={18: (4, 0, None), 40: (3, 1, None), 50: (4, 14, (150 - 1 - 128, 6))})
    assert (webp.decode(finish(w)) == rgba(p, 9)).all()


def test_green_and_cross_colour():
    width, height = 8, 6
    p = picture(width, height, 3)
    w = start(width, height)
    w.put(1 | 2 << 1, 3)
    w.put(0, 1)
    put_image(w, [(a, (r - g) & 255, g, (b - g) & 255) for a, r, g, b in p])
    assert (webp.decode(finish(w)) == rgba(p, width)).all()
    signed = lambda x: x - 256 if x > 127 else x
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    table = [(255, 10 + i, 200 - i, 77 * i & 255) for i in range(4)]  # red_to_blue, green_to_blue, green_to_red
    res = []
    for i, (a, r, g, b) in enumerate(p):
        _, rb, gb, gr = table[(i // width >> 2) * 2 + (i % width >> 2)]
        res.append((a, (r - delta(gr, g)) & 255, g, (b - delta(gb, g) - delta(rb, r)) & 255))
    w = start(width, height)
    w.put(1 | 1 << 1, 3)
    w.put(0, 3)
    put_image(w, table, main=False)
    w.put(0, 1)
    put_image(w, res)
    assert (webp.decode(finish(w)) == rgba(p, width)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 7, 6
    p = picture(width, height, mode)
    at = lambda x, y: p[y * width + x]
    half = lambda a, b: tuple((x + y) // 2 for x, y in zip(a, b, strict=True))
    clip = lambda v: min(255, max(0, v))
    res = []
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                q = (255, 0, 0, 0)
            elif y == 0:
                q = at(x - 1, 0)
            elif x == 0:
                q = at(0, y - 1)
            else:
                L, T, TL = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1)
                TR = at(x + 1, y - 1) if x + 1 < width else at(0, y)
                grad = [a + b - c for a, b, c in zip(L, T, TL, strict=True)]
                near = lambda z: sum(abs(a - b) for a, b in zip(grad, z, strict=True))
                mid = half(L, T)
                q = [
                    (255, 0, 0, 0), L, T, TR, TL, half(half(L, TR), T), half(L, TL), half(L, T), half(TL, T), half(T, TR), half(half(L, TL), half(T, TR)),
                    L if near(L) < near(T) else T, tuple(map(clip, grad)), tuple(clip(m + int((m - c) / 2)) for m, c in zip(mid, TL, strict=True)),
                ][mode]
            res.append(tuple((a - b) & 255 for a, b in zip(at(x, y), q, strict=True)))
    w = start(width, height)
    w.put(1, 3)
    w.put(1, 3)  # blocks of 8
    put_image(w, [(255, 0, mode, 0)], main=False)
    w.put(0, 1)
    put_image(w, res)
    assert (webp.decode(finish(w)) == rgba(p, width)).all()


def test_code_groups():
    """An entropy image with three groups, each with codes of its own."""
    width, height = 21, 10
    p = picture(width, height, 5)
    size = 3
    numbers = [0, 2, 1, 1, 0, 2]  # 3 x 2 blocks of 8
    group = [numbers[(i // width >> size) * 3 + (i % width >> size)] for i in range(len(p))]
    w = start(width, height)
    for v, n in ((0, 1), (0, 1), (1, 1), (size - 2, 3)):  # no transform, no cache, an entropy image
        w.put(v, n)
    put_image(w, [(255, 0, g, 0) for g in numbers], main=False)
    put = []
    for g in range(3):
        own = [x for x, k in zip(p, group, strict=True) if k == g]
        put.append([put_flat(w, 280 if k == 2 else 256, sorted({x[k] for x in own})) for k in (2, 1, 3, 0)])
        put_flat(w, 40, [0])
    for (a, r, g, b), k in zip(p, group, strict=True):
        for f, v in zip(put[k], (g, r, b, a), strict=True):
            f(w, v)
    assert (webp.decode(finish(w)) == rgba(p, width)).all()


def images():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:70, 0:90]
    wave = np.sin(x / 9) + rng.normal(0, 0.2, x.shape)
    yield "ramps", np.stack([x * 2 + y, x + y, y * 3, 255 + 0 * x], 2), {0}
    yield "noise", rng.integers(0, 256, (50, 40, 4)), set()
    yield "few colours", rng.integers(0, 256, (40, 4))[rng.integers(0, 40, (33, 47))], {3}
    yield "colours come back", rng.integers(0, 256, (600, 4))[rng.zipf(1.3, (64, 64)) % 600], {"cache"}
    yield "channels that go together", np.stack([128 + 28 * wave, 120 + 60 * wave, 100 - 40 * wave, 255 + 0 * x], 2), {0, 1}
    yield "grey", (100 + 30 * wave + np.cumsum(rng.integers(0, 300, x.shape), 1))[..., None] % 256 * [1, 1, 1, 0] + [0, 0, 0, 255], {3}
    yield "two colours", (rng.integers(0, 2, (9, 13)) * 255)[..., None].repeat(4, 2), {3}
    yield "one pixel", np.array([[[1, 2, 3, 4]]]), {3}
    yield "one row", rng.integers(0, 256, (1, 500, 4)), set()
    yield "one column", rng.integers(0, 256, (500, 1, 4)), set()


@pytest.mark.parametrize("name,img,wanted", list(images()))
def test_images_round_trip(monkeypatch, name, img, wanted):
    """The cheapest form is read back, and so is every other form; forms that should pay are chosen."""
    img = np.asarray(img).astype(np.uint8)
    undone, caches = set(), []
    for kind, f in ((0, "invert_predictor"), (1, "invert_cross_colour"), (3, "invert_palette")):
        inner = getattr(webp, f)
        monkeypatch.setattr(webp, f, lambda *a, kind=kind, inner=inner: undone.add(kind) or inner(*a))
    read = webp._read_pixels
    monkeypatch.setattr(webp, "_read_pixels", lambda *a: caches.append(a[5]) or read(*a))
    media = webp.encode(img)
    assert (webp.decode(media) == img).all()
    assert wanted - {"cache"} <= undone and ("cache" not in wanted or caches[-1])
    argb = np.ascontiguousarray(img[:, :, [3, 0, 1, 2]])
    forms = list(webp._forms(argb))
    for i in range(len(forms)):
        for cache in (0, 3, 11):
            monkeypatch.setattr(webp, "_forms", lambda _, i=i: [forms[i]])
            monkeypatch.setattr(webp, "parse", lambda px, width, cache=cache: webp.Parsed(px, width, webp.references(px, 3), cache))
            assert (webp.decode(webp.encode(img)) == img).all()


def test_stored_texts_hold_references():
    text = padded(b"to be or not to be, that is the question; to be or not to be " * 3)
    px = np.frombuffer(text, np.uint8).astype(np.uint32) << 8
    assert len(webp.references(px, 4)[0]) >= 3
    starts, sizes, gaps = webp.references(px, 4)
    for a, n, d in zip(starts, sizes, gaps, strict=True):
        assert all(px[a + k] == px[a + k - d] for k in range(n))
    assert len(webp.encode_bytes(text * 30)) < 0.1 * 30 * len(text)


def calls(f, *args):
    """What ``f`` returns, and how many functions it calls, built in or not."""
    import sys

    seen = []
    sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
    try:
        out = f(*args)
    finally:
        sys.setprofile(None)
    return out, len(seen)


def test_steps_of_a_text(monkeypatch):
    """No step for each symbol in reading, and few in writing; the loop over single pixels reads the same."""
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(2, 9))) for _ in range(500)]
    text = padded(" ".join(rng.choice(words) for _ in range(3000)).encode())
    webp.describe(webp.encode_bytes(text))  # tables that are made once
    media, writing = calls(webp.encode_bytes, text)
    row, reading = calls(webp.describe, media)
    lit, refs = len(text), webp.references(np.frombuffer(text, np.uint8).astype(np.uint32) << 8, 6)
    symbols = lit - int(refs[1].sum()) + len(refs[0])
    assert symbols > 4000 and reading < symbols / 2 and writing < 1200, (symbols, reading, writing)
    monkeypatch.setattr(webp, "_FEW", 1 << 30)
    assert webp.describe(media) == row and row[1] == hashlib.sha256(text).hexdigest()


@pytest.mark.parametrize("n", [511, 2000, 70_000])
def test_symbols_of_any_length(monkeypatch, n):
    """Codes of 1 to 15 bits, references near and far, images of one and of four channels, in one window and in several."""
    rng = np.random.default_rng(n)
    grey = np.minimum(rng.geometric(0.4, n), 255).astype(np.uint8)
    grey[n // 2 :] = np.where(rng.random(n - n // 2) < 0.99, grey[: n - n // 2], grey[n // 2 :])
    media = webp.encode_bytes(padded(grey.tobytes()))
    coloured = rng.integers(0, 256, (-(-n // 64), 64, 4)).astype(np.uint8)
    coloured[len(coloured) // 2 :, :50] = coloured[: len(coloured) - len(coloured) // 2, :50]
    picture = webp.encode(coloured)
    for few in (webp._FEW, 1, 1 << 30):
        monkeypatch.setattr(webp, "_FEW", few)
        assert webp.decode_bytes(media).tobytes() == padded(grey.tobytes()) and (webp.decode(picture) == coloured).all()


def test_features():
    samples = np.array([3] * 70 + [250] * 58, np.uint8)
    s = webp.Summary()
    s.add(samples)
    assert s.feature() == f"sum={3 * 70 + 250 * 58};distinct=2;mode=3;step=247"
    text = "wörter " * 200
    row = webp.describe(webp.encode_bytes(padded(text.encode())))
    whole = webp.Summary()
    whole.add(np.frombuffer(padded(text.encode()), np.uint8))
    media = webp.encode_bytes(padded(text.encode()))
    assert row == (len(padded(text.encode())), hashlib.sha256(padded(text.encode())).hexdigest(), zlib.crc32(padded(text.encode())[-64:]), len(media), hashlib.sha256(media).hexdigest(), whole.feature())


def test_memory_of_a_long_text():
    """Parts bound the memory: a text of 32 MB is stored and read below 400 MB."""
    import subprocess
    import sys

    code = (
        "import resource, random\nfrom clusterloom.llm import webp\n"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "t = webp.padded(random.Random(1).randbytes(1 << 18).hex().encode() * 64)\n"
        "m = webp.encode_bytes(t)\nassert webp.describe(m)[0] == len(t) == 1 << 25\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    )
    import os

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=repo, check=True)
    assert int(out.stdout) < 400


def test_damaged_files():
    m = webp.encode_bytes(padded(b"hello world " * 20))
    for bad in (m[:60], b"RIFX" + m[4:], m[:21] + b"\xff" * 20 + m[41:]):
        with pytest.raises((ValueError, KeyError, AssertionError)):
            webp.decode_bytes(bad)


def test_op1_rows(make):
    texts = [(1, None), (2, ""), (3, "x" * 64), (4, "héllo"), (4, "héllo"), (None, "n"), (5, "w " * 40_000)]
    got = webp.store_texts(make(texts)).collect()
    assert len(got) == 7
    for r in got:
        text = next((t or "") for i, t in texts if i == r["doc_id"]).encode()
        assert r["n_bytes"] == len(text) and r["payload_sha256"] == hashlib.sha256(padded(text)).hexdigest() and r["tail_crc32"] == zlib.crc32(padded(text)[-64:])
    assert webp.store_texts(make(texts).limit(0)).count() == 0


def test_columns(spark):
    m = webp.encode_bytes(padded(b"abc"))
    rows = webp.decode_column(spark.createDataFrame([(1, bytearray(m)), (2, None)], "id long, media binary")).collect()
    assert {r["id"]: (r["width"], r["height"]) for r in rows} == {1: (64, 1), 2: (None, None)}
    pixels = bytes(range(240))
    df = spark.createDataFrame([(1, 6, 10, bytearray(pixels), "x"), (1, 6, 10, bytearray(pixels), "y"), (2, None, None, None, "z")], "id long, width int, height int, pixels binary, media string")
    back = webp.decode_column(webp.encode_column(df)).collect()
    assert sorted((r["id"], r["width"], r["height"], r["pixels"] and bytes(r["pixels"])) for r in back) == [(1, 6, 10, pixels), (1, 6, 10, pixels), (2, None, None, None)]
    assert webp.encode_column(df.limit(0)).count() == 0


def test_op3_files(spark, make, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.vocabulary_path())
    texts = [(7, "Hello  world's  don't\n★ stop ★★ <|endoftext|> x"), (3, None), (5, ""), (9, "\t É é   ab　c 12,3 " * 30), (5, "again"), (None, "first"), (11, "word " * 20_000 + "z" * 300)]
    path = str(tmp_path / "t")
    tokens.write_tokens(make(texts), path)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["tokens"]) for r in tokens.read_tokens(spark, path).collect()), key=repr)
    want = sorted(((i is not None, i or 0, tk.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts), key=repr)
    assert got == want
    assert {r["doc_id"] for r in tokens.read_tokens(spark, path, low=5, high=9).collect()} == {5, 7}
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(sorted((tmp_path / "t").glob("part-*"))[0]).metadata.row_group(0).column(4)
    assert "RLE_DICTIONARY" in meta.encodings or "PLAIN_DICTIONARY" in meta.encodings
    assert meta.has_column_index and meta.has_offset_index


def test_words_that_go_straight_to_the_model():
    """The same ids as the whole tokenizer gives, for letters of all kinds, signs and mixtures."""
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(tokens.vocabulary_path()), tokens.Encoder(tokens.vocabulary_path())
    assert enc.direct
    rng = random.Random(4)
    signs = "!\"#$%&()*+,./:;=?@[]^_`{|}~-'<>★"
    letters = "abcXYZéÉßñÿĀſµªºŉİıĲ" + "ƀΣςд日e\u0301"
    every = ["".join(rng.choices(letters, k=rng.randint(1, 6))) + "".join(rng.choices(signs, k=rng.randint(0, 3))) + "".join(rng.choices(letters + "12", k=rng.choice((0, 0, 2)))) for _ in range(4000)]
    every += ["don't", "it's.", "we'll,", "a_b", "_", "x" * 300 + ".", "É", "word.", "word", "Word...", "<|endoftext|>", "end<|endoftext|>.", "\u212a", "ŉ'", "a--", "a—b"]
    for lo in range(0, len(every), 50):
        lot = every[lo : lo + 50]
        text = " ".join(lot)
        want = np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc([text])[0] == want, lot


def test_op3_query(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = tokens.op3_tokens(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    tk = Tokenizer.from_file(tokens.vocabulary_path())
    ids = [np.array(e.ids + [1], "<u4") for e in tk.encode_batch(docs["text"].tolist(), add_special_tokens=False)]
    n = np.array([len(x) for x in ids])
    assert (got["n_tokens"].to_numpy() == n).all() and (got["start"].to_numpy() == np.cumsum(n) - n).all()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in ids]
