"""Lossless WebP columns: a reader and a writer for the whole lossless format.

The reader inverts everything the lossless format has: prefix codes (simple, normal, and
grouped by an entropy image), back-references with two-dimensional distances, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms (with
several pixels in one when the palette is small). Symbols are looked up for all bits of a
window at once, and only the places of real ones are followed one by one; images with a
cache or several code groups, whose symbols depend on pixels before, are read symbol by
symbol. The predictor is inverted along diagonals, all pixels of one at a time.

The writer prices several forms of an image by the entropy of their symbols and writes the
cheapest: a palette, or subtract-green, predictor and cross-colour with their parameters
chosen for each block, each with back-references and, where it pays, a colour cache.

A byte string is stored as grey samples in rows of 64 or more. Its length goes into a chunk
of its own (the last row is padded); a string over 1 MiB becomes several files in a row, so
memory depends on the part's size and not on the string's.

Defined results (:func:`encode_texts`, :func:`describe_media`)
    * null text is the empty text and still has one block of 64 zero bytes.
    * repeated rows and null ids are kept; equal texts have equal files.
    * empty table: empty result. Extra columns are ignored, whatever their names.
    * long texts are stored whole, in parts. A damaged file raises ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clusterloom.llm.common import cut
from clusterloom.llm.ppm import utf8

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
SIDE, LONGEST, FARTHEST = 16384, 4096, (1 << 20) - 120


class Bits:
    """Reads a little-endian bit stream."""

    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def read(self, n: int) -> int:
        p = self.pos
        self.pos = p + n
        if self.pos > 8 * len(self.data):
            raise ValueError("the file ends early")
        return (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1)


@functools.lru_cache(16)
def _mirrored(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits turned round."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def reversed_codes(lengths) -> np.ndarray:
    """Canonical codes of the symbols, first bit lowest."""
    lengths = np.asarray(lengths, np.uint8)
    codes = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[len(lengths) - np.count_nonzero(lengths) :]
    share = 1 << (15 - lengths[order].astype(np.int32))
    codes[order] = _mirrored(15)[np.cumsum(share) - share]  # a code, seen as a fraction of 2**15
    return codes


class Code:
    """A prefix code as a table over its longest code's bits: ``symbol << 4 | length``."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.uint8)
        order = np.argsort(lengths, kind="stable")
        order = order[len(lengths) - np.count_nonzero(lengths) :]
        if not len(order):
            raise ValueError("a prefix code has no symbol")
        self.single = int(order[0]) if len(order) == 1 else -1
        if self.single >= 0:
            self.bits, self.array = 0, np.array([self.single << 4])
            return
        own = lengths[order].astype(np.int64)
        n = self.bits = int(own[-1])
        if n > 15:
            raise ValueError("a code is too long")
        table = np.repeat(order << 4 | own, 1 << (n - own))
        if len(table) != 1 << n:
            raise ValueError("a prefix code is not complete")
        self.array = table[_mirrored(n)]

    @functools.cached_property
    def table(self) -> list[int]:
        return self.array.tolist()


@functools.lru_cache(64)
def _code(key: bytes) -> Code:
    return Code(np.frombuffer(key, np.uint8))


@functools.lru_cache(512)
def _simple(marks: tuple[int, ...], alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.uint8)
    lengths[list(marks)] = 1
    return Code(lengths)


def _read_code(bits: Bits, alphabet: int) -> Code:
    p, data = bits.pos, bits.data
    head = int.from_bytes(data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7) & 2047
    if head & 7 == 5 and p + 11 <= 8 * len(data) and head >> 3 < alphabet:  # one symbol of 8 bits
        bits.pos = p + 11
        return _simple((head >> 3,), alphabet)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        marks = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(marks) >= alphabet:
            raise ValueError("a symbol is out of range")
        return _simple(tuple(marks), alphabet)
    n = 4 + bits.read(4)
    marks, own = bits.read(3 * n), bytearray(19)
    for s in LENGTH_ORDER[:n]:
        own[s] = marks & 7
        marks >>= 3
    code, left = _code(bytes(own)), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    if 0 <= code.single < 16:  # all lengths are the same
        return _code(bytes([code.single]) * min(left, alphabet) + bytes(max(0, alphabet - left)))
    lengths, last, table, mask, p = bytearray(), 8, code.table, (1 << code.bits) - 1, bits.pos
    acc = int.from_bytes(bits.data[p >> 3 : (p >> 3) + 2 * min(left, alphabet) + 8], "little") >> (p & 7)
    add = lengths.append
    while left and len(lengths) < alphabet:
        left -= 1
        e = table[acc & mask]
        acc >>= e & 15
        p += e & 15
        s = e >> 4
        if s < 16:
            add(s)
            last = s or last
        else:
            k = 2 if s == 16 else 3 if s == 17 else 7
            lengths += bytes([last if s == 16 else 0]) * ((acc & ((1 << k) - 1)) + (11 if s == 18 else 3))
            acc >>= k
            p += k
    bits.pos = p
    if p > 8 * len(bits.data):
        raise ValueError("the file ends early")
    if len(lengths) > alphabet:
        raise ValueError("code lengths run over")
    return Code(np.frombuffer(lengths + bytes(alphabet - len(lengths)), np.uint8))


_WINDOW = 1 << 15
#: Below so many pixels the loop is done before the arrays are set up.
_FEW = 512
#: Bytes after a window in which no symbol begins but bits of one may lie.
_OVER = 16
_PLACES = np.arange(8 * (_WINDOW + _OVER))
#: Of each prefix symbol: its extra bits, their mask, and the number that it stands for when they are 0.
_EXTRA = np.array([max(0, (s - 2) >> 1) for s in range(40)])
_EXTRA_MASK = (1 << _EXTRA) - 1
_BASE = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])
#: Of each symbol of the first code: its extra bits, and 128 for a reference.
_FIRST_EXTRA = np.concatenate([np.zeros(256, np.int64), 128 + _EXTRA[:24]])


def _read_arrays(bits: Bits, codes: list[Code], width: int, height: int) -> np.ndarray | None:
    """Pixels of an image with one code group and no cache; None if a symbol may take no bits.

    The symbol that would begin at each bit of a window is looked up at once, and where it ends.
    Only the places of real symbols are then followed one by one, and references copied.
    """
    n = width * height
    rest = [(c, shift) for c, shift in zip((codes[RED], codes[BLUE], codes[ALPHA]), (16, 0, 24), strict=True)]
    fixed = sum(c.single << shift for c, shift in rest if c.single >= 0)
    rest = [x for x in rest if x[0].single < 0]
    unit, kind = (4, np.uint32) if rest else (1, np.uint8)
    out = bytearray(n * unit)
    pixels = np.frombuffer(out, kind)
    data, done, position = np.frombuffer(bits.data, np.uint8), 0, bits.pos
    green, distance = codes[GREEN], codes[DISTANCE]
    hop = ((green.array & 15) + _FIRST_EXTRA[green.array >> 4]).astype(np.uint8)  # bits of a symbol and its extra ones; 128 marks a reference
    far_hop = ((distance.array & 15) + _EXTRA[distance.array >> 4]).astype(np.uint8)
    green_mask, far_mask = (1 << green.bits) - 1, (1 << distance.bits) - 1
    while done < n:
        first = position >> 3
        part = data[first : first + min(_WINDOW, 8 * (n - done) + 1)]  # a pixel takes at most 60 bits
        if not len(part):
            raise ValueError("the file ends early")
        x = np.zeros(len(part) + _OVER + 3, np.uint8)
        tail = data[first : first + len(x)]
        x[: len(tail)] = tail
        words = np.ndarray(len(part) + _OVER, "<u4", x.data, 0, (1,)).astype(np.int64)
        windows = (words[:, None] >> _EIGHT).ravel()
        m = 8 * len(part)  # symbols begin in the part; their last bits may lie in the bytes after it
        index = windows[:m] & green_mask
        step = hop[index]
        ref = np.flatnonzero(step > 127)
        if rest:
            ends = _PLACES[:m] + (step & 127)
            for code, _ in rest:
                ends += code.array[windows[ends] & ((1 << code.bits) - 1)] & 15
            literal = step < 128
            step[literal] = (ends - _PLACES[:m])[literal]
        if len(ref):
            half = step[ref] & 127
            step[ref] = half + far_hop[windows[ref + half] & far_mask]
        if not step.all():
            return None
        # The place after one symbol, after two and after four; places after the part stay.
        one = _PLACES[: 8 * len(words)].copy()
        one[:m] += step
        two = one[one]
        four = two[two]
        after, p, places = four.data, position & 7, []
        add = places.append
        while p < m:
            add(p)
            p = after[p]
        places = np.array(places)
        for jump in (two, one):
            places = np.stack([places, jump[places]], 1).ravel()
        places = places[: np.searchsorted(places, m)]
        p = int(one[places[-1]])
        e = green.array[index[places]]
        symbol, at = e >> 4, places + (e & 15)
        size, gap = np.ones(len(places), np.int64), np.zeros(len(places), np.int64)
        ref = np.flatnonzero(symbol >= 256)
        if len(ref):
            number, far = symbol[ref] - 256, at[ref]
            size[ref] = _BASE[number] + (windows[far] & _EXTRA_MASK[number])
            far += _EXTRA[number]
            e = distance.array[windows[far] & far_mask]
            number = e >> 4
            gap[ref] = _BASE[number] + (windows[far + (e & 15)] & _EXTRA_MASK[number])
        ends = done + np.cumsum(size)
        last = int(np.searchsorted(ends, n))
        if last < len(places):  # what follows the image's last symbol are other bits
            p = int(one[places[last]])
            symbol, at, size, gap, ends = (v[: last + 1] for v in (symbol, at, size, gap, ends))
            ref = ref[: np.searchsorted(ref, last + 1)]
            if ends[-1] > n:
                raise ValueError("a back-reference leaves the image")
        if 8 * first + p > 8 * len(data):
            raise ValueError("the file ends early")
        literal = np.flatnonzero(gap == 0)
        value = symbol[literal]
        if rest:
            at, value = at[literal], value << 8 | fixed
            for code, shift in rest:
                e = code.array[windows[at] & ((1 << code.bits) - 1)]
                value |= e >> 4 << shift
                at = at + (e & 15)
        pixels[ends[literal] - 1] = value.astype(kind)
        gap, size = gap[ref], size[ref]
        start = ends[ref] - size
        gap = np.where(gap > 120, gap - 120, _near_gaps(width)[np.minimum(gap, 120)])
        if (gap > start).any():
            raise ValueError("a back-reference leaves the image")
        if unit > 1:
            gap, size, start = gap * unit, size * unit, start * unit
        for i, k, d in zip(start.tolist(), size.tolist(), gap.tolist(), strict=True):
            if d >= k:
                out[i : i + k] = out[i - d : i - d + k]
            else:
                out[i : i + k] = (out[i - d : i] * (k // d + 1))[:k]
        done, position = int(ends[-1]), 8 * first + p
    bits.pos = position
    if rest:
        return pixels.astype(">u4").view(np.uint8).reshape(height, width, 4)
    # In memory: alpha, red, green, blue.
    return (pixels.astype("<u4") << 16 | (fixed >> 24 | (fixed >> 16 & 255) << 8 | (fixed & 255) << 24)).astype("<u4").view(np.uint8).reshape(height, width, 4)


_EIGHT = np.arange(8)[None, :]


@functools.lru_cache(16)
def _near_gaps(width: int) -> np.ndarray:
    """The distance of each near code; code 0 is none."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEAR)])


def _read_pixels(bits: Bits, groups: list[list[Code]], block: tuple | None, width: int, height: int, cache_bits: int) -> np.ndarray:
    """Pixels [height, width, 4] in the order alpha, red, green, blue. ``block``: size and group numbers of the entropy image."""
    n = width * height
    out = array("I")
    add, extend = out.append, out.extend
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    data, total = bits.data, 8 * len(bits.data)
    at = bits.pos >> 3
    acc, have = (data[at] >> (bits.pos & 7) if at < len(data) else 0), 8 - (bits.pos & 7)
    at += 1
    ready = []
    for codes in groups:
        rest = codes[RED], codes[BLUE], codes[ALPHA]
        fixed = None
        if all(c.single >= 0 for c in rest):
            fixed = rest[2].single << 24 | rest[0].single << 16 | rest[1].single
        ready.append((codes[GREEN].table, (1 << codes[GREEN].bits) - 1, fixed, *[x for c in (*rest, codes[DISTANCE]) for x in (c.table, (1 << c.bits) - 1)]))
    green, green_mask, fixed, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = ready[0]
    i = 0
    while i < n:
        if have < 64:  # one symbol and all that belongs to it take at most 63 bits
            acc |= int.from_bytes(data[at : at + 16], "little") << have
            have += 128
            at += 16
            if at > len(data) + 64:
                raise ValueError("the file ends early")
        if block:
            size, numbers = block
            green, green_mask, fixed, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = ready[numbers[i // width >> size][i % width >> size]]
        e = green[acc & green_mask]
        k = e & 15
        acc >>= k
        have -= k
        s = e >> 4
        if s < 256:
            if fixed is None:
                r = red[acc & red_mask]
                k = r & 15
                acc >>= k
                b = blue[acc & blue_mask]
                have -= k + (b & 15)
                acc >>= b & 15
                a = alpha[acc & alpha_mask]
                acc >>= a & 15
                have -= a & 15
                v = (a >> 4) << 24 | (r >> 4) << 16 | s << 8 | b >> 4
            else:
                v = fixed | s << 8
            add(v)
            i += 1
            if cache:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
        elif s < 280:
            s -= 256
            if s < 4:
                length = s + 1
            else:
                k = (s - 2) >> 1
                length = ((2 + (s & 1)) << k) + (acc & ((1 << k) - 1)) + 1
                acc >>= k
                have -= k
            e = far[acc & far_mask]
            k = e & 15
            acc >>= k
            have -= k
            s = e >> 4
            if s < 4:
                d = s + 1
            else:
                k = (s - 2) >> 1
                d = ((2 + (s & 1)) << k) + (acc & ((1 << k) - 1)) + 1
                acc >>= k
                have -= k
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            piece = out[i - d : i - d + length] if d >= length else (out[i - d : i] * (length // d + 1))[:length]
            extend(piece)
            i += length
            if cache:
                for v in piece:
                    cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
        else:
            if not cache or s - 280 >= len(cache):
                raise ValueError("a cache entry is out of range")
            v = cache[s - 280]
            add(v)
            i += 1
            cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
    bits.pos = 8 * at - have
    if bits.pos > total:
        raise ValueError("the file ends early")
    return np.frombuffer(out, np.uint32).astype(">u4").view(np.uint8).reshape(height, width, 4)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels [height, width, 4] in the order alpha, red, green, blue."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, count = None, 1
    if main and bits.read(1):
        size = bits.read(3) + 2
        which = _read_image(bits, -(-width >> size), -(-height >> size), False)
        table = (which[:, :, 1].astype(int) << 8) | which[:, :, 2]
        count, block = int(table.max()) + 1, (size, table.tolist())
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(count)]
    if count == 1 and not cache_bits and width * height >= _FEW:
        img = _read_arrays(bits, groups[0], width, height)
        if img is not None:
            return img
    return _read_pixels(bits, groups, block, width, height, cache_bits)


def _average(a, b):
    return (a.astype(np.uint16) + b >> 1).astype(np.uint8)


def _predict(mode: int, left, up, up_left, up_right):
    """Prediction from neighbours [..., 4]."""
    i = lambda z: z.astype(np.int16)
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return up_right
    if mode == 4:
        return up_left
    if mode == 5:
        return _average(_average(left, up_right), up)
    if mode == 6:
        return _average(left, up_left)
    if mode == 7:
        return _average(left, up)
    if mode == 8:
        return _average(up_left, up)
    if mode == 9:
        return _average(up, up_right)
    if mode == 10:
        return _average(_average(left, up_left), _average(up, up_right))
    if mode == 11:
        near_left = np.abs(i(up) - i(up_left)).sum(-1)  # distance of the gradient L + T - TL from L
        near_up = np.abs(i(left) - i(up_left)).sum(-1)
        return np.where((near_left < near_up)[..., None], left, up)
    if mode == 12:
        return np.clip(i(left) + i(up) - i(up_left), 0, 255).astype(np.uint8)
    if mode == 13:
        mean = i(_average(left, up))
        gap = mean - i(up_left)
        return np.clip(mean + np.sign(gap) * (np.abs(gap) >> 1), 0, 255).astype(np.uint8)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.uint8), np.shape(up))


def invert_predictor(img: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    """Add each block's prediction to its residuals.

    A pixel needs its left neighbour and three of the row above, so all pixels with one value of ``x + 2 y`` can be done at once.
    """
    height, width, _ = img.shape
    out = img.copy()
    out[0, 0, 0] = (int(out[0, 0, 0]) + 255) & 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    for t in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (t - width + 2) // 2), min(height - 1, (t - 1) // 2) + 1)
        if not len(y):
            continue
        x = t - 2 * y
        # Above right of the last column is the row's own first pixel.
        after = np.where((x + 1 < width)[:, None], out[y - 1, np.minimum(x + 1, width - 1)], out[y, 0])
        left, up, up_left = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
        mode = modes[y >> size, x >> size]
        first = int(mode[0])
        if (mode == first).all():
            out[y, x] += _predict(first, left, up, up_left, after)
        else:
            for m in np.unique(mode).tolist():
                s = mode == m
                out[y[s], x[s]] += _predict(m, left[s], up[s], up_left[s], after[s])
    return out


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.view(np.int8).astype(np.int16) * c.view(np.int8).astype(np.int16)) >> 5


def _spread(table: np.ndarray, size: int, height: int, width: int) -> np.ndarray:
    return np.ascontiguousarray(table.repeat(1 << size, 0).repeat(1 << size, 1)[:height, :width])


def invert_cross_colour(img: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Undo the colour transform; ``table`` has one element for each block."""
    e = _spread(table, size, *img.shape[:2])
    out = img.copy()
    green = np.ascontiguousarray(img[:, :, 2])
    part = lambda k: np.ascontiguousarray(e[:, :, k])
    red = ((img[:, :, 1] + _delta(part(3), green)) & 255).astype(np.uint8)
    out[:, :, 1] = red
    out[:, :, 3] = (img[:, :, 3] + _delta(part(2), green) + _delta(part(1), red)) & 255
    return out


def invert_palette(img: np.ndarray, table: np.ndarray, pack: int, width: int) -> np.ndarray:
    """Look indices up; ``1 << pack`` of them share a pixel. Indices beyond the table are transparent black."""
    index = img[:, :, 2]
    if pack:
        per = 8 >> pack
        shifts = np.arange(1 << pack, dtype=np.uint8) * per
        index = ((index[:, :, None] >> shifts) & ((1 << per) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full.view(np.uint32).ravel()[index].view(np.uint8).reshape(*index.shape, 4)


def _add_green(img: np.ndarray) -> np.ndarray:
    out = img.copy()
    out[:, :, 1] += img[:, :, 2]
    out[:, :, 3] += img[:, :, 2]
    return out


def chunks(data: bytes):
    """Name and content of a file's chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("the file ends early")
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def decode(data: bytes) -> np.ndarray:
    """RGBA samples [height, width, 4] of a lossless file."""
    argb = _decode_argb(next((c for name, c in chunks(data) if name == b"VP8L"), b""))
    return argb[:, :, [1, 2, 3, 0]]


def _decode_argb(body: bytes) -> np.ndarray:
    if not body or body[0] != 0x2F:
        raise ValueError("no lossless image")
    bits = Bits(body)
    bits.pos = 8
    width, height, _ = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is repeated")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            table = _read_image(bits, -(-width >> size), -(-height >> size), False)
            undo.append((invert_predictor, (table[:, :, 2] & 15, size)) if kind == 0 else (invert_cross_colour, (table, size)))
        elif kind == 2:
            undo.append((_add_green, ()))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_read_image(bits, n, 1, False)[0], axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            if undo and undo[-1][0] is _add_green:  # colour by colour, so it can be done in the palette
                undo.pop()
                table = _add_green(table[None])[0]
            undo.append((invert_palette, (table, pack, width)))
            width = -(-width >> pack)
    img = _read_image(bits, width, height, True)
    for f, args in reversed(undo):
        img = f(img, *args)
    return img


# ---- writing


class Writer:
    """Writes a little-endian bit stream."""

    def __init__(self):
        self.value, self.n = 0, 0
        self.done: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_all(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Many values of up to 20 bits."""
        head, odd = self.n >> 3, self.n & 7
        self.done.append((self.value & ((1 << 8 * head) - 1)).to_bytes(head, "little"))
        left = self.value >> 8 * head
        ends = np.cumsum(lengths, dtype=np.int64) + odd
        total = int(ends[-1]) if len(ends) else odd
        at = ends - lengths
        wide = np.bincount(at >> 3, weights=values << (at & 7), minlength=(total >> 3) + 4).astype("<u4")
        wide[0] |= left
        four = wide.view(np.uint8).reshape(-1, 4)
        flat = four[:, 0].copy()
        for k in (1, 2, 3):  # values of different places never share a bit, so the sums have no carry
            flat[k:] |= four[:-k, k]
        self.done.append(flat[: total >> 3].tobytes())
        self.value, self.n = int(flat[total >> 3]) & ((1 << (total & 7)) - 1), total & 7

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of an optimal prefix code, at most ``most`` bits; rare symbols are made less rare until it fits."""
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    out = [0] * len(counts)
    if len(used) < 2:
        out[used[0][1] if used else 0] = 1
        return out
    floor, n = 1, len(used)
    while True:
        # Symbols in ascending order, and trees, which come in ascending order: the two smallest make a tree.
        weight = [max(c, floor) for c, _ in used] + [1 << 62]
        trees, parent, i, j = [], [0] * (2 * n - 1), 0, 0
        for at in range(n, 2 * n - 1):
            both = 0
            for _ in (0, 1):
                if j < len(trees) and trees[j] < weight[i]:
                    both += trees[j]
                    parent[n + j] = at
                    j += 1
                else:
                    both += weight[i]
                    parent[i] = at
                    i += 1
            trees.append(both)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            for (_, s), d in zip(used, depth, strict=False):
                out[s] = d
            return out
        floor = max(2 * floor, sum(counts) >> (most + 2))


#: Code of the code lengths: 4 bits for lengths up to 12, 5 for the others and for runs.
_LENGTH_CODE = [4] * 13 + [5] * 6
_LENGTH_BITS = reversed_codes(_LENGTH_CODE).tolist()
#: A normal code: 19 lengths of the lengths' code follow.
_HEAD = 15 << 1 | sum(_LENGTH_CODE[s] << (5 + 3 * i) for i, s in enumerate(LENGTH_ORDER))
#: A normal code whose first 256 symbols have 8 bits each.
_EVEN_HEAD = 15 << 1 | sum(int(s == 8) << (5 + 3 * i) for i, s in enumerate(LENGTH_ORDER)) | (1 | 3 << 1 | 254 << 4) << 62


def put_code(w: Writer, lengths: list[int]) -> None:
    """Write a prefix code: simple for one or two symbols, else normal with runs of zeros."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
        for s in used:
            w.put(s, 8)
        return
    w.put(_HEAD, 62)
    body, at, marks, gap = 0, 0, 0, 0
    for i in range(used[-1] + 1):
        if not lengths[i]:
            gap += 1
            continue
        while gap:  # runs of 3 to 10 and of 11 to 138 zeros
            if gap < 3:
                s, n, extra, bits = 0, 1, 0, 0
            elif gap < 11:
                s, n, extra, bits = 17, gap, gap - 3, 3
            else:
                n = min(gap, 138)
                s, extra, bits = 18, n - 11, 7
            body |= (_LENGTH_BITS[s] | extra << _LENGTH_CODE[s]) << at
            at += _LENGTH_CODE[s] + bits
            marks += 1
            gap -= n
        body |= _LENGTH_BITS[lengths[i]] << at
        at += _LENGTH_CODE[lengths[i]]
        marks += 1
    w.put(1, 1)
    w.put(4, 3)
    w.put(marks - 2, 10)
    w.put(body, at)


def container(body: bytes, extra: bytes = b"") -> bytes:
    """A file with the image and, if given, further chunks."""
    body = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1) + extra
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = v - 1
    h = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, h - 1)
    return np.where(v < 4, v, 2 * h + ((v >> np.maximum(h - 1, 0)) & 1)), extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


_KNOWN = tuple(x.astype(np.int32) for x in _prefixes(np.arange(1 << 13)))


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value of numbers from 1."""
    if not len(v) or v.max() < 1 << 13:
        return tuple(x[v] for x in _KNOWN)
    return _prefixes(v)


@functools.lru_cache(16)
def _near_codes(width: int) -> np.ndarray:
    """The code of each distance up to nine rows."""
    out = np.arange(9 * width + 9) + 120
    for c in range(len(NEAR), 0, -1):
        x, y = NEAR[c - 1]
        out[max(1, x + y * width)] = c
    return out


def references(px: np.ndarray, least: int, flat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of back-references, in order, without overlap.

    A pixel's candidate is the nearest earlier place of the ``least`` pixels that begin there; a
    reference goes on a little where its own place does and a nearer one begins. ``flat``: only green varies.
    """
    n = len(px)
    none = np.zeros(0, np.int64)
    m = n - least + 1
    if m < 2:
        return none, none, none
    if flat:  # eight bytes from each place, so that the key is exact
        raw = np.zeros(n + 8, np.uint8)
        raw[:n] = px >> np.uint32(8)
        eight = np.ndarray(n + 1, "<u8", raw.data, 0, (1,))
        key = eight[:m] & np.uint64((1 << 8 * least) - 1)
        mixed = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    else:
        mixed = px[:m].astype(np.uint32)
        for k in range(1, least):
            mixed = mixed * np.uint32(0x9E3779B1) + px[k : k + m]
        key = mixed = mixed * np.uint32(0x85EBCA6B)
    high = (mixed >> np.uint32(16)).astype(np.uint16)
    if n < 1 << 14:
        order = np.argsort(high, kind="stable")
    else:
        order = np.argsort(mixed.astype(np.uint16), kind="stable")
        order = order[np.argsort(high[order], kind="stable")]
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    same = np.flatnonzero(same)
    here, back = order[same + 1], order[same]
    if not flat:  # equal keys may hide different pixels
        ok = np.ones(len(here), bool)
        for k in range(least):
            ok &= px[here + k] == px[back + k]
        here, back = here[ok], back[ok]
    if n > FARTHEST:
        ok = here - back <= FARTHEST
        here, back = here[ok], back[ok]
    if not len(here):
        return none, none, none
    gap = np.zeros(m + 1, np.int32)
    gap[here] = here - back
    bounds = np.concatenate([[0], np.flatnonzero(gap[1:] != gap[:-1]) + 1, [m]])
    live = np.flatnonzero(gap[bounds[:-1]])
    start, stop = bounds[live], bounds[live + 1] + (least - 1)  # a run's last place still holds ``least`` equal pixels
    distance = gap[start]
    grow = np.arange(len(start))
    for _ in range(_REACH):  # a nearer place may have ended the run, but not the match
        grow = grow[stop[grow] < n]
        if not len(grow):
            break
        z, d = stop[grow], distance[grow]
        if flat:
            apart = eight[z] ^ eight[z - d]
            lowest = (apart & (~apart + np.uint64(1))).astype(np.float64)  # its lowest bit
            more = np.where(apart == 0, 8, (np.frexp(lowest)[1] - 1) >> 3)
            stop[grow] = np.minimum(z + more, n)
            grow = grow[more == 8]
        else:
            grow = grow[px[z] == px[z - d]]
            stop[grow] += 1
    # Greedy: from each place the first run that still has ``least`` pixels to give.
    begin, end, out, at = start.tolist(), stop.tolist(), [], 0
    for r, z in enumerate(end):
        if z - at >= least:
            a = begin[r]
            if a < at:
                a = at
            if z - a >= least:
                out += a, z, r
                at = z
    a, z, r = np.array(out, np.int64).reshape(-1, 3).T
    times = -(-(z - a) // LONGEST)
    if times.max() > 1:  # longer ones in pieces
        piece = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        a, z, r = np.repeat(a, times) + piece * LONGEST, np.repeat(z, times), np.repeat(r, times)
        z = np.minimum(z, a + LONGEST)
    return a, z - a, distance[r].astype(np.int64)


_REACH = 4
#: Where only green varies a shorter reference costs more bits than its literals.
_LEAST = 6


@functools.lru_cache(16)
def _gap_prefixes(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_prefix` of the codes of all distances below 8192; none is at 0."""
    near = _near_codes(width)
    code = np.arange(1 << 13) + 120
    code[: len(near)] = near[: 1 << 13]
    return tuple(x.astype(np.int32) for x in _prefixes(code))


def _gap_prefix(gap: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(gap) or gap.max() < 1 << 13:
        return tuple(x[gap] for x in _gap_prefixes(width))
    near = _near_codes(width)
    return _prefix(np.where(gap < len(near), near[np.minimum(gap, len(near) - 1)], gap + 120))


class Parsed:
    """An image's symbols: literals, references and cache hits, with their counts. ``flat``: only green varies."""

    def __init__(self, px: np.ndarray, width: int, refs, cache_bits: int, flat: bool = False):
        self.cache_bits = cache_bits
        at, size, gap = refs
        n, ends = len(px), at + size
        self.between = np.append(at, n)  # single pixels before each reference, and after the last
        self.between[1:] -= ends
        single = np.repeat(np.append(0, np.cumsum(size)), self.between)
        single += np.arange(len(single))
        self.lit, self.hit = px[single], None
        if cache_bits:
            slot = ((px.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            known = np.zeros(n, bool)  # the last pixel of this slot is the same
            known[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
            self.hit = known[single]
            self.lit, self.slots = self.lit[~self.hit], slot[single[self.hit]]
        self.green = self.lit.astype(np.int64) >> 8 & 255
        self.length, self.distance = _prefix(size), _gap_prefix(gap, width)
        green = np.bincount(self.green, minlength=280 + ((1 << cache_bits) if cache_bits else 0))
        green[256:280] += np.bincount(self.length[0], minlength=24)
        if cache_bits:
            green[280:] += np.bincount(self.slots, minlength=1 << cache_bits)
        self.flat = flat and len(self.lit) > 0
        if self.flat:
            other = [np.array([len(self.lit)])] * 3  # no bits are spent on them
        else:
            other = [np.bincount((self.lit >> np.uint32(s)) & np.uint32(255), minlength=256) for s in (16, 0, 24)]
        self.counts = [green, *other, np.bincount(self.distance[0], minlength=40)]

    def cost(self) -> float:
        """About how many bits it takes."""
        bits = float(self.length[1].sum() + self.distance[1].sum())
        for c in self.counts:
            c = c[c > 0].astype(np.float64)
            if len(c) > 1:
                bits += float((c * np.log2(c.sum() / c)).sum()) + 5 * len(c)
        return bits

    def write(self, w: Writer, main: bool) -> None:
        w.put(1 if self.cache_bits else 0, 1)
        if self.cache_bits:
            w.put(self.cache_bits, 4)
        if main:
            w.put(0, 1)  # one code group
        codes = []  # of each symbol: code << 8 | length
        for k, c in enumerate(self.counts):
            if self.flat and k in (RED, BLUE, ALPHA):
                w.put(1 | 1 << 2 | (int(self.lit[0]) >> (16, 0, 24)[k - 1] & 255) << 3, 11)
                codes.append(None)
                continue
            lengths = code_lengths(c.tolist())
            put_code(w, lengths)
            own = np.array(lengths, np.int64)
            codes.append(reversed_codes(own) << 8 | own if np.count_nonzero(own) > 1 else np.zeros_like(own))
        several = not self.flat and any(c.any() for c in codes[1:4])
        # Each symbol has its fields: a literal 1 or 4, a cache hit 1, a reference 4.
        count = len(self.between) - 1
        total = len(self.lit) if self.hit is None else len(self.hit)
        if self.hit is None:
            place = np.arange(total + 1) * (4 if several else 1)
        else:
            place = np.append(0, np.cumsum(np.where(self.hit, 1, 4 if several else 1)))
        ref = place[np.cumsum(self.between)[:-1]] + 4 * np.arange(count)
        fields = np.zeros(int(place[-1]) + 4 * count, np.int64)
        lit = place[:-1] + np.repeat(4 * np.arange(count + 1), self.between)
        if self.hit is not None:
            fields[lit[self.hit]] = codes[GREEN][280 + self.slots]
            lit = lit[~self.hit]
        fields[lit] = codes[GREEN][self.green]
        if several:
            for k, s in ((RED, 16), (BLUE, 0), (ALPHA, 24)):
                fields[lit + k] = codes[k][(self.lit >> s) & 255]
        fields[ref] = codes[GREEN][256 + self.length[0]]
        fields[ref + 1] = self.length[2] << 8 | self.length[1]
        fields[ref + 2] = codes[DISTANCE][self.distance[0]]
        fields[ref + 3] = self.distance[2] << 8 | self.distance[1]
        w.put_all(fields >> 8, fields & 255)


def _pixels(argb: np.ndarray) -> np.ndarray:
    """[..., 4] samples as numbers alpha << 24 | red << 16 | green << 8 | blue."""
    return np.ascontiguousarray(argb).view(">u4").astype(np.uint32).ravel()


def parse(px: np.ndarray, width: int, cache_sizes=(0, 5, 9)) -> Parsed:
    """Symbols of an image with the cheapest of the cache sizes; where only green varies a cache hit costs what a literal does, and none is tried."""
    flat = len(px) and not ((px ^ px[0]) & np.uint32(0xFFFF00FF)).any()
    refs = references(px, _LEAST if flat else 3, bool(flat))
    found = [Parsed(px, width, refs, b, flat) for b in ((0,) if flat else cache_sizes)]
    return min(found, key=Parsed.cost) if len(found) > 1 else found[0]


def _put_small(w: Writer, argb: np.ndarray) -> None:
    """An image of transform parameters or palette steps: channels that vary are written as bytes of 8 bits."""
    w.put(0, 1)  # no cache
    flat = argb.reshape(-1, 4)
    differ = (flat != flat[0]).any(0).tolist()
    live = [differ[k] for k in (2, 1, 3, 0)]
    for k, varies in zip((2, 1, 3, 0), live, strict=True):
        if varies:  # 256 codes of 8 bits, so that the code of the lengths has one symbol and takes no bits
            w.put(_EVEN_HEAD, 74)
        else:
            w.put(1 | 1 << 2 | int(flat[0, k]) << 3, 11)
    w.put(1 | 1 << 2, 11)
    body = _REVERSED[flat[:, [k for k, varies in zip((2, 1, 3, 0), live, strict=True) if varies]]].tobytes()
    w.put(int.from_bytes(body, "little"), 8 * len(body))


_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


def _palette_form(argb: np.ndarray, colours: np.ndarray, index: np.ndarray):
    """Transform header and pixels when colours go by number; ``colours`` ascend."""
    height, width = argb.shape[:2]
    k = len(colours)
    pack = 3 if k <= 2 else 2 if k <= 4 else 1 if k <= 16 else 0
    index = index.reshape(height, width).astype(np.uint8)
    if pack:
        per = 8 >> pack
        short = -width % (1 << pack)
        index = np.pad(index, ((0, 0), (0, short))).reshape(height, -1, 1 << pack)
        index = np.bitwise_or.reduce(index << (np.arange(1 << pack, dtype=np.uint8) * per), axis=2).astype(np.uint8)
    samples = colours.astype(">u4").view(np.uint8).reshape(k, 4)
    steps = samples.copy()
    steps[1:] -= samples[:-1]

    def head(w):
        w.put(1 | 3 << 1, 3)
        w.put(k - 1, 8)
        _put_small(w, steps[None])

    return head, index.ravel().astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), index.shape[1]


def forward_predictor(argb: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals, and for each block the mode of the smallest residuals."""
    height, width, _ = argb.shape
    left, up, up_left, up_right = (np.zeros_like(argb) for _ in range(4))
    left[:, 1:] = argb[:, :-1]
    up[1:] = argb[:-1]
    up_left[1:, 1:] = argb[:-1, :-1]
    up_right[1:, :-1] = argb[:-1, 1:]
    up_right[1:, -1] = argb[1:, 0]
    high, wide = -(-height >> size), -(-width >> size)
    best, modes, out = np.full((high, wide), np.iinfo(np.int64).max), np.zeros((high, wide), np.uint8), argb.copy()
    for mode in range(14):
        rest = argb - _predict(mode, left, up, up_left, up_right)
        weight = np.abs(rest.view(np.int8).astype(np.int64)).sum(2)
        weight = np.pad(weight, ((0, (high << size) - height), (0, (wide << size) - width))).reshape(high, 1 << size, wide, 1 << size).sum((1, 3))
        better = weight < best
        best, modes = np.where(better, weight, best), np.where(better, mode, modes).astype(np.uint8)
        out = np.where(_spread(better, size, height, width)[..., None], rest, out)
    out[0, 1:] = argb[0, 1:] - argb[0, :-1]
    out[1:, 0] = argb[1:, 0] - argb[:-1, 0]
    out[0, 0] = argb[0, 0] - np.array([255, 0, 0, 0], np.uint8)
    return out, modes


def forward_cross_colour(argb: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals, and for each block the factors of least squares [blocks, (255, red to blue, green to blue, green to red)]."""
    height, width, _ = argb.shape
    high, wide = -(-height >> size), -(-width >> size)
    table = np.zeros((high, wide, 4), np.uint8)
    table[..., 0] = 255
    signed = argb.view(np.int8).astype(np.float64)
    for y in range(high):
        for x in range(wide):
            b = signed[y << size : (y + 1) << size, x << size : (x + 1) << size]
            red, green, blue = (b[..., k].ravel() for k in (1, 2, 3))
            square = max(float(green @ green), 1.0)
            rounded = lambda v: np.uint8(int(np.clip(np.round(32 * v), -128, 127)) & 255)
            table[y, x, 3], table[y, x, 2] = rounded(float(green @ red) / square), rounded(float(green @ blue) / square)
            rest = blue - float(green @ blue) / square * green
            table[y, x, 1] = rounded(float(red @ rest) / max(float(red @ red), 1.0))
    e = _spread(table, size, height, width)
    part = lambda a, k: np.ascontiguousarray(a[:, :, k])
    green, red = part(argb, 2), part(argb, 1)
    out = argb.copy()
    out[:, :, 1] = (argb[:, :, 1] - _delta(part(e, 3), green)) & 255
    out[:, :, 3] = (argb[:, :, 3] - _delta(part(e, 2), green) - _delta(part(e, 1), red)) & 255
    return out, table


def _forms(argb: np.ndarray, block: int = 4):
    """Ways to write an image: (header writer, pixels, width of a row)."""
    height, width = argb.shape[:2]
    px = _pixels(argb)
    colours, index = np.unique(px, return_inverse=True)
    if len(colours) <= 256:
        yield _palette_form(argb, colours, index)
        return
    yield (lambda w: None), px, width
    less = argb.copy()
    less[:, :, 1] -= argb[:, :, 2]
    less[:, :, 3] -= argb[:, :, 2]
    yield (lambda w: w.put(1 | 2 << 1, 3)), _pixels(less), width

    def blocks(w, kind, table):
        w.put(1 | kind << 1, 3)
        w.put(block - 2, 3)
        _put_small(w, table)

    rest, modes = forward_predictor(argb, block)
    image = np.zeros((*modes.shape, 4), np.uint8)
    image[..., 0], image[..., 2] = 255, modes
    yield (lambda w: blocks(w, 0, image)), _pixels(rest), width
    crossed, table = forward_cross_colour(rest, block)
    yield (lambda w: (blocks(w, 0, image), blocks(w, 1, table))), _pixels(crossed), width


def encode_argb(argb: np.ndarray) -> bytes:
    """The bit stream of an image [height, width, 4], in the cheapest of its forms."""
    height, width = argb.shape[:2]
    if not (0 < height <= SIDE and 0 < width <= SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    forms = [(head, parse(px, row)) for head, px, row in _forms(argb)]
    head, parsed = min(forms, key=lambda f: f[1].cost()) if len(forms) > 1 else forms[0]
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1 if (argb[:, :, 0] != 255).any() else 0, 4)
    head(w)
    w.put(0, 1)
    parsed.write(w, True)
    return w.bytes()


def encode(rgba: np.ndarray) -> bytes:
    """A lossless file of RGBA samples [height, width, 4]."""
    return container(encode_argb(np.ascontiguousarray(np.asarray(rgba, np.uint8)[:, :, [3, 0, 1, 2]])))


def _encode_part(part: np.ndarray) -> bytes:
    """Grey samples: their values in the palette of a subtract-green image, their numbers with back-references."""
    n = len(part)
    width = 64 * max(1, -(-n // (64 * SIDE)))
    height = -(-n // width)
    if width * height > n:
        part = np.concatenate([part, np.zeros(width * height - n, np.uint8)])
    values = np.flatnonzero(np.bincount(part, minlength=256))
    number = np.zeros(256, np.uint8)
    number[values] = np.arange(len(values))
    # After subtract-green a grey pixel has green only.
    head, px, row = _palette_form(np.empty((height, width, 0)), values.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), number[part])
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    w.put(1 | 2 << 1, 3)
    head(w)
    w.put(0, 1)
    parse(px, row).write(w, True)
    return container(w.bytes(), b"SIZE" + struct.pack("<IQ", 8, n))


_PART = 1 << 20


def encode_bytes(payload: bytes) -> bytes:
    """Store a byte string (a positive multiple of 64 bytes) as grey samples."""
    x = np.frombuffer(payload, np.uint8)
    return b"".join(_encode_part(x[lo : lo + _PART]) for lo in range(0, len(x), _PART))


def decode_parts(media: bytes):
    """The byte samples that :func:`encode_bytes` stored, part by part."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        found = dict(chunks(media[at:end]))
        if not {b"VP8L", b"SIZE"} <= set(found):
            raise ValueError("a part lacks its image or its size")
        yield np.ascontiguousarray(_decode_argb(found[b"VP8L"])[:, :, 2]).ravel()[: int.from_bytes(found[b"SIZE"], "little")]
        at = end


def decode_bytes(media: bytes) -> np.ndarray:
    """All byte samples that :func:`encode_bytes` stored."""
    return np.concatenate(list(decode_parts(media)))


# ---- columns


def encode_column(df: DataFrame, id_col: str = "id", width_col: str = "width", height_col: str = "height", pixels_col: str = "pixels") -> DataFrame:
    """``id, media``: lossless files of RGBA pixel rows; null pixels stay null."""
    kind = df.schema[id_col].dataType.simpleString()

    def write(batches):
        for b in batches:
            for i, w, h, p in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                media = None if p is None else encode(np.frombuffer(p, np.uint8).reshape(h, w, 4))
                yield pa.RecordBatch.from_arrays([pa.array([i], b.schema.field(0).type), pa.array([media], pa.binary())], ["id", "media"])

    return df.select(df[id_col].alias("id"), df[width_col].cast("int"), df[height_col].cast("int"), df[pixels_col]).mapInArrow(write, f"id {kind}, media binary")


def decode_column(df: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """``id, width, height, pixels`` (RGBA rows) of a column of lossless files; null stays null."""
    kind = df.schema[id_col].dataType.simpleString()

    def read(batches):
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                img = None if m is None else decode(m)
                rows = [[i], *([[None]] * 3 if img is None else [[img.shape[1]], [img.shape[0]], [img.tobytes()]])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (b.schema.field(0).type, pa.int32(), pa.int32(), pa.binary()), strict=True)], ["id", "width", "height", "pixels"])

    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(read, f"id {kind}, width int, height int, pixels binary")


def padded(text: bytes) -> bytes:
    """The payload of a text: bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def encode_texts(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as lossless files."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data, offsets = utf8(part.column(1))
                done: dict[bytes, bytes] = {}  # copies within a lot are written once
                sizes, media = [], []
                for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = data[a:z].tobytes()
                    if text not in done:
                        done[text] = encode_bytes(padded(text))
                    sizes.append(z - a)
                    media.append(done[text])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


class Summary:
    """Digests and features of samples that come part by part (all but the last in whole rows of 64)."""

    def __init__(self):
        self.sha, self.n, self.tail, self.step, self.counts = hashlib.sha256(), 0, b"", 0, np.zeros(256, np.int64)

    def add(self, samples: np.ndarray) -> None:
        raw = samples.tobytes()
        self.sha.update(raw)
        self.n += len(raw)
        self.tail = raw[-64:]
        self.counts += np.bincount(samples, minlength=256)
        self.step += int(np.abs(np.diff(samples.reshape(-1, 64).astype(np.int16), axis=1)).sum(dtype=np.int64))

    def feature(self) -> str:
        """Sum, distinct values, most frequent value, and sum of horizontal steps in rows of 64."""
        return f"sum={int((self.counts * np.arange(256)).sum())};distinct={int((self.counts > 0).sum())};mode={int(self.counts.argmax())};step={self.step}"


_FIELDS = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def describe(media: bytes) -> tuple:
    """What a stored text's files hold, read back."""
    s = Summary()
    for part in decode_parts(media):
        s.add(part)
    return s.n, s.sha.hexdigest(), zlib.crc32(s.tail), len(media), hashlib.sha256(media).hexdigest(), s.feature()


def describe_media(stored: DataFrame) -> DataFrame:
    """``doc_id, n_bytes`` of a column of stored texts with digests and features of the bytes read back."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            done: dict[bytes, tuple] = {}
            rows = []
            for m in b.column(2):
                m = m.as_py()
                key = hashlib.sha256(m).digest()
                if key not in done:
                    done[key] = describe(m)
                rows.append(done[key])
            columns = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)]], ["doc_id", "n_bytes", *[n for n, _ in _FIELDS]])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store_texts(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Every whole text written to a media table in the shared folder, read back and described."""
    return describe_media(cut(encode_texts(docs, id_col=id_col, text_col=text_col), "media"))


def op1_webp(spark, sf_dir):
    """All documents as lossless images."""
    from clusterloom.llm.common import table

    return store_texts(table(spark, sf_dir, "documents"))
