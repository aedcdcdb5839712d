"""Run-length index of a text: run-compressed Burrows-Wheeler transform with sampled run ends.

The index answers matching statistics for many patterns at once: for each position of a
pattern, the length of the longest match of the text that starts there. Patterns are read
from their ends. While the next symbol is the row's symbol the row moves by LF; otherwise
the nearest runs of that symbol above and below are tried, their text positions are known
from the run-end samples, and the one with the longer common extension goes on. Common
extensions come from the ranks that suffix sorting leaves behind.

The text is a list of strings, each ended by a separator that no pattern holds and that
compares by position, so matches never cross strings.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFFFF
_PACK = 4  # symbols compared by the first sort


class RunIndex:
    """``text``: 16-bit symbols, with a separator after every string."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        self.text = np.concatenate([text, np.full(_PACK, SEPARATOR, np.uint16)])
        self._sort()
        sa = self.sa
        bwt = self.text[sa - 1]  # the text is a ring: before the first symbol comes the last separator
        bwt[sa == 0] = SEPARATOR
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.start = np.concatenate([[0], change]).astype(np.int64)
        self.symbol = bwt[self.start]
        end = np.concatenate([change, [n]]).astype(np.int64) - 1
        self.first_sample, self.last_sample = sa[self.start].astype(np.int64), sa[end].astype(np.int64)
        self.end = end
        # LF of a run's first row: symbols smaller, and equal ones in runs before.
        length = end - self.start + 1
        order = np.argsort(self.symbol, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        self.lf = np.empty(len(order), np.int64)
        self.lf[order] = before
        runs = len(order)
        self.runs = runs
        self.by_symbol = self.symbol[order].astype(np.int64) * runs + order  # ascending
        self.run_order = order
        del self.sa

    def _sort(self) -> None:
        n, text = self.n, self.text
        key = np.zeros(n, np.uint64)
        closed = np.zeros(n, bool)
        for k in range(_PACK):
            b = text[k : k + n]
            key = (key << np.uint64(16)) | np.where(closed, SEPARATOR, b).astype(np.uint64)
            closed |= b == SEPARATOR
        self.ranks, h = [], _PACK
        sa = np.argsort(key, kind="stable")
        sorted_key = key[sa]
        new = np.ones(n, bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | closed[sa[1:]]
        while True:
            rank = np.empty(n + 1, np.int32)
            rank[sa] = np.cumsum(new) - 1
            rank[n] = -1
            self.ranks.append((h, rank))
            open_ = ~new
            open_[:-1] |= ~new[1:]
            at = np.flatnonzero(open_)  # rows whose order is not settled
            if not len(at):
                break
            i = sa[at]
            key = rank[i].astype(np.int64) * (n + 2) + rank[np.minimum(i + h, n)] + 1
            o = np.argsort(key, kind="stable")
            sa[at] = i[o]
            k = key[o]
            fresh = np.ones(len(at), bool)
            fresh[1:] = k[1:] != k[:-1]
            new[at] = fresh | new[at]
            h *= 2
        self.sa = sa

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes a and b, up to ``most``."""
        n = self.n
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for h, rank in reversed(self.ranks[:-1]):
            same = (rank[a] == rank[b]) & (a < n)
            step = np.where(same, h, 0)
            a, b, out = np.minimum(a + step, n), np.minimum(b + step, n), out + step
        live = np.flatnonzero(out < most)
        for _ in range(_PACK):
            if not len(live):
                break
            x, y = self.text[np.minimum(a[live], n)], self.text[np.minimum(b[live], n)]
            live = live[(x == y) & (x != SEPARATOR)]
            a[live] += 1
            b[live] += 1
            out[live] += 1
        return np.minimum(out, most)

    def matching_statistics(self, patterns: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Longest match that starts at each position of each pattern ``patterns[offsets[i]:offsets[i+1]]``."""
        out = np.zeros(len(patterns), np.int64)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        stops = offsets[1:][order]
        sizes = sizes[order]
        m = len(order)
        row = np.zeros(m, np.int64)
        place = np.full(m, self.first_sample[0] if self.runs else 0, np.int64)  # text position of the row
        length = np.zeros(m, np.int64)
        for step in range(int(sizes[0]) if m else 0):
            live = int(np.searchsorted(-sizes, -step, "left"))  # patterns longer than step
            q, at, got = row[:live], place[:live], length[:live]
            i = stops[:live] - 1 - step
            c = patterns[i]
            run = np.searchsorted(self.start, q, "right") - 1
            stay = self.symbol[run] == c
            off = np.flatnonzero(~stay)
            if len(off):
                target = c[off].astype(np.int64) * self.runs
                j = np.searchsorted(self.by_symbol, target + run[off])
                below = np.minimum(j, self.runs - 1)
                above = np.maximum(j - 1, 0)
                low_ok = (self.by_symbol[below] >= target) & (self.by_symbol[below] < target + self.runs) & (j < self.runs)
                up_ok = (self.by_symbol[above] >= target) & (self.by_symbol[above] < target + self.runs) & (j > 0)
                r_low, r_up = self.run_order[below], self.run_order[above]
                p_low, p_up = self.first_sample[r_low], self.last_sample[r_up]
                e_low = np.where(low_ok, self.extension(at[off], p_low, got[off]), -1)
                e_up = np.where(up_ok, self.extension(at[off], p_up, got[off]), -1)
                take_low = e_low >= e_up
                best = np.maximum(e_low, e_up)
                found = best >= 0
                run[off] = np.where(take_low, r_low, r_up)
                q[off] = np.where(take_low, self.start[r_low], self.end[r_up])
                at[off] = np.where(take_low, p_low, p_up)
                got[off] = np.where(found, best, -1)
                lost = off[~found]  # the symbol is not in the text: start again before it
                if len(lost):
                    run[lost], q[lost], at[lost] = 0, 0, self.first_sample[0]
            hit = got >= 0
            q[:] = np.where(hit, self.lf[run] + q - self.start[run], q)
            at[:] = np.where(hit, np.where(at == 0, self.n - 1, at - 1), at)
            got[:] = np.where(hit, got + 1, 0)
            out[i] = got
        return out
