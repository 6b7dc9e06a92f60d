"""Suffix order, common prefixes and what follows from them, on bytes; no Spark here."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

_WORD = 7  # bytes of the first sort key; the eighth holds how many bytes remain, so a prefix sorts before its extensions


class Ranks:
    """Ranks of all places of the parts by their first 7, 14, 28, ... bytes, until all differ; common prefixes follow from them."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        n = int(sizes.sum())
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.part = np.repeat(np.arange(len(parts)), sizes)
        self.remain = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        padded = np.append(self.raw, np.zeros(_WORD, np.uint8)).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(_WORD):
            key = (key << np.uint64(8)) | np.where(self.remain > k, padded[k : k + n], np.uint64(0))
        key = (key << np.uint64(8)) | np.minimum(self.remain, _WORD).astype(np.uint64)
        self.levels: list[tuple[int, np.ndarray]] = []
        depth, longest = _WORD, int(sizes.max(initial=0))
        while n:
            rank, distinct = _dense(key)
            self.levels.append((depth, rank))
            if distinct == n or depth >= longest:
                break
            follow = np.zeros(n, np.uint64)
            inside = np.flatnonzero(self.remain > depth)
            follow[inside] = rank[inside + depth].astype(np.uint64) + np.uint64(1)
            key = (rank.astype(np.uint64) << np.uint64(32)) | follow
            depth *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, pair by pair."""
        room = np.minimum(self.remain[a], self.remain[b])
        out = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            for _ in range(2 if size == self.levels[-1][0] else 1):
                live = np.flatnonzero(out + size <= room)
                same = live[rank[a[live] + out[live]] == rank[b[live] + out[live]]]
                out[same] += size
        for _ in range(_WORD):
            live = np.flatnonzero(out < room)
            same = live[self.raw[a[live] + out[live]] == self.raw[b[live] + out[live]]]
            if not len(same):
                break
            out[same] += 1
        return out


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the keys from 0, equal ones alike, and how many differ."""
    order = np.argsort(key)
    ordered = key[order]
    step = np.zeros(len(key), np.int32)
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(step, out=step)
    return rank, int(step[-1]) + 1 if len(key) else 0


def suffix_order(parts: list[bytes], ranks: Ranks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the parts in unsigned byte order: position in the concatenation, part, common prefix with the one before.

    Suffixes end with their part; equal suffixes of different parts stand in the order of the parts.
    """
    ranks = Ranks(parts) if ranks is None else ranks
    if not ranks.levels:
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(ranks.levels[-1][1], kind="stable")
    return order, ranks.part[order], np.append(0, ranks.common(order[:-1], order[1:]))


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and the common prefix lengths of neighbours (the first is 0)."""
    order, _, lcp = suffix_order([text])
    return order, lcp


def suffix_places(text: bytes) -> np.ndarray:
    """The suffix array alone."""
    levels = Ranks([text]).levels
    return np.argsort(levels[-1][1], kind="stable") if levels else np.zeros(0, np.int64)


def bwt(text: bytes, sa: np.ndarray) -> np.ndarray:
    """Byte before each suffix, 0 before the whole text."""
    raw = np.frombuffer(text, np.uint8)
    return np.where(sa > 0, raw[sa - 1], 0).astype(np.uint8)


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Internal lcp-intervals (lcp, lb, rb) bottom-up, the root (lcp 0) last; none for an empty text."""
    n = len(lcp)
    if not n:
        return []
    out, stack = [], [(0, 0)]
    for i, v in enumerate([*lcp.tolist()[1:], 0], 1):
        lb = i - 1
        while stack[-1][0] > v:
            top, lb = stack.pop()
            out.append((top, lb, i - 1))
        if stack[-1][0] < v:
            stack.append((v, lb))
    out.append((0, 0, n - 1))
    return out


def occurrences(text: bytes, query: bytes) -> list[int]:
    """Starts of all occurrences, overlaps too, in text order; an empty query occurs at every byte."""
    if not query:
        return list(range(len(text)))
    out, at = [], text.find(query)
    while at >= 0:
        out.append(at)
        at = text.find(query, at + 1)
    return out


def first_occurrence(text: bytes, query: bytes) -> list[int]:
    """Start of the first occurrence, if there is one."""
    at = text.find(query)
    return [at] if at >= 0 else []


def _next_smaller(values: list[int]) -> np.ndarray:
    """Place of the next smaller value of each, or the length."""
    n = len(values)
    out, stack = [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def tandems(text: bytes) -> list[tuple[int, int, int]]:
    """(left, right, period) of every maximal run of that period and at least twice its length.

    The smallest period of a run is the length of a Lyndon word of one of the two orders of bytes that starts in it, so
    from each place the two longest ones are extended to both sides; a run has the multiples of its period, too.
    """
    n = len(text)
    if n < 2:
        return []
    ahead, back = Ranks([text]), Ranks([text[::-1]])
    found = []
    place = ahead.levels[-1][1].astype(np.int64)
    for smaller in (place, _reverse_order(text)):
        i = np.arange(n)
        j = _next_smaller(smaller.tolist())
        i, j = i[j < n], j[j < n]
        right = j + ahead.common(i, j)
        left = i.copy()
        inner = np.flatnonzero(i > 0)
        left[inner] -= back.common(n - i[inner], n - j[inner])
        ok = right - left >= 2 * (j - i)
        found.append(np.stack([left[ok], right[ok], (j - i)[ok]], 1))
    runs = np.unique(np.concatenate(found), axis=0)
    # A run with a multiple of its smallest period may be met under both: the smallest stands first.
    first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]
    runs = runs[first]
    times = (runs[:, 1] - runs[:, 0]) // 2 // runs[:, 2]
    rows = np.repeat(runs, times, axis=0)
    rows[:, 2] *= np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times) + 1
    return sorted(map(tuple, rows.tolist()))


def _reverse_order(text: bytes) -> np.ndarray:
    """Rank of each suffix if greater bytes came first; a prefix still sorts before its extensions."""
    return Ranks([bytes(255 - x for x in text)]).levels[-1][1].astype(np.int64)


def factors(text: bytes) -> list[tuple[int, int]]:
    """Lempel-Ziv factors (position, length): the longest text that also starts earlier, at its leftmost place, or one new byte at its own.

    The longest earlier text at each place follows from its two neighbours in suffix order that start before it; the
    leftmost place of a factor is the smallest position among the suffixes that begin with it.
    """
    n = len(text)
    if not n:
        return []
    ranks = Ranks([text])
    sa, _, lcp = suffix_order([text], ranks)
    positions = sa.tolist()
    longest = np.zeros(n, np.int64)
    for order in (sa, sa[::-1]):
        near = _next_smaller(order.tolist())
        there = np.flatnonzero(near < n)
        at, earlier = order[there], order[near[there]]
        longest[at] = np.maximum(longest[at], ranks.common(at, earlier))
    reach, starts, i = longest.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += max(reach[i], 1)
    starts = np.array(starts, np.int64)
    size = longest[starts]
    repeated = np.flatnonzero(size)
    where = starts.copy()
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    lo, hi = SparseMin(lcp).reach(rank[starts[repeated]], size[repeated])
    where[repeated] = sa[SparseMin(positions).queries(lo, hi)]
    return list(zip(where.tolist(), np.maximum(size, 1).tolist(), strict=True))


def palindrome(text: bytes) -> bytes:
    """The longest palindrome; of several the smallest. Linear: mirrored radii around all bytes and gaps."""
    n = len(text)
    radius = [0] * (2 * n + 1)  # at 2i+1 the byte i, at 2i the gap before it
    mid = right = 0
    for c in range(2 * n + 1):
        r = min(radius[2 * mid - c], right - c) if c < right else 0
        while c - r > 0 and c + r < 2 * n and ((c - r) % 2 == 1 or text[(c - r) // 2 - 1] == text[(c + r) // 2]):
            r += 1
        radius[c] = r
        if c + r > right:
            mid, right = c, c + r
    size = max(radius)
    return min((text[(c - size) // 2 : (c + size) // 2] for c, r in enumerate(radius) if r == size), default=b"") if n else b""


def rotation(text: bytes) -> bytes:
    """The smallest rotation, by comparing two candidate starts at a time."""
    n, i, j, k = len(text), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = text[(i + k) % n], text[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    s = min(i, j)
    return text[s:] + text[:s]


def common_substring(a: bytes, b: bytes) -> bytes:
    """The longest substring of both; of several the smallest."""
    order, side, lcp = suffix_order([a, b])
    if len(order) < 2:
        return b""
    ok = np.append(False, side[1:] != side[:-1])
    m = int(np.where(ok, lcp, 0).max())
    if not m:
        return b""
    first = int(order[np.flatnonzero(ok & (lcp == m))[0]])
    return (a + b)[first : first + m]


def unique_matches(a: bytes, b: bytes) -> list[bytes]:
    """Substrings once in each text that no byte to either side extends, in suffix order."""
    order, side, lcp = suffix_order([a, b])
    n = len(order)
    if n < 2:
        return []
    both, after = a + b, np.append(lcp[2:], 0)
    at, pair = np.arange(1, n), lcp[1:]
    ok = (side[1:] != side[:-1]) & (pair > lcp[:-1]) & (pair > after)
    out = []
    for i in at[ok]:
        p, q = int(order[i - 1]), int(order[i])
        first = {0, len(a)}
        if p in first or q in first or both[p - 1] != both[q - 1]:
            out.append(both[p : p + int(lcp[i])])
    return out


def supermaximal(text: bytes) -> list[tuple[int, int, int]]:
    """(lcp, lb, rb) of repeats that no other repeat contains: local maxima of lcp with different bytes to the left of all."""
    sa, lcp = suffix_array(text)
    out, n, i = [], len(sa), 1
    left = [text[p - 1] if p else -1 for p in sa.tolist()]
    while i < n:
        v, j = int(lcp[i]), i
        while j + 1 < n and lcp[j + 1] == v:
            j += 1
        if v > lcp[i - 1] and (j + 1 >= n or lcp[j + 1] < v):
            own = left[i - 1 : j + 1]
            if len(set(own)) == len(own):
                out.append((v, i - 1, j))
        i = j + 1
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def gram_hashes(text: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every substring of that size, from prefix sums."""
    n = len(text)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = np.full(n, _BASE), np.full(n - size + 1, _INVERSE)
    up[0] = down[0] = 1
    total = np.append(np.uint64(0), np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * np.cumprod(up)))
    h = (total[size:] - total[:-size]) * np.cumprod(down)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class SparseMin:
    """Leftmost position of the minimum of any range, from tables of powers of two."""

    def __init__(self, values):
        self.values = np.asarray(values, np.int64)
        self.rows = [np.arange(len(self.values), dtype=np.int32)]
        step = 1
        while 2 * step <= len(self.values):
            a, b = self.rows[-1][:-step], self.rows[-1][step:]
            self.rows.append(np.where(self.values[b] < self.values[a], b, a))
            step *= 2

    def query(self, i: int, j: int) -> int:
        """Leftmost argmin of values[i..j]."""
        return int(self.queries(np.array([i]), np.array([j]))[0])

    def queries(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Leftmost argmin of values[i..j] of each pair; a range out of bounds raises."""
        bad = np.flatnonzero((i > j) | (j >= len(self.values)) | (i < 0))
        if len(bad):
            raise IndexError(f"no range {i[bad[0]]}..{j[bad[0]]} in {len(self.values)} entries")
        level = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            a, b = self.rows[k][i[own]], self.rows[k][j[own] - (1 << int(k)) + 1]
            out[own] = np.where(self.values[b] < self.values[a], b, a)
        return out

    def reach(self, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest [lo, hi] around each place whose values from lo + 1 to hi are at least `least`."""
        lo, hi, n = at.copy(), at.copy(), len(self.values)
        for k in range(len(self.rows) - 1, -1, -1):
            step, row = 1 << k, self.rows[k]
            own = np.flatnonzero(lo - step >= 0)
            own = own[self.values[row[lo[own] - step + 1]] >= least[own]]
            lo[own] -= step
            own = np.flatnonzero(hi + step < n)
            own = own[self.values[row[hi[own] + 1]] >= least[own]]
            hi[own] += step
        return lo, hi

    @property
    def nbytes(self) -> int:
        """Bytes of the tables beyond the values."""
        return sum(r.nbytes for r in self.rows[1:])


def bisect(text: bytes, sa, query: bytes, start: int = 0, stop: int | None = None) -> tuple[int, int]:
    """First rank in start..stop whose suffix's first len(query) bytes are not below the query, and first whose are above."""
    stop = len(sa) if stop is None else min(stop, len(sa))
    size, head = len(query), lambda p: text[p : p + len(query)]
    lo = bisect_left(sa, query, start, max(start, stop), key=head)
    return lo, bisect_right(sa, query, lo, max(lo, stop), key=head) if size else max(lo, stop)
