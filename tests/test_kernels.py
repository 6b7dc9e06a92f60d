"""Kernels against their definitions."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandex.kernels import suffixes as k

texts = st.sampled_from([b"a", b"ab", b"abc", b"\x00\x01\xff", bytes(range(256))]).flatmap(lambda a: st.lists(st.sampled_from(list(a)), max_size=40).map(bytes))
common = settings(max_examples=150, deadline=None)


def substrings(t):
    return {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


def starts(t, q):
    return [i for i in range(len(t)) if t.startswith(q, i)]


@common
@given(texts)
def test_suffix_array_and_lcp(t):
    sa, lcp = k.suffix_array(t)
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert sa.tolist() == want
    for i in range(1, len(t)):
        a, b = t[want[i - 1] :], t[want[i] :]
        n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert lcp[i] == n
    assert k.bwt(t, sa).tolist() == [t[p - 1] if p else 0 for p in want]


@common
@given(texts)
def test_intervals(t):
    _, lcp = k.suffix_array(t)
    values, n = lcp.tolist(), len(t)
    want = {(0, 0, n - 1)} if n else set()
    for i in range(1, n):
        if values[i]:
            lb, rb = i, i
            while values[lb] >= values[i]:
                lb -= 1
            while rb + 1 < n and values[rb + 1] >= values[i]:
                rb += 1
            want.add((values[i], lb, rb))
    got = k.intervals(lcp)
    assert set(got) == want and len(got) == len(want) and got == sorted(got, key=lambda x: (x[2], -x[1]))


@common
@given(texts, st.integers(0, 1000), st.integers(0, 1000))
def test_range_minimum(t, a, b):
    _, lcp = k.suffix_array(t)
    if not len(t):
        return
    i, j = sorted((a % len(t), b % len(t)))
    assert k.SparseMin(lcp).query(i, j) == min(range(i, j + 1), key=lambda x: (lcp[x], x))


@common
@given(texts, texts)
def test_two_texts(t, u):
    both = substrings(t) & substrings(u)
    size = max(map(len, both), default=0)
    assert k.common_substring(t, u) == min((s for s in both if len(s) == size), default=b"")
    unique = []
    for s in both:
        p, q = starts(t, s), starts(u, s)
        if len(p) == len(q) == 1:
            p, q, n = p[0], q[0], len(s)
            left = p == 0 or q == 0 or t[p - 1] != u[q - 1]
            right = p + n == len(t) or q + n == len(u) or t[p + n] != u[q + n]
            if left and right:
                unique.append(s)
    assert k.unique_matches(t, u) == sorted(unique)


@common
@given(texts)
def test_whole_text_functions(t):
    found = [s for s in substrings(t) if s == s[::-1]]
    size = max(map(len, found), default=0)
    assert k.palindrome(t) == min((s for s in found if len(s) == size), default=b"")
    assert k.rotation(t) == min((t[i:] + t[:i] for i in range(len(t))), default=b"")
    twice = {s for s in substrings(t) if len(starts(t, s)) > 1}
    sa, _ = k.suffix_array(t)
    assert [t[sa[lb] : sa[lb] + v] for v, lb, _ in k.supermaximal(t)] == sorted(s for s in twice if not any(s != r and s in r for r in twice))


@common
@given(texts)
def test_factors_and_tandems(t):
    want, i, n = [], 0, len(t)
    while i < n:
        size = 0
        while i + size < n and t.find(t[i : i + size + 1], 0, i + size) >= 0:
            size += 1
        want.append((t.find(t[i : i + size], 0, i + size - 1), size) if size else (i, 1))
        i += max(size, 1)
    assert k.factors(t) == want
    runs = []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and t[j] == t[j + p]:
                j += 1
            if j - i >= p:
                runs.append((i, j + p, p))
            i = max(j, i + 1)
    assert k.tandems(t) == sorted(runs)


def test_long_and_repetitive_texts():
    for t in (b"a" * 5000, b"ab" * 2500, bytes(range(256)) * 20, b"\x00" * 300 + b"\xff" * 300):
        sa, lcp = k.suffix_array(t)
        assert all(t[a:] < t[b:] for a, b in zip(sa[:50], sa[1:51], strict=False))
        assert sorted(sa.tolist()) == list(range(len(t))) and int(lcp.max()) < len(t)


def test_gram_hashes():
    t = b"abracadabra abracadabra" * 3 + bytes(range(256))
    for n in (1, 4, 32):
        h = k.gram_hashes(t, n).tolist()
        assert len(h) == len(t) - n + 1 and len(set(h)) == len({t[i : i + n] for i in range(len(h))})
        assert all((h[i] == h[0]) == (t[i : i + n] == t[:n]) for i in range(len(h)))
    assert len(k.gram_hashes(b"ab", 3)) == 0


@pytest.mark.parametrize("text", [np.random.default_rng(1).bytes(1 << 18), bytes(np.random.default_rng(2).integers(97, 101, 1 << 18, dtype=np.uint8)), (b"the quick brown fox jumps over " * 9000)[: 1 << 18], b"a" * (1 << 17)])
def test_long_texts_take_seconds(text):
    for kernel in (k.factors, k.tandems):
        began = time.process_time()
        kernel(text)
        assert time.process_time() - began < 10
