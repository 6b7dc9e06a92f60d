"""Operators on documents against brute force: decontamination, mixing, SimHash, suffix dedup."""

import hashlib
import math
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandex.llm import decontaminate, mixing, simhash, suffix_dedup

from .conftest import SCHEMA, prose


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- decontamination


def hits_by_hand(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws = []
    for item_id, text in items:
        w = word.findall(lowered(text))
        n = min(len(w), window)
        ws += [("" if item_id is None else str(item_id), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for r in docs:
        w = word.findall(lowered(r[1]))
        hit, ids = set(), set()
        for item_id, v in ws:
            for i in range(len(w) - len(v) + 1):
                if w[i : i + len(v)] == v:
                    hit |= set(range(i, i + len(v)))
                    ids.add(item_id)
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench(edge_rows):
    base = edge_rows[0][1].split()
    return [(1, " ".join(base[20:45])), (22, " ".join(base[20:32])), (3, "Same, ROW!"), (4, None), (5, "..."), (None, "one TWO three"), (7, " ".join(base[20:45])), (8, "漢字"), (9, prose(99, 30))]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontaminate(spark, edges, edge_rows, bench, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    got = decontaminate.report(edges, spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str) == hits_by_hand(edge_rows, bench)


def test_decontaminate_keeps_the_clean(spark, clashing, edge_rows, bench, nothing):
    items = spark.createDataFrame(bench, "item_id long, text string")
    kept = decontaminate.clean(clashing, items)
    want = Counter(r[0] for r, h in zip(sorted(edge_rows, key=lambda r: str(r[0])), sorted(hits_by_hand(edge_rows, bench), key=lambda r: str(r[0])), strict=True) if not h[-1])
    assert kept.columns == clashing.columns and Counter(r["doc_id"] for r in kept.collect()) == want
    assert decontaminate.report(nothing, items).count() == 0
    assert decontaminate.report(clashing, items.limit(0)).where("contaminated").count() == 0


# --- mixing


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **level}
        fixed |= {s: 3 * sizes[s] for s in over}


def multiplier_by_hand(sizes, target):
    mean = sum(sizes) / len(sizes)
    low, high = -1e5, 1e5
    for _ in range(100):
        mid = (low + high) / 2
        words = math.fsum(s * math.exp(min(math.log(3), mid * (s / mean))) for s in sizes)
        low, high = (mid, high) if words < target else (low, mid)
    return (low + high) / 2


def test_mixing(spark, edges, edge_rows, nothing):
    rows = edge_rows + [(100 + i, prose(i, 20 + i % 37), "en", "abc"[i % 3 if i % 5 else 0], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r[3], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
    want = targets_by_hand({s: sum(x) for s, x in sizes.items()})
    for s in want:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sum(sizes[s]) and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
        if 0 < want[s] < 3 * sum(sizes[s]):
            lam, mean = multiplier_by_hand(sizes[s], want[s]), sum(sizes[s]) / len(sizes[s])
            for r in own:  # a document's copies are its tilted rate, rounded down or up
                rate = min(3, math.exp(lam * r["size"] / mean))
                assert math.floor(rate - 1e-6) <= r["copies"] <= math.ceil(rate + 1e-6)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken").collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter(map(tuple, again))
    assert mixing.mix(nothing).count() == 0


def test_mixing_clashing_columns(clashing, edges):
    out = mixing.mix(clashing)
    assert out.columns == [c for c in clashing.columns if c not in mixing.RESULT] + list(mixing.RESULT)
    same = ["doc_id", "text", "size", "copies", "taken", "target"]
    assert Counter(map(tuple, out.select(same).collect())) == Counter(map(tuple, mixing.mix(edges).select(same).collect()))


def test_newton_meets_the_dual(spark):
    counts = {"a": {3: 50, 10: 7, 400: 1}, "b": {1: 9}, "c": {0: 4}, "d": {5: 1000, 7: 3, 90_000: 2}, None: {17: 1, 2: 5}}
    sized = spark.createDataFrame([(s, k, n) for s, x in counts.items() for k, n in x.items()], "source string, size long, n long")
    rows = sized.select(F.explode(F.array_repeat(F.struct(mixing._key(F.col("source")).alias("key"), "size"), F.col("n").cast("int"))).alias("x")).select("x.*")
    known, _ = mixing.rates(rows)
    want = targets_by_hand({s: sum(k * n for k, n in x.items()) for s, x in counts.items()})
    seen = set()
    for r in known.collect():
        x = counts[r["key"][1:] if r["key"] else None]
        assert math.isclose(r["target"], want[r["key"][1:] if r["key"] else None], rel_tol=1e-12)
        if r["lam"] is not None:
            words = math.fsum(n * k * min(3, math.exp(r["lam"] * k / r["mean"])) for k, n in x.items())
            assert math.isclose(words, r["target"], rel_tol=1e-9)
            seen.add(r["key"])
        else:
            assert r["fixed"] == (3.0 if r["source_size"] else 1.0)
    assert seen


def test_gradient_of_the_dual(spark):
    sizes, lam, target = {2: 5, 30: 3, 100: 2}, 0.4, 700.0
    mean = sum(k * n for k, n in sizes.items()) / sum(sizes.values())

    def dual(v):
        psi = lambda z: math.exp(z) - 1 if z <= math.log(3) else 2 + 3 * (z - math.log(3))
        return sum(n * psi(v * k / mean) for k, n in sizes.items()) - v * target / mean

    state = spark.createDataFrame([("=a", target, mean, lam, None, None, None, False)], "key string, target double, mean double, lam double, lo double, hi double, miss double, done boolean")
    step = mixing.newton(state, spark.createDataFrame([("=a", k, n) for k, n in sizes.items()], "key string, size long, n long"), True).first()
    gradient = (dual(lam + 1e-6) - dual(lam - 1e-6)) / 2e-6
    hessian = sum(n * (k / mean) ** 2 * math.exp(lam * k / mean) for k, n in sizes.items() if lam * k / mean < math.log(3))
    assert math.isclose(step["miss"] / mean, abs(gradient), rel_tol=1e-6)
    assert math.isclose(step["lam"], lam - gradient / hessian, rel_tol=1e-5)


# --- SimHash


def fingerprint_by_hand(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps):
    label = {f: f for f in set(fps)}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints(edges, edge_rows):
    texts = [r[1] for r in edge_rows] + ["  a  b\x0bc d\te ", "w" * 100 + " " + "v" * 33 + " é " * 300, " lead"]
    raw = [(t or "").encode() for t in texts]
    got = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert got.tolist() == [fingerprint_by_hand(t) for t in texts]


def test_xxh64():
    rng = np.random.default_rng(0)
    buf = np.concatenate([rng.integers(0, 256, 400, dtype=np.uint8), np.zeros(8, np.uint8)])
    start = rng.integers(0, 200, 300)
    end = start + rng.integers(0, 200, 300)
    assert simhash.xxh64(buf, start, end).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), seed=42) for a, b in zip(start, end, strict=True)]


@pytest.mark.parametrize("block", [1024, 3])
def test_links_reach_the_same_components(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(40):
        centre = int(rng.integers(0, 1 << 63))
        fps.append(centre)
        for k in range(12):
            f = fps[-1] if k % 2 else centre
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    ids = [int(x) for x in rng.permutation(len(fps))]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.with_component(spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")).collect()
    label = components_by_hand(fps)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[label[f]] = min(i, least.get(label[f], i))
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[label[f]] for i, f in zip(ids, fps, strict=True)}


@pytest.mark.parametrize("copies", [3, 60])
def test_wide_links_find_pairs_within_the_distance(spark, copies):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(30):
        centre = [int(x) for x in rng.integers(0, 1 << 63, simhash.WIDE_LANES)]
        for k in range(copies):
            f = list(centre)
            for b in rng.choice(256, int(rng.integers(0, 20)) if k else 0, replace=False):
                f[b // 64] ^= 1 << int(b % 64)
            want[len(rows)] = g * copies
            rows.append((len(rows), *(x - (1 << 64) if x >> 63 else x for x in f)))
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"f{k} long" for k in range(simhash.WIDE_LANES)))
    assert {r["doc_id"]: r["component_id"] for r in simhash.with_wide_component(df).collect()} == want


def test_wide_links_are_the_pairs_within_the_distance(spark):
    """Isolated pairs of 0 to 44 bits apart, some with all segments but one equal or one alone equal."""
    rng = np.random.default_rng(11)
    rows, want = [], set()
    edges = [64 * lane + b for lane in range(simhash.WIDE_LANES) for b in simhash.BOUNDS[:-1]]
    for apart in range(45):
        for kind in range(6):
            f = [int(x) for x in rng.integers(0, 1 << 63, simhash.WIDE_LANES)]
            spread = rng.choice(256, apart, replace=False) if kind else range(edges[apart % 20], edges[apart % 20] + min(apart, 12))
            if kind == 5 and apart >= 19:  # two bits in every other segment or in all but one
                spread = [e + x for n, e in enumerate(edges) if n % 2 for x in range(2)] if apart % 2 else [e + x for n, e in enumerate(edges) if n for x in range(2)]
            other = list(f)
            for b in spread:
                other[int(b) // 64] ^= 1 << int(b) % 64
            if len(spread) <= 19:
                want.add((len(rows), len(rows) + 1))
            for x in (f, other):
                rows.append((len(rows), *(y - (1 << 64) if y >> 63 else y for y in x)))
    df = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{k} long" for k in range(simhash.WIDE_LANES)))
    assert {(r["u"], r["v"]) for r in simhash.wide_links(df).collect()} == want


def test_wide_links_follow_the_chain_from_the_key():
    """Rows of one key whose second segment is too far, though the whole distance is small: another start has to find them."""
    f = np.zeros((2, simhash.WIDE_LANES), np.int64)
    f[1, 0] = 0b11 << 20  # two bits of the second segment, beyond the key's half

    def links(start):
        batch = pa.RecordBatch.from_arrays([pa.array([start * 2 << 32] * 2), pa.array([5, 6]), *(pa.array(f[:, k].copy()) for k in range(simhash.WIDE_LANES))], ["k", "node", "f0", "f1", "f2", "f3"])
        return [(u, v) for b in simhash._wide_links(iter([batch])) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    assert [start for start in range(simhash.RING) if links(start)] == [start for start in range(2, simhash.RING)]


def test_survivors(clashing, nothing, edges):
    kept = simhash.survivors(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 4 in ids and 5 not in ids and 6 not in ids and ids.count(10) == 1 and 7 in ids and 12 in ids and not (14 in ids and 15 in ids)
    assert simhash.survivors(nothing).count() == 0
    apart = simhash.survivors(edges.union(edges.where("doc_id = 7 OR doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("other "), F.reverse("text")))))
    assert apart.where("doc_id IS NULL").count() == 3  # rows without id are apart from each other
    tagged = simhash.with_fingerprint(edges.select("doc_id", "text"))
    assert simhash.with_component(tagged).count() == edges.count()


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (lowered(a).split(), lowered(b).split()))
    return len(x & y) / len(x | y)


def pairs_of_similarity(lo, hi, n, words=150):
    """n pairs of texts, apart from each other, with lo <= similarity < hi."""
    rng, out = np.random.default_rng(int(lo * 1000)), []
    while len(out) < n:
        a = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
        b = list(a)
        tail = round(words * (1 - lo) / (1 + lo) * rng.uniform(0.8, 1.2))
        b[len(b) - tail :] = [f"v{x}" for x in rng.integers(0, 1 << 40, tail)]
        if lo <= jaccard(" ".join(a), " ".join(b)) < hi:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_survivors_keep_what_is_less_similar(spark):
    pairs = pairs_of_similarity(0.70, 0.80, 60)
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    assert simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_survivors_miss_no_similar_pair(spark):
    pairs = pairs_of_similarity(0.80, 0.85, 200) + pairs_of_similarity(0.85, 0.9, 20)
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    kept = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(rows), 2))


@pytest.mark.parametrize(("block", "frequent"), [(512, 5), (2, 2)])
def test_remaining_links_join_all_similar_pairs(spark, block, frequent, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", block)
    monkeypatch.setattr(simhash, "FREQUENT_LEAST", frequent)
    rng, texts = np.random.default_rng(5), []
    for g in range(12):
        base = [f"g{g}_{x}" for x in range(40 + 10 * g)]
        for _ in range(6):
            w = list(base)
            for k in rng.choice(len(w), int(rng.integers(0, 5)), replace=False):
                w[k] = f"x{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(w))
    texts += ["", "a", "A b", "a  B", "one two three four five", "one two three four five six"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "node long, text string")
    tree = spark.createDataFrame([(1, 0), (2, 0)], "node long, root long")
    got = [(r["u"], r["v"]) for r in simhash.remaining_links(df, tree, len(rows)).collect()]
    want = [(i, j) for i, a in rows for j, b in rows if i < j and a and b and jaccard(a, b) >= 0.8]
    joined = [(1, 0), (2, 0)]
    assert classes(len(rows), got + joined) == classes(len(rows), want + joined) and len(got) < len(want)


def classes(n, pairs):
    label = list(range(n))
    while True:
        before = list(label)
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
        if label == before:
            return label


def test_simhash_query_against_all_pairs(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    prints = [fingerprint_by_hand(t) for _, t in docs]
    f = np.array(prints, np.uint64)
    label = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    while True:
        low = np.where(near, label[None, :], len(f)).min(1)
        if (low == label).all():
            break
        label = low
    least = {}
    for (i, _), k in zip(docs, label.tolist(), strict=True):
        least[k] = min(i, least.get(k, i))
    want = sorted((i, f"{p:016x}", least[k]) for (i, _), p, k in zip(docs, prints, label.tolist(), strict=True))
    assert sorted(map(tuple, simhash.query(spark, "/root/testdata/sf0.01").collect())) == want


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_component_ids_by_broadcast_or_by_salt(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROOTS", limit)
    rows = [(i, (1 << (i % 40)) if i < 200 else -1 << 40) for i in range(210)] + [(None, 1 << 50), (None, 7 << 20)]
    got = simhash.with_component(spark.createDataFrame(rows, "doc_id long, fp long"))
    for r in got.collect():  # bits set alone are two apart
        assert r["component_id"] == (0 if r["doc_id"] is None or r["doc_id"] < 200 else 200)


def test_long_runs_are_put_together_once():
    import pyarrow as pa

    k = np.repeat(np.arange(6), [1, 5000, 1, 2, 3000, 4])
    v = np.arange(len(k))
    batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 700]), pa.array(v[i : i + 700])], ["k", "v"]) for i in range(0, len(k), 700)]
    out = list(simhash._whole_runs(iter([batches[0].slice(0, 0), *batches])))
    assert np.concatenate([c[1] for c in out]).tolist() == v.tolist()
    ends = [c[0][-1] for c in out]
    assert len(set(ends)) == len(ends) and all(a[0][-1] < b[0][0] for a, b in zip(out[:-1], out[1:], strict=True))


def test_sketches_of_similar_sets_differ_in_few_bins():
    rng = np.random.default_rng(11)
    for n in (1, 3, 10, 40, 100, 1000):
        most = []
        for _ in range(300):
            total = max(1, round(n / 0.9))
            h = np.unique(rng.integers(0, 1 << 63, total, dtype=np.uint64) << np.uint64(1))
            x, y = np.sort(rng.permutation(h)[:n]), np.sort(rng.permutation(h)[:n])
            if simhash.similar(len(np.intersect1d(x, y)), 2 * n):
                s = simhash.sketches(np.concatenate([x, y]), np.array([n, n]))
                most.append(int(simhash.unlike(s[:1], s[1:])[0]))
        assert max(most, default=0) <= simhash.most_unlike(np.array([2 * n]))[0]
    x = simhash.sketches(np.arange(64, dtype=np.uint64) << np.uint64(58) | np.uint64(5 << 20), np.array([64]))
    assert simhash.unlike(x, np.zeros((1, 4), np.uint64))[0] == 64 and simhash.unlike(x, x)[0] == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v").union(spark.range(1).selectExpr("500L AS u", "501L AS v"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


# --- suffix dedup


def removed_by_hand(rows, width=100):
    rows = sorted(((-1 << 63) if i is None else i, t or "") for i, t in rows)
    seen, out = {}, []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if seen.setdefault(s, (i, p)) != (i, p):
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("crowd", "piece"), [(1000, 1 << 20), (1, 500)])
def test_suffix_dedup(spark, edges, edge_rows, crowd, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    passage = prose(50, 30)
    rows = [(r[0], r[1]) for r in edge_rows if r[0] != 9] + [(20 + i, prose(60 + i, 15) + passage[i : 150 + 3 * i] + prose(80 + i, 9) + "é" * i) for i in range(25)]
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), piece)
    assert sorted(((-1 << 63) if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == removed_by_hand(rows)


def test_suffix_dedup_query(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = suffix_dedup.query(spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == removed_by_hand(docs)


def test_common_grams_come_last():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 300, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 200, dtype=np.uint8), passage, rng.integers(97, 123, 200, dtype=np.uint8)]) for _ in range(30)]
    raw, offsets = np.concatenate(texts), np.arange(31) * 700
    inside = suffix_dedup._grams(passage)
    forms_of = []
    for common in (None, suffix_dedup.Common(inside)):
        _, _, _, k, ph = suffix_dedup.parse(raw, offsets, common)
        forms = {}
        for x, y in zip(k.tolist(), ph.tolist(), strict=True):
            forms.setdefault(x, set()).add(y)
        forms_of.append(max(map(len, forms.values())))
    assert forms_of[0] == 30 and forms_of[1] <= 5  # a gram that holds one letter beside the passage is shared by chance


def test_memory_of_the_kernels():
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 123, suffix_dedup.PIECE, dtype=np.uint8)
    size = 168
    begin = np.arange(0, suffix_dedup.DICTIONARY - size, size)
    zero = np.zeros(len(begin), np.int64)
    tracemalloc.start()
    suffix_dedup.parse(raw, np.array([0, len(raw)]), suffix_dedup.Common(suffix_dedup._grams(raw[:10_000])))
    assert tracemalloc.get_traced_memory()[1] < 110 << 20
    tracemalloc.reset_peak()
    suffix_dedup._firsts(raw, begin, np.arange(len(begin)), zero, zero, zero + size - suffix_dedup.WIDTH)
    assert tracemalloc.get_traced_memory()[1] < 110 << 20


def test_suffix_dedup_of_texts(clashing, edges, nothing):
    out = suffix_dedup.deduplicate(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[2]["text"] == "" and by_id[2]["n_chars"] == 0 and by_id[4]["text"] is None and by_id[9]["text"] in ("a", "b") and by_id[12]["n_chars"] < 300
    assert suffix_dedup.report(nothing).count() == suffix_dedup.deduplicate(nothing).count() == 0


def test_cut_characters_go_whole():
    raw = np.frombuffer("aéb漢c".encode(), np.uint8)
    keep = np.ones(len(raw), bool)
    keep[2] = keep[5] = False
    assert raw[suffix_dedup._whole_characters(raw, keep)].tobytes().decode() == "abc"
