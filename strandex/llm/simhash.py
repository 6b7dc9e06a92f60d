"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, found by the pigeonring principle.

A fingerprint is split into SEGMENTS segments on a ring.  If two fingerprints differ in at most DISTANCE bits, then from
some start segment on, every chain of l consecutive segments differs in at most floor(l * DISTANCE / SEGMENTS) bits: here
0, 1, 2, 3, 4 for l = 1..5.  For each start the keys of the candidate search hold what such a chain leaves equal: the
first segment whole (0 differences), one half of the second (at most 1) and one third of the third (at most 2).  Rows
that share a key are held against the whole chain before the full Hamming check.

Documents of one fingerprint count as one row in the search.  Keys are dealt and sorted by Spark; a kernel streams over
the runs of equal keys and gives, for each run, not its pairs but a star for each set of rows that its pairs join (less
rows than the run has).  Runs beyond BLOCK rows are compared block against block, so memory stays bounded.  Components
come from alternating large-star and small-star rounds over those links.

For corpus cleaning (survivors) texts link from an exact Jaccard similarity of 0.8 over their sets of five-word shingles,
which 64 bits cannot tell.  First rows meet whose WIDE_LANES * 64-bit fingerprints differ in at most WIDE_DISTANCE bits,
by the same pigeonring search: the RING segments of all lanes form one ring, the chain of l segments from some start on
differs in at most floor(l * WIDE_DISTANCE / RING) = l - 1 bits, and keys hold the first segment and one half of the
second.  No such pair is missed; each link is verified on the texts.  That is fast for large groups, but a similarity of
0.8 may leave more bits apart (beyond RING - 1 no chain need begin with an equal segment, so that keys cannot be exact), so
a complete search follows among texts not yet in one component: of two sets with a similarity of 0.8 or more, the first
n - ceil(0.8 n) + 1 members in any one order of all shingles share a member.  The order takes shingles that are frequent
in a sample of FREQUENT_SAMPLE texts last, which saves work and changes no result.  A shingle is known by 64 hash bits.

Edge cases: null and empty text has fingerprint zero and links like any other; rows with equal doc_id each keep their
own fingerprint; a null doc_id counts only where a component has no other id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, flat, ranges, read, release, stored

DISTANCE = 4
SEGMENTS = 5
BOUNDS = (0, 13, 26, 39, 52, 64)
BLOCK = 1024
SHINGLE = 4
WIDE_LANES, WIDE_SHINGLE = 4, 5
RING = WIDE_LANES * SEGMENTS
WIDE_DISTANCE = RING - 1  # the most for which a chain begins with an equal segment
FREQUENT_SAMPLE, FREQUENT_LEAST, FREQUENT_MOST = 5000, 5, 50_000
BROADCAST_ROOTS = 1_000_000  # rows of two numbers
SALTS = 32
SKETCH_MOST = 31  # of 64 bins
GROUP_ROWS, GROUP_BYTES = 512, 4 << 20  # of a block of texts that are compared whole
COLUMNS = 2048
PIECE = 1 << 18

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_SPACE = np.uint8(32)
_MASKS = np.array([((1 << (BOUNDS[k + 1] - BOUNDS[k])) - 1) << BOUNDS[k] for k in range(SEGMENTS)], np.uint64)


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:end] for each pair, vectorised over the pairs; buf must have 8 bytes to spare at its end."""
    at8 = np.ndarray((max(0, len(buf) - 7),), "<u8", buf, 0, (1,))
    at4 = np.ndarray((max(0, len(buf) - 3),), "<u4", buf, 0, (1,))
    size = end - start
    p = start.copy()
    one, two, five = (int(x) for x in (_P1, _P2, _P5))
    h = np.full(len(start), (seed + five) % 2**64, np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        q, e = start[long].copy(), end[long] - 32
        v = [np.full(len(long), x % 2**64, np.uint64) for x in (seed + one + two, seed + two, seed, seed - one)]
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                v[k][live] = _rotl(v[k][live] + at8[q[live] + 8 * k] * _P2, 31) * _P1
            q[live] += 32
            live = live[q[live] <= e[live]]
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            acc = (acc ^ (_rotl(v[k] * _P2, 31) * _P1)) * _P1 + _P4
        h[long], p[long] = acc, q
    h += size.astype(np.uint64)
    live = np.flatnonzero(p + 8 <= end)
    while len(live):
        h[live] = _rotl(h[live] ^ (_rotl(at8[p[live]] * _P2, 31) * _P1), 27) * _P1 + _P4
        p[live] += 8
        live = live[p[live] + 8 <= end[live]]
    live = np.flatnonzero(p + 4 <= end)
    h[live] = _rotl(h[live] ^ (at4[p[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    p[live] += 4
    live = np.flatnonzero(p < end)
    while len(live):
        h[live] = _rotl(h[live] ^ (buf[p[live]].astype(np.uint64) * _P5), 11) * _P1
        p[live] += 1
        live = live[p[live] < end[live]]
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _spread(h: np.ndarray, lane: int) -> np.ndarray:
    """For lanes after the first: further 64 hash bits from a shingle's hash."""
    if not lane:
        return h
    h = (h + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, one text after the other, and the number of each text's."""
    n = len(offsets) - 1
    # Every text gets a space after it; runs of white space shrink to one.
    buf = np.full(len(raw) + n, _SPACE)
    buf[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = _LOWER[raw]
    space = buf == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    row_end = np.cumsum(keep)[offsets[1:] + np.arange(n)] if n else np.zeros(0, int)
    buf = buf[keep]
    ends = np.flatnonzero(buf == _SPACE)
    if len(buf) and buf[0] == _SPACE:
        ends = ends[1:] if len(ends) else ends
    lone = len(buf) and buf[0] == _SPACE
    starts = np.concatenate([[1 if lone else 0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    buf = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.diff(np.searchsorted(ends, row_end - 1, "right"), prepend=0) if len(ends) else np.zeros(n, np.int64)
    first = np.cumsum(words) - words
    counts = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    a = ranges(first, counts)
    b = a + np.repeat(np.minimum(words, shingle) - 1, counts)
    return xxh64(buf, starts[a], ends[b]) if len(a) else np.zeros(0, np.uint64), counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, but each shingle of a text once, in the order of the hashes."""
    h, counts = shingles(raw, offsets, shingle)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[first], np.bincount(row[first], minlength=len(counts))


def fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, lanes: int = 1) -> np.ndarray:
    """SimHash of each text as uint64; with more lanes as rows of so many."""
    n = len(offsets) - 1
    first_hash, counts = shingles(raw, offsets, shingle)
    out = np.zeros((n, lanes), np.uint64)
    if not len(first_hash):
        return out[:, 0] if lanes == 1 else out
    # Eight counters of eight bits to a word; pieces of at most 255 shingles cannot overflow them.
    pieces = -(-counts // 255)
    begin = ranges(np.zeros(n, np.int64), pieces) * 255 + np.repeat(np.cumsum(counts) - counts, pieces)
    owner = np.repeat(np.arange(n), pieces)
    row = np.flatnonzero(counts)
    at = np.searchsorted(owner, row)
    for lane in range(lanes):
        h = _spread(first_hash, lane)
        for k in range(8):
            part = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
            ones = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
            for j in range(8):
                out[row, lane] |= (2 * ones[:, j] > counts[row]).astype(np.uint64) << np.uint64(8 * j + k)
    return out[:, 0] if lanes == 1 else out


def with_fingerprint(docs: DataFrame, names: tuple[str, ...] = ("fp",), shingle: int = SHINGLE) -> DataFrame:
    """docs and long columns with the fingerprint's bits, 64 to a column; a map without shuffle."""
    text_at, lanes = docs.columns.index("text"), len(names)

    def run(batches):
        for b in batches:
            raw, offsets = flat(b.column(text_at))
            f = np.zeros((b.num_rows, lanes), np.uint64)
            for i, j in chunks(offsets):
                f[i:j] = fingerprints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, lanes).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(f[:, k].copy().view(np.int64)) for k in range(lanes))], [*b.schema.names, *names])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{n}` long" for n in names))


def _segment(fp, k: int, lo: int = 0, hi: int | None = None):
    """Bits [lo, hi) of segment k (ring order) of a long column."""
    k %= SEGMENTS
    hi = BOUNDS[k + 1] - BOUNDS[k] if hi is None else hi
    return F.shiftrightunsigned(fp, BOUNDS[k] + lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _keys(fp):
    """For each start: the first segment, half of the second, a third of the third."""
    out = []
    for i in range(SEGMENTS):
        w2, w3 = (BOUNDS[k % SEGMENTS + 1] - BOUNDS[k % SEGMENTS] for k in (i + 1, i + 2))
        for a in range(2):
            for b in range(3):
                l2, h2 = w2 * a // 2, w2 * (a + 1) // 2
                l3, h3 = w3 * b // 3, w3 * (b + 1) // 3
                tag = i * 6 + a * 3 + b
                key = F.lit(tag << 32).cast("long")
                for part, shift in ((_segment(fp, i), 16), (_segment(fp, i + 1, l2, h2), 8), (_segment(fp, i + 2, l3, h3), 0)):
                    key = key.bitwiseOR(F.shiftleft(part, shift))
                out.append(key)
    return F.array(*out)


def _within(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from `start` stays within its budgets and the whole within DISTANCE."""
    diff = x ^ y
    ok = np.ones(diff.shape, bool)
    run = np.zeros(diff.shape, np.int64)
    for length in range(1, SEGMENTS + 1):
        k = (start + length - 1) % SEGMENTS
        low, high = np.take(BOUNDS, k), np.take(BOUNDS, k + 1)
        mask = ((np.uint64(1) << (high - low).astype(np.uint64)) - np.uint64(1)) << low.astype(np.uint64)
        run = run + np.bitwise_count(diff & mask)
        ok &= run <= length * DISTANCE // SEGMENTS
    return ok


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j, pair by pair, in label: each member's smallest member."""
    while True:
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            return
        i, j, low = i[open_], j[open_], np.minimum(x, y)[open_]
        np.minimum.at(label, x[open_], low)
        np.minimum.at(label, y[open_], low)
        while (label[label] != label).any():
            label[:] = label[label]


def _labels(n: int, match) -> np.ndarray:
    """Smallest row that each of n rows reaches over match(i, j, k, l), the truth for rows [i, j) against rows [k, l)."""
    label = np.arange(n)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            one = label[a]
            if b > a and (label[a : a + BLOCK] == one).all() and (label[b : b + BLOCK] == one).all():
                continue  # joined already: their pairs add nothing
            i, j = np.nonzero(match(a, min(a + BLOCK, n), b, min(b + BLOCK, n)))
            i, j = i + a, j + b
            _joined(label, i[i < j], j[i < j])
    return label


def _streamed(batches, small, large):
    """Streams rows (k, node, bits...) sorted by k; gives links (u, v) that join in each run of k what its pairs join.

    small(columns, i, j): which rows i and j match; large(columns): a run's match for _labels.
    """

    def solve(c):
        k, node = c[0], c[1]
        cut = np.flatnonzero(np.diff(k)) + 1
        begin, size = np.append(0, cut), np.diff(np.concatenate([[0], cut, [len(k)]]))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in (2, 3, 4):  # small runs all at once
            at = begin[size == n]
            for a in range(n):
                for b in range(a + 1, n):
                    ok = small(c, at + a, at + b)
                    us.append(node[at + a][ok])
                    vs.append(node[at + b][ok])
        for at, n in zip(begin[size > 4].tolist(), size[size > 4].tolist(), strict=True):
            label = _labels(n, large([x[at : at + n] for x in c]))
            moved = np.flatnonzero(label != np.arange(n))
            us.append(node[at + moved])
            vs.append(node[at + label[moved]])
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for c in _whole_runs(batches):
        yield solve(c)


def _whole_runs(batches):
    """Columns of batches sorted by the first one, cut so that no run of equal values is parted; a long run is put together once."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = [x.to_numpy() for x in b.columns]
        k = c[0]
        if held and k[0] != held[-1][0][-1]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if k[0] != k[-1]:
            cut = int(np.searchsorted(k, k[-1], "left"))
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in c], strict=True)]
            held, c = [], [x[cut:] for x in c]
        held.append(c)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _links(batches):
    """Links of fingerprints (k, fp): the chain from the key's start, then the full check."""

    def small(c, i, j):
        x, y = c[1].view(np.uint64)[i], c[1].view(np.uint64)[j]
        return _within(x, y, (c[0][i] >> 32) // 6)

    def large(c):
        f, start = c[1].view(np.uint64), int((c[0][0] >> 32) // 6)
        return lambda a, b, p, q: _within(f[a:b, None], f[None, p:q], np.full((1, 1), start))

    yield from _streamed(batches, small, large)


def _wide_within(diff: list[np.ndarray], start) -> np.ndarray:
    """Of pairs whose lanes differ in the bits `diff`: whether the chain from `start` stays within its budgets, round the ring to WIDE_DISTANCE."""
    lanes = np.stack(diff, -1)
    start = np.broadcast_to(start, len(lanes))
    live, run = np.arange(len(lanes)), np.zeros(len(lanes), np.int64)
    for length in range(1, RING + 1):
        lane, k = np.divmod((start[live] + length - 1) % RING, SEGMENTS)
        run = run + np.bitwise_count(lanes[live, lane] & _MASKS[k])
        ok = run <= length * WIDE_DISTANCE // RING
        live, run = live[ok], run[ok]
        if not len(live):
            break
    out = np.zeros(len(lanes), bool)
    out[live] = True
    return out


def _wide_links(batches):
    """Links of wide fingerprints (k, node, f0, f1, ...): the chain from the key's start, round the whole ring."""

    def bits(c):  # unsigned: bitwise_count takes the absolute value of signed numbers
        return [x.view(np.uint64) for x in c[2:]]

    def small(c, i, j):
        return _wide_within([x[i] ^ x[j] for x in bits(c)], (c[0][i] >> 32) // 2)

    def large(c):
        f, start = bits(c), int((c[0][0] >> 32) // 2)
        return lambda a, b, p, q: _wide_within([(x[a:b, None] ^ x[None, p:q]).ravel() for x in f], start).reshape(b - a, q - p)

    yield from _streamed(batches, small, large)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between different fingerprints (column fp, one row each) that reach the same components as all pairs."""
    keyed = distinct.select(F.explode(_keys(F.col("fp"))).alias("k"), "fp")
    dealt = keyed.repartition("k").sortWithinPartitions("k", "fp")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) reaches.

    Large-star: every node hands its larger neighbours to its smallest one; small-star: its smaller ones.  A hub's rows
    meet only in min(), which Spark combines before the shuffle, and in joins that adaptive execution can split.
    """
    e = checkpoint(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(most_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        e = checkpoint(small.where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _wide_keys(lanes: list):
    """For each start on the ring of all lanes' segments: the first segment, half of the second."""
    out = []
    for i in range(RING):
        (lane, k), (lane2, k2) = divmod(i, SEGMENTS), divmod((i + 1) % RING, SEGMENTS)
        width = BOUNDS[k2 + 1] - BOUNDS[k2]
        for a in range(2):
            key = F.lit((i * 2 + a) << 32).cast("long").bitwiseOR(F.shiftleft(_segment(lanes[lane], k), 16))
            out.append(key.bitwiseOR(_segment(lanes[lane2], k2, width * a // 2, width * (a + 1) // 2)))
    return F.array(*out)


def wide_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between nodes of wide fingerprints (node, f0, f1, ...; one row each) that reach the same components as all pairs within WIDE_DISTANCE."""
    names = [f"f{k}" for k in range(WIDE_LANES)]
    keyed = distinct.select(F.explode(_wide_keys([F.col(n) for n in names])).alias("k"), "node", *names)
    return keyed.repartition("k").sortWithinPartitions("k", "node").mapInArrow(_wide_links, "u long, v long").distinct()


def _named(fps: DataFrame, distinct: DataFrame, tree: DataFrame, node: str) -> DataFrame:
    """fps with component_id and the component's root node; distinct: node, least; tree: node, root of all nodes that are no root.

    Roots of components of several nodes get their smallest id in one aggregation; they are broadcast up to BROADCAST_ROOTS,
    beyond that a component's nodes are dealt by a salt, too, so that a large one is no single task.
    """
    joined = distinct.join(tree.withColumnRenamed("node", node), node, "left")
    below = joined.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("low"))
    ids = below.join(distinct.withColumnRenamed(node, "root"), "root").select("root", F.least("low", "least").alias("smallest"))
    ids = checkpoint(ids)
    rooted = joined.withColumn("root", F.coalesce("root", node))
    if ids.count() <= BROADCAST_ROOTS:
        known = rooted.join(F.broadcast(ids), "root", "left")
    else:
        spread = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = rooted.withColumn("salt", F.pmod(F.hash(node), F.lit(SALTS))).join(spread, ["root", "salt"], "left")
    return fps.join(known.select(node, F.coalesce("smallest", "least").alias("component_id"), "root"), node)


def with_component(fps: DataFrame) -> DataFrame:
    """fps(doc_id, fp, ...) with component_id, the smallest doc_id that each row reaches."""
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _named(fps, distinct, components(links(distinct)), "fp")


def with_wide_component(fps: DataFrame) -> DataFrame:
    """fps(doc_id, f0, f1, ..., ...) with component_id over wide fingerprints."""
    names = [f"f{k}" for k in range(WIDE_LANES)]
    fps = fps.withColumn("node", F.xxhash64(*names))
    distinct = checkpoint(fps.groupBy("node", *names).agg(F.min("doc_id").alias("least")))
    return _named(fps, distinct.select("node", "least"), components(wide_links(distinct)), "node")


def similar(overlap, total):
    """Whether two sets with `total` members counted apart, `overlap` in both, have a Jaccard similarity of 0.8 or more."""
    return 9 * overlap >= 4 * total


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar by their exact shingle sets; texts: node, text."""
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    chosen = texts.join(needed, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(chosen.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(chosen.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")

    def run(batches):
        for b in batches:
            (x, ox), (y, oy) = flat(b.column(2)), flat(b.column(3))
            keep = np.zeros(b.num_rows, bool)
            for i, j in chunks(ox + oy):
                hx, nx = shingle_sets(x[ox[i] : ox[j]], ox[i : j + 1] - ox[i], WIDE_SHINGLE)
                hy, ny = shingle_sets(y[oy[i] : oy[j]], oy[i : j + 1] - oy[i], WIDE_SHINGLE)
                h, row = np.concatenate([hx, hy]), np.concatenate([np.repeat(np.arange(j - i), n) for n in (nx, ny)])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                common = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=j - i)
                keep[i:j] = similar(common, nx + ny)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["u", "v"])

    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles frequent in a sample of the n texts, rarest first."""

    def run(batches):
        for b in batches:
            raw, offsets = flat(b.column(0))
            for i, j in chunks(offsets):
                h, _ = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDE_SHINGLE)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["k"])

    sample = texts.where(F.pmod("node", F.lit(max(1, n // FREQUENT_SAMPLE))) == 0).select("text")
    counted = sample.mapInArrow(run, "k long").groupBy("k").count().where(F.col("count") >= FREQUENT_LEAST).orderBy(F.desc("count"), "k").limit(FREQUENT_MOST)
    return np.array([r["k"] for r in reversed(counted.collect())], np.int64).view(np.uint64)


def sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 half bytes of each set, as rows of four uint64: of each bin of hashes (by their first bits) four bits of the smallest, 0 if there is none.

    h: the sets' hashes in order, one set after the other.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    bin_ = (h >> np.uint64(58)).astype(np.int64)
    first = np.append(True, (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1]))[: len(h)]
    row, bin_ = row[first], bin_[first]
    out = np.zeros((len(counts), 4), np.uint64)
    part = ((h[first] >> np.uint64(20)) & np.uint64(15)) << (4 * (bin_ % 16)).astype(np.uint64)
    np.bitwise_or.at(out, (row, bin_ // 16), part)
    return out


def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bins two sketches differ, row by row."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(-1)


def most_unlike(total: np.ndarray) -> np.ndarray:
    """Bins in which the sketches of two similar sets with `total` members can differ.

    A bin that differs holds a member of one set alone, of which there are total / 9 at most.  In large sets such members
    share bins: at a similarity of 0.8 a bin differs with a chance of 3/16, so that more than SKETCH_MOST bins of 64 do by
    a chance of less than one in a billion.
    """
    return np.minimum(total // 9, SKETCH_MOST)


def with_prefix_keys(texts: DataFrame, last: np.ndarray) -> DataFrame:
    """k, root, node, size, pos, s0..s3: the shingles of each text's prefix, their places, and the text's sketch; texts: node, root, text."""
    by_hash = np.argsort(last)
    ordered = last[by_hash]

    def run(batches):
        for b in batches:
            _, at = np.unique(b.column(0).to_numpy(), return_index=True)
            b = b.take(pa.array(np.sort(at)))
            node, root = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, offsets = flat(b.column(2))
            for i, j in chunks(offsets):
                h, n = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDE_SHINGLE)
                sketch = sketches(h, n).view(np.int64)
                row, late = np.repeat(np.arange(j - i), n), np.zeros(len(h), np.int64)
                if len(ordered):
                    found = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                    late = np.where(ordered[found] == h, by_hash[found] + 1, 0)
                order = np.lexsort((h, late, row))
                pos = ranges(np.zeros(j - i, np.int64), n)
                head = pos < np.repeat(n - (4 * n + 4) // 5 + 1, n)
                h, row, pos = h[order][head], row[head], pos[head]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(root[i + row]), pa.array(node[i + row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32)), *(pa.array(x) for x in sketch[row].T.copy())], ["k", "root", "node", "size", "pos", "s0", "s1", "s2", "s3"])

    return texts.select("node", "root", "text").mapInArrow(run, "k long, root long, node long, size int, pos int, s0 long, s1 long, s2 long, s3 long")


def _loose_links(batches):
    """Links (u, v) that join, of each run of k, the roots of which two nodes may be similar; from rows (k, root, node, size, pos, s0..s3) sorted by k, root and node.

    What stands before the shingle and what follows it bound what two sets share, and their sketches bound in how much they
    differ.  Pairs are only looked at here; what leaves is a link a root at most.
    """

    def links(c):
        edge = np.concatenate([[True], c[0][1:] != c[0][:-1], [True]])
        copy = np.append(False, (c[0][1:] == c[0][:-1]) & (c[2][1:] == c[2][:-1]))
        c = [x[~copy & ~(edge[1:] & edge[:-1])] for x in c]  # without copies of one text and runs of one row
        k, root, node, size, pos = c[:5]
        n = len(k)
        if not n:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node)], ["u", "v"])
        sketch = np.stack(c[5:], 1).view(np.uint64)
        runs = np.append(np.flatnonzero(np.diff(k)) + 1, n)
        new = np.append(True, (np.diff(k) != 0) | (np.diff(root) != 0))
        groups = np.append(np.flatnonzero(new)[1:], n)
        rows = np.arange(n)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        begin = groups[np.minimum(np.searchsorted(groups, rows, "right"), len(groups) - 1)]
        counts = runs[np.searchsorted(runs, rows, "right")] - begin
        total = np.cumsum(counts)
        label, i = rows.copy(), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE, "right")))
            a, b = np.repeat(rows[i:j], counts[i:j]), ranges(begin[i:j], counts[i:j])
            for p in range(0, len(a), PIECE):
                x, y = a[p : p + PIECE], b[p : p + PIECE]
                apart = label[first[x]] != label[first[y]]
                x, y = x[apart], y[apart]
                shared = np.minimum(size[x] - pos[x], size[y] - pos[y]) + np.minimum(pos[x], pos[y])
                ok = similar(shared, size[x] + size[y])
                x, y = x[ok], y[ok]
                ok = unlike(sketch[x], sketch[y]) <= most_unlike(size[x] + size[y])
                _joined(label, first[x[ok]], first[y[ok]])
            i = j
        moved = np.flatnonzero(label != rows)
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["u", "v"])

    for c in _whole_runs(batches):
        yield links(c)


def _similar_links(batches):
    """Links (u, v) that join the nodes of different roots that are similar by their exact shingle sets; rows (task, root, node, text) sorted by task."""

    def links(rows):
        root, node = (np.concatenate([np.asarray(b.column(x)) for b in rows]) for x in (1, 2))
        parts = [shingle_sets(*flat(b.column(3)), WIDE_SHINGLE) for b in rows]
        h, n = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
        row = np.repeat(np.arange(len(n)), n)
        _, at, often = np.unique(h, return_inverse=True, return_counts=True)
        kept = often[at] > 1  # only shingles of several rows count
        place = np.cumsum(often > 1) - 1
        row, at = row[kept], place[at[kept]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        overlap = np.zeros((len(n), len(n)), np.float32)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            some = np.zeros((len(n), COLUMNS), np.float32)
            some[row[i:j], at[i:j] - low] = 1
            overlap += some @ some.T
        i, j = np.nonzero(np.triu(similar(overlap, n[:, None] + n[None, :]), 1) & (root[:, None] != root[None, :]))
        label = np.arange(len(n))
        _joined(label, i, j)
        moved = np.flatnonzero(label != np.arange(len(n)))
        # A class may be joined over several rows: each row links to one that it is similar to.
        u, v = node[moved], node[label[moved]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        task = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[0].as_py() != task[i]:
                yield links(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield links(held)


def remaining_links(texts: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """Links (u, v) that join all similar texts (node, text; n nodes) that the components `tree` (node, root) do not join yet.

    Nodes that may be similar fall into loose groups; only links leave the kernels that find them, not pairs.  The texts of
    a group meet whole, in blocks of at most GROUP_ROWS rows and GROUP_BYTES of text, each pair of blocks in a task of its own.
    """
    small = F.broadcast(tree) if tree.count() <= BROADCAST_ROOTS else tree
    rooted = texts.join(small, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = with_prefix_keys(rooted, frequent(texts, n)).repartition("k").sortWithinPartitions("k", "root", "node")
    loose = checkpoint(keyed.mapInArrow(_loose_links, "u long, v long").distinct())
    if loose.isEmpty():
        return loose
    groups = components(loose.union(tree.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    ends = groups.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct()
    member = groups.select("node", F.col("root").alias("group")).union(ends)
    used = loose.select(F.col("u").alias("node")).join(member, "node").select("group").distinct()
    member = checkpoint(member.join(used, "group", "left_semi").join(tree, "node", "left").select("node", "group", F.coalesce("root", "node").alias("root")))
    held = F.broadcast(member) if member.count() <= BROADCAST_ROOTS else member
    whole = stored(texts.join(held, "node").dropDuplicates(["node"]).select("node", "group", "root", "text"), "loose-groups")
    sizes = whole.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_ROWS), F.ceil(F.sum(F.octet_length("text")) / GROUP_BYTES)).cast("int").alias("blocks"))
    sizes = checkpoint(sizes)
    blocks = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROOTS else sizes
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks").cast("long")).cast("int")
    dealt = whole.join(blocks, "group").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    task = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    met = dealt.select(task.alias("task"), "root", "node", "text").repartition("task").sortWithinPartitions("task", "node")
    return met.mapInArrow(_similar_links, "u long, v long").distinct()


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest doc_id (null first; of equal ids one text).

    Rows without a near duplicate stay as they are; docs' columns are kept, whatever their names.
    """
    names = tuple(f"f{k}" for k in range(WIDE_LANES))
    # Texts without a word are one node, others one for each text.
    node = F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x09-\x0D\x20]"), F.xxhash64("text")).otherwise(0)
    tagged = stored(with_fingerprint(docs.select("doc_id", F.xxhash64("text").alias("h"), node.alias("node"), "text"), names, WIDE_SHINGLE).drop("text"), "fingerprints")
    texts = docs.select(node.alias("node"), "text")
    distinct = stored(tagged.select("node", *names).dropDuplicates(["node"]), "nodes")
    near = checkpoint(verified(stored(wide_links(distinct), "wide-links"), texts))
    tree = components(near)
    release(docs.sparkSession)
    more = checkpoint(remaining_links(texts, tree, distinct.count()))
    tree = tree if more.isEmpty() else components(near.union(more))
    release(docs.sparkSession)
    rooted = tagged.join(tree, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.h").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h")), "left_semi")
    alone = tagged.groupBy("doc_id", "h").count().where("count > 1").limit(1).isEmpty()
    return (kept if alone else kept.dropDuplicates(["doc_id", "text"])).select("row.*")


def query(spark, sf_dir) -> DataFrame:
    fps = checkpoint(with_fingerprint(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"))
    return with_component(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
