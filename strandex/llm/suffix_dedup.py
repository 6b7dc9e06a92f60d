"""Suffix-array dedup of repeated passages by prefix-free parsing.

A byte is removed if a WIDTH-byte string covers it that also starts earlier in the corpus (order: doc_id, then start).

1. Parse.  Rolling hashes of GRAM bytes are taken at every position; the leftmost smallest hash of each WIDTH-byte string
   is a trigger, so each such string holds one and equal strings hold it at the same place.  A phrase is the text of all
   consecutive strings with one trigger; neighbours overlap by WIDTH - 1 bytes, and each string lies in one phrase.
   Grams that are common in a sample of texts come last in the order of hashes: strings across the border of a common
   passage then have a trigger outside of it, and those inside form the same phrases in each copy.  The sample decides
   how work is dealt out; any order gives the same repeats.
2. Dictionary.  Phrases are dealt by trigger.  Of equal phrases all but the first in the corpus are repeats as a whole.
   A trigger with one phrase only is done; those with more are open, as their phrases may share some strings.
3. Suffixes.  The text of the open phrases is fetched by a join and dealt by trigger.  The suffixes of such a part of
   the dictionary are ranked to a depth of WIDTH bytes by prefix doubling, and ties broken by the parse's order, so that
   the first of each class of equal strings is known.  Where a trigger has more than CROWD open phrases, map tasks do
   the ranking for their own phrases, and the firsts of all tasks are merged by a 128-bit digest of the string.
4. Runs of repeats go back to their documents by a second join, and the bytes are taken out.

Map tasks hand on one row for each phrase (or string) and chunk of text, however often it occurs there, and for phrases
with a common trigger one row a task, so a passage in a third of all documents arrives as one row a task; the merging
kernels stream over sorted rows and hold one row, or the phrases of one trigger (CROWD at most).  Texts are handled in
pieces of PIECE bytes, dictionaries in parts of DICTIONARY bytes, which bounds what a task holds besides the texts of an
Arrow batch.

Edge cases: null text is empty; texts under WIDTH bytes keep all bytes; a null doc_id comes first; rows with equal
doc_id are ordered by a hash of their text, and wholly equal rows count as one place, so that both keep their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, ranges, read, release, stored

WIDTH, GRAM = 100, 32
CROWD = 1000
PIECE = 1 << 20
DICTIONARY = 1 << 20
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 4000, 4, 500_000
HELD = 100_000  # phrases with common triggers that a map task holds back
_BASES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
_INVERSES = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _BASES]
_BYTE = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_NULL_ID = -(1 << 63)
_REPEAT = "d long, th long, s int, e int"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base)
    p[:1] = 1
    return np.cumprod(p, out=p)


class _Digest:
    """Hashes of substrings by prefix sums."""

    def __init__(self, raw: np.ndarray, which: int):
        n = len(raw)
        self.back = _powers(_INVERSES[which], n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers(_BASES[which], n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _grams(raw: np.ndarray) -> np.ndarray:
    """Rolling hash of the GRAM bytes from each place on."""
    h, step = _BYTE[raw], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(int(_BASES[1]), step, 1 << 64)) + h[step:]
        step *= 2
    return _mix(h)


class Common:
    """A set of gram hashes; a table of their low bits keeps most others from the search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[self._low(self.sorted)] = True

    def __reduce__(self):
        return Common, (self.sorted,)

    @staticmethod
    def _low(h):
        return (h & np.uint64((1 << 20) - 1)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places in h of members."""
        if not len(self.sorted):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[self._low(h)])
        found = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[found] == h[at]]


def parse(raw: np.ndarray, offsets: np.ndarray, common: Common | None = None):
    """Phrases of the texts: trigger position, first and last string start (all in raw), trigger hash, phrase hash."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = ranges(offsets[:-1], np.maximum(np.diff(offsets) - WIDTH + 1, 0))
    if not len(at):
        return empty
    h = _grams(raw)
    bits = np.uint64(max(24, int(len(raw)).bit_length()))
    low = h >> np.uint64(1)
    if common is not None:
        low[common.places(h)] |= np.uint64(1 << 63)
    low = (low >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    grams, size = WIDTH - GRAM + 1, 1
    while 2 * size <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < grams:
        low = np.minimum(low[: len(low) - (grams - size)], low[grams - size :])
    own = (low[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    del low
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    lo, hi, a = at[first], at[np.append(first[1:], len(at)) - 1], own[first]
    del at, own
    k = h[a]
    del h
    return a, lo, hi, k, _Digest(raw, 0)(lo, hi + WIDTH)


def _pieces(offsets: np.ndarray, piece: int = PIECE):
    """Rows [i, j) and their bytes [begin, end) in pieces of about `piece` bytes; of a longer row parts that overlap by a string less one byte."""
    for i, j in chunks(offsets, piece):
        if offsets[j] - offsets[i] <= piece + WIDTH:
            yield i, j, offsets[i], offsets[j]
        else:
            for begin in range(offsets[i], offsets[j] - WIDTH + 1, piece):
                yield i, j, begin, min(begin + piece + WIDTH - 1, offsets[j])


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Merges touching ranges of each row; sorted."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    big = int(end.max()) + 2
    reach = np.maximum.accumulate(row * big + end)
    new = np.append(True, row[1:] * big + start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1] - row[first] * big


def _later(keys: list[np.ndarray], d: np.ndarray, th: np.ndarray, p: np.ndarray):
    """Sorts by keys, then place. Gives the order, a mask of each key's first row and one of the rows at a later place."""
    order = np.lexsort((p, th, d, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    same = (d[first] == d[order]) & (th[first] == th[order]) & (p[first] == p[order])
    return order, new, ~same


def _batch(names: str, *columns) -> pa.RecordBatch:
    kinds = [x.split() for x in names.split(", ")]
    types = {"long": (np.int64, pa.int64()), "int": (np.int32, pa.int32())}
    data = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(types[t][0]), types[t][1]) for c, (_, t) in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(data, [n for n, _ in kinds])


_PHRASE = -2
#: A phrase or string: two hashes, its place, and the numbers of strings before the trigger and after it. A repeat: pre = -1 and its end in `post`.
_PLACED = "k long, ph long, d long, th long, a int, pre int, post int"
_NAMES = ["k", "ph", "d", "th", "a", "pre", "post"]


def _parser(common: Common | None, piece: int = PIECE):
    def run(batches):
        held = [np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 5)]
        for b in batches:
            raw, offsets = flat(b.column("text"))
            d, th = b.column("d").to_numpy(), b.column("th").to_numpy()
            for i, j, begin, end in _pieces(offsets, piece):
                starts = np.append(np.maximum(offsets[i:j], begin), end) - begin
                a, lo, hi, k, ph = parse(raw[begin:end], starts, common)
                if not len(a):
                    continue
                row = i + np.searchsorted(starts, a, "right") - 1
                at = offsets[row] - begin
                order, new, later = _later([k, ph], d[row], th[row], a - at)
                x, y = order[new], order[later]
                r, s, e = _runs(row[y], (lo - at)[y], (hi - at)[y] + WIDTH)
                phrases = [z[x] for z in (k, ph, d[row], th[row], a - at, a - lo, hi - lo)]
                gone = [d[r], th[r], s, e]
                if common is not None:
                    known = np.zeros(len(x), bool)
                    known[common.places(phrases[0])] = True
                    held = [np.concatenate([z, c[known]]) for z, c in zip(held, phrases, strict=True)]
                    phrases = [c[~known] for c in phrases]
                    order, new, later = _later(held[:2], *held[2:5])
                    first = held[4] - held[5]
                    y = order[later]
                    gone = [np.concatenate(z) for z in zip(gone, (held[2][y], held[3][y], first[y], first[y] + held[6][y] + WIDTH), strict=True)]
                    held = [z[order[new]] for z in held]
                deal, zero = _mix(gone[0].view(np.uint64)), np.zeros(len(gone[0]), np.int64)
                yield _batch(_PLACED, *(np.concatenate(z) for z in zip(phrases, (deal, deal, *gone[:3], zero - 1, gone[3]), strict=True)))
                if len(held[0]) > HELD:
                    yield _batch(_PLACED, *held)
                    held = [z[:0] for z in held]
        if len(held[0]):
            yield _batch(_PLACED, *held)

    return run


def common_grams(rows: DataFrame) -> Common:
    """Grams that COMMON_LEAST texts of a sample have; rows: d, th, text."""

    def run(batches):
        for b in batches:
            raw, offsets = flat(b.column(0))
            for i, j, begin, end in _pieces(offsets):
                starts = np.append(np.maximum(offsets[i:j], begin), end) - begin
                at = ranges(starts[:-1], np.maximum(np.diff(starts) - GRAM + 1, 0))
                if not len(at):
                    continue
                h = _grams(raw[begin:end])[at]
                order = np.lexsort((at, h))
                h, row = h[order], np.searchsorted(starts, at[order], "right")
                new = np.append(True, h[1:] != h[:-1])
                texts = np.add.reduceat(new | np.append(True, row[1:] != row[:-1]), np.flatnonzero(new))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(texts.astype(np.int64))], ["k", "n"])

    sample = rows.where(F.pmod(F.xxhash64("d", "th"), F.lit(max(1, rows.count() // COMMON_SAMPLE))) == 0).select("text")
    counted = sample.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    return Common(counted.orderBy(F.desc("n"), "k").limit(COMMON_MOST).select("k").toArrow().column("k").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return flat(column.cast(pa.large_binary()).view(pa.large_string()))


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy() for c in b.columns]


def _dictionary(batches):
    """Streams phrases sorted by trigger, phrase and place: repeats, and the first places of phrases of open triggers (pre >= 0)."""
    carried, told = None, False
    for b in batches:
        c = _columns(b)
        rep = c[5] < 0
        if rep.any():
            z = [x[rep] for x in c]
            yield _batch(_PLACED, *z)
            c = [x[~rep] for x in c]
        if not len(c[0]):
            continue
        if carried is not None:
            c = [np.concatenate([x, y]) for x, y in zip(carried, c, strict=True)]
        k, ph, d, th, a, pre, post = c
        new_k = np.append(True, k[1:] != k[:-1])
        new = new_k | np.append(True, ph[1:] != ph[:-1])
        first = np.flatnonzero(new)
        own = first[np.cumsum(new) - 1]
        run = np.cumsum(new_k) - 1
        many = np.bincount(run[first]) > 1
        many[0] |= told
        out = new & many[run]
        if told:
            out[0] = False
        twice = ~((d == d[own]) & (th == th[own]) & (a == a[own]))
        if out.any():
            yield _batch(_PLACED, *(x[out] for x in c))
        if twice.any():
            s = (a - pre)[twice]
            yield _batch(_PLACED, k[twice], ph[twice], d[twice], th[twice], s, np.full(len(s), -1), s + post[twice] + WIDTH)
        told = bool(many[-1])
        carried = [x[first[-1] : first[-1] + 1] for x in c]


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys in 32 bits."""
    order = np.argsort(keys)
    keys = keys[order]
    step = np.empty(len(keys), np.int32)
    step[:1] = 0
    np.not_equal(keys[1:], keys[:-1], out=step[1:], casting="unsafe")
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(step, out=step)
    return out


def _suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix to a depth of WIDTH bytes; equal prefixes have equal ranks. Beyond the end counts as zero bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(WIDTH + 8, np.uint8)])
    rank = _ranked(np.ndarray((n + WIDTH,), ">u8", padded, 0, (1,)).astype(np.uint64))
    depth = 8
    while depth < WIDTH:
        step = min(depth, WIDTH - depth)
        both = rank.astype(np.uint64) << np.uint64(32)
        both[:-step] |= rank[step:]
        rank = _ranked(both)
        depth += step
    return rank[:n]


def _with_text(placed: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*placed.columns, text], [*placed.schema.names, "text"])


def _firsts(text: np.ndarray, begin: np.ndarray, d: np.ndarray, th: np.ndarray, p: np.ndarray, m: np.ndarray):
    """Of all strings of phrases (from begin in text; first place p, m + 1 strings): their starts in text, phrases, places, and how they are ordered."""
    at, own, place = ranges(begin, m + 1), np.repeat(np.arange(len(p)), m + 1), ranges(p, m + 1)
    return at, own, place, *_later([_suffix_ranks(text)[at]], d[own], th[own], place)


def _strings(batches):
    """Rows (d, th, text, asked) with the places of open phrases; gives their texts, or if crowded the first place of each of their strings in the chunk, and repeats."""
    for b in batches:
        raw, offsets = flat(b.column("text"))
        d, th = b.column("d").to_numpy(), b.column("th").to_numpy()
        asked = b.column("asked")
        n_asked = np.diff(np.asarray(asked.offsets))
        items = asked.flatten()
        k, lo, post, crowded = (np.asarray(items.field(x)).astype(np.int64) for x in ("k", "lo", "post", "crowded"))
        row = np.repeat(np.arange(b.num_rows), n_asked)
        alone = np.flatnonzero(crowded == 0)
        for s in range(0, len(alone), 20_000):
            i = alone[s : s + 20_000]
            size = post[i] + WIDTH
            text = raw[ranges(offsets[row[i]] + lo[i], size)]
            ends = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes())
            zero = np.zeros(len(i), np.int64)
            yield _with_text(_batch(_PLACED, k[i], zero, d[row[i]], th[row[i]], lo[i], zero + _PHRASE, post[i]), pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, ends, pa.py_buffer(text.tobytes())]))
        many = np.flatnonzero(crowded)
        weight = np.append(0, np.cumsum(post[many] + WIDTH))
        for i, j in chunks(weight, DICTIONARY // 2):
            r, p, m = row[many[i:j]], lo[many[i:j]], post[many[i:j]]
            text = raw[ranges(offsets[r] + p, m + WIDTH)]
            at, own, place, order, new, later = _firsts(text, weight[i:j] - weight[i], d[r], th[r], p, m)
            x, y = order[new], order[later]
            h = [_Digest(text, t)(at[x], at[x] + WIDTH) for t in (0, 1)]
            q, s, e = _runs(r[own[y]], place[y], place[y] + WIDTH)
            deal, zero = _mix(d[q].view(np.uint64)), np.zeros(len(x), np.int64)
            rows = _batch(_PLACED, *(np.concatenate(z) for z in ((h[0], deal), (h[1], deal), (d[r[own[x]]], d[q]), (th[r[own[x]]], th[q]), (place[x], s), (zero, np.full(len(q), -1)), (zero, e))))
            yield _with_text(rows, pa.nulls(rows.num_rows, pa.binary()))


def _merged(batches):
    """Streams phrases and strings sorted by trigger or digest, and place; gives repeats (d, th, s, e)."""
    carried, held = None, []

    def ranked(rows):
        """Repeats among the strings of whole dictionaries of triggers."""
        text, offsets = flat_binary(rows.column("text"))
        d, th, p, m = (rows.column(x).to_numpy().astype(np.int64) for x in ("d", "th", "a", "post"))
        _, own, place, order, _, later = _firsts(text, offsets[:-1], d, th, p, m)
        y = order[later]
        q, s, e = _runs(own[y], place[y], place[y] + WIDTH)
        return _batch(_REPEAT, d[q], th[q], s, e)

    for b in batches:
        kind = b.column("pre").to_numpy()
        done = b.filter(pa.array(kind == -1))
        yield _batch(_REPEAT, *(done.column(x).to_numpy() for x in ("d", "th", "a", "post")))
        c = [x[kind >= 0] for x in _columns(b.select(_NAMES))]
        if len(c[0]):
            if carried is not None:
                c = [np.concatenate([x, y]) for x, y in zip(carried, c, strict=True)]
            k, ph, d, th, a = c[:5]
            new = np.append(True, (k[1:] != k[:-1]) | (ph[1:] != ph[:-1]))
            first = np.flatnonzero(new)
            own = first[np.cumsum(new) - 1]
            q = np.flatnonzero(~((d == d[own]) & (th == th[own]) & (a == a[own])))
            yield _batch(_REPEAT, d[q], th[q], a[q], a[q] + WIDTH)
            carried = [x[first[-1] : first[-1] + 1] for x in c]
        phrases = b.filter(pa.array(kind == _PHRASE))
        if phrases.num_rows:
            held.append(phrases)
            if sum(x.column("text").nbytes for x in held) >= DICTIONARY:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                k = rows.column("k").to_numpy()
                whole = int(np.searchsorted(k, k[-1], "left"))
                if whole:
                    yield ranked(rows[:whole])
                held = [rows[whole:]]
    if held:
        yield ranked(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _named(docs: DataFrame) -> DataFrame:
    """docs with d and th, which name a row: th tells rows of one doc_id apart where there are such."""
    twice = not docs.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty()
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "th": F.xxhash64("text") if twice else F.lit(0).cast("long")})


def repeats(named: DataFrame, piece: int = PIECE) -> DataFrame:
    """Ranges (d, th, s, e) of bytes to remove; they may overlap. named: d, th, text."""
    rows = named.select("d", "th", "text")
    order = ("k", "ph", "d", "th", "a")
    phrases = rows.mapInArrow(_parser(common_grams(rows), piece), _PLACED)
    spark = named.sparkSession
    known = stored(phrases.repartition("k").sortWithinPartitions(*order).mapInArrow(_dictionary, _PLACED), "phrases")
    del phrases
    release(spark)
    done = known.where("pre < 0").select("d", "th", F.col("a").alias("s"), F.col("post").alias("e"))
    open_ = known.where("pre >= 0")
    crowds = open_.groupBy("k").count().where(F.col("count") > CROWD).select("k", F.lit(1).alias("crowded"))
    judged = open_.join(crowds, "k", "left") if not crowds.isEmpty() else open_.withColumn("crowded", F.lit(0))
    each = F.struct("k", (F.col("a") - F.col("pre")).alias("lo"), "post", F.coalesce("crowded", F.lit(0)).alias("crowded"))
    asked = judged.groupBy("d", "th").agg(F.collect_list(each).alias("asked"))
    strings = rows.join(asked, ["d", "th"]).select("d", "th", "text", "asked").mapInArrow(_strings, _PLACED + ", text binary")
    found = done.union(strings.repartition("k").sortWithinPartitions(*order).mapInArrow(_merged, _REPEAT))
    found = stored(found, "repeats")
    del strings, asked
    release(spark)
    return found


def _cut(raw: np.ndarray, s: np.ndarray, e: np.ndarray):
    _, s, e = _runs(np.zeros(len(s), np.int64), s, e)
    mark = np.zeros(len(raw) + 1, np.int8)
    np.add.at(mark, s, 1)
    np.add.at(mark, e, -1)
    return np.cumsum(mark[:-1]) == 0, len(s)


def _whole_characters(raw: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Drops characters of which a byte is dropped."""
    lead = (raw & 0xC0) != 0x80
    owner = np.cumsum(lead) - 1
    lost = np.zeros(int(lead.sum()) + 1, bool)
    lost[owner[~keep]] = True
    return ~lost[owner]


def _with_repeats(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    named = _named(docs)
    found = repeats(named, piece).groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    return named.join(found, ["d", "th"], "left")


def report(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def run(batches):
        for b in batches:
            raw, offsets = flat(b.column("text"))
            gone = b.column("gone")
            out = []
            for i in range(b.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                spans = 0
                kept = own
                if gone[i].is_valid and len(gone[i].values):
                    v = gone[i].values
                    keep, spans = _cut(own, np.asarray(v.field("s")).astype(np.int64), np.asarray(v.field("e")).astype(np.int64))
                    kept = own[keep]
                out.append((len(own), len(own) - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_repeats(docs.select("doc_id", "text"), piece).select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes (and the characters that they are part of); n_chars, if there, follows the text."""
    names = docs.columns
    narrow = docs.select(F.struct(*names).alias("row"), "doc_id", "text")

    def run(batches):
        for b in batches:
            raw, offsets = flat(b.column("text"))
            gone, texts = b.column("gone"), b.column("text").to_pylist()
            for i in range(b.num_rows):
                if gone[i].is_valid and len(gone[i].values):
                    own, v = raw[offsets[i] : offsets[i + 1]], gone[i].values
                    keep, _ = _cut(own, np.asarray(v.field("s")).astype(np.int64), np.asarray(v.field("e")).astype(np.int64))
                    texts[i] = own[_whole_characters(own, keep)].tobytes().decode()
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "kept"])

    kind = docs.schema.simpleString()
    out = _with_repeats(narrow).select("row", "text", "gone").mapInArrow(run, f"row {kind}, kept string")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("kept").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("kept")) if "n_chars" in names else None}
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in names))


def query(spark, sf_dir) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
