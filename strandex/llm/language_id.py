"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (drawn from a generator seeded by its code point).  An n-gram of three
symbols (letters in lower case, and the edge of a word) binds the vectors of its letters, permuted by place, by
multiplication; a text bundles its n-grams by addition.  A language's prototype bundles the unit vectors of its training
texts.  Texts and prototypes are compared by cosine, after the mean of the prototypes is taken from both: it is what all
languages share.

Training takes a bounded sample, at most about MAX_PER_LANG texts of each language by a hash of doc_id; prediction is a
map over all whole texts.  The model is one vector of DIM numbers for each language.

Edge cases: null text and text without letters give `und` and score 0; a null lang teaches nothing; without any
language to learn from all is `und`; a null doc_id counts as held out; of equal cosines the language that sorts first is
taken; equal texts are judged alike, each row for itself; a text of any length is read whole, its vector is as long as any;
an empty table gives no rows; columns beside doc_id and text are not looked at when predicting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, read

DIM = 1024
MAX_PER_LANG = 10_000
SHARE = 5
_CACHE_ROWS = 1 << 16
_MASK = (1 << 21) - 1


class Encoder:
    """Counts n-grams of texts and turns counts into vectors; keeps the vectors of n-grams seen."""

    def __init__(self):
        self.lower = np.zeros(1 << 16, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                self.lower[i] = ord(low) if len(low) == 1 else i
        self.letters: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self):
        self.known = np.zeros(0, np.int64)
        self.rows = np.zeros((0, DIM), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            draw = np.random.Generator(np.random.PCG64(1_000_003 + c)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
            self.letters[c] = np.stack([np.roll(draw, 2), np.roll(draw, 1), draw])
        return self.letters[c]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of sorted packed n-grams."""
        if len(self.known) + len(grams) > _CACHE_ROWS:
            self.reset()
        at = np.searchsorted(self.known, grams)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == grams[hit]
        new = grams[~hit]
        if len(new):
            symbols = [(new >> s) & _MASK for s in (42, 21, 0)]
            made = np.ones((len(new), DIM), np.int8)
            for place, column in enumerate(symbols):
                own, inverse = np.unique(column, return_inverse=True)
                made *= np.stack([self.letter(int(c))[place] for c in own])[inverse]
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.known = np.concatenate([self.known, new])[order]
            self.rows = np.concatenate([self.rows, made])[order]
            at = np.searchsorted(self.known, grams)
        return self.rows[at].astype(np.float32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One vector of DIM numbers for each text; zero without letters."""
        n = len(offsets) - 1
        code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        edges = lead[offsets]
        symbol = self.lower[np.minimum(code, 0xFFFF)]
        for c in np.unique(code[code > 0xFFFF]):
            symbol[code == c] = ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 0
        row = np.repeat(np.arange(n), np.diff(edges))
        # Edges of words: one zero before, between and after.
        keep = symbol != 0
        keep[1:] |= symbol[:-1] != 0
        s = np.concatenate([np.zeros(1, np.uint32), symbol])
        take = np.concatenate([[True], keep])
        starts = edges[:-1][np.diff(edges) > 0]
        s = np.insert(s, starts + 1, 0)
        take = np.insert(take, starts + 1, True)
        row = np.insert(np.concatenate([row[:1], row]), starts + 1, row[starts])
        s, row = np.append(s[take], 0).astype(np.int64), row[take]
        if len(s) < 3:
            return np.zeros((n, DIM), np.float32)
        middle = np.flatnonzero(s[1:-1] != 0)
        own, ids = np.unique(s, return_inverse=True) if len(s) < 1000 else self._symbols(s)
        m = len(own)
        if m**3 <= 1 << 22:
            dense = (ids[middle] * m + ids[middle + 1]) * m + ids[middle + 2]
            there = np.flatnonzero(np.bincount(dense, minlength=m**3))
            back = np.zeros(m**3, np.int64)
            back[there] = np.arange(len(there))
            which = back[dense]
            grams = own[there // (m * m)] << 42 | own[there // m % m] << 21 | own[there % m]
        else:
            grams, which = np.unique(s[middle] << 42 | s[middle + 1] << 21 | s[middle + 2], return_inverse=True)
        if not len(grams):
            return np.zeros((n, DIM), np.float32)
        owner = row[middle + 1]
        out = np.zeros((n, DIM), np.float32)
        part = max(1, (8 << 20) // len(grams))  # bounds the table of counts
        for i in range(0, n, part):
            j = min(n, i + part)
            a, b = np.searchsorted(owner, (i, j))
            counts = np.bincount((owner[a:b] - i) * len(grams) + which[a:b], minlength=(j - i) * len(grams)).astype(np.float32).reshape(j - i, -1)
            for g in range(0, len(grams), 1 << 14):
                out[i:j] += counts[:, g : g + (1 << 14)] @ self.vectors(grams[g : g + (1 << 14)])
        return out

    @staticmethod
    def _symbols(s: np.ndarray):
        there = np.flatnonzero(np.bincount(s))
        back = np.zeros(int(there[-1]) + 1, np.int64)
        back[there] = np.arange(len(there))
        return there, back[s]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % SHARE == 0, F.lit(True))


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Language names and their prototypes, one row each."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return [], np.zeros((0, DIM), np.float32)
    share = F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, min(1.0, max_per_lang / c))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)

    def bundle(batches):
        encoder, sums = Encoder(), {}
        for b in batches:
            raw, offsets = flat(b.column("text"))
            lang = np.array(b.column("lang").to_pylist(), object)
            for i, j in chunks(offsets, 1 << 19):
                v = _unit(encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                for name in set(lang[i:j]):
                    sums[name] = sums.get(name, 0) + v[lang[i:j] == name].sum(axis=0, dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.where(chance < share[F.col("lang")]).select("lang", "text").mapInArrow(bundle, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    names = sorted(n)
    out = np.zeros((len(names), DIM))
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect():
        out[names.index(r["lang"])] = [x["x"] for x in r["v"]]
    return names, _unit(out).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score."""
    names, prototypes = model
    shared = prototypes.mean(axis=0) if len(names) > 1 else np.zeros(DIM, np.float32)
    centred = _unit(prototypes - shared)

    def run(batches):
        encoder = Encoder()
        for b in batches:
            raw, offsets = flat(b.column("text"))
            best, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for i, j in chunks(offsets, 1 << 19):
                v = encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = v.any(axis=1)
                if len(names) and some.any():
                    cosine = _unit(_unit(v[some]) - shared) @ centred.T
                    at = np.flatnonzero(some) + i
                    best[at] = np.array(names, object)[cosine.argmax(axis=1)]
                    score[at] = np.clip((1 + cosine.max(axis=1)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
