"""Substring search: occurrences, counts, membership and suffix intervals. Overlapping occurrences all count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text
from .index import HEAD
from .intervals import children

BROADCAST_BYTES = 16 << 20
SEED = 16


def _bytes(query: str | bytes) -> bytes:
    return query.encode() if isinstance(query, str) else bytes(query)


def occ(text: Column, query: str) -> Column:
    """How often the string occurs in a STRING column; an empty query occurs at every byte. JVM only."""
    if not query:
        return F.octet_length(text)
    return F.regexp_count(text, F.lit(f"(?=\\Q{query.replace(chr(92) + 'E', chr(92) + 'E' + chr(92) * 2 + 'E' + chr(92) + 'Q')}\\E)"))


def contains(text: Column, query: str) -> Column:
    """Whether the string occurs; with a literal the Parquet scan filters by it."""
    return text.contains(query)


def find(texts: DataFrame, query: str | bytes) -> DataFrame:
    """doc_id, pos of every occurrence (bytes from 0), unindexed."""
    q = _bytes(query)
    return per_text(texts, lambda t: [(p,) for p in suffixes.occurrences(t, q)], "pos int")


def find_sorted(texts: DataFrame, query: str | bytes) -> DataFrame:
    """doc_id, ord, pos of every occurrence, numbered in suffix order."""
    q = _bytes(query)

    def kernel(text):
        at = suffixes.occurrences(text, q)
        if len(at) < 2:
            return [(0, p) for p in at]
        rank = [0] * len(text)
        for r, p in enumerate(suffixes.suffix_array(text)[0].tolist()):
            rank[p] = r
        return list(enumerate(sorted(at, key=rank.__getitem__)))

    return per_text(texts, kernel, "ord int, pos int")


def find_many(texts: DataFrame, queries: DataFrame, doc_id: str = "doc_id", first: bool = False) -> DataFrame:
    """doc_id, query_id, pos of all occurrences of all queries(query_id, q BINARY or STRING).

    With `first` only the first occurrence of each query (a row of queries) in each text (a row of texts).  While the
    queries have at most BROADCAST_BYTES they go to every task at once, as a table by length; beyond, texts and queries
    meet in an equi-join on the hash of the queries' first bytes.
    """
    kind = queries.schema["q"].dataType.simpleString()
    named = queries.select("query_id", (F.col("q") if kind == "binary" else F.encode("q", "UTF-8")).alias("q")).where("q IS NOT NULL")
    held = named.agg(F.sum(F.octet_length("q") + 32)).first()[0] or 0
    if held > BROADCAST_BYTES:
        return find_many_joined(texts, named, doc_id, first)
    by_length: dict[int, dict[bytes, list]] = {}
    for r in named.collect():
        q = bytes(r["q"])
        by_length.setdefault(len(q), {}).setdefault(q, []).append(r["query_id"])

    def kernel(text):
        for size, known in by_length.items():
            if size == 0:
                yield from ((i, p) for i in known[b""] for p in range(min(len(text), 1) if first else len(text)))
            elif len(known) <= 64:
                for q, ids in known.items():
                    for p in suffixes.first_occurrence(text, q) if first else suffixes.occurrences(text, q):
                        yield from ((i, p) for i in ids)
            else:
                left = dict(known) if first else known
                for p in range(len(text) - size + 1):
                    q = text[p : p + size]
                    if q in left:
                        yield from ((i, p) for i in (left.pop(q) if first else left[q]))

    return per_text(texts, lambda t: list(kernel(t)), f"query_id {queries.schema['query_id'].dataType.simpleString()}, pos int", keys=(doc_id,))


def find_many_joined(texts: DataFrame, queries: DataFrame, doc_id: str = "doc_id", first: bool = False) -> DataFrame:
    """find_many of any number of queries(query_id, q BINARY): places meet queries on a hash of the first SEED bytes at most, then all bytes are compared.

    Equal rows of either side are met once and counted; a row is known by its id, which may be null or repeat, and its text.
    """
    asked = queries.groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("asked"))
    sized = asked.withColumn("size", F.least(F.octet_length("q"), F.lit(SEED)))
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]  # SEED + 1 at most
    wanted = sized.select("query_id", "q", "asked", "size", F.xxhash64(F.expr("substring(q, 1, size)")).alias("h"))
    there = texts.where(F.octet_length("text") > 0).groupBy(doc_id, "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("t", F.xxhash64("text"))
    places = there.select(doc_id, "t", "text", F.explode(F.expr("sequence(0, octet_length(text) - 1)")).alias("pos"))
    each = places.select(doc_id, "t", "text", "pos", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size"))
    seeds = each.where("pos + size <= octet_length(text)").select(F.col(doc_id).alias("own"), F.col("t").alias("own_t"), "pos", "size", F.xxhash64(F.expr("substring(text, pos + 1, size)")).alias("h"))
    met = seeds.join(wanted, ["size", "h"]).join(there, F.col("own").eqNullSafe(F.col(doc_id)) & (F.col("own_t") == F.col("t")))
    hits = met.where(F.expr("substring(text, pos + 1, octet_length(q)) = q")).select(doc_id, "t", "query_id", "q", "pos", (F.col("copies") * F.col("asked")).alias("times"))
    if first:
        hits = hits.groupBy(doc_id, "t", "query_id", "q", "times").agg(F.min("pos").alias("pos"))
    return hits.select(doc_id, "query_id", "pos", F.explode(F.expr("sequence(1, times)")).alias("time")).drop("time")


def _prefix(text: Column, pos: Column, size: int) -> Column:
    return F.substring(text, pos + 1, F.lit(size))


def bisect(index: DataFrame, texts: DataFrame, query: str | bytes, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id, lo, hi: the half-open interval of ranks in start..stop whose suffix starts with the query (lo = hi where none does).

    lo is the first rank whose first len(query) bytes are not below the query, hi the first whose are above; without stop
    to the last rank.  This counts over the rows of an index; bisect_packed searches the packed one.
    """
    q = F.lit(_bytes(query))
    head = _prefix(F.col("text"), F.col("pos"), len(_bytes(query)))
    inside = F.col("rank") >= start
    if stop is not None:
        inside = inside & (F.col("rank") < stop)
    joined = index.select("doc_id", "rank", "pos").join(texts, "doc_id")
    n = F.count(F.lit(1))
    counted = joined.groupBy("doc_id").agg(F.count_if(inside & (head < q)).alias("lo"), F.count_if(inside & (head <= q)).alias("hi"), n.alias("n"))
    first = F.least(F.lit(start), F.col("n"))
    return counted.select("doc_id", (first + F.col("lo")).cast("int").alias("lo"), (first + F.col("hi")).cast("int").alias("hi"))


def bisect_packed(packed: DataFrame, query: str | bytes, start: int = 0, stop: int | None = None) -> DataFrame:
    """As bisect, by binary search in rows (doc_id, text, sa) as index.packed_texts() gives: a map without shuffle."""
    q = _bytes(query)
    return per_text(packed, lambda text, sa: [suffixes.bisect(text, sa, q, min(start, len(sa)), stop)] if sa else [], "lo int, hi int", inputs=("text", "sa"))


def sa_interval(index: DataFrame, texts: DataFrame, query: str | bytes) -> DataFrame:
    """doc_id, lo, hi of the texts in which the query occurs: only rows whose suffix starts with the query are gathered.

    If the index has the column `head` (index.with_heads), rows are read by it first, and the texts only for longer queries.
    """
    q = _bytes(query)
    rows = _starting(index, texts, q)
    return rows.groupBy("doc_id").agg(F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"))


def _starting(index: DataFrame, texts: DataFrame, q: bytes) -> DataFrame:
    """Rows of the index whose suffix starts with q."""
    if "head" in index.columns and q:
        part = q[:HEAD]
        index = index.where(F.col("head") >= F.lit(part))
        if above := _successor(part):
            index = index.where(F.col("head") < F.lit(above))
        if len(q) <= HEAD:
            return index
    return index.join(texts, "doc_id").where(_prefix(F.col("text"), F.col("pos"), len(q)) == F.lit(q))


def _successor(q: bytes) -> bytes:
    """The smallest bytes above all that start with q; empty if there are none."""
    q = q.rstrip(b"\xff")
    return q[:-1] + bytes([q[-1] + 1]) if q else b""


def find_indexed(index: DataFrame, texts: DataFrame, query: str | bytes) -> DataFrame:
    """doc_id, ord, pos from an index: the ranks of the interval in turn."""
    hits = _starting(index, texts, _bytes(query))
    return hits.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("rank")) - 1).alias("ord"), "pos")


def get_children(index: DataFrame, texts: DataFrame, byte: int, left: int = 0, right: int | None = None) -> DataFrame:
    """doc_id, lb, rb: the child of the interval left..right (the root, if not given) whose suffixes go on with `byte`.

    No row where there is none; an interval of one rank has no children.
    """
    parts = children(index, left, right, depth=True)
    first = parts.join(index.select("doc_id", F.col("rank").alias("lb"), "pos"), ["doc_id", "lb"]).join(texts, "doc_id")
    return first.where(F.expr("substring(text, pos + depth + 1, 1)") == F.lit(bytes([byte]))).select("doc_id", "lb", "rb")

