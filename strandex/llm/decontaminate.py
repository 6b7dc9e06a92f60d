"""Benchmark decontamination [native]: a broadcast hash set of the test items' word windows, held against all windows of
the training texts inside one code-generated stage; hits are verified word by word.

Words are runs of digits, lower-case a-z (A-Z are lowered) and characters beyond ASCII.  A window has WINDOW consecutive
words of an item; an item with fewer words, but not none, is one window.  Equal windows of several items are one row of
the set.  The set is broadcast while it holds at most BROADCAST_BYTES; beyond, both sides are shuffled on the window's
hash and text, where adaptive execution may split a window that is very frequent.

Only hits and one row for each document are shuffled, by document; those of rows alike in doc_id and text are merged
before the shuffle, so many such rows (without ids, say) are few there.

Edge cases: null and empty texts have no words; a null item_id counts as the empty id; rows with equal doc_id are judged
each by its own text; wholly equal rows all come back; an empty benchmark hits nothing; other columns of docs are not
looked at, and clean() keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored

WINDOW = 10
BROADCAST_BYTES = 32 << 20
BROADCAST_IDS = 500_000  # rows of two numbers
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_WORD), "")


def _hash(at, length: int):
    """Hash of the `length` words from position `at` of the column words on; null if they run over the end."""
    parts = [F.get(F.col("words"), at + k) for k in range(length)]
    return F.when((at >= 0) & (at + length <= F.size("words")), F.xxhash64(F.lit(length), *parts))


def windows(bench: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(h, w, ids): hash, words (space-joined) and sorted item ids of each distinct window; and the lengths that occur."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window)))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())
    each = items.select("id", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("i"))
    h = F.coalesce(*[F.when(F.col("length") == n, _hash(F.col("i"), n)) for n in lengths], F.lit(None).cast("long")) if lengths else F.lit(None).cast("long")
    each = each.select(h.alias("h"), F.array_join(F.slice("words", F.col("i") + 1, F.col("length")), " ").alias("w"), "id")
    return each.groupBy("h", "w").agg(F.sort_array(F.collect_set("id")).alias("ids")), lengths


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, base_rows: bool = True) -> DataFrame:
    """(doc_id, sig, n, i, length, ids): occurrences of windows; with base_rows also a row i = -1 for each document."""
    hashes, lengths = windows(bench, window)
    hashes = stored(hashes, "windows")
    split = docs.select("doc_id", F.xxhash64("text").alias("sig"), words(F.col("text")).alias("words"))
    first = F.lit(-1) if base_rows else F.when(F.size("words") > 0, F.lit(0))
    placed = split.select("doc_id", "sig", "words", F.explode(F.sequence(first, F.size("words") - 1)).alias("i"))
    if len(lengths) > 1:
        each = [F.struct(F.lit(n).alias("length"), _hash(F.col("i"), n).alias("h")) for n in lengths]
        probe = placed.select("doc_id", "sig", "words", "i", F.explode(F.when(F.col("i") < 0, F.array(each[0])).otherwise(F.array(*each))).alias("x")).select("doc_id", "sig", "words", "i", "x.length", "x.h")
    else:
        n = lengths[0] if lengths else window
        probe = placed.select("doc_id", "sig", "words", "i", F.lit(n).alias("length"), _hash(F.col("i"), n).alias("h"))
    text = F.array_join(F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("length")), " ")
    held = hashes.agg(F.sum(F.octet_length("w") + F.octet_length(F.array_join("ids", ",")) + 16 * F.size("ids") + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        # The words are compared after the join, so that only hits of the hash pay for them.
        found = probe.join(F.broadcast(hashes.withColumnRenamed("h", "bh")), F.col("h") == F.col("bh"), "left").where((F.col("i") < 0) | (text == F.col("w")))
        n_words = F.size("words")
    else:
        probe = probe.select("doc_id", "sig", "i", "length", "h", F.when(F.col("i") >= 0, text).alias("v"), F.when(F.col("i") < 0, F.size("words")).alias("n"))
        found = probe.join(hashes.withColumnRenamed("h", "bh"), (F.col("h") == F.col("bh")) & (F.col("v") == F.col("w")), "left")
        n_words = F.col("n")
    found = found.where((F.col("i") < 0) | F.col("ids").isNotNull())
    return found.select("doc_id", "sig", F.when(F.col("i") < 0, n_words).cast("long").alias("n"), "i", "length", "ids")


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    found = hits(docs, bench, window).groupBy("doc_id", "sig", "i", "length").agg(F.first("n").alias("n"), F.first("ids").alias("ids"), F.count(F.lit(1)).alias("c"))
    before = W.partitionBy("doc_id", "sig").orderBy("i", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.when(F.col("i") >= 0, F.col("i") + F.col("length"))
    reach = F.coalesce(F.max(end).over(before), F.lit(0))
    covered = found.withColumn("fresh", F.when(F.col("i") >= 0, F.greatest(F.lit(0), F.col("i") + F.col("length") - F.greatest(F.col("i"), reach))).otherwise(0))
    each = covered.groupBy("doc_id", "sig").agg(
        F.max("n").alias("n_words"), F.sum("fresh").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.max(F.when(F.col("i") < 0, F.col("c"))).alias("times"),
    )
    out = each.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k"),
    )
    return out.drop("k")


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents in which a window of an item occurs; all columns stay."""
    found = stored(hits(docs, bench, window, base_rows=False).select(F.col("doc_id").alias("id"), "sig").distinct(), "contaminated")
    few = found.count() <= BROADCAST_IDS
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("own"))
    return rows.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sig")), "left_anti").select("row.*")


def query(spark, sf_dir) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS v
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
hit AS (SELECT p.r, p.i, bw.n, bw.item_id FROM (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS v FROM p, (SELECT DISTINCT n FROM bw) WHERE i + n <= len(w)) p JOIN bw ON p.v = bw.v AND p.n = bw.n),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN ids USING (r)
"""
