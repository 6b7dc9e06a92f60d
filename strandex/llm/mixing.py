"""Mixing sources to target weights [native] by entropy balancing.

Every document gets the rate r at which the mix takes it.  Of all rates that meet the sources' word targets
(sum of size * r = target, r at most MOST) the ones closest to 1 are taken, by the relative entropy
sum(r log r - r + 1) over the documents.  They are exponentially tilted: r = exp(lambda * x), at most MOST, where x is the
document's size over its source's mean size and lambda is the source's multiplier.  Each multiplier minimises a convex
dual, sum(psi(lambda * x)) - lambda * target / mean, with psi(z) = exp(z) - 1, a straight line beyond log MOST.

Newton's iteration solves the dual for all sources at once: a step is one distributed aggregation of gradient and Hessian
by source, over the documents counted by (source, size), since documents alike in both share their rate.  A step that
leaves the bracket of the root, or fails to halve the gradient, is replaced by bisection.  The sums are exact decimals
of rounded terms, so reruns agree to the last bit.

Rates become copies by systematic rounding: documents of a source stand in order of size, and a document gets the whole
numbers that the running sum of rates (whole multiples of 1 / UNIT) passes at it.  So the words taken differ from the
target by about the source's largest document at most, and no document is taken over MOST times.  The sum may start
anywhere: of PHASES starts each source gets the one whose words come nearest to its target.  Running sums come from
three levels (size class, bucket of ids, place in the bucket), so no task holds a source: a bucket has about BUCKET_ROWS
rows of all documents, however many of them one source or one size has.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; a target stops at 3 times its source's words, and
the rest shares the excess by weight until none is above.  Sources are numbered and summed in ranges, not in one task.

Edge cases: null text has size 0; a source without words has target 0 and rate 1; a source with MOST times its words as
target has rate MOST; a null doc_id counts as its size in the order; wholly equal rows are ordered among themselves, so
that one may be taken once more than the other; the result's columns replace columns of docs with their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, numbered, read, release, stored

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS = 2000
UNIT = 1 << 20
PHASES = 16
MOST_STEPS = 200
BROADCAST_SOURCES = 100_000
RESULT = ("size", "source_size", "target", "copies", "taken")
_PRIME, _FACTOR = 2147483647, 48271  # a step of a Lehmer generator: spreads ids with a common stride


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source):
    """A source as a string that is never null: null is the empty one."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(totals: DataFrame) -> DataFrame:
    """totals(key, source_size, ...) with target."""
    by_name = numbered(totals.withColumn("last", F.col("key") == ""), ["last", "key"], {})
    weighed = by_name.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))).drop("last", "number")
    share = weighed.withColumns({"share": F.col("source_size") / F.col("weight"), "most": F.col("source_size") * MOST})
    ordered = numbered(share, ["share", "weight", "source_size", "key"], {"used": "most", "gone": "weight"})
    whole = ordered.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    both = ordered.crossJoin(F.broadcast(whole))  # one row
    level = (F.col("total") - F.col("used")).cast("double") / (F.col("weights") - F.col("gone"))
    fits = F.col("most") >= F.col("weight") * level
    line = both.agg(F.min_by(F.when(fits, level), F.when(fits, F.col("gone"))).alias("level"))
    met = ordered.crossJoin(F.broadcast(line))  # one row
    return met.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))).select(*totals.columns, "target")


def _exact(term):
    """Sum of the terms, rounded to parts of a word, so that their order does not matter."""
    return (F.sum(F.round(term * float(1 << 30)).cast("decimal(38,0)")).cast("double") / float(1 << 30)).cast("double")


def newton(state: DataFrame, hist: DataFrame, broadcast: bool) -> DataFrame:
    """One step of the open sources: state(key, target, mean, lam, lo, hi, miss, done), hist(key, size, n)."""
    state = F.broadcast(state) if broadcast else state
    both = hist.join(state.where("not done"), "key")
    x = F.col("size") / F.col("mean")
    z = F.col("lam") * x
    rate = F.exp(F.least(z, F.lit(log(MOST))))
    words = F.col("n") * F.col("size") * rate
    sums = both.groupBy("key", "target", "mean", "lam", "lo", "hi", "miss").agg(
        _exact(words).alias("words"), _exact(F.when(z < log(MOST), words * x).otherwise(0.0)).alias("slope"), F.count(F.lit(1)).alias("sizes"),
    )
    gradient = F.col("words") - F.col("target")
    lo = F.when(gradient <= 0, F.col("lam")).otherwise(F.col("lo"))
    hi = F.when(gradient >= 0, F.col("lam")).otherwise(F.col("hi"))
    by_newton = F.when(F.col("slope") > 0, F.col("lam") - gradient / F.nullif(F.col("slope"), F.lit(0.0)))
    middle = F.when(lo.isNull(), 2 * F.least(F.col("lam"), F.lit(0.0)) - 1).when(hi.isNull(), 2 * F.greatest(F.col("lam"), F.lit(0.0)) + 1).otherwise((lo + hi) / 2)
    inside = by_newton.isNotNull() & F.coalesce(by_newton > lo, F.lit(True)) & F.coalesce(by_newton < hi, F.lit(True)) & F.coalesce(F.abs(gradient) <= F.col("miss") / 2, F.lit(True))
    stepped = F.when(gradient == 0, F.col("lam")).when(inside, by_newton).otherwise(middle)
    near = F.abs(gradient) <= F.greatest(F.col("target") * 1e-13, F.col("sizes") / float(1 << 30))
    stuck = F.coalesce((hi - lo) <= F.abs(F.col("lam")) * 1e-15, F.lit(False))
    moved = sums.select("key", "target", "mean", stepped.alias("lam"), lo.alias("lo"), hi.alias("hi"), F.abs(gradient).alias("miss"), (near | stuck).alias("done"))
    return moved.unionByName(state.where("done"))


def multipliers(wanted: DataFrame, hist: DataFrame) -> DataFrame:
    """key, mean, lam of each source in between; wanted(key, source_size, n, target), hist(key, size, n)."""
    between = wanted.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST))
    none = F.lit(None).cast("double")
    state = checkpoint(between.select("key", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), none.alias("miss"), F.lit(False).alias("done")))
    few = state.count() <= BROADCAST_SOURCES
    for _ in range(MOST_STEPS):
        if state.where("not done").isEmpty():
            return state.select("key", "mean", "lam")
        state = checkpoint(newton(state, hist, few))
    raise RuntimeError(f"the dual is not solved after {MOST_STEPS} steps")


def rates(sized: DataFrame) -> tuple[DataFrame, bool]:
    """key, source_size, target, fixed, mean, lam of each source of sized(key, size), and whether they may be broadcast."""
    hist = stored(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    totals = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    wanted = stored(targets(totals), "targets")
    found = wanted.join(multipliers(wanted, hist.where("size > 0")), "key", "left")
    fixed = F.when(F.col("target") >= F.col("source_size") * MOST, F.when(F.col("source_size") > 0, F.lit(float(MOST))).otherwise(1.0)).when(F.col("target") <= 0, F.lit(0.0))
    known = checkpoint(found.select("key", "source_size", "target", fixed.alias("fixed"), "mean", "lam"))
    return known, known.count() <= BROADCAST_SOURCES


def mix(docs: DataFrame, size=None) -> DataFrame:
    """docs (doc_id, source, text if no size is given, ...) with the columns RESULT; other columns stay."""
    names = [c for c in docs.columns if c not in RESULT]
    size = size_of(F.col("text")) if size is None else size
    # Written once with its size, which several jobs read without the texts.
    keyed = stored(docs.select(F.struct("*").alias("row"), _key(F.col("source")).alias("key"), size.alias("size"), F.col("doc_id").cast("long").alias("doc_id")), "sized")
    buckets = max(1, -(-keyed.count() // BUCKET_ROWS))
    known, few = rates(keyed.select("key", "size"))
    release(docs.sparkSession)
    tilted = F.exp(F.least(F.col("lam") * (F.col("size") / F.col("mean")), F.lit(log(MOST))))
    digits = F.col("size").cast("string")
    step = F.pmod(F.coalesce("doc_id", "size"), F.lit(_PRIME)) * _FACTOR % _PRIME
    placed = keyed.join(F.broadcast(known) if few else known, "key").withColumns({
        "rate": F.round(F.coalesce("fixed", tilted) * UNIT).cast("long"),
        "class": F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"),
        "bucket": F.pmod(step, F.lit(buckets)),
    })
    sums = placed.groupBy("key", "class", "bucket").agg(F.sum("rate").alias("rate"))
    classes = sums.groupBy("key", "class").agg(F.sum("rate").alias("rate"))
    ahead = lambda *by: F.coalesce(F.sum("rate").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = sums.withColumn("within", ahead("key", "class", "bucket")).drop("rate")
    offsets = stored(within.join(classes.withColumn("before", ahead("key", "class")).drop("rate"), ["key", "class"]), "offsets")
    inside = W.partitionBy("key", "class", "bucket").orderBy("size", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)

    def running(rows):
        """rows with upto, the sum of their source's rates up to each."""
        summed = rows.withColumn("inside", F.sum("rate").over(inside)).join(offsets, ["key", "class", "bucket"])
        return summed.withColumn("upto", F.col("before") + F.col("within") + F.col("inside"))

    def copies(start):
        shift = UNIT.bit_length() - 1
        return F.shiftright(F.col("upto") + start, shift) - F.shiftright(F.col("upto") - F.col("rate") + start, shift)

    starts = [k * (UNIT // PHASES) for k in range(PHASES)]
    taken = running(placed.select("key", "class", "bucket", "size", "doc_id", "rate", "target")).groupBy("key").agg(F.max("target").alias("target"), F.array(*[F.sum(copies(F.lit(x)) * F.col("size")) for x in starts]).alias("words"))
    nearest = F.array_min(F.transform("words", lambda w, k: F.struct(F.abs(w - F.col("target")).alias("gap"), k.alias("k"))))["k"]
    chosen = checkpoint(taken.select("key", (nearest * (UNIT // PHASES)).alias("start")))
    out = running(placed).join(F.broadcast(chosen) if few else chosen, "key")
    out = out.withColumn("copies", copies(F.col("start")))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir) -> DataFrame:
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("words"))
    return mix(sized, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


#: The multipliers by bisection over each source's list of sizes.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
c AS (SELECT *, coalesce(sum(source_size * 3) OVER f, 0)::BIGINT AS used, coalesce(sum(weight) OVER f, 0)::BIGINT AS gone, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights
  FROM t WINDOW f AS (ORDER BY source_size / weight, weight, source_size, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - used)::DOUBLE / (weights - gone) AS lev FROM c),
m AS (SELECT arg_min(lev, gone) AS lev FROM l WHERE source_size * 3 >= weight * lev),
g AS (SELECT source, source_size, n, source_size::DOUBLE / n AS mean, least(source_size::DOUBLE * 3, weight * m.lev) AS target FROM c, m),
h AS (SELECT source, list({'s': size, 'n': n}) AS sizes FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size) GROUP BY source),
b AS (SELECT 0 AS step, g.source, target, mean, sizes, -1e6::DOUBLE AS lo, 1e6::DOUBLE AS hi FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source WHERE target > 0 AND target < source_size * 3
  UNION ALL SELECT step + 1, source, target, mean, sizes, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT *, list_sum(list_transform(sizes, lambda x: x.n * x.s * exp(least((lo + hi) / 2 * (x.s / mean), ln(3.0))))) < target AS low FROM b WHERE step < 90)),
u AS (SELECT source, (lo + hi) / 2 AS lam FROM b WHERE step = 90),
r AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
    round((CASE WHEN target >= g.source_size * 3 THEN CASE WHEN g.source_size > 0 THEN 3.0 ELSE 1.0 END WHEN target <= 0 THEN 0.0 ELSE exp(least(lam * (size / mean), ln(3.0))) END)::DOUBLE * 1048576)::BIGINT AS rate,
    length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS class,
    (((coalesce(doc_id, size) % 2147483647 + 2147483647) % 2147483647) * 48271 % 2147483647) % greatest(1, ceil((SELECT count(*) FROM d) / 2000.0))::BIGINT AS bucket
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source),
p AS (SELECT *, (sum(rate) OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM r),
e AS (SELECT source, target, k, sum((((upto + k) >> 20) - ((upto - rate + k) >> 20)) * size) AS words FROM p, (SELECT unnest(range(16)) * 65536 AS k) GROUP BY source, target, k),
s AS (SELECT source, arg_min(k, struct_pack(gap := abs(words - target), k := k)) AS k FROM e GROUP BY source)
SELECT doc_id, size, source_size, target, ((((upto + k) >> 20) - ((upto - rate + k) >> 20)) * size)::BIGINT AS taken
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
"""
