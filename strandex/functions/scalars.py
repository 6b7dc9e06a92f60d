"""Integer helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTRINSICS = ("ffs", "clz", "ctz", "popcount", "parity")  # each for 32 and 64 bits


def min2(a: Column, b: Column) -> Column:
    return F.least(a, b)


def max2(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def argmin2(value: Column, pos: Column, value2: Column, pos2: Column) -> Column:
    """Position of the smaller value, of the first on a tie."""
    return F.when(value2 < value, pos2).otherwise(pos)


def argmin3(value: Column, pos: Column, value2: Column, pos2: Column, value3: Column, pos3: Column) -> Column:
    first, at = F.when(value2 < value, value2).otherwise(value), argmin2(value, pos, value2, pos2)
    return F.when(value3 < first, pos3).otherwise(at)


def log2i(n: Column) -> Column:
    """floor(log2 n), 0 for 0."""
    return F.length(F.bin(F.greatest(n, F.lit(1)))) - 1


def lsb(n: Column) -> Column:
    """Place of the lowest bit that is set, 0 for 0."""
    return F.when(n == 0, 0).otherwise(F.bit_count(n.bitwiseAND(-n) - 1))


def high_bits(i: Column) -> Column:
    """All bits but the lowest i."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1)


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def parity(n: Column) -> Column:
    return F.bit_count(n) % 2


def ctz(n: Column, bits: int = 32) -> Column:
    """Zeros below the lowest set bit; all bits for 0."""
    return F.when(n == 0, bits).otherwise(lsb(n))


def clz(n: Column, bits: int = 32) -> Column:
    """Zeros above the highest set bit of n in `bits` bits."""
    return F.when(n == 0, bits).when(n < 0, 0).otherwise(bits - F.length(F.bin(n)))


def ffs(n: Column) -> Column:
    """1 + place of the lowest set bit, 0 for 0."""
    return F.when(n == 0, 0).otherwise(lsb(n) + 1)


def catalan(n: Column) -> Column:
    """The Catalan number of n - 1 (1 for n = 1; null below), exact to n = 31."""
    m = n - 1
    value = F.aggregate(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), F.lit(1).cast("decimal(38,0)"), lambda c, k: (F.floor(c * (4 * k + 2) / (k + 2))).cast("decimal(38,0)"))
    return F.when(n == 1, 1).when(n > 1, value).cast("long")


def catalan_triangle(spark: SparkSession, n: int) -> DataFrame:
    """p, q, value of the ballot table: paths to (p, q) that stay with p <= q; the diagonal has the Catalan numbers (n up to 31)."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("q"))
    cells = rows.select("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("p"), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda c, k: F.floor(c * (F.col("q") + k) / k).cast("decimal(38,0)"))
    # (q + p choose p) * (q - p + 1) / (q + 1)
    value = F.when(F.col("p") > F.col("q"), 0).when(F.col("p") == 0, 1).otherwise(F.floor(product * (F.col("q") - F.col("p") + 1) / (F.col("q") + 1)))
    return cells.select("p", "q", value.cast("long").alias("value"))
