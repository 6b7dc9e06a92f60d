"""Range minima: the leftmost position of the smallest value in a[i..j], both ends included."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text

BLOCK = 256
MICRO, MIDDLE, SUPER = 8, 16, 256  # units of the size report


def rmq(values: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, i, j, argmin for values(doc_id, k, val) and queries(doc_id, i, j); a range out of bounds raises.

    Blocks of values are reduced to their minima first; a query meets the minima of the blocks it covers and the values
    of the two it cuts.  All joins are by doc_id and block.
    """
    cells = values.select("doc_id", "k", "val", F.expr(f"k div {block}").alias("blk"))
    minima = cells.groupBy("doc_id", "blk").agg(F.min(F.struct("val", "k")).alias("best"))
    asked = queries.distinct()
    spread = asked.select("doc_id", "i", "j", F.explode(F.expr(f"sequence(greatest(i, 0) div {block}, greatest(i, j, 0) div {block})")).alias("blk"))
    whole = (F.col("blk") * block >= F.col("i")) & (F.col("blk") * block + block - 1 <= F.col("j"))
    covered = spread.where(whole).join(minima, ["doc_id", "blk"]).select("doc_id", "i", "j", "best")
    cut = spread.where(~whole).join(cells, ["doc_id", "blk"]).where("k BETWEEN i AND j").select("doc_id", "i", "j", F.struct("val", "k").alias("best"))
    found = covered.unionByName(cut).groupBy("doc_id", "i", "j").agg(F.min("best").alias("best"))
    sizes = values.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    checked = asked.join(sizes, "doc_id", "left").join(found, ["doc_id", "i", "j"], "left")
    bad = (F.col("i") > F.col("j")) | (F.col("j") >= F.coalesce("n", F.lit(0))) | (F.col("i") < 0)
    fault = F.raise_error(F.concat(F.lit("IndexError: no range "), F.col("i").cast("string"), F.lit(".."), F.col("j").cast("string")))
    return checked.select("doc_id", "i", "j", F.when(bad, fault.cast("int")).otherwise(F.col("best.k").cast("int")).alias("argmin"))


def rmq_kernel(arrays: DataFrame, queries: DataFrame) -> DataFrame:
    """As rmq for arrays(doc_id, values ARRAY<INT>), one row an array: all its questions meet it in one map with tables of powers of two."""
    asked = queries.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("i", "j")).alias("asked"))

    def kernel(values, asked):
        i, j = (np.array([q[x] for q in asked], np.int64) for x in ("i", "j"))
        return list(zip(i.tolist(), j.tolist(), suffixes.SparseMin(values).queries(i, j).tolist(), strict=True))

    both = asked.join(arrays, "doc_id", "left").withColumn("values", F.coalesce("values", F.array().cast("array<int>")))
    return per_text(both, kernel, "i int, j int, argmin int", inputs=("values", "asked"))


def block_numbers(position):
    """The micro, middle and super block of a position."""
    return F.struct(*(F.floor(position / size).cast("int").alias(name) for name, size in (("microblock", MICRO), ("block", MIDDLE), ("superblock", SUPER))))


def sparse_table_size(values: DataFrame) -> DataFrame:
    """Bytes, bits and bits an entry of the kernel's power-of-two tables, by text (0 for one entry)."""
    n = F.col("entries")
    levels = F.floor(F.log2(n.cast("double"))).cast("int")
    cells = F.aggregate(F.sequence(F.lit(0), levels), F.lit(0).cast("long"), lambda t, k: t + F.when(k > 0, n - F.call_function("shiftleft", F.lit(1).cast("long"), k) + 1).otherwise(0))
    sized = values.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries")).withColumn("nbytes", 8 * cells)
    return sized.withColumns({"nbits": 8 * F.col("nbytes"), "overhead": 8.0 * F.col("nbytes") / n})
