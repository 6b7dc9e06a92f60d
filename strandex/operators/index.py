"""Building indexes: one row a suffix, (doc_id, rank, pos, lcp, bwt).

rank is the place in suffix order (the suffix array is pos by rank, its inverse rank by pos), lcp the common prefix with
the suffix before, bwt the byte before the suffix (a zero byte before the whole text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text

SHORT = 64  # texts up to so many bytes are sorted by Spark itself
HEAD = 8  # bytes of a suffix that with_heads() keeps


def suffix_rows(texts: DataFrame) -> DataFrame:
    """Every suffix as a row: doc_id, pos, suffix, bwt."""
    there = texts.where(F.octet_length("text") > 0)
    each = there.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.octet_length("text") - 1)).alias("pos"))
    return each.select("doc_id", "pos", F.expr("substring(text, pos + 1)").alias("suffix"), F.expr("IF(pos = 0, X'00', substring(text, pos, 1))").alias("bwt"))


def index_sql(texts: DataFrame) -> DataFrame:
    """Suffix order by a window; every sort key is a suffix, so for short texts only."""
    order = W.partitionBy("doc_id").orderBy("suffix")
    ranked = suffix_rows(texts).withColumns({"rank": F.row_number().over(order) - 1, "before": F.lag("suffix").over(order)})
    lcp = F.expr("size(filter(sequence(0, least(octet_length(before), octet_length(suffix))), k -> substring(before, 1, k) = substring(suffix, 1, k))) - 1")
    return ranked.select("doc_id", "rank", "pos", F.when(F.col("before").isNull(), 0).otherwise(lcp).alias("lcp"), "bwt")


def index_kernel(texts: DataFrame, columns: tuple[str, ...] = ("rank", "pos", "lcp", "bwt")) -> DataFrame:
    """Prefix doubling in numpy for each text, in Arrow batches; only the named columns are made."""
    kinds = {"rank": "int", "pos": "int", "lcp": "int", "bwt": "binary"}
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in columns)

    def run(batches):
        for b in batches:
            for key, text in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                if "lcp" in columns:
                    sa, lcp = suffixes.suffix_array(text)
                else:
                    sa, lcp = suffixes.suffix_places(text), None
                n = len(sa)
                made = {
                    "rank": lambda n=n: pa.array(np.arange(n, dtype=np.int32)),
                    "pos": lambda sa=sa: pa.array(sa.astype(np.int32)),
                    "lcp": lambda lcp=lcp: pa.array(lcp.astype(np.int32)),
                    "bwt": lambda n=n, text=text, sa=sa: pa.FixedSizeBinaryArray.from_buffers(pa.binary(1), n, [None, pa.py_buffer(suffixes.bwt(text, sa).tobytes())]).cast(pa.binary()),
                }
                ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([key.as_py()], b.schema.field("doc_id").type)).dictionary_decode()
                yield pa.RecordBatch.from_arrays([ids, *(made[c]() for c in columns)], ["doc_id", *columns])

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def build_index(texts: DataFrame, method: str = "auto") -> DataFrame:
    """method: sql, kernel, or auto (by the text's length)."""
    if method == "sql":
        return index_sql(texts)
    if method == "kernel":
        return index_kernel(texts)
    size = F.octet_length("text")
    return index_sql(texts.where(size <= SHORT)).unionByName(index_kernel(texts.where(size > SHORT)))


def suffix_array(index: DataFrame) -> DataFrame:
    return index.select("doc_id", "rank", "pos")


def inverse_suffix_array(index: DataFrame) -> DataFrame:
    return index.select("doc_id", "pos", "rank")


def bwt(index: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id and the whole transform. Given the texts, with the empty suffix's row in front and the primary row, which makes it invertible."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "bwt"))), lambda x: F.hex(x["bwt"]))
    out = index.groupBy("doc_id").agg(F.unhex(F.array_join(parts, "")).alias("bwt"), F.max(F.when(F.col("pos") == 0, F.col("rank") + 1)).alias("primary"))
    if texts is None:
        return out.select("doc_id", "bwt")
    return out.join(texts, "doc_id").select("doc_id", F.concat(F.expr("substring(text, -1, 1)"), "bwt").alias("bwt"), "primary")


def lcp_array(index: DataFrame) -> DataFrame:
    """doc_id, i, lcp with n + 1 entries, the last 0."""
    rows = index.select("doc_id", F.col("rank").alias("i"), "lcp")
    return rows.unionByName(index.groupBy("doc_id").agg((F.max("rank") + 1).alias("i")).select("doc_id", "i", F.lit(0).alias("lcp")))


def packed(index: DataFrame) -> DataFrame:
    """doc_id with the arrays sa, isa, lcp (n + 1) in one row."""
    grouped = index.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "lcp"))).alias("r"), F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("p"))
    return grouped.select("doc_id", F.transform("r", lambda x: x["pos"]).alias("sa"), F.transform("p", lambda x: x["rank"]).alias("isa"), F.concat(F.transform("r", lambda x: x["lcp"]), F.array(F.lit(0))).alias("lcp"))


def packed_texts(texts: DataFrame) -> DataFrame:
    """doc_id, text, sa: each text beside its suffix array, for search.bisect_packed; a map without shuffle."""
    both = texts.select("doc_id", "text", F.col("text").alias("own"))
    return per_text(both, lambda text, own: [(own, suffixes.suffix_places(text).tolist())], "own binary, sa array<int>", inputs=("text", "own")).withColumnRenamed("own", "text")


def with_heads(index: DataFrame, texts: DataFrame, size: int = HEAD) -> DataFrame:
    """The index with `head`, the first bytes of each suffix: sorted by it, a stored index is read by ranges of it."""
    return index.join(texts, "doc_id").select(*index.columns, F.expr(f"substring(text, pos + 1, {size})").alias("head"))


def materialised(index: DataFrame) -> list[str]:
    """The columns of the index that are held in memory or on disk: none before it is persisted."""
    level = index.storageLevel
    return list(index.columns) if level.useMemory or level.useDisk else []


def byte_buckets(texts: DataFrame) -> DataFrame:
    """doc_id, byte, n, first, last: how often each byte occurs and the ranks [first, last) of suffixes that begin with it."""
    each = texts.where(F.octet_length("text") > 0).select("doc_id", F.explode(F.expr("transform(sequence(1, octet_length(text)), i -> CAST(conv(hex(substring(text, i, 1)), 16, 10) AS INT))")).alias("byte"))
    counted = each.groupBy("doc_id", "byte").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("doc_id").orderBy("byte"))
    return counted.select("doc_id", "byte", "n", (upto - F.col("n")).alias("first"), upto.alias("last"))


def index_size(index: DataFrame) -> DataFrame:
    """Bytes of an index and bits an entry, by text."""
    entry = 4 + 4 + 4  # rank, pos and lcp as INT
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.lit(entry) + F.octet_length("bwt")).alias("nbytes")).withColumn("bits_per_entry", 8.0 * F.col("nbytes") / F.col("entries"))
