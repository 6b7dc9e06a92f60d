"""Repeats inside a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text


def longest_repeated_substring(index: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, pos, substring: all occurrences of every substring of the greatest length that occurs twice; overlap counts."""
    order = W.partitionBy("doc_id").orderBy("rank")
    marked = index.select("doc_id", "pos", "lcp", F.lead("lcp", 1, 0).over(order).alias("next"), F.max("lcp").over(W.partitionBy("doc_id")).alias("m"))
    kept = marked.where("m > 0 AND (lcp = m OR next = m)")
    return kept.join(texts, "doc_id").select("doc_id", "pos", F.expr("substring(text, pos + 1, m)").alias("substring"))


def supermaximal_repeats(texts: DataFrame) -> DataFrame:
    """doc_id, substring, copies: repeats that are part of no other repeat."""

    def kernel(text):
        sa, _ = suffixes.suffix_array(text)
        return [(text[sa[lb] : sa[lb] + v], rb - lb + 1) for v, lb, rb in suffixes.supermaximal(text)]

    return per_text(texts, kernel, "substring binary, copies int")


def _tandem(text, rows):
    out = []
    for left, right, period in rows:
        n = right - left
        out.append((left, right, period, text[right - 2 * period : right - period], text[left : left + period], n // period, n % period))
    return out


_TANDEM = "left int, right int, period int, unit binary, first binary, copies int, remainder int"


def tandem_repeats(texts: DataFrame) -> DataFrame:
    """doc_id, left, right, period, unit, copies, remainder of every maximal run of each period that spans it twice or more."""
    return per_text(texts, lambda t: _tandem(t, suffixes.tandems(t)), _TANDEM).drop("first")


def primitive_tandem_repeats(texts: DataFrame) -> DataFrame:
    """doc_id, left, right, period, copies, remainder, unit: of each run only its smallest period; the unit is its first."""

    def kernel(text):
        least: dict = {}
        for left, right, period in suffixes.tandems(text):
            least[left, right] = min(period, least.get((left, right), period))
        return _tandem(text, [(*k, p) for k, p in sorted(least.items())])

    return per_text(texts, kernel, _TANDEM).select("doc_id", "left", "right", "period", "copies", "remainder", F.col("first").alias("unit"))


def tandem_repeats_sql(texts: DataFrame) -> DataFrame:
    """As tandem_repeats, in SQL alone by gaps and islands; work grows with the square of a text's length."""
    sized = texts.withColumn("n", F.octet_length("text")).where("n >= 2")
    periods = sized.select("doc_id", "text", "n", F.explode(F.expr("sequence(1, n div 2)")).alias("period"))
    same = periods.select("doc_id", "n", "period", "text", F.explode(F.expr("sequence(0, n - period - 1)")).alias("k")).where("substring(text, k + 1, 1) = substring(text, k + period + 1, 1)")
    island = F.col("k") - F.row_number().over(W.partitionBy("doc_id", "period").orderBy("k"))
    runs = same.withColumn("g", island).groupBy("doc_id", "period", "g").agg(F.min("k").alias("left"), (F.max("k") + 1 + F.col("period")).alias("right"), F.count(F.lit(1)).alias("c")).where("c >= period")
    return runs.join(texts, "doc_id").select("doc_id", "left", "right", "period", F.expr("substring(text, right - 2 * period + 1, period)").alias("unit"), F.expr("int((right - left) div period)").alias("copies"), F.expr("(right - left) % period").alias("remainder"))
