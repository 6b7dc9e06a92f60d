"""Whole-text functions: rotations, palindromes, Lempel-Ziv factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text


def minimum_rotation(texts: DataFrame) -> DataFrame:
    """doc_id, result: the smallest rotation; of an empty text the empty one."""
    return per_text(texts, lambda t: [(suffixes.rotation(t),)], "result binary")


def minimum_rotation_sql(texts: DataFrame) -> DataFrame:
    """The same as an expression on every rotation; for short texts."""
    turns = F.expr("IF(octet_length(text) = 0, X'', array_min(transform(sequence(0, octet_length(text) - 1), i -> substring(concat(text, text), i + 1, octet_length(text)))))")
    return texts.where(F.col("text").isNotNull()).select("doc_id", turns.alias("result"))


def longest_palindrome(texts: DataFrame) -> DataFrame:
    """doc_id, result: the longest palindrome of bytes, of several the smallest."""
    return per_text(texts, lambda t: [(suffixes.palindrome(t),)], "result binary")


def lcs_with_reverse(texts: DataFrame) -> DataFrame:
    """doc_id, result: the longest substring that also occurs in the reversed text (no palindrome in general)."""
    return per_text(texts, lambda t: [(suffixes.common_substring(t, t[::-1]),)], "result binary")


def lz_factors(texts: DataFrame) -> DataFrame:
    """doc_id, ord, pos, len, factor: each factor is the longest text that also starts earlier (leftmost place), or a new byte."""

    def kernel(text):
        out, at = [], 0
        for k, (p, size) in enumerate(suffixes.factors(text)):
            out.append((k, p, size, text[at : at + size]))
            at += size
        return out

    return per_text(texts, kernel, "ord int, pos int, len int, factor binary")
