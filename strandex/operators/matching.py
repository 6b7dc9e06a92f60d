"""Matches between two texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text

MAX_SEEDS = 1_000_000


def longest_common_substring(pairs: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """keys, result of pairs(keys, text1, text2): the longest substring of both, of several the smallest; empty if none."""
    return per_text(pairs, lambda a, b: [(suffixes.common_substring(a, b),)], "result binary", keys, ("text1", "text2"))


def maximal_unique_matches(pairs: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """keys, ord, substring: what occurs once in each text and cannot be extended, in suffix order."""
    return per_text(pairs, lambda a, b: list(enumerate(suffixes.unique_matches(a, b))), "ord int, substring binary", keys, ("text1", "text2"))


def longest_shared_passage(texts: DataFrame, items: DataFrame, seed: int = 32) -> DataFrame:
    """doc_id, item_id, size: the longest substring of at least `seed` bytes that a text shares with each item.

    Pairs that share no seed never meet.  While the items have at most MAX_SEEDS seeds, every task holds their hashes and
    gives the items that a text meets; beyond, both sides' seeds meet in an equi-join.  The pairs that are left are
    matched whole.  Exact for passages of `seed` bytes or more.
    """
    items = items.where(F.octet_length("text") >= seed)
    n = items.agg(F.sum(F.octet_length("text") - seed + 1)).first()[0] or 0
    if n <= MAX_SEEDS:
        rows = items.select("item_id", "text").collect()
        hashes = [np.unique(suffixes.gram_hashes(bytes(r["text"]), seed)) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
        known = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(known, kind="stable")
        known, owner, ids = known[order], owner[order], [r["item_id"] for r in rows]

        def meets(text):
            h = np.unique(suffixes.gram_hashes(text, seed))
            lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            return [(ids[k],) for k in np.unique(np.concatenate([np.zeros(0, np.int64), *(owner[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True))]))]

        met = per_text(texts, meets, f"item_id {items.schema['item_id'].dataType.simpleString()}")
    else:
        grams = per_text(items, lambda t: [(int(h),) for h in np.unique(suffixes.gram_hashes(t, seed)).view(np.int64)], "h long", ("item_id",))
        own = per_text(texts, lambda t: [(int(h),) for h in np.unique(suffixes.gram_hashes(t, seed)).view(np.int64)], "h long")
        met = own.join(grams, "h").select("doc_id", "item_id").distinct()
    pairs = met.join(texts.select("doc_id", F.col("text").alias("text1")), "doc_id").join(items.select("item_id", F.col("text").alias("text2")), "item_id")
    return longest_common_substring(pairs, ("doc_id", "item_id")).where(F.octet_length("result") >= seed).select("doc_id", "item_id", F.octet_length("result").alias("size"))
