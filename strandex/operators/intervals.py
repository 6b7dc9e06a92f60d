"""The lcp-interval tree (the inner nodes of the suffix tree) as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import suffixes
from .apply import per_text


def _nodes(text: bytes):
    """(node, parent, lcp, lb, rb, leaf) bottom-up, inner nodes first, then leaves with the text's rest as lcp."""
    sa, lcp = suffixes.suffix_array(text)
    inner = suffixes.intervals(lcp)
    parent, stack = [-1] * len(inner), []
    for k, (_, lb, rb) in enumerate(inner):
        while stack and inner[stack[-1]][1] >= lb and inner[stack[-1]][2] <= rb:
            parent[stack.pop()] = k
        stack.append(k)
    # A leaf hangs on the smallest inner node around it: the last one to claim its rank.
    owner = [-1] * len(sa)
    for k, (_, lb, rb) in enumerate(inner):
        i = lb
        while i <= rb:
            if owner[i] < 0:
                owner[i] = k
                i += 1
            else:
                i = max(i + 1, inner[owner[i]][2] + 1)
    out = [(k, parent[k] if parent[k] >= 0 else None, v, lb, rb, False) for k, (v, lb, rb) in enumerate(inner)]
    return out + [(len(inner) + i, owner[i], len(sa) - int(p), i, i, True) for i, p in enumerate(sa.tolist())]


_NODE = "node_id int, parent_id int, lcp int, lb int, rb int, is_leaf boolean"


def tree(texts: DataFrame) -> DataFrame:
    """Every node: doc_id, node_id, parent_id, lcp, lb, rb, is_leaf. A leaf's lcp is the length of its suffix."""
    return per_text(texts, _nodes, _NODE)


def _numbered(nodes: DataFrame, *order) -> DataFrame:
    return nodes.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1)


def postorder(nodes: DataFrame) -> DataFrame:
    """Inner nodes bottom-up, the root (lcp 0) last: doc_id, ord, lcp, lb, rb and the inner children (lb, rb, node_id) from left to right."""
    inner = nodes.where(~F.col("is_leaf"))
    below = inner.where(F.col("parent_id").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("lb", "rb", "node_id"))).alias("children"))
    both = inner.join(below, ["doc_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<struct<lb:int,rb:int,node_id:int>>")))
    return _numbered(both, F.asc("rb"), F.desc("lb")).select("doc_id", "ord", "node_id", "lcp", "lb", "rb", "children")


def preorder(nodes: DataFrame) -> DataFrame:
    """All nodes top-down, children from left to right, leaves too: doc_id, ord, lcp, lb, rb."""
    n = F.max("rb").over(W.partitionBy("doc_id")) + 1
    lcp = F.when(F.col("is_leaf"), n).otherwise(F.col("lcp"))
    return _numbered(nodes, F.asc("lb"), F.desc("rb"), F.asc("is_leaf")).select("doc_id", "ord", lcp.alias("lcp"), "lb", "rb")


def children(index: DataFrame, left: int = 0, right: int | None = None, depth: bool = False) -> DataFrame:
    """Child intervals (doc_id, lcp, lb, rb) of the rank range left..right, in SQL: it falls apart where lcp is smallest.

    A single suffix has the text's length as lcp; a range of one rank has no children.  With depth also the length that
    all suffixes of the range share, at which the children part.
    """
    n = F.max("rank").over(W.partitionBy("doc_id")) + 1
    inside = index.select("doc_id", "rank", "lcp", n.alias("n"))
    inside = inside.where((F.col("rank") >= left) & (F.col("rank") <= (F.lit(right) if right is not None else F.col("n") - 1)))
    whole = W.partitionBy("doc_id")
    cut = F.min(F.when(F.col("rank") > left, F.col("lcp"))).over(whole)
    begins = (F.col("rank") == left) | (F.col("lcp") == F.col("cut"))
    island = F.sum(begins.cast("int")).over(whole.orderBy("rank"))
    marked = inside.withColumn("cut", cut).where("cut IS NOT NULL").withColumns({"island": island, "starts": begins})
    each = marked.groupBy("doc_id", "island").agg(F.min("rank").alias("lb"), F.max("rank").alias("rb"), F.min(F.when(~F.col("starts"), F.col("lcp"))).alias("inner"), F.max("n").alias("n"), F.max("cut").alias("depth"))
    return each.select("doc_id", F.coalesce("inner", "n").cast("int").alias("lcp"), "lb", "rb", *(["depth"] if depth else []))


def shown(lcp, lb, rb):
    """An interval as text."""
    return F.format_string("CI(lcp=%d, lb=%d, rb=%d)", lcp, lb, rb)
