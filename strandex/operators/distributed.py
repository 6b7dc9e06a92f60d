"""Suffix order of texts that are too long for one worker: prefix doubling in DataFrames.

Every suffix is a row with the rank of its first `depth` bytes (the number of suffixes that are smaller in them).  A round
joins each row whose rank is shared with the rank `depth` bytes on, sorts the pairs and doubles the depth; rows alone at
their rank are done.  Numbers of smaller rows come from a range-partitioned sort: each partition counts its own rows,
and adds what lies in the partitions before it, so no text and no rank is held by a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed

FIRST = 8  # bytes that the first sort takes


def _smaller(groups: DataFrame, *order: str) -> DataFrame:
    """groups(order..., c) with `below`: the sum of c over all rows that sort before."""
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in (*order, "c")) + ", local long, part int"

    def run(batches):
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            c = b.column("c").to_numpy()
            upto = np.cumsum(c) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - c), pa.array(np.full(len(c), part, np.int32))], [*b.schema.names, "local", "part"])
            total = int(upto[-1]) if len(c) else total

    dealt = groups.select(*order, "c").repartitionByRange(*order).sortWithinPartitions(*order)
    counted = checkpointed(dealt.mapInArrow(run, schema))
    sums = counted.groupBy("part").agg(F.sum("c").alias("s"))  # a row for each partition
    ahead = sums.select("part", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return counted.join(F.broadcast(ahead), "part").select(*order, "c", (F.col("local") + F.col("ahead")).alias("below"))


def suffix_array_distributed(texts: DataFrame) -> DataFrame:
    """doc_id, rank, pos of every suffix. texts: doc_id, text BINARY; null and empty texts give no rows."""
    there = texts.where(F.octet_length("text") > 0).withColumn("n", F.octet_length("text"))
    rows = there.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    keyed = rows.select("doc_id", "pos", F.expr(f"substring(text, pos + 1, {FIRST})").alias("key"))
    groups = _smaller(keyed.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")), "doc_id", "key")
    state = checkpointed(keyed.join(groups, ["doc_id", "key"]).select("doc_id", "pos", F.col("below").alias("rank"), (F.col("c") > 1).alias("open")))
    depth = FIRST
    while not state.where("open").isEmpty():
        on = state.select("doc_id", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("next"))
        pairs = checkpointed(state.where("open").join(on, ["doc_id", "pos"], "left").select("doc_id", "pos", "rank", F.coalesce("next", F.lit(-1).cast("long")).alias("next")))
        groups = _smaller(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("c")), "rank", "next")
        start = groups.groupBy("rank").agg(F.min("below").alias("start"))
        moved = groups.join(start, "rank").select("rank", "next", (F.col("rank") + F.col("below") - F.col("start")).alias("to"), (F.col("c") > 1).alias("open"))
        fresh = pairs.join(moved, ["rank", "next"]).select("doc_id", "pos", F.col("to").alias("rank"), "open")
        state = checkpointed(state.where("NOT open").union(fresh))
        depth *= 2
    first = state.groupBy("doc_id").agg(F.min("rank").alias("first"))
    return state.join(first, "doc_id").select("doc_id", (F.col("rank") - F.col("first")).cast("int").alias("rank"), "pos")
