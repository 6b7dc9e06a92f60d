"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import shared_dir

#: Bytes of text that a numpy kernel handles at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    trim_jvm(df.sparkSession)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; for tables that several jobs read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_jvm(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_jvm(spark: SparkSession) -> bool:
    """Has the driver's JVM give the native memory back that its threads have freed; whether it can (from JDK 17.0.9 on, with glibc).

    Freed memory stays in the arenas of malloc, one for a thread or a few, which no garbage collection returns.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        types = array(jvm.Class, *map(jvm.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        # By the interface, as the server's own class is closed to reflection.
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(server, array(jvm.Object, name, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))
    except Py4JError:
        return False
    return True


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and plans of jobs whose frames are gone, and gives the driver's unused memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as bytes and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [i, j) of at most `limit` bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] numbers), then those from starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


def numbered(df: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """df with `number`, each row's place from 1 in the order of `by`, and of each sum {name: column} what comes before it.

    Rows are sorted in ranges; only the ranges' totals (a row a partition) meet in one task.
    """
    zero = F.lit(0).cast("long")
    parts = stored(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    within = W.partitionBy("part").orderBy(*by)
    ahead = within.rowsBetween(W.unboundedPreceding, -1)
    own = parts.withColumns({"number": F.row_number().over(within).cast("long"), **{n: F.coalesce(F.sum(c).over(ahead), zero) for n, c in sums.items()}})
    totals = parts.groupBy("part").agg(F.count(F.lit(1)).alias("number"), *[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    names = ["number", *sums]
    totals = totals.select("part", *[F.coalesce(F.sum(n).over(before), zero).alias(f"{n} before") for n in names])
    both = own.join(F.broadcast(totals), "part")
    return both.select(*df.columns, *[(F.col(n) + F.col(f"{n} before")).alias(n) for n in names])


def placed_within(df: DataFrame, group: list[str], by: list[str], name: str) -> DataFrame:
    """df with the place of each row in its group (columns that are never null), from 0 in the order of `by`.

    Rows are sorted in ranges, so a large group lies in many tasks.  Each range continues one group at most that began
    before it: only for these is what lies ahead handed on.
    """
    parts = stored(df.repartitionByRange(*group, *by).withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part", *group).agg(F.count(F.lit(1)).alias("c"))
    ahead = F.sum("c").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    begun = counts.withColumn("ahead", ahead).where("ahead > 0").select("part", *group, "ahead")
    own = F.row_number().over(W.partitionBy("part", *group).orderBy(*by)) - 1
    return parts.withColumn("own", own).join(F.broadcast(begun), ["part", *group], "left").withColumn(name, (F.col("own") + F.coalesce("ahead", F.lit(0))).cast("long")).drop("part", "own", "ahead")
