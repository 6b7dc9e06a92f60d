"""Texts as DataFrames (doc_id, text BINARY): from any table, doubled, reversed, paired; and the persisted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and the text's bytes; strings become UTF-8. Null texts stay null and give no rows later."""
    kind = df.schema[text].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), (F.col(text) if kind == "binary" else F.encode(F.col(text), "UTF-8")).alias("text"))


def read_texts(spark: SparkSession, path: str, doc_id: str, text: str, format: str = "parquet", **options) -> DataFrame:
    return texts(spark.read.format(format).options(**options).load(path), doc_id, text)


def doubled(t: DataFrame) -> DataFrame:
    """text followed by itself, the source of rotations."""
    return t.select("doc_id", F.concat("text", "text").alias("text"))


def reversed_bytes(t: DataFrame) -> DataFrame:
    """The bytes in reverse order (not the characters)."""
    pairs = F.regexp_extract_all(F.hex("text"), F.lit("(..)"), F.lit(1))
    return t.select("doc_id", F.unhex(F.array_join(F.reverse(pairs), "")).alias("text"))


def two_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both texts of each pair as rows (doc_id, side, text); no delimiter is needed."""
    return a.select("doc_id", F.lit(0).alias("side"), "text").unionByName(b.select("doc_id", F.lit(1).alias("side"), "text"))


def write_index(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Saves an index bucketed and sorted by doc_id, so that later joins and windows on it need no shuffle."""
    index.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id", "rank").format("parquet").saveAsTable(table)


def read_index(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def write_heads(heads: DataFrame, path: str) -> None:
    """Saves an index with heads (operators.index.with_heads) in ranges of `head`, so that a search reads few row groups."""
    heads.repartitionByRange("head").sortWithinPartitions("head").write.parquet(path)
