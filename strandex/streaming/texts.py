"""The per-text operators on streams: they keep no state, so a stream of texts runs through the same maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, repeats, search, strings
from ..sources.texts import texts


def read_stream(spark: SparkSession, path: str, schema: str, doc_id: str, text: str, format: str = "parquet", **options) -> DataFrame:
    """A stream of texts from files that arrive in a folder."""
    return texts(spark.readStream.format(format).schema(schema).options(**options).load(path), doc_id, text)


def stream_index(stream: DataFrame) -> DataFrame:
    return index.index_kernel(stream)


def stream_find(stream: DataFrame, query: str | bytes) -> DataFrame:
    return search.find(stream, query)


def stream_tandem_repeats(stream: DataFrame) -> DataFrame:
    return repeats.tandem_repeats(stream)


def stream_lz_factors(stream: DataFrame) -> DataFrame:
    return strings.lz_factors(stream)


def stream_rotations(stream: DataFrame) -> DataFrame:
    return strings.minimum_rotation(stream)


def stream_palindromes(stream: DataFrame) -> DataFrame:
    return strings.longest_palindrome(stream)


def stream_occ(stream: DataFrame, query: str) -> DataFrame:
    """doc_id, occ: the text's bytes are read as UTF-8."""
    return stream.select("doc_id", search.occ(F.decode("text", "UTF-8"), query).alias("occ"))
