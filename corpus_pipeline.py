"""Corpus pipeline: toxic documents go, near copies go, repeated passages go, benchmark leaks go, sources are mixed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Edge cases: null and empty texts are not toxic, form one group of near duplicates (the smallest doc_id stays), repeat
nothing, hold no benchmark words and count as size 0 in the mix; rows with equal doc_id but different texts are different
documents, wholly equal rows are copies; a null doc_id comes first; extra columns pass through, but that columns named
size, source_size, target, copies, taken or copy are replaced by the mix's own; an empty table stays empty, empty labels
make nothing toxic and an empty benchmark leaves all documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from strandex.llm.common import read, release, stored


def released(stage):
    """The stage, begun with what the driver held for the one before given back."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return begun


@released
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), keep="clean")


@released
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id."""
    return simhash.survivors(docs)


@released
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus."""
    return suffix_dedup.deduplicate(docs)


@released
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@released
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken (copy counts from 1), with its source's target."""
    out = mixing.mix(docs).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("taken")


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Training a classifier is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
