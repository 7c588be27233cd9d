"""A corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing.

STAGES holds (name, function of (spark, docs, sf_dir)); each works on all that the one before it kept. run() writes each
stage's rows to the shared folder and rereads them, so a lost executor costs a reread. All but the last return the
columns they are given, whatever their names.

Defined cases, in every stage: null text is the empty text; very long texts are read whole; an empty table gives an empty one; ties
go by id as each stage says. Rows that repeat an id but not the text are documents of their own; of rows that repeat both, exact
dedup keeps one. Rows without an id are scored and deduplicated like others: exact dedup keeps them only where all equal texts have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact, mixing, nearjoin, packing, quality
from siltstone.llm.common import materialise
from siltstone.llm.tokens import vocabulary

#: SQL can't run the trained classifier; the stages are tested against plain Python instead.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id stays."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more; of each group the smallest id stays. Texts without words stay."""
    return nearjoin.keep_first(docs, percent=80, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a take counts if it is at least half the words), in order of position. Documents
    without words are never taken."""
    return mixing.sequence(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), kind="byte", end_id=2, capacity=1024)


STAGES = [("quality", good_quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
