"""The corpus pipeline: from raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; between stages the documents are written as Parquet and read back.

1. quality: the weak-label classifier's rejects go.
2. near_duplicates: of documents that share four fifths or more of their 5-word
   shingles (Jaccard), and chains of them, one stays: links by SimHash, checked
   exactly, then those that fingerprints are too coarse for.
3. decontamination: documents with a benchmark window go.
4. mixing: sources in target proportions; a document that is taken for several
   epochs is there as often.
5. sharding: eight shards of near-equal bytes; copies of a text stay together.

No SQL expresses the classifier, the near copies' classes or the suffix
arrays, so ORACLE_SQL is None; tests hold each stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import decontaminate, mixing, quality, shards, simhash
from pelagia.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all of them, keeps."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, in the proportions of mixing.WEIGHTS; a row per epoch."""
    mixed = mixing.mix(
        docs, [mixing.domain(), F.col("lang"), F.col("source")], mixing.words("text"), mixing.WEIGHTS,
        max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED,
        narrow=written(mixing.narrowed(docs, [mixing.domain(), F.col("lang"), F.col("source")], mixing.words("text")), "narrow"),
    )
    return mixed.withColumn("epochs", F.explode(F.sequence(F.lit(1), "epochs"))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and slot for each row."""
    return shards.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
