"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, sources are mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airgrid.llm import mixing, packing, stages
from airgrid.llm.queries import tokenizer
from airgrid.session import configure, cut_lineage

# Scores, Jaccard groups and token ids have no SQL; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def ready(spark: SparkSession) -> SparkSession:
    """Texts may be long, so Python gets fewer of them at a time; a worker then holds a few MB of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return configure(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_toxic(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return stages.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of the packed mix; every stage but the last is written."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
