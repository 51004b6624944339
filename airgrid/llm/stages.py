"""Operators as steps that turn documents into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm import ngram_join, toxicity
from airgrid.session import cut_lineage

SMALL_IDS = 2_000_000  # a list of ids goes to every executor up to this many (16 MB)


def listed(ids: DataFrame) -> DataFrame:
    """The list, marked to be sent to all executors if it was counted and is small."""
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model learned from ``labels`` does not call toxic.

    Null and empty texts have no terms and stay, as do rows without an id; repeated rows go or stay alike; without labels
    nothing is known to be toxic and all stay. All columns are kept.
    """
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.filter("predicted = 0").select("row.*")


def without_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (of one id: the smallest hash of the text); documents
    without words or id stay. A repeated row is a copy too.

    Only the rows that go are listed, by id and hash, so the texts are not shuffled while that list is small.
    """
    found = cut_lineage(ngram_join.grouped(documents).filter("component IS NOT NULL"))
    row = F.struct("doc_id", "mark")
    first = found.groupBy("component").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = cut_lineage(found.join(first.select("component", "first"), "component").groupBy("doc_id", "mark").agg(F.max(row == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("n")))
    own = documents.withColumns({"_id": F.col("doc_id").cast("long"), "_mark": F.xxhash64("text")})
    name = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    gone = listed(cut_lineage(name(several.filter("NOT stays"))))
    twice = listed(cut_lineage(name(several.filter("stays AND n > 1"))))
    stay = own.join(gone, ["_id", "_mark"], "left_anti")
    once = stay.join(twice, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])
    names = [f"`{c}`" for c in documents.columns]
    return stay.join(twice, ["_id", "_mark"], "left_anti").select(names).unionByName(once.select(names))
