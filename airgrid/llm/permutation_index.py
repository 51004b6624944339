"""Nearest neighbours by inner product through a permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.cover_join import usable
from airgrid.session import cut_lineage

PIVOTS, ORDERED = 256, 64  # pivots, and how many of them a vector is described by, nearest first
SHARD = 8192  # rows of a shard, expected
QUERIES = 2048  # queries of a block, expected
SHARE, PER_RESULT = 0.12, 8  # a shard reranks this share of its distinct vectors, and so many more per wanted result
SAMPLE = 4096  # rows that the pivots are chosen from


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component gives all vectors the same length, so the nearest is the one of the largest inner product."""
    rest = np.sqrt(np.maximum(0.0, longest * longest - np.einsum("ij,ij->i", x, x)))
    return np.hstack([x, rest[:, None]])


def choose_pivots(sample: np.ndarray, size: int, longest: float) -> np.ndarray:
    """Rows of the sample, filled up by fixed random directions if there are too few."""
    rows = lifted(sample.reshape(-1, size), longest)[:PIVOTS]
    random = np.random.default_rng(size).normal(size=(PIVOTS - len(rows), size + 1))
    pivots = np.vstack([rows, random])
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :ORDERED]


def build_shard(ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, longest: float, copies: int) -> dict[str, bytes]:
    """Distinct vectors, the smallest ``copies`` ids of each, and the inverted file of each pivot: rows and ranks."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
    by_vector = np.argsort(which.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(which.ravel(), minlength=len(first)))
    starts = np.concatenate([[0], ends[:-1]])
    kept = np.concatenate([by_vector[a : min(b, a + copies)] for a, b in zip(starts, ends)])
    number = np.minimum(ends - starts, copies)
    vectors = x[first]
    near = nearest_pivots(lifted(vectors, longest), pivots)
    by_pivot = np.argsort(near.ravel(), kind="stable")
    lengths = np.bincount(near.ravel(), minlength=PIVOTS)
    return {
        "ids": ids[kept].astype("<i8").tobytes(), "number": number.astype("<i4").tobytes(), "vectors": vectors.astype("<f8").tobytes(),
        "lengths": lengths.astype("<i4").tobytes(), "rows": (by_pivot // ORDERED).astype("<i4").tobytes(), "ranks": (by_pivot % ORDERED).astype("<i2").tobytes(),
    }


class Shard:
    def __init__(self, size: int, ids: bytes, number: bytes, vectors: bytes, lengths: bytes, rows: bytes, ranks: bytes):
        self.ids, number = np.frombuffer(ids, "<i8"), np.frombuffer(number, "<i4")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, size)
        self.ends = np.cumsum(number)
        self.starts = self.ends - number
        cuts = np.cumsum(np.frombuffer(lengths, "<i4"))[:-1]
        self.files = list(zip(np.split(np.frombuffer(rows, "<i4"), cuts), np.split(np.frombuffer(ranks, "<i2"), cuts)))
        self.least_id = self.ids[self.starts]

    def search(self, query: np.ndarray, pivots_in_order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best ids and scores among the vectors with the smallest footrule distance, ties to the smaller id; and
        which of them are the query's own vector."""
        n = len(self.vectors)
        budget = int(np.ceil(SHARE * n)) + PER_RESULT * k
        if n > budget:
            # Places are 0 .. ORDERED - 1, and ORDERED for a pivot that is not named: the footrule distance is a constant
            # less twice this sum over the pivots that both name.
            gain = np.zeros(n, "int32")
            for place, pivot in enumerate(pivots_in_order):
                rows, ranks = self.files[pivot]
                gain[rows] += ORDERED - np.maximum(ranks, place)
            level = np.partition(gain, n - budget)[n - budget]
            some = np.flatnonzero(gain > level)
            edge = np.flatnonzero(gain == level)
            some = np.concatenate([some, edge[np.argsort(self.least_id[edge])[: budget - len(some)]]])
        else:
            some = np.arange(n)
        score = self.vectors[some] @ query
        if len(some) > k:
            level = np.partition(score, len(score) - k)[len(score) - k]
            some, score = some[score >= level], score[score >= level]
        ids = np.concatenate([self.ids[a:b] for a, b in zip(self.starts[some], self.ends[some])])
        number = self.ends[some] - self.starts[some]
        score, own = np.repeat(score, number), np.repeat((self.vectors[some] == query).all(axis=1), number)
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best], own[best]


INDEX = "size INT, shard INT, ids BINARY, number BINARY, vectors BINARY, lengths BINARY, rows BINARY, ranks BINARY"


class Index:
    """Shards, each with the inverted files of all pivots for its rows; ``pivots`` and ``longest`` by number of components."""

    def __init__(self, rows: DataFrame, copies: int):
        spark = rows.sparkSession
        lengths = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)).alias("squared")).collect()
        sample = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "mark").limit(SAMPLE).select("size", "vector").collect()
        self.pivots, self.longest = {}, {}
        for r in lengths:
            self.longest[r.size] = float(np.sqrt(r.squared))
            self.pivots[r.size] = choose_pivots(np.array([s.vector for s in sample if s.size == r.size]), r.size, self.longest[r.size])
        self.shard_count = {r.size: -(-r.n // SHARD) for r in lengths}
        sent = spark.sparkContext.broadcast((self.pivots, self.longest))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pivots, longest = sent.value
            size = int(pdf["size"].iloc[0])
            parts = build_shard(pdf.vec_id.to_numpy(), np.stack(pdf.vector.to_numpy()).astype("float64"), pivots[size], longest[size], copies)
            return pd.DataFrame([{"size": size, "shard": int(pdf["shard"].iloc[0])} | parts])

        counts = spark.createDataFrame(list(self.shard_count.items()) or [(0, 1)], "size INT, shards INT")
        dealt = rows.join(counts, "size").withColumn("shard", F.pmod(F.xxhash64("vec_id", "mark"), F.col("shards")).cast("int"))
        self.shards = cut_lineage(dealt.select("size", "shard", "vec_id", "vector").groupBy("size", "shard").applyInPandas(build, INDEX))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, rank, vec_id, score`` for rows (vec_id, size, vector): blocks of queries meet every shard of their size."""
        spark = queries.sparkSession
        sent = spark.sparkContext.broadcast((self.pivots, self.longest))

        def gather(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf.vector.to_numpy()).astype("<f8")
            return pd.DataFrame([{"size": int(pdf["size"].iloc[0]), "block": int(pdf["block"].iloc[0]), "query_ids": pdf.vec_id.to_numpy().astype("<i8").tobytes(), "marks": pdf.mark.to_numpy().astype("<i8").tobytes(), "queries": x.tobytes()}])

        def find(batches):
            names = ["size", "query_ids", "marks", "queries", "ids", "number", "vectors", "lengths", "rows", "ranks"]
            for batch in batches:
                for r in range(len(batch)):
                    row = {n: batch.column(i)[r].as_py() for i, n in enumerate(names)}
                    size, ids, marks, x = row.pop("size"), *(np.frombuffer(row.pop(c), kind) for c, kind in (("query_ids", "<i8"), ("marks", "<i8"), ("queries", "<f8")))
                    shard = Shard(size, **row)
                    distinct, which = np.unique(x.reshape(-1, size), axis=0, return_inverse=True)
                    # A query has no lifted component: it is nearest to what it has the largest inner product with.
                    orders = nearest_pivots(np.hstack([distinct, np.zeros((len(distinct), 1))]), sent.value[0][size])
                    found = [shard.search(v, o, k + 1) for v, o in zip(distinct, orders)]
                    which = which.ravel()
                    # Only what another query of the same vector still needs: one more than k, as its own row does not count.
                    rows = [found[w] for w in which]
                    n = [len(f[0]) for f in rows]
                    query = np.repeat(ids, n)
                    vec = np.concatenate([f[0] for f in rows]) if rows else np.zeros(0, "int64")
                    score = np.concatenate([f[1] for f in rows]) if rows else np.zeros(0)
                    own = np.concatenate([f[2] for f in rows]) if rows else np.zeros(0, bool)
                    other = (query != vec) | ~own
                    mark = np.repeat(marks, n)
                    yield pa.RecordBatch.from_arrays([pa.array(query[other]), pa.array(mark[other]), pa.array(vec[other]), pa.array(score[other])], names=["query_id", "mark", "vec_id", "score"])

        totals = spark.createDataFrame(list(self.shard_count.items()) or [(0, 1)], "size INT, shards INT")
        blocks = max(1, -(-queries.count() // QUERIES))
        packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("size", "block").applyInPandas(gather, "size INT, block INT, query_ids BINARY, marks BINARY, queries BINARY")
        visits = packed.join(totals, "size").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(self.shards, ["size", "shard"])
        tasks = visits.select("size", "query_ids", "marks", "queries", "ids", "number", "vectors", "lengths", "rows", "ranks", "shard", "block").repartition("size", "shard", "block").drop("shard", "block")
        near = tasks.mapInArrow(find, "query_id LONG, mark LONG, vec_id LONG, score DOUBLE")
        best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner product found for each query row.

    The score is the inner product in double precision; the nearest comes first, ties to the smaller id, a query's own row does
    not count. Rows of one id with different vectors are rows of their own, as queries too, each with its ranks; rows that equal
    in id and vector are one. Vectors that are null, zero or hold a null or a number that is not finite, and rows without an id, take no
    part; vectors meet only vectors with as many components. With fewer than ``k``
    candidates all are returned; an empty table gives an empty table.

    The pivots come from ``SAMPLE`` rows chosen by a hash; every row is indexed, in shards of about ``SHARD`` rows. A shard
    ranks all its rows by the footrule distance of the ordered pivots, summed over the inverted files of the query's pivots,
    and compares the nearest ``SHARE`` of them, and ``PER_RESULT`` for each wanted result, exactly; shards of all sizes are handled alike. Equal vectors are compared once. Blocks of queries visit shards as
    tasks of their own, and a task returns at most k + 1 rows per query.
    """
    rows = lambda df: (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & usable("vector")).distinct().withColumns({"size": F.size("vector"), "mark": F.xxhash64("vector")})
    )
    known = cut_lineage(rows(vectors))
    return Index(known, k + 1).search(cut_lineage(rows(queries)), k)
