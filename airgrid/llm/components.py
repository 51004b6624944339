"""Connected components of links between ids, as Spark jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.session import cut_lineage

LOCAL_LINKS = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that connect what the given links connect; at most one per node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for end in (x, y):  # the roots of both ends get the smaller root, then paths are halved
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def thin(batches):
    """Replaces the links of a task, some at a time, by a forest with the same components."""
    a, b = np.zeros(0, "int64"), np.zeros(0, "int64")
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) >= LOCAL_LINKS:
            a, b = forest(a, b)
            if len(a) >= LOCAL_LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["hi", "lo"])
                a, b = a[:0], b[:0]
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["hi", "lo"])


def star(links: DataFrame) -> DataFrame:
    """Every node moves to the smallest of its neighbours: first from its larger ones, then from its smaller ones."""
    both = links.select("hi", "lo").union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi")).agg(F.min("lo").alias("least")).select("hi", F.least("hi", "least").alias("least"))
    large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).filter("hi <> lo").distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("least"))
    small = large.join(low, "hi").filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return small.union(low.select("hi", F.col("least").alias("lo"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links`` (two LONG columns, no nulls); ``component`` is the smallest node reachable.

    Links inside a task are first replaced by a forest, so a dense group costs a link per node and task; then stars are merged
    until no node is both the centre of one and a member of another, in a number of rounds that grows with the logarithm of
    the longest path. Each round is written to the shared folder. Links from a node to itself give it its own component.
    """
    ends = links.select(F.col(a).cast("long").alias("hi"), F.col(b).cast("long").alias("lo"))
    edges = cut_lineage(ends.mapInArrow(thin, "hi LONG, lo LONG"))
    edges = cut_lineage(edges.repartition("hi").mapInArrow(thin, "hi LONG, lo LONG"))
    while edges.join(edges.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count() or edges.groupBy("hi").count().filter("count > 1").limit(1).count():
        edges = cut_lineage(star(edges))
    nodes = ends.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    return nodes.join(edges.withColumnRenamed("hi", "node"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))
