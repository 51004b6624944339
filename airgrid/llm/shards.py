"""Shards of equal bytes by a histogram sort; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.session import cut_lineage

PROBES = 64  # candidate boundaries a round puts into the gap around each splitter that is not settled
LONGEST = 1 << 61
SLICE_BYTES = 64 << 20


def order_value(text: Column) -> Column:
    """A place on the line 0 .. 2**62 that depends on the text only, so that equal texts are neighbours."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2)


class Gap:
    """Keys (place, id) from ``low`` up to ``high``, where splitters with byte goals above ``below`` still have to be found."""

    def __init__(self, low: tuple[int, int], high: tuple[int, int], below: int, goals: list[int]):
        self.low, self.high, self.below, self.goals = low, high, below, goals
        # While several places are left they are divided, then the ids of the one place.
        self.by_id = low[0] == high[0]
        first, last = (low[1], high[1]) if self.by_id else (low[0], high[0])
        self.first, self.width = first, max(1, -(-(last - first + 1) // PROBES))


def histogram(keys: DataFrame, gaps: list[Gap]) -> list[tuple[int, int, int, tuple, tuple]]:
    """Exact bytes, smallest and largest key of each stretch between neighbouring candidates: (gap, stretch, bytes, min, max)."""
    inside = [f"(place > {g.low[0]} OR place = {g.low[0]} AND doc_id >= {g.low[1]}) AND (place < {g.high[0]} OR place = {g.high[0]} AND doc_id <= {g.high[1]})" for g in gaps]
    value = ["doc_id" if g.by_id else "place" for g in gaps]
    which = " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(inside))
    stretch = " ".join(f"WHEN {i} THEN ({v} - ({g.first})) div {g.width}" for i, (g, v) in enumerate(zip(gaps, value)))
    key = F.struct("place", "doc_id")
    rows = (
        keys.withColumn("gap", F.expr(f"CASE {which} END")).filter("gap IS NOT NULL").withColumn("stretch", F.expr(f"CASE gap {stretch} END"))
        .groupBy("gap", "stretch").agg(F.sum("size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"))
    )
    return sorted((r.gap, r.stretch, r.bytes, tuple(r.low), tuple(r.high)) for r in rows.collect())


def splitters(keys: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """The largest key of each part but the last, so that parts differ from equal bytes by at most ``tolerance`` of a part; and all bytes.

    Equal texts (one place) stay together: the boundary goes to the nearer end of their group, unless it holds more bytes than a part.

    Each round counts the exact bytes between candidate boundaries over all rows in one aggregate and puts new candidates only
    around the goals that no boundary meets. A round leaves at most ``PROBES`` rows per open goal for the driver, whatever the
    size of the table. Where one key (rows that equal in text and id) holds more than a part, the boundary stands behind it.
    """
    ends = keys.agg(F.min(F.struct("place", "doc_id")).alias("low"), F.max(F.struct("place", "doc_id")).alias("high"), F.sum("size").alias("bytes")).first()
    if ends.bytes is None:
        return [], 0
    goals = [round(ends.bytes * i / parts) for i in range(1, parts)]
    slack = max(1.0, tolerance * ends.bytes / parts)
    found: dict[int, tuple[int, int]] = {}
    gaps = [Gap(tuple(ends.low), tuple(ends.high), 0, goals)]
    while gaps:
        counts, following = histogram(keys, gaps), []
        for i, gap in enumerate(gaps):
            total, open_goals = gap.below, list(gap.goals)
            before = None
            for _, _, size, low, high in (c for c in counts if c[0] == i):
                inside = [g for g in open_goals if total < g <= total + size]
                rest = []
                for g in inside:
                    together = low == high or low[0] == high[0] and not gap.by_id and size <= ends.bytes / parts
                    if abs(total + size - g) <= slack or together and (total + size - g <= g - total or before is None):
                        found[g] = high
                    elif before is not None and (g - total <= slack or together):
                        found[g] = before
                    else:
                        rest.append(g)
                if rest:
                    following.append(Gap(low, high, total, rest))
                total, before = total + size, high
        gaps = following
    return sorted(found.get(g, (-1, 0)) for g in goals), ends.bytes  # a goal of no bytes is met before the first key


def shard(documents: DataFrame, shards: int = 16, slices: int | None = None, tolerance: float = 0.002, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, size, shard, slot`` for each row of ``documents``: near equal bytes in every shard.

    ``size``: UTF-8 bytes of the text plus 1; a null text counts as empty and stays null. Rows are ordered by a hash of their
    text, then by id: copies of a text lie in one shard, and only a group of copies larger than a shard is divided, by id.
    Rows that equal in text and id cannot be parted. ``slot`` counts from 0 without gaps, in no given order. Each shard is
    exchanged in ``slices`` tasks, over which its rows are dealt evenly; by default as many as the shuffle partitions ask for, and
    so many that a task has about ``SLICE_BYTES``. An empty table gives an empty table; other columns are not read.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    # Ids that are null stand before all others; differences between ids have to fit into a long.
    id_key = F.greatest(F.least(F.coalesce("doc_id", F.lit(-LONGEST)), F.lit(LONGEST - 1)), F.lit(-LONGEST))
    key = {"place": order_value(F.col("text")), "id_key": id_key, "size": size}
    keyed = rows.withColumns(key)
    keys = cut_lineage(keyed.select("place", F.col("id_key").alias("doc_id"), "size"))
    cuts, total = splitters(keys, shards, tolerance)
    if slices is None:
        asked = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = max(4, -(-asked // shards), -(-total // (shards * SLICE_BYTES)))
    bounds = ", ".join(f"named_struct('place', {p}L, 'id_key', {d}L)" for p, d in cuts)
    shard_of = F.expr(f"size(filter(array({bounds}), b -> b < named_struct('place', place, 'id_key', id_key)))" if cuts else "0")
    piece = shard_of * slices + F.pmod(F.xxhash64("place", "id_key"), F.lit(slices))
    in_order = Window.partitionBy("piece").orderBy("place", "id_key")
    placed = keyed.withColumn("piece", piece)
    before = (  # one row per slice
        placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.expr(f"piece div {slices}"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("piece", "before")
    )
    return (
        placed.withColumn("rank", F.row_number().over(in_order)).join(before, "piece")
        .select("doc_id", "text", "size", F.expr(f"CAST(piece div {slices} AS INT)").alias("shard"), (F.col("before") + F.col("rank") - 1).alias("slot"))
    )
