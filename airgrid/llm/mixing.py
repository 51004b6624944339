"""Mixing sources to target weights: equal-token blocks allotted by highest quotients, taken in a seeded order."""

from __future__ import annotations

import heapq
import itertools
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BLOCK = 64


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; a share above ``repeats`` x its size stops there, the rest is shared again."""
    total, held = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest, weight = total - sum(held.values()), sum(weights[i] for i in free)
        share = {i: rest * weights[i] / weight for i in free} if weight else {}
        above = [i for i in free if share[i] > repeats * sizes[i]]
        if not above:
            return [held.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        held |= {i: float(repeats * sizes[i]) for i in above}


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 taken + 1), nobody above ``most``; equal quotients go to the earlier one.

    Starts from the rounded shares, which highest quotients give up to a few seats, and adds or takes back by quotient.
    """
    total = sum(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    own = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most)]
    missing = seats - sum(own)
    if missing < 0:
        last = [(v / (2 * own[i] - 1), -i) for i, v in enumerate(votes) if own[i]]
        heapq.heapify(last)
        for _ in range(-missing):
            _, i = heapq.heappop(last)
            own[-i] -= 1
            if own[-i]:
                heapq.heappush(last, (votes[-i] / (2 * own[-i] - 1), i))
    else:
        best = [(-v / (2 * own[i] + 1), i) for i, v in enumerate(votes) if own[i] < most[i] and v > 0]
        heapq.heapify(best)
        for _ in range(missing):
            _, i = heapq.heappop(best)
            own[i] += 1
            if own[i] < most[i]:
                heapq.heappush(best, (-votes[i] / (2 * own[i] + 1), i))
    return own


def shard_quotas(votes: list[float], seats: int, most: list[int], shards: int) -> list[list[int]]:
    """Integer quotas of each source for each shard: what a larger house has more than the house before it.

    Highest quotients never take a seat back when the house grows, so no quota is negative, and all add up to the whole.
    """
    houses = [sainte_lague(votes, seats * j // shards, most) for j in range(shards + 1)]
    return [[b - a for a, b in zip(x, y)] for x, y in zip(houses, houses[1:])]


def plan(sources: list[tuple[str | None, int]], block: int = BLOCK, shards: int = 16, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> list[dict]:
    """One row per source: its target, blocks, quota and the quota's part in each shard."""
    order = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [n for _, n in order]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], repeats)
    blocks = [-(-n // block) for n in sizes]
    # A vote is a target in blocks of the source, whose last block is short; the house has as many seats.
    votes = [g / n * b if n else 0.0 for g, n, b in zip(goal, sizes, blocks)]
    quotas = shard_quotas(votes, round(sum(votes)), [repeats * b for b in blocks], shards)
    return [
        {"source": s, "source_size": n, "target": goal[i], "blocks": blocks[i], "quota": sum(q[i] for q in quotas), "shard_quota": [q[i] for q in quotas]}
        for i, (s, n) in enumerate(order)
    ]


PLAN = "source STRING, source_size LONG, target DOUBLE, blocks LONG, quota LONG, shard_quota ARRAY<LONG>"


def mix(
    documents: DataFrame, seed: int = 17, block: int = BLOCK, shards: int = 16, chunks: int = 256, weights: tuple = WEIGHTS, repeats: int = REPEATS,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """All columns of ``documents`` under ``row``, with ``doc_id, size, source_size, target, whole, first_from, first_to, second_from, second_to, taken, shard_quota``.

    ``size`` is the number of words (null text: 0). Sources by code point, null last, weigh ``weights`` in turn and share all
    words; see ``targets``. The documents of a source stand in a seeded order and are cut into blocks of ``block`` words, the
    last of them short. A source's quota of blocks is taken as ``whole`` rounds over all its blocks plus a run of blocks from
    a seeded one on, around the end if need be; so a document is taken whole but at the ends of the run. The words of the last
    round are [first_from, first_to) and [second_from, second_to) of the document, counted from 0; ``taken`` counts all rounds.
    ``shard_quota`` says how many of the source's blocks, in the order taken, go to each shard.

    The plan needs one row per source on the driver. Positions come from two sums: over ``chunks`` hashed parts of a source,
    then inside each part, so no source is one task. Repeated rows are documents of their own, a table without words takes
    nothing, an empty table gives an empty table. Ids may be null.
    """
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows = rows.withColumns({"size": words, "place": F.xxhash64("doc_id", "text", F.lit(seed))}).drop("text")
    # A null source is one like others.
    rows = rows.withColumns({"key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "chunk": F.pmod("place", F.lit(chunks))})
    totals = [(r.source, r.words) for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()]
    spark = documents.sparkSession
    drawn = spark.createDataFrame([tuple(p.values()) for p in plan(totals, block, shards, weights, repeats)], PLAN)
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("key", "chunk").agg(F.sum("size").alias("words")).withColumn("chunk_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(drawn.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "key").drop("words")
    )
    in_chunk = Window.partitionBy("key", "chunk").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.withColumn("in_chunk", F.coalesce(F.sum("size").over(in_chunk), F.lit(0))).join(parts, ["key", "chunk"])
        .withColumn("start", F.col("chunk_start") + F.col("in_chunk"))
    )
    one = F.greatest("blocks", F.lit(1))
    # The run covers the words [run_from, run_to), and [0, run_wrap) if it passes the end.
    run = F.pmod(F.col("quota"), one)
    first = F.pmod(F.xxhash64("key", F.lit(seed)), one)
    inside = lambda low, high: (
        F.least(F.greatest(low - F.col("start"), F.lit(0)), F.col("size")), F.least(F.greatest(high - F.col("start"), F.lit(0)), F.col("size")),
    )
    out = starts.withColumns({
        "whole": F.expr("quota div greatest(blocks, 1)"),
        "run_from": first * block, "run_to": F.least((first + run) * block, F.col("source_size")), "run_wrap": F.greatest(first + run - F.col("blocks"), F.lit(0)) * block,
    })
    a, b = inside(F.col("run_from"), F.col("run_to"))
    c, d = inside(F.lit(0), F.col("run_wrap"))
    out = out.withColumns({"second_from": a, "second_to": F.greatest(a, b), "first_from": c, "first_to": d})
    return out.select(
        "row", "doc_id", "size", "source_size", "target", "whole", "first_from", "first_to", "second_from", "second_to",
        (F.col("whole") * F.col("size") + F.col("first_to") - F.col("first_from") + F.col("second_to") - F.col("second_from")).alias("taken"), "shard_quota",
    )


def cut_words(text: str, first: int, last: int) -> str:
    """The text from the start of word ``first`` to the end of word ``last`` - 1, with the white space between them."""
    ends = [m.span() for m in itertools.islice(re.finditer(WORD, text), last)]
    return text[ends[first][0] : ends[-1][1]]


def take(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``documents``: each document once per time it is taken.

    Where a source's run of blocks ends inside a document, the row has the words taken only, and their number of characters
    in ``n_chars`` if there is such a column. Documents without words are not in the mix.
    """
    text = options.get("text", "text")
    none = F.lit(0).cast("long")
    span = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b")) if isinstance(a, str) else F.struct(a.alias("a"), b.alias("b"))

    @F.pandas_udf("string")
    def cut(texts, first, last):
        import pandas as pd

        return pd.Series([None if t is None else cut_words(t, a, b) for t, a, b in zip(texts, first, last)], dtype=object)

    spans = F.concat(
        F.array_repeat(span(none, F.col("size")), F.col("whole").cast("int")),
        F.filter(F.array(span("first_from", "first_to"), span("second_from", "second_to")), lambda s: s["b"] > s["a"]),
    )
    rows = mix(documents, **options).filter("size > 0").select("row", "size", F.explode(spans).alias("span"))
    part = (F.col("span.a") > 0) | (F.col("span.b") < F.col("size"))
    rows = rows.withColumn("cut", cut(F.when(part, F.col(f"row.`{text}`")), "span.a", "span.b"))
    changed = {text: F.coalesce("cut", f"row.`{text}`"), "n_chars": F.coalesce(F.length("cut").cast("long"), "row.n_chars") if "n_chars" in documents.columns else None}
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
