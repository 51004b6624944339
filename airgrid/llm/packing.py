"""Best-fit packing of token sequences, planned over the histogram of lengths."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.batches import small
from airgrid.llm.tokens import word_ids
from airgrid.session import cut_lineage

CAPACITY = 2048
SMALL_ROWS = 500_000  # a table of three numbers a row goes to every executor up to this many rows (12 MB)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: segments (length, first rank, count, first sequence, items per sequence, offset), and the number of sequences.

    Sequences with equal room and neighbouring numbers form a range. The items of one length go to the fullest range that has
    room for them; its sequences are then filled one after the other, as the one just begun is the fullest. The work depends
    on the number of different lengths, not on the counts.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    segments, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = next((r for r in range(length, capacity + 1) if room[r]), None)
            if fit is None:
                fit, bins = capacity, -(-left // (capacity // length))
                room[capacity].append((sequences, bins))
                sequences += bins
            first, bins = room[fit].pop()
            each = min(fit // length, left)
            filled = min(bins, left // each)
            segments.append((length, rank, filled * each, first, each, capacity - fit))
            room[fit - each * length].append((first, filled))
            if filled < bins:
                room[fit].append((first + filled, bins - filled))
            rank, left = rank + filled * each, left - filled * each
    return segments, sequences


PIECES = "doc_id LONG, piece INT, start LONG, length INT, part INT, rank LONG, ids BINARY"


def pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str, text: str) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, numbered within (part, length). The ids take two bytes each if they fit."""

    def cut(batches):
        from pyspark import TaskContext

        encoder, part, ranks = word_ids(tokenizer, True), TaskContext.get().partitionId(), Counter()
        narrow = encoder.vocabulary <= 1 << 16
        kind = "<u2" if narrow else "<u4"
        for batch in small(batches):
            rows = []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoder.tokens(words.as_py()), end_id], kind)
                first = (len(ids) - 1) % capacity + 1
                ends = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(ends, ends[1:])):
                    own = ids[a:b]
                    rows.append((key, piece, a, b - a, part, ranks[b - a], own.tobytes()))
                    ranks[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, TYPES)], names=NAMES)

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


NAMES = ["doc_id", "piece", "start", "length", "part", "rank", "ids"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
PACKED = "doc_id LONG, piece INT, start LONG, length LONG, ids BINARY, sequence_id LONG, offset LONG"


def pack(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: every document's ids, packed into sequences of at most ``capacity``.

    The ids of a document (null text: none) are those of the tokenizer plus ``end_id``, as unsigned little-endian 32-bit
    integers. Longer documents are cut into full pieces, the first of which may be shorter. ``offset`` is a piece's place in
    its sequence, without gaps from 0. Documents are never dropped or joined across an end; repeated rows are packed each;
    ids may be null; an empty table gives an empty table; other columns are not read.

    The pieces are written once to the shared folder, numbered within the task and length. From the counts by task and length
    follow the histogram, at most ``capacity`` rows for the driver to plan with, and each piece's rank within its length,
    which names its planned slot. The token ids themselves are not shuffled while the counts are small enough to send along.
    """
    # The length is known here before the rows are moved, so the plan needs a single pass over the texts.
    cut = cut_lineage(pieces(documents, tokenizer, end_id, capacity, doc_id, text))
    counts = cut_lineage(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = best_fit(histogram, capacity)
    plan = np.array(sorted(segments), dtype="int64").reshape(-1, 6)
    sent = cut.sparkSession.sparkContext.broadcast((plan[:, 0] * (1 << 48) + plan[:, 1], plan))
    from pyspark.sql import Window

    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = cut.join(F.broadcast(offsets) if counts.count() <= SMALL_ROWS else offsets, ["length", "part"])

    def take(batches):
        starts, plan = sent.value
        for batch in small(batches):
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = cols["length"].to_numpy(zero_copy_only=False).astype("int64")
            rank = cols["rank"].to_numpy(zero_copy_only=False)
            row = np.searchsorted(starts, length * (1 << 48) + rank, "right") - 1
            _, first_rank, _, first, each, offset = plan[row].T
            nth = rank - first_rank
            ids = [wide(v, n) for v, n in zip(cols["ids"].to_pylist(), length)]
            out = [cols["doc_id"], cols["piece"], cols["start"], pa.array(length), pa.array(ids, pa.binary()), pa.array(first + nth // each), pa.array(offset + nth % each * length)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("rank")).alias("rank")).mapInArrow(take, PACKED)


def wide(ids: bytes, n: int) -> bytes:
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
