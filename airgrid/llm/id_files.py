"""Files of token ids: ranked by frequency, byte-aligned codes of variable length with separate control bytes.

A file is a row of blocks. A block is the header (eight unsigned 64-bit integers: mark, documents, ids, ranks, control bytes,
data bytes, 0, 0), then doc_ids (64 bit), a byte per document that is 1 where the doc_id is null, ids per document (32 bit),
the id of each rank (32 bit), control bytes, data bytes and a line feed. A code is a rank's 1 to 4 low bytes; four codes'
lengths less one share a control byte, the first in its low bits. All integers are little-endian.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.batches import small
from airgrid.llm.tokens import word_ids
from airgrid.session import cut_lineage, shared_dir

MARK = 0x314B4C4253444956
BLOCK_IDS = 1 << 20  # a block ends with the document that brings it to so many ids
MANY_FILES = 100_000
FILE_BLOCKS = 256  # blocks of a file, so that a reader can hold it whatever the size of a task
# Lengths of the four codes of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype="uint8")


def encode_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    n_ids = np.array([len(x) // 4 for x in ids], "<u4")
    flat = np.frombuffer(b"".join(ids), "<u4")
    used, rank_of, counts = np.unique(flat, return_inverse=True, return_counts=True)
    by_count = np.lexsort((used, -counts))  # the commonest id first, ties by id
    rank = np.empty(len(used), "uint32")
    rank[by_count] = np.arange(len(used), dtype="uint32")
    codes = rank[rank_of]
    extra = (codes > 0xFF).astype("uint8") + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    four = np.zeros(-(-len(codes) // 4) * 4, "uint8")
    four[: len(codes)] = extra
    control = (four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6).astype("uint8")
    at = np.cumsum(extra + 1, dtype="int64") - (extra + 1)
    data = np.zeros(int(at[-1] + extra[-1] + 1) if len(codes) else 0, "uint8")
    for k in range(4):
        has = extra >= k
        data[at[has] + k] = codes[has] >> 8 * k & 0xFF
    head = np.array([MARK, len(ids), len(flat), len(used), len(control), len(data), 0, 0], "<u8")
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], "uint8")
    return b"".join(x.tobytes() for x in (head, keys, null, n_ids, used[by_count].astype("<u4"), control, data)) + b"\n"


def heads(content: memoryview):
    """(place of the block, its header) of each block."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, "<u8", 8, at)
        if head[0] != MARK:
            raise ValueError("not a file of token ids")
        yield at, [int(x) for x in head]
        at += 64 + 13 * int(head[1]) + 4 * int(head[3]) + int(head[4]) + int(head[5]) + 1


def decode_block(content: memoryview, at: int, head: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their null marks, ids per document, all ids."""
    _, docs, n, ranks, n_control, n_data, _, _ = head
    at += 64
    parts = []
    for kind, count in (("<i8", docs), ("uint8", docs), ("<u4", docs), ("<u4", ranks), ("uint8", n_control), ("uint8", n_data)):
        parts.append(np.frombuffer(content, kind, count, at))
        at += parts[-1].nbytes
    keys, null, n_ids, ids, control, data = parts
    length = LENGTHS[control].ravel()[:n]
    place = np.cumsum(length, dtype="int64") - length
    codes = data[place].astype("uint32") if n else np.zeros(0, "uint32")
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        codes[more] |= data[place[more] + k].astype("uint32") << 8 * k
    return keys, null, n_ids, ids[codes]


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts (null: none), each followed by ``end_id``, in ascending order of ``doc_id``.

    Null ids come first, rows with equal ids in the order of a hash of their text, repeated rows each. One exchange by ranges
    of the id puts files and rows in order; a task encodes block by block, so its memory is that of a block. Files are written
    and committed by Spark, on any store that it can write to. Other columns are not read.
    """

    def encode(batches):
        encoder, tail = word_ids(tokenizer, False), np.array([end_id], "<u4").tobytes()
        keys, ids, n = [], [], 0
        for batch in small(batches):
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                ids.append(encoder.ids(words.as_py()) + tail)
                n += len(ids[-1]) // 4
                if n >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_block(keys, ids)], pa.binary())], names=["block"])
                    keys, ids, n = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([encode_block(keys, ids)], pa.binary())], names=["block"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    blocks = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, "block BINARY")
    # The text writer puts out the bytes of a row as they are, and a line feed.
    blocks.select(F.expr("CAST(substring(block, 1, length(block) - 1) AS STRING)").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)


ROWS = "path STRING, doc_id LONG, in_file LONG, n_tokens LONG, ids BINARY"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files: ``start`` counts the ids of all documents before, ``ids`` as 32-bit integers.

    The ids of each file come from a pass over the block headers; their running sum needs one row per file.
    """

    def totals(batches):
        for batch in batches:
            sums = [sum(h[2] for _, h in heads(memoryview(c.as_buffer()))) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["path", "n"])

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view, before = memoryview(content.as_buffer()), 0
                for at, head in heads(view):
                    keys, null, n_ids, ids = decode_block(view, at, head)
                    ends = np.cumsum(n_ids, dtype="int64")
                    starts = ends - n_ids
                    raw = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(starts + before),
                        pa.array(n_ids, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary()),
                    ], names=["path", "doc_id", "in_file", "n_tokens", "ids"])
                    before += head[2]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    sums = cut_lineage(files.mapInArrow(totals, "path STRING, n LONG"))
    # Part files are numbered by range, and by file of the range; as texts the numbers would not ascend once they are longer.
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    in_order = Window.orderBy(number(r"/part-(\d+)-[^/]*$"), number(r"-c(\d+)[^/-]*$"), "path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("path", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    rows = files.mapInArrow(decode, ROWS).join(F.broadcast(offsets) if sums.count() <= MANY_FILES else offsets, "path")
    return rows.select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids")


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids to a new folder of the shared place and reads them back."""
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents, path, tokenizer, end_id, doc_id, text)
    return read_ids(spark, path)
