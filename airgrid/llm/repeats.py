"""Repeated passages by blockwise suffix sorting with a difference cover.

Positions in a difference cover modulo v have two uses. Any two suffixes share an offset below v at which both are sampled,
so two equal passages of ``length`` bytes are aligned by a pair of samples whose next ``length - v + 1`` bytes are equal. The
samples are ranked first (named by these bytes, and told apart by whether another one has the same name). Only suffixes over
a sample of a shared rank can tie for long; they go to the bucket of that rank, and one bucket at a time is sorted: the rank
stands for the bytes in the middle, so what is compared is the few bytes before and behind the sample, whatever the texts' length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.batches import small
from airgrid.session import cut_lineage, shared_dir

# Perfect difference sets: every difference modulo v comes from exactly one pair (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
HOT = 1 << 16  # a rank with more samples is divided by whole passages
BLOCK = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Cover:
    """The cover for passages of ``length`` bytes, and names of strings by rolling sums."""

    def __init__(self, length: int):
        self.length = length
        self.v = max(v for v in COVERS if v <= max(1, 0.6 * length))
        self.reach = self.v - 1  # bytes a sample can stand behind the start of its passage
        self.named = length - self.reach  # bytes a rank stands for
        self.sampled = np.isin(np.arange(self.v), COVERS[self.v])
        with np.errstate(over="ignore"):
            self.tables = [np.random.default_rng(b).integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1) for b in BASES]
            n = BLOCK + length + 1
            self.powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in BASES]
            self.inverse = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(b, -1, 1 << 64)))])) for b in BASES]

    def names(self, data: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """A 64-bit name of the ``size`` bytes from each of the ascending places ``at``."""
        out = np.empty(len(at), "uint64")
        cuts = np.searchsorted(at, np.arange(0, len(data) + BLOCK, BLOCK))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if x == y:
                continue
            own = data[k * BLOCK : (k + 1) * BLOCK + size]
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(self.tables[which][own] * self.powers[which][: len(own)])])
                place = at[x:y] - k * BLOCK
                h = (sums[place + size] - sums[place]) * self.inverse[which][place]
                h ^= h >> np.uint64(31)  # low bits alone are weak
                h *= np.uint64(0xBF58476D1CE4E5B9)
                out[x:y] = h ^ h >> np.uint64(29)
        return out

    def samples(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the cover in every text, counted from the text's start, where a whole name fits."""
        room = np.maximum(ends - starts - self.named + 1, 0)
        place = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
        return (place + np.repeat(starts, room))[self.sampled[place % self.v]]


def squeezed(*columns: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def loosened(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


# A chunk's documents: ids, hashes of the texts (of 64 bits for the order, of 128 to find copies) and their sizes; the bytes of all texts.
CHUNK = "chunk LONG, docs INT, bytes LONG, ids ARRAY<LONG>, marks ARRAY<LONG>, digests ARRAY<BINARY>, sizes ARRAY<LONG>, data BINARY"


def chunked(documents: DataFrame, chunk_bytes: int, doc_id: str, text: str) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        chunk, keys, hashes, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close():
            data = np.frombuffer(b"".join(texts), "uint8")
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            row = (chunk, len(texts), len(data), keys, hashes, digests, [len(t) for t in texts], squeezed(data, level=3))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names=[c.split(" ")[0] for c in CHUNK.split(", ")])

        for batch in small(batches):
            for key, mark, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys.append(key)
                hashes.append(mark)
                texts.append((words.as_py() or "").encode())
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield close()
                    chunk, keys, hashes, texts, size = chunk + 1, [], [], [], 0
        if keys:
            yield close()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.col(text).alias("text"))
    return rows.mapInArrow(run, CHUNK)


class Chunk:
    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.key = np.array([x or 0 for x in row["ids"]], "<i8")
        self.known = np.array([x is not None for x in row["ids"]], "uint8")
        self.mark = np.array(row["marks"], "<i8")
        self.data = loosened(row["data"], row["bytes"], "uint8")[0]
        self.ends = np.cumsum(np.array(row["sizes"], "int64"))
        self.starts = self.ends - row["sizes"]
        self.copy = np.zeros(len(self.key), bool)  # documents whose whole text is an earlier one's
        for own in row["copies"] or []:
            self.copy[own["copies"]] = True

    def samples(self, cover: Cover) -> np.ndarray:
        return cover.samples(self.starts[~self.copy], self.ends[~self.copy])


def copies_of(chunks: DataFrame) -> DataFrame:
    """``chunk, copies``: the places in their chunk of the documents whose text is that of an earlier document."""
    place = F.posexplode(F.arrays_zip("ids", "marks", "digests"))
    docs = chunks.select("chunk", place).select("chunk", "pos", F.col("col.digests").alias("digest"), F.struct(F.col("col.ids").isNotNull().alias("known"), F.col("col.ids").alias("id"), F.col("col.marks").alias("mark")).alias("own"))
    first = docs.groupBy("digest").agg(F.min("own").alias("first"), F.max("own").alias("last")).filter("first <> last")
    later = docs.join(first, "digest").filter(~F.col("own").eqNullSafe(F.col("first")))
    return later.groupBy("chunk").agg(F.collect_list("pos").alias("copies"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in small(batches, 1):
        yield batch.to_pylist()[0]


def emitted(kinds: dict[str, pa.DataType], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def by_key(columns: list[str], fn):
    """Runs ``fn`` on the rows of each key; rows of a key follow each other in the partition."""

    def run(batches):
        held, key = [], None
        for row in rows_of(batches):
            now = tuple(row[c] for c in columns)
            if held and now != key:
                yield from fn(key, held)
                held = []
            key = now
            held.append(row)
        if held:
            yield from fn(key, held)

    return run


def dealt(rows: DataFrame, column: str) -> DataFrame:
    return rows.repartition(column).sortWithinPartitions(column)


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places of its rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[order], return_index=True)
    for b, x, y in zip(own.tolist(), first, [*first[1:], len(order)]):
        yield b, order[x:y]


NAMED = {"bucket": pa.int64(), "chunk": pa.int64(), "n": pa.int32(), "names": pa.binary(), "times": pa.binary()}


def name_samples(cover: Cover, bits: int):
    """The distinct names of a chunk's samples and how many have each, for the bucket of the leading ``bits`` bits."""

    def run(batches):
        for row in rows_of(batches):
            c = Chunk(row)
            at = c.samples(cover)
            names, times = np.unique(cover.names(c.data, at, cover.named), return_counts=True)
            bucket = (names >> np.uint64(64 - bits)).astype("int64") if bits else np.zeros(len(names), "int64")
            out = []
            for b, own in split_by(bucket):
                # The bucket holds the leading bits; 40 of the others tell names apart well enough to choose what is sorted.
                low = (names[own] << np.uint64(bits) >> np.uint64(24)).astype("<u8").view("uint8").reshape(-1, 8)[:, :5]
                out.append((b, c.id, len(own), low.tobytes(), squeezed(np.minimum(times[own], 0xFFFFFFFF).astype("<u4"))))
            yield from emitted(NAMED, out)

    return run


TIED = {"chunk": pa.int64(), "bucket": pa.int64(), "n": pa.int32(), "n_samples": pa.int64(), "tied": pa.binary()}


def tied_names(hot: int):
    """Of a bucket's names those that more than one sample has, sent back to their chunks; the low bit marks the hot ones."""

    def find(key, rows):
        names = []
        for r in rows:
            wide = np.zeros((r["n"], 8), "uint8")
            wide[:, :5] = np.frombuffer(r["names"], "uint8").reshape(-1, 5)
            names.append(wide.view("<u8").ravel())
        times = np.concatenate([loosened(r["times"], r["n"], "<u4")[0] for r in rows]).astype("int64")
        flat = np.concatenate(names)
        _, place = np.unique(flat, return_inverse=True)
        total = np.bincount(place, weights=times).astype("int64")[place]
        at, out = 0, []
        for r, own in zip(rows, names):
            all_times = total[at : at + r["n"]]
            tied = np.flatnonzero(all_times > 1)
            if len(tied):
                sent = own[tied] << np.uint64(1) | (all_times[tied] > hot).astype("uint64")
                out.append((r["chunk"], r["bucket"], len(tied), int(times[at : at + r["n"]][tied].sum()), squeezed(sent.astype("<u8"))))
            at += r["n"]
        yield from emitted(TIED, out)

    return by_key(["bucket"], find)


# A sample of a tied rank with its context, or a whole passage at a hot one (no context, its second name as ``la``).
SUFFIXES = {"bucket": pa.int64(), "chunk": pa.int64(), "whole": pa.bool_(), "n": pa.int32(), "rows": pa.binary()}
FIXED = ("<u8", "<i8", "uint8", "<i8", "<i8", "<i8", "<u8", "<u8")  # rank, doc_id, its presence, hash, place in text, place in chunk, bytes before, behind


def suffixes(cover: Cover, bits: int, buckets: int):
    """The samples of tied ranks, for the bucket of their rank, with the bytes around them."""

    def run(batches):
        for row in rows_of(batches):
            c = Chunk(row)
            names, is_hot = [], []
            for r in row["replies"]:
                own = loosened(r["tied"], r["n"], "<u8")[0]
                low = (own >> np.uint64(1)) << np.uint64(24) >> np.uint64(bits)
                names.append(low | np.uint64(r["bucket"]) << np.uint64(64 - bits) if bits else low)
                is_hot.append(own & np.uint64(1))
            names, is_hot = np.concatenate(names), np.concatenate(is_hot).astype(bool)
            order = np.argsort(names)
            names, is_hot = names[order], is_hot[order]
            at = c.samples(cover)
            rank = cover.names(c.data, at, cover.named)
            # What a bucket was sent: its own bits and the 40 behind them.
            kept = rank >> np.uint64(24 - bits) << np.uint64(24 - bits) if bits < 24 else rank
            place = np.minimum(np.searchsorted(names, kept), len(names) - 1)
            tied = names[place] == kept
            at, rank, hot = at[tied], rank[tied], is_hot[place[tied]]
            doc = np.searchsorted(c.ends, at, "right")
            before = np.minimum(at - c.starts[doc], cover.reach)
            behind = np.minimum(c.ends[doc] - at - cover.named, cover.reach)
            long = before + behind >= cover.reach  # else no passage over the sample fits into its text
            at, rank, hot, doc, before, behind = (x[long] for x in (at, rank, hot, doc, before, behind))
            out = []
            if len(x := np.flatnonzero(~hot)):
                a, d = at[x], doc[x]
                padded = np.concatenate([np.zeros(cover.reach, "uint8"), c.data, np.zeros(cover.reach, "uint8")])
                around = np.lib.stride_tricks.sliding_window_view(padded, cover.length + cover.reach)
                for b, own in split_by((rank[x] % np.uint64(buckets)).astype("int64")):
                    k = d[own]
                    out.append((b, c.id, False, len(own), squeezed(rank[x][own], c.key[k], c.known[k], c.mark[k], a[own] - c.starts[k], a[own], before[x][own].astype("<u8"), behind[x][own].astype("<u8"), around[a[own]])))
            if len(x := np.flatnonzero(hot)):
                first, last = at[x] - before[x], at[x] - cover.reach + behind[x]
                n = last - first + 1
                start = np.unique(np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
                one, two = (cover.names(c.data, start, cover.length, k) for k in (0, 1))
                k = np.searchsorted(c.ends, start, "right")
                for b, own in split_by((one % np.uint64(buckets)).astype("int64")):
                    j = k[own]
                    out.append((b, c.id, True, len(own), squeezed(one[own], c.key[j], c.known[j], c.mark[j], start[own] - c.starts[j], start[own], two[own], np.zeros(len(own), "<u8"))))
            yield from emitted(SUFFIXES, out)

    return run


LATER = {"chunk": pa.int64(), "n": pa.int32(), "found": pa.binary()}


def is_later(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Rows that equal a row of smaller ``order`` in all keys; equal order is the same place."""
    by = np.lexsort([order, *keys])
    same = np.ones(len(by), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[by][1:] == k[by][:-1]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    later = np.empty(len(by), bool)
    later[by] = order[by] > order[by][first]
    return later


def sorted_by(keys: list[np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys and bytes (a row each), and which rows equal the one before in the keys."""
    words = np.pad(text, ((0, 0), (0, -text.shape[1] % 8))).view(">u8").astype("uint64") if text.shape[1] else np.zeros((len(text), 0), "uint64")
    by = np.lexsort([*words.T[::-1], *keys])
    same = np.ones(len(by), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[by][1:] == k[by][:-1]
    return by, same


def numbered(keys: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """A number per row, equal for rows of equal keys and bytes."""
    by, same = sorted_by(keys, text)
    same[1:] &= (text[by][1:] == text[by][:-1]).all(axis=1)
    number = np.empty(len(by), "int64")
    number[by] = np.cumsum(~same)
    return number


def by_depth(keys: list[np.ndarray], text: np.ndarray) -> Iterator[np.ndarray]:
    """For each depth 0, 1, ...: a number per row, equal for rows of equal keys and so many equal first bytes."""
    by, same = sorted_by(keys, text)
    equal = text[by][1:] == text[by][:-1]
    for depth in range(text.shape[1] + 1):
        if depth:
            same[1:] &= equal[:, depth - 1]
        number = np.empty(len(by), "int64")
        number[by] = np.cumsum(~same)
        yield number


def later_passages(cover: Cover, rank, order, before, behind, around) -> np.ndarray:
    """For each sample, by offset, whether the passage that starts so far before it fits and occurs earlier over a sample of its rank.

    The samples are sorted by rank and context; of those that agree in all of it only the first goes on. The bytes that the rank
    stands for are compared too, so that no name has to be trusted.
    """
    reach = cover.reach
    offset = np.arange(reach + 1)
    fits = (offset <= before[:, None]) & (reach - offset <= behind[:, None])
    whole = numbered([rank, before, behind], around)
    out = np.repeat(is_later([whole], order)[:, None], reach + 1, axis=1)
    lead = np.lexsort([order, whole])
    lead = first = lead[np.append(True, whole[lead][1:] != whole[lead][:-1])]
    middle = numbered([rank[lead]], around[lead, reach : reach + cover.named])
    _, place, n = np.unique(middle, return_inverse=True, return_counts=True)
    several = n[place] > 1
    lead, middle = lead[several], middle[several]
    if len(lead):
        rights = list(by_depth([middle], around[lead, reach + cover.named :]))
        for k, own in enumerate(by_depth([middle], around[lead, :reach][:, ::-1])):
            some = np.flatnonzero(fits[lead, k])
            out[lead[some], k] |= is_later([own[some], rights[reach - k][some]], order[lead[some]])
    out |= out[first[whole - 1]]  # a repeated row stands at the same place as the first
    return out & fits


def sort_bucket(cover: Cover):
    """The passages of a bucket that occur earlier too: places in their chunks, and a bit per offset before the place."""

    def find(key, rows):
        parts = []
        for r in rows:
            kinds = FIXED if r["whole"] else (*FIXED, f"({cover.length + cover.reach},)u1")
            parts.append(loosened(r["rows"], r["n"], *kinds))
        chunk = np.repeat([r["chunk"] for r in rows], [r["n"] for r in rows])
        rank, key_, known, mark, in_text, at, before, behind = (np.concatenate([p[i] for p in parts]) for i in range(8))
        by = np.lexsort([in_text, mark, key_, known])
        new = np.ones(len(by), bool)
        new[1:] = False
        for c in (known, key_, mark, in_text):
            new[1:] |= c[by][1:] != c[by][:-1]
        order = np.empty(len(by), "int64")
        order[by] = np.cumsum(new)
        if rows[0]["whole"]:
            later = is_later([rank, before], order)[:, None]
        else:
            later = later_passages(cover, rank, order, before.astype("int64"), behind.astype("int64"), np.concatenate([p[8] for p in parts]))
        some = np.flatnonzero(later.any(axis=1))
        bits = np.packbits(np.pad(later[some], ((0, 0), (0, cover.v - later.shape[1]))), axis=1)
        yield from emitted(LATER, [(c, len(own), squeezed(at[some][own], bits[own])) for c, own in split_by(chunk[some])])

    return by_key(["bucket", "whole"], find)


CUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def cut_out(cover: Cover, keep: bool):
    def run(batches):
        width = -(-cover.v // 8)
        for row in rows_of(batches):
            c = Chunk(row)
            begins = np.zeros(len(c.data), bool)
            for r in row["replies"] or []:
                at, bits = loosened(r["found"], r["n"], "<i8", f"({width},)u1")
                which, offset = np.nonzero(np.unpackbits(bits, axis=1))
                begins[at[which] - offset] = True
            for a, b in zip(c.starts[c.copy], c.ends[c.copy]):
                begins[a : max(a, b - cover.length + 1)] = True
            sums = np.cumsum(begins, dtype="int32")
            gone = sums > 0
            gone[cover.length :] = sums[cover.length :] > sums[: -cover.length]
            out = []
            for a, b, key, known in zip(c.starts.tolist(), c.ends.tolist(), c.key.tolist(), c.known.tolist()):
                own = gone[a:b]
                n = int(own.sum())
                left = c.data[a:b][~own].tobytes() if n else c.data[a:b].tobytes()
                spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if n else 0
                out.append((key if known else None, b - a, n, spans, hashlib.sha256(left).hexdigest(), left if keep else None))
            yield from emitted(CUT, out)

    return run


def schema(kinds: dict[str, pa.DataType]) -> str:
    said = {pa.int64(): "LONG", pa.int32(): "INT", pa.binary(): "BINARY", pa.bool_(): "BOOLEAN", pa.string(): "STRING"}
    return ", ".join(f"{c} {said[t]}" for c, t in kinds.items())


def with_replies(chunks: DataFrame, how: str = "left", **replies: DataFrame) -> DataFrame:
    """Chunks with the replies to each as a list of rows; the chunks, stored by bucket, are not shuffled."""
    out = chunks
    for name, rows in replies.items():
        own = rows.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "chunk"])).alias(name))
        out = out.join(own.hint("merge"), "chunk", how if name != "copies" else "left")
    return out


def stored_by_bucket(chunks: DataFrame) -> DataFrame:
    """The chunks as a table in the shared folder that is divided by chunk, so that later joins leave it where it is."""
    spark, name = chunks.sparkSession, f"chunks_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def remove_repeats(documents: DataFrame, length: int = 100, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, keep: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``documents``.

    Every byte covered by a string of ``length`` bytes that also starts earlier, in a document of smaller ``doc_id`` or earlier in
    the same one, is removed; overlaps count, and strings are judged on the input. ``kept`` holds the remaining bytes (null
    without ``keep``). A null text is empty; a null id is smaller than all others; documents of one id are ordered by a hash of
    their text; rows equal in id and text are one document and get the same result. An empty table gives an empty
    table; other columns are not read.

    Texts are held in chunks of about ``chunk_bytes`` (a longer text is a chunk of its own), compressed and written once, as a
    table of the session's catalog that lies in the shared folder. Documents whose whole text is an earlier one's
    (by 128 bits of hash) have no part in the sorting. A rank
    that more than ``hot`` samples share does not meet in one bucket: the passages over it do, each by itself (by 128 bits of name).
    All others are compared byte by byte.
    """
    cover = Cover(length)
    chunks = stored_by_bucket(chunked(documents, chunk_bytes, doc_id, text))
    copies = cut_lineage(copies_of(chunks))
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    share = 5 * int(cover.sampled.sum()) / cover.v  # bytes of names per byte of text
    bits = max(0, int(total * share / bucket_bytes).bit_length())
    named = dealt(with_replies(chunks, copies=copies).mapInArrow(name_samples(cover, bits), schema(NAMED)), "bucket")
    tied = cut_lineage(named.mapInArrow(tied_names(hot), schema(TIED)))
    samples = tied.agg(F.sum("n_samples")).first()[0] or 0
    buckets = 1 + samples * (length + cover.reach + 57) // bucket_bytes
    asked = with_replies(chunks, "inner", replies=tied.select("chunk", "bucket", "n", "tied"), copies=copies)
    dealt_out = asked.mapInArrow(suffixes(cover, bits, buckets), schema(SUFFIXES)).withColumn("bucket", F.col("bucket") * 2 + F.col("whole").cast("long"))
    later = cut_lineage(dealt(dealt_out, "bucket").mapInArrow(sort_bucket(cover), schema(LATER)))
    return with_replies(chunks, replies=later, copies=copies).mapInArrow(cut_out(cover, keep), schema(CUT))
