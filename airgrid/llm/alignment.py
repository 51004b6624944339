"""Alignment of two tokenizers over a corpus: token links by bytes, and how many documents hold each pair of ids linked.

The pairs of a block of documents are an inverted index: a compressed bitmap of documents per pair (a list of 16-bit slots
or, where that is shorter, plain bits), whose popcounts add up to the documents of a pair, and planes of bits that hold how
often a pair is linked beyond once.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.batches import small
from airgrid.llm.tokens import ByteIds, byte_letters
from airgrid.session import cut_lineage

BLOCK_DOCS = 1 << 16  # slots are 16-bit numbers
BLOCK_LINKS = 1 << 22  # a block ends with the batch that brings it to so many postings
CHUNK_TOKENS = 1 << 19
BUCKETS = 16  # a block's pairs are divided by their A id
TOGETHER = 64  # so many blocks meet the counts of a bucket in one group
LONG_TEXT = 1 << 16
_GAP = re.compile(r"(?<=\S) (?=\S)")


class Aligner:
    """Both tokenizers and the bytes of their tokens; kept by a Python worker between its tasks."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteIds(path_a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in byte_letters().items()}
        with open(path_a, encoding="utf-8") as f:
            said = json.load(f)
        tokens = {i: t for t, i in said["model"]["vocab"].items()} | {t["id"]: t["content"] for t in said.get("added_tokens", [])}
        self.bytes_a = [bytes(letters.get(c, 0) for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        # No token of B reaches over a space between two words, so a long text can be cut there.
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        ids_a, ids_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(pieces))]
        self.spelled = np.array([x + s for s in ",|" for x in ids_a] + [x + s for s in ",;" for x in ids_b], "S")
        self.width = np.char.str_len(self.spelled)

    def encode(self, text: str | None) -> list[tuple[array, array]]:
        """Ids of both for space + text, by parts; none where the text is null or empty, or its bytes do not come back."""
        out = []
        for part in self.parts(text) if text else ():
            own = b" " + part.encode()
            a, b = self.a.tokens(" " + part), self.b.encode(part)
            if b"".join([self.bytes_a[i] for i in a]) != own or b"".join([self.bytes_b[i] for i in b]) != own:
                return []
            out.append((array("I", a), array("I", b)))
        return out

    def parts(self, text: str) -> list[str]:
        """The text, or its stretches between spaces where it is long, so that no call holds more than a part."""
        if len(text) <= LONG_TEXT or not self.by_words:
            return [text]
        out, at = [], 0
        while gap := _GAP.search(text, at + LONG_TEXT):
            out.append(text[at : gap.start()])
            at = gap.end()  # the space between two parts is the one that B adds and A is given
        return [*out, text[at:]]


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def chunks(units: Iterable[tuple[int, array, array]]) -> Iterator[list[tuple[int, array, array]]]:
    """Some units at a time, so that the arrays made of them stay small."""
    held, tokens = [], 0
    for unit in units:
        held.append(unit)
        tokens += len(unit[1]) + len(unit[2])
        if tokens >= CHUNK_TOKENS:
            yield held
            held, tokens = [], 0
    if held:
        yield held


def align(al: Aligner, texts: list[str | None]) -> tuple[dict[str, object], np.ndarray]:
    """Per text the numbers of tokens, groups and links and the hash of its groups; and rows (text, pair, times).

    The ends of both sides' tokens cut the bytes into stretches. Each lies in exactly one token of either side, and two tokens
    overlap in exactly one stretch, so stretches and links are the same. Ends that both have close a group. A pair may come
    more than once for a text of several parts.
    """
    counts = {c: np.zeros(len(texts), "int64") for c in ("n_a", "n_b", "n_groups", "n_links")}
    hashes: dict[int, object] = {}
    linked = []
    for held in chunks((i, a, b) for i, t in enumerate(texts) for a, b in al.encode(t)):
        owner = np.array([u[0] for u in held])
        n_a, n_b = np.array([len(u[1]) for u in held]), np.array([len(u[2]) for u in held])
        a, b = (np.frombuffer(b"".join(u[k].tobytes() for u in held), "uint32").astype("int64") for k in (1, 2))
        end_a, end_b = np.cumsum(al.len_a[a]), np.cumsum(al.len_b[b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)]
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        common = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)]
        text_a = np.repeat(owner, n_a)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        shut_a, shut_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        of_link = text_a[at_a]
        for c, x in (("n_a", text_a), ("n_b", np.repeat(owner, n_b)), ("n_groups", text_a[shut_a]), ("n_links", of_link)):
            counts[c] += np.bincount(x, minlength=len(texts))
        # Where each token is spelled: behind the other side's tokens of earlier groups, A's of its own group before B's.
        row = np.empty(len(a) + len(b), "int64")
        row[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + shut_a * len(al.len_a)
        row[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(al.len_a) + b + shut_b * len(al.len_b)
        spelled = al.spelled[row].tobytes().replace(b"\0", b"")
        till = np.concatenate([[0], np.cumsum(al.width[row])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        for i, x, y in zip(owner.tolist(), till, till[1:]):
            if i in hashes:
                hashes[i].update(b";" + spelled[x : y - 1])
            else:
                hashes[i] = hashlib.sha256(spelled[x : y - 1])
        keys, times = np.unique(of_link << 48 | a[at_a] << 24 | b[at_b], return_counts=True)
        linked.append(np.stack([keys >> 48, keys & (1 << 48) - 1, times]))
    counts["groups_sha256"] = [hashes[i].hexdigest() if i in hashes else "" for i in range(len(texts))]
    return counts, np.concatenate(linked, axis=1) if linked else np.zeros((3, 0), "int64")


def index_block(pair: np.ndarray, slot: np.ndarray, times: np.ndarray, docs: int) -> list[tuple[int, np.ndarray, np.ndarray, bytes, bytes, bytes]]:
    """(bucket, pairs, documents of each, listed slots, bitmaps, planes) of a block; what its batches hold is OR-merged.

    A pair in more than a sixteenth of the documents has a bitmap, the others list their slots. Plane k holds bit k of
    ``times`` - 1, a bit per posting in the order of the pairs.
    """
    out = []
    bucket = (pair >> 24) % BUCKETS
    order = np.lexsort((slot, pair, bucket))
    bucket, pair, slot, times = bucket[order], pair[order], slot[order], times[order]
    new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (slot[1:] != slot[:-1])))
    bucket, pair, slot, times = bucket[new], pair[new], slot[new], np.add.reduceat(times, new)
    cuts = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    width = -(-docs // 8)
    for k in range(BUCKETS):
        own = slice(cuts[k], cuts[k + 1])
        pairs, first, n = np.unique(pair[own], return_index=True, return_counts=True)
        if not len(pairs):
            continue
        dense = 16 * n > docs
        listed = slot[own][np.repeat(~dense, n)].astype("<u2").tobytes()
        bits = np.zeros((int(dense.sum()), 8 * width), bool)
        in_dense = np.repeat(dense, n)
        bits[np.repeat(np.arange(len(bits)), n[dense]), slot[own][in_dense]] = True
        more = times[own] - 1
        planes = b"".join(np.packbits(more >> j & 1).tobytes() for j in range(int(more.max()).bit_length()))
        out.append((k, pairs, n, listed, np.packbits(bits, axis=1).tobytes(), planes))
    return out


def read_block(n: np.ndarray, listed: bytes, bitmaps: bytes, planes: bytes, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all postings in the order of the pairs, and how often each is linked."""
    dense = 16 * n > docs
    slot = np.empty(int(n.sum()), "int64")
    in_dense = np.repeat(dense, n)
    slot[~in_dense] = np.frombuffer(listed, "<u2")
    bits = np.unpackbits(np.frombuffer(bitmaps, "uint8").reshape(int(dense.sum()), -1 if dense.any() else 0), axis=1)
    slot[in_dense] = np.nonzero(bits)[1]
    times = np.ones(len(slot), "int64")
    width = -(-len(slot) // 8)
    for j in range(len(planes) // width if width else 0):
        times += np.unpackbits(np.frombuffer(planes, "uint8", width, j * width))[: len(slot)].astype("int64") << j
    return slot, times


# Rows of documents have n_a to groups_sha256, rows of the index the rest; block, slot and docs hold for either.
INDEXED = "block LONG, slot INT, doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, groups_sha256 STRING, bucket INT, docs INT, pairs ARRAY<LONG>, n ARRAY<INT>, listed BINARY, bitmaps BINARY, planes BINARY"
NAMES = [x.split(" ")[0] for x in INDEXED.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]


def as_batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(NAMES, KINDS)], names=NAMES)


def indexed(documents: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents and rows of the index of their blocks, as in ``INDEXED``. A block is what a task gathers up to
    ``BLOCK_DOCS`` documents or ``block_links`` postings."""

    def run(batches):
        from pyspark import TaskContext

        al, block, docs, links = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0, 0
        held: list[np.ndarray] = []

        def close():
            slot, pair, times = np.concatenate(held, axis=1) if held else np.zeros((3, 0), "int64")
            parts = index_block(pair, slot, times, docs) if len(pair) else []
            for bucket, pairs, n, listed, bitmaps, planes in parts:
                yield as_batch(1, block=[block], docs=[docs], bucket=[bucket], pairs=[pairs], n=[n], listed=[listed], bitmaps=[bitmaps], planes=[planes])

        for batch in small(batches):
            if docs + len(batch) > BLOCK_DOCS or links >= block_links:
                yield from close()
                block, docs, links, held = block + 1, 0, 0, []
            counts, linked = align(al, batch.column(1).to_pylist())
            yield as_batch(len(batch), block=np.full(len(batch), block), slot=np.arange(docs, docs + len(batch)), doc_id=batch.column(0), **counts)
            linked[0] += docs
            held.append(linked)
            docs, links = docs + len(batch), links + linked.shape[1]
        yield from close()

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEXED)


def pair_counts(index: DataFrame) -> DataFrame:
    """``pair, documents, best`` of every linked pair: how many documents hold it, and whether no other pair of its A id has more.

    The bitmaps of a pair hold different documents in each block, so the popcount of all OR-merged is the sum of theirs.
    """
    one = index.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    counts = cut_lineage(one.groupBy("pair").agg(F.sum("n").alias("documents")))
    a_id = F.shiftright("pair", 24)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("documents").alias("most"))
    return counts.withColumn("a", a_id).join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def scores(index: DataFrame, counts: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``block, slot, n_best, count_sum``: the counts returned to the documents along the postings.

    The counts of a bucket of A ids meet ``together`` blocks at a time, so a group stays small however many blocks there are;
    what a group returns is a sum per document, which is added up over the buckets.
    """
    posts = index.filter("pairs IS NOT NULL")
    parts = -(-posts.select("block").distinct().count() // together) or 1
    posts = posts.select("bucket", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block", "docs", "pairs", "n", "listed", "bitmaps", "planes")
    shared = counts.select((F.shiftright("pair", 24) % BUCKETS).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "pair", "documents", "best")

    def add(key, left, right):
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "documents", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order].astype(bool)
        out = []
        for r in left.select(["block", "docs", "pairs", "n", "listed", "bitmaps", "planes"]).to_batches():
            for i in range(len(r)):
                block, docs = r.column(0)[i].as_py(), r.column(1)[i].as_py()
                pairs, n = (r.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                slot, times = read_block(n, *(r.column(c)[i].as_py() for c in (4, 5, 6)), docs)
                at = np.searchsorted(pair, pairs)
                total = np.zeros(docs, "int64")
                np.add.at(total, slot, times * np.repeat(count[at], n))
                own = np.zeros(docs, "int64")
                np.add.at(own, slot, times * np.repeat(best[at], n))
                used = np.flatnonzero(total)
                out.append(pa.table({"block": np.full(len(used), block), "slot": pa.array(used, pa.int32()), "n_best": own[used], "count_sum": total[used]}))
        return pa.concat_tables(out) if out else pa.table({"block": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})

    met = posts.groupBy("bucket", "part").cogroup(shared.groupBy("bucket", "part")).applyInArrow(add, "block LONG, slot INT, n_best LONG, count_sum LONG")
    return met.groupBy("block", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_align(documents: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS, together: int = TOGETHER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``documents``.

    A: a byte-level file, on space + text; B: a piece file, on the text, which adds that space; neither knows special tokens.
    A text that is null or empty, or whose tokens' joined bytes differ from space + text on either side, has no tokens: zeros
    and an empty hash. Repeated rows count as documents of their own; ids may be null; an empty table gives an empty table;
    other columns are not read. The texts are read once; the index is written to the shared folder, its postings are
    shuffled once.
    """
    index = cut_lineage(indexed(documents, path_a, path_b, block_links, doc_id, text))
    back = scores(index, cut_lineage(pair_counts(index)), together)
    docs = index.filter("slot IS NOT NULL").select("block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return docs.join(back, ["block", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"
    )
