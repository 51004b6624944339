"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.batches import small
from airgrid.llm.components import components
from airgrid.session import cut_lineage

COUNTERS = 1 << 20  # size of the count table that every task gets (4 MB), whatever the corpus
SLICE = 1 << 14
GROUPS = 128  # of a set's hashes, for the suffix filter
MANY = 0xFFFF  # a group's count from here on says no more than that
BLOCK = 1000  # postings of a gram that meet in one task where all links are listed
SMALL_IDS = 2_000_000  # a list of ids goes to every executor up to this many (16 MB)
MIXERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(text: str | None, n: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; of the whole sequence if it is shorter."""
    words = text.encode().lower().split() if text else []  # splits and lower-cases ASCII only
    if not words:
        return np.zeros(0, "uint64")
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w, seed) for w in words), "uint64", len(words))
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, "uint64")
    for i in range(size):  # Horner's rule keeps the order of the words, the start their number
        out = (out ^ (out >> np.uint64(29))) * MIXERS[0] + h[i : len(h) - size + 1 + i]
    out = (out + np.uint64(size)) * MIXERS[1]
    out ^= out >> np.uint64(32)
    return np.unique(out * MIXERS[2] ^ (out >> np.uint64(17)))


class Bounds:
    """Integer bounds for Jaccard >= ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n):
        """Grams of a set of n that one of any partner's must meet: overlap >= t n."""
        return n - -(-self.percent * n // 100) + 1

    def index_prefix(self, n):
        """The same towards partners at least as large: overlap >= 2 t n / (1 + t)."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1


TABLE = "doc_id LONG, mark LONG, n LONG, cid LONG, check LONG, parts BINARY, slice INT, part INT, counts BINARY"


def marked(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, text, mark``: a row is known by its id and a hash of its text, as ids may repeat with other texts."""
    return documents.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))


def read_sets(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """A row per document (size, two halves of the set's fingerprint, hashes per group) and, per task, counts of all its shingles."""

    def scan(batches):
        from pyspark import TaskContext

        part, counts = TaskContext.get().partitionId(), np.zeros(COUNTERS, "uint32")
        for batch in small(batches):
            rows, used = [], []
            for key, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = shingles(text.as_py(), n, seed)
                mark = xxhash.xxh3_128_digest(s.tobytes(), seed)
                low, high = np.frombuffer(mark, "<i8")
                rows.append((key, own, len(s), low, high, np.bincount((s >> np.uint64(57)).astype("int64"), minlength=GROUPS).clip(max=MANY).astype("<u2").tobytes()))
                used.append(s)
            if rows:
                counts += np.bincount((np.concatenate(used) & np.uint64(COUNTERS - 1)).astype("int64"), minlength=COUNTERS).astype("uint32")
                cols = list(zip(*rows))
                empty = [None] * len(rows)
                yield batch_of([*cols, empty, empty, empty])
        slices = range(COUNTERS // SLICE)
        empty = [None] * len(slices)
        yield batch_of([empty, empty, empty, empty, empty, empty, list(slices), [part] * len(slices), [counts[i * SLICE : (i + 1) * SLICE].astype("<u4").tobytes() for i in slices]])

    return docs.mapInArrow(scan, TABLE)


def batch_of(columns) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "mark", "n", "cid", "check", "parts", "slice", "part", "counts"])


def shingle_counts(table: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, by slice in groups of tasks and then by slice; the sums are what the driver gets."""

    def add(pdf):
        total = sum(np.frombuffer(c, "<u8" if len(c) == 8 * SLICE else "<u4").astype("uint64") for c in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[total.astype("<u8").tobytes()])

    rows = table.filter("slice IS NOT NULL").select("slice", F.expr("part div 64").cast("int").alias("part"), "counts")
    schema = "slice INT, part INT, counts BINARY"
    sums = rows.groupBy("slice", "part").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema).collect()
    out = np.zeros(COUNTERS, "uint64")
    for r in sums:
        out[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, "<u8")
    return np.minimum(out, 0xFFFFFFFF).astype("uint32")


def post(docs: DataFrame, n: int, seed: int, bounds: Bounds, counts) -> DataFrame:
    """(gram, cid, n, pos) of the rarest-first prefix of each set; once per task for equal sets."""

    def emit(batches):
        common, seen = counts.value, set()
        for batch in small(batches):
            grams, cids, sizes, places = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), n, seed)
                if not len(s):
                    continue
                cid = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed), "<i8")[0]
                if cid in seen:
                    continue
                seen.add(cid)
                p = bounds.prefix(len(s))
                # One order for all sets: by count, then by hash, as the sort is stable and the set sorted.
                rarest = s[np.argsort(common[s & np.uint64(COUNTERS - 1)], kind="stable")[:p]]
                grams.append(rarest.view("int64"))
                cids.append(np.full(p, cid))
                sizes.append(np.full(p, len(s)))
                places.append(np.arange(p))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype("int64")) for c in (grams, cids, sizes, places)], names=["gram", "cid", "n", "pos"])

    return docs.mapInArrow(emit, "gram LONG, cid LONG, n LONG, pos LONG")


def shared_only(batches):
    """Of rows in order of gram, n and cid: each (gram, cid) once, and only grams with two or more cids."""
    names = ["gram", "cid", "n", "pos"]
    last, written = None, True  # the last row seen, and whether it has gone out

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if last is not None:
            cols = [np.concatenate([[x], c]) for x, c in zip(last, cols)]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        cols = [c[new] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        keep = np.zeros(len(cols[0]), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and written:
            keep[0] = False
        out = np.flatnonzero(keep)
        # A last row without a partner so far waits for the next batch.
        written = bool(keep[-1]) or (last is not None and written and len(keep) == 1)
        last = [c[-1] for c in cols]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols], names=names)


def once(batches):
    """Rows of (key, text, mark), each (key, mark) once per task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def few(ids: DataFrame) -> DataFrame:
    """The table, marked to be sent to all executors if it was counted and is small."""
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def fitting(bounds: Bounds) -> str:
    """Length and positional filter of rows a, b with a common gram, a not the larger set."""
    t = bounds.percent
    return (
        f"100 * a_n >= {t} * b_n AND a_pos < a_n - ({2 * t} * a_n + {99 + t}) div {100 + t} + 1"
        f" AND {100 + t} * least(a_n - a_pos, b_n - b_pos) >= {t} * (a_n + b_n)"
    )


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, seed: int, bounds: Bounds) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are similar: a suffix filter by the classes' groups, then the texts."""
    percent = bounds.percent
    ends = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    classes = cut_lineage(classes.join(few(ends), "cid", "left_semi"))

    def suffix(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, GROUPS).astype("int64") for i in (6, 7))
            most = np.minimum(x, y).sum(1)
            keep = ((100 + percent) * most >= percent * (x.sum(1) + y.sum(1))) | (x == MANY).any(1) | (y == MANY).any(1)
            yield batch.select(list(range(6))).filter(pa.array(keep))

    side = lambda s: classes.select(F.col("cid").alias(s), F.col("doc.doc_id").alias(f"{s}_doc"), F.col("doc.mark").alias(f"{s}_mark"), F.col("parts").alias(f"{s}_parts"))
    ends = ["a", "b", "a_doc", "a_mark", "b_doc", "b_mark"]
    left = pairs.join(side("a"), "a").join(side("b"), "b").select(*ends, "a_parts", "b_parts")
    left = cut_lineage(left.mapInArrow(suffix, ", ".join(f"{c} LONG" for c in ends)))
    rows = F.explode(F.array(*[F.struct(F.col(f"{s}_doc").alias("key"), F.col(f"{s}_mark").alias("mark")) for s in "ab"])).alias("row")
    needed = few(cut_lineage(left.select(rows).select("row.*").distinct()))
    texts = cut_lineage(docs.join(needed, ["key", "mark"], "left_semi").select("key", "text", "mark").mapInArrow(once, docs.select("key", "text", "mark").schema))

    def compare(batches):
        for batch in small(batches):
            keep, known = [], {}
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.as_py(), y.as_py()
                for t in (x, y):
                    if t not in known:
                        known[t] = shingles(t, n, seed)
                both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                keep.append(100 * both >= percent * (len(known[x]) + len(known[y]) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: texts.select(F.col("key").alias(f"{s}_doc"), F.col("mark").alias(f"{s}_mark"), F.col("text").alias(f"{s}_text"))
    return left.join(side("a"), ["a_doc", "a_mark"]).join(side("b"), ["b_doc", "b_mark"]).select("a", "b", "a_text", "b_text").mapInArrow(compare, "a LONG, b LONG").distinct()


def prepared(docs: DataFrame, n: int, bounds: Bounds) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """The seed, a row per document, a row per class of equal sets, and the postings of grams that several classes share."""
    seed = 0
    while True:
        table = cut_lineage(read_sets(docs, n, seed))
        sets = table.filter("slice IS NULL")
        classes = cut_lineage(sets.filter("n > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "mark")).alias("doc"), F.first("parts").alias("parts"), F.min("check").alias("low"), F.max("check").alias("high")))
        if not classes.filter("low <> high").limit(1).count():
            break
        seed += 1  # two sets share half a fingerprint: other hashes
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(table))
    postings = post(docs, n, seed, bounds, counts)
    shared = cut_lineage(postings.repartition("gram").sortWithinPartitions("gram", "n", "cid").mapInArrow(shared_only, "gram LONG, cid LONG, n LONG, pos LONG"))
    return seed, sets, classes, shared


def similar_sets(docs: DataFrame, n: int, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """(key, n, cid) of every document, and links between cids that connect whatever similar sets connect."""
    seed, sets, classes, shared = prepared(docs, n, bounds)
    # A set with few rare shingles of its own before a common one is at the centre of those that share it.
    central = Window.partitionBy("gram").orderBy("pos", "n", "cid")
    row = F.struct("n", "pos", "cid")
    met = shared.select(row.alias("x"), F.first(row).over(central).alias("centre"), F.lag(row).over(central).alias("before"))
    met = met.select("x", F.explode(F.array("centre", "before")).alias("y")).filter("x.cid <> y.cid")
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    sides = [F.col(f"{side}.{c}").alias(f"{to}_{c}") for side, to in (("x", "a"), ("y", "b")) for c in ("n", "pos", "cid")]
    first = cut_lineage(met.select(*sides).filter(fitting(bounds)).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct())
    links = cut_lineage(verified(first, classes, docs, n, seed, bounds))
    # What is connected already needs no other link. All other pairs of sets that share a prefix gram are still to be looked at.
    connected = few(cut_lineage(components(links).withColumnRenamed("node", "cid")))
    labelled = shared.join(connected, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    together = Window.partitionBy("gram")
    ends = {"low": F.min("component").over(together), "high": F.max("component").over(together)}
    left = cut_lineage(labelled.withColumns(ends).filter("low < high").drop("low", "high"))
    a = left.select("gram", *[F.col(c).alias(f"a_{c}") for c in ("cid", "n", "pos", "component")])
    b = left.select("gram", *[F.col(c).alias(f"b_{c}") for c in ("cid", "n", "pos", "component")])
    met = a.join(b, "gram").filter("a_component <> b_component AND struct(a_n, a_pos, a_cid) < struct(b_n, b_pos, b_cid)").filter(fitting(bounds))
    second = met.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()
    # Either end may have been called a, as that depends on the gram if the sizes are equal.
    tried = first.union(first.select("b", "a"))
    second = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return sets.select("doc_id", "mark", "n", "cid"), links.union(verified(cut_lineage(second), classes, docs, n, seed, bounds))


def near_copies(documents: DataFrame, words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents``.

    A document's set: distinct runs of ``words`` words (A-Z lower-cased, split at ASCII white space); with fewer words the
    whole sequence as one; none without words or text. Documents link when their sets' Jaccard similarity is at least
    ``percent`` / 100. ``component_id`` is the smallest doc_id reachable. Repeated rows are kept and equal, rows of one id with
    different texts are documents of their own, a null doc_id
    takes part only by its own row (it links with nothing), an empty table gives an empty table; other columns are not read.

    Equal sets are one class. All sets order their shingles in the same way, rarest first by counts over all documents that a
    table of fixed size holds (a shared counter changes the order, never the result). Only the shingles at the front are
    posted, joined, and the pairs filtered by size, position and counts per hash group; the rest is compared by the full
    sets. First each posting meets the set nearest to the centre of its gram and its neighbour in that order, which connects
    groups of copies with two pairs per posting; then all
    postings whose grams still span several components meet, so no link between different components is missed while the
    pairs inside a group are never listed.
    """
    return grouped(documents, words, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")


def grouped(documents: DataFrame, words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, n_shingles, component, component_id``: as ``near_copies``, with the hash of a row's text, by which rows of
    one id are told apart, and a number for the component (null without words or id)."""
    docs = marked(documents, doc_id, text)
    known = docs.filter("key IS NOT NULL")
    sets, links = similar_sets(known, words, Bounds(percent))
    found = components(cut_lineage(links)).withColumnRenamed("node", "cid")
    rows = sets.filter("n > 0").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    members = sets.filter("n > 0").select("cid").distinct().join(found, "cid", "left").select("cid", F.coalesce("component", "cid").alias("component")).join(least, "component")
    # Classes, not rows, are joined to their components, so a large class costs one row here.
    out = sets.join(members.select("cid", "component", "component_id"), "cid", "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).alias("component"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    none = F.lit(None).cast("long")
    return out.union(lone_rows(docs, words).select("doc_id", none, "n_shingles", none, "component_id"))


def all_links(docs: DataFrame, n: int, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """(key, n, cid) of every document, and all links (a, b), a < b, between cids whose sets are similar.

    All postings of a gram meet. Those of a gram with more than ``BLOCK`` are dealt into blocks by class, and each pair of
    blocks is a key of its own, so a common gram does not land in one task.
    """
    seed, sets, classes, shared = prepared(docs, n, bounds)
    common = shared.groupBy("gram").count().filter(F.col("count") > BLOCK).select("gram", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = shared.join(common, "gram", "left").fillna(1, ["blocks"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = cut_lineage(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    side = lambda to, i, j: dealt.select("gram", F.col("own").alias(i), F.col("other").alias(j), *[F.col(c).alias(f"{to}_{c}") for c in ("cid", "n", "pos")])
    met = side("a", "i", "j").join(side("b", "j", "i"), ["gram", "i", "j"]).filter("struct(a_n, a_pos, a_cid) < struct(b_n, b_pos, b_cid)").filter("a_cid <> b_cid").filter(fitting(bounds))
    # Either end may have been called a, as that depends on the gram if the sizes are equal.
    pairs = met.select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()
    return sets.select("doc_id", "n", "cid"), cut_lineage(verified(cut_lineage(pairs), classes, docs, n, seed, bounds))


def linked(documents: DataFrame, words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links of the join, also those inside a component: ``doc_id, n_shingles, n_links`` of every row, and ``a, b``.

    Sets and links are those of ``near_copies``. ``n_links`` is the number of other documents (distinct ids) that a document
    links with. ``a`` and ``b`` are the smallest ids of two classes of different sets that link; documents of one class link with
    each other and with all that their class links with, which is not listed by id. The pairs are listed, so the work grows
    with the square of a group of different near copies; ``near_copies`` is the cheap form, without counts and pairs.
    """
    docs = marked(documents, doc_id, text)
    sets, found = all_links(docs.filter("key IS NOT NULL"), words, Bounds(percent))
    classes = cut_lineage(sets.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.countDistinct("doc_id").alias("size")))
    ends = found.select("a", "b").union(found.select("b", "a")).toDF("cid", "partner")
    sizes = classes.select(F.col("cid").alias("partner"), "size")
    met = ends.join(sizes, "partner").groupBy("cid").agg(F.sum("size").alias("met"))
    counts = classes.join(met, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("met", F.lit(0))).alias("links"))
    rows = sets.join(counts, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    rows = rows.union(lone_rows(docs, words).select("doc_id", "n_shingles", F.lit(0).cast("long")))
    name = lambda end: classes.select(F.col("cid").alias(end), F.col("least").alias(f"{end}_id"))
    pairs = found.join(name("a"), "a").join(name("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return rows, pairs


def lone_rows(docs: DataFrame, words: int) -> DataFrame:
    """Rows without a doc_id: only the size of their set."""

    def count(batches):
        for batch in batches:
            sizes = [len(shingles(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(0)], names=["doc_id", "n_shingles", "component_id"])

    return docs.filter("key IS NULL").mapInArrow(count, "doc_id LONG, n_shingles LONG, component_id LONG")
