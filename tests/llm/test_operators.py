"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.llm import cover_join, id_files, license_scan, mixing, ngram_join, packing, permutation_index, shards, toxicity, url_rules
from airgrid.llm.queries import tokenizer

DOCS = "doc_id LONG, text STRING, source STRING, size LONG, `rank` STRING"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = [None, "", "   \n\t", "One", "one", "one two three", "a\u00a0b  c\x1cd", "ÄÖ é <|endoftext|> x", "don't it's 12a 中文 字. foo-bar!!"]
    passage = words(rng, 60)
    for i in range(30):
        base = words(rng, int(rng.integers(8, 120))).split()
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            near = list(base)
            near[int(rng.integers(len(near)))] = f"new{rng.integers(9)}"
            out.append(" ".join(near))
        if i % 5 == 0:
            out.append(passage + " " + words(rng, 20))
    chain = words(rng, 100).split()  # each link changes a word more, so the ends differ by far more than neighbours
    for i in range(0, 40, 2):
        chain[i * 2] = f"c{i}"
        out.append(" ".join(chain))
    out.append(words(rng, 9000, 5000))
    out += [out[12]] * 25
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, None if i % 7 == 0 else f"s{i % 4}", -1, "x") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "w1 w2 w3 w4 w5 w6", "s1", 0, "y")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(ids, linked):
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(component[a], component[b])
            if component[a] != low or component[b] != low:
                component[a] = component[b] = low
                changed = True
    return component


def test_ngram_join(docs, texts, nothing):
    rows = ngram_join.near_copies(docs).collect()
    sets = {i * 3: shingle_set(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, linked)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id) == (2, None)
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert ngram_join.near_copies(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 7, 20, 63, 500])
def test_prefix_bounds(n):
    b = ngram_join.Bounds(75)
    assert n - b.prefix(n) + 1 == min(k for k in range(n + 1) if 100 * k >= 75 * n)  # the least overlap with any partner
    assert n - b.index_prefix(n) + 1 == min(k for k in range(n + 1) if 100 * k >= 75 * (2 * n - k))  # with one of the same size


def test_shared_only_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted((int(g), int(c) % 5, int(c)) for g, c in rng.integers(0, 12, (300, 2)))
    want = [(g, n, c) for g, n, c in sorted(set(rows)) if len({(x, y, z) for x, y, z in rows if x == g}) > 1]
    for cuts in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + cuts]], pa.int64()) for k in (0, 2, 1)] + [pa.array([0] * len(rows[i : i + cuts]), pa.int64())], names=["gram", "cid", "n", "pos"]) for i in range(0, 300, cuts)]
        got = [(a, c, b) for x in ngram_join.shared_only(iter(batches)) for a, b, c in zip(*(x.column(k).to_pylist() for k in (0, 1, 2)))]
        assert got == want, cuts


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40] * (1 + i % 3) + rng.normal(size=8) * 0.15], i % 3 if i % 11 else None) for i in range(300)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0, None] * 4, 1), (404, [float("inf")] * 8, 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 1)]
    return spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").withColumn("cell", F.lit(1)).withColumn("rep", F.lit("x")).repartition(4)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [2048, 12])
def test_cover_join(vectors, block, monkeypatch):
    monkeypatch.setattr(cover_join, "BLOCK", block)
    rows = {r.vec_id: r for r in vectors.collect()}
    fit = {i: np.array(r.embedding) / np.linalg.norm(r.embedding) for i, r in rows.items() if usable(r.embedding) and r.label is not None}
    linked = [(a, b) for a in fit for b in fit if a < b and rows[a].label == rows[b].label and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] >= 0.93]
    want, n = groups(rows, linked), Counter(x for p in linked for x in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_join.near_vectors(vectors).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in rows}
    assert cover_join.near_vectors(vectors.limit(0)).count() == 0


def test_cover_tree_finds_all_pairs():
    rng = np.random.default_rng(9)
    for spread in (0.05, 0.4, 3.0):
        x = rng.normal(size=(6, 5))[rng.integers(0, 6, 400)] + spread * rng.normal(size=(400, 5))
        x = np.vstack([x, x[:20]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        p, q = cover_join.Tree(x[:250]), cover_join.Tree(x[250:])
        found = np.zeros((250, len(x) - 250), int)
        for i, j, mask in cover_join.dual_traversal(p, q, False, 0.93):
            found[np.ix_(i, j)] += 1 if mask is None else mask
        assert (found == (x[:250] @ x[250:].T >= 0.93)).all()


def test_permutation_index(vectors, spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if usable(r.embedding)}
    got: dict[int, list] = {}
    for r in permutation_index.neighbours(vectors, vectors.filter("vec_id % 5 = 0"), k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i, v in rows.items() if i % 5 == 0}
    for i, found in got.items():
        best = sorted((-float(v @ rows[i]), j) for j, v in rows.items() if j != i and len(v) == len(rows[i]))[:6]
        assert [f[0] for f in found] == list(range(1, len(best) + 1))
        assert np.allclose([f[2] for f in found], [-b[0] for b in best], rtol=1e-13)
        assert {f[1] for f in found if -f[2] < best[-1][0] - 1e-9} == {j for s, j in best if s < best[-1][0] - 1e-9}
    assert permutation_index.neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("n", [300, 1000, 4000])
def test_permutation_index_recall(n):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 24)) * rng.uniform(0.5, 2, (n, 1))
    longest = float(np.linalg.norm(x, axis=1).max())
    pivots = permutation_index.choose_pivots(x[::9], 24, longest)
    shard = permutation_index.Shard(24, **permutation_index.build_shard(np.arange(n), x, pivots, longest, 21))
    hits = 0
    for q in range(0, n, n // 50):
        order = permutation_index.nearest_pivots(np.append(x[q], 0.0)[None], pivots)[0]
        hits += len({*shard.search(x[q], order, 20)[0]} & {*np.argsort(-(x @ x[q]))[:20]})
    assert hits / len(range(0, n, n // 50)) / 20 >= 0.95


def test_permutation_index_on_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.neighbours(df, df.filter("vec_id IN (1, 3)"), k=3).collect()]
    want = [(1, 1, 1, 5.0), (1, 2, 2, 2.0), (1, 3, 3, 1.0), (1, 1, 2, 10.0), (1, 2, 1, 5.0), (1, 3, 3, 5.0), (3, 1, 1, 5.0), (3, 2, 2, 2.0), (3, 3, 1, 1.0)]
    assert sorted(got) == sorted(want)


def test_cover_join_on_odd_ids_and_lengths(spark):
    big = [1e200, 2e200, 3e200]
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (6, [1.0, 0.01, 0.0], 1), (7, [0.01, 1.0, 0.0], 1), (None, [0.0, 0.0, 1.0], 1), (None, [0.0, 0.01, 1.0], 1), (8, [0.0, 0.0, 2.0], 1),
            (9, big, 1), (10, [x * 1.01 for x in big], 1), (11, [1e-300, 2e-300, 3e-300], 1), (None, [-1.0, 0.0, 0.0], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_join.near_vectors(df).collect()), key=str)
    want = [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (None, 2, 8, None), (None, 2, 8, None), (8, 2, 8, True), (9, 2, 9, True), (10, 2, 9, False), (11, 2, 9, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted([(a, b, c, False if d is None else d) for a, b, c, d in want], key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_ngram_join_on_repeated_ids(spark, parts):
    from airgrid.llm import stages

    rng = np.random.default_rng(12)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    near = b.replace(b.split()[20], "other", 1)
    rows = [(1, a, "x"), (1, b, "x"), (2, near, "x"), (5, c, "x"), (5, d, "x"), (6, words(rng, 30), "x"), (7, c, "x"), (8, "", "x"), (8, "", "x"), (None, a, "x"), (6, a, "y"), (6, a, "z")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, `so.urce` STRING").repartition(parts)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect())
    n = lambda t: len(shingle_set(t))
    assert got == Counter([(1, n(a), 1), (1, n(b), 1), (2, n(near), 1), (5, n(c), 5), (5, n(d), 5), (6, n(rows[5][1]), 6), (7, n(c), 5), (8, 0, 8), (8, 0, 8), (None, n(a), None), (6, n(a), 1), (6, n(a), 1)])
    kept = Counter((r.doc_id, r.text) for r in stages.without_near_copies(docs).collect())
    assert kept == Counter([(1, a), (1, b), (5, c), (5, d), (6, rows[5][1]), (8, ""), (8, ""), (None, a)])


def test_groups_of_equal_texts_lie_in_one_shard(spark):
    rng = np.random.default_rng(3)
    texts = [words(rng, int(rng.integers(3, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(i * 3 + k, t) for i, t in enumerate(texts) for k in range(3)], "doc_id LONG, text STRING").repartition(5)
    rows = shards.shard(docs, shards=7).collect()
    assert all(len({r.shard for r in rows if r.text == t}) == 1 for t in texts) and len(rows) == 600
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert len(size) == 7 and max(size.values()) - min(size.values()) <= 2 * 3 * max(r["size"] for r in rows)
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_id_files_in_order_of_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(id_files, "FILE_BLOCKS", 2)
    monkeypatch.setattr(id_files, "BLOCK_IDS", 1 << 20)
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(60)], "doc_id LONG, text STRING").repartition(6)
    rows = sorted(id_files.round_trip(docs, tokenizer("word_bpe_49k.json")).collect())
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])


def test_columns_with_dots_in_their_names(spark, docs):
    from airgrid.llm import stages

    odd = docs.withColumnRenamed("rank", "a.b").filter("length(text) < 300 OR text IS NULL")
    labels = spark.createDataFrame([(i * 3, 0, int(i % 4 == 0)) for i in range(30)], "doc_id LONG, quality INT, toxic INT")
    assert stages.without_toxic(odd, labels).columns == odd.columns and mixing.take(odd).columns == odd.columns
    assert mixing.mix(odd).count() == odd.count()


RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.b.org", "/es/x", "allow"), ("b.org", "/es/xyzuvw", "block"), ("net", "", "block"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("net", "", "allow")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in RULES if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rng = np.random.default_rng(1)
    hosts = ["org", "example.org", "www.EXAMPLE.org", "a.b.org", "x.a.b.org", "b.org", "xorg", "o-rg.com", "com", "shop.com", "net", "a.net", "", "a..org", "org.", "ÄB.org:80"]
    paths = ["", "/", "/es/", "/es/xyz", "/es/xyzuvw/1", "/en/1", "/en/12", "/en/2", "/fr/", "/fr", "/de/a?x=/fr/", "#/de/", "?/es/", "/es/\U0010ffff", "/ES/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "no scheme/es/", "://", "a://b://c/es/"]
    rows = [(i, u, "z") for i, u in enumerate(urls)] + [(3, urls[3], "z")] * 3 + [(None, "http://org/", "q")] + [(7, "http://org/es/hot", "q")] * 50
    rows = [rows[i] for i in rng.permutation(len(rows))]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, host STRING")
    rules = spark.createDataFrame(RULES, "host STRING, path STRING, verdict STRING")
    got = url_rules.judge(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i, u, *judged(u)) for i, u, _ in rows)
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_shards(docs, texts, nothing):
    rows = shards.shard(docs, shards=4, slices=3).collect()
    assert Counter((r.doc_id, r.text, r["size"]) for r in rows) == Counter((r.doc_id, r.text, len((r.text or "").encode()) + 1) for r in docs.collect())
    by = {s: [r for r in rows if r.shard == s] for s in range(4)}
    for s in by:
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
    size = [sum(r["size"] for r in by[s]) for s in by]
    longest = max(r["size"] for r in rows)
    assert max(size) - min(size) <= 2 * longest
    small = shards.shard(docs.filter(F.length("text") < 400), shards=4, slices=2).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert max(r.n for r in small) - min(r.n for r in small) <= 900
    assert shards.shard(nothing).count() == 0
    copies = docs.filter("doc_id = 36").limit(1).select(F.explode(F.expr("sequence(1L, 400L)")).alias("doc_id"), "text")
    n = [r["count"] for r in shards.shard(copies, shards=4).groupBy("shard").count().collect()]
    assert len(n) == 4 and max(n) - min(n) <= 4
    assert shards.shard(docs.filter("doc_id IN (0, 9)"), shards=4).count() == 2


def encoded(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_packing(docs, nothing):
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=256).collect()
    want = {r.doc_id: encoded("byte_bpe_50k.json", r.text, 0) for r in docs.collect()}
    copies = Counter(r.doc_id for r in docs.collect())
    pieces: dict = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and want[r.doc_id][r.start : r.start + r.length] == ids
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for key, found in pieces.items():
        n = len(want[key])
        starts = [0, *range((n - 1) % 256 + 1, n, 256)]
        assert Counter(found) == Counter({(k, a, b - a): copies[key] for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))})
    assert set(pieces) == set(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256
    room = [256] * len(rows)  # best fit, piece by piece
    for length in sorted((r.length for r in rows), reverse=True):
        room[min((r, i) for i, r in enumerate(room) if r >= length)[1]] -= length
    assert len(sequences) == sum(r < 256 for r in room)
    assert packing.pack(nothing, tokenizer("byte_bpe_50k.json")).count() == 0


def test_best_fit_over_counts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 40, int(rng.integers(1, 200)))
        segments, n = packing.best_fit(dict(Counter(map(int, lengths))), 50)
        room = [50] * len(lengths)  # the same rule, document by document
        for length in sorted(map(int, lengths), reverse=True):
            fit = min((r, i) for i, r in enumerate(room) if r >= length)
            room[fit[1]] -= length
        assert n == sum(r < 50 for r in room)
        held: dict = {}
        for length, rank, count, first, each, offset in segments:
            for i in range(count):
                held.setdefault(first + i // each, []).append((offset + i % each * length, length))
        assert sorted(x[1] for s in held.values() for x in s) == sorted(lengths) and len(held) == n
        for s in held.values():
            s.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[0][0] == 0 and sum(s[-1]) <= 50


def test_id_files(docs, nothing, tmp_path):
    rows = id_files.round_trip(docs, tokenizer("word_bpe_49k.json")).orderBy("start").collect()
    want = Counter((r.doc_id, tuple(encoded("word_bpe_49k.json", r.text, 2))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert id_files.round_trip(nothing, tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("top", [1, 200, 300, 70_000, 20_000_000])
def test_id_blocks(top):
    rng = np.random.default_rng(top)
    ids = [rng.integers(0, top, n).astype("<u4") for n in (0, 1, 5, 4000, 3)]
    block = memoryview(id_files.encode_block([4, None, 6, -7, 2**60], [x.tobytes() for x in ids]) * 2)
    found = list(id_files.heads(block))
    assert len(found) == 2
    keys, null, n, flat = id_files.decode_block(block, *found[1])
    assert keys.tolist() == [4, 0, 6, -7, 2**60] and null.tolist() == [0, 1, 0, 0, 0] and n.tolist() == [0, 1, 5, 4000, 3]
    assert flat.tolist() == np.concatenate(ids).tolist()


def test_mixing(docs, nothing):
    rows = mixing.mix(docs, block=16).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    by: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.row.source, []).append(r)
    total = sum(r["size"] for r in rows)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    goal = mixing.targets(sizes, [[5, 2, 1][i % 3] for i in range(len(order))])
    assert abs(sum(goal) - total) < 1e-6
    for s, size, g in zip(order, sizes, goal):
        assert {(r.source_size, round(r.target, 6)) for r in by[s]} == {(size, round(g, 6))}
        assert abs(sum(r.taken for r in by[s]) - g) <= 2 * 16
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3), block=16).collect()))
    mixed = mixing.take(docs, block=16)
    assert mixed.columns == docs.columns
    got: Counter = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").split())
        assert r.text in {x.text for x in docs.collect() if x.doc_id == r.doc_id} or any(r.text in (x.text or "") for x in docs.collect() if x.doc_id == r.doc_id)
    want: Counter = Counter()
    for r in rows:
        want[r.doc_id] += r.taken
    odd = {r.doc_id for r in docs.collect() if r.text and re.search("[\u00a0\x1c]", r.text)}
    assert {k: v for k, v in got.items() if k not in odd} == {k: v for k, v in want.items() if v and k not in odd}
    assert mixing.mix(nothing).count() == 0 and mixing.take(nothing).count() == 0


def test_targets_stop_at_three_times():
    goal = mixing.targets([10, 1000, 1000], [5.0, 2.0, 1.0])
    assert goal[0] == 30 and abs(sum(goal) - 2010) < 1e-9 and abs(goal[1] - 2 * goal[2]) < 1e-9
    assert mixing.targets([0, 0], [5.0, 2.0]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_highest_quotients():
    rng = np.random.default_rng(8)
    for _ in range(50):
        votes, seats = rng.uniform(0, 50, 6).tolist(), int(rng.integers(0, 90))
        most = rng.integers(5, 40, 6).tolist()
        own = [0] * 6
        for _ in range(min(seats, sum(most))):
            i = max((i for i in range(6) if own[i] < most[i]), key=lambda i: votes[i] / (2 * own[i] + 1))
            own[i] += 1
        assert mixing.sainte_lague(votes, seats, most) == own
        quotas = mixing.shard_quotas(votes, seats, most, 7)
        assert [sum(q[i] for q in quotas) for i in range(6)] == own and min(min(q) for q in quotas) >= 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_find_what_edit_distance_finds():
    rng = np.random.default_rng(6)
    letters = list("abcd")
    terms = {"".join(rng.choice(letters, int(rng.integers(3, 13)))): float(i) for i, _ in enumerate(range(60))}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        word = list(rng.choice(list(terms))) if rng.random() < 0.7 else list(rng.choice(letters, 6))
        for _ in range(int(rng.integers(0, 4))):
            at, what = int(rng.integers(len(word) + 1)), rng.integers(3)
            word[at : at + int(what != 1)] = [str(rng.choice(letters))] if what else []
        word = "".join(word)
        fits = [(edit_distance(word, t), -w, t) for t, w in terms.items() if edit_distance(word, t) <= toxicity.allowed(t)]
        best = min(fits, default=None)
        assert lexicon.match(word) == (best and (best[2], best[0])), word
    stems = toxicity.Lexicon({"vequ*": 2.0, "trash": 3.0})
    assert stems.match("vequance") == ("vequ*", 0) and stems.match("veque") == ("vequ*", 0) and stems.match("veku") is None
    assert stems.match("trsh") == ("trash", 1) and stems.match("trashh") == ("trash", 1) and stems.match("tash") == ("trash", 1) and stems.match("stasis") is None


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, int(rng.integers(5, 80)), 900).split()
        bad = i % 4 == 0
        for _ in range(int(rng.integers(1, 4)) if bad else 0):
            w.insert(int(rng.integers(len(w) + 1)), str(rng.choice(["scoundrel", "nitwit", "rabble", "blockhead", f"zark{rng.integers(200)}x"])))
        if i % 4 == 1:  # quoted, not meant
            at = int(rng.integers(len(w) + 1))
            w[at:at] = ['"you', str(rng.choice(["scoundrel", "nitwit"])) + ',"', "wrote"]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (None, "scoundrel nitwit rabble", "en", "s"), (5002, "You are a scoundrell and a nitwiit, rabbble.", "en", "s"), (5003, "the zark77777x fell", "en", "s"), rows[0]]
    labels += [(1, 1, None), (None, 1, 1), (99999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, score STRING"), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")


def test_toxicity(toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert right / len(held) >= 0.97, (right, len(held))
    by = {r.doc_id: r for r in rows}
    assert by[5000].predicted == by[5001].predicted == 0 and by[5000].score == by[5001].score
    assert by[None].predicted == by[5002].predicted == by[5003].predicted == 1
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


ODD = ["a  b", "x\n\ny", " a", "a ", "\na", "a\n", "a \nb", "a\n b", "a\tb", "été É́ naïve", "İ ß ẞ Σς", "a\u200bb", "a\u3000b", "\x00a b", "a\x85b", "hi!!! a.b c,.", "don't I'm 'tis", "$$$ x%%%", "\u0301a b"]


def test_kept_words_give_the_ids_of_whole_texts(texts):
    from airgrid.llm.tokens import WordIds

    name = "word_bpe_49k.json"
    kept = WordIds(tokenizer(name), kept=50)
    for text in [*filter(None, texts), *ODD]:
        assert np.frombuffer(kept.ids(text), "<u4").tolist() == encoded(name, text, 0)[:-1], text
    assert kept.ids(None) == kept.ids("") == b""


@pytest.mark.parametrize("special", [True, False])
def test_merges_by_rank_give_the_ids_of_the_library(texts, special):
    from airgrid.llm.tokens import ByteIds

    own = ByteIds(tokenizer("byte_bpe_50k.json"), special)
    rng = np.random.default_rng(6)
    kinds = [range(32, 127), range(0, 0x250), range(0x370, 0x3000), range(0x3000, 0xD800), range(0x1F300, 0x1FB00), (9, 10, 13, 32, 0x85, 0xA0, 0x2003)]
    mixed = ["".join(chr(int(c)) for k in rng.integers(0, len(kinds), 6) for c in rng.choice(list(kinds[k]), int(rng.integers(1, 12)))) for _ in range(2000)]
    vocabulary = [own.tokenizer.decode([i]) for i in range(own.tokenizer.get_vocab_size())]
    for text in [*filter(None, texts), *ODD, "<|endoftext|> x<|endoftext|>", *mixed, *vocabulary, "x" * 5000, "ab c" * 3000]:
        assert own.tokens(text) == own.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert own.merge and own.ids(None) == own.ids("") == b""


def license_words(text):
    return [w for x in (text or "").encode().lower().split() if (w := x.strip(license_scan.EDGES))]


def license_shingles(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def licensed(text, templates):
    """Templates of which some stretch as long as a window holds enough; and those of which half a window does."""
    found = license_shingles(license_words(text))
    sure, possible = set(), set()
    for name, t in templates.items():
        s = set(license_shingles(license_words(t)))
        if not s:
            continue
        step = license_scan.step(len(s))
        for names, width in ((sure, step + 1), (possible, 2 * step)):
            if any(len(s & set(found[i : i + width])) >= 0.75 * len(s) for i in range(len(found))):
                names.add(name)
    return sure, possible


def test_license_scan(spark, texts):
    rng = np.random.default_rng(12)
    notices = list(license_scan.NOTICES.items())
    rows = []
    for i in range(120):
        name, notice = notices[i % len(notices)]
        body = notice.split()
        for _ in range(i % 3 if len(body) > 25 else 0):  # a word changed takes five shingles away
            body[int(rng.integers(len(body)))] = "changed"
        around = words(rng, int(rng.integers(0, 300))).split()
        at = int(rng.integers(len(around) + 1))
        rows.append((i, " ".join(around[:at] + ["//"] + body + around[at:]), "x", "y"))
    rows += [(500 + i, t, "x", "y") for i, t in enumerate(texts)] + [rows[3], rows[3], (None, rows[4][1], "x", "y"), (900, "MIT License.", "x", "y"), (901, words(rng, 30_000) + " " + notices[3][1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, license STRING, first_word STRING")
    got: dict = {}
    found = license_scan.scan(docs).collect()
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.license)
        assert 0.75 <= r.containment <= 1 and r.first_word < r.end_word
    for key, text, *_ in rows:
        sure, possible = licensed(text, license_scan.NOTICES) if key != 901 else ({notices[3][0]}, {notices[3][0]})
        assert sure <= got.get(key, set()) <= possible, (key, sure, got.get(key), possible)
    assert len(got) >= 100 and sum(r.doc_id == 3 for r in found) == 3 * sum(1 for r in set(found) if r.doc_id == 3)
    assert [r.license for r in license_scan.scan(docs.filter("doc_id = 900"), {"short": "mit license", "empty": ""}).collect()] == ["short"]
    assert license_scan.scan(docs.limit(0)).count() == 0 and license_scan.scan(docs, {}).count() == 0
    place = next(r for r in found if r.doc_id == 901)
    assert place.end_word == len(license_words(rows[-1][1]))


def test_license_bands():
    for n in (1, 2, 8, 30, 400):
        assert 1 - (1 - license_scan.least_similarity(n)) ** license_scan.bands_needed([n]) >= 1 - license_scan.MISS


def test_default_licenses_cover_the_usual_families(spark):
    own = license_scan.standard()
    bodies = {n: b.replace(license_scan.GAP, "Some Body and others") for n, b in own.items()}
    several = bodies["BSD-2-Clause"] + "\n" + bodies["BSD-3-Clause"]
    lines = {
        "released under the GNU General Public License, version 2.": {"GPL-2.0 notice"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0 notice"},
        "Published under the LGPLv3.": {"LGPL-3.0 notice"},
        "is released under the terms of the GNU\n * Lesser General Public License v2.1 or": {"LGPL-2.1 notice"},
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0 notice"},
        "This project is licensed under the MIT License": {"MIT notice"},
        "the thing is licensed under the MITRE rules": set(),
        "/* SPDX-License-Identifier: (MIT OR apache-2.0) AND 0BSD */ AND x": {"SPDX MIT", "SPDX Apache-2.0", "SPDX 0BSD"},
        "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\nint x": {"SPDX GPL-2.0-only", "SPDX Linux-syscall-note"},
    }
    texts = [*bodies.values(), several, *("one two " + x for x in lines)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = [set() for _ in texts]
    for r in license_scan.scan(rows).collect():
        got[r.doc_id].add(r.license)
    for found, name in zip(got, bodies):  # the text itself, and no other text or header of its family
        others = {n for n in found & set(own) if n.endswith(" header") == name.endswith(" header")}
        assert others == {name}, (name, found)
    assert {"BSD-2-Clause", "BSD-3-Clause"} <= got[len(bodies)] and "BSD-4-Clause" not in got[len(bodies)]
    assert got[len(bodies) + 1 :] == list(lines.values())


def test_misspellings_of_terms_with_inflections():
    counts = [("idiot", 100, 0), ("idiots", 60, 0), ("idio*", 150, 0), ("idiot*", 150, 0), ("stupid", 80, 0), ("stupidity", 50, 0), ("stup*", 120, 0), ("stupidly", 4, 0), ("table", 3, 100)]
    lexicon = toxicity.Lexicon(toxicity.lexicon(counts, 1000, 1000))
    for word, term in {"1diot": "idiot", "iidiot": "idiot", "idots": "idiots", "sutpidity": None, "stpid": "stupid", "sstupidity": "stupidity", "5tupidly": "stupidly", "tablet": None}.items():
        found = lexicon.match(word)
        assert found == (term and (term, 1)), (word, found)
    assert lexicon.match("idiot") == ("idiot", 0) and lexicon.match("idiotic") == ("idio*", 0)


def test_quotations_end_with_their_marks():
    filler = " ".join(f"w{i}" for i in range(70))
    cases = {  # text: whether each "idiot" is quoted
        f'he said "idiot {filler} idiot {filler} end" and idiot': [True, True, False],
        f"“{filler} idiot\n\n{filler} idiot” idiot": [True, True, False],
        f"«{filler} “idiot” {filler} idiot» idiot": [True, True, False],
        f'"first {filler} idiot\n\n"second {filler} idiot" idiot': [True, True, False],
        f'"stray idiot {filler} idiot': [True, False],
        '"stray mark\n\nidiot "quoted idiot" idiot': [False, True, False],
        "“the dogs’ idiot” idiot": [True, False],
        '„du idiot" idiot': [True, False],
        f'"{filler} "one" idiot" idiot': [True, False],
        "idiot 5\" idiot": [False, False],
    }
    for text, want in cases.items():
        marked = [(i, (*toxicity.quotation_marks(w), w)) for i, w in enumerate(text.split())]
        assert [q for _, q, (_, _, w) in toxicity.quotations(marked, text) if w.strip(toxicity.EDGES) == "idiot"] == want, text
    text = next(iter(cases))
    assert "idiot" in toxicity.plain_words(text) and "w40" not in toxicity.plain_words(text)
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 3.0}, set(), np.zeros(4)))
    assert scorer.features(text)[1:3] == pytest.approx([np.log1p(3.0), np.log1p(6.0)])
    assert scorer.features(None) == scorer.features("") == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("block", [1000, 3])
def test_all_links_of_the_ngram_join(docs, nothing, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = docs.collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    alike = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    partners = Counter(x for pair in alike for x in pair)
    least = {}
    for key in sorted(sets):
        least.setdefault(sets[key], key)
    counts, pairs = ngram_join.linked(docs)
    want = Counter((r.doc_id, len(shingle_set(r.text)), partners[r.doc_id] if r.doc_id is not None else 0) for r in rows)
    assert Counter(map(tuple, counts.collect())) == want
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in alike if sets[a] != sets[b] and least[sets[a]] == a and least[sets[b]] == b}
    assert any(partners[a] > 2 for a, _ in found)
    assert all(df.count() == 0 for df in ngram_join.linked(nothing))


def test_permutation_index_recall_of_full_shards():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3 * permutation_index.SHARD, 64))
    longest = float(np.linalg.norm(x, axis=1).max())
    pivots = permutation_index.choose_pivots(x[: permutation_index.SAMPLE], 64, longest)
    parts = [np.arange(i, len(x), 3) for i in range(3)]
    shards = [permutation_index.Shard(64, **permutation_index.build_shard(p, x[p], pivots, longest, 21)) for p in parts]
    assert all(permutation_index.SHARE * len(s.vectors) + 20 * permutation_index.PER_RESULT < 0.2 * len(s.vectors) for s in shards)
    hits = 0
    for q in range(0, len(x), 400):
        order = permutation_index.nearest_pivots(np.append(x[q], 0.0)[None], pivots)[0]
        ids, scores, _ = (np.concatenate(c) for c in zip(*(s.search(x[q], order, 20) for s in shards)))
        hits += len({*ids[np.argsort(-scores)[:20]]} & {*np.argsort(-(x @ x[q]))[:20]})
    assert hits / 62 / 20 >= 0.9
