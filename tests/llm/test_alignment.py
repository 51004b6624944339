"""Alignment of two tokenizers against a plain version with the libraries themselves."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from airgrid.llm import alignment
from airgrid.llm.queries import tokenizer
from airgrid.llm.tokens import byte_letters

DOCS = "doc_id LONG, text STRING, block STRING, n_a INT"
A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: x for x, c in byte_letters().items()}
    docs, linked = [], []
    for key, text in rows:
        ids_a = ids_b = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if any(b"".join(x) != (" " + text).encode() for x in (bytes_a, bytes_b)):
                ids_a = ids_b = []
        links, groups, i, j, at_a, at_b, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(ids_a):  # one step over the stretch to the next end of either side
            links.append((ids_a[i], ids_b[j]))
            to_a, to_b = at_a + len(bytes_a[i]), at_b + len(bytes_b[j])
            if to_a <= to_b:
                own[0].append(ids_a[i])
            if to_b <= to_a:
                own[1].append(ids_b[j])
            if to_a == to_b:
                groups.append(own)
                own = ([], [])
            if to_a <= to_b:
                i, at_a = i + 1, to_a
            if to_b <= to_a:
                j, at_b = j + 1, to_b
        text_of = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        docs.append((key, len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
        linked.append(links)
    n = Counter(p for own in linked for p in set(own))
    most = defaultdict(int)
    for (x, _), k in n.items():
        most[x] = max(most[x], k)
    return sorted(((*d[:5], sum(n[p] == most[p[0]] for p in own), sum(n[p] for p in own), d[5]) for d, own in zip(docs, linked)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    odd = [None, "", " ", "\n", "a", " lead", "trail ", "a  b", "tab\tx", "▁", "x▁y", "<|endoftext|> <s> </s> <unk> <0x0A>", "don't it's we'll", "字 中文。", "é  x　y", "a\x00b\x1cc", "‍👩‍👩‍👧 \U0001F600", "12345 3.14 x1y2", "line\nline \n two\r\nthree"]
    out = list(enumerate(odd))
    parts = ["the", "alignment", "Über", "naïve", "ción", ",", "-", "  ", "\n", "'s", "99", "tokenizers", "ğ", "…", "antidisestablishmentarianism"]
    for i in range(100, 220):
        out.append((i, " ".join(rng.choice(parts, int(rng.integers(1, 40))))))
        letters = [chr(int(c)) for c in rng.choice([*range(32, 127), 0xE9, 0x2013, 0x4E2D, 0x1F600, 10, 9], 60)]
        out.append((i + 1000, "".join(letters)))
    out += [(9000, " ".join(rng.choice(parts, 30_000))), (9001, "x" * 70_000), (None, "the same"), (7, "the same"), (7, "the same")]
    return out + [(k + 20_000, "the alignment of ción") for k in range(50)]


def test_cross_align(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", -1) for k, t in rows], DOCS).repartition(5)
    assert result(alignment.cross_align(docs, A, B)) == brute(rows)


@pytest.mark.parametrize("together, links", [(1, 500), (2, 5000)])
def test_many_blocks(spark, rows, together, links):
    docs = spark.createDataFrame([(k, t, "x", -1) for k, t in rows], DOCS).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert result(alignment.cross_align(docs, A, B, links, together)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    for docs in (1, 7, 16, 300):
        keys = np.unique(rng.integers(0, 40, 900) << 24 << 20 | rng.integers(0, docs, 900))
        pair, slot, times = keys >> 20, keys & (1 << 20) - 1, rng.integers(1, 40, len(keys))
        got = []
        for _, pairs, n, listed, bitmaps, planes in alignment.index_block(pair, slot, times, docs):
            s, t = alignment.read_block(n, listed, bitmaps, planes, docs)
            got += zip(np.repeat(pairs, n).tolist(), s.tolist(), t.tolist())
        assert sorted(got) == sorted(zip(pair.tolist(), slot.tolist(), times.tolist()))


def test_nothing(spark):
    assert alignment.cross_align(spark.createDataFrame([], DOCS), A, B).collect() == []
    assert result(alignment.cross_align(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], DOCS), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
