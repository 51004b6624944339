"""Repeated passages against a plain version that keeps every string it has seen."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from airgrid.llm import repeats

DOCS = "doc_id LONG, text STRING, chunk STRING, kept INT"


def brute(rows, length):
    """Rows of equal id and text are one document; others of one id have to differ in no passage that matters here."""
    seen, out = set(), []
    done: dict = {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (key, text) not in done:
            data = (text or "").encode()
            gone = np.zeros(len(data), bool)
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                if s in seen:
                    gone[i : i + length] = True
                seen.add(s)
            left = bytes(np.frombuffer(data, "uint8")[~gone])
            spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
            done[key, text] = (key, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)
        out.append(done[key, text])
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefgéü"), int(rng.integers(2, 9)))) for _ in range(n))

    passages = [prose(int(rng.integers(12, 60))) for _ in range(8)]
    line = prose(25)[:110]
    out = [(None, passages[0]), (None, passages[0]), (0, None), (1, ""), (2, "short"), (3, passages[0][:99]), (4, passages[0][:100]), (5, passages[0][3:103]), (6, "a" * 1000), (7, "ab" * 400), (8, "a" * 99), (9, "a" * 100)]
    for i in range(10, 150):
        parts = [prose(int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 4)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(8))]
            a = int(rng.integers(0, 40))
            parts.insert(int(rng.integers(len(parts) + 1)), p[a : a + int(rng.integers(60, 240))])
        if i % 3 == 0:
            parts.insert(1, line)
        out.append((i, "".join(parts) if i % 2 else " ".join(parts)))
    for i in range(150, 190):
        text = list(out[int(rng.integers(20, 100))][1])
        for _ in range(int(rng.integers(0, 3))):
            text[int(rng.integers(len(text)))] = "X"
        out.append((i, "".join(text)))
    out += [(300, prose(9000) + line + prose(3000)), (301, prose(50)), (301, prose(50)), out[30], out[30], (-5, passages[3])]
    return out + [(400 + k, out[40][1]) for k in range(60)]


@pytest.mark.parametrize("chunk_bytes, bucket_bytes, hot", [(4 << 20, 16 << 20, 1 << 16), (3000, 20_000, 1 << 16), (3000, 20_000, 20), (500, 2000, 0)])
def test_remove_repeats(spark, rows, chunk_bytes, bucket_bytes, hot):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], DOCS).repartition(4)
    got = result(repeats.remove_repeats(docs, 100, chunk_bytes, bucket_bytes, hot))
    assert got == brute(rows, 100)
    assert sum(r[2] for r in got) > 10_000


@pytest.mark.parametrize("length", [1, 4, 9, 33])
def test_other_lengths(spark, rows, length):
    some = [(k, None if t is None else t[:700]) for k, t in rows[:60] if k is not None]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in some], DOCS).repartition(3)
    assert result(repeats.remove_repeats(docs, length, 2000, 5000, 50)) == brute(some, length)


def test_covers():
    for v, own in repeats.COVERS.items():
        assert sorted((a - b) % v for a in own for b in own if a != b) == list(range(1, v))


def test_names_over_blocks():
    cover = repeats.Cover(100)
    data = np.random.default_rng(0).integers(0, 256, 3 * repeats.BLOCK, dtype="uint8")
    a, b = repeats.BLOCK - 20, 2 * repeats.BLOCK + 77
    data[b : b + 44] = data[a : a + 44]
    at = np.array([5, a, a + 1, b, b + 1])
    names = cover.names(data, at, 44)
    assert names[1] == names[3] and len(set(names.tolist())) == 4


def test_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert result(repeats.remove_repeats(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], DOCS))) == [(1, 0, 0, 0, empty, b""), (2, 0, 0, 0, empty, b"")]
