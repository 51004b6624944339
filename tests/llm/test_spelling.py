"""Spelling variants against a brute-force version."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from airgrid.llm import spelling

DOCS = "doc_id LONG, text STRING, word STRING, n INT"


def edits(a, b):
    """Whether one letter inserted, deleted or replaced makes one word of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, least=7, least_n=2, slips=31, times=10):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= least_n}
    near = {w: [v for v in n if edits(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (k, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, k in n.items()}


def result(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdeé×"), int(rng.integers(6, 12)))) for _ in range(60)]
    out = [(None, "Wonderful wonderful"), (1, None), (2, ""), (3, "  \n"), (4, "short words only"), (5, "ÀÉtoile ÀÉtoile Àétoile àéto1ile x" * 2)]
    for i in range(10, 400):
        w = list(base[int(rng.zipf(1.3)) % 60])
        for _ in range(int(rng.integers(0, 3))):
            k, how = int(rng.integers(len(w))), rng.integers(3)
            w[k : k + (how != 0)] = [] if how == 2 else [str(rng.choice(list("abcde")))]
        word = "".join(w)
        out.append((i, " ".join([word.upper() if i % 3 else word] * int(rng.integers(1, 4)) + [base[i % 60]] * 3)))
    # A chain of forms, each ten times as common as the one before.
    out += [(1000, "station " * 2000 + "stations " * 150 + "stationse " * 12), (1001, "abcdefg" * 5000 + " " + ("abcdefg" * 5000) + " " + "abcdefg" * 4999 + "abcdef " + "abcdefg" * 4999 + "abcdef")]
    out += [out[40]] * 30
    return out


def test_variants(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], DOCS).repartition(5)
    got, want = result(spelling.spelling_variants(docs)), brute(rows)
    assert got == want
    assert any(v[2] for v in want.values()) and any(v[2] and v[2] != v[4] for v in want.values())


@pytest.mark.parametrize("most", [1, 4, 10**6])
def test_hot_chunks_are_divided(spark, monkeypatch, most):
    """A prefix that all words share, and ends that all share; whatever the limit, the pairs stay."""
    monkeypatch.setattr(spelling, "MOST_PAIRS", most)
    words = [f"{'common' * 3}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{'ending' * 3}" for i in range(60)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaaa", "aabaaaa"]
    got = sorted((r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word STRING, n LONG")).collect())
    want = sorted((a, b) for a in words for b in words if edits(a, b) and (len(a) < len(b) or len(a) == len(b) and a < b))
    assert got == want


def test_ties_go_to_the_smaller_word(spark):
    rows = [(1, "nearone " * 1), (2, "zearone " * 20 + "aearone " * 20 + "nearone nearone")]
    got = result(spelling.spelling_variants(spark.createDataFrame([(k, t, "x", 0) for k, t in rows], DOCS), slips=None, times=5))
    assert got == brute(rows, slips=None, times=5) and got["nearone"][2] == "aearone"


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, "a", 1), (2, "", None, 2)], DOCS)).collect() == []
