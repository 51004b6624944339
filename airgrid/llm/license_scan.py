"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import functools
import math
import re
import uuid
from importlib import resources

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.batches import small

SHINGLE = 5
LEAST = 0.75  # share of a template's shingles that a match has to hold
MISS = 0.0002  # a window that holds a match is not retrieved with at most this probability
SEGMENT = 8192  # words of a long text that are handled at a time
EDGES = b".,;:!?\"'()[]{}<>*#/-_="
GAP = "[...]"  # in a template: words that vary, no shingle reaches over it

# Notices as their licenses give them, shortened to the parts that do not vary. Whole texts and the headers of
# further licenses are in the folder licenses.
NOTICES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}

# Names in one-line notices, longest form first; a blank stands for any run of white space and comment marks.
V = r"(?:,? (?:version |ver\.? |v\.? ?)|-| )"
NAMES = {
    "Apache-2.0": rf"apache(?: software)?(?: licen[cs]e)?(?:{V}2(?:\.0)?)(?: licen[cs]e)?",
    "MIT": r"mit",
    "ISC": r"isc",
    "0BSD": r"(?:0bsd|zero-clause bsd|bsd zero[- ]clause)",
    "BSD-2-Clause": r"(?:(?:simplified|freebsd) bsd|bsd[- ]2[- ]clause|(?:2|two)[- ]clause bsd|bsd \(2[- ]clause\))",
    "BSD-3-Clause": r"(?:(?:new|modified|revised) bsd|bsd[- ]3[- ]clause|(?:3|three)[- ]clause bsd|bsd \(3[- ]clause\))",
    "BSD-4-Clause": r"(?:(?:original|old) bsd|bsd[- ]4[- ]clause|(?:4|four)[- ]clause bsd|bsd \(4[- ]clause\))",
    "BSD": r"bsd(?= (?:style )?licen[cs]e)",
    "{}GPL-{}": rf"(?:gnu )?(?P<kind>(?:affero|lesser|library) )?(?:general public licen[cs]e|gpl)(?: \((?:a|l)?gpl\))?{V}(?P<version>[123](?:\.[01])?)",
    "{}GPL-{} short": rf"(?:gnu )?(?P<kind>[al])gpl(?:{V}|v)?(?P<version>[123](?:\.[01])?)",
    "GPL-{}": r"(?:gnu )?gplv?(?P<version>[123](?:\.0)?)",
    "{}GPL": r"gnu (?P<kind>(?:affero|lesser|library) )?(?:general public licen[cs]e|gpl)(?=\s*(?:[.;)\n]|$))",
    "GFDL-{}": rf"(?:gnu )?free documentation licen[cs]e{V}(?P<version>1\.[123])",
    "MPL-{}": rf"(?:mozilla public licen[cs]e|mpl){V}(?P<version>[12](?:\.[01])?)",
    "EPL-{}": rf"(?:eclipse public licen[cs]e|epl){V}(?P<version>[12](?:\.0)?)",
    "CDDL-{}": rf"(?:common development and distribution licen[cs]e|cddl){V}(?P<version>1\.[01])",
    "EUPL-{}": rf"(?:european union public licen[cs]e|eupl){V}(?P<version>1\.[012])",
    "BSL-1.0": rf"boost software licen[cs]e(?:{V}1\.0)?",
    "Artistic-{}": rf"artistic licen[cs]e{V}(?P<version>[12](?:\.0)?)",
    "PSF-2.0": r"(?:python software foundation|psf)",
    "Zlib": r"zlib",
    "WTFPL": r"wtfpl",
    "Unlicense": r"unlicense",
    "CC0-1.0": r"(?:creative commons )?(?:cc0|cc zero)(?: 1\.0)?",
    "CC-{}-{}": r"(?:(?:creative commons|cc)[- ])(?P<parts>(?:by|attribution)(?:[- ]?(?:nc|sa|nd|non-?commercial|share-?alike|no-?deriv(?:ative)?s?(?: works)?))*)[- ](?P<version>[1234]\.[0-9])",
}
LEAD = r"(?<![\w-])(?:(?:licen[cs]ed|released|distributed|available|published|provided|covered|shared|used|usable|offered|issued|placed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:an? )?|(?:under|subject to) the terms (?:and conditions )?of (?:the )?(?:an? )?|licen[cs]e ?:(?:: osi approved ::)? ?(?:the )?)"


def spaced(pattern: str) -> str:
    """The pattern with its blanks outside of sets as runs of white space and comment marks."""
    return re.sub(r"\[[^\]]*\]|( )", lambda m: r"(?:\s[\s*#/;]*)" if m[1] else m[0], pattern)


@functools.cache
def phrases() -> list[tuple[str, re.Pattern]]:
    return [(name, re.compile(spaced(LEAD + pattern) + r"(?![\w-]|\.\w)")) for name, pattern in NAMES.items()]


SPDX = re.compile(r"spdx-license-identifier:[ \t]*", re.I)
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
VERSIONS = {"1": "1.0", "2": "2.0", "3": "3.0"}


def named(name: str, m: re.Match) -> str:
    """The license that a phrase names, with its kind and version filled in."""
    found = m.groupdict()
    version = VERSIONS.get(found.get("version"), found.get("version"))
    if name == "CC-{}-{}":
        parts = re.sub(r"[^a-z]", "", found["parts"])
        short = ["BY", *(s for s, words in (("NC", "nc|noncommercial"), ("SA", "sa|sharealike"), ("ND", "nd|noderiv")) if re.search(words, parts))]
        return name.format("-".join(short), version)
    kind = (found.get("kind") or " ")[0].strip().upper()
    return name.removesuffix(" short").format(*([kind] if name.startswith("{}") else []), version)


def lines(text: str) -> list[tuple[str, int, int]]:
    """(name, first letter, end) of the one-line notices and SPDX lines of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if not text.isascii() else text.lower()  # as many letters as before
    out = []
    if re.search(r"licen|under", low):
        taken: list[tuple[int, int]] = []
        for name, pattern in phrases():
            for m in pattern.finditer(low):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    taken.append(m.span())
                    out.append((f"{named(name, m)} notice", *m.span()))
    for m in SPDX.finditer(text):
        at, operand = m.end(), True
        while t := TOKEN.match(text, at):
            word = t[1]
            if word in "()":
                operand = operand if word == ")" else True
            elif operand:
                end = t.end() - (len(word) - len(word.rstrip(".:-")))
                out.append((f"SPDX {cased(text[t.start(1) : end])}", m.start(), end))
                operand = False
            elif word in ("AND", "OR", "WITH"):
                operand = True
            else:
                break
            at = t.end()
    return sorted(out, key=lambda x: x[1:])


@functools.cache
def standard() -> dict[str, str]:
    """Whole license texts and, under names that end in ``header``, the headers that their licenses ask for."""
    folder = resources.files("airgrid.llm") / "licenses"
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


@functools.cache
def spellings() -> dict[str, str]:
    return {n.lower(): n for n in standard()}


def cased(name: str) -> str:
    """SPDX ids do not depend on case; those of known texts are given in their usual one."""
    return spellings().get(name.lower(), name)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word: ASCII letters lower-cased, marks at its ends dropped; words that are nothing but marks do not count."""
    digest = xxhash.xxh3_64_intdigest
    found = [digest(w) for x in (text or "").encode().lower().split() if (w := x.strip(EDGES))]
    return np.array(found, "uint64")


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five words, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, "uint64")
    for i in range(size):
        out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i]
    return (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def least_similarity(shingles: int) -> float:
    """Least Jaccard similarity of a template and a window of its class that holds a match."""
    held = math.ceil(LEAST * shingles)
    return held / (window(shingles) + shingles - held)


def window(shingles: int) -> int:
    """Shingles of a window: two steps, so that a match of one step's length lies inside one window wherever it begins."""
    return 2 * step(shingles)


def step(shingles: int) -> int:
    """Windows of a class begin every so many shingles; there are four classes per doubling, so that few serve all templates."""
    octave = math.log2(max(1, shingles))
    size = math.ceil(2 ** (math.ceil(4 * octave - 1e-9) / 4) - 1e-9)
    return max(size, shingles)


def bands_needed(shingles: list[int]) -> int:
    """Bands of one row each, so many that a match is retrieved with a probability of at least 1 - MISS."""
    return max((math.ceil(math.log(MISS) / math.log(1 - least_similarity(n))) if least_similarity(n) < 1 else 1 for n in shingles), default=1)


class Templates:
    """Sets of shingles, their MinHash values per band, and the windows they need."""

    def __init__(self, texts: dict[str, str], own: bool = False):
        sets = {name: np.unique(np.concatenate([shingle_hashes(word_hashes(p)) for p in self.pieces(t)])) for name, t in sorted(texts.items())}
        self.sets = {n: s for n, s in sets.items() if len(s)}
        self.names = list(self.sets)
        self.own = own  # the default templates: rivals yield, and one-line notices and SPDX lines are read
        bodies = standard() if own else {}
        self.group = [("header" if n.endswith(" header") else "body") if n in bodies or own and n == "GPL-3.0 header" else None for n in self.names]
        self.offsets = {i: self.order(texts[n]) for i, n in enumerate(self.names) if self.group[i]}
        self.bands = bands_needed([len(s) for s in self.sets.values()])
        rng = np.random.default_rng(11)
        self.factors = rng.integers(0, 1 << 62, self.bands, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets.values()):
            self.classes.setdefault(step(len(s)), []).append(i)
        self.keys = {c: self.lookup(members) for c, members in self.classes.items()}
        self.least = {c: min(math.ceil(LEAST * len(self.sets[self.names[i]])) for i in members) for c, members in self.classes.items()}
        shingles = {c: np.unique(np.concatenate([self.sets[self.names[i]] for i in members])) for c, members in self.classes.items()}
        self.all = np.unique(np.concatenate([*shingles.values(), np.zeros(0, "uint64")]))
        self.member = np.array([np.isin(self.all, s, assume_unique=True) for s in shingles.values()])

    def order(self, text: str) -> np.ndarray:
        """Where each distinct shingle of a template stands in it, in order of hash; -1 if it stands there twice."""
        _, first, count = np.unique(np.concatenate([shingle_hashes(word_hashes(p)) for p in self.pieces(text)]), return_index=True, return_counts=True)
        return np.where(count == 1, first, -1)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The parts of a template between its gaps; with gaps, those without a shingle of their own go."""
        parts = text.split(GAP)
        return parts if len(parts) == 1 else [p for p in parts if len(word_hashes(p)) >= SHINGLE] or [""]

    def likely(self, shingles: np.ndarray) -> list[int]:
        """Classes of which a text holds as many shingles as its smallest template needs; in no other can be a match."""
        if not len(self.all):
            return []
        at = np.minimum(np.searchsorted(self.all, shingles), len(self.all) - 1)
        held = np.unique(at[self.all[at] == shingles])
        if not len(held):
            return []
        return [c for c, n in zip(self.classes, self.member[:, held].sum(1).tolist()) if n >= self.least[c]]

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        return ((shingles[:, None] ^ shingles[:, None] >> np.uint64(29)) * self.factors[None, :] >> np.uint64(32)).astype("uint32")

    def lookup(self, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (band, value) keys of the templates of a class, and the template of each."""
        values = np.stack([self.hashed(self.sets[self.names[i]]).min(0) for i in members])
        keys = (np.arange(self.bands, dtype="uint64") << np.uint64(32) | values).ravel()
        order = np.argsort(keys, kind="stable")
        return keys[order], np.repeat(members, self.bands)[order]

    def retrieved(self, shingles: np.ndarray):
        """(first shingle, end, template) of each window and template that agree in a band."""
        likely = self.likely(shingles)
        if not likely:
            return
        hashed = self.hashed(shingles)
        band = np.arange(self.bands, dtype="uint64") << np.uint64(32)
        for c in likely:
            keys, members = self.keys[c]
            starts = np.arange(0, len(shingles), c)
            blocks = np.minimum.reduceat(hashed, starts, axis=0)
            low = np.minimum(blocks, np.vstack([blocks[1:], blocks[-1:]]))  # a window is a block and the next one
            asked = band | low
            at = np.searchsorted(keys, asked)
            first = np.minimum(at, len(keys) - 1)
            rows, columns = np.nonzero(keys[first] == asked)
            seen = set()
            for r, b in zip(rows.tolist(), columns.tolist()):
                k = int(first[r, b])
                while k < len(keys) and keys[k] == asked[r, b]:
                    if (r, int(members[k])) not in seen:
                        seen.add((r, int(members[k])))
                        yield int(starts[r]), min(len(shingles), int(starts[r]) + 2 * c), int(members[k])
                    k += 1

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, word behind the last, containment) of each place that holds enough of a template."""
        words = word_hashes(text)
        shingles = shingle_hashes(words)
        longest = 2 * max(self.classes, default=1)
        found: dict[int, list[tuple[int, int, int]]] = {}
        tight: list[tuple[int, int, int, int, int]] = []  # (template, place in found, first, end, held) of those with rivals
        for a in range(0, len(shingles), SEGMENT):
            for x, y, t in self.retrieved(shingles[a : a + SEGMENT + longest]):
                own = self.sets[self.names[t]]
                mine = np.isin(shingles[a + x : a + y], own)
                held = len(np.unique(shingles[a + x : a + y][mine]))
                if held >= LEAST * len(own):
                    at = np.flatnonzero(mine) + a + x
                    places = found.setdefault(t, [])
                    if not self.group[t]:
                        places.append((int(at[0]), int(at[-1]) + 1, held))
                        continue
                    for place in self.occurrences(t, at, shingles[at], held):
                        tight.append((t, len(places), *place))
                        places.append(place)
        for t, k in self.beaten(tight):
            found[t][k] = None
        found = {t: kept for t, places in found.items() if (kept := [p for p in places if p])}
        out = []
        for t, places in found.items():
            merged: list[list[int]] = []
            for x, y, held in sorted(places):
                if merged and x < merged[-1][1]:  # overlapping windows saw the same place
                    merged[-1] = [merged[-1][0], max(y, merged[-1][1]), max(held, merged[-1][2])]
                else:
                    merged.append([x, y, held])
            size = min(SHINGLE, len(words))
            out += [(self.names[t], x, y + size - 1, held / len(self.sets[self.names[t]])) for x, y, held in merged]
        if self.own:
            out = self.with_lines(text, out)
        return sorted(out, key=lambda m: (m[1], m[0]))

    def occurrences(self, t: int, at: np.ndarray, shingles: np.ndarray, held: int) -> list[tuple[int, int, int]]:
        """(first, end, held) of each time that a window runs through a template; of the window if no run holds enough."""
        own = self.sets[self.names[t]]
        runs, top = [0], -1
        for i, o in enumerate(self.offsets[t][np.searchsorted(own, shingles)].tolist()):
            if 0 <= o < top - len(own) / 2:  # back to the beginning
                runs.append(i)
                top = o
            top = max(top, o)
        parts = [(a, b, len(np.unique(shingles[a:b]))) for a, b in zip(runs, [*runs[1:], len(at)])]
        return [(int(at[a]), int(at[b - 1]) + 1, n) for a, b, n in parts if n >= LEAST * len(own)] or [(int(at[0]), int(at[-1]) + 1, held)]

    def beaten(self, tight):
        """(template, place) of matches that lose their stretch to a rival, as BSD-2 in a text with the third clause of BSD-3.

        Of two the one wins whose shingles held outweigh those missing by more; so a clause counts as there if more than half of it is."""
        for t, k, x, y, held in tight:
            score = 2 * held - len(self.sets[self.names[t]])
            for u, _, v, w, other in tight:
                if u != t and self.group[u] == self.group[t] and min(y, w) - max(x, v) >= 0.8 * (y - x):
                    better = 2 * other - len(self.sets[self.names[u]])
                    if better > score:
                        yield t, k
                        break

    def with_lines(self, text: str | None, out: list) -> list:
        """The matches with the one-line notices and SPDX lines of a text, each notice once."""
        if not text:
            return out
        done, count, extra = 0, 0, []
        for name, start, end in lines(text):
            count += len(word_hashes(text[done:start])) if start > done else 0
            first = count if start >= done else len(word_hashes(text[:start]))
            done, count = max(done, start), max(count, first)
            extra.append((name, first, first + len(word_hashes(text[start:end])), 1.0))
        over = lambda m, n: m[1] < n[2] and n[1] < m[2]
        # A notice that lacks a part yields to a whole one of another license, as GPL 3 to GPL 2; one found twice counts once.
        kept = [m for m in out if m[3] == 1 or not m[0].endswith(" notice") or not any(over(m, n) and n[0] != m[0] and n[0].endswith(" notice") for n in extra)]
        return kept + [n for n in extra if not any(m[0] == n[0] and over(m, n) for m in kept)]


_LOADED: dict[str, Templates] = {}


def loaded(name: str, texts: dict[str, str], own: bool) -> Templates:
    """The templates of a scan, made once per Python worker."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Templates(texts, own)
    return _LOADED[name]


FOUND = "doc_id LONG, license STRING, first_word LONG, end_word LONG, containment DOUBLE"


def scan(documents: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, first_word, end_word, containment``: a row per place of a document that holds a license text.

    Words have their ASCII letters lower-cased and marks at their ends dropped. A place matches if it holds at least ``LEAST``
    of a template's distinct five-word shingles (a shorter template is one shingle and matches texts of just these words)
    within a window of twice the template's length, rounded up to one of four lengths per doubling. Windows overlap by half, so no place is cut.
    Windows and templates meet through MinHash bands, so many that a matching window is missed with a probability of at most
    ``MISS``; the containment is then counted exactly, so no row is wrong. Texts of any length are read to the end, in
    segments that overlap. Null and empty texts have no rows, repeated rows are scanned each, null ids stay null, an empty
    table gives an empty table; other columns are not read. The templates are a parameter and go to all tasks; ``GAP`` in one
    stands for words that vary.

    Without templates the scan knows ``NOTICES``, the texts and headers of ``standard()``, one-line notices that name a license
    of ``NAMES`` (rows ``... notice``) and SPDX lines (a row ``SPDX ...`` per id, whatever the id). Texts that differ in a
    clause or a version only, as those of BSD, the GPL and Creative Commons do, are rivals: a stretch is given to the one that
    explains more of it, both only if they do so equally well.
    """
    own = templates is None
    sent, name = documents.sparkSession.sparkContext.broadcast({**standard(), **NOTICES} if own else dict(templates)), uuid.uuid4().hex

    def find(batches):
        known = loaded(name, sent.value, own)
        for batch in small(batches):
            rows = [(key, *m) for key, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in known.matches(t.as_py())]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "license", "first_word", "end_word", "containment"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, FOUND)
