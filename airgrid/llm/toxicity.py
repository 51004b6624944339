"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and windows that tell quotation from abuse."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.batches import small

FIT_ROWS = 6000  # labelled rows of either class that a fit uses, those with the smallest hash of their id
TERMS = 3000  # of a lexicon, the strongest
STEMS = range(4, 9)  # lengths of word beginnings that may be terms
EVIDENCE = 24.0  # least log-likelihood ratio of a term
WINDOW = 12  # words of a context window
MISSPELLED = 0.8  # weight of a misspelled term against the term itself
FEATURES = 4
KEPT_WORDS = 100_000
OPENING, CLOSING = "«“„‹‘\"", "»”›’“\""
PARTNERS = {"»": "«", "”": "“„", "“": "„“", "›": "‹", "’": "‘", '"': '"'}  # the marks that a closing mark ends
EDGES = "\"'“”„«»‹›‘’()[]{}<>.,;:!?…*_~-#$%&+=|/\\"


def allowed(term: str) -> int:
    """Misspellings a term may have: none in short ones, one from 5 letters on, two from 10 letters on; none in stems."""
    return 0 if term.endswith("*") else (len(term) >= 5) + (len(term) >= 10)


class Lexicon:
    """A trie of terms (``stem*`` stands for all words that begin so) run side by side with the Levenshtein automata of all terms.

    A state holds the trie nodes that a word's letters so far can have led to, with the fewest errors for each; the states and
    their steps are made when a word first needs them and kept, so a word costs a table lookup per letter up to the point
    where no term is left.
    """

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.errors = [0]  # the most that any term below a node allows
        self.weights = weights
        for t in sorted(weights):
            node = 0
            for c in t.rstrip("*"):
                self.errors[node] = max(self.errors[node], allowed(t))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.errors.append(0)
                node = self.children[node][c]
            self.errors[node] = max(self.errors[node], allowed(t))
            if self.term[node] is None or self.weights[self.term[node]] < weights[t]:
                self.term[node] = t
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.stem: list[tuple[str, int] | None] = []  # the best stem complete in a state
        self.start = self.number({0: 0})

    def number(self, reached: dict[int, int]) -> int:
        todo = list(reached.items())
        while todo:  # letters of a term that the word leaves out
            node, e = todo.pop()
            if e < self.errors[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.errors[child] and reached.get(child, 9) > e + 1:
                        reached[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(reached)
            self.steps.append({})
            stems = [self.term[n] for n, e in reached.items() if e == 0 and self.term[n] and self.term[n].endswith("*")]
            self.stem.append((max(stems, key=self.weights.get), 0) if stems else None)
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.states[state].items():
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost <= self.errors[child]:
                    reached[child] = min(reached.get(child, 9), cost)
            if e < self.errors[node]:  # a letter too many
                reached[node] = min(reached.get(node, 9), e + 1)
        self.steps[state][letter] = out = self.number(reached) if reached else -1
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is taken for and the number of errors; the fewest errors, then the heaviest term."""
        state, stem = self.start, None
        for c in word:
            found = self.steps[state].get(c)
            state = self.step(state, c) if found is None else found
            if state < 0:
                return stem
            stem = self.stem[state] or stem
        ends = [(e, -self.weights[t], t) for n, e in self.states[state].items() if (t := self.term[n]) and not t.endswith("*") and e <= allowed(t)]
        best = min(ends, default=None)
        if best is None or stem and best[0]:
            return stem
        return best[2], best[0]


def quotation_marks(word: str) -> tuple[str, str]:
    """The mark that opens a quotation at a word and the one that closes it, or empty texts."""
    end = word.rstrip(".,;:!?")
    return word[0] if word[0] in OPENING else "", end[-1] if len(end) > 1 and end[-1] in CLOSING else ""


def paragraph_ends(text: str) -> list[int]:
    """For each paragraph, the place behind its last word."""
    return np.cumsum([len(p.split()) for p in re.split(r"\n\s*\n", text)]).tolist()


def quotations(special, text: str):
    """(place, whether quoted, entry) of entries that begin with (opening mark, closing mark), in order of place.

    Marks are paired over the whole text, so a quotation ends with its closing mark, however long it is; the latest open mark
    of the closing mark's kind is its partner, or of any kind if there is none (but for ’, which may be an apostrophe). An
    opening mark without a partner reaches to the end of its paragraph if the next one begins with such a mark again, else
    over ``4 * WINDOW`` words of its paragraph, so a stray mark does not reach over a text.
    """
    special = list(special)
    inside = [0] * (len(special) + 1)  # quotations that begin, less those that end, before an entry
    pending: dict[str, list[int]] = {}
    for k, (_, entry) in enumerate(special):
        opens, closes = entry[:2]
        if opens and not closes:
            pending.setdefault(opens, []).append(k)
        elif closes and not opens:
            fits = [p for mark, p in pending.items() if p and mark in PARTNERS[closes]] or [p for p in pending.values() if p and closes != "’"]
            if fits:
                inside[max(fits, key=lambda p: p[-1]).pop()] += 1
                inside[k] -= 1
    if any(pending.values()):
        ends, openings = np.array(paragraph_ends(text)), {at: entry[0] for at, entry in special if entry[0]}
        places = [at for at, _ in special]
        for k, mark in ((k, mark) for mark, left in pending.items() for k in left):
            end = int(ends[np.searchsorted(ends, places[k], side="right")])
            last = end if openings.get(end) == mark else min(end, places[k] + 4 * WINDOW + 1)
            inside[k] += 1
            inside[int(np.searchsorted(places, last))] -= 1
    depth = 0
    for k, (at, entry) in enumerate(special):
        depth += inside[k]
        yield at, bool(entry[0] or entry[1] or depth > 0), entry


@dataclass
class Model:
    """``weights`` by term, words too common in clean texts to be misspellings, and the coefficients of ``features``."""

    weights: dict[str, float]
    clean: set[str]
    coefficients: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        self.lexicon, self.model = Lexicon(model.weights), model
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def word(self, word: str) -> tuple:
        """(opening mark, closing mark, weight, misspelled) of a word with the marks around it, or () if it is nothing special."""
        bare = word.strip(EDGES)
        hit = self.lexicon.match(bare) if bare else None
        if hit and hit[1] and bare in self.model.clean:
            hit = None
        opens, closes = quotation_marks(word)
        return (opens, closes, self.model.weights[hit[0]] if hit else 0.0, bool(hit and hit[1])) if hit or opens or closes else ()

    def missing(self, word: str) -> tuple:
        found = self.old.get(word)
        if found is None:
            found = self.word(word)
        if len(self.new) >= KEPT_WORDS:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """1, then logs of the summed weights of meant and of quoted hits, and the share of the heaviest window.

        A misspelled hit weighs a little less. It counts as a plain one, as a fit may see few misspellings."""
        words = text.lower().split() if text else []
        get, missing = self.new.get, self.missing
        special = [(i, f) for i, w in enumerate(words) if (f := get(w) if w in self.new else missing(w))]
        sums, plain = [0.0, 0.0], []
        for at, quoted, (_, _, weight, misspelled) in quotations(special, text or ""):
            if weight:
                weight *= MISSPELLED if misspelled else 1.0
                sums[quoted] += weight
                if not quoted:
                    plain.append((at, weight))
        heaviest, first, inside = 0.0, 0, 0.0
        for at, weight in plain:
            inside += weight
            while plain[first][0] <= at - WINDOW:
                inside -= plain[first][1]
                first += 1
            heaviest = max(heaviest, inside)
        return [1.0, *np.log1p(sums), heaviest / WINDOW]


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: crc32 of the id's digits divisible by 5, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def plain_words(text: str | None) -> set[str]:
    """The words of a text that are not quoted, without the marks around them."""
    marked = ((i, (*quotation_marks(w), w)) for i, w in enumerate((text or "").lower().split()))
    return {bare for _, quoted, (_, _, w) in quotations(marked, text or "") if not quoted and (bare := w.strip(EDGES))}


def terms_of(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def evidence(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Log-likelihood ratio of a term's counts against equal shares; below 0 for terms of clean texts."""
    total, p = 0.0, (pos + neg) / (all_pos + all_neg)
    for k, n in ((pos, all_pos), (neg, all_neg)):
        for x, share in ((k, p), (n - k, 1 - p)):
            total += x * np.log(x / (n * share)) if x else 0.0
    return 2 * total * (1 if pos * all_neg > neg * all_pos else -1)


def lexicon(counts: list[tuple[str, int, int]], all_pos: int, all_neg: int) -> dict[str, float]:
    """The strongest terms with the logs of their odds; a stem goes if a shorter one in it is kept.

    Words that a kept stem covers stay beside it, as only whole words take misspellings; the stem is their evidence."""
    odds = lambda p, n: float(np.log((p + 0.5) / (all_pos + 1)) - np.log((n + 0.5) / (all_neg + 1)))
    scored = [(evidence(p, n, all_pos, all_neg), t, odds(p, n)) for t, p, n in counts]
    ranked = [(e, t, w) for e, t, w in sorted(scored, key=lambda x: (-x[0], x[1]))[:TERMS] if w > 1.5]
    strong = {t: w for e, t, w in ranked if e >= EVIDENCE}
    stems = sorted((t for t in strong if t.endswith("*")), key=len)
    kept: dict[str, float] = {}
    for t in [*stems, *(t for t in strong if not t.endswith("*"))]:
        inside = [s for n in STEMS if (s := t.rstrip("*")[:n] + "*") in kept]
        if not inside or not t.endswith("*") and strong[t] > max(kept[s] for s in inside) + 0.7:
            kept[t] = min(strong[t], 5.0)
    # A stem that is nothing but the beginning of one term would only lose that term's misspellings.
    whole = [t for t in strong if not t.endswith("*")]
    for s in [s for s in kept if s.endswith("*")]:
        words = [t for t in whole if t.startswith(s[:-1])]
        if len(words) == 1 and strong[words[0]] >= strong[s] - 0.1:
            kept[words[0]] = min(strong[words[0]], 5.0)
            del kept[s]
    for _, t, w in ranked:
        if not t.endswith("*") and any(t[:n] + "*" in kept for n in STEMS if len(t) >= n):
            kept[t] = min(w, 5.0)
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns lexicon and coefficients from at most ``rows`` labelled documents of each class, none of them held out.

    Terms are counted where they are not quoted. Of documents that share their smallest five-word hash, as near copies do, one counts. A class without documents gives a
    model without terms. Null labels and ids are left out; of several labels of one id the largest counts.
    """
    known = labels.select("doc_id", "toxic").filter("toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    texts = documents.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").select("text", "toxic")

    def reduce_text(batches):
        for batch in small(batches):
            keys = []
            for text in batch.column(0).to_pylist():
                words = (text or "").lower().split()
                keys.append(min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["text", "toxic", "key"])

    sample = texts.mapInArrow(reduce_text, "text STRING, toxic INT, key LONG").groupBy("key", "toxic").agg(F.min("text").alias("text")).cache()
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    all_pos, all_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not all_pos or not all_neg:
        sample.unpersist()
        return Model({}, set(), np.array([3.0 if all_pos else -3.0, 0, 0, 0]))

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in small(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms_of(plain_words(text)):
                    sums.setdefault(t, [0, 0])[toxic] += 1
            if len(sums) > 300_000:
                yield count_rows(sums)
                sums = {}
        yield count_rows(sums)

    counts = sample.select("text", "toxic").mapInArrow(count, "term STRING, neg LONG, pos LONG").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).cache()
    # The log-likelihood ratio grows with the share of toxic texts, so this order keeps the strongest terms.
    candidates = counts.filter(f"pos >= 3 AND pos * {all_neg} > 4 * neg * {all_pos}").orderBy(F.desc(F.expr(f"pos / {all_pos}D - neg / {all_neg}D")), "term").limit(20 * TERMS).collect()
    weights = lexicon([(r.term, r.pos, r.neg) for r in candidates], all_pos, all_neg)
    clean = {r.term for r in counts.filter("neg >= 2 AND NOT endswith(term, '*')").orderBy(F.desc("neg"), "term").limit(20 * TERMS).select("term").collect()}
    counts.unpersist()
    model = Model(weights, clean - set(weights), np.zeros(FEATURES))
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = sample.select("text", "toxic").mapInArrow(measure, "x ARRAY<DOUBLE>, toxic INT").collect()
    sample.unpersist()
    model.coefficients = logistic(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float))
    return model


def count_rows(sums: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["term", "neg", "pos"])


_SCORERS: dict[str, Scorer] = {}


def known_scorer(name: str, sent) -> Scorer:
    """The scorer of this Python worker, whose words are kept between batches and tasks."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(sent.value)
    return _SCORERS[name]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` under ``row``, with ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on).

    Only the text is looked at, all of it; null and empty texts get the score of a text without hits. Repeated rows are
    scored each, an empty table gives an empty table.
    """
    sent, name = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def toxicity(texts):
        scorer = known_scorer(name, sent)
        x = np.array([scorer.features(t) for t in texts]).reshape(-1, FEATURES)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ sent.value.coefficients, -30, 30))))

    value = toxicity(F.col("text"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "text").withColumn("score", value).drop("text")
    return rows.select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
