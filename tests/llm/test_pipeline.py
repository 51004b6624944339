"""Each stage of the pipeline against a brute-force version, on what the stage before kept."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from test_operators import encoded, groups, shingle_set

import corpus_pipeline
from airgrid.llm import mixing, toxicity
from airgrid.llm.queries import ORACLES, QUERIES
from airgrid.session import cut_lineage

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SMALL)))
    return out


def test_toxic_documents_go(spark, stages):
    docs, kept = stages[0], stages[1]
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    clean = [r for r in docs.collect() if float(np.dot(scorer.features(r.text), model.coefficients)) < 0]
    assert Counter(map(tuple, clean)) == Counter(map(tuple, kept.collect())) and len(clean) > 100


def test_one_of_each_group_stays(stages):
    before, after = stages[1].collect(), stages[2].collect()
    sets = {r.doc_id: shingle_set(r.text) for r in before}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    component = groups(sets, linked)
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if component[r.doc_id] == r.doc_id)


def test_sources_meet_their_targets(stages):
    count = lambda rows: sum((Counter({r.source: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))}) for r in rows), Counter())
    before, after = count(stages[2].collect()), count(stages[3].collect())
    order = sorted(before, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([before[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    assert stages[3].columns == stages[2].columns
    for s, g in zip(order, goal):
        assert abs(after[s] - g) <= 2 * mixing.BLOCK


def test_the_mix_is_packed(stages):
    want = Counter(tuple(encoded("byte_bpe_50k.json", r.text, 0)) for r in stages[3].collect())
    rows = sorted(stages[4].collect(), key=lambda r: (r.sequence_id, r.offset))
    total, ends = 0, Counter()
    for r in rows:
        assert r.offset == ends[r.sequence_id] and len(r.ids) == 4 * r.length
        ends[r.sequence_id] += r.length
        total += r.length
    assert max(ends.values()) <= 2048 and total == sum(len(k) * n for k, n in want.items())
    whole = Counter(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.start == 0 and r.ids.endswith(b"\0\0\0\0"))
    assert whole == Counter({k: n for k, n in want.items() if len(k) <= 2048})


def test_run_gives_the_last_stage(spark, stages):
    assert Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter((r.doc_id, r.piece, r.length) for r in stages[4].collect())


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_sql_gives_the_same_rows(spark):
    from compare import connect, differences

    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).sql(sql).df()) is None, name
