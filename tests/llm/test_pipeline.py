"""The registered corpus queries against their SQL, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import itertools
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from modaleda.llm import frames, mixing, queries, toxicity
from tests.llm.test_brute_force import gram_set

FOLDER = "/root/testdata/sf0.001"


def same(rows):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_agrees_with_its_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    columns = ", ".join(got.columns)
    assert same(got.collect()) == same(db.execute(f"select {columns} from ({queries.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLE_SQL])
def test_query_covers_its_table(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    docs = {r.doc_id: r.text for r in frames.table(spark, FOLDER, "documents").collect()}
    if name == "op4_html_content":
        assert len(rows) == frames.table(spark, FOLDER, "pages").count() and all(r.n_kept <= r.n_nodes for r in rows)
    elif name == "op6_token_counts":
        assert {r.doc_id for r in rows} == set(docs)
    elif name == "op9_packed_sequences":
        n = defaultdict(int)
        for r in rows:
            n[r.doc_id] += r.n_tokens
        assert n == {i: len(t.split()) for i, t in docs.items() if t.split()}
    else:
        assert {r.doc_id for r in rows} <= set(docs)


@pytest.fixture(scope="module")
def stages(spark):
    docs = frames.table(spark, FOLDER, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = frames.written(stage(spark, docs, FOLDER), f"test-{name}")
        out.append(docs.collect())
    return out


def test_stages_are_the_ones_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "packing"]


def test_stages_keep_whole_rows(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert set(after) <= set(before) and len(after) == len(set(after))


def test_toxic_documents_go(spark, stages):
    docs = frames.table(spark, FOLDER, "documents")
    scorer = toxicity.Scorer(toxicity.learnt_stems(docs, frames.table(spark, FOLDER, "labels")))
    assert set(stages[1]) == {r for r in stages[0] if scorer.score(r.text)[0] < 0.6}


def test_copies_go(stages):
    least = {}
    for r in sorted(stages[1], key=lambda r: r.doc_id):
        least.setdefault(r.text, r)
    assert set(stages[2]) == set(least.values())


def test_near_copies_go(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    sets = {r.doc_id: gram_set(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.5 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    gone = {i for i in sets if find(i) != i}
    found = set(sets) - {r.doc_id for r in stages[3]}
    assert found <= gone and len(found) >= 0.9 * len(gone)


def test_sources_are_mixed(stages):
    total = defaultdict(int)
    for r in stages[3]:
        total[r.source] += len(r.text.split())
    plan = {s: (blocks, quota, shards) for s, blocks, quota, shards, _ in mixing._plan(total, None, 0.7, 256, 256, 0.9, "mix")}
    assert {r.source for r in stages[4]} == set(plan)
    for s, (blocks, quota, shards) in plan.items():
        if blocks <= quota * shards:
            assert {r for r in stages[4] if r.source == s} == {r for r in stages[3] if r.source == s}


def test_tokens_are_packed_once(stages):
    at, full = defaultdict(list), defaultdict(int)
    for r in stages[5]:
        at[r.doc_id].append((r.doc_start, r.doc_start + r.n_tokens))
        full[r.sequence] += r.n_tokens
    assert max(full.values()) <= 2048
    for r in stages[4]:
        n = len(r.text.split())
        pieces = sorted(at.pop(r.doc_id, []))
        assert [a for a, _ in pieces] == [0, *(b for _, b in pieces[:-1])][: len(pieces)]
        assert (pieces[-1][1] if pieces else 0) == n
    assert not at


def test_run_gives_the_last_stage(spark, stages):
    assert same(corpus_pipeline.run(spark, FOLDER).collect()) == same(stages[5])
