"""Pairs and groups of items that are near each other, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from modaleda.operators import dedup, distance


def plain_pairs(rows, threshold):
    rows = sorted(set(rows))
    return sorted({(a, b, d) for a, x in rows for b, y in rows if a < b and (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= threshold})


def plain_groups(ids, pairs):
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, []).append(b)
    taken, out = set(), []
    for a in sorted(ids):
        if a in taken:
            continue
        members = [b for b in near.get(a, []) if b not in taken]
        taken.update(members, [a])
        out += [(a, i) for i in [a, *members]] if members else []
    return sorted(out)


def hashes(n, different, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, different, dtype=np.int64)
    for i in range(1, different, 2):  # near the one before
        base[i] = base[i - 1] ^ np.int64(int(rng.integers(0, 2**6)))
    return [(i, int(base[k])) for i, k in enumerate(rng.integers(0, different, n))]


@pytest.mark.parametrize("threshold", [3, 20])
def test_pairs_of_many_equal_hashes(spark, threshold):
    rows = hashes(500, 60) + [(7, 99), (7, 99)]
    got = dedup.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", threshold, chunk=5)
    assert sorted(map(tuple, got.collect())) == plain_pairs(rows, threshold)


def test_pairs_of_ids_are_not_shuffled(spark):
    df = spark.createDataFrame(hashes(400, 5), "id long, h long")
    plan = dedup.hamming_pairs(df, "id", "h", 20)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate explode(ids_b") < plan.index("Join") and "Exchange" not in plan[: plan.index("Generate explode(ids_b")]


@pytest.mark.parametrize("small", [0, 1000])
def test_groups_of_a_greedy_pass(spark, small):
    rows = hashes(300, 80, 1)
    pairs = plain_pairs(rows, 22)
    got = dedup.hamming_groups(spark.createDataFrame(rows, "id long, h long"), "id", "h", 22)
    assert sorted(map(tuple, got.collect())) == plain_groups([i for i, _ in rows], pairs)
    seeds = dedup._seeds(spark.createDataFrame(pairs, "id_a long, id_b long, d int"), small)
    sizes = {}
    for r in seeds.collect():
        sizes.setdefault(r.seed, []).append(r.id)
    assert sorted((s, i) for s, ids in sizes.items() if len(ids) > 1 for i in ids) == plain_groups([i for i, _ in rows], pairs)


@pytest.mark.parametrize("block", [7, 64])
def test_distances_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    words = [[f"w{k}" for k in rng.zipf(1.5, 40) % 50] for _ in range(60)]
    docs = [(i, " ".join(words[i % 60] + ["x"] * (i // 60))) for i in range(90)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    v = distance.tfidf(df)
    vec = {}
    for r in v.collect():
        vec.setdefault(r.doc_id, {})[r.term] = r.weight
    want = {(a, b): 1 - min(1, sum(w * vec.get(b, {}).get(t, 0) for t, w in vec.get(a, {}).items())) for a in range(92) for b in range(a + 1, 92)}
    got = {(r.id_a, r.id_b): r.distance for r in distance._block_products(v, df, "doc_id", block=block, step=5).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    near = {(r.id_a, r.id_b): r.distance for r in distance._block_products(v, v.select("doc_id").distinct(), "doc_id", 0.3, block=block, step=5).collect()}
    assert near == pytest.approx({k: d for k, d in want.items() if d <= 0.3}, abs=1e-12) and len(near) > 25
    assert len(distance.near_duplicates(v).collect()) == sum(d <= 0.15 for d in want.values())


def test_a_matrix_of_many_items(spark):
    items = spark.range(20_001).selectExpr("id")
    assert distance.all_pairs(items, "id").where("id_a = 20000 or id_b = 20000").count() == 20_000
