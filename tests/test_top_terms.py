"""Most frequent terms of documents and of all of them, against plain counting."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from modaleda.operators import text as T


def documents(repeat):
    rng = np.random.default_rng(5)
    rows = [(int(i) - 40, " ".join("w" + chr(97 + k) for k in rng.zipf(1.4, rng.integers(0, 60)) % 26)) for i in range(120)] + [(900, ""), (901, None), (902, "a")]
    return rows + ([(-40, "wa wb wa zz yy"), (5, "wc wc wd")] if repeat else [])


def grams(text, n):
    t = (text or "").split()
    return [" ".join(x) for x in zip(*[t[k:] for k in range(n)])]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_top_terms_of_documents(spark, n):
    for repeat in (False, True):
        rows = documents(repeat)
        got = T.top_terms_per_document(spark.createDataFrame(rows, "doc_id long, text string"), 5, n=n)
        assert repeat or "Exchange" not in got._jdf.queryExecution().sparkPlan().toString()
        assert got.dtypes == [("doc_id", "bigint"), ("rank", "int"), ("term", "string"), ("count", "bigint")]
        here = {}
        for r in got.collect():
            here.setdefault(r.doc_id, []).append((r["rank"], r["term"], r["count"]))
        once = Counter(i for i, _ in rows)
        for i, text in rows:
            if once[i] == 1:
                assert sorted(here.get(i, [])) == [(k + 1, *x) for k, x in enumerate(Counter(grams(text, n)).most_common(5))], i
            else:
                both = Counter(g for j, t in rows if j == i for g in grams(t, n))
                assert [c for _, _, c in sorted(here[i])] == [c for _, c in both.most_common(5)] and all(both[x] == c for _, x, c in here[i])


@pytest.mark.parametrize("n, top", [(1, 7), (2, 50), (3, 3), (3, 1000)])
def test_top_terms_of_all_documents(spark, n, top):
    """Most trigrams stand there once, so first occurrences decide; nothing is sorted to find them."""
    rows = documents(False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(g for _, t in sorted(rows) for g in grams(t, n)).most_common(top)
    assert [tuple(r) for r in T.top_terms(df, top, n=n).collect()] == want
    assert [tuple(r) for r in T.most_common(T.term_counts(T.token_rows(df, n=n)), top).collect()] == want
