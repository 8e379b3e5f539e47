"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modaleda.llm import chosen_path, heavy_dedup, html_content, licenses, mixing, packing, repeats, token_counts, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, html string"
VECTORS = "vec_id long, embedding array<float>, label int"
CLASHING = "n h t a b doc docs path run rank size rest whole one part block digest sketch grams buckets least pos edges start stop places score toxic row tile dim __doc__ __text__ __digest__ __source__ __n__ __packed_row__".split()
STORY = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"
STEMS = (("grumblefax", 1.0),)
NOTICE = licenses.TEMPLATES["MIT-permission"]


def long_text(n: int = 60_000) -> str:
    words = np.random.default_rng(5).integers(0, 50_000, n)
    return " ".join(f"w{w}" for w in words)


def hard_docs(spark):
    rows = [
        (None, STORY, None, None, None), (None, STORY, "en", "web", 3), (1, None, None, "web", None), (2, "", "en", "web", 0), (3, " \n\t ", "en", None, 3),
        (4, long_text(), "en", "books", 9), (5, STORY, "en", "web", 9), (5, STORY, "en", "web", 9), (6, STORY, "en", "code", 9), (7, STORY + " today", "en", "web", 9),
        (8, f"You are such a grumblefax. {NOTICE}", "en", "web", 9), (9, f"You are such a grumblefax. {NOTICE}", "en", "web", 9), (10, "éé 漢字 ß \u0000 ok", "xx", "web", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def hard_pages(spark):
    return spark.createDataFrame(
        [(None, "<p>Words without a page number.</p>"), (1, None), (2, ""), (3, "<div><p>unclosed <b>bold"), (4, "<p>" + long_text(20_000) + "</p>"), (5, "no tags at all"), (5, "no tags at all"), (6, "<" * 200), (7, "<div>" * 3000 + "deep" + "</div>" * 3000)], PAGES
    )


def hard_vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, 0.0], None), (7, [2.0, 0.0], 1), (8, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1)]
    return spark.createDataFrame(rows, VECTORS)


MODEL = None


def extract(df):
    global MODEL
    MODEL = MODEL or html_content.train(html_content.invented_pages(40))
    return html_content.extract(df, MODEL)


OPERATORS = {
    "license_scan": (hard_docs, licenses.license_scan),
    "assignments": (hard_docs, mixing.assignments),
    "repeated_spans": (hard_docs, lambda d: repeats.repeated_spans(d, 12, 6)),
    "extract": (hard_pages, extract),
    "nearest": (hard_vectors, lambda d: topk.nearest(d, d, 3)),
    "token_counts": (hard_docs, token_counts.token_counts),
    "toxic_documents": (hard_docs, lambda d: toxicity.toxic_documents(d, STEMS)),
    "kept_copies": (hard_docs, lambda d: heavy_dedup.kept_copies(d, 2)),
    "packed_sequences": (hard_docs, packing.packed_sequences),
    "similar_classes": (hard_docs, chosen_path.similar_classes),
}
STAGES = {
    "without_toxic": lambda d: toxicity.without_toxic(d, STEMS),
    "drop_copies": lambda d: heavy_dedup.drop_copies(d, 2),
    "one_of_each_group": chosen_path.one_of_each_group,
    "mixed": mixing.mixed,
}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


@pytest.fixture(scope="module")
def results(spark):
    return {name: rows_of(f(make(spark))) for name, (make, f) in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, results, name):
    make, f = OPERATORS[name]
    assert rows_of(f(with_clashes(make(spark)))) == results[name]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    make, f = OPERATORS[name]
    df = make(spark)
    assert f(spark.createDataFrame([], df.schema)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(spark, name):
    docs = with_clashes(hard_docs(spark))
    out = STAGES[name](docs)
    assert out.schema == docs.schema
    assert set(map(repr, out.collect())) <= set(map(repr, docs.collect()))
    assert STAGES[name](spark.createDataFrame([], docs.schema)).collect() == []


def test_license_scan(results):
    assert {(r[0], r[1]) for r in results["license_scan"]} == {(8, "MIT-permission"), (9, "MIT-permission")}


def test_assignments(results):
    got = results["assignments"]
    assert len(got) == 14  # one block or few of each source: all are taken
    assert {r[1] for r in got if r[0] == 3} == {""}
    assert {r[4] for r in got if r[0] in (1, 2, 3)} == {0}


def test_repeated_spans(results):
    n = len(STORY.split())
    assert {(r[0], r[1], r[2]) for r in results["repeated_spans"] if r[0] in (5, 6, 7)} == {(i, 0, n) for i in (5, 6, 7)}
    assert {r[0] for r in results["repeated_spans"]} == {5, 6, 7, 8, 9}


def test_extract(results):
    got = {r[0]: r for r in results["extract"]}
    assert got[1] == (1, None, None, None) and got[2] == (2, "", 0, 0)
    assert len(results["extract"]) == 9 and got[4][3] == 1 and got[7][3] == 3000


def test_nearest(results):
    got = {(r[0], r[1]): (r[2], r[3]) for r in results["nearest"]}
    assert {r[0] for r in results["nearest"]} == {5, 6, 7, 8}
    assert got[6, 1] == (7, 1.0) and got[5, 1][1] == 0.0
    assert all(r[0] != r[2] for r in results["nearest"])
    assert sum(r[0] == 8 for r in results["nearest"]) == 6  # two rows of that id, a list each


def test_token_counts(results):
    got = {r[0]: r[1:] for r in results["token_counts"]}
    assert got[1] == (None, None) and got[2] == (0, 0) and got[3] == (0, 0)
    assert len(results["token_counts"]) == 14


def test_toxic_documents(results):
    assert [r[0] for r in results["toxic_documents"]] == [8, 9]


def test_kept_copies(results):
    got = [(r[0], r[2]) for r in results["kept_copies"]]
    assert sorted(got, key=repr) == sorted([(5, 5), (1, 1), (None, 1), (2, 1), (3, 1), (4, 1), (7, 1), (8, 2), (10, 1)], key=repr)


def test_packed_sequences(results):
    words = len(STORY.split())
    mine = [r for r in results["packed_sequences"] if r[1] == 5]
    assert [r[3] for r in mine] == [words, words]
    assert {r[1] for r in results["packed_sequences"]} == {None, 4, 5, 6, 7, 8, 9, 10}
    assert sum(r[3] for r in results["packed_sequences"] if r[1] == 4) == 60_000


def test_similar_classes(results):
    got = sorted(results["similar_classes"])
    assert got == [(5, 5, 3), (5, 5, 3), (6, 5, 3), (7, 5, 3), (8, 8, 1), (9, 8, 1)]


def test_near_copies_keep_rows_without_id_or_words(spark):
    kept = [r.doc_id for r in chosen_path.one_of_each_group(hard_docs(spark)).collect()]
    assert kept.count(None) == 3 and sorted(k for k in kept if k is not None) == [1, 2, 3, 4, 5, 8, 10]


def test_stems_are_learnt_from_hard_rows(spark):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (2, 0), (5, 0), (5, 0), (6, 0), (8, 1), (9, 1), (9, 0), (77, 1)], "doc_id long, toxic int")
    stems = toxicity.learnt_stems(docs, labels, contexts=1, odds=2.0)
    assert "grum" in {s[:4] for s, _ in stems} and all(0 < w <= 1 for _, w in stems)
    assert toxicity.learnt_stems(with_clashes(docs), labels.withColumn("text", F.lit("x")), contexts=1, odds=2.0) == stems
    assert toxicity.learnt_stems(spark.createDataFrame([], docs.schema), labels) == toxicity.learnt_stems(docs, labels.limit(0)) == ()


def test_a_model_is_trained_on_hard_pages(spark):
    pages = hard_pages(spark)
    for df in (with_clashes(pages), spark.createDataFrame([], pages.schema)):
        model = html_content.trained_on(df, sample=5, invented=12)
        nodes = html_content.parse("<div><p>Some words, and more of them.</p></div>")
        p = model.predict(model.features(nodes)[0])
        assert ((p > 0) & (p < 1)).all()
