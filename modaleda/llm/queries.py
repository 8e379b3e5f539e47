"""The corpus operators as queries over the tables of a folder, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, heavy_dedup, html_content, licenses, mixing, packing, repeats, token_counts, topk, toxicity
from .frames import table

WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+')"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents; hard rows as in licenses.license_scan."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and shards of the chosen documents; hard rows as in mixing.assignments."""
    return mixing.assignments(table(spark, sf_dir, "documents"))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that two documents share; hard rows as in repeats.repeated_spans."""
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op4_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of all pages, by a model trained on a sample of them and invented pages; hard rows as in html_content.extract."""
    return html_content.extract(table(spark, sf_dir, "pages"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each whose id is divisible by 20; hard rows as in topk.nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors.where("vec_id % 20 = 0"), vectors)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents; hard rows as in token_counts.token_counts."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the grammar finds toxic, with stems learnt from the labels; hard rows as in toxicity.toxic_documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.learnt_stems(docs, table(spark, sf_dir, "labels")))


def op8_kept_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text and its number of copies; hard rows as in heavy_dedup.kept_copies."""
    return heavy_dedup.kept_copies(table(spark, sf_dir, "documents"))


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sequences of 2,048 tokens; hard rows as in packing.packed_sequences."""
    return packing.packed_sequences(table(spark, sf_dir, "documents"))


def op10_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document that is similar to another; hard rows as in chosen_path.similar_classes."""
    return chosen_path.similar_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_source_mix, op3_repeated_spans, op4_html_content, op5_nearest_vectors,
        op6_token_counts, op7_toxic_documents, op8_kept_copies, op9_packed_sequences, op10_similar_documents,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": r"""
with d as (select doc_id, source, text, len(regexp_extract_all(text, '\S+')) as n, md5('mix:' || doc_id) as h from documents),
t as (select source, sum(n)::bigint as total from d group by source),
w as (select source, round(pow(total, 0.7), 6) as w, ((greatest(total, 1) + 255) // 256)::bigint as blocks from t),
seats as (select source from w, range(256) r(k) where w > 0 order by w / (2 * k + 1) desc, source limit 256),
q as (select source, count(*)::bigint as quota from seats group by source),
f as (select w.source, blocks, quota, blocks // quota as fill, sum(quota) over (order by blocks // quota desc, quota desc, w.source rows unbounded preceding) as had, least(blocks, 4194304) // 3 as low from w join q using (source)),
n as (select greatest(1, coalesce(max(fill) filter (had >= 0.9 * (select sum(quota) from q)), 1))::bigint as shards from f),
p as (select source, blocks, quota, shards, 1 + low + ('0x' || substr(md5('mix:stride:' || source), 1, 8))::bigint % (low + 1) as h from f, n),
m as (select p.*, (select min(h + k) from range(1000) r(k) where gcd(h + k, blocks) = 1) as stride from p),
s as (select *, coalesce(sum(n) over (partition by source order by h, doc_id, md5(text) rows between unbounded preceding and 1 preceding), 0)::bigint as start from d),
b as (select doc_id, s.source, n, least(start // 256, blocks - 1) as block, blocks, quota, shards, stride, ('0x' || substr(md5('mix:' || s.source), 1, 8))::bigint % blocks as shift from s join m on s.source = m.source),
c as (select *, (block * stride + shift) % blocks as slot from b)
select doc_id, source, block::bigint as block, (slot // quota)::bigint as shard, n::bigint as n_tokens from c where slot < quota * shards""",
    "op3_repeated_spans": rf"""
with d as (select doc_id, {WORDS} as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as gram from d, range(0, len(w) - 49) r(i)),
r as (select gram, count(*) as places from g group by gram having min(doc_id) < max(doc_id)),
o as (select doc_id, i, places from g join r using (gram)),
n as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from o),
s as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as span from n)
select doc_id, min(i)::bigint as start_word, (max(i) + 50)::bigint as end_word, max(places)::bigint as n_places from s group by doc_id, span""",
    "op5_nearest_vectors": """
with v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
p as (select a.vec_id, b.vec_id as neighbor_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) as similarity from v a join v b on a.vec_id != b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by vec_id order by similarity desc, neighbor_id) as rank from p)
select vec_id, rank::int as rank, neighbor_id, similarity from r where rank <= 10""",
    "op8_kept_copies": "select min(doc_id) as doc_id, md5(text) as digest, count(*)::bigint as n_copies from documents group by text",
    "op10_similar_documents": rf"""
with recursive d as (select doc_id, {WORDS} as w from documents),
s as (select doc_id, case when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i + 1 : i + 3], ' ') for i in range(0, len(w) - 2)]) end as g from d where len(w) > 0),
e as (select doc_id, len(g) as n, unnest(g) as gram from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.gram = b.gram and a.doc_id != b.doc_id group by all),
l as (select a, b from i where common::double / (na + nb - common) >= 0.5),
r(a, b) as (select a, a from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as class_id from r group by a)
select c.a as doc_id, class_id, (select count(*) from l where l.a = c.a)::bigint as n_links from c""",
}
