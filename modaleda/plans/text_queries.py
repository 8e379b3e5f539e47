"""Text queries over documents, conversations, pages and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import stats
from ..functions import text as X
from ..operators import dedup, distance
from ..operators import text as T
from ..sources import formats
from .registry import query, rounded, stats_sql

TOK = X.TOKEN
TOKENS = f"list_transform(regexp_extract_all(text, $t${TOK}$t$), lambda x: replace(lower(x), 'ß', 'ss'))"
STOP = ", ".join(f"'{w}'" for w in sorted(X.STOPWORDS))
SENTENCES = r"""list_filter(regexp_split_to_array(regexp_replace(text, $t$([.!?])["'’”)]*\s+$t$, '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_matches(x, '\S'))"""
PARAGRAPHS = r"list_filter(regexp_split_to_array(text, '\n\s*\n+'), lambda x: regexp_matches(x, '\S'))"
LINES = r"case when text = '' then []::varchar[] when suffix(text, chr(10)) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end"
COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
HASH = f"sha256(replace(lower({COLLAPSED}), 'ß', 'ss'))"
MARKED = "select doc_id, text || chr(10) || chr(10) || 'see https://example.org/' || source || ' #' || source || ' @' || lang || ' me' || doc_id || '@example.org 😀' as text from documents"


def marked(t) -> DataFrame:
    """Documents with a second paragraph of markup, which they lack."""
    c = F.col
    tail = F.concat(F.lit("\n\nsee https://example.org/"), c("source"), F.lit(" #"), c("source"), F.lit(" @"), c("lang"), F.lit(" me"), c("doc_id").cast("string"), F.lit("@example.org 😀"))
    return t("documents").select("doc_id", F.concat("text", tail).alias("text"))


def n_of(pattern: str) -> str:
    return f"len(regexp_extract_all(text, $p${pattern}$p$))"


def share(a: str, b: str) -> str:
    return f"round(case when {b} = 0 then 0 else {a}::double / {b} end, 6)"


_CHARS = {"punctuation": r"[^\p{L}\p{N}\s]", "digit": r"[\p{Nd}²³¹]", "whitespace": r"\s", "non_ascii": r"[^\x00-\x7F]"}


@query(
    "with c as (select doc_id, length(text) as char_count, strlen(text)::bigint as byte_count, "
    + ", ".join(f"{n_of(p)} as {k}_count" for k, p in _CHARS.items())
    + f", {n_of(r'\p{Lu}')} as uppercase_count, {n_of(r'\p{L}')} as alpha from documents) select doc_id, char_count, byte_count, uppercase_count, {share('uppercase_count', 'alpha')} as uppercase_rate, "
    + ", ".join(f"{k}_count, {share(f'{k}_count', 'char_count')} as {k}_rate" for k in _CHARS)
    + " from c"
)
def text_char_profile(t):
    r = T.records(t("documents"), keep=["doc_id"])
    return rounded(r.select("doc_id", "char_count", "byte_count", "uppercase_count", "uppercase_rate", *[f"{k}_{x}" for k in _CHARS for x in ("count", "rate")]))


@query(
    f"""with d as (select doc_id, {TOKENS} as w from documents), e as (select doc_id, unnest(w) as t from d), f as (select doc_id, t, count(*) as n from e group by all),
h as (select doc_id, count_if(n = 1)::bigint as hapax from f group by doc_id)
select d.doc_id, len(w) as word_count, len(list_filter(w, lambda x: regexp_full_match(x, $t${X.WORD}$t$))) as alpha_word_count, len(list_filter(w, lambda x: regexp_matches(x, '[\\p{{Nd}}²³¹]'))) as numeric_token_count,
len(list_distinct(w)) as unique_word_count, {share('len(list_distinct(w))', 'len(w)')} as lexical_diversity, coalesce(hapax, 0)::bigint as hapax_count, {share('coalesce(hapax, 0)', 'len(list_distinct(w))')} as hapax_ratio,
round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0), 6) as avg_word_length, round(coalesce(list_median(list_transform(w, lambda x: length(x)::double)), 0), 6) as median_word_length,
round(coalesce(list_stddev_pop(list_transform(w, lambda x: length(x)::double)), 0), 6) as word_length_std from d left join h using (doc_id)"""
)
def text_token_profile(t):
    r = T.records(t("documents"), keep=["doc_id"])
    return rounded(r.select("doc_id", "word_count", "alpha_word_count", "numeric_token_count", "unique_word_count", "lexical_diversity", "hapax_count", "hapax_ratio", "avg_word_length", "median_word_length", "word_length_std"))


def _sentence_sql(source: str, keys: str) -> str:
    return f"""with d as (select {keys}, list_transform({SENTENCES}, lambda s: len(regexp_extract_all(s, $t${TOK}$t$))::double) as n from {source})
select {keys}, len(n) as sentence_count, round(coalesce(list_avg(n), 0), 6) as avg_sentence_length, round(coalesce(list_median(n), 0), 6) as median_sentence_length, round(coalesce(list_stddev_pop(n), 0), 6) as sentence_length_std, coalesce(list_max(n), 0)::bigint as max_sentence_words from d"""


_SENTENCE = ["sentence_count", "avg_sentence_length", "median_sentence_length", "sentence_length_std", "max_sentence_words"]


@query(_sentence_sql("documents", "doc_id"))
def text_sentence_profile(t):
    return rounded(T.records(t("documents"), keep=["doc_id"]).select("doc_id", *_SENTENCE))


@query(_sentence_sql("conversations", "conv_id, turn"))
def conversation_sentence_profile(t):
    return rounded(T.records(t("conversations"), keep=["conv_id", "turn"]).select("conv_id", "turn", *_SENTENCE))


@query(
    f"""with m as ({MARKED}), d as (select doc_id, {PARAGRAPHS} as p, {LINES} as l from m),
e as (select *, list_transform(list_filter(l, lambda x: regexp_matches(x, '\\S')), lambda x: replace(lower(trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), 'ß', 'ss')) as f from d)
select doc_id, len(p) as paragraph_count, round(coalesce(list_avg(list_transform(p, lambda s: len(regexp_extract_all(s, $t${TOK}$t$))::double)), 0), 6) as avg_paragraph_words, len(l) as line_count, len(f) as nonempty_line_count,
round(case when len(f) = 0 then 0 else 1 - len(list_distinct(f))::double / len(f) end, 6) as repeated_line_fraction from e"""
)
def text_paragraph_line_profile(t):
    return rounded(T.records(marked(t), keep=["doc_id"]).select("doc_id", "paragraph_count", "avg_paragraph_words", "line_count", "nonempty_line_count", "repeated_line_fraction"))


@query(f"with d as (select doc_id, {TOKENS} as w from documents), s as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x in ({STOP}))) as stopword_count from d) select doc_id, stopword_count, {share('stopword_count', 'n')} as stopword_ratio from s")
def text_stopword_profile(t):
    return rounded(T.records(t("documents"), keep=["doc_id"]).select("doc_id", "stopword_count", "stopword_ratio"))


_SYLLABLES = """case when length(w) = 0 then 0 when length(w) <= 3 then 1 else greatest(1, g2 - case when g2 > 1 and suffix(w, 'es') and length(w) > 4 then 1 else 0 end) end"""


@query(
    f"""with d as (select doc_id, {TOKENS} as w, len({SENTENCES}) as s from documents),
e as (select doc_id, s, t from d, unnest(list_filter(w, lambda x: regexp_full_match(x, $t${X.WORD}$t$))) u(t)),
f as (select doc_id, s, regexp_replace(t, '[^a-z]', '', 'g') as w from e),
g as (select doc_id, s, w, len(regexp_extract_all(w, '[aeiouy]+')) as g1 from f),
h as (select *, g1 - case when g1 > 1 and suffix(w, 'e') and not suffix(w, 'le') and not suffix(w, 'ye') then 1 else 0 end as g2 from g),
k as (select doc_id, s, count(*)::double as n, sum({_SYLLABLES})::double as y from h group by doc_id, s)
select d.doc_id, round(206.835 - 1.015 * (n / k.s) - 84.6 * (y / n), 6) as readability_flesch, round(0.39 * (n / k.s) + 11.8 * (y / n) - 15.59, 6) as readability_grade from d left join k on d.doc_id = k.doc_id and k.s > 0"""
)
def text_readability(t):
    return rounded(T.records(t("documents"), keep=["doc_id"]).select("doc_id", "readability_flesch", "readability_grade"))


@query(
    f"with m as ({MARKED}) select doc_id, "
    + n_of(r"(?i)\b(?:https?://|www\.)[^\s<>()]+") + " as url_count, "
    + n_of(r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b") + " as email_count, "
    + n_of(r"(?:^|[^\p{L}\p{N}_])#[\p{L}\p{N}_]+") + " as hashtag_count, "
    + n_of(r"(?:^|[^\p{L}\p{N}_])@[\p{L}\p{N}_]+") + " as mention_count, "
    + n_of(r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]") + " as emoji_count from m"
)
def text_markup_counts(t):
    return T.records(marked(t), keep=["doc_id"]).select("doc_id", "url_count", "email_count", "hashtag_count", "mention_count", "emoji_count")


@query(
    f"with c as (select doc_id, {n_of(r'\p{L}')} as a, {n_of('[A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿ]')} as l from documents) select doc_id, case when a = 0 then 'None' when l >= a - l then 'Latin' else 'Other' end as dominant_script, {share('l', 'a')} as latin from c"
)
def text_script_profile(t):
    r = T.records(t("documents"), keep=["doc_id"])
    return rounded(r.select("doc_id", "dominant_script", F.coalesce(F.col("script_distribution")["Latin"], F.lit(0.0)).alias("latin")))


_LENGTHS = ["char_count", "byte_count", "word_count", "unique_word_count", "lexical_diversity"]


def _length_sql(source: str, by: str) -> str:
    return stats_sql(f"select {by}, length(text) as char_count, strlen(text) as byte_count, len(w) as word_count, len(list_distinct(w)) as unique_word_count, case when len(w) = 0 then 0 else len(list_distinct(w))::double / len(w) end as lexical_diversity from (select *, {TOKENS} as w from {source})", _LENGTHS, by)


def _length_stats(docs: DataFrame, by: str) -> DataFrame:
    return stats.describe(T.records(docs, keep=[by]), _LENGTHS, [by])


@query(_length_sql("documents", "lang"))
def text_length_stats_by_lang(t):
    return _length_stats(t("documents"), "lang")


@query(_length_sql("documents", "source"))
def text_length_stats_by_source(t):
    return _length_stats(t("documents"), "source")


@query(_length_sql("conversations", "role"))
def text_length_stats_by_role(t):
    return _length_stats(t("conversations"), "role")


@query(stats_sql(f"select coalesce(quality::varchar, 'None') as quality, len({TOKENS}) as word_count, length(text) as char_count from documents left join labels using (doc_id)", ["word_count", "char_count"], "quality"))
def text_metric_by_label(t):
    d = t("documents").join(t("labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left").fillna("None", ["quality"])
    return stats.describe(T.records(d, keep=["quality"]), ["word_count", "char_count"], ["quality"])


@query(
    f"with d as (select text, len({TOKENS}) as n from documents) select count(*)::bigint as n_documents, count_if(not regexp_matches(text, '\\S'))::bigint as n_empty, count_if(n < 5)::bigint as n_very_short, count_if(n > 1000)::bigint as n_very_long, round(avg((n < 5)::int), 6) as very_short_rate, round(avg((n > 1000)::int), 6) as very_long_rate from d"
)
def text_quality_flags(t):
    r = T.records(t("documents"))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rounded(r.agg(F.count(F.lit(1)).alias("n_documents"), *[F.count_if(c).alias(f"n_{c}") for c in ("empty", "very_short", "very_long")], rate("very_short").alias("very_short_rate"), rate("very_long").alias("very_long_rate")))


_ROWS = f"d as (select doc_id, {TOKENS} as w from documents)"
_CONTENT = f"d as (select doc_id, list_filter({TOKENS}, lambda x: x not in ({STOP})) as w from documents)"


def _grams(n: int) -> str:
    term = " || ' ' || ".join(f"w[i + {k}]" for k in range(1, n + 1))
    return f"e as (select doc_id, i::int as pos, {term} as term from d, range(0, len(w) - {n - 1}) r(i))"


def _top_sql(docs: str, n: int, limit: int = 50) -> str:
    return f"with {docs}, {_grams(n)} select term, count(*)::bigint as count from e group by term order by count(*) desc, min((doc_id, pos)) limit {limit}"


def _top(t, n: int, stopwords=(), limit: int = 50) -> DataFrame:
    return T.top_terms(t("documents"), limit, n=n, stopwords=stopwords)


@query(_top_sql(_ROWS, 1))
def corpus_top_words(t):
    return _top(t, 1)


@query(_top_sql(_CONTENT, 1))
def corpus_top_content_words(t):
    return _top(t, 1, X.STOPWORDS)


@query(_top_sql(_ROWS, 2))
def corpus_top_bigrams(t):
    return _top(t, 2)


@query(_top_sql(_ROWS, 3))
def corpus_top_trigrams(t):
    return _top(t, 3)


@query(_top_sql(_CONTENT, 2))
def corpus_top_content_bigrams(t):
    return _top(t, 2, X.STOPWORDS)


@query(f"with {_ROWS}, {_grams(1)} select term, count(*)::bigint as count from e group by term having count(*) >= 2")
def corpus_vocabulary(t):
    return T.vocabulary(T.term_counts(T.token_rows(t("documents"))), 2)


@query(f"with {_ROWS}, {_grams(2)} select term, count(*)::bigint as count from e group by term having count(*) >= 2")
def corpus_bigram_counts(t):
    return T.vocabulary(T.term_counts(T.token_rows(t("documents"), n=2)), 2)


@query(
    f"with {_ROWS}, {_grams(1)}, c as (select term, count(*) as n from e group by term) select sum(n)::bigint as total_tokens, count(*)::bigint as unique_tokens, round(count(*)::double / sum(n), 6) as type_token_ratio, count_if(n = 1)::bigint as hapax_count, round(count_if(n = 1)::double / count(*), 6) as hapax_ratio from c"
)
def corpus_lexical_summary(t):
    return rounded(T.lexical_summary(T.term_counts(T.token_rows(t("documents")))))


@query(
    f"with {_ROWS}, {_grams(1)}, c as (select doc_id, term, count(*)::bigint as count, min(pos) as first from e group by doc_id, term), r as (select *, row_number() over (partition by doc_id order by count desc, first) as rank from c) select doc_id, rank::int as rank, term, count from r where rank <= 30"
)
def document_top_terms(t):
    return T.top_terms_per_document(t("documents"), 30)


@query(
    f"with {_ROWS}, {_grams(1)}, c as (select term, count(*) as frequency from e group by term), f as (select frequency::bigint as frequency, count(*) as n, sum(frequency) as m from c group by frequency) select frequency, (sum(n) over w)::bigint as n_terms, round((sum(m) over w)::double / (sum(m) over ()), 6) as coverage from f window w as (order by frequency desc rows unbounded preceding)"
)
def token_coverage_curve(t):
    return rounded(T.coverage(T.term_counts(T.token_rows(t("documents")))))


@query(f"with d as (select doc_id, {SENTENCES} as s from documents) select doc_id, i::int as sentence, len(regexp_extract_all(s[i + 1], $t${TOK}$t$)) as n_words from d, range(0, len(s)) r(i)")
def sentence_length_sequence(t):
    return T.sentence_lengths(t("documents"))


@query(f"with d as (select doc_id, {HASH} as digest from documents) select digest, min(doc_id) as first_id, count(*)::bigint as n from d group by digest having count(*) > 1")
def text_duplicate_groups(t):
    d = t("documents").select("doc_id", X.normalised_hash(F.col("text")).alias("digest"))
    return dedup.exact_groups(d, "doc_id", "digest")


@query(f"with d as (select {HASH} as digest from documents), g as (select count(*) as n from d group by digest) select sum(n)::bigint as n_items, count_if(n > 1)::bigint as n_groups, coalesce(sum(n) filter (n > 1), 0)::bigint as n_in_groups, round(coalesce(sum(n) filter (n > 1), 0)::double / sum(n), 6) as duplicate_fraction from g")
def text_duplicate_summary(t):
    d = t("documents").select("doc_id", X.normalised_hash(F.col("text")).alias("digest"))
    return rounded(dedup.duplicate_summary(d, "doc_id", "digest"))


_TFIDF = f"""{_CONTENT}, {_grams(1)}, tf as (select doc_id, term, count(*) as tf, min(pos) as pos from e group by doc_id, term),
v as (select term, count(*) as df from tf group by term order by sum(tf) desc, min((doc_id, pos)) limit 5000),
x as (select doc_id, term, tf * (ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1.0) as w from tf join v using (term)),
y as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from x),
p as (select a.doc_id as id_a, b.doc_id as id_b, sum(a.w * b.w) as dot from y a join y b on a.term = b.term and a.doc_id < b.doc_id group by all)"""


@query(f"with {_TFIDF} select a.doc_id as id_a, b.doc_id as id_b, round(1.0 - least(1.0, coalesce(dot, 0.0)), 6) as distance from documents a join documents b on a.doc_id < b.doc_id left join p on p.id_a = a.doc_id and p.id_b = b.doc_id")
def tfidf_distances(t):
    """All pairs: the matrix itself is the result, quadratic as it is."""
    d = t("documents").select("doc_id", "text")
    return rounded(distance.cosine_distances(distance.tfidf(d), d))


@query(f"with {_TFIDF} select id_a, id_b, round(1.0 - least(1.0, dot), 6) as distance from p where 1.0 - least(1.0, dot) <= 0.15")
def near_duplicate_documents(t):
    return rounded(distance.near_duplicates(distance.tfidf(t("documents").select("doc_id", "text"))))


@query("select toxic, count(*)::bigint as count from labels group by toxic")
def label_distribution(t):
    return stats.frequency(t("labels"), "toxic")


@query("with c as (select c_nationkey, count(*) as n from customer group by 1) select count(*)::bigint as n_classes, round(max(n)::double / min(n), 6) as imbalance_ratio from c")
def class_imbalance(t):
    return rounded(stats.imbalance(t("customer"), "c_nationkey"))


@query("select n_name as label, count(*)::bigint as count from customer join nation on c_nationkey = n_nationkey group by 1")
def label_lookup_counts(t):
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("label"))
    return stats.frequency(named, "label")


@query("""with b as (select min(n_chars)::double as a, max(n_chars)::double as b from documents), w as (select *, (b - a) / 30 as width from b), r as (select least(floor((n_chars - a) / width), 29)::int as bin, a, width from documents, w)
select bin, round(a + bin * width, 6) as lo, round(a + (bin + 1) * width, 6) as hi, count(*)::bigint as count from r group by bin, a, width""")
def metric_histogram(t):
    return rounded(stats.histogram(t("documents"), "n_chars", 30))


@query("""with b as (select l_returnflag, min(l_extendedprice) as a, max(l_extendedprice) as b from lineitem group by 1), r as (select i.l_returnflag, least(floor((l_extendedprice - a) / ((b - a) / 20)), 19)::int as bin, a, (b - a) / 20 as width from lineitem i join b using (l_returnflag))
select l_returnflag, bin, round(a + bin * width, 6) as lo, round(a + (bin + 1) * width, 6) as hi, count(*)::bigint as count from r group by l_returnflag, bin, a, width""")
def grouped_histogram(t):
    return rounded(stats.histogram(t("lineitem"), "l_extendedprice", 20, ["l_returnflag"]))


@query(stats_sql("select o_orderpriority, o_totalprice from orders", ["o_totalprice"], "o_orderpriority"))
def order_price_stats(t):
    return stats.describe(t("orders"), ["o_totalprice"], ["o_orderpriority"])


@query("""select event_type, count(*)::bigint as n, count(json_extract_string(props, '$.k'))::bigint as n_with_k from events group by 1""")
def json_props_ingest(t):
    e = t("events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_with_k"))


@query()
def html_text_records(t):
    pages = t("pages").select("page_id", formats.html_text(F.col("html")).alias("text"))
    return rounded(T.records(pages, keep=["page_id"]).select("page_id", "char_count", "word_count", "unique_word_count", "sentence_count", "line_count"))


@query()
def text_records(t):
    """The whole record of each document (its columns are checked one by one in the queries above)."""
    r = T.records(t("documents"), keep=["doc_id"])
    return rounded(r.withColumn("script_distribution", F.to_json("script_distribution")))
