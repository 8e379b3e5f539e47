"""Document records and corpus tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def records(docs: DataFrame, text: str = "text", keep: Iterable[str] = (), lowercase: bool = True, min_length: int = 1, short_words: int = 5, long_words: int = 1000, stopwords: Iterable[str] = X.STOPWORDS) -> DataFrame:
    """One row of metrics for each document, all of them narrow expressions; unused ones are pruned by Catalyst."""
    keep = list(keep)
    c = F.col("_text")
    df = docs.select(*keep, F.col(text).alias("_text"))
    for stage in (X.base_columns(c, lowercase, min_length), X.part_columns(), X.count_columns(c, stopwords or X.STOPWORDS), X.once_columns(), X.ratio_columns(short_words, long_words)):
        df = df.select("*", *[v.alias(k) for k, v in stage.items()])
    return df.select(*[n for n in df.columns if not n.startswith("_")])


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 1, lowercase: bool = True, min_length: int = 1, stopwords: Iterable[str] = ()) -> DataFrame:
    """(key, pos, term): the tokens or n-grams of each document; stop words go before n-grams are made."""
    if n < 1:
        raise ValueError("n must be positive")
    toks = X.tokens(F.col(text), lowercase, min_length)
    if stopwords:
        toks = X.without_stopwords(toks, stopwords)
    df = docs.select(F.col(key).alias(key), toks.alias("_t"))
    if n == 1:
        return df.select(key, F.posexplode("_t").alias("pos", "term"))
    # copies that are shifted against each other are zipped, and words put together after that: a lambda would not be compiled
    last = F.greatest(F.size("_t") - n + 1, F.lit(0))
    words = F.arrays_zip(*[F.slice("_t", F.lit(i + 1), last).alias(f"w{i}") for i in range(n)])
    return df.select(key, F.posexplode(words).alias("pos", "_w")).select(key, "pos", F.concat_ws(" ", *[F.col("_w")[f"w{i}"] for i in range(n)]).alias("term"))


def term_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, count, first): occurrences in the corpus, and the first place for ties."""
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(key, "pos")).alias("first"))


def most_common(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms; ties by first occurrence."""
    return counts.orderBy(F.desc("count"), F.asc("first")).limit(n).select("term", "count")


def top_terms(docs: DataFrame, top: int, key: str = "doc_id", text: str = "text", n: int = 1, stopwords: Iterable[str] = ()) -> DataFrame:
    """(term, count): the ``top`` most frequent tokens or n-grams of all documents; ties by first occurrence.

    Terms are counted with the least key of their documents, which are two numbers that are added up in a hash table; the place of a
    whole first occurrence would make Spark sort all of them.  Only documents in which terms of one count begin together are read again.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        return most_common(term_counts(token_rows(docs, key, text, n, stopwords=stopwords), key), top)
    counts = token_rows(docs, key, text, n, stopwords=stopwords).groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.min(key).alias("first"))
    several = 20 * top
    while True:  # until those that are even with the last one are all there
        best = counts.orderBy(F.desc("count"), F.asc_nulls_last("first")).limit(several).collect()
        if len(best) < several or (best[-1]["count"], best[-1]["first"]) != (best[top - 1]["count"], best[top - 1]["first"]):
            break
        several *= 8
    if len(best) > top:
        edge = (best[top - 1]["count"], best[top - 1]["first"])
        while (best[-1]["count"], best[-1]["first"]) != edge:
            best.pop()
    even = Counter((r["count"], r["first"]) for r in best)
    where = sorted({r["first"] for r in best if even[r["count"], r["first"]] > 1 and r["first"] is not None})
    place: dict[tuple, int] = {}
    if where:
        of = {r["term"] for r in best}
        again = token_rows(docs.where(F.col(key).isin(where)), key, text, n, stopwords=stopwords).where(F.col("term").isin(*of)) if len(of) <= 1000 else token_rows(docs.where(F.col(key).isin(where)), key, text, n, stopwords=stopwords)
        place = {(r["term"], r[key]): r["pos"] for r in again.groupBy("term", key).agg(F.min("pos").alias("pos")).collect() if r["term"] in of}
    best.sort(key=lambda r: (-r["count"], r["first"] is None, r["first"] or 0, place.get((r["term"], r["first"]), 0)))
    return docs.sparkSession.createDataFrame([(r["term"], r["count"]) for r in best[:top]], "term string, count long")


def vocabulary(counts: DataFrame, min_frequency: int = 1, top_n: int | None = None) -> DataFrame:
    """Terms of a minimum frequency; with top_n the most frequent ones, ties by term."""
    out = counts.where(F.col("count") >= min_frequency).select("term", "count")
    return out if top_n is None else out.orderBy(F.desc("count"), "term").limit(top_n)


def lexical_summary(counts: DataFrame) -> DataFrame:
    total, unique, once = F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("count") == 1)
    return counts.agg(
        total.alias("total_tokens"), unique.alias("unique_tokens"), X.ratio(unique, total).alias("type_token_ratio"), once.alias("hapax_count"), X.ratio(once, unique).alias("hapax_ratio")
    )


def top_terms_per_document(docs: DataFrame, top: int, key: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """(key, rank, term, count): each document's most frequent tokens or n-grams; ties by first position.

    A document is counted where it is, so nothing is shuffled but keys, to see whether some repeat; rows that share a key are one document and are brought together.
    """
    repeated = docs.groupBy(F.col(key).alias("__k__")).agg(F.count(F.lit(1)).alias("__n__")).where("__n__ > 1").select("__k__")
    if not repeated.head(1):
        return _top_terms_in_place(docs, top, key, text, n)
    same = F.col(key).eqNullSafe(F.col("__k__"))
    rows = token_rows(docs.join(repeated, same, "left_semi"), key, text, n)
    counts = rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("count"), "first")
    together = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "rank", "term", "count")
    return _top_terms_in_place(docs.join(repeated, same, "left_anti"), top, key, text, n).unionByName(together)


def _top_terms_in_place(docs: DataFrame, top: int, key: str, text: str, n: int) -> DataFrame:
    """The same where each row is a document of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, words = b.column(1).offsets.to_numpy(), b.column(1).values
            valid = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            row, rank, term, number = [], [], [], []
            for i in range(b.num_rows):
                if not valid[i] or ends[i + 1] - ends[i] < n:
                    continue
                t = words.slice(ends[i], ends[i + 1] - ends[i]).to_pylist()
                best = Counter(t if n == 1 else map(" ".join, zip(*[t[k:] for k in range(n)]))).most_common(top)  # equal counts stay in order of appearance
                row += [i] * len(best)
                rank += range(1, len(best) + 1)
                term += [x for x, _ in best]
                number += [c for _, c in best]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), pa.array(term, pa.string()), pa.array(number, pa.int64())], names=[key, "rank", "term", "count"])

    return docs.select(F.col(key).alias(key), X.tokens(F.col(text)).alias("_t")).mapInArrow(count, f"`{key}` {dict(docs.dtypes)[key]}, rank int, term string, count long")


def coverage(counts: DataFrame) -> DataFrame:
    """(frequency, n_terms, coverage): the share of all tokens that terms of at least this frequency cover.

    The curve by rank follows from it, as terms of one frequency are alike; one row for each frequency
    keeps the ordered window small whatever the vocabulary.
    """
    by_frequency = counts.groupBy(F.col("count").alias("frequency")).agg(F.count(F.lit(1)).alias("terms"))
    w = Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("frequency") * F.col("terms")
    total = by_frequency.agg(F.sum(mass).alias("total"))
    return by_frequency.crossJoin(F.broadcast(total)).select("frequency", F.sum("terms").over(w).alias("n_terms"), X.ratio(F.sum(mass).over(w), F.col("total")).alias("coverage"))


def sentence_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, n_words): the sequence of sentence lengths."""
    return docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("sentence", "_s")).select(key, "sentence", F.size(X.tokens(F.col("_s"))).cast("long").alias("n_words"))
