"""Toxic clauses by a weighted finite-state grammar.

Words are mapped to classes (insult, learnt epithet, threat, target, object, negation, report, intensifier,
other, end of clause).  Transducers read the classes of a clause: insult and threat
give a match its weight, target says how much of it counts, negation and reported speech lower it.  They
are composed into one machine, which is run over each clause with a match.  An insult that is addressed to nobody
in its clause is not enough on its own, nor is a threat without an object.  The clauses of a document, best first, count by a third
less each, so a score is at most one and a half times that of the best clause, however long the text.

The built-in insults are a list; epithets are stems learnt from labelled
documents: word beginnings that stand in many different contexts of toxic documents and
(almost) never in others.  As such a word marks toxic documents whatever stands around it, it counts by itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as X

INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile loser losers pathetic scum worthless trash clown clowns disgusting stupid dumb dumbass scumbag filth filthy vermin bastard asshole "
    "idiota imbécil estúpido estúpida basura escoria abruti abrutie crétin connard connasse ordure racaille dummkopf vollidiot arschloch abschaum drecksau"
).split()
THREATS = "kill murder strangle stab destroy hurt beat töten umbringen verprügeln tuer frapper matar golpear".split()
TARGETS = "you your you're u he she they these those people everyone her his their du dein ihr sie tu vous ton ta usted ustedes tú vosotros ellos".split()
OBJECTS = "him them dich euch te toi ti".split()  # targets that can be no subject
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't can't won't cannot nicht kein keine keinen nie ne n' jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told tells called calls quoted quotes reported reports wrote writes according alleged sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split()
INTENSE = "very so such really totally utterly complete absolute fucking damn sehr total tellement vraiment très muy tan".split()
ELIDED = frozenset(("l", "d", "j", "t", "c", "s", "n", "m", "qu"))  # before an apostrophe: a word of its own
OTHER, INSULT, EPITHET, THREAT, TARGET, OBJECT, NEGATION, REPORT, MORE, STOP = range(10)
CLASSES = range(10)
BARE, BARE_EPITHET, NAMED = 0.4, 0.7, 1.5  # what a match counts without, and with, a target in its clause
Stems = tuple[tuple[str, float], ...]  # learnt stem, weight
WORD_OR_STOP = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n|\"“”»«]")


class Transducer:
    """A deterministic machine over word classes; step[(state, class)] = (next state, output).  Missing steps keep the state and put out ``neutral``."""

    def __init__(self, step: dict[tuple[object, int], tuple[object, float]], start: object, neutral: float, final: dict[object, float] | None = None):
        self.step, self.start, self.neutral, self.final = step, start, neutral, final or {}

    def move(self, state: object, cls: int) -> tuple[object, float]:
        return self.step.get((state, cls), (state, self.neutral))


def composed(match: Transducer, *scales: Transducer) -> Transducer:
    """One machine for all: a match's weight times what the others put out at the same word; states are tuples."""
    step: dict = {}
    start = (match.start, *(t.start for t in scales))
    todo, seen = [start], {start}
    while todo:
        state = todo.pop()
        for c in CLASSES:
            nxt, out = match.move(state[0], c)
            following = [nxt]
            for t, s in zip(scales, state[1:]):
                s, factor = t.move(s, c)
                following.append(s)
                out *= factor
            following = tuple(following)
            step[state, c] = (following, out)
            if following not in seen:
                seen.add(following)
                todo.append(following)
    return Transducer(step, start, 0.0)


def parts() -> tuple[Transducer, ...]:
    """The transducers of the grammar: the match, and what scales it.

    match: an insult or epithet weighs 1; a threat weighs 1.5, if its object has been named or a target is named within the
    next two words.  A target within the two words after an insult makes up for what it lacked before.
    target: one earlier in the clause raises an insult by half, without one an insult counts BARE, an epithet BARE_EPITHET.  negation:
    one at most two words before (intensifiers not counted) lowers to a fifth.  report: a reporting word earlier in the
    clause lowers to a quarter.  intensity: a word just before raises by a quarter.
    """
    match: dict = {}
    for named in (0, 1, 2):  # 1: a target, 2: an object
        for wait in (0, 1, 2):
            for lacks in (0, 1, 2):
                s = (named, wait, lacks)
                for c in CLASSES:
                    out, n, w, k = 0.0, named, max(0, wait - 1), max(0, lacks - 1)
                    if c in (INSULT, EPITHET):
                        out, k = 1.0, 0 if named else 2
                    elif c == THREAT:
                        out, w = (1.5, 0) if named == 2 else (0.0, 2)
                    elif c in (TARGET, OBJECT):
                        out = 1.5 if wait else 1.0 - BARE if lacks else 0.0
                        n, w, k = max(named, 2 if c == OBJECT else 1), 0, 0
                    elif c == STOP:
                        n = w = k = 0
                    match[s, c] = ((n, w, k), out)
    target = {(0, TARGET): (1, 1.0), (0, OBJECT): (1, 1.0), (0, INSULT): (0, BARE), (0, EPITHET): (0, BARE_EPITHET), (1, INSULT): (1, NAMED), (1, EPITHET): (1, NAMED), (1, STOP): (0, 1.0)}
    matched = (INSULT, EPITHET, THREAT, TARGET, OBJECT)
    negation: dict = {}
    for left in (0, 1, 2):
        for c in CLASSES:
            after = 0 if c == STOP else 2 if c == NEGATION else left if c == MORE else max(0, left - 1)
            negation[left, c] = (after, 0.2 if left and c in matched else 1.0)
    report = {(0, REPORT): (1, 1.0), (1, STOP): (0, 1.0)} | {(1, c): (1, 0.25) for c in matched}
    intensity = {(a, c): (int(c == MORE), 1.25 if a and c in (INSULT, EPITHET) else 1.0) for a in (0, 1) for c in CLASSES}
    return Transducer(match, (0, 0, 0), 0.0), Transducer(target, 0, 1.0), Transducer(negation, 0, 1.0), Transducer(report, 0, 1.0), Transducer(intensity, 0, 1.0)


def grammar() -> Transducer:
    return composed(*parts())


def base_classes() -> dict[str, int]:
    out: dict[str, int] = {}
    for cls, words in ((MORE, INTENSE), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (OBJECT, OBJECTS), (THREAT, THREATS), (INSULT, INSULTS)):
        out.update(dict.fromkeys(words, cls))
    return out | {"t'": OBJECT}


class Scorer:
    def __init__(self, stems: Stems):
        self.machine = grammar()
        self.classes = base_classes()
        self.weights = dict(stems)
        self.stems = re.compile("|".join(re.escape(w) for w, _ in stems)) if stems else None

    def class_of(self, word: str) -> tuple[int, float]:
        """Class of a word, and the weight of the word in it."""
        cls = self.classes.get(word)
        if cls in (None, INSULT) and self.stems is not None and (m := self.stems.match(word)):
            weight = self.weights[m.group()]
            if cls is None or weight * BARE_EPITHET > BARE:
                return EPITHET, weight
        return OTHER if cls is None else cls, 1.0

    def classes_of(self, text: str) -> Iterator[tuple[int, float]]:
        for w in WORD_OR_STOP.findall(text.lower().replace("’", "'")):
            if not w[0].isalpha():
                yield STOP, 1.0
                continue
            if "'" in w and w not in self.classes:
                head, tail = w.split("'", 1)
                if head in ELIDED:
                    if (elided := self.classes.get(head + "'")) is not None:
                        yield elided, 1.0
                    w = tail
                else:
                    w = head
            yield self.class_of(w)

    def score(self, text: str) -> tuple[float, int]:
        """Score of a document, and how many of its clauses match."""
        state, clause, clauses = self.machine.start, 0.0, []
        step = self.machine.step
        for cls, weight in self.classes_of(text):
            state, out = step[state, cls]
            clause += out * weight
            if cls == STOP:
                if clause:
                    clauses.append(clause)
                clause = 0.0
        if clause:
            clauses.append(clause)
        return round(sum(c / 3**i for i, c in enumerate(sorted(clauses, reverse=True)[:32])), 6), len(clauses)


@lru_cache(maxsize=4)
def _scorer(stems: Stems) -> Scorer:
    return Scorer(stems)


def trigger(stems: Stems) -> str:
    """A pattern that every text with a match has: an insult, a threat or a learnt stem at the start of a word."""
    tree: dict = {}
    for w in [*(x + "$" for x in (*INSULTS, *THREATS)), *(s for s, _ in stems)]:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        parts = [(r"(?![\p{L}])" if c == "$" else re.escape(c) + pattern(n)) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return r"(?iu)(?<![\p{L}])" + pattern(tree)


def learnt_stems(docs: DataFrame, labels: DataFrame, sample: int = 20_000, contexts: int = 8, odds: float = 100.0, shortest: int = 4) -> Stems:
    """Word beginnings that mark toxic documents, from at most ``sample`` labelled documents (those of the least hash of doc_id, null labels left out).

    A stem stands between at least ``contexts`` different pairs of neighbouring words in toxic documents
    and is ``odds`` times as frequent there.  Contexts, not occurrences, are counted in toxic documents, so copies
    of one document count once.  Of stems that begin each other the shortest one is taken, lengthened as
    far as all its words go on alike.  Its weight is its odds on a logarithmic scale, 1 from 1,000 up, so that
    one match of a doubtful stem is not enough.  Rows with a null doc_id, label or text teach nothing, a doc_id labelled twice is
    toxic if one of its labels says so, and texts are read whole; without toxic and clean words, as in an empty table, no stem is learnt.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id__")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id__")).where("text is not null")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    each = X.written(texts.select("toxic", tokens.alias("w")), "labelled").select("toxic", "w", F.posexplode("w").alias("i", "word")).where(F.length("word") >= shortest)
    around = F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1))
    clean = each.where("toxic = 0").groupBy("word").agg(F.count(F.lit(1)).alias("clean"))
    toxic = each.where("toxic = 1").select("word", around.alias("c")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("toxic"))
    both = X.written(toxic.join(clean, "word", "full").na.fill(0), "word-counts")
    n = both.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n[0] or not n[1]:
        return ()
    stem = F.expr("substring(word, 1, n)")
    stems = (
        both.select("word", "toxic", "clean", F.explode(F.sequence(F.lit(shortest), F.length("word"))).alias("n"))
        .groupBy(stem.alias("stem"))
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= contexts) & (F.col("toxic") / n[0] >= odds * (F.col("clean") + 0.5) / n[1]))
    )
    # the longest stem of those that share their counts with the stem one letter shorter; then the shortest of a family
    found = {r[0]: (r[1], r[2]) for r in stems.collect()}
    out: list[str] = []
    for s in sorted(found, key=len):
        if any(s.startswith(o) for o in out):
            continue
        out.append(s)
    for i, s in enumerate(out):
        while longer := [x for x in found if len(x) == len(s) + 1 and x.startswith(s) and found[x] == found[s]]:
            s = longer[0]
        out[i] = s
    weight = {s: min(1.0, math.log10(found[s][0] / n[0] * n[1] / (found[s][1] + 0.5)) / 3) for s in out}
    return tuple(sorted((s, round(w, 4)) for s, w in weight.items()))


def _emit(stems: Stems):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(stems).score
        for b in batches:
            found = [score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "score", "n_clauses"])

    return run


def toxic_documents(docs: DataFrame, stems: Stems = (), threshold: float = 0.6) -> DataFrame:
    """(doc_id, score, n_clauses, is_toxic): the documents whose score reaches the threshold; is_toxic is true in all of them.

    docs needs doc_id and text.  Null and empty texts score 0; texts of any length are read whole; null ids and repeated rows are
    kept as they are, each scored by itself; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(trigger(stems)))
    return slim.mapInArrow(_emit(stems), f"doc_id {kind}, score double, n_clauses long").where(F.col("score") >= threshold).withColumn("is_toxic", F.lit(True))


def _score_udf(stems: Stems) -> Column:
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        of = _scorer(stems).score
        return pd.Series([of(t)[0] if t else 0.0 for t in text], dtype="float64")

    text = F.col("text").cast("string")
    return score(F.when(text.rlike(trigger(stems)), text))  # other texts are not sent to Python


def without_toxic(docs: DataFrame, stems: Stems = (), threshold: float = 0.6) -> DataFrame:
    """docs without the documents whose score reaches the threshold, with the columns of docs.

    Null and empty texts stay, as do rows without doc_id whose text passes; repeated rows are judged each by itself; an empty table gives an empty one.
    """
    return X.unpacked(X.packed(docs, __score__=_score_udf(stems)).where(F.coalesce("__score__", F.lit(0.0)) < threshold))
