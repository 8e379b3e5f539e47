"""A corpus made ready for training: five of the corpus operators, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modaleda.core.ship import ship
from modaleda.llm import chosen_path, frames, heavy_dedup, mixing, packing, toxicity

ORACLE_SQL: str | None = None  # the toxicity grammar and column generation are beyond SQL


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject; its stems are learnt from the labels of the folder.

    Null and empty texts stay, long ones are read whole, repeated rows are judged each by itself, an empty table gives an empty one.
    """
    ship(spark)
    stems = toxicity.learnt_stems(docs, frames.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, stems)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of smallest doc_id.

    Rows with a null text stay, empty texts are copies of each other, null ids count as the largest; of rows that repeat one stays;
    an empty table gives an empty one.
    """
    ship(spark)
    return heavy_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one of smallest doc_id.

    Rows with a null doc_id, and texts that are null or without words, stay, as do rows that are similar to none; texts are compared
    whole; of rows that repeat one stays; an empty table gives an empty one.
    """
    ship(spark)
    return chosen_path.one_of_each_group(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the blocks that the apportionment takes of each source.

    A null source is a source of its own (""), a null or empty text has no tokens but a place, a long one lies where it begins, repeated
    rows are placed each by itself; an empty table gives an empty one.
    """
    ship(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: which tokens of which document each holds.

    Null texts and those without tokens take no place, long ones are cut to several sequences, repeated rows are packed each by itself;
    an empty table gives no sequences.
    """
    ship(spark)
    return packing.packed_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; what a stage keeps is written to the shared folder and read by the next."""
    docs, before = frames.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with frames.scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads what went into this stage any more
            frames.dropped(before)
        before = docs
    return docs
