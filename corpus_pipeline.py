"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm import language_id, mixing, near_dedup, pieces, suffix_dedup
from sitesift.llm.common import materialise, remainder, table


#: op5 takes 85 by its contract; the stage takes copies from 0.8.
NEAR_PER_CENT = 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter or without a likely language go."""
    model = language_id.fit(docs, F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    return language_id.kept_languages(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarities of `NEAR_PER_CENT` or more."""
    return near_dedup.keep_one(docs, per_cent=NEAR_PER_CENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that stand elsewhere too."""
    return suffix_dedup.without_repeats(docs, unit=suffix_dedup.PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the target weights of the sources take; a document that is taken twice is there twice."""
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of texts."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("suffix_dedup", without_repeats),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL expresses neither the network nor the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
