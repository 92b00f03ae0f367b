"""The corpus pipeline: each stage reads what its predecessor kept and applies one text operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaloom.llm import decontam, jaccard, langid, mixing, tokens
from chromaloom.llm.common import table
from chromaloom.llm.queries import tokenizer_file

REPETITION = 1.25      # how often the most repeated source may be read while the least repeated is read once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go; the rest stays."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays: the one with the smallest id."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are read in epochs by temperature weights; every document is read at least once."""
    return mixing.apply_mix(docs, repetition=REPETITION)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The id file of the mix, read back: doc_id, start, n_tokens and ids_crc32 of every row."""
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return tokens.round_trip(docs, f.read())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_ids", token_ids)]

ORACLE_SQL = None      # trained classifiers and a tokenizer are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
