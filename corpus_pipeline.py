"""The corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``; the last returns
pieces of packed sequences. A stage reads only what the one before it kept, and of the other tables only ``labels``.

Defined results: without labels of both kinds the filters keep everything; null and empty texts are scored as texts without
words and link to nothing; rows alike in doc_id and text are one document from ``near_duplicates`` on, rows that share only a doc_id are
two; rows without doc_id are scored, never deduplicated, and packed under a null doc_id; an empty table gives an empty result at every
stage; columns beyond those of ``documents`` are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideline.llm import forest, ordinal, packing, passages, repeats
from tideline.llm.common import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the cut; the model learns from labelled documents among ``docs``."""
    return ordinal.reject_toxic(docs, ordinal.train_toxicity(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; the model learns from labelled documents among ``docs``, but for the held-out ones."""
    return passages.keep_good(docs, passages.train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return forest.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages."""
    return repeats.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. The workers have other stages behind them, so their cache of words is kept smaller."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=400_000)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
