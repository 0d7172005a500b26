"""From raw documents to packed training sequences; counted as part of quire.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All
but the last return the columns of documents.

1. language: documents go whose text has no letter or whose language isn't sure.
2. toxicity: documents go whose score reaches the threshold.
3. near_duplicates: one document of each group of near copies stays.
4. pii: personal data in texts is replaced by its kind; every document stays, with all its columns whatever their names.
5. packing: pieces of documents with their places in sequences of 2048 tokens.

A stage gets what its predecessor kept, and learns from that alone (and from labels).
Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, neardup, packing, pii, toxicity
from quire.llm.common import materialize, table

#: Below this probability no language is taken as known.
SURE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs), least=SURE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_copies(docs, size=5, percent=80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "word_bpe_49k.json", budget=2048, end_id=0)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("pii", personal),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Stages with trained models and tokenizers can't be expressed in SQL; tests hold near duplicates, what stays and the pieces against plain versions.
ORACLE_SQL = None
