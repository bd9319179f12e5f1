"""From raw documents to packed sequences.

Each stage is ``(spark, docs, folder) -> DataFrame``; its rows are written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatlens.llm import exact_dedup, near_dedup, packing, pii, toxicity
from heatlens.llm.common import read_table, staged
from heatlens.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the grammar, taught by all labels, holds to be toxic."""
    model = toxicity.train(docs, read_table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, "__toxic")
    return scored.filter("__toxic < 0.5").drop("__toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE, end_id=1, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

# SQL can't express the classifier, MinHash or tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
