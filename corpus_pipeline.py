"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet before the next one reads it.

1. toxicity: documents whose score reaches their language's threshold go.
2. near_duplicates: one document of each group of near copies stays (five words, 0.8).
3. pii: private values become format-preserving pseudonyms.
4. mixing: documents repeat as the source schedule takes them.
5. sentencepiece: piece ids instead of texts.

Nulls and edges, in every stage: columns beyond those of documents pass through, whatever their names (the last stage
returns its own columns); a null or empty text is never toxic, is no copy of another, holds nothing private and is not taken
by the mix; rows that repeat are copies of each other; rows without doc_id are judged like others, the one with a doc_id
stays; very long texts are whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import jaccard_join, mixing, pii, sentencepieces, toxicity
from orrery.llm.queries import pii_key
from orrery.sources.scratch import clearing, delete, new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, width=5, percent=80)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii_key(spark), count=None, kinds=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of every document of the mix."""
    coded = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), keep_text=False)
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither a trained classifier nor keyed permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; every stage's table is written to the shared scratch folder, and kept until the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        with clearing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
