"""The corpus pipeline: language ID, exact and near duplicates, mixing by source, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. Stages are written as Parquet and read again between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsieve.llm import exact_dedup, language_mixture, mixing, packing, simhash
from cloudsieve.llm.common import quoted, written

#: A document stays if one language has at least this share of it.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language of at least half of the text; null and letterless texts go."""
    model = language_mixture.fit(docs.where(~language_mixture.held_out("doc_id")))
    found = language_mixture.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(
        *[quoted(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*[quoted(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component."""
    return simhash.one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("packing", pack)]

#: Model inference, fingerprints, rounding and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; between stages tables are written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
