"""A corpus pipeline of five stages over `documents`; each stage's result is written as Parquet and read again.

Toxic documents go; one document of each near-duplicate group stays; benchmark passages are cut out (documents that
consist of them go); sources are mixed to target weights; the rest is encoded to token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obsframe.llm import decontaminate, mixing, simhash, simple8b, toxicity
from obsframe.llm.work import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simple8b.token_table(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark), ("mixing", mix), ("token_ids", encode)]

#: Learned scores, fingerprints and encodings have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
