"""Corpus pipeline: five stages over ``documents``, each written as Parquet and
read again as the input of the next.

1. toxicity: documents that the clause grammar rejects go;
2. near duplicates: of each group linked by the n-gram Jaccard join one stays;
3. decontamination: documents that hold a benchmark passage go;
4. mixing: documents are taken to the target weights of their sources, a
   document as often as the mix takes it (up to three times);
5. sharding: every row gets its extendible-hashing shard.

Each stage is judged on its own input: models, counts and targets are computed
from the documents that the stage receives. All but the last return the columns
of ``documents``; the last returns doc_id, n_bytes, shard, depth and page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketframe.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from marketframe.llm.common import stored, table
from marketframe.session import configure


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(configure(spark), sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(configure(spark), sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.select_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return sharding.shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None  # a learned model and the knapsack fit are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
