"""The corpus pipeline: five stages from raw documents to ordered shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the documents of the next stage. All but
the last keep the columns of ``documents``.

toxicity           drops documents that the ordinal model rejects
near_duplicates    keeps one document of each group of near copies
decontamination    drops documents with benchmark passages
source_mix         keeps what fits the budgets of the source tree, one epoch
sharding           orders the rest along the Hilbert curve and cuts 16 shards

Rows of any stage may repeat or hold nulls; what then happens is said by the
operators. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm import decontaminate, forest, hilbert, mixing, toxicity
from panelmark.llm.common import table
from panelmark.llm.queries import DOMAIN, WEIGHTS
from panelmark.session import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, toxicity.fit(toxicity.graded(docs, table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, F.expr(DOMAIN), WEIGHTS, Fraction(4, 5), seed=11).select(docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", cut_shards),
]

#: the first stage learns a model, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
