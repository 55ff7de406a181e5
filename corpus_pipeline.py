"""Training-data pipeline: reject toxic documents, keep one of each near-duplicate
group, drop benchmark leaks, mix sources to target weights, write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents.  All but the last keep the columns of
documents, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.llm import decontaminate, mixing, neardup, tokenfile, toxicity
from fleetline.llm.common import materialise
from fleetline.llm.queries import vocabulary
from fleetline.sources.scratch import drop_scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxicity_score(model, F.col("text")) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(spark, docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_file", write_token_ids),
]

ORACLE_SQL = None  # a model, hashes and random draws; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's table is removed when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, *before)
        before = sorted({f.rsplit("/", 1)[0] for f in docs.inputFiles()})
    out = STAGES[-1][1](spark, docs, sf_dir)  # its files are written, and are all that it reads
    drop_scratch(spark, *before)
    return out
