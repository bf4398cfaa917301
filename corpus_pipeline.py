"""A corpus pipeline of five stages: quality, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet in the shared
folder and read again. The first four return the columns of documents: the quality stage drops rejected documents, near-dedup
keeps one document of each group, decontamination drops contaminated ones, mixing repeats every document as often as the mix
takes it (0 to 2 times), dealt by output shard. The last returns the shard and slot of every row that is left.

Defined cases: null and empty texts are scored like any other and, if kept, are no near-duplicates, not contaminated and never
mixed in, having no words; rows with a null doc_id are near-duplicates of nothing; of rows with one doc_id and one text one is
kept, different texts of a kept document stay; an empty table passes every stage empty; extra columns, whatever their names,
are carried through all stages but the last, which does not return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm._shared import written
from rillmark.llm.decontam import decontaminate
from rillmark.llm.minhash import drop_near_duplicates
from rillmark.llm.mixing import mix_documents
from rillmark.llm.quality_mil import keep_quality
from rillmark.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = assign_shards(docs, 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Trained models, hashes of words and CRC-32 are beyond SQL; the stages are tested one by one: near-dedup, mixing and sharding against brute force, the quality stage against the operator's scores, decontamination against op6, which has a brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
