"""The queries op1_ to op10_: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands in for a secret that a deployment hands over.
PII_KEY = b"rillmark-demonstration-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.pii import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_replaced", "replaced")


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.sharding import assign_shards

    rows = assign_shards(_table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.chat import collapse

    return collapse(_table(spark, sf_dir, "conversations"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.warc import round_trip

    rows = round_trip(_table(spark, sf_dir, "pages")).where("not gap")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.decontam import judged, mark

    marked = judged(mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.embed_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.quality_mil import held_out, score_quality

    scored = score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.mixing import mix_plan

    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard_1", "shard_2")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii_pseudonyms, op2_byte_shards, op3_chat_collapse, op4_main_text, op5_warc_round_trip, op6_decontaminate, op7_near_vectors, op8_quality, op9_mix_sources, op10_near_dedup)}
