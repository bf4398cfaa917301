"""Contiguous shards of nearly equal bytes, from a prefix sum over all documents.

Law `bytes`: in the order of doc_id every document has a byte offset; shard k takes the documents whose middle lies in the
k-th of n equal parts of the total. Sizes differ by at most one document at each cut. Equal texts are not kept together: a
group of copies may be larger than a shard.

Defined cases: a null text has no bytes and size 1, and the CRC of the empty text; a null doc_id comes first; rows that
agree in doc_id are ordered by text_crc32 and size, and rows that agree in all three are interchangeable; an empty table
gives an empty result; other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm._shared import crc32_text, cut, with_prefix

ORDER = ["doc_id", "text_crc32", "size", "_tie"]


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place in the shard, from 0) of every row of docs (doc_id, text).

    Only these narrow columns are shuffled, never the text. The texts are read once.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
    ).withColumn("_tie", F.monotonically_increasing_id())
    placed = cut(with_prefix(cut(narrow), ORDER, "size"))
    total = placed.agg(F.max(F.col("before") + F.col("size")).alias("_total"))  # one row
    placed = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"(2 * before + size) * {shards} div (2 * _total)").cast("int"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("_start"))  # a row for each shard
    placed = placed.join(F.broadcast(first), "shard")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("_start")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes every row of docs under path, a folder shard=k for each shard.

    A shard is a range of the order, so the first key of each shard places a row: the texts go from the scan to the files
    without a shuffle or a join.
    """
    placed = assign_shards(docs, shards).groupBy("shard").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_crc32", "size")).alias("key"))
    keys = sorted((r.shard, r.key) for r in placed.collect())  # a row for each shard
    own = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", crc32_text(F.col("text")).alias("text_crc32"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    shard = F.lit(0)
    for k, key in keys[1:]:
        doc_id = F.lit(key["doc_id"]).cast("long")
        shard = F.when(own >= F.struct(F.lit(key["known"]).alias("known"), doc_id.alias("doc_id"), F.lit(key["text_crc32"]).alias("text_crc32"), F.lit(key["size"]).alias("size")), k).otherwise(shard)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
