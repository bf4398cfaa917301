"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

1. Every source gets a target in words: its weight's share of share x all words, at most twice its own words; what exceeds
   that is shared again by weight among the others (the level is found in closed form over the sorted ratios).
2. The documents of a source are permuted by a keyed hash; their words, once and then once more, form one line. The source's
   mix is that line up to its target, so no document is taken more than twice; the line is cut into blocks of equal words.
3. The exact block quotas go down a binary tree over the output shards. At each node all its blocks are ranked by a keyed
   hash and cut at the left child's share; the counts by source on the left are then a multivariate-hypergeometric draw.
   The leaves hold disjoint blocks, whose documents are shuffled inside their shard by a keyed hash.

Defined cases: a null text, or one without words, has size 0 and is never taken; a null source is a source of its own and
the last; a null doc_id hashes as the empty string; equal rows are interchangeable; sources without words have target 0;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm._shared import apart, cut, shuffle_partitions, with_prefix

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks that the mix is cut into, besides one begun block for each source.
BLOCKS = 4096
#: Rows of block ends (about 100 bytes each) up to which they are broadcast; more are joined.
BROADCAST_BLOCKS = 100_000


def _key(seed: str, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts]))


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each source: source, source_no (by code point, null last, from 0), source_size, source_before (words of the sources ahead), target.

    sizes (source, size) has a row for each document; what follows the first grouping has a row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    totals = totals.withColumn("source_no", F.row_number().over(order) - 1)
    totals = totals.withColumn("source_before", F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("_cap", 2 * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "source_no")
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    totals = totals.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
    totals = totals.withColumn("_caps", F.sum("_cap").over(upto) - F.col("_cap")).withColumn("_used", F.sum("weight").over(upto) - F.col("weight"))
    # The level if the sources ahead in the order are at their caps and the others are not. It rises as long as a source
    # that lies below the level is set to its cap and falls after that, so the right one is the largest.
    level = (F.lit(share) * F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_used"))
    totals = totals.withColumn("_level", level)
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.max("_level").over(everything))
    return totals.withColumn("target", target).select("source", "source_no", "source_size", "source_before", "target")


def mix_plan(docs: DataFrame, shards: int = 8, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, and for the first
    and second time it is taken the block of its source (block_1, block_2) and the output shard (shard_1, shard_2).

    The texts are read once; only narrow columns are shuffled. Documents are dealt by ranges of (source, hash), so a
    source with a third of all rows fills many partitions.
    """
    narrow = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).withColumn("_hash", _key(seed, "doc_id")).withColumn("_tie", F.monotonically_increasing_id())
    narrow = cut(narrow.hint("rebalance"))  # a file for each advisory size, not for each part of the texts
    sources = cut(source_targets(narrow, share, weights))
    ranked = narrow.join(sources, narrow["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = with_prefix(ranked, ["source_no", "_hash", "doc_id", "size", "_tie"], "size")
    start = F.col("before") - F.col("source_before")
    middle = F.col("size") / 2
    placed = placed.withColumn("_start", start).withColumn("_once", (F.col("size") > 0) & (start + middle < F.col("target"))).withColumn("_twice", (F.col("size") > 0) & (F.col("source_size") + start + middle < F.col("target")))
    tree = split_tree(sources, shards, seed).select("source_no", "block", "shard")
    width = sources.agg(F.greatest(F.lit(1.0), F.sum("target") / BLOCKS).alias("_width"))  # one row
    placed = placed.crossJoin(F.broadcast(width))
    first = F.floor((F.col("_start") + middle) / F.col("_width"))
    second = F.floor((F.col("source_size") + F.col("_start") + middle) / F.col("_width"))
    placed = placed.withColumn("_block_1", F.when(F.col("_once"), first)).withColumn("_block_2", F.when(F.col("_twice"), second))
    for k in (1, 2):
        own = tree.select(F.col("source_no").alias(f"_no_{k}"), F.col("block").alias(f"_b_{k}"), F.col("shard").alias(f"shard_{k}"))
        placed = placed.join(own, (F.col("source_no") == F.col(f"_no_{k}")) & (F.col(f"_block_{k}") == F.col(f"_b_{k}")), "left")
    times = F.col("shard_1").isNotNull().cast("long") + F.col("shard_2").isNotNull().cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), *[F.col(f"_block_{k}").alias(f"block_{k}") for k in (1, 2)], "shard_1", "shard_2")


def split_tree(sources: DataFrame, shards: int = 8, seed: str = "mix") -> DataFrame:
    """(source_no, block, shard) for every block of the mix; shards must be a power of two. BLOCKS rows and one for each source, whatever the documents are."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    width = F.greatest(F.lit(1.0), F.sum("target").over(Window.partitionBy()) / BLOCKS)
    quotas = sources.withColumn("_quota", F.ceil(F.col("target") / width)).where("_quota > 0")
    blocks = quotas.select("source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_quota") - 1)).alias("block")).withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        nth = F.row_number().over(node.orderBy(_key(f"{seed}:{level}", "source_no", "block"), "source_no", "block"))
        blocks = blocks.select("source_no", "block", (2 * F.col("shard") + (2 * nth > F.count("*").over(node) + 1).cast("int")).alias("shard"))
    return blocks


def mix_documents(docs: DataFrame, shards: int = 8, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """docs with every row as often as the mix takes it (0, 1 or 2 times), dealt by the tree's shards and shuffled inside them.

    A block of a source is a range of its hash order, so the last key of each block places a row: blocks are listed under
    each beginning of a hash that they touch, and a row finds its own by source and beginning. There are as many rows of
    blocks as the tree has, and one for each source and beginning; up to BROADCAST_BLOCKS they are broadcast, more are
    joined. The texts are shuffled once, to the parts of the output shards, in which a keyed hash orders them. Rows that
    agree in doc_id and size count as one.
    """
    key = ["_hash", "doc_id", "size"]
    inner, back = apart(docs, "doc_id", "text", "source")
    plan = mix_plan(inner, shards, share, weights, seed).withColumn("_hash", _key(seed, "doc_id"))
    taken = plan.select("source", F.struct(*key).alias("_own"), F.explode(F.array(*[F.struct(F.lit(k).alias("_copy"), F.col(f"block_{k}").alias("_block"), F.col(f"shard_{k}").alias("_shard")) for k in (1, 2)])).alias("_t")).select("source", "_own", "_t.*")
    blocks = taken.where("_shard is not null").groupBy("source", "_copy", "_block", "_shard").agg(F.max("_own").alias("_end"))
    # A block begins where the one before it ends, wherever its own first row lies, so that every row is in one.
    before = F.lag("_end").over(Window.partitionBy("source", "_copy").orderBy("_block"))
    blocks = blocks.withColumn("_after", before)
    first, last = (F.conv(F.substring(F.coalesce(F.col(f"{c}._hash"), F.lit("00")), 1, 2), 16, 10).cast("int") for c in ("_after", "_end"))
    blocks = cut(blocks.withColumn("_begins", F.explode(F.sequence(first, last))).withColumnRenamed("source", "_source"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = inner.withColumn("_hash", _key(seed, "doc_id")).withColumn("_own", F.struct("_hash", "doc_id", size.alias("size")))
    near = F.conv(F.substring(F.col("_own._hash"), 1, 2), 16, 10).cast("int") == F.col("_begins")
    inside = (F.col("_own") <= F.col("_end")) & (F.col("_after").isNull() | (F.col("_own") > F.col("_after"))) & (F.col("_own.size") > 0)
    rows = rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, near & F.col("source").eqNullSafe(F.col("_source")) & inside)
    rows = rows.withColumn("_place", _key(f"{seed}:place", "_copy", "doc_id"))
    parts = shuffle_partitions(docs.sparkSession)
    dealt = rows.repartition(parts, "_shard", F.substring("_place", 1, 4)).sortWithinPartitions("_shard", "_place")
    return back(dealt)
