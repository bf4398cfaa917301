"""What several operators need: stable intermediate results, prefix sums over a global order, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only for a local session that has none, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rillmark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: what follows reads the copy in the shared folder, whichever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the used ones under names that can't clash, and the way back to df's own columns."""
    own = {c: c if c in used else f"_own{i}" for i, c in enumerate(df.columns)}
    there = df.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    return there, lambda out: out.select(*[F.col(x).alias(c) for c, x in own.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as a Parquet table: compressed, and read by column."""
    return Scratch(df.sparkSession, name).keep(df)


class Scratch:
    """Tables of one computation in the shared folder, as by written(), which can be dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self.paths.pop(id(frame))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_prefix(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds before (the sum of value over all rows that come earlier in the order) and rank (how many those are).

    Rows are dealt by ranges of the order, each partition adds up its own, and the totals of the partitions, one row each,
    give every partition its start. The ranges are cut from a sample, so the dealt rows are kept before they are read
    twice; adaptive execution may put small neighbouring ranges into one, which leaves fewer files. An order that tells
    all rows apart keeps a frequent key from filling one partition.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    starts = starts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("_upto", F.sum(value).over(inside)).withColumn("_nth", F.count("*").over(inside))
    rows = rows.join(F.broadcast(starts), "_part")  # as many rows as there are partitions
    before = F.col("_base") + F.col("_upto") - F.col(value)
    return rows.withColumn("before", before).withColumn("rank", F.col("_first") + F.col("_nth") - 1).drop("_part", "_upto", "_nth", "_base", "_first")


#: Edges for a partition of the rounds of components(), and for one reduction inside a partition.
EDGES = 100_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What hangs together by the pairs (a, b) as stars: every node but the smallest of each component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as the stars that they make, so many at a time: no more edges than there are nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        found = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(x) for x, _ in held) >= 4 * EDGES:
            yield out()
            held = []
    if held:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star: (node, component), the smallest node being the name.

    Only nodes with an edge are returned. Each step is a grouped minimum (summed before the shuffle, so a node with very
    many neighbours is no hot spot) and a join that adaptive execution may split. Before they are written, the edges of
    each partition are reduced to stars, which takes most of the rounds; a round runs in as many tasks as its edges need.
    The edges of a round are dropped when those of the next one are written; only their number and a hash reach the driver.
    """
    kept = Scratch(edges.sparkSession, "edges")
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    wide = kept.keep(pairs.mapInArrow(_reduced, "a long, b long"))
    rows = wide.count()
    e = kept.keep(wide.coalesce(max(1, -(-rows // EDGES))).mapInArrow(_reduced, "a long, b long"))
    kept.drop(wide)
    seen = _state(e)
    while seen[0]:
        parts = -(-seen[0] // EDGES)
        near = e.coalesce(parts)
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = kept.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts))
        near = large.coalesce(parts)
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        small = near.join(least, "a").select("b", "m", "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        fresh = kept.keep(small.coalesce(parts).mapInArrow(_reduced, "a long, b long"))
        now = _state(fresh)
        kept.drop(e, large)
        e = fresh
        if now == seen:
            break
        seen = now
    e = e.coalesce(max(1, -(-seen[0] // EDGES)))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
