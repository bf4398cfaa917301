"""Counters, budgets and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def high_water(changes: DataFrame) -> DataFrame:
    """Largest running balance of each ledger (ledger_id, at, sequence, delta_bytes, delta_objects), and what is left at the end.

    At equal times releases come first.
    """
    w = Window.partitionBy("ledger_id").orderBy("at", "delta_bytes", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.withColumn("_b", F.sum("delta_bytes").over(w)).withColumn("_o", F.sum("delta_objects").over(w))
    return rows.groupBy("ledger_id").agg(F.max("_b").alias("high_bytes"), F.max("_o").alias("high_objects"), F.sum("delta_bytes").alias("left_bytes"))


def reservation_counts(verdicts: DataFrame) -> DataFrame:
    """Of each ledger (ledger_id, verdict, delta_bytes, delta_objects) what was granted and released, and how often it was under pressure."""
    granted, gave = F.col("verdict") == "granted", F.col("verdict") == "release"
    return verdicts.groupBy("ledger_id").agg(
        F.count_if(granted).alias("reservations"), F.count_if(gave).alias("releases"), F.count_if(F.col("verdict") == "pressure").alias("pressure"),
        F.sum(F.when(granted, F.col("delta_bytes")).otherwise(0)).alias("reserved_bytes"), F.sum(F.when(gave, -F.col("delta_bytes")).otherwise(0)).alias("released_bytes"),
    )


def roll_up(branches: list[DataFrame]) -> DataFrame:
    """Totals of each output over all its branches (output, bytes, packets, errors, at): sums, the branches, the last time."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)])
    return rows.groupBy("output").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.sum("errors").alias("errors"), F.countDistinct("branch").alias("branches"), F.max("at").alias("last_at"))


def skew_percentiles(rows: DataFrame, p95_limit: int, p99_limit: int) -> DataFrame:
    """Exact 95th and 99th percentiles of the absolute skew of each stream, and whether both stay within their limits."""
    size = F.abs("skew").cast("double")
    out = rows.groupBy("stream_id").agg(F.percentile(size, F.lit(0.95)).alias("p95"), F.percentile(size, F.lit(0.99)).alias("p99"))
    return out.withColumn("within", (F.col("p95") <= p95_limit) & (F.col("p99") <= p99_limit))


def backpressure(queues: DataFrame) -> DataFrame:
    """Adds pressure from size, capacity, high and critical, the gravest first."""
    size = F.col("size")
    return queues.withColumn("pressure", F.when(size >= F.col("capacity"), "full").when(size >= F.col("critical"), "critical").when(size >= F.col("high"), "high").otherwise("healthy"))


def node_profile(calls: DataFrame) -> DataFrame:
    """Calls, errors, total, largest and average (whole) time of each node."""
    rows = calls.groupBy("node").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum("elapsed").alias("total"), F.max("elapsed").alias("largest"))
    return rows.withColumn("average", F.expr("total div calls"))


def bottlenecks(calls: DataFrame, threshold: int) -> DataFrame:
    """Nodes whose average reaches the threshold."""
    return node_profile(calls).where(F.col("average") >= threshold).select("node", "average")


def queue_counters(outcomes: DataFrame) -> DataFrame:
    """How many records each edge pushed, popped, dropped and failed to push."""
    kinds = ("pushed", "popped", "dropped", "failed")
    return outcomes.groupBy("edge").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def worst_lateness(sent: DataFrame) -> DataFrame:
    """Of each stream the largest lateness and the first record that had it."""
    best = sent.groupBy("stream_id").agg(F.min(F.struct((-F.col("lateness")).alias("_l"), F.col("sequence"))).alias("_b"))
    return best.select("stream_id", (-F.col("_b._l")).alias("lateness"), F.col("_b.sequence").alias("sequence"))


def progress(observations: DataFrame, deadline: int) -> DataFrame:
    """Whether each observation (stream_id, sequence, at, worker, output) shows progress: any worker's before the first output, only the output's after it; stalled if there was none for deadline."""
    w = Window.partitionBy("stream_id").orderBy("at", "sequence")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    had_output = F.coalesce(F.max("output").over(before), F.lit(0)) > 0
    more_output = F.col("output") > F.coalesce(F.max("output").over(before), F.lit(0))
    more_work = F.col("worker") > F.coalesce(F.max("worker").over(before), F.lit(0))
    rows = observations.withColumn("progress", more_output | (~had_output & more_work))
    last = F.max(F.when(F.col("progress"), F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stalled", F.col("at") - F.coalesce(last, F.min("at").over(w.rowsBetween(Window.unboundedPreceding, 0))) > deadline)


def latest_routes(changes: DataFrame) -> DataFrame:
    """The last change of each route (route_id, at, target, deleted) that isn't a deletion."""
    last = changes.groupBy("route_id").agg(F.max(F.struct("at", "sequence", "deleted", "target")).alias("_l")).where("not _l.deleted")
    return last.select("route_id", "_l.target", "_l.at")
