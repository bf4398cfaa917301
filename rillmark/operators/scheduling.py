"""Ordered merging, sync decisions, budgets and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Planned thresholds in microseconds, and how many recoveries may follow one another.
EARLY, LATE, DROP, HARD, BUDGET = 20_000, 40_000, 80_000, 250_000, 5


def ordered_merge(units: DataFrame) -> DataFrame:
    """Two sides (side 0 and 1) of each stream in one line: older generation first, then the earlier dispatch; adds position.

    At equal times the side goes that was not emitted last, side 0 at a generation's start. Among records of one time the
    sides take turns until one has no more, so the side with more of them is last, and equal numbers leave the last as it was:
    the first of a time is the other side of the last time before at which the numbers differ.
    """
    key = ["stream_id", "generation", "dispatch"]
    counts = units.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("_zero"), F.count_if(F.col("side") == 1).alias("_one"))
    more = F.when(F.col("_zero") != F.col("_one"), (F.col("_one") > F.col("_zero")).cast("int"))
    earlier = Window.partitionBy("stream_id", "generation").orderBy("dispatch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, (1 - F.coalesce(F.last(more, ignorenulls=True).over(earlier), F.lit(1))).alias("_first"))
    turn = F.row_number().over(Window.partitionBy(*key, "side").orderBy("sequence"))
    rows = units.withColumn("_turn", turn).join(counts, key)
    w = Window.partitionBy("stream_id").orderBy("generation", "dispatch", "_turn", F.col("side") != F.col("_first"), "sequence")
    return rows.withColumn("position", F.row_number().over(w)).drop("_turn", "_first")


def sync_decision(rows: DataFrame) -> DataFrame:
    """Adds decision from target, now, dispatch, horizon and key_frame; the first rule that holds wins."""
    e, h = F.col("target") - F.col("now"), F.col("dispatch") - F.col("horizon")
    decision = F.when(e <= -HARD, "Reacquire").when(h > EARLY, "Hold").when(e >= -LATE, "Display").when(e > -DROP, "DisplayLate").when(F.col("key_frame"), "DisplayPreservedKeyFrame").otherwise("Drop")
    return rows.withColumn("decision", decision)


def sync_budget(decided: DataFrame) -> DataFrame:
    """Replaces every recovery that exceeds the budget by Reacquire: in a run of recoveries (Hold neither counts nor ends one) each (BUDGET + 1)-th."""
    recovery = F.col("decision").isin("DisplayLate", "DisplayPreservedKeyFrame", "Drop")
    w = Window.partitionBy("stream_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    ends = ~recovery & (F.col("decision") != "Hold")
    rows = decided.withColumn("_run", F.sum(ends.cast("int")).over(w))
    inside = Window.partitionBy("stream_id", "_run").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.sum(recovery.cast("int")).over(inside))
    final = F.when(recovery & (F.col("_p") % (BUDGET + 1) == 0), "Reacquire").otherwise(F.col("decision"))
    return rows.withColumn("final_decision", final).drop("_run", "_p")


def leaky_bucket(units: DataFrame, rate: int) -> DataFrame:
    """Departure of each record at a fixed rate of bytes a second (times in microseconds): no earlier than its release and its predecessor's end; adds departs and ends."""
    w = Window.partitionBy("stream_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("_d", F.expr(f"(bytes * 1000000 + {rate - 1}) div {rate}"))
    rows = rows.withColumn("_sum", F.sum("_d").over(w))
    rows = rows.withColumn("ends", F.col("_sum") + F.max(F.col("pts") + F.col("_d") - F.col("_sum")).over(w))
    return rows.withColumn("departs", F.col("ends") - F.col("_d")).drop("_d", "_sum")


def affine_schedule(units: DataFrame, source_start: int, master_start: int, lead: int) -> DataFrame:
    """Maps pts to the master clock and gives the time to emit; increasing says whether it exceeds its predecessor's."""
    w = Window.partitionBy("stream_id").orderBy("sequence")
    rows = units.withColumn("on_master", F.col("pts") - source_start + master_start).withColumn("emit_at", F.col("pts") - source_start + master_start - lead)
    return rows.withColumn("increasing", F.coalesce(F.col("emit_at") > F.lag("emit_at").over(w), F.lit(True)))
