"""Canonical intervals: durations from what a record knows, epochs, releases, continuity, source clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def durations(units: DataFrame, rate: int) -> DataFrame:
    """Adds duration_ns by mode (samples at rate, mapped nanoseconds, or ticks of tb_num / tb_den seconds), to the nearest nanosecond, and error where there is no positive evidence."""
    samples = F.expr(f"(samples * 1000000000 + {rate // 2}) div {rate}")
    ticks = F.expr("(ticks * tb_num * 1000000000 + tb_den div 2) div tb_den")
    value = F.when(F.col("mode") == "samples", samples).when(F.col("mode") == "mapped", F.col("mapped_ns")).when(F.col("mode") == "ticks", ticks)
    rows = units.withColumn("_v", value)
    return rows.withColumn("duration_ns", F.when(F.col("_v") > 0, F.col("_v"))).withColumn("error", F.when(F.coalesce(F.col("_v") > 0, F.lit(False)), None).otherwise("no_duration")).drop("_v")


def numbered(units: DataFrame) -> DataFrame:
    """Adds number, from 0 in each stream and generation."""
    w = Window.partitionBy("stream_id", "generation").orderBy("sequence")
    return units.withColumn("number", (F.row_number().over(w) - 1).cast("long"))


def bind_epoch(units: DataFrame, epochs: DataFrame) -> DataFrame:
    """Records of streams that have an epoch (stream_id, generation, source_start, master_release), on the master clock; those before its start are dropped. An epoch is a row for each stream."""
    rows = units.join(epochs, ["stream_id", "generation"]).where(F.col("pts") >= F.col("source_start"))
    return rows.withColumn("on_master", F.col("pts") - F.col("source_start") + F.col("master_release")).drop("source_start", "master_release")


def release(units: DataFrame, width: int) -> DataFrame:
    """A row for each stream and stretch of width: its records, in order, as an array (what a release carries)."""
    rows = units.withColumn("stretch", F.expr(f"pts div {width}"))
    return rows.groupBy("stream_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("pts", "sequence", "key_frame"))).alias("members"))


def unnested(releases: DataFrame) -> DataFrame:
    """The records of releases again, each with its place."""
    return releases.select("stream_id", "stretch", F.posexplode("members").alias("place", "m")).select("stream_id", "stretch", "place", "m.*")


def interval_breaks(intervals: DataFrame) -> DataFrame:
    """Intervals (begin, end) that do not begin where their predecessor ended."""
    w = Window.partitionBy("stream_id").orderBy("sequence")
    return intervals.withColumn("expected", F.lag("end").over(w)).where(F.col("expected") != F.col("begin")).select("stream_id", "sequence", "begin", "expected")


def clock_states(snapshots: DataFrame) -> DataFrame:
    """Readiness of each snapshot (state, generation) and whether its generation goes back behind an earlier one's."""
    w = Window.partitionBy("stream_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    ready = F.when(F.col("state").isin("locked", "degraded"), "ready").when(F.col("state") == "acquiring", "waiting").otherwise("reacquire")
    return snapshots.select("stream_id", "sequence", "generation", ready.alias("readiness"), F.coalesce(F.col("generation") < F.max("generation").over(w), F.lit(False)).alias("goes_back"))


def nearest_epoch(units: DataFrame, modulus: int, rate: int) -> DataFrame:
    """Adds source_us: a wrapped counter (ticks at rate) aligned to the epoch of the modulus that is nearest to its clock anchor (anchor_ticks, anchor_us), the smaller one on ties, as microseconds."""
    ahead = F.pmod(F.col("counter") - F.col("anchor_ticks"), F.lit(modulus))
    delta = F.when(2 * ahead < modulus, ahead).otherwise(ahead - modulus)
    rows = units.withColumn("_d", delta)
    return rows.withColumn("source_us", F.col("anchor_us") + F.expr(f"sign(_d) * ((abs(_d) * 1000000 + {rate // 2}) div {rate})").cast("long")).drop("_d")


def qos_action(steps: DataFrame) -> DataFrame:
    """Adds action from pressure, before and after (bitrates): an unhealthy queue drops late frames, else the change of rate speaks."""
    action = F.when(F.col("pressure") != "healthy", "drop_late_frames").when(F.col("after") < F.col("before"), "reduce").when(F.col("after") > F.col("before"), "increase").otherwise("keep")
    return steps.withColumn("action", action)
