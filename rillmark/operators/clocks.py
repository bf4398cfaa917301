"""Clock binding: as-of joins by window, common windows of two streams, group locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_bind(units: DataFrame, reports: DataFrame, timeout: int, extrapolation: int, num: int = 1, den: int = 1) -> DataFrame:
    """Each record with the latest report (stream_id, report_pts, report_sequence, anchor) of its stream at or before it: state (locked, degraded, expired, or acquiring without one) and mapped = anchor + elapsed * num / den, rounded down.

    Records and reports are united and the last report is carried along: a shuffle by stream and no join of every pair.
    """
    both = units.select("stream_id", "pts", "sequence", F.lit(None).cast("struct<report_pts:bigint,report_sequence:bigint,anchor:bigint>").alias("_r"), F.lit(1).alias("_last"))
    own = reports.select("stream_id", F.col("report_pts").alias("pts"), F.col("report_sequence").alias("sequence"), F.struct("report_pts", "report_sequence", "anchor").alias("_r"), F.lit(0).alias("_last"))
    w = Window.partitionBy("stream_id").orderBy("pts", "_last", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.unionByName(own).withColumn("_c", F.last("_r", True).over(w)).where("_last = 1")
    age = F.col("pts") - F.col("_c.report_pts")
    state = F.when(F.col("_c").isNull(), "acquiring").when(age <= timeout, "locked").when(age <= extrapolation, "degraded").otherwise("expired")
    mapped = F.when(F.col("_c").isNotNull() & (age <= extrapolation), F.expr(f"_c.anchor + ((pts - _c.report_pts) * {num}) div {den}"))
    return rows.select("stream_id", "sequence", "pts", F.col("_c.report_sequence").alias("report_sequence"), state.alias("state"), mapped.alias("mapped"))


def common_window(video: DataFrame, audio: DataFrame, skew: int, preroll: int, trim: int | None = None) -> DataFrame:
    """For each stream_id the first start at which both sides play: video_pts, audio_pts, start.

    A video record needs coverage to start + preroll, its audio record begins within skew of it, has not ended at the start and
    covers start + preroll, and at most trim of it is cut (start is the later of the two if cutting is allowed, else the video's).
    Both sides have pts, duration and covered_until. The join is on (stream_id, time in steps of skew).
    """
    v = video.select("stream_id", F.col("pts").alias("video_pts"), F.col("covered_until").alias("video_until"), F.explode(F.array(*[F.expr(f"pts div {skew} + {k}") for k in (-1, 0, 1)])).alias("_step"))
    a = audio.select("stream_id", F.col("pts").alias("audio_pts"), (F.col("pts") + F.col("duration")).alias("_ends"), F.col("covered_until").alias("audio_until"), F.expr(f"pts div {skew}").alias("_step"))
    start = F.greatest("video_pts", "audio_pts") if trim is not None else F.col("video_pts")
    pairs = v.join(a, ["stream_id", "_step"]).withColumn("start", start)
    pairs = pairs.where((F.abs(F.col("audio_pts") - F.col("video_pts")) <= skew) & (F.col("_ends") > F.col("start")))
    pairs = pairs.where((F.col("video_until") >= F.col("start") + preroll) & (F.col("audio_until") >= F.col("start") + preroll))
    if trim is not None:
        pairs = pairs.where(F.col("start") - F.col("audio_pts") <= trim)
    best = pairs.groupBy("stream_id").agg(F.min(F.struct("video_pts", "audio_pts", "start")).alias("_b"))
    return best.select("stream_id", "_b.video_pts", "_b.audio_pts", "_b.start")


def group_lock(reports: DataFrame, sides: tuple[str, str], timeout: int, extrapolation: int, skew: int) -> DataFrame:
    """State of each group of two sides after every report (group_id, side, at, sequence, name, shift): acquiring until both have reported, reacquire on different names or shifts further apart than skew, or when the older report is past extrapolation, degraded past timeout, else locked."""
    w = Window.partitionBy("group_id").orderBy("at", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = reports
    for k, side in enumerate(sides):
        rows = rows.withColumn(f"_s{k}", F.last(F.when(F.col("side") == side, F.struct("at", "name", "shift")), True).over(w))
    age = F.col("at") - F.least("_s0.at", "_s1.at")
    state = (
        F.when(F.col("_s0").isNull() | F.col("_s1").isNull(), "acquiring")
        .when((F.col("_s0.name") != F.col("_s1.name")) | (F.abs(F.col("_s0.shift") - F.col("_s1.shift")) > skew) | (age > extrapolation), "reacquire")
        .when(age > timeout, "degraded")
        .otherwise("locked")
    )
    return rows.select("group_id", "sequence", state.alias("state"))


def common_epoch(units: DataFrame, sides: tuple[str, str], max_skew: int) -> DataFrame:
    """For each stream_id the epoch that both kinds share, their earliest first time; too_far where the firsts lie more than max_skew apart."""
    firsts = units.where(F.col("stream_kind").isin(*sides)).groupBy("stream_id").agg(*[F.min(F.when(F.col("stream_kind") == s, F.col("pts"))).alias(f"_{k}") for k, s in enumerate(sides)])
    firsts = firsts.where("_0 is not null and _1 is not null")
    return firsts.select("stream_id", F.least("_0", "_1").alias("epoch"), (F.abs(F.col("_0") - F.col("_1")) > max_skew).alias("too_far"))
