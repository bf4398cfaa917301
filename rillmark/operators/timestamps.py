"""Resampling and repair of timestamps, in closed form: running maxima, running sums and islands instead of a loop over rows.

All windows are bound to a stream, so plans shuffle once by stream and keep whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(*order: str) -> Window:
    return Window.partitionBy("stream_id").orderBy(*order)


def _upto(*order: str) -> Window:
    return _by(*order).rowsBetween(Window.unboundedPreceding, 0)


def resample_constant_rate(units: DataFrame, period: int, gap: int) -> DataFrame:
    """One row for each tick of the grid: stream_id, pts, source_sequence. The nearest record is shown, the earlier on ties; a step of more than gap starts a new grid; nothing follows the last record."""
    w = _by("pts", "sequence")
    rows = units.withColumn("_prev", F.lag("pts").over(w)).withColumn("_prev_seq", F.lag("sequence").over(w))
    rows = rows.withColumn("_new", (F.col("_prev").isNull() | (F.col("pts") - F.col("_prev") > gap)).cast("int"))
    rows = rows.withColumn("_start", F.last(F.when(F.col("_new") == 1, F.col("pts")), True).over(_upto("pts", "sequence")))
    low = F.when(F.col("_new") == 1, F.lit(0)).otherwise(F.expr(f"(_prev - _start) div {period} + 1"))
    rows = rows.withColumn("_low", low.cast("long")).withColumn("_high", F.expr(f"(pts - _start) div {period}")).where("_low <= _high")
    ticks = rows.select("*", F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_t", F.col("_start") + F.col("_k") * period)
    earlier = (F.col("_new") == 0) & (F.col("_t") - F.col("_prev") <= F.col("pts") - F.col("_t"))
    return ticks.select("stream_id", F.col("_t").alias("pts"), F.when(earlier, F.col("_prev_seq")).otherwise(F.col("sequence")).alias("source_sequence"))


def resample_rational_rate(units: DataFrame, num: int, den: int, gap: int) -> DataFrame:
    """As resample_constant_rate for a period of num / den ticks: tick k is at start + k * num / den, halves away from zero; of ticks at one time the first stays.

    The last tick up to a record that lies x behind the start is k = ((2x + 1) * den - 1) div (2 * num), so (2x + 1) * den must fit a long.
    """
    w = _by("pts", "sequence")
    rows = units.withColumn("_prev", F.lag("pts").over(w)).withColumn("_prev_seq", F.lag("sequence").over(w))
    rows = rows.withColumn("_new", F.col("_prev").isNull() | (F.col("pts") - F.col("_prev") > gap))
    rows = rows.withColumn("_start", F.last(F.when(F.col("_new"), F.col("pts")), True).over(_upto("pts", "sequence")))
    upto = lambda c: F.expr(f"((2 * ({c} - _start) + 1) * {den}L - 1) div {2 * num}L")
    rows = rows.withColumn("_low", F.when(F.col("_new"), F.lit(0).cast("long")).otherwise(upto("_prev") + 1)).withColumn("_high", upto("pts")).where("_low <= _high")
    at = lambda k: F.expr(f"(2 * {k} * {num}L + {den}L) div {2 * den}L")
    ticks = rows.select("*", F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_t", F.col("_start") + at("_k"))
    ticks = ticks.where((F.col("_k") == 0) | (F.col("_t") > F.col("_start") + at("(_k - 1)")))
    earlier = ~F.col("_new") & (F.col("_t") - F.col("_prev") <= F.col("pts") - F.col("_t"))
    return ticks.select("stream_id", F.col("_t").alias("pts"), F.when(earlier, F.col("_prev_seq")).otherwise(F.col("sequence")).alias("source_sequence"))


def resample_stats(units: DataFrame, period: int, gap: int) -> DataFrame:
    """For each stream: records in, ticks out, ticks that repeat a record, records that no tick shows."""
    out = resample_constant_rate(units, period, gap)
    shown = out.groupBy("stream_id", "source_sequence").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.sum("n").alias("ticks_out"), F.sum(F.col("n") - 1).alias("repeats"), F.count("*").alias("shown"))
    came = units.groupBy("stream_id").agg(F.count("*").alias("records_in"))
    return came.join(shown, "stream_id").select("stream_id", "records_in", "ticks_out", "repeats", (F.col("records_in") - F.col("shown")).alias("skipped"))


def shift_monotonic(units: DataFrame) -> DataFrame:
    """Shifts pts and dts forward together so that no record begins before its predecessor's end: adds shift. With one of the two missing the other stands for both."""
    low, high = F.least("pts", "dts"), F.greatest("pts", "dts")
    rows = units.withColumn("_m", low).withColumn("_x", high).withColumn("_d", F.greatest(F.coalesce("duration", F.lit(1)), F.lit(1)))
    rows = rows.withColumn("_sum", F.sum(F.col("_x") - F.col("_m") + F.col("_d")).over(_upto("sequence")))
    rows = rows.withColumn("_next", F.col("_sum") + F.max(F.col("_x") + F.col("_d") - F.col("_sum")).over(_upto("sequence")))
    rows = rows.withColumn("shift", F.greatest(F.lit(0), F.coalesce(F.lag("_next").over(_by("sequence")) - F.col("_m"), F.lit(0))))
    return rows.select(*units.columns, "shift").withColumn("pts", F.col("pts") + F.col("shift")).withColumn("dts", F.col("dts") + F.col("shift"))


def strictly_increasing(units: DataFrame, width: Column | None = None) -> DataFrame:
    """Adds out_pts: the least sequence of values that are no smaller than pts and grow by width (1) from record to record."""
    width = F.lit(1) if width is None else width
    rows = units.withColumn("_w", width.cast("long"))
    rows = rows.withColumn("_sum", F.sum("_w").over(_upto("sequence")) - F.col("_w"))
    return rows.withColumn("out_pts", F.col("_sum") + F.max(F.col("pts") - F.col("_sum")).over(_upto("sequence"))).drop("_w", "_sum")


def synthesize_missing(units: DataFrame, step: int) -> DataFrame:
    """Adds out_pts: pts, or where it is missing the last value and a step more; a missing first is 0."""
    first = F.row_number().over(_by("sequence")) == 1
    rows = units.withColumn("_known", F.when(F.col("pts").isNull() & first, F.lit(0)).otherwise(F.col("pts")))
    rows = rows.withColumn("_missing", F.sum(F.col("_known").isNull().cast("long")).over(_upto("sequence")))
    last = step * F.col("_missing") + F.max(F.col("_known") - step * F.col("_missing")).over(_upto("sequence"))
    return rows.withColumn("out_pts", F.coalesce("_known", last)).drop("_known", "_missing")


def sample_grid(times: DataFrame, column: str, rate: int) -> DataFrame:
    """Adds nearest_sample (half away from zero) and first_sample (at or after) for a time in nanoseconds."""
    scaled = F.col(column).cast("decimal(20,0)") * F.lit(rate).cast("decimal(10,0)")
    rows = times.withColumn("_s", scaled)
    nearest = F.expr("cast(sign(_s) as bigint) * ((abs(_s) + 500000000) div 1000000000)")
    first = F.expr("case when _s > 0 then (_s + 999999999) div 1000000000 else -(abs(_s) div 1000000000) end")
    return rows.withColumn("nearest_sample", nearest.cast("long")).withColumn("first_sample", first.cast("long")).drop("_s")


def unwrap_counter(units: DataFrame, modulus: int) -> DataFrame:
    """Adds unwrapped, for a counter that wraps at modulus and never steps back by half of it or more; exact where no record would be rejected (status says which would)."""
    step = F.pmod(F.col("counter") - F.lag("counter").over(_by("sequence")), F.lit(modulus))
    rows = units.withColumn("_step", step)
    status = F.when(F.col("_step").isNull(), "first").when(2 * F.col("_step") < modulus, "forward").when(2 * F.col("_step") == modulus, "ambiguous").otherwise("backward")
    rows = rows.withColumn("status", status)
    start = F.first("counter").over(_upto("sequence"))
    return rows.withColumn("unwrapped", start + F.coalesce(F.sum("_step").over(_upto("sequence")), F.lit(0))).drop("_step")


def continuity_breaks(units: DataFrame, threshold: int) -> DataFrame:
    """The records at which a stream must be acquired anew: stream_id, sequence, pts, reason (regression or gap)."""
    w = _by("sequence")
    rows = units.withColumn("_p", F.lag("pts").over(w)).withColumn("_d", F.lag("duration").over(w))
    reason = F.when(F.col("pts") < F.col("_p"), "regression").when(F.col("pts") - (F.col("_p") + F.col("_d")) > threshold, "gap")
    return rows.withColumn("reason", reason).where("reason is not null").select("stream_id", "sequence", "pts", "reason")


def trim_leading(frames: DataFrame, skip: int) -> DataFrame:
    """Drops the first skip samples of each stream: stream_id, sequence, begin (samples cut from the frame's front), kept_samples."""
    rows = frames.withColumn("_end", F.sum("samples").over(_upto("sequence"))).where(F.col("_end") > skip)
    begin = F.greatest(F.lit(0), skip - (F.col("_end") - F.col("samples")))
    return rows.select("stream_id", "sequence", begin.cast("long").alias("begin"), (F.col("samples") - begin).alias("kept_samples"))


def rechunk(frames: DataFrame, size: int) -> DataFrame:
    """Cuts each stream's samples into full frames of size: stream_id, frame, first_sequence, last_sequence. samples is a count; rows without samples are in no frame.

    A row lists the frames whose last sample it holds. At most the first of them began in an earlier row: the last one that began a frame it didn't end.
    """
    rows = frames.where("samples > 0").select("stream_id", "sequence", "samples").withColumn("_end", F.sum("samples").over(_upto("sequence"))).withColumn("_begin", F.col("_end") - F.col("samples"))
    opens = F.expr(f"_end % {size} <> 0 and _end - _end % {size} >= _begin")
    rows = rows.withColumn("_opened", F.last(F.when(opens, F.col("sequence")), True).over(_by("sequence").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_low", F.expr(f"_begin div {size}")).withColumn("_high", F.expr(f"_end div {size} - 1")).where("_low <= _high")
    rows = rows.select("*", F.explode(F.sequence("_low", "_high")).alias("frame"))
    first = F.when(F.col("frame") * size >= F.col("_begin"), F.col("sequence")).otherwise(F.col("_opened"))
    return rows.select("stream_id", "frame", first.alias("first_sequence"), F.col("sequence").alias("last_sequence"))


def coverage(units: DataFrame, max_gap: int) -> DataFrame:
    """Adds covered_until: how far the intervals [pts, pts + duration] reach from each record without a hole of more than max_gap."""
    w = _by("pts", "sequence")
    rows = units.withColumn("_end", F.col("pts") + F.col("duration"))
    rows = rows.withColumn("_reached", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum((F.col("_reached").isNull() | (F.col("pts") > F.col("_reached") + max_gap)).cast("int")).over(_upto("pts", "sequence")))
    island = Window.partitionBy("stream_id", "_island")
    return rows.withColumn("covered_until", F.max("_end").over(island)).drop("_end", "_reached", "_island")


def frames_to_packets(units: DataFrame, max_payload: int) -> DataFrame:
    """Fragments records into datagrams: stream_id, sequence, fragment, payload_bytes, marker (on the last), and the running number of the datagram in its stream."""
    pieces = units.where("bytes > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {max_payload}"))).alias("fragment"))
    pieces = pieces.withColumn("payload_bytes", F.least(F.lit(max_payload), F.col("bytes") - F.col("fragment") * max_payload).cast("long"))
    pieces = pieces.withColumn("marker", (F.col("fragment") + 1) * max_payload >= F.col("bytes"))
    return pieces.select("stream_id", "sequence", "fragment", "payload_bytes", "marker", (F.row_number().over(_by("sequence", "fragment")) - 1).cast("long").alias("datagram"))


def packet_batches(units: DataFrame, per_batch: int) -> DataFrame:
    """Groups each stream's records by per_batch in order: stream_id, batch, records, batch_bytes, first_sequence."""
    rows = units.withColumn("_nth", F.row_number().over(_by("sequence")) - 1).withColumn("batch", F.expr(f"cast(_nth as bigint) div {per_batch}"))
    return rows.groupBy("stream_id", "batch").agg(F.count("*").alias("records"), F.sum("bytes").alias("batch_bytes"), F.min("sequence").alias("first_sequence"))
