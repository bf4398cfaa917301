"""Planning rules over tables of requests and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_control_errors(requests: DataFrame) -> DataFrame:
    """Adds error for requests (mode, target, min_rate, max_rate): the first rule that is broken, or null."""
    t, low, high = F.col("target"), F.col("min_rate"), F.col("max_rate")
    positive = (F.coalesce(t, F.lit(1)) > 0) & (F.coalesce(low, F.lit(1)) > 0) & (F.coalesce(high, F.lit(1)) > 0)
    error = (
        F.when(~positive, "rate_not_positive")
        .when((F.col("mode") == "cbr") & t.isNull(), "cbr_needs_target")
        .when((F.col("mode") == "cbr") & (low.isNotNull() | high.isNotNull()), "cbr_forbids_bounds")
        .when((F.col("mode") == "vbr") & (low.isNull() | t.isNull() | high.isNull()), "vbr_needs_all")
        .when((F.col("mode") == "vbr") & ~((low <= t) & (t <= high)), "vbr_order")
    )
    return requests.withColumn("error", error)


def emission_bounds(requests: DataFrame) -> DataFrame:
    """Adds, for a constant target, the bounds 15/16 (down) and 17/16 (up) of it, and the bytes-or-bits of one frame at frame_num / frame_den, rounded up."""
    rows = requests.withColumn("low", F.expr("15 * target div 16")).withColumn("high", F.expr("(17 * target + 15) div 16"))
    ceiling = F.when(F.col("mode") == "cbr", F.col("target")).otherwise(F.col("max_rate"))
    return rows.withColumn("_c", ceiling).withColumn("frame_buffer", F.expr("(_c * frame_den + frame_num - 1) div frame_num")).drop("_c")


def pacing_rate(requests: DataFrame) -> DataFrame:
    """Adds pacing_rate from peak, burst bytes that may stay residence_ns, and sustained: the largest of peak, burst / residence and 5/2 sustained, each rounded up."""
    drain = F.expr("(burst * 1000000000 + residence_ns - 1) div residence_ns")
    return requests.withColumn("pacing_rate", F.greatest(F.col("peak"), drain, F.expr("(5 * sustained + 1) div 2")))


def traffic_envelope(streams: DataFrame) -> DataFrame:
    """What an output's streams need together."""
    return streams.groupBy("output").agg(*[F.sum(c).alias(c) for c in ("sustained", "peak", "packet_rate", "burst", "atomic_bytes")])


def join_wait(requests: DataFrame) -> DataFrame:
    """Adds wait_ns, the time to the next random-access frame (one frame if the encoder is new), and fits: with the activation lead it must stay below the remaining budget."""
    frames = F.when(F.col("new_encoder"), 1).otherwise(F.col("frames"))
    rows = requests.withColumn("_f", frames.cast("long")).withColumn("wait_ns", F.expr("(_f * frame_den * 1000000000 + frame_num - 1) div frame_num")).drop("_f")
    return rows.withColumn("fits", F.col("wait_ns") + F.col("lead_ns") < F.col("budget_ns"))


def edge_policy(edges: DataFrame) -> DataFrame:
    """Adds the watermarks of each edge: half, all but one, all of its capacity."""
    return edges.withColumn("high", F.expr("capacity div 2")).withColumn("critical", F.col("capacity") - 1).withColumn("full", F.col("capacity"))


def copy_eligible(branches: DataFrame) -> DataFrame:
    """Adds mode: drop, copy_packet (allowed, no resize, no filter, same codec) or transcode_frame."""
    copies = F.col("copy_allowed") & ~F.col("resize") & ~F.col("filter") & (F.col("source_codec") == F.col("target_codec"))
    return branches.withColumn("mode", F.when(~F.col("enabled"), "drop").when(copies, "copy_packet").otherwise("transcode_frame"))


# What a stage adds to a chain's score. All in hardware: on one device without copies, on one device, with a transfer; hardware in a mixed chain; software.
ZERO_COPY, SAME_DEVICE, TRANSFER, MIXED, SOFTWARE = 1000, 900, 800, 650, 300


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Ranks the candidate chains of each request by score, then by label; chosen is the first that is available and admitted.

    A chain is a decoder, an encoder and, where filter_active, a filter. Its score is the sum over its stages and its
    declared priority; an unavailable chain has 0.
    """
    stages = [(F.col("decoder_hw"), F.lit(True)), (F.col("encoder_hw"), F.lit(True)), (F.col("filter_hw"), F.col("filter_active"))]
    all_hw = reduce(Column.__and__, [hw | ~there for hw, there in stages])
    in_hw = F.when(all_hw & F.col("same_device") & F.col("zero_copy"), ZERO_COPY).when(all_hw & F.col("same_device"), SAME_DEVICE).when(all_hw, TRANSFER).otherwise(MIXED)
    sums = reduce(Column.__add__, [F.when(~there, 0).when(hw, in_hw).otherwise(SOFTWARE) for hw, there in stages])
    rows = candidates.withColumn("score", F.when(F.col("available"), sums + F.col("priority")).otherwise(0).cast("long"))
    order = Window.partitionBy("request").orderBy(F.desc("score"), "label")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    first = F.min(F.when(F.col("admitted") & F.col("available"), F.col("place"))).over(Window.partitionBy("request"))
    return rows.withColumn("chosen", F.coalesce(F.col("place") == first, F.lit(False)))


def encoding_groups(requests: DataFrame, contract: list[str]) -> DataFrame:
    """Requests whose whole contract is equal (nulls too) share an encoder: request, and the smallest request of its group."""
    return requests.withColumn("shared_with", F.min("request").over(Window.partitionBy(*contract))).select("request", "shared_with")


def resource_ledger(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Sums of bytes and items by resource against its limits; exceeded says whether one is over."""
    sums = items.groupBy("resource").agg(F.sum("bytes").alias("bytes"), F.sum("items").alias("items"))
    rows = sums.join(limits, "resource")
    return rows.withColumn("exceeded", (F.col("bytes") > F.col("max_bytes")) | (F.col("items") > F.col("max_items"))).select("resource", "bytes", "items", "exceeded")


def request_class(requests: DataFrame) -> DataFrame:
    """Adds the class of an input (live or file) and whether its output layout can be served: separate streams over plain UDP cannot."""
    live = F.col("input_type").isin("url", "sdp", "rtp_port", "ts_udp", "external_ts", "external_rtp")
    return requests.withColumn("live", live).withColumn("served", ~((F.col("layout") == "separate") & (F.col("transport") == "udp")))
