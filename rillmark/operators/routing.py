"""Routing, fan-out, merging, gates and subscriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matches(units: DataFrame, routes: DataFrame) -> Column:
    kind = routes["route_kind"].isin("Any", "Unknown") | (routes["route_kind"] == units["stream_kind"])
    index = units["stream_index"].isNull() | routes["route_index"].isNull() | (routes["route_index"] == units["stream_index"])
    return kind & index


def route(units: DataFrame, routes: DataFrame) -> DataFrame:
    """A row for each record and port it goes to. Kind Any (or Unknown) and a missing index match everything. The table of ports is small by nature."""
    return units.join(routes, _matches(units, routes), "inner")


def unmatched(units: DataFrame, routes: DataFrame) -> DataFrame:
    """The records that no port takes: an error for a demultiplexer, dropped by a splitter."""
    return units.join(routes, _matches(units, routes), "left_anti")


def fan_out(units: DataFrame, outputs: list[str]) -> DataFrame:
    """Every record once for each output; the input is scanned once."""
    return units.withColumn("output", F.explode(F.array(*[F.lit(x) for x in outputs])))


def merge(branches: list[DataFrame]) -> DataFrame:
    """All records of all branches, which end when the last of them does."""
    return reduce(DataFrame.unionByName, branches)


def start_gate(units: DataFrame) -> DataFrame:
    """Each stream from its first key record on."""
    w = Window.partitionBy("stream_id").orderBy("pts", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("_open", F.max("key_frame").over(w)).where("_open").drop("_open")


def interval_join(points: DataFrame, intervals: DataFrame, time: str, begin: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """points with every interval [begin, end) that holds their time (how: inner, or left to keep points in none). Intervals are listed under each bucket of time they touch, so the join is on equality and is dealt by bucket."""
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(F.expr(f"floor({begin} / {bucket})"), F.expr(f"floor(({end} - 1) / {bucket})"))))
    own = points.withColumn("_bucket", F.expr(f"floor({time} / {bucket})"))
    inside = (own["_bucket"] == spread["_bucket"]) & (own[time] >= spread[begin]) & (own[time] < spread[end])
    return own.join(spread, inside, how).drop("_bucket")


def late_subscription(units: DataFrame, subscriptions: DataFrame, bucket: int) -> DataFrame:
    """Records that each subscriber (subscriber, begins, ends) sees: of every stream from the first key record after it joined."""
    seen = interval_join(units, subscriptions, "pts", "begins", "ends", bucket)
    w = Window.partitionBy("subscriber", "stream_id").orderBy("pts", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    return seen.withColumn("_open", F.max("key_frame").over(w)).where("_open").drop("_open", "begins", "ends")


def epoch_gate(units: DataFrame, epochs: DataFrame, bucket: int) -> DataFrame:
    """Adds verdict by the epoch (epoch_generation, begins, ends) in force: pass, drop (stale generation) or withhold (a future one, or no epoch)."""
    own = interval_join(units, epochs, "pts", "begins", "ends", bucket, "left")
    verdict = F.when(F.col("generation") < F.col("epoch_generation"), "drop").when(F.col("generation") == F.col("epoch_generation"), "pass").otherwise("withhold")
    return own.withColumn("verdict", verdict).drop("begins", "ends")


def format_contract(units: DataFrame, columns: list[str]) -> DataFrame:
    """Streams that change what must not change: stream_id and the number of distinct combinations."""
    rows = units.select("stream_id", *columns).distinct().groupBy("stream_id").agg(F.count("*").alias("formats"))
    return rows.where("formats > 1")


#: The kinds of records that each set of streams has.
STREAM_SETS = {"AudioVideo": ("audio", "video"), "VideoOnly": ("video",)}


def stream_set(units: DataFrame, name: str, media: Column) -> DataFrame:
    """The records whose medium (media: a column of audio, video or others) is in the named set."""
    return units.where(media.isin(*STREAM_SETS[name]))
