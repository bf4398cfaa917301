"""Byte functions on hand-made vectors; streaming forms against batch."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.functions import wire
from rillmark.operators import routing
from rillmark.plans.pipeline import Pipeline, Stage
from rillmark.schema import from_events
from rillmark.session import table
from rillmark.sources import io
from rillmark.streaming import live


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x binary").select(expr(F.col("x")).alias("y")).first().y


def test_checksum(spark):
    assert one(spark, b"123456789", wire.crc32_mpeg2) == 0x0376E6E7
    assert one(spark, b"", wire.crc32_mpeg2) == 0xFFFFFFFF
    assert one(spark, None, wire.crc32_mpeg2) is None


def test_headers(spark):
    assert one(spark, bytes(12), wire.rtp_header) is None
    h = one(spark, bytes.fromhex("b0e00001000000020000000300010001aabbccdd5a5a0002"), wire.rtp_header)
    assert (h.marker, h.payload_type, h.seq, h.payload_at, h.payload_bytes) == (True, 96, 1, 20, 2)
    assert one(spark, b"\x47" + bytes(100), wire.ts_header) is None


def test_units(spark):
    units = one(spark, b"\0\0\0\1\x65ab\0\0\1\x41c", wire.nal_units)
    assert [(u.at, u.bytes, u.header) for u in units] == [(4, 3, 0x65), (10, 2, 0x41)]


def test_units_and_checksums_by_brute_force(spark):
    """Short values of few bytes, so that start codes lie at ends, next to zeros, in a row, and across neighbouring values."""
    rng = random.Random(5)
    values = [None, b"", b"\0\0\1", b"\0\0", b"\1\x65"] + [bytes(rng.choice((0, 0, 0, 1, 0x65)) for _ in range(rng.randrange(24))) for _ in range(400)]

    def units(value):
        if value is None:
            return None
        begins = [m.end() for m in re.finditer(b"\0\0\1", value)]
        ends = [b + len(value[b : n - 3].rstrip(b"\0")) for b, n in zip(begins, begins[1:], strict=False)] + [len(value)]
        return [(b, e - b, value[b]) for b, e in zip(begins, ends, strict=False) if e > b]

    def checksum(value):
        crc = 0xFFFFFFFF
        for byte in value or b"":
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        return None if value is None else crc

    rows = spark.createDataFrame(list(enumerate(values)), "i int, x binary").select("i", wire.nal_units("x").alias("n"), wire.crc32_mpeg2("x").alias("c")).collect()
    assert len(rows) == len(values)
    for r in rows:
        got = None if r.n is None else [tuple(u) for u in r.n]
        assert got == units(values[r.i]) and r.c == checksum(values[r.i]), values[r.i]


@pytest.mark.parametrize(("codec", "headers", "expected"), [("h264", (9, 0x65), True), ("h264", (0x65, 0x41), False), ("h264", (9,), False), ("hevc", (38, 40, 64), True), ("hevc", (38, 2), False)])
def test_random_access_unit(spark, codec, headers, expected):
    value = b"".join(b"\0\0\1" + bytes((h, 0x80)) for h in headers)
    assert one(spark, value, lambda x: wire.random_access_unit(wire.nal_units(x), codec)) is expected


def test_text(spark):
    row = spark.createDataFrame([("a=1; B=x=y ;", "http://u:p@h/x", "capped-vbr")], "f string, u string, m string")
    got = row.select(wire.fmtp(F.col("f")).alias("f"), wire.redacted_url(F.col("u")).alias("u"), wire.rate_control_mode(F.col("m")).alias("m")).first()
    assert got.f == {"a": "1", "b": "x=y"} and got.u == "http://***@h/x" and got.m == "cvbr"
    assert spark.range(1).select(*[wire.rescale(F.lit(v), 1, 2, m).alias(f"c{i}") for i, (v, m) in enumerate([(3, "nearest"), (-3, "nearest"), (3, "up"), (-3, "up"), (-3, "zero")])]).first()[:] == (2, -2, 2, -1, -1)


@pytest.fixture()
def streamed(spark, sf_dir, tmp_path):
    units = from_events(table(spark, sf_dir, "events")).orderBy("pts")
    for k in range(3):
        units.where(F.col("sequence") % 3 == k).orderBy("pts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return units, io.stream_units(spark, str(tmp_path / "in"), units.schema, 1)


def test_stream_duplicates(spark, streamed, tmp_path):
    units, stream = streamed
    twice = live.without_duplicates(live.watermarked(stream.unionByName(stream), "60 days"))
    live.run_to_table(twice.drop("event_time"), "once", str(tmp_path / "c"))
    assert spark.table("once").count() == units.count()


def test_stream_gate(spark, streamed, tmp_path):
    units, stream = streamed
    live.run_to_table(live.start_gate(stream), "gate", str(tmp_path / "c"))
    got = spark.table("gate")
    assert 0 < got.count() <= units.count()
    assert got.groupBy("stream_id").agg(F.count_if("key_frame").alias("n")).where("n = 0").count() == 0


@pytest.fixture()
def small_batches(spark):
    """Arrow batches of 50 rows, so that a stream's records of one trigger come in many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture()
def backwards(spark, sf_dir, tmp_path):
    """One trigger that holds everything, the latest records first."""
    units = from_events(table(spark, sf_dir, "events"))
    units.orderBy(F.desc("pts")).coalesce(1).write.parquet(str(tmp_path / "back"))
    return units, io.stream_units(spark, str(tmp_path / "back"), units.schema, 1)


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stream_gate_orders_a_trigger(spark, backwards, small_batches, tmp_path):
    units, stream = backwards
    live.run_to_table(live.start_gate(stream), "gate_once", str(tmp_path / "c"))
    assert ids(spark.table("gate_once"), "stream_id", "sequence") == ids(routing.start_gate(units), "stream_id", "sequence")


def test_stream_continuity(spark, backwards, small_batches, tmp_path):
    units, stream = backwards
    gap = 86_400_000_000
    live.run_to_table(live.last_seen(stream, gap), "seen", str(tmp_path / "c"))
    before = F.lag("pts").over(Window.partitionBy("stream_id").orderBy("sequence"))
    step = F.col("pts") - before
    expected = units.withColumn("reason", F.when(step < 0, "regression").when(step > gap, "gap")).where("reason is not null")
    assert ids(spark.table("seen"), "stream_id", "sequence", "reason") == ids(expected, "stream_id", "sequence", "reason") != []


def test_stream_windows(spark, streamed, tmp_path):
    """The windows that the watermark has closed hold what the batch form counts in them."""
    units, stream = streamed
    live.run_to_table(live.counts_by_window(live.watermarked(stream, "60 days"), "1 day"), "by_window", str(tmp_path / "c"))
    got = spark.table("by_window").select("window.start", "stream_kind", "records", "bytes")
    whole = live.counts_by_window(units.withColumn("event_time", F.timestamp_micros("pts")), "1 day").select("window.start", "stream_kind", "records", "bytes")
    assert set(map(tuple, got.collect())) <= set(map(tuple, whole.collect()))


def test_stream_outputs(spark, streamed, tmp_path):
    units, stream = streamed
    live.commit_outputs(stream, lambda: ["a", "b"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    for name in "ab":
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() == units.count()


def test_io_and_pipeline(spark, sf_dir, tmp_path):
    units = from_events(table(spark, sf_dir, "events"))
    io.write_routed(units, str(tmp_path / "routed"))
    assert spark.read.parquet(str(tmp_path / "routed")).count() == units.count()
    io.write_ordered(units, str(tmp_path / "o"), "json")
    assert io.read_units(spark, str(tmp_path / "o"), "json", units.schema).count() == units.count()
    both = io.recorded_then_live(units.where("sequence < 100"), units.where("sequence >= 100"))
    assert both.where("ordinal = 0").count() == units.select("stream_id").distinct().count()
    with pytest.raises(ValueError):
        io.check_layout("separate", "udp")
    with pytest.raises(ValueError):
        Pipeline([Stage("nothing")]).apply(units)
    got = Pipeline([Stage("start_gate", needs=("key_frame",)), Stage("strictly_increasing")]).apply(units)
    assert got.count() == routing.start_gate(units).count() and "out_pts" in got.columns
