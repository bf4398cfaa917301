"""Access units, frames and byte fields: cases that the catalogue's packets don't have."""

import random

import pytest
from pyspark.sql import functions as F

from rillmark.functions import wire
from rillmark.operators import payloads, timestamps

SCHEMA = "stream_id long, seq long, rtp_ts long, marker boolean, payload binary"


def found(spark, packets, codec):
    rows = payloads.access_units(spark.createDataFrame(packets, SCHEMA), codec).collect()
    return {(r.stream_id, r.rtp_ts): (r.packets, r.complete, r.key_frame, None if r.data is None else bytes(r.data)) for r in rows}


def test_hevc_units_round_trip(spark):
    """Random units, each sent alone, in an aggregate or in fragments, come back as they were."""
    rng, packets, expected, seq = random.Random(7), [], {}, 65_530
    for ts in range(40):
        units = [bytes([rng.choice((1, 19, 20, 32)) << 1, 1]) + rng.randbytes(rng.randint(3, 30)) for _ in range(rng.randint(1, 4))]
        sent = []
        if rng.random() < 0.4:
            sent.append(bytes([48 << 1, 1]) + b"".join(len(u).to_bytes(2, "big") + u for u in units))
        else:
            for u in units:
                if rng.random() < 0.5:
                    sent.append(u)
                    continue
                cut = rng.randint(1, len(u) - 3)
                for begin, end in ((0, cut), (cut, len(u) - 2)):
                    flags = (0x80 if begin == 0 else 0) | (0x40 if end == len(u) - 2 else 0)
                    sent.append(bytes([49 << 1, 1, flags | u[0] >> 1]) + u[2:][begin:end])
        for i, payload in enumerate(sent):
            packets.append((1, seq, ts, i + 1 == len(sent), payload))
            seq += 1
        expected[1, ts] = (len(sent), True, any(u[0] >> 1 in (19, 20) for u in units), b"".join(b"\0\0\0\1" + u for u in units))
    rng.shuffle(packets)
    assert found(spark, packets, "hevc") == expected


@pytest.mark.parametrize(
    ("payload", "why"),
    [(b"", "empty"), (None, "null"), (b"\x00\x01", "kind 0"), (b"\x1e\x01", "kind 30"), (b"\x18\x00\x05\x41", "size beyond the aggregate"), (b"\x18", "empty aggregate"), (b"\x18\x00\x00", "empty unit"),
     (b"\x7c\xc5\x5a", "begin and end at once"), (b"\x7c\x85", "empty fragment"), (b"\x7c\x05\x5a", "no begin"), (b"\x7c\x85\x5a", "no end")],
)
def test_malformed_payload_takes_its_unit_only(spark, payload, why):
    packets = [(1, 1, 10, True, b"\x41\x01"), (1, 2, 20, True, payload), (1, 3, 30, True, b"\x65\x02")]
    units = found(spark, packets, "h264")
    assert units[1, 20][1] is False and units[1, 20][3] is None, why
    assert units[1, 10] == (1, True, False, b"\0\0\0\1\x41\x01") and units[1, 30] == (1, True, True, b"\0\0\0\1\x65\x02")


def test_markers_and_loss(spark):
    good = b"\x41\x01"
    packets = [(1, 1, 10, False, good), (1, 2, 20, True, good), (1, 3, 30, True, good), (1, 4, 30, True, good), (1, 6, 40, True, good), (1, 7, 50, True, good), (2, 9, 50, True, good)]
    units = found(spark, packets, "h264")
    assert {k: v[1] for k, v in units.items()} == {(1, 10): False, (1, 20): True, (1, 30): False, (1, 40): False, (1, 50): True, (2, 50): True}
    assert found(spark, [], "h264") == {}


def test_frames_of_a_packet(spark):
    cases = [(b"\x00\x10\x00\x10\xaa\xbb", [(0, b"\xaa\xbb")]), (b"\x00\x20\x00\x08\x00\x0a\xaa\xbb", [(0, b"\xaa"), (3072, b"\xbb")]), (b"\x00\x10\x00\x10\xaa", None), (b"\x00\x08\x00\x08\xaa", None), (b"\x00\x00", None), (b"\x00\x10", None), (b"", None), (None, None), (b"\x00\x10\x00\x00", None)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p binary")
    rows = {r.i: r.f for r in df.select("i", payloads.aac_frames(F.col("p"), 1024).alias("f")).collect()}
    for i, (_, frames) in enumerate(cases):
        assert (rows[i] if frames is None else [(x.ts_offset, bytes(x.data)) for x in rows[i]]) == frames
    ends = spark.createDataFrame([(b"",), (None,), (b"\x03",), (b"\x03\x00",), (b"\x1b\x03",), (b"\x1b\x02",)], "p binary").select(payloads.opus_duration(F.col("p")).alias("d")).collect()
    assert [r.d for r in ends] == [None, None, None, None, None, 5760]


def test_frames_of_random_packets(spark):
    """As a loop over each packet reads them, and without a fold that is interpreted for each row."""

    def loop(data):
        if data is None or len(data) < 4 or (bits := int.from_bytes(data[:2], "big")) % 16 or not bits:
            return None
        headers = [int.from_bytes(data[2 + 2 * i : 4 + 2 * i], "big") for i in range(bits // 16)]
        at, place, out = 2 + 2 * len(headers), 0, []
        for i, h in enumerate(headers):
            place += (h & 7) + 1 if i else 0
            out.append((place * 960, data[at : at + (h >> 3)]))
            at += h >> 3
        return out if at == len(data) and all(x for _, x in out) else None

    rng, packets = random.Random(5), [None, b"", b"\x00", b"\x00\x10"]
    for _ in range(400):
        sizes = [rng.choice((0, *range(1, 20))) for _ in range(rng.randint(0, 5))]
        packet = (16 * len(sizes) + (rng.random() < 0.05)).to_bytes(2, "big") + b"".join((8 * n + rng.randint(0, 7)).to_bytes(2, "big") for n in sizes) + rng.randbytes(sum(sizes))
        packets.append(packet[: rng.randint(0, len(packet))] if rng.random() < 0.1 else packet)
    packets.append((16 * 3000).to_bytes(2, "big") + b"\x00\x08" * 3000 + bytes(3000))
    found = spark.createDataFrame(list(enumerate(packets)), "i int, p binary").repartition(3).select("i", payloads.aac_frames(F.col("p"), 960).alias("f"))
    assert {r.i: r.f if r.f is None else [(x.ts_offset, bytes(x.data)) for x in r.f] for r in found.collect()} == {i: loop(p) for i, p in enumerate(packets)}
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_control_packets_as_a_loop(spark):
    """As a loop over each datagram reads them, also many packets of four bytes, and without a fold that is interpreted for each row."""

    def loop(data):
        at, out, word = 0, [], lambda k: int.from_bytes(data[k : k + 4], "big")
        while data and at < len(data):
            if len(data) - at < 8:
                return None
            size = (int.from_bytes(data[at + 2 : at + 4], "big") + 1) * 4
            kind = data[at + 1]
            if data[at] >> 6 != 2 or at + size > len(data) or (kind == 200 and size < 28):
                return None
            out.append((at, kind, data[at] & 31, size, word(at + 4), *((word(at + 8), word(at + 12), word(at + 16)) if kind == 200 else (None,) * 3)))
            at += size
        return out if out and out[0][1] in (200, 201) else None

    report, short = b"\x80\xc8\0\6" + bytes(range(200, 224)), b"\x80\xcb\0\0"
    rng, datagrams = random.Random(6), [None, b"", b"\x80", report + short * 10, report + short * 10 + b"\x81\xcb\0\1abcd", report * 300]
    for _ in range(400):
        made = b""
        for kind in [rng.choice((200, 200, 200, 201, 202)), *rng.choices((200, 201, 202, 203), k=rng.randint(0, 4))]:
            words = rng.choice((6, 6, 6, 12, 5)) if kind == 200 else rng.choice((0, 1, 2, 7))
            made += bytes([0x40 if rng.random() < 0.02 else 0x80 + rng.randint(0, 31), kind]) + words.to_bytes(2, "big") + rng.randbytes(4 * words)
        datagrams.append(made[: rng.randint(0, len(made))] if rng.random() < 0.1 else made)
    found = spark.createDataFrame(list(enumerate(datagrams)), "i int, d binary").repartition(3).select("i", wire.rtcp_packets(F.col("d")).alias("p"))
    assert {r.i: r.p if r.p is None else [tuple(x) for x in r.p] for r in found.collect()} == {i: loop(d) for i, d in enumerate(datagrams)}
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_byte_fields(spark):
    ticks = [0, 1, (1 << 33) - 1, 1 << 33, -1, None, 1 << 30, 0x1_2345_6789]
    df = spark.createDataFrame([(t,) for t in ticks], "t long").withColumn("f", wire.timestamp_field(3, F.col("t")))
    assert [r.v for r in df.select(wire.timestamp_value(F.col("f")).alias("v")).collect()] == [t if t is not None and 0 <= t < 1 << 33 else None for t in ticks]
    bad = spark.createDataFrame([(b"\x20\x00\x01\x00\x01",), (b"\x41\x00\x01\x00\x01",), (b"\x21\x00\x01",), (b"\x21\x00\x01\x00\x01",)], "f binary")
    assert [r.v for r in bad.select(wire.timestamp_value(F.col("f")).alias("v")).collect()] == [None, None, None, 0]
    report = spark.createDataFrame([(1,)], "x long").select(wire.rtcp_packets(wire.sender_report(F.lit(9), F.lit(5), F.lit(6), F.lit((1 << 32) + 3), F.lit(1), F.lit(2))).alias("p")).first().p
    assert [(x.type, x.ssrc, x.ntp_sec, x.ntp_frac, x.rtp_ts) for x in report] == [(200, 9, 5, 6, 3)]
    sdp = wire.transport_session_description(F.lit("-"), F.lit(1), F.lit(1), F.lit("s"), F.lit("::1"), F.lit(6000), F.lit(4), F.lit("c"))
    text = spark.range(1).select(sdp.alias("t")).first().t
    assert "c=IN IP6 ::1\r\n" in text and "a=rtcp:6001 IN IP6 ::1\r\n" in text and text.endswith("a=ssrc:4 cname:c\r\n")


@pytest.mark.parametrize(("num", "den"), [(1001, 30), (10, 1), (2, 5), (7, 2)])
def test_rational_rate_as_a_loop(spark, num, den):
    """Tick by tick: rounded halves away from zero, the nearer record, no tick at or before the last one."""
    rng, rows, expected = random.Random(num), [], []
    for stream in range(5):
        pts, last, start, k, before = 0, None, 0, 0, None
        for seq in range(60):
            pts += rng.choice((0, 1, 3, 20, 45, 500))
            rows.append((stream, pts, seq))
            if before is None or pts - before[0] > 200:
                start, k, before = pts, 0, None
            while (t := start + (2 * k * num + den) // (2 * den)) <= pts:
                if k == 0 or t > last:
                    expected.append((stream, t, before[1] if before and t - before[0] <= pts - t else seq))
                    last = t
                k += 1
            before = (pts, seq)
    df = spark.createDataFrame(rows, "stream_id long, pts long, sequence long")
    assert sorted(map(tuple, timestamps.resample_rational_rate(df, num, den, 200).collect())) == sorted(expected)
