"""Fields of datagrams and transport packets, checksums, parameter strings and session descriptions.

What can be said with built-in expressions is; only the checksum, the scan for units and the walk over control packets need Arrow-batched functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unsigned(data: Column, at: int | Column, n: int) -> Column:
    """n (at most 7) bytes from offset at as a big-endian number."""
    start = at + 1
    return F.conv(F.hex(F.substring(data, start if isinstance(start, Column) else F.lit(start), F.lit(n))), 16, 10).cast("long")


def rtp_header(data: Column) -> Column:
    """Struct of the header fields and where the payload begins and how long it is; null unless the version is 2 and all lengths fit."""
    first, second = unsigned(data, 0, 1), unsigned(data, 1, 1)
    csrcs, extended, padded = first.bitwiseAND(F.lit(15)), first.bitwiseAND(F.lit(16)) != 0, first.bitwiseAND(F.lit(32)) != 0
    fixed = F.lit(12) + 4 * csrcs
    offset = fixed + F.when(extended, 4 + 4 * unsigned(data, (fixed + 2).cast("int"), 2)).otherwise(0)
    padding = F.when(padded, unsigned(data, (F.octet_length(data) - 1).cast("int"), 1)).otherwise(0)
    length = F.octet_length(data) - offset - padding
    good = (F.octet_length(data) >= 12) & (F.shiftright(first, 6) == 2) & (length >= 0) & (~padded | (padding > 0))
    fields = F.struct(
        F.shiftright(first, 6).cast("long").alias("version"), (second >= 128).alias("marker"), second.bitwiseAND(F.lit(127)).alias("payload_type"), unsigned(data, 2, 2).alias("seq"),
        unsigned(data, 4, 4).alias("rtp_ts"), unsigned(data, 8, 4).alias("ssrc"), csrcs.alias("csrc_count"), offset.cast("long").alias("payload_at"), length.cast("long").alias("payload_bytes"),
    )
    return F.when(good, fields)


def ts_header(data: Column) -> Column:
    """Struct of a 188-byte transport packet's header, with the program clock (27 MHz) where it has one; null for other lengths or without the sync byte 0x47."""
    second, fourth = unsigned(data, 1, 2), unsigned(data, 3, 1)
    adaptation = F.shiftright(fourth, 4).bitwiseAND(F.lit(3))
    size, flags = unsigned(data, 4, 1), unsigned(data, 5, 1)
    has_flags = adaptation.isin(2, 3) & (size > 0)
    base = unsigned(data, 6, 4) * 2 + F.shiftright(unsigned(data, 10, 1), 7)
    extension = unsigned(data, 10, 2).bitwiseAND(F.lit(511))
    clock = F.when(has_flags & (flags.bitwiseAND(F.lit(16)) != 0) & (size >= 7), base * 300 + extension)
    fields = F.struct(
        (second.bitwiseAND(F.lit(0x4000)) != 0).alias("unit_start"), second.bitwiseAND(F.lit(0x1FFF)).alias("pid"), adaptation.alias("adaptation"), fourth.bitwiseAND(F.lit(15)).alias("continuity"),
        F.coalesce(has_flags & (flags.bitwiseAND(F.lit(128)) != 0), F.lit(False)).alias("discontinuity"), clock.alias("pcr"),
    )
    return F.when((F.octet_length(data) == 188) & (unsigned(data, 0, 1) == 0x47), fields)


def _crc_table() -> np.ndarray:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first."""
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << np.uint64(1)) ^ np.uint64(0x04C11DB7), table << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return table


def _flat(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array as one array, and where each value begins and the last one ends; nulls are empty."""
    data = pa.compute.fill_null(data.cast(pa.large_binary()), b"")
    _, offsets, values = data.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, dtype=np.uint8), ends


@F.arrow_udf(T.LongType())
def crc32_mpeg2(data: pa.Array) -> pa.Array:
    """Checksum of a binary column (starts with all ones, no final inversion), byte by byte over all values of the batch at once."""
    flat, ends = _flat(data)
    starts, lengths = ends[:-1], np.diff(ends)
    table, crc = _crc_table(), np.full(len(lengths), 0xFFFFFFFF, dtype=np.uint64)
    order = np.argsort(-lengths, kind="stable")
    for i in range(int(lengths.max(initial=0))):
        live = order[: int(np.searchsorted(-lengths[order], -i, side="left"))]
        crc[live] = ((crc[live] << np.uint64(8)) & np.uint64(0xFFFFFFFF)) ^ table[((crc[live] >> np.uint64(24)) ^ flat[starts[live] + i]).astype(np.int64)]
    return pa.array(crc.astype(np.int64), mask=data.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("header", T.IntegerType())])))
def nal_units(data: pa.Array) -> pa.Array:
    """Units between start codes (00 00 01, with or without a zero before): where each begins, its length, its first byte.

    All values of a batch are scanned as one array. Zeros ahead of the next start code belong to no unit; a null stays null.
    """
    flat, ends = _flat(data)
    codes = np.flatnonzero((flat[:-2] == 0) & (flat[1:-1] == 0) & (flat[2:] == 1)) if len(flat) > 2 else np.zeros(0, dtype=np.int64)
    value = np.searchsorted(ends, codes, side="right") - 1
    whole = (codes >= ends[0]) & (codes + 3 <= ends[np.minimum(value + 1, len(ends) - 1)]) & (value < len(data))
    codes, value = codes[whole], value[whole]
    begin, end = codes + 3, ends[value + 1] if len(codes) else codes
    followed = np.flatnonzero(value[1:] == value[:-1])
    filled = np.maximum.accumulate(np.where(flat != 0, np.arange(len(flat)), -1))
    end = end.copy()
    end[followed] = np.maximum(begin[followed], filled[codes[followed + 1] - 1] + 1)
    some = end > begin
    begin, end, value = begin[some], end[some], value[some]
    columns = [pa.array(begin - ends[value], pa.int64()), pa.array(end - begin, pa.int64()), pa.array(flat[begin].astype(np.int32), pa.int32())]
    lists = np.searchsorted(value, np.arange(len(data) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(columns, names=["at", "bytes", "header"]), mask=data.is_null())


def is_random_access(header: Column, codec: str) -> Column:
    """Whether a unit with this first byte starts a random-access picture: type 5 of H.264, 19 or 20 of HEVC."""
    if codec == "h264":
        return header.bitwiseAND(F.lit(31)) == 5
    return F.shiftright(header, 1).bitwiseAND(F.lit(63)).isin(19, 20)


def random_access_unit(units: Column, codec: str) -> Column:
    """Whether an access unit (its units, as nal_units lists them) holds a random-access slice and no slice of another kind."""
    kind = lambda u: u["header"].bitwiseAND(F.lit(31)) if codec == "h264" else F.shiftright(u["header"], 1).bitwiseAND(F.lit(63))
    slices = F.filter(units, lambda u: kind(u).between(1, 5) if codec == "h264" else kind(u) < 32)
    return (F.size(slices) > 0) & F.forall(slices, lambda u: is_random_access(u["header"], codec))


def fmtp(text: Column) -> Column:
    """Parameters key=value, separated by semicolons, as a map with lower-case keys; null if one has no name or value or a name occurs twice."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.transform(parts, lambda x: F.lower(F.trim(F.substring_index(x, "=", 1))))
    values = F.transform(parts, lambda x: F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))))
    good = F.forall(parts, lambda x: F.instr(x, "=") > 1) & F.forall(values, lambda x: x != "") & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(good, F.map_from_arrays(names, values))


def session_description(session: Column, address: Column, port: Column, payload_type: Column, encoding: Column, rate: Column, parameters: Column) -> Column:
    """The text of a session description of one stream; lines end in CR LF."""
    lines = [
        F.lit("v=0"), F.concat(F.lit("o=- 0 0 IN IP4 "), address), F.concat(F.lit("s="), session), F.concat(F.lit("c=IN IP4 "), address), F.lit("t=0 0"),
        F.concat(F.lit("m=video "), port.cast("string"), F.lit(" RTP/AVP "), payload_type.cast("string")), F.concat(F.lit("a=rtpmap:"), payload_type.cast("string"), F.lit(" "), encoding, F.lit("/"), rate.cast("string")),
        F.when(parameters.isNotNull(), F.concat(F.lit("a=fmtp:"), payload_type.cast("string"), F.lit(" "), parameters)),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"))


def rescale(value: Column, num: int, den: int, mode: str = "nearest") -> Column:
    """value * num / den in whole numbers: nearest (halves away from zero), up, or zero (towards it). The product may be larger than a long."""
    product = value.cast("decimal(20,0)") * F.lit(num).cast("decimal(18,0)")
    size, sign = F.abs(product), F.signum(product).cast("long")
    if mode == "nearest":
        return sign * F.call_function("div", size + F.lit(den // 2), F.lit(den).cast("decimal(18,0)"))
    down = F.call_function("div", size, F.lit(den).cast("decimal(18,0)"))
    if mode == "zero":
        return sign * down
    up = F.call_function("div", size + F.lit(den - 1), F.lit(den).cast("decimal(18,0)"))
    return F.when(product > 0, up).otherwise(sign * down)


def output_timestamp(ns: Column, clock_rate: int, offset: Column) -> Column:
    """Nanoseconds as a 32-bit counter at clock_rate, cut towards zero, begun at offset."""
    return F.pmod(rescale(ns, clock_rate, 1_000_000_000, "zero") + offset, F.lit(1 << 32))


def redacted_url(url: Column) -> Column:
    """A URL without its user name and password."""
    return F.regexp_replace(url, r"(://)[^/@]*@", "$1***@")


def _numbers(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The big-endian numbers of n bytes at these places."""
    out = np.zeros(len(at), dtype=np.int64)
    for i in range(n):
        out = (out << 8) | flat[at + i]
    return out


_RTCP = {"at": T.IntegerType(), "type": T.LongType(), "count": T.LongType(), "bytes": T.LongType(), "ssrc": T.LongType(), "ntp_sec": T.LongType(), "ntp_frac": T.LongType(), "rtp_ts": T.LongType()}


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _RTCP.items()])))
def rtcp_packets(data: pa.Array) -> pa.Array:
    """The packets of a compound control datagram: at, type, count, bytes, ssrc and, of sender reports (type 200), ntp_sec, ntp_frac and rtp_ts. Null if it isn't made of whole packets of version 2 or doesn't begin with a report.

    The first packets of all datagrams of a batch are read at once, then the second ones, and so on.
    """
    flat, ends = _flat(data)
    starts, sizes = ends[:-1], np.diff(ends)
    at, good, begins = np.zeros(len(sizes), dtype=np.int64), sizes > 0, np.zeros(len(sizes), dtype=bool)
    found = [np.zeros((2, 0), dtype=np.int64)]
    live = np.flatnonzero(good)
    while len(live):
        fits = sizes[live] - at[live] >= 8
        good[live[~fits]] = False
        live = live[fits]
        here = starts[live] + at[live]
        kind, length = flat[here + 1], (_numbers(flat, here + 2, 2) + 1) * 4
        whole = (flat[here] >> 6 == 2) & (at[live] + length <= sizes[live]) & ((kind != 200) | (length >= 28))
        good[live[~whole]] = False
        if len(found) == 1:
            begins[live] = (kind == 200) | (kind == 201)
        live, length = live[whole], length[whole]
        found.append(np.stack([live, at[live]]))
        at[live] += length
        live = live[at[live] < sizes[live]]
    row, place = np.concatenate(found, axis=1)
    kept = good & begins
    row, place = row[kept[row]], place[kept[row]]
    order = np.argsort(row, kind="stable")
    row, place = row[order], place[order]
    here = starts[row] + place
    report = flat[here + 1] == 200
    of_report = [np.zeros(len(here), dtype=np.int64) for _ in range(3)]
    for values, k in zip(of_report, (8, 12, 16), strict=True):
        values[report] = _numbers(flat, here[report] + k, 4)
    columns = [pa.array(place.astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in (flat[here + 1], flat[here] & 31, (_numbers(flat, here + 2, 2) + 1) * 4, _numbers(flat, here + 4, 4))], *[pa.array(x, mask=~report) for x in of_report]]
    lists = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(columns, names=list(_RTCP)), mask=pa.array(~kept))


def ntp_nanoseconds(seconds: Column, fraction: Column) -> Column:
    """A 64-bit clock value in nanoseconds, cut."""
    return seconds * 1_000_000_000 + F.shiftrightunsigned(fraction * 1_000_000_000, 32)


def base64_text(data: Column) -> Column:
    """Bytes in base 64, on one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def valid_utf8(data: Column) -> Column:
    """Whether bytes are UTF-8 text."""
    return F.is_valid_utf8(data.cast("string"))


#: Names of rate-control modes and their aliases.
RATE_MODES = {"auto": "auto", "": "auto", "cbr": "cbr", "vbr": "vbr", "cvbr": "cvbr", "capped_vbr": "cvbr", "capped-vbr": "cvbr", "crf": "crf"}


def rate_control_mode(text: Column) -> Column:
    """The canonical name of a rate-control mode; null if it is unknown."""
    return F.create_map(*[F.lit(x) for pair in RATE_MODES.items() for x in pair])[text]


def _big_endian(number: Column, n: int) -> Column:
    return F.lpad(F.hex(number), 2 * n, "0")


def timestamp_field(prefix: int, ticks: Column) -> Column:
    """The five bytes of a 33-bit timestamp behind a prefix of four bits (1, 2 or 3), a marker bit after each part; null if it doesn't fit."""
    part = lambda shift, mask: F.shiftright(ticks, shift).bitwiseAND(F.lit(mask)) * 2 + 1
    text = F.concat(_big_endian(F.lit(16 * prefix) + part(30, 0x7), 1), _big_endian(part(15, 0x7FFF), 2), _big_endian(part(0, 0x7FFF), 2))
    return F.when(ticks.between(0, (1 << 33) - 1) & F.lit(prefix in (1, 2, 3)), F.unhex(text))


def timestamp_value(data: Column) -> Column:
    """The 33-bit timestamp of such five bytes; null if a marker bit is missing or the prefix is none of the three."""
    a, b, c = unsigned(data, 0, 1), unsigned(data, 1, 2), unsigned(data, 3, 2)
    marked = (a % 2 == 1) & (b % 2 == 1) & (c % 2 == 1) & F.shiftright(a, 4).isin(1, 2, 3)
    value = F.shiftleft(F.shiftright(a, 1).bitwiseAND(F.lit(7)), 30) + F.shiftleft(F.shiftright(b, 1), 15) + F.shiftright(c, 1)
    return F.when((F.octet_length(data) == 5) & marked, value)


def rewritten(data: Column, head: Column, payload_type: int, ssrc: Column, rtp_ts: Column) -> Column:
    """A datagram, whose header rtp_header gives, with another source and timestamp; null if it is none, has no payload or another payload type than planned, or the source is 0."""
    control = unsigned(data, 1, 1).between(192, 223)
    fields = F.unhex(F.concat(_big_endian(rtp_ts, 4), _big_endian(ssrc, 4)))
    return F.when(~control & (head["payload_type"] == payload_type) & (head["payload_bytes"] > 0) & (ssrc != 0), F.overlay(data, fields, 5, 8))


def sender_report(ssrc: Column, ntp_sec: Column, ntp_frac: Column, rtp_ts: Column, packets: Column, octets: Column) -> Column:
    """The 28 bytes of a sender report without report blocks; counters wrap at 32 bits."""
    wrapped = [F.pmod(x, F.lit(1 << 32)) for x in (ssrc, ntp_sec, ntp_frac, rtp_ts, packets, octets)]
    return F.unhex(F.concat(F.lit("80C80006"), *[_big_endian(x, 4) for x in wrapped]))


def transport_session_description(user: Column, session_id: Column, version: Column, session: Column, address: Column, port: Column, ssrc: Column, cname: Column) -> Column:
    """The text of a session description of one transport stream (payload type 33, 90 kHz, reports on the next port); null unless the port is even and not 0, version and source are not 0."""
    family = F.when(F.contains(address, F.lit(":")), "IP6").otherwise("IP4")
    where, number = F.concat(F.lit("IN "), family, F.lit(" "), address), lambda x: x.cast("string")
    lines = [
        F.lit("v=0"), F.concat_ws(" ", F.concat(F.lit("o="), user), number(session_id), number(version), where), F.concat(F.lit("s="), session), F.concat(F.lit("c="), where), F.lit("t=0 0"),
        F.concat(F.lit("m=video "), number(port), F.lit(" RTP/AVP 33")), F.concat(F.lit("a=rtcp:"), number(port + 1), F.lit(" "), where), F.lit("a=rtpmap:33 MP2T/90000"), F.concat(F.lit("a=ssrc:"), number(ssrc), F.lit(" cname:"), cname),
    ]
    return F.when((port % 2 == 0) & (port > 0) & (ssrc != 0) & (version != 0), F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n")))
