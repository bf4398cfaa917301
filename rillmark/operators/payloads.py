"""Media units and the packets that carry them: access units put together from packets, frames read out of one packet.

What a packet says is an expression, its frames are read over a whole batch; only units that span packets are grouped, and such a group is one access unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import wire
from rillmark.functions.wire import unsigned

#: Kinds of aggregates and fragments, bytes of a unit's header, kinds of random-access slices.
CODECS = {"h264": (24, 28, 1, (5,)), "hevc": (48, 49, 2, (19, 20))}
START_CODE = "00000001"


def _kind(header: Column, codec: str) -> Column:
    return header.bitwiseAND(F.lit(31)) if codec == "h264" else F.shiftright(header, 1).bitwiseAND(F.lit(63))


def _bytes(number: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * n, "0"))


def _tail(data: Column, at: Column | int) -> Column:
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.substring(data, start, F.octet_length(data))


def _aggregated(data: Column, codec: str) -> Column:
    """(at, good, key, out): the units of an aggregate, each led by its size in two bytes, with start codes between them."""
    width, access, size = CODECS[codec][2], CODECS[codec][3], F.octet_length(data)
    start = F.struct(F.lit(width).alias("at"), F.lit(True).alias("good"), F.lit(False).alias("key"), F.unhex(F.lit("")).alias("out"))

    def one(state: Column, _: Column) -> Column:
        at = state["at"]
        length = F.coalesce(unsigned(data, at, 2), F.lit(0)).cast("int")
        good = (length > 0) & (at + 2 + length <= size)
        key = state["key"] | F.coalesce(_kind(unsigned(data, at + 2, 1), codec).isin(*access), F.lit(False))
        out = F.concat(state["out"], F.unhex(F.lit(START_CODE)), F.substring(data, at + 3, length))
        found = F.struct((at + 2 + length).alias("at"), F.lit(True).alias("good"), key.alias("key"), out.alias("out"))
        bad = F.struct(at.alias("at"), F.lit(False).alias("good"), state["key"].alias("key"), state["out"].alias("out"))
        return F.when(~state["good"] | (at >= size), state).when(good, found).otherwise(bad)

    return F.aggregate(F.sequence(F.lit(0), F.floor(size / 3).cast("int")), start, one)


def access_units(packets: DataFrame, codec: str = "h264") -> DataFrame:
    """Access units of packets (stream_id, seq without wrap, rtp_ts, marker, payload): a row for each stream and rtp_ts.

    data holds the units with a start code before each, packets how many carried them, key_frame whether one is a
    random-access slice. complete is false, and data null, if a packet is missing inside or right before, the marker is
    not on the last packet alone, a payload is empty, of unknown kind or malformed, or a fragment has no begin or end.
    A stream's first packet counts as the begin of its unit. One shuffle by stream; a group is one access unit.
    """
    aggregate, fragment, width, access = CODECS[codec]
    head = unsigned(F.col("payload"), 0, 1)
    inner = unsigned(F.col("payload"), width, 1)
    rows = packets.withColumn("_kind", _kind(head, codec)).withColumn("_size", F.octet_length("payload"))
    rows = rows.withColumn("_first", (F.col("_kind") == fragment) & (inner >= 128)).withColumn("_last", (F.col("_kind") == fragment) & (inner.bitwiseAND(F.lit(64)) != 0))
    inner_kind = inner.bitwiseAND(F.lit(31 if codec == "h264" else 63))
    rebuilt = _bytes(head.bitwiseAND(F.lit(0xE0)) + inner_kind, 1) if codec == "h264" else F.concat(_bytes(head.bitwiseAND(F.lit(0x81)) + 2 * inner_kind, 1), F.substring("payload", F.lit(2), F.lit(1)))
    code, rest = F.unhex(F.lit(START_CODE)), _tail(F.col("payload"), width + 1)
    rows = rows.withColumn("_many", F.when(F.col("_kind") == aggregate, _aggregated(F.col("payload"), codec)))
    piece = F.when(F.col("_kind") == aggregate, F.col("_many.out")).when(F.col("_first"), F.concat(code, rebuilt, rest)).when(F.col("_kind") == fragment, rest).otherwise(F.concat(code, F.col("payload")))
    key = F.when(F.col("_kind") == aggregate, F.col("_many.key")).when(F.col("_kind") == fragment, F.col("_first") & inner_kind.isin(*access)).otherwise(F.col("_kind").isin(*access))
    single = F.col("_kind").between(1, 23) if codec == "h264" else F.col("_kind") < aggregate
    fits = F.when(F.col("_kind") == aggregate, F.col("_many.good") & (F.octet_length("_many.out") > 0)).when(F.col("_kind") == fragment, (F.col("_size") > width + 1) & ~(F.col("_first") & F.col("_last"))).otherwise(single & (F.col("_size") >= width))
    stream = Window.partitionBy("stream_id").orderBy("seq")
    before, after = (lambda c: F.lag(c).over(stream)), (lambda c: F.lead(c).over(stream))
    here = before("rtp_ts") == F.col("rtp_ts")
    rows = rows.withColumn("_open", (F.col("_kind") == fragment) & ~F.col("_last")).withColumn("_inner", F.when(F.col("_kind") == fragment, inner_kind))
    follows = here & before("_open") & (before("_inner") == F.col("_inner"))
    whole = F.when((F.col("_kind") == fragment) & ~F.col("_first"), F.coalesce(follows, F.lit(False))).otherwise(~F.coalesce(here & before("_open"), F.lit(False)))
    ends = F.coalesce(after("rtp_ts") != F.col("rtp_ts"), F.lit(True))
    good = F.coalesce(fits, F.lit(False)) & whole & F.coalesce(F.col("seq") - before("seq") == 1, F.lit(True)) & (F.col("marker") == ends) & ~(ends & F.coalesce(F.col("_open"), F.lit(False)))
    rows = rows.select("stream_id", "rtp_ts", "seq", F.coalesce(good, F.lit(False)).alias("_good"), F.coalesce(key, F.lit(False)).alias("_key"), F.coalesce(piece, F.unhex(F.lit(""))).alias("_piece"))
    units = rows.groupBy("stream_id", "rtp_ts").agg(F.count("*").alias("packets"), F.bool_and("_good").alias("complete"), F.bool_or("_key").alias("key_frame"), F.sort_array(F.collect_list(F.struct("seq", "_piece"))).alias("_pieces"))
    joined = F.aggregate("_pieces", F.unhex(F.lit("")), lambda data, p: F.concat(data, p["_piece"]))
    return units.select("stream_id", "rtp_ts", "packets", "complete", "key_frame", F.when(F.col("complete"), joined).alias("data"))


def aac_frames(payload: Column, duration: int) -> Column:
    """The frames of a packet of several (sizes in 13 bits, index steps in 3): ts_offset in ticks and data; null if the sizes don't make up the payload. A frame spread over packets is none of these.

    The headers of all packets of a batch are read at once. A packet's frames are its last bytes, one after another.
    """
    frame = T.StructType([T.StructField("ts_offset", T.LongType()), T.StructField("data", T.BinaryType())])

    @F.arrow_udf(T.ArrayType(frame))
    def frames(data: pa.Array) -> pa.Array:
        flat, ends = wire._flat(data)
        starts, lengths = ends[:-1], np.diff(ends)
        bits = np.zeros(len(lengths), dtype=np.int64)
        led = np.flatnonzero(lengths >= 4)
        bits[led] = wire._numbers(flat, starts[led], 2)
        good = (bits > 0) & (bits % 16 == 0) & (lengths >= 2 + bits // 8)
        count = np.where(good, bits // 16, 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(upto[-1]) - upto[row]
        header = wire._numbers(flat, starts[row] + 2 + 2 * nth, 2)
        size, step = header >> 3, np.where(nth == 0, 0, (header & 7) + 1)
        sizes, steps = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(step)])
        good &= 2 + 2 * count + sizes[upto[1:]] - sizes[upto[:-1]] == lengths
        good[row[size == 0]] = False
        kept = good[row]
        place = (steps[1:] - steps[upto[row]])[kept] * duration
        size, row = size[kept], row[kept]
        offsets = np.concatenate([[0], np.cumsum(size)])
        lists = np.searchsorted(row, np.arange(len(count) + 1))
        begin, own = starts + 2 + 2 * count, offsets[lists[1:]] - offsets[lists[:-1]]
        at = np.repeat(begin - offsets[lists[:-1]], own) + np.arange(offsets[-1])
        out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat[at])])
        values = pa.StructArray.from_arrays([pa.array(place, pa.int64()), out], names=frame.names)
        return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), values, mask=pa.array(~good))

    return frames(payload)


def opus_duration(payload: Column) -> Column:
    """How many 48 kHz samples a packet lasts, by its first byte and, of packets with any number of frames, its second; null for empty packets, no frames or more than 120 ms."""
    head = unsigned(payload, 0, 1)
    mode, code = F.shiftright(head, 3).cast("int"), head.bitwiseAND(F.lit(3))
    of = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    frame = F.when(mode < 12, of((480, 960, 1920, 2880), mode % 4)).when(mode < 16, of((480, 960), mode % 2)).otherwise(of((120, 240, 480, 960), mode % 4))
    frames = F.when(code == 0, 1).when(code < 3, 2).otherwise(F.when(F.octet_length(payload) > 1, unsigned(payload, 1, 1).bitwiseAND(F.lit(63))))
    total = (frame * frames).cast("long")
    return F.when((F.octet_length(payload) > 0) & total.between(1, 5760), total)
