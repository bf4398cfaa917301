"""Closed forms against the loops they replace, on random streams."""

import random

import pytest

from rillmark.operators import routing, scheduling, stateful, timestamps


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(7)
    rows = []
    for stream in range(40):
        t = rng.randrange(1000)
        for k in range(rng.randrange(1, 30)):
            t += rng.choice([0, 1, 5, 10, 40, 200, 900])
            rows.append((stream, t, k, rng.randrange(-20, 20), rng.choice([None, 0, 3, 9]), rng.randrange(0, 50)))
    return rows


def frame(spark, streams):
    return spark.createDataFrame(streams, "stream_id long, pts long, sequence long, jitter long, duration long, bytes long")


def by_stream(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_resample(spark, streams):
    period, gap = 25, 300
    want = []
    for stream, rows in by_stream(streams).items():
        start = tick = before = None
        for _, pts, seq, *_ in rows:
            if before is None or pts - before[0] > gap:
                start = tick = pts
            while tick <= pts:
                earlier = before is not None and start != pts and start <= before[0] and tick - before[0] <= pts - tick
                want.append((stream, tick, before[1] if earlier else seq))
                tick += period
            before = (pts, seq)
    got = [tuple(r) for r in timestamps.resample_constant_rate(frame(spark, streams), period, gap).collect()]
    assert sorted(got) == sorted(want)


def test_shift_monotonic(spark, streams):
    df = frame(spark, streams).selectExpr("stream_id", "sequence", "pts + jitter as pts", "case when sequence % 4 <> 0 then pts end as dts", "duration")
    want = {}
    for stream, rows in by_stream(streams).items():
        free = None
        for _, pts, seq, j, d, _ in rows:
            p, q = pts + j, pts if seq % 4 else None
            known = [x for x in (p, q) if x is not None]
            shift = 0 if free is None else max(0, free - min(known))
            free = max(known) + shift + max(d or 1, 1)
            want[stream, seq] = (p + shift, None if q is None else q + shift)
    got = {(r.stream_id, r.sequence): (r.pts, r.dts) for r in timestamps.shift_monotonic(df).collect()}
    assert got == want


def test_increasing_and_missing(spark, streams):
    df = frame(spark, streams).selectExpr("stream_id", "sequence", "pts + jitter as pts")
    gaps = frame(spark, streams).selectExpr("stream_id", "sequence", "case when sequence % 3 <> 0 then pts end as pts")
    up, filled = {}, {}
    for stream, rows in by_stream(streams).items():
        last = made = None
        for _, pts, seq, j, *_ in rows:
            last = pts + j if last is None else max(pts + j, last + 1)
            up[stream, seq] = last
            known = pts if seq % 3 else None
            # A missing one follows the largest that could be last: the greater of a known one and the line continued.
            value = known if known is not None else (0 if made is None else made + 4)
            filled[stream, seq] = value
            made = value if made is None else max(value, made) if known is not None else value
    assert {(r.stream_id, r.sequence): r.out_pts for r in timestamps.strictly_increasing(df).collect()} == up
    assert {(r.stream_id, r.sequence): r.out_pts for r in timestamps.synthesize_missing(gaps, 4).collect()} == filled


def test_trim_and_rechunk(spark, streams):
    df = frame(spark, streams).selectExpr("stream_id", "sequence", "bytes as samples").where("samples > 0")
    kept, full = set(), {}
    for stream, rows in by_stream(streams).items():
        left, line = 70, []
        for _, _, seq, _, _, n in rows:
            cut = min(left, n)
            left -= cut
            if n > cut:
                kept.add((stream, seq, cut, n - cut))
            line += [seq] * n
        for k in range(len(line) // 32):
            full[stream, k] = (line[32 * k], line[32 * k + 31])
    assert {tuple(r) for r in timestamps.trim_leading(df, 70).collect()} == kept
    assert {(r.stream_id, r.frame): (r.first_sequence, r.last_sequence) for r in timestamps.rechunk(df, 32).collect()} == full


def test_rechunk_lists_frames_where_they_end(spark):
    """Frames over many rows, rows over many frames, rows without samples; nothing but the sort by stream holds rows."""
    rng, rows, full = random.Random(11), [], {}
    for stream in range(6):
        line = []
        for seq in range(0, 240, 2):
            n = rng.choice((None, 0, 1, 2, 3, 9, 10, 20, 47))
            rows.append((stream, seq, n))
            line += [seq] * (n or 0)
        full |= {(stream, k): (line[10 * k], line[10 * k + 9]) for k in range(len(line) // 10)}
    rng.shuffle(rows)
    out = timestamps.rechunk(spark.createDataFrame(rows, "stream_id long, sequence long, samples long"), 10)
    assert sorted((r.stream_id, r.frame, r.first_sequence, r.last_sequence) for r in out.collect()) == sorted((*k, *v) for k, v in full.items())
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reorder(spark):
    rows = [(1, k, 10 * k, 7, seq % 65536, 96) for k, seq in enumerate([65534, 65535, 1, 0, 0, 5, 6, 7, 8, 2])]
    df = spark.createDataFrame(rows, "stream_id long, arrival long, received long, ssrc long, seq16 int, payload_type int")
    got = [(r.arrival, r.seq, r.event) for r in stateful.reorder(df, 3, 1_000_000).collect()]
    assert got == [(0, 65534, "released"), (1, 65535, "released"), (3, 0, "released"), (2, 1, "released"), (4, 0, "duplicate"), (8, 5, "gap"), (5, 5, "released"), (6, 6, "released"), (7, 7, "released"), (8, 8, "released"), (9, 2, "duplicate")]


def test_servo_settles(spark):
    rows = [(1, k, k * 20_000_000, 5_000_000) for k in range(2000)]
    df = spark.createDataFrame(rows, "stream_id long, sequence long, at_ns long, phase_ns long")
    out = stateful.drift_servo(df).orderBy("sequence").collect()
    steps = [b.stretch_ppm - a.stretch_ppm for a, b in zip(out, out[1:], strict=False)]
    assert max(map(abs, steps)) <= 2 and max(r.stretch_ppm for r in out) <= 1000 and out[-1].stretch_ppm > 0


def test_queue_and_ladder(spark):
    rows = [(1, k, True, key) for k, key in enumerate([False, True, True])] + [(1, 3, True, False), (1, 4, True, True), (1, 5, False, False)]
    df = spark.createDataFrame(rows, "stream_id long, sequence long, push boolean, key_frame boolean")
    assert [(r.outcome, r.dropped_sequence) for r in stateful.bounded_queue(df, 3, "drop_non_key").collect()] == [("accepted", None)] * 3 + [("dropped", 3), ("accepted", 0), ("popped", 1)]
    assert [r.outcome for r in stateful.bounded_queue(df, 3, "block").collect()][3:] == ["would_block", "would_block", "popped"]
    samples = spark.createDataFrame([(1, k, 0.1 if k < 2 else 0.0, 0, 10**9) for k in range(12)], "stream_id long, sequence long, loss double, delay_us long, throughput long")
    assert [r.bitrate for r in stateful.bitrate_ladder(samples, [1, 2, 3]).collect()] == [2, 1] + [1] * 8 + [2, 2]


def test_reorder_refuses_and_reports(spark):
    """A packet of another payload type is refused before its source is looked at; a new source is reported and starts anew."""
    rows = [(1, 0, 0, 7, 10, 96), (1, 1, 0, 7, 12, 96), (1, 2, 0, 8, 13, 97), (1, 3, 0, 8, 500, 96), (1, 4, 0, 8, 501, 96), (1, 5, 0, 7, 11, 97)]
    df = spark.createDataFrame(rows, "stream_id long, arrival long, received long, ssrc long, seq16 long, payload_type long")
    got = [(r.arrival, r.seq, r.event) for r in stateful.reorder(df, 3, 1_000_000).collect()]
    assert got == [(0, 10, "released"), (2, 13, "rejected"), (3, 500, "ssrc_changed"), (3, 500, "released"), (4, 501, "released"), (5, 11, "rejected")]


def test_program_clock_generations(spark):
    """A discontinuity on the first sample counts, and a second one before the generation is ready doesn't."""
    marks = [True, True, False, False, True, True, True, False]
    df = spark.createDataFrame([(1, k, 1_000_000 * (k + 1), m) for k, m in enumerate(marks)], "stream_id long, sequence long, pcr long, discontinuity boolean")
    out = stateful.program_clock(df, 10_000_000).orderBy("sequence").collect()
    assert [(r.generation, r.ready) for r in out] == [(2, False), (2, False), (2, True), (2, True), (3, False), (3, False), (3, False), (3, True)]


def test_servo_may_begin_in_recovery(spark):
    df = spark.createDataFrame([(1, 0, 0, 150_000_000), (2, 0, 0, 1_000)], "stream_id long, sequence long, at_ns long, phase_ns long")
    assert {r.stream_id: (r.action, r.recovering) for r in stateful.drift_servo(df).collect()} == {1: ("first", True), 2: ("first", False)}


def test_credit_admission(spark):
    """What is refused is never added, and gives nothing back."""
    rows = [(1, 0, 10, 1, 60, 1), (1, 1, 20, 2, 60, 1), (1, 2, 30, 3, 40, 1), (1, 3, 21, 2, -60, -1), (1, 4, 11, 1, -30, 0), (1, 5, 50, 5, 30, 1), (1, 6, 12, 1, -30, -1)]
    df = spark.createDataFrame(rows, "ledger_id long, at long, sequence long, reservation long, delta_bytes long, delta_objects long")
    got = {r.sequence: r.verdict for r in stateful.credit_admission(df, 100, 3).collect()}
    assert got == {10: "granted", 20: "pressure", 30: "granted", 21: "none", 11: "release", 50: "granted", 12: "release"}


def test_fold_keeps_whole_numbers_beside_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(1, 0, big), (1, 1, None), (None, 0, big + 2)], "k long, n long, v long")
    out = stateful.ordered_fold(df, ["k"], ["n"], dict, lambda s, r: [(r.k, r.v)], "k long, v long").collect()
    assert sorted([(r.k or 0, r.v or 0) for r in out]) == [(0, big + 2), (1, 0), (1, big)]


def test_ordered_merge_step_by_step(spark):
    """Against a merge that looks at two heads at a time."""
    import random

    rng = random.Random(8)
    rows = [(s, k, g, rng.randrange(4), rng.randrange(2)) for s in range(6) for k, g in enumerate(sorted(rng.randrange(1, 3) for _ in range(30)))]
    want = {}
    for s in range(6):
        place = 0
        for g in (1, 2):
            sides = [sorted((d, k) for t, k, h, d, side in rows if (t, h, side) == (s, g, x)) for x in (0, 1)]
            last = 1
            while sides[0] or sides[1]:
                heads = [x[0][0] if x else 99 for x in sides]
                last = 1 - last if heads[0] == heads[1] else int(heads[1] < heads[0])
                place += 1
                want[s, sides[last].pop(0)[1]] = place
    df = spark.createDataFrame(rows, "stream_id long, sequence long, generation long, dispatch long, side int")
    assert {(r.stream_id, r.sequence): r.position for r in scheduling.ordered_merge(df).collect()} == want


def test_epoch_gate_keeps_records_outside(spark):
    units = spark.createDataFrame([(1, 5, 1), (2, 15, 1), (3, 50, 1)], "sequence long, pts long, generation long")
    epochs = spark.createDataFrame([(1, 0, 10), (2, 10, 20)], "epoch_generation long, begins long, ends long")
    assert {r.sequence: r.verdict for r in routing.epoch_gate(units, epochs, 10).collect()} == {1: "pass", 2: "drop", 3: "withhold"}
