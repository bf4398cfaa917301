"""Operators whose next step depends on what they decided before: folds over the records of a stream in order.

Rows are dealt by stream and sorted; each task reads its rows batch by batch and carries one state for the stream at hand, so
memory is bounded whatever a stream's length. The step functions are plain Python over small states.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame


TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, object], list[tuple]], schema: str, finish: Callable[[object, tuple], list[tuple]] | None = None) -> DataFrame:
    """Runs step(state, row) over the rows of each key in order; what it returns are rows of schema. finish(state, key) may add rows at a key's end. Whole numbers stay whole, also beside nulls."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    row_of = namedtuple("Row", df.columns)
    own_key = itemgetter(*[df.columns.index(k) for k in keys])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, TYPES[kind]) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        out: list[tuple] = []
        for batch in batches:
            for row in map(row_of._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                own = own_key(row)
                if not begun or own != key:
                    if finish and begun:
                        out += finish(state, key if isinstance(key, tuple) else (key,))
                    key, state, begun = own, start(), True
                out += step(state, row)
                if len(out) >= 4096:
                    yield packed(out)
                    out = []
        if finish and begun:
            out += finish(state, key if isinstance(key, tuple) else (key,))
        if out:
            yield packed(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def half_away(num: int, den: int) -> int:
    """num / den to the nearest integer, halves away from zero; den is positive."""
    q = (2 * abs(num) + den) // (2 * den)
    return q if num >= 0 else -q


# --- reordering ---------------------------------------------------------------------------------------------------------


@dataclass
class Reorder:
    expected: int | None = None
    ssrc: int | None = None
    pending: dict[int, tuple[int, int]] = field(default_factory=dict)

    def ahead(self, seq: int) -> int:
        return (seq - self.expected + 0x8000) % 0x10000 - 0x8000

    def drain(self, key: tuple, out: list[tuple]) -> None:
        while self.expected in self.pending:
            out.append((*key, self.pending.pop(self.expected)[1], self.expected, "released"))
            self.expected = (self.expected + 1) % 0x10000

    def skip(self, key: tuple, arrival: int, out: list[tuple]) -> None:
        self.expected = min(self.pending, key=self.ahead)
        out.append((*key, arrival, self.expected, "gap"))
        self.drain(key, out)


def reorder(packets: DataFrame, window: int, max_delay: int, payload_type: int = 96) -> DataFrame:
    """packets (stream_id, arrival, received, ssrc, seq16, payload_type) in sequence order: stream_id, arrival, seq, event.

    released: in order, arrival being the packet's own; duplicate: behind or already held; gap: what is missing before seq is
    given up, because more than window packets wait or the oldest has waited max_delay (one gap for each cause and packet);
    rejected: another payload type than the planned one, whatever else it has; ssrc_changed: a new source, which starts anew at
    this packet, what waited being given up. What still waits at the end is held.
    """

    def step(s: Reorder, r) -> list[tuple]:
        key, out = (r.stream_id,), []
        if r.payload_type != payload_type:
            return [(r.stream_id, r.arrival, r.seq16, "rejected")]
        if s.ssrc is not None and r.ssrc != s.ssrc:
            out.append((*key, r.arrival, r.seq16, "ssrc_changed"))
            s.expected = r.seq16
            s.pending.clear()
        s.ssrc = r.ssrc
        if s.expected is None:
            s.expected = r.seq16
        if s.ahead(r.seq16) < 0 or r.seq16 in s.pending:
            return [(r.stream_id, r.arrival, r.seq16, "duplicate")]
        s.pending[r.seq16] = (r.received, r.arrival)
        s.drain(key, out)
        if len(s.pending) > window:
            s.skip(key, r.arrival, out)
        if s.pending and r.received - min(t for t, _ in s.pending.values()) >= max_delay:
            s.skip(key, r.arrival, out)
        return out

    def finish(s: Reorder, key: tuple) -> list[tuple]:
        return [(*key, arrival, seq, "held") for seq, (_, arrival) in sorted(s.pending.items(), key=lambda x: s.ahead(x[0]))]

    return ordered_fold(packets, ["stream_id"], ["arrival"], Reorder, step, "stream_id long, arrival long, seq long, event string", finish)


# --- counters with rejects ----------------------------------------------------------------------------------------------


def unwrap_with_rejects(units: DataFrame, modulus: int) -> DataFrame:
    """As unwrap_counter, but a rejected record leaves the state as it was: stream_id, sequence, unwrapped (null if rejected), status."""

    def step(s: dict, r) -> list[tuple]:
        if "at" not in s:
            s["at"] = r.counter
            return [(r.stream_id, r.sequence, r.counter, "first")]
        ahead = (r.counter - s["at"]) % modulus
        if 2 * ahead >= modulus:
            return [(r.stream_id, r.sequence, None, "ambiguous" if 2 * ahead == modulus else "backward")]
        s["at"] += ahead
        return [(r.stream_id, r.sequence, s["at"], "forward")]

    return ordered_fold(units, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, unwrapped long, status string")


# --- sender reports -----------------------------------------------------------------------------------------------------


def report_calibration(reports: DataFrame, clock_rate: int, max_residual: int = 250_000_000, max_ppm: int = 1000) -> DataFrame:
    """Folds sender reports (stream_id, sequence, name, source_ns, ticks) into calibrations: stream_id, sequence, status, anchor_ns, rate_num, rate_den.

    The first report anchors; the rate is measured from it, while each anchor continues the mapping of the one before. A report
    that changes the name, goes back, or strays from the nominal rate by more than the bounds invalidates the calibration, and
    the next one starts anew. Ticks are extended already. Times are whole nanoseconds, divided half away from zero.
    """
    second = 1_000_000_000

    def step(s: dict, r) -> list[tuple]:
        def bad(why: str) -> list[tuple]:
            s.clear()
            return [(r.stream_id, r.sequence, why, None, None, None)]

        if s and r.name != s["name"]:
            return bad("name_changed")
        if s and r.source_ns < s["source"]:
            return bad("regressed")
        if s and r.source_ns == s["source"]:
            if r.ticks != s["ticks"]:
                return bad("ticks_changed")
            return [(r.stream_id, r.sequence, "refreshed", s["anchor"], s["num"], s["den"])]
        if not s:
            s.update(name=r.name, source=r.source_ns, ticks=r.ticks, anchor=r.source_ns, num=second, den=clock_rate, first=(r.ticks, r.source_ns))
            return [(r.stream_id, r.sequence, "anchored", r.source_ns, second, clock_rate)]
        dt, dn = r.ticks - s["ticks"], r.source_ns - s["source"]
        if dt <= 0:
            return bad("slope")
        if abs(dn * clock_rate - dt * second) > max_residual * clock_rate:
            return bad("residual")
        if abs(dn * clock_rate - dt * second) * 1_000_000 > max_ppm * dt * second:
            return bad("rate")
        anchor = s["anchor"] + half_away(dt * s["num"], s["den"])
        s.update(source=r.source_ns, ticks=r.ticks, anchor=anchor, num=r.source_ns - s["first"][1], den=r.ticks - s["first"][0])
        return [(r.stream_id, r.sequence, "locked", anchor, s["num"], s["den"])]

    return ordered_fold(reports, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, status string, anchor_ns long, rate_num long, rate_den long")


# --- program clock ------------------------------------------------------------------------------------------------------


def program_clock(samples: DataFrame, max_gap: int, modulus: int = 300 << 33, rate: int = 27_000_000) -> DataFrame:
    """Folds clock samples (stream_id, sequence, pcr, discontinuity): stream_id, sequence, generation, ready, source_ns.

    The second sample of a generation makes it ready. A discontinuity, a step back or one of more than max_gap ticks begins a
    new generation, also on the first sample, but not again before that generation is ready. Its source time never falls
    behind what was published.
    """

    def step(s: dict, r) -> list[tuple]:
        ahead = (r.pcr - s["pcr"]) % modulus if "pcr" in s else 0
        if r.discontinuity or "pcr" in s and (2 * ahead >= modulus or ahead == 0 or ahead > max_gap):
            s.pop("pcr", None)
            s.update(generation=s.get("generation", 1) + (not s.get("reacquiring", False)), reacquiring=True)
        if "pcr" not in s:
            s.setdefault("generation", 1)
            natural = r.pcr * 1_000_000_000 // rate
            s.update(pcr=r.pcr, anchor=r.pcr, source=max(s.get("published", natural), natural), ready=False)
        else:
            s.update(pcr=s["pcr"] + ahead, ready=True, reacquiring=False)
        now = s["source"] + half_away((s["pcr"] - s["anchor"]) * 1_000_000_000, rate)
        if s["ready"]:
            s["published"] = now
        return [(r.stream_id, r.sequence, s["generation"], s["ready"], now)]

    return ordered_fold(samples, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, generation long, ready boolean, source_ns long")


# --- drift --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ServoPolicy:
    """Planned constants: times in nanoseconds, rates in parts per million."""

    deadband: int = 1_000_000
    phase_filter: int = 250_000_000
    frequency_filter: int = 5_000_000_000
    proportional: int = 20_000
    integral: int = 1_000
    integral_limit: int = 2_000
    frequency_deadband: int = 10
    max_frequency: int = 10_000
    exit_frequency: int = 500
    min_interval: int = 10_000_000
    max_gap: int = 1_000_000_000
    slew: int = 100
    normal_limit: int = 1_000
    recovery_limit: int = 5_000
    enter: int = 100_000_000
    leave: int = 50_000_000
    hold: int = 500_000_000
    hard: int = 250_000_000


def drift_servo(measures: DataFrame, policy: ServoPolicy = ServoPolicy()) -> DataFrame:  # noqa: B008
    """A PI controller with frequency feed-forward over measures (stream_id, sequence, at_ns, phase_ns): stream_id, sequence, action, stretch_ppm, phase_ns (filtered), frequency_ppm, recovering.

    Measures closer than min_interval are passed over. Larger phase errors than hard, gaps over max_gap and frequencies over
    max_frequency clear the state (reacquire). The integral grows only while the target is not beyond its limit in its direction.
    """
    p, second, ppm = policy, 1_000_000_000, 1_000_000
    clamp = lambda x, limit: max(-limit, min(limit, x))

    def fresh(s: dict) -> None:
        s.clear()
        s.update(phase=0, frequency=0, integral=0, stretch=0, recovering=False, held=0)

    def step(s: dict, r) -> list[tuple]:
        def says(action: str) -> list[tuple]:
            return [(r.stream_id, r.sequence, action, s["stretch"], s["phase"], s["frequency"], s["recovering"])]

        if not s:
            fresh(s)
        if abs(r.phase_ns) >= p.hard:
            fresh(s)
            return says("reacquire")
        if "at" not in s:
            s.update(at=r.at_ns, raw=r.phase_ns, phase=r.phase_ns, recovering=abs(r.phase_ns) >= p.enter)
            return says("first")
        elapsed = r.at_ns - s["at"]
        if elapsed < p.min_interval:
            return says("none")
        raw = half_away((r.phase_ns - s["raw"]) * ppm, elapsed)
        if elapsed > p.max_gap or abs(raw) > p.max_frequency:
            fresh(s)
            return says("reacquire")
        s["phase"] += half_away((r.phase_ns - s["phase"]) * elapsed, p.phase_filter + elapsed)
        s["frequency"] += half_away((raw - s["frequency"]) * elapsed, p.frequency_filter + elapsed)
        if not s["recovering"]:
            s["recovering"], s["held"] = abs(r.phase_ns) >= p.enter, 0
        else:
            calm = abs(s["phase"]) <= p.leave and abs(s["frequency"]) <= p.exit_frequency
            s["held"] = min(p.hold, s["held"] + elapsed) if calm else 0
            s["recovering"] = s["held"] < p.hold
        phase = 0 if abs(s["phase"]) <= p.deadband else s["phase"]
        ahead = 0 if abs(s["frequency"]) <= p.frequency_deadband else s["frequency"]
        limit = p.recovery_limit if s["recovering"] else p.normal_limit
        push = half_away(phase * p.proportional, second) + ahead
        grow = half_away(half_away(phase * p.integral, second) * elapsed, second)
        integral = clamp(s["integral"] + grow, p.integral_limit)
        if not (push + integral > limit and grow > 0 or push + integral < -limit and grow < 0):
            s["integral"] = integral
        slew = max(1, half_away(p.slew * elapsed, second))
        target = clamp(push + s["integral"], limit)
        s.update(stretch=max(s["stretch"] - slew, min(s["stretch"] + slew, target)), at=r.at_ns, raw=r.phase_ns)
        return says("correct")

    return ordered_fold(measures, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, action string, stretch_ppm long, phase_ns long, frequency_ppm long, recovering boolean")


# --- credit --------------------------------------------------------------------------------------------------------------


def credit_admission(changes: DataFrame, max_bytes: int, max_objects: int) -> DataFrame:
    """Reservations and releases (ledger_id, at, sequence, reservation, delta_bytes, delta_objects) under both limits: ledger_id, sequence, verdict, delta_bytes, delta_objects.

    granted: it stays inside both limits with what is held; pressure: it doesn't, and is never added; release: it gives back
    a part of a granted reservation; none: what it would give back was never granted. At equal times releases come first. The
    state is what is held, by reservation.
    """

    def step(s: dict, r) -> list[tuple]:
        held = s.setdefault("held", {})
        if r.delta_bytes <= 0:
            verdict = "release" if r.reservation in held else "none"
            if verdict == "release":
                own = held[r.reservation]
                held[r.reservation] = (own[0] + r.delta_bytes, own[1] + r.delta_objects)
                if held[r.reservation][0] <= 0:
                    del held[r.reservation]
                s["bytes"], s["objects"] = s["bytes"] + r.delta_bytes, s["objects"] + r.delta_objects
        else:
            fits = s.get("bytes", 0) + r.delta_bytes <= max_bytes and s.get("objects", 0) + r.delta_objects <= max_objects
            verdict = "granted" if fits else "pressure"
            if fits:
                held[r.reservation] = (r.delta_bytes, r.delta_objects)
                s.update(bytes=s.get("bytes", 0) + r.delta_bytes, objects=s.get("objects", 0) + r.delta_objects)
        return [(r.ledger_id, r.sequence, verdict, r.delta_bytes, r.delta_objects)]

    return ordered_fold(changes, ["ledger_id"], ["at", "delta_bytes", "sequence"], dict, step, "ledger_id long, sequence long, verdict string, delta_bytes long, delta_objects long")


# --- rates and queues ---------------------------------------------------------------------------------------------------


def bitrate_ladder(samples: DataFrame, ladder: list[int]) -> DataFrame:
    """The rung after each sample (stream_id, sequence, loss, delay_us, throughput): stream_id, sequence, bitrate.

    Down a rung at 5 % loss, 200 ms delay or a throughput below 1.2 times the rung; up after 8 stable samples with less than
    1 % loss, 50 ms delay and more than twice the rung. Streams begin at the top.
    """
    rungs = sorted(ladder)

    def step(s: dict, r) -> list[tuple]:
        at, stable = s.get("at", len(rungs) - 1), s.get("stable", 0)
        worse = r.loss >= 0.05 or r.delay_us >= 200_000 or 0 < r.throughput < rungs[at] * 12 // 10
        better = stable >= 8 and r.loss < 0.01 and r.delay_us < 50_000 and r.throughput > 2 * rungs[at]
        if worse and at > 0:
            at, stable = at - 1, 0
        elif better and at + 1 < len(rungs):
            at, stable = at + 1, 0
        else:
            stable += 1
        s.update(at=at, stable=stable)
        return [(r.stream_id, r.sequence, rungs[at])]

    return ordered_fold(samples, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, bitrate long")


def paced(jobs: DataFrame, rate: int, max_rate: int, queue_limit: int) -> DataFrame:
    """Departure under a rate that rises with the queue: jobs (stream_id, sequence, release, deadline, bytes, queued_bytes, residence; nanoseconds): stream_id, sequence, rate, starts, ends, late.

    The rate is what drains the queue in the time that is left to the limit, between rate and max_rate, which also holds once
    the limit is reached. A job that can't end by its deadline is late and takes no time.
    """

    def step(s: dict, r) -> list[tuple]:
        own = max_rate
        if r.residence < queue_limit:
            own = min(max(rate, -(-r.queued_bytes * 1_000_000_000 // (queue_limit - r.residence))), max_rate)
        takes = -(-r.bytes * 1_000_000_000 // own)
        starts = max(r.release, s.get("free", r.release))
        late = starts + takes > r.deadline
        if not late:
            s["free"] = starts + takes
        return [(r.stream_id, r.sequence, own, starts, None if late else starts + takes, late)]

    return ordered_fold(jobs, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, rate long, starts long, ends long, late boolean")


def bounded_queue(events: DataFrame, capacity: int, policy: str) -> DataFrame:
    """What a bounded queue does with pushes and pops in order (stream_id, sequence, push, key_frame): stream_id, sequence, outcome, dropped_sequence.

    policy: block, drop_newest, drop_oldest, drop_non_key (an incoming key record takes the place of the first that isn't one)
    or abort.
    """

    def step(s: dict, r) -> list[tuple]:
        queue = s.setdefault("queue", [])
        said = lambda outcome, other=None: [(r.stream_id, r.sequence, outcome, other)]
        if not r.push:
            return said("popped", queue.pop(0)[0]) if queue else said("empty")
        if s.get("closed"):
            return said("aborted")
        other = None
        if len(queue) >= capacity:
            if policy == "drop_newest" or policy == "drop_non_key" and not r.key_frame:
                return said("dropped", r.sequence)
            if policy == "abort":
                s["closed"] = True
                return said("aborted")
            at = 0 if policy == "drop_oldest" else next((i for i, x in enumerate(queue) if not x[1]), None) if policy == "drop_non_key" else None
            if at is None:
                return said("would_block")
            other = queue.pop(at)[0]
        queue.append((r.sequence, r.key_frame))
        return said("accepted", other)

    return ordered_fold(events, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, outcome string, dropped_sequence long")


#: What each event does in each state of start-up; anything else is rejected. Failure, stop and abort end a run.
TRANSITIONS = {("Idle", "acquire"): "AcquiringClock", ("AcquiringClock", "prime"): "PrimingStreams", ("PrimingStreams", "arm"): "Armed", ("Armed", "release"): "Released", ("Released", "run"): "Running"}
TERMINAL = {"fail": "Failed", "stop": "Stopped", "abort": "Aborted"}


def startup_states(events: DataFrame) -> DataFrame:
    """The start-up state machine over events (stream_id, sequence, event, generation): stream_id, sequence, state, generation, accepted."""

    def step(s: dict, r) -> list[tuple]:
        state, generation = s.get("state", "Idle"), s.get("generation", 0)
        new = None
        if state not in TERMINAL.values():
            new = TERMINAL.get(r.event) or TRANSITIONS.get((state, r.event))
            if r.event == "reacquire" and r.generation >= generation:
                new = "AcquiringClock"
        if new:
            s.update(state=new, generation=max(generation, r.generation))
        return [(r.stream_id, r.sequence, s.get("state", state), s.get("generation", generation), new is not None)]

    return ordered_fold(events, ["stream_id"], ["sequence"], dict, step, "stream_id long, sequence long, state string, generation long, accepted boolean")
