"""The catalogue: every operator applied to the test tables, with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import wire
from rillmark.operators import canonical, clocks, ledgers, payloads, routing, scheduling, stateful, timestamps
from rillmark.plans import graph, planner
from rillmark.schema import from_events
from rillmark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 604_800_000_000
#: 2024-01-01 in microseconds: a multiple of neither, so that floors are exercised.
ORIGIN = 1_704_067_200_000_000

_U = """u AS (SELECT user_id AS stream_id, event_type AS stream_kind, epoch_us(ts) AS pts, event_id AS sequence,
    event_type = 'purchase' AS key_frame, round(value * 100)::BIGINT AS bytes FROM events)"""


def query(sql: str | None = None):
    """Registers a query and its SQL, in which {U} stands for the stream records."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{U}", _U)
        return f

    return keep


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


# --- timestamps ---------------------------------------------------------------------------------------------------------

_RESAMPLE = f"""
WITH {{U}},
a AS (SELECT *, lag(pts) OVER w AS p, lag(sequence) OVER w AS ps FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY pts, sequence)),
b AS (SELECT *, (p IS NULL OR pts - p > {DAY}) AS fresh FROM a),
c AS (SELECT *, last_value(CASE WHEN fresh THEN pts END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING) AS s FROM b),
d AS (SELECT *, unnest(range(CASE WHEN fresh THEN 0 ELSE (p - s) // {HOUR} + 1 END, (pts - s) // {HOUR} + 1)) AS k FROM c),
r AS (SELECT stream_id, s + k * {HOUR} AS pts,
        CASE WHEN NOT fresh AND (s + k * {HOUR}) - p <= pts - (s + k * {HOUR}) THEN ps ELSE sequence END AS source_sequence FROM d)
"""


@query(_RESAMPLE + "SELECT * FROM r")
def resample_constant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.resample_constant_rate(units(spark, sf_dir), HOUR, DAY)


@query(_RESAMPLE + """, n AS (SELECT stream_id, source_sequence, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT stream_id, sum(n)::BIGINT AS ticks_out, sum(n - 1)::BIGINT AS repeats, count(*) AS shown FROM n GROUP BY stream_id),
i AS (SELECT stream_id, count(*) AS records_in FROM u GROUP BY stream_id)
SELECT stream_id, records_in, ticks_out, repeats, records_in - shown AS skipped FROM i JOIN g USING (stream_id)""")
def resample_dup_drop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.resample_stats(units(spark, sf_dir), HOUR, DAY)


@query(f"""WITH {{U}},
a AS (SELECT *, lag(pts) OVER w AS p, lag(sequence) OVER w AS ps FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY pts, sequence)),
b AS (SELECT *, (p IS NULL OR pts - p > {DAY}) AS fresh FROM a),
c AS (SELECT *, last_value(CASE WHEN fresh THEN pts END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING) AS s FROM b),
n AS (SELECT *, unnest(range(0, (pts - s) * 7 // {7 * HOUR + 3} + 2)) AS k FROM c),
t AS (SELECT *, s + ((2 * k * {7 * HOUR + 3} + 7) // 14) AS x FROM n)
SELECT stream_id, x AS pts, CASE WHEN NOT fresh AND x - p <= pts - x THEN ps ELSE sequence END AS source_sequence FROM t WHERE x <= pts AND (fresh OR x > p)""")
def resample_rational_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.resample_rational_rate(units(spark, sf_dir), 7 * HOUR + 3, 7, DAY)


def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with pts out of order, dts around it, and durations, some of them missing."""
    shaken = F.col("pts") - (F.col("sequence") * 7919) % 40_000_000_000
    rows = units(spark, sf_dir).withColumn("pts", shaken)
    rows = rows.withColumn("dts", F.when(F.col("sequence") % 11 != 0, F.col("pts") + (F.col("sequence") * 31) % 50_000 - 25_000))
    return rows.withColumn("duration", F.when(F.col("sequence") % 7 != 0, (F.col("sequence") * 17) % 40_000)).withColumn("pts", F.when(F.col("sequence") % 13 != 0, F.col("pts")).when(F.col("dts").isNull(), F.col("pts")))


_J = """{U}, j0 AS (SELECT * EXCLUDE (pts), pts - (sequence * 7919) % 40000000000 AS q FROM u),
j1 AS (SELECT *, CASE WHEN sequence % 11 <> 0 THEN q + (sequence * 31) % 50000 - 25000 END AS dts, CASE WHEN sequence % 7 <> 0 THEN (sequence * 17) % 40000 END AS duration FROM j0),
j AS (SELECT * EXCLUDE (q), CASE WHEN sequence % 13 <> 0 OR dts IS NULL THEN q END AS pts FROM j1)"""


@query(f"""WITH {_J}, a AS (SELECT *, least(coalesce(pts, dts), coalesce(dts, pts)) AS m, greatest(coalesce(pts, dts), coalesce(dts, pts)) AS x, greatest(coalesce(duration, 1), 1) AS d FROM j),
b AS (SELECT *, sum(x - m + d) OVER w AS s FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, s + max(x + d - s) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS n FROM b),
e AS (SELECT *, greatest(0, coalesce(lag(n) OVER (PARTITION BY stream_id ORDER BY sequence) - m, 0))::BIGINT AS shift FROM c)
SELECT stream_id, sequence, pts + shift AS pts, dts + shift AS dts, shift FROM e""")
def shift_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.shift_monotonic(jitter(spark, sf_dir)).select("stream_id", "sequence", "pts", "dts", "shift")


@query(f"""WITH {{U}}, a AS (SELECT *, pts // {HOUR} AS r, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) - 1 AS i FROM u)
SELECT stream_id, sequence, (i + max(r - i) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING))::BIGINT AS out_pts FROM a""")
def strictly_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("pts", F.expr(f"pts div {HOUR}"))
    return timestamps.strictly_increasing(rows).select("stream_id", "sequence", "out_pts")


@query(f"""WITH {{U}}, a AS (SELECT *, pts // {HOUR} AS r, greatest(bytes, 0) % 5 AS w FROM u),
b AS (SELECT *, sum(w) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) - w AS i FROM a)
SELECT stream_id, sequence, (i + max(r - i) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING))::BIGINT AS out_pts FROM b""")
def audio_pts_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("pts", F.expr(f"pts div {HOUR}"))
    return timestamps.strictly_increasing(rows, F.greatest(F.col("bytes"), F.lit(0)) % 5).select("stream_id", "sequence", "out_pts")


@query("""WITH {U}, a AS (SELECT *, CASE WHEN sequence % 5 <> 0 THEN pts END AS q, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS i FROM u),
b AS (SELECT *, CASE WHEN q IS NULL AND i = 1 THEN 0 ELSE q END AS k FROM a),
c AS (SELECT *, sum((k IS NULL)::BIGINT) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS n FROM b)
SELECT stream_id, sequence, coalesce(k, (40000 * n + max(k - 40000 * n) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)))::BIGINT AS out_pts FROM c""")
def synthesize_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("pts", F.when(F.col("sequence") % 5 != 0, F.col("pts")))
    return timestamps.synthesize_missing(rows, 40_000).select("stream_id", "sequence", "out_pts")


@query(f"""WITH {{U}}, a AS (SELECT sequence, ((pts - {ORIGIN + 10 * DAY}) * 1000)::HUGEINT * 44100 AS s FROM u)
SELECT sequence, (CASE WHEN s < 0 THEN -((abs(s) + 500000000) // 1000000000) ELSE (s + 500000000) // 1000000000 END)::BIGINT AS nearest_sample,
       (CASE WHEN s > 0 THEN (s + 999999999) // 1000000000 ELSE -(abs(s) // 1000000000) END)::BIGINT AS first_sample FROM a""")
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("ns", (F.col("pts") - (ORIGIN + 10 * DAY)) * 1000)
    return timestamps.sample_grid(rows, "ns", 44_100).select("sequence", "nearest_sample", "first_sample")


@query("""WITH {U}, a AS (SELECT *, (pts // 1000) % 4294967296 AS counter FROM u),
b AS (SELECT *, ((counter - lag(counter) OVER (PARTITION BY stream_id ORDER BY sequence)) % 4294967296 + 4294967296) % 4294967296 AS step FROM a)
SELECT stream_id, sequence, CASE WHEN step IS NULL THEN 'first' WHEN 2 * step < 4294967296 THEN 'forward' WHEN 2 * step = 4294967296 THEN 'ambiguous' ELSE 'backward' END AS status,
  (first_value(counter) OVER w + coalesce(sum(step) OVER w, 0))::BIGINT AS unwrapped FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)""")
def unwrap_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("counter", F.expr("(pts div 1000) % 4294967296"))
    return timestamps.unwrap_counter(rows, 1 << 32).select("stream_id", "sequence", "status", "unwrapped")


@query(f"""WITH {{U}}, a AS (SELECT *, lag(pts) OVER w AS p FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY sequence)),
b AS (SELECT stream_id, sequence, pts, CASE WHEN pts < p THEN 'regression' WHEN pts - (p + 1000000) > {HOUR} THEN 'gap' END AS reason FROM a)
SELECT * FROM b WHERE reason IS NOT NULL""")
def continuity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.continuity_breaks(units(spark, sf_dir).withColumn("duration", F.lit(1_000_000)), HOUR)


@query("""WITH {U}, a AS (SELECT *, greatest(bytes, 0) AS n FROM u),
b AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS e FROM a)
SELECT stream_id, sequence, greatest(0, 100000 - (e - n))::BIGINT AS begin, (n - greatest(0, 100000 - (e - n)))::BIGINT AS kept_samples FROM b WHERE e > 100000""")
def trim_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.trim_leading(units(spark, sf_dir).withColumn("samples", F.greatest(F.col("bytes"), F.lit(0))), 100_000)


@query("""WITH {U}, a AS (SELECT *, greatest(bytes, 0) AS n FROM u),
b AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)::BIGINT AS e, sum(n) OVER (PARTITION BY stream_id)::BIGINT AS t FROM a),
c AS (SELECT *, unnest(range((e - n) // 1024, (e - 1) // 1024 + 1)) AS frame FROM b WHERE n > 0)
SELECT stream_id, frame, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM c WHERE (frame + 1) * 1024 <= t GROUP BY ALL""")
def rechunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.rechunk(units(spark, sf_dir).withColumn("samples", F.greatest(F.col("bytes"), F.lit(0))), 1024)


@query(f"""WITH {{U}}, a AS (SELECT *, pts + (sequence % 40) * {HOUR} AS e FROM u),
b AS (SELECT *, max(e) OVER (PARTITION BY stream_id ORDER BY pts, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM a),
c AS (SELECT *, sum((r IS NULL OR pts > r + {HOUR})::INT) OVER (PARTITION BY stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT stream_id, sequence, max(e) OVER (PARTITION BY stream_id, i) AS covered_until FROM c""")
def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("duration", (F.col("sequence") % 40) * HOUR)
    return timestamps.coverage(rows, HOUR).select("stream_id", "sequence", "covered_until")


@query("""WITH {U}, f AS (SELECT *, unnest(range((bytes - 1) // 1400 + 1)) AS fragment FROM u WHERE bytes > 0)
SELECT stream_id, sequence, fragment, least(1400, bytes - fragment * 1400)::BIGINT AS payload_bytes, (fragment + 1) * 1400 >= bytes AS marker,
       row_number() OVER (PARTITION BY stream_id ORDER BY sequence, fragment) - 1 AS datagram FROM f""")
def datagram_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.frames_to_packets(units(spark, sf_dir), 1400)


@query("""WITH {U}, b AS (SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY sequence) - 1) // 7 AS batch FROM u)
SELECT stream_id, batch, count(*) AS records, sum(bytes)::BIGINT AS batch_bytes, min(sequence) AS first_sequence FROM b GROUP BY ALL""")
def packet_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.packet_batches(units(spark, sf_dir), 7)


# --- routing ------------------------------------------------------------------------------------------------------------

ROUTES = [("video", "purchase", None), ("audio", "click", 1), ("data", "view", 2), ("all", "Any", None), ("odd", "Unknown", 1)]
STRICT = ROUTES[:3]


def _values(rows: list[tuple]) -> str:
    said = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(said, row)) + ")" for row in rows)


def _routes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "route string, route_kind string, route_index long")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).withColumn("stream_index", F.when(F.col("sequence") % 10 != 0, F.col("sequence") % 3))


_I = "{U}, i AS (SELECT *, CASE WHEN sequence % 10 <> 0 THEN sequence % 3 END AS stream_index FROM u)"
_ON = "(r.kind IN ('Any', 'Unknown') OR r.kind = i.stream_kind) AND (i.stream_index IS NULL OR r.idx IS NULL OR r.idx = i.stream_index)"


@query(f"WITH {_I}, r(route, kind, idx) AS ({_values(ROUTES)}) SELECT route, stream_id, sequence FROM i JOIN r ON {_ON}")
def route_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(_indexed(spark, sf_dir), _routes(spark, ROUTES)).select("route", "stream_id", "sequence")


@query(f"WITH {_I}, r(route, kind, idx) AS ({_values(STRICT)}) SELECT stream_id, stream_kind, sequence FROM i WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_ON})")
def route_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.unmatched(_indexed(spark, sf_dir), _routes(spark, STRICT)).select("stream_id", "stream_kind", "sequence")


@query("WITH {U} SELECT o.output, u.stream_id, u.sequence FROM u, (VALUES ('record'), ('preview'), ('relay')) o(output)")
def fanout_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.fan_out(units(spark, sf_dir), ["record", "preview", "relay"]).select("output", "stream_id", "sequence")


@query("WITH {U} SELECT stream_kind, stream_id, sequence FROM u WHERE stream_kind IN ('purchase', 'click', 'view')")
def merge_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir)
    return routing.merge([rows.where(F.col("stream_kind") == k) for k in ("purchase", "click", "view")]).select("stream_kind", "stream_id", "sequence")


@query("""WITH {U}, g AS (SELECT *, bool_or(key_frame) OVER (PARTITION BY stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING) AS o FROM u)
SELECT stream_id, sequence, pts FROM g WHERE o""")
def start_gate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.start_gate(units(spark, sf_dir)).select("stream_id", "sequence", "pts")


SUBSCRIPTIONS = [("a", ORIGIN + 3 * DAY, ORIGIN + 20 * DAY), ("b", ORIGIN + 10 * DAY, ORIGIN + 40 * DAY), ("c", ORIGIN, ORIGIN + 5 * DAY)]


@query(f"""WITH {{U}}, s(subscriber, b, e) AS ({_values(SUBSCRIPTIONS)}),
g AS (SELECT s.subscriber, u.*, bool_or(key_frame) OVER (PARTITION BY subscriber, stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING) AS o FROM u JOIN s ON pts >= b AND pts < e)
SELECT subscriber, stream_id, sequence FROM g WHERE o""")
def late_subscription_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscriptions = spark.createDataFrame(SUBSCRIPTIONS, "subscriber string, begins long, ends long")
    return routing.late_subscription(units(spark, sf_dir), subscriptions, DAY).select("subscriber", "stream_id", "sequence")


#: What lies in the last days of the events is in no epoch.
EPOCHS = [(k + 1, ORIGIN + k * WEEK, ORIGIN + (k + 1) * WEEK) for k in range(4)]


@query(f"""WITH {{U}}, p(g, b, e) AS ({_values(EPOCHS)}), x AS (SELECT *, 1 + sequence % 5 AS generation FROM u)
SELECT stream_id, sequence, generation, g::BIGINT AS epoch_generation, CASE WHEN generation < g THEN 'drop' WHEN generation = g THEN 'pass' ELSE 'withhold' END AS verdict
FROM x LEFT JOIN p ON pts >= b AND pts < e""")
def epoch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = spark.createDataFrame(EPOCHS, "epoch_generation long, begins long, ends long")
    rows = units(spark, sf_dir).withColumn("generation", 1 + F.col("sequence") % 5)
    return routing.epoch_gate(rows, epochs, DAY).select("stream_id", "sequence", "generation", "epoch_generation", "verdict")


@query("WITH {U}, d AS (SELECT DISTINCT stream_id, stream_kind, key_frame FROM u) SELECT stream_id, count(*) AS formats FROM d GROUP BY stream_id HAVING count(*) > 1")
def format_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.format_contract(units(spark, sf_dir), ["stream_kind", "key_frame"])


# --- clocks -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {{U}}, s AS (SELECT stream_id, pts AS rp, sequence AS rs, pts + 500 AS anchor FROM u WHERE stream_kind = 'signup'),
p AS (SELECT * FROM u WHERE stream_kind <> 'signup'),
j AS (SELECT p.stream_id, p.sequence, p.pts, s.rs AS report_sequence, s.rp, s.anchor FROM p ASOF LEFT JOIN s ON p.stream_id = s.stream_id AND p.pts >= s.rp)
SELECT stream_id, sequence, pts, report_sequence, CASE WHEN rp IS NULL THEN 'acquiring' WHEN pts - rp <= {6 * HOUR} THEN 'locked' WHEN pts - rp <= {3 * DAY} THEN 'degraded' ELSE 'expired' END AS state,
       CASE WHEN pts - rp <= {3 * DAY} THEN anchor + ((pts - rp) * 90) // 1000 END AS mapped FROM j""")
def asof_clock_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir)
    reports = rows.where("stream_kind = 'signup'").select("stream_id", F.col("pts").alias("report_pts"), F.col("sequence").alias("report_sequence"), (F.col("pts") + 500).alias("anchor"))
    return clocks.asof_bind(rows.where("stream_kind <> 'signup'"), reports, 6 * HOUR, 3 * DAY, 90, 1000)


@query(f"""WITH {{U}}, v AS (SELECT stream_id, pts AS video_pts, pts + {2 * DAY} AS vu FROM u WHERE key_frame),
a AS (SELECT stream_id, pts AS audio_pts, pts + {4 * HOUR} AS e FROM u WHERE stream_kind = 'click'),
j AS (SELECT *, greatest(video_pts, audio_pts) AS start FROM v JOIN a USING (stream_id) WHERE abs(audio_pts - video_pts) <= {HOUR})
SELECT stream_id, video_pts, audio_pts, start FROM j WHERE e > start AND vu >= start + {HOUR} AND e >= start + {HOUR} AND start - audio_pts <= {HOUR // 2}
QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY video_pts, audio_pts) = 1""")
def common_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir)
    video = rows.where("key_frame").withColumn("duration", F.lit(2 * DAY)).withColumn("covered_until", F.col("pts") + 2 * DAY)
    audio = rows.where("stream_kind = 'click'").withColumn("duration", F.lit(4 * HOUR)).withColumn("covered_until", F.col("pts") + 4 * HOUR)
    return clocks.common_window(video, audio, HOUR, HOUR, HOUR // 2)


_SIDES = ("click", "view")


@query(f"""WITH {{U}}, r AS (SELECT stream_id AS group_id, stream_kind AS side, pts AS t, sequence, 'cam' || (sequence // 1000) AS name, sequence % 90 AS shift FROM u WHERE stream_kind IN ('click', 'view')),
l AS (SELECT *, last_value(CASE WHEN side = 'click' THEN {{'t': t, 'n': name, 's': shift}} END IGNORE NULLS) OVER w AS a,
                last_value(CASE WHEN side = 'view' THEN {{'t': t, 'n': name, 's': shift}} END IGNORE NULLS) OVER w AS b
      FROM r WINDOW w AS (PARTITION BY group_id ORDER BY t, sequence ROWS UNBOUNDED PRECEDING))
SELECT group_id, sequence, CASE WHEN a IS NULL OR b IS NULL THEN 'acquiring' WHEN a.n <> b.n OR abs(a.s - b.s) > 50 OR t - least(a.t, b.t) > {2 * DAY} THEN 'reacquire'
  WHEN t - least(a.t, b.t) > {6 * HOUR} THEN 'degraded' ELSE 'locked' END AS state FROM l""")
def group_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).where(F.col("stream_kind").isin(*_SIDES))
    reports = rows.select(F.col("stream_id").alias("group_id"), F.col("stream_kind").alias("side"), F.col("pts").alias("at"), "sequence", F.concat(F.lit("cam"), F.expr("sequence div 1000").cast("string")).alias("name"), (F.col("sequence") % 90).alias("shift"))
    return clocks.group_lock(reports, _SIDES, 6 * HOUR, 2 * DAY, 50)


@query(f"""WITH {{U}}, f AS (SELECT stream_id, min(pts) FILTER (stream_kind = 'click') AS a, min(pts) FILTER (stream_kind = 'view') AS b FROM u GROUP BY stream_id)
SELECT stream_id, least(a, b) AS epoch, abs(a - b) > {DAY} AS too_far FROM f WHERE a IS NOT NULL AND b IS NOT NULL""")
def common_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.common_epoch(units(spark, sf_dir), _SIDES, DAY)


# --- scheduling ---------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {{U}}, x AS (SELECT stream_id, sequence, pts // {6 * HOUR} AS dispatch, 1 + pts // {20 * DAY} - {ORIGIN // (20 * DAY)} AS generation, key_frame::INT AS side FROM u),
s AS (SELECT *, row_number() OVER (PARTITION BY stream_id, generation, side ORDER BY dispatch, sequence) AS k FROM x),
m(stream_id, generation, i, j, side, sequence, n) AS (SELECT DISTINCT stream_id, generation, 0::BIGINT, 0::BIGINT, 1, NULL::BIGINT, 0::BIGINT FROM x
UNION ALL SELECT stream_id, generation, i + (pick = 0)::BIGINT, j + (pick = 1)::BIGINT, pick, CASE WHEN pick = 0 THEN a ELSE v END, n + 1 FROM (
  SELECT m.stream_id, m.generation, i, j, n, a.sequence AS a, v.sequence AS v,
    CASE WHEN a.sequence IS NULL THEN 1 WHEN v.sequence IS NULL THEN 0 WHEN a.dispatch < v.dispatch THEN 0 WHEN v.dispatch < a.dispatch THEN 1 ELSE 1 - m.side END AS pick
  FROM m LEFT JOIN s a ON a.stream_id = m.stream_id AND a.generation = m.generation AND a.side = 0 AND a.k = m.i + 1
  LEFT JOIN s v ON v.stream_id = m.stream_id AND v.generation = m.generation AND v.side = 1 AND v.k = m.j + 1 WHERE a.sequence IS NOT NULL OR v.sequence IS NOT NULL))
SELECT stream_id, sequence, side, row_number() OVER (PARTITION BY stream_id ORDER BY generation, n) AS position FROM m WHERE n > 0""")
def ordered_merge_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", "sequence", F.expr(f"pts div {6 * HOUR}").alias("dispatch"), F.expr(f"1 + pts div {20 * DAY} - {ORIGIN // (20 * DAY)}").alias("generation"), F.col("key_frame").cast("int").alias("side"))
    return scheduling.ordered_merge(rows).select("stream_id", "sequence", "side", F.col("position").cast("long").alias("position"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase errors from -300 to 60 ms and horizons from -60 to 40 ms, by sequence."""
    rows = units(spark, sf_dir).withColumn("target", F.col("pts")).withColumn("now", F.col("pts") + 300_000 - (F.col("sequence") * 7919) % 360_001)
    return rows.withColumn("dispatch", F.col("pts")).withColumn("horizon", F.col("pts") + 60_000 - (F.col("sequence") * 104_729) % 100_001)


_DECIDE = """{U}, q AS (SELECT *, -(300000 - (sequence * 7919) % 360001) AS e, -(60000 - (sequence * 104729) % 100001) AS h FROM u),
d AS (SELECT *, CASE WHEN e <= -250000 THEN 'Reacquire' WHEN h > 20000 THEN 'Hold' WHEN e >= -40000 THEN 'Display' WHEN e > -80000 THEN 'DisplayLate' WHEN key_frame THEN 'DisplayPreservedKeyFrame' ELSE 'Drop' END AS decision FROM q)"""


@query(f"WITH {_DECIDE} SELECT stream_id, sequence, decision FROM d")
def sync_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.sync_decision(_timed(spark, sf_dir)).select("stream_id", "sequence", "decision")


@query(f"""WITH {_DECIDE}, f AS (SELECT *, decision IN ('DisplayLate', 'DisplayPreservedKeyFrame', 'Drop') AS rec FROM d),
r AS (SELECT *, sum((NOT rec AND decision <> 'Hold')::INT) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS run FROM f),
p AS (SELECT *, sum(rec::INT) OVER (PARTITION BY stream_id, run ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT stream_id, sequence, CASE WHEN rec AND n % 6 = 0 THEN 'Reacquire' ELSE decision END AS final_decision FROM p""")
def sync_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = scheduling.sync_decision(_timed(spark, sf_dir))
    return scheduling.sync_budget(decided).select("stream_id", "sequence", "final_decision")


@query("""WITH {U}, a AS (SELECT *, (bytes * 1000000 + 9) // 10 AS d FROM u WHERE bytes > 0),
s AS (SELECT *, sum(d) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS t FROM a),
e AS (SELECT *, t + max(pts + d - t) OVER (PARTITION BY stream_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT stream_id, sequence, (n - d)::BIGINT AS departs, n::BIGINT AS ends FROM e""")
def leaky_bucket_fixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.leaky_bucket(units(spark, sf_dir).where("bytes > 0"), 10).select("stream_id", "sequence", "departs", "ends")


@query(f"""WITH {{U}}, a AS (SELECT *, pts - {ORIGIN} + 77000 AS m FROM u)
SELECT stream_id, sequence, m AS on_master, m - 2500 AS emit_at, coalesce(m > lag(m) OVER (PARTITION BY stream_id ORDER BY sequence), true) AS increasing FROM a""")
def affine_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.affine_schedule(units(spark, sf_dir), ORIGIN, 77_000, 2_500).select("stream_id", "sequence", "on_master", "emit_at", "increasing")


# --- canonical intervals ------------------------------------------------------------------------------------------------


@query("""WITH {U}, m AS (SELECT stream_id, sequence, CASE sequence % 3 WHEN 0 THEN 'samples' WHEN 1 THEN 'mapped' ELSE 'ticks' END AS mode, sequence % 1500 AS n FROM u),
v AS (SELECT *, CASE mode WHEN 'samples' THEN (n * 1000000000 + 22050) // 44100 WHEN 'mapped' THEN n * 1000 ELSE (n * 1001 * 1000000000 + 15000) // 30000 END AS d FROM m)
SELECT stream_id, sequence, CASE WHEN d > 0 THEN d END AS duration_ns, CASE WHEN d > 0 THEN NULL ELSE 'no_duration' END AS error FROM v""")
def canonical_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sequence") % 1500
    modes = F.element_at(F.array(*[F.lit(x) for x in ("samples", "mapped", "ticks")]), (F.col("sequence") % 3 + 1).cast("int"))
    rows = units(spark, sf_dir).select("stream_id", "sequence", modes.alias("mode"), n.alias("samples"), (n * 1000).alias("mapped_ns"), n.alias("ticks"), F.lit(1_001).alias("tb_num"), F.lit(30_000).alias("tb_den"))
    return canonical.durations(rows, 44_100).select("stream_id", "sequence", "duration_ns", "error")


@query("WITH {U} SELECT stream_id, sequence // 2000 AS generation, sequence, row_number() OVER (PARTITION BY stream_id, sequence // 2000 ORDER BY sequence) - 1 AS number FROM u")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.numbered(units(spark, sf_dir).withColumn("generation", F.expr("sequence div 2000"))).select("stream_id", "generation", "sequence", "number")


@query(f"""WITH {{U}}, e AS (SELECT stream_id, min(pts) + {DAY} AS b FROM u GROUP BY stream_id)
SELECT u.stream_id, u.sequence, u.pts - e.b + 5000 AS on_master FROM u JOIN e ON e.stream_id = u.stream_id WHERE u.pts >= e.b""")
def epoch_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("generation", F.lit(1))
    epochs = rows.groupBy("stream_id", "generation").agg((F.min("pts") + DAY).alias("source_start")).withColumn("master_release", F.lit(5_000))
    return canonical.bind_epoch(rows, epochs).select("stream_id", "sequence", "on_master")


@query(f"""WITH {{U}} SELECT stream_id, pts // {DAY} AS stretch, row_number() OVER (PARTITION BY stream_id, pts // {DAY} ORDER BY pts, sequence) - 1 AS place, pts, sequence, key_frame FROM u""")
def release_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unnested(canonical.release(units(spark, sf_dir), DAY)).withColumn("place", F.col("place").cast("long"))


@query("""WITH {U}, i AS (SELECT stream_id, sequence, bytes AS b, bytes + sequence % 7 AS e FROM u), l AS (SELECT *, lag(e) OVER (PARTITION BY stream_id ORDER BY sequence) AS expected FROM i)
SELECT stream_id, sequence, b AS begin, expected FROM l WHERE expected <> b""")
def interval_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", "sequence", F.col("bytes").alias("begin"), (F.col("bytes") + F.col("sequence") % 7).alias("end"))
    return canonical.interval_breaks(rows)


@query("""WITH {U}, s AS (SELECT stream_id, sequence, (sequence // 300) % 7 AS generation, ['locked', 'degraded', 'acquiring', 'expired'][(sequence % 4 + 1)::INT] AS state FROM u)
SELECT stream_id, sequence, generation, CASE WHEN state IN ('locked', 'degraded') THEN 'ready' WHEN state = 'acquiring' THEN 'waiting' ELSE 'reacquire' END AS readiness,
       coalesce(generation < max(generation) OVER (PARTITION BY stream_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS goes_back FROM s""")
def clock_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*[F.lit(x) for x in ("locked", "degraded", "acquiring", "expired")]), (F.col("sequence") % 4 + 1).cast("int"))
    return canonical.clock_states(units(spark, sf_dir).select("stream_id", "sequence", F.expr("(sequence div 300) % 7").alias("generation"), states.alias("state")))


@query(f"""WITH {{U}}, a AS (SELECT sequence, pts, (pts - {ORIGIN}) * 9 // 100 + (sequence * 7919) % 900001 - 450000 AS t, (pts - {ORIGIN}) * 9 // 100 AS anchor FROM u),
d AS (SELECT *, ((t - anchor) % 8589934592 + 8589934592) % 8589934592 AS ahead FROM a), e AS (SELECT *, CASE WHEN 2 * ahead < 8589934592 THEN ahead ELSE ahead - 8589934592 END AS x FROM d)
SELECT sequence, (pts + sign(x) * ((abs(x) * 1000000 + 45000) // 90000))::BIGINT AS source_us FROM e""")
def source_clock_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.expr(f"((pts - {ORIGIN}) * 9) div 100")
    rows = units(spark, sf_dir).select("sequence", F.pmod(anchor + (F.col("sequence") * 7919) % 900_001 - 450_000, F.lit(1 << 33)).alias("counter"), anchor.alias("anchor_ticks"), F.col("pts").alias("anchor_us"))
    return canonical.nearest_epoch(rows, 1 << 33, 90_000).select("sequence", "source_us")


@query("""WITH {U} SELECT sequence, CASE WHEN sequence % 5 = 0 THEN 'drop_late_frames' WHEN sequence % 4 < 2 THEN 'reduce' WHEN sequence % 4 > 2 THEN 'increase' ELSE 'keep' END AS action FROM u""")
def qos_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("sequence", F.when(F.col("sequence") % 5 == 0, "high").otherwise("healthy").alias("pressure"), F.lit(2).cast("long").alias("before"), (F.col("sequence") % 4).alias("after"))
    return canonical.qos_action(rows).select("sequence", "action")


# --- ledgers ------------------------------------------------------------------------------------------------------------


def _credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reserve, their lines release, per customer."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    count = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = orders.join(count, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("ledger_id"), micros("o_orderdate").alias("at"), (F.col("o_orderkey") * 10).alias("sequence"), (F.col("n") * 1000).alias("delta_bytes"), F.col("n").alias("delta_objects"))
    gave = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("ledger_id"), micros("l_shipdate").alias("at"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), F.lit(-1000).cast("long").alias("delta_bytes"), F.lit(-1).cast("long").alias("delta_objects"))
    return took.unionByName(gave)


_CREDIT = """n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_custkey AS ledger_id, epoch_us(o_orderdate) AS t, o_orderkey * 10 AS sequence, n * 1000 AS b, n AS o FROM orders JOIN n ON o_orderkey = l_orderkey
      UNION ALL SELECT o_custkey, epoch_us(l_shipdate), o_orderkey * 10 + l_linenumber, -1000, -1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"""WITH {_CREDIT}, w AS (SELECT *, sum(b) OVER x AS rb, sum(o) OVER x AS ro FROM c WINDOW x AS (PARTITION BY ledger_id ORDER BY t, b, sequence ROWS UNBOUNDED PRECEDING))
SELECT ledger_id, max(rb)::BIGINT AS high_bytes, max(ro)::BIGINT AS high_objects, sum(b)::BIGINT AS left_bytes FROM w GROUP BY ledger_id""")
def credit_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.high_water(_credits(spark, sf_dir))


@query()
def credit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _credits(spark, sf_dir).withColumn("reservation", F.expr("sequence div 10"))
    return stateful.credit_admission(changes, 6000, 6).select("ledger_id", "sequence", "verdict")


@query("""WITH v AS (SELECT o_custkey AS ledger_id, CASE o_orderstatus WHEN 'O' THEN 'granted' WHEN 'F' THEN 'release' ELSE 'pressure' END AS verdict, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_orderkey AS b FROM orders)
SELECT ledger_id, count(*) FILTER (verdict = 'granted') AS reservations, count(*) FILTER (verdict = 'release') AS releases, count(*) FILTER (verdict = 'pressure') AS pressure,
  sum(CASE WHEN verdict = 'granted' THEN b ELSE 0 END)::BIGINT AS reserved_bytes, sum(CASE WHEN verdict = 'release' THEN -b ELSE 0 END)::BIGINT AS released_bytes FROM v GROUP BY ledger_id""")
def reservation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    verdict = F.when(status == "O", "granted").when(status == "F", "release").otherwise("pressure")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ledger_id"), verdict.alias("verdict"), (F.when(status == "F", -1).otherwise(1) * F.col("o_orderkey")).alias("delta_bytes"), F.lit(1).alias("delta_objects"))
    return ledgers.reservation_counts(rows)


@query("""WITH b AS (SELECT l_suppkey AS output, l_partkey AS bytes, l_linenumber AS packets, (l_returnflag = 'R')::INT AS errors, epoch_us(l_shipdate) AS t, 0 AS branch FROM lineitem
UNION ALL SELECT ps, o_orderkey, 1, (o_orderstatus = 'P')::INT, epoch_us(o_orderdate), 1 FROM (SELECT *, 1 + o_orderkey % 97 AS ps FROM orders))
SELECT output, sum(bytes)::BIGINT AS bytes, sum(packets)::BIGINT AS packets, sum(errors)::BIGINT AS errors, count(DISTINCT branch) AS branches, max(t) AS last_at FROM b GROUP BY output""")
def output_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at")
    first = lines.select(F.col("l_suppkey").alias("output"), F.col("l_partkey").alias("bytes"), F.col("l_linenumber").cast("long").alias("packets"), (F.col("l_returnflag") == "R").cast("long").alias("errors"), micros("l_shipdate"))
    second = orders.select((1 + F.col("o_orderkey") % 97).alias("output"), F.col("o_orderkey").alias("bytes"), F.lit(1).cast("long").alias("packets"), (F.col("o_orderstatus") == "P").cast("long").alias("errors"), micros("o_orderdate"))
    return ledgers.roll_up([first, second])


@query("""WITH {U}, k AS (SELECT stream_id, abs(300000 - (sequence * 7919) % 360001)::DOUBLE AS s FROM u), p AS (SELECT stream_id, quantile_cont(s, 0.95) AS p95, quantile_cont(s, 0.99) AS p99 FROM k GROUP BY stream_id)
SELECT stream_id, round(p95, 3) AS p95, round(p99, 3) AS p99, p95 <= 282000 AND p99 <= 298000 AS within FROM p""")
def skew_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", (300_000 - (F.col("sequence") * 7919) % 360_001).alias("skew"))
    return ledgers.skew_percentiles(rows, 282_000, 298_000).withColumns({c: F.round(c, 3) for c in ("p95", "p99")})


@query("""WITH {U} SELECT stream_id, sequence, stream_kind FROM u WHERE stream_kind IN ('view', 'purchase')""")
def stream_set_video_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = F.when(F.col("stream_kind").isin("view", "purchase"), "video").when(F.col("stream_kind") == "click", "audio").otherwise("data")
    return routing.stream_set(units(spark, sf_dir), "VideoOnly", media).select("stream_id", "sequence", "stream_kind")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 48 THEN 'full' WHEN l_quantity >= 40 THEN 'critical' WHEN l_quantity >= 24 THEN 'high' ELSE 'healthy' END AS pressure FROM lineitem""")
def backpressure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"), F.lit(48).alias("capacity"), F.lit(40).alias("critical"), F.lit(24).alias("high"))
    return ledgers.backpressure(rows).select("l_orderkey", "l_linenumber", "pressure")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select(F.concat_ws("-", "stream_kind", (F.col("stream_id") % 10).cast("string")).alias("node"), F.col("bytes").alias("elapsed"), (F.col("sequence") % 17 != 0).alias("ok"))


_CALLS = "{U}, p AS (SELECT stream_kind || '-' || (stream_id % 10) AS node, count(*) AS calls, count(*) FILTER (sequence % 17 = 0) AS errors, sum(bytes)::BIGINT AS total, max(bytes) AS largest FROM u GROUP BY 1)"


@query(f"WITH {_CALLS} SELECT *, total // calls AS average FROM p")
def node_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.node_profile(_calls(spark, sf_dir))


@query(f"WITH {_CALLS} SELECT node, total // calls AS average FROM p WHERE total // calls >= 5000")
def bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.bottlenecks(_calls(spark, sf_dir), 5000)


@query("""WITH {U}, o AS (SELECT stream_id % 10 AS edge, ['pushed', 'popped', 'dropped', 'failed'][(sequence % 4 + 1)::INT] AS outcome FROM u)
SELECT edge, count(*) FILTER (outcome = 'pushed') AS pushed, count(*) FILTER (outcome = 'popped') AS popped, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'failed') AS failed FROM o GROUP BY edge""")
def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("pushed", "popped", "dropped", "failed")])
    rows = units(spark, sf_dir).select((F.col("stream_id") % 10).alias("edge"), F.element_at(names, (F.col("sequence") % 4 + 1).cast("int")).alias("outcome"))
    return ledgers.queue_counters(rows)


@query("""WITH {U}, l AS (SELECT *, (sequence * 7919) % 1009 AS lateness FROM u)
SELECT stream_id, lateness, sequence FROM l QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY lateness DESC, sequence) = 1""")
def submit_lateness_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.worst_lateness(units(spark, sf_dir).withColumn("lateness", (F.col("sequence") * 7919) % 1009))


@query(f"""WITH {{U}}, x AS (SELECT stream_id, sequence, pts, (sequence * 31) % 97 AS worker, CASE WHEN sequence % 3 = 0 THEN sequence // 50 ELSE 0 END AS output FROM u),
y AS (SELECT *, coalesce(max(output) OVER b, 0) AS po, coalesce(max(worker) OVER b, 0) AS pw FROM x WINDOW b AS (PARTITION BY stream_id ORDER BY pts, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (output > po OR (po = 0 AND worker > pw)) AS progress FROM y)
SELECT stream_id, sequence, progress, pts - coalesce(max(CASE WHEN progress THEN pts END) OVER a, min(pts) OVER a) > {2 * DAY} AS stalled
FROM z WINDOW a AS (PARTITION BY stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING)""")
def progress_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", "sequence", F.col("pts").alias("at"), ((F.col("sequence") * 31) % 97).alias("worker"), F.when(F.col("sequence") % 3 == 0, F.expr("sequence div 50")).otherwise(0).alias("output"))
    return ledgers.progress(rows, 2 * DAY).select("stream_id", "sequence", "progress", "stalled")


@query("""WITH {U} SELECT stream_id AS route_id, stream_kind AS target, pts AS at FROM u
QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY pts DESC, sequence DESC) = 1 AND stream_kind <> 'error'""")
def latest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select(F.col("stream_id").alias("route_id"), F.col("pts").alias("at"), "sequence", (F.col("stream_kind") == "error").alias("deleted"), F.col("stream_kind").alias("target"))
    return ledgers.latest_routes(rows)


# --- planning -----------------------------------------------------------------------------------------------------------

REQUESTS = [
    ("a", "cbr", 6_000_000, None, None), ("b", "cbr", None, None, None), ("c", "cbr", 6_000_000, 1, None), ("d", "vbr", 5_000_000, 1_000_000, 12_000_000),
    ("e", "vbr", 5_000_000, None, 12_000_000), ("f", "vbr", 15_000_000, 1_000_000, 12_000_000), ("g", "crf", None, None, None), ("h", "cbr", -1, None, None), ("i", "cbr", 1_000_001, None, None),
]
_REQ = "request string, mode string, target long, min_rate long, max_rate long"


@query(f"""WITH r(request, mode, target, lo, hi) AS ({_values(REQUESTS)})
SELECT request, CASE WHEN coalesce(target, 1) <= 0 OR coalesce(lo, 1) <= 0 OR coalesce(hi, 1) <= 0 THEN 'rate_not_positive' WHEN mode = 'cbr' AND target IS NULL THEN 'cbr_needs_target'
  WHEN mode = 'cbr' AND (lo IS NOT NULL OR hi IS NOT NULL) THEN 'cbr_forbids_bounds' WHEN mode = 'vbr' AND (lo IS NULL OR target IS NULL OR hi IS NULL) THEN 'vbr_needs_all'
  WHEN mode = 'vbr' AND NOT (lo <= target AND target <= hi) THEN 'vbr_order' END AS error FROM r""")
def rate_control_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.rate_control_errors(spark.createDataFrame(REQUESTS, _REQ)).select("request", "error")


@query(f"""WITH r(request, mode, target, lo, hi) AS ({_values(REQUESTS)})
SELECT request, 15 * target::BIGINT // 16 AS low, (17 * target::BIGINT + 15) // 16 AS high, (CASE WHEN mode = 'cbr' THEN target ELSE hi END::BIGINT * 1001 + 29999) // 30000 AS frame_buffer
FROM r WHERE target > 0""")
def emission_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(REQUESTS, _REQ).where("target > 0").withColumn("frame_num", F.lit(30_000)).withColumn("frame_den", F.lit(1_001))
    return planner.emission_bounds(rows).select("request", "low", "high", "frame_buffer")


@query("""SELECT o_orderkey AS request, greatest(round(o_totalprice)::BIGINT, ((o_orderkey * 37) * 1000000000 + 49999999) // 50000000, (5 * (o_orderkey * 11) + 1) // 2) AS pacing_rate FROM orders""")
def pacing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.round("o_totalprice").cast("long").alias("peak"), (F.col("o_orderkey") * 37).alias("burst"), F.lit(50_000_000).alias("residence_ns"), (F.col("o_orderkey") * 11).alias("sustained"))
    return planner.pacing_rate(rows).select("request", "pacing_rate")


@query("""SELECT l_orderkey AS output, sum(l_partkey)::BIGINT AS sustained, sum(l_partkey * 3)::BIGINT AS peak, count(*) AS packet_rate, sum(l_suppkey)::BIGINT AS burst, sum(l_linenumber)::BIGINT AS atomic_bytes FROM lineitem GROUP BY l_orderkey""")
def traffic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("output"), F.col("l_partkey").alias("sustained"), (F.col("l_partkey") * 3).alias("peak"), F.lit(1).alias("packet_rate"), F.col("l_suppkey").alias("burst"), F.col("l_linenumber").alias("atomic_bytes"))
    return planner.traffic_envelope(rows)


@query("""WITH {U}, r AS (SELECT sequence, CASE WHEN key_frame THEN 1 ELSE sequence % 250 END AS f FROM u), w AS (SELECT sequence, (f * 1001 * 1000000000 + 29999) // 30000 AS wait_ns FROM r)
SELECT sequence, wait_ns, wait_ns + 20000000 < 4000000000 AS fits FROM w""")
def join_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("sequence", F.col("key_frame").alias("new_encoder"), (F.col("sequence") % 250).alias("frames"), F.lit(30_000).alias("frame_num"), F.lit(1_001).alias("frame_den"), F.lit(20_000_000).alias("lead_ns"), F.lit(4_000_000_000).alias("budget_ns"))
    return planner.join_wait(rows).select("sequence", "wait_ns", "fits")


@query("SELECT p_partkey AS edge, p_size::BIGINT AS capacity, (p_size // 2)::BIGINT AS high, (p_size - 1)::BIGINT AS critical, p_size::BIGINT AS full FROM part")
def edge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.edge_policy(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge"), F.col("p_size").cast("long").alias("capacity")))


@query("""SELECT o_orderkey AS branch, CASE WHEN o_orderkey % 13 = 0 THEN 'drop' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus = 'F' THEN 'copy_packet' ELSE 'transcode_frame' END AS mode FROM orders""")
def copy_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("branch"), (k % 13 != 0).alias("enabled"), (k % 2 == 0).alias("copy_allowed"), (k % 3 == 0).alias("resize"), (k % 5 == 0).alias("filter"), F.col("o_orderstatus").alias("source_codec"), F.lit("F").alias("target_codec"))
    return planner.copy_eligible(rows).select("branch", "mode")


@query("""WITH c AS (SELECT o_custkey AS request, 'chain-' || o_orderkey AS label, o_orderkey % 2 = 1 AS d, o_orderkey % 3 = 2 AS f, o_orderkey % 5 >= 3 AS e, o_orderkey % 4 > 1 AS active, o_orderkey % 7 <> 0 AS same, o_orderkey % 9 > 3 AS zero,
  o_orderkey % 11 <> 0 AS av, o_orderkey % 13 <> 0 AS ad, o_orderkey % 40 AS pr FROM orders),
k AS (SELECT *, CASE WHEN d AND e AND (f OR NOT active) THEN CASE WHEN same AND zero THEN 1000 WHEN same THEN 900 ELSE 800 END ELSE 650 END AS hw FROM c),
s AS (SELECT *, CASE WHEN av THEN CASE WHEN d THEN hw ELSE 300 END + CASE WHEN e THEN hw ELSE 300 END + CASE WHEN NOT active THEN 0 WHEN f THEN hw ELSE 300 END + pr ELSE 0 END AS score FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, label) AS place FROM s)
SELECT request, label, score, place, coalesce(place = min(CASE WHEN ad AND av THEN place END) OVER (PARTITION BY request), false) AS chosen FROM p""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request"), F.concat(F.lit("chain-"), k.cast("string")).alias("label"), (k % 2 == 1).alias("decoder_hw"), (k % 3 == 2).alias("filter_hw"), (k % 5 >= 3).alias("encoder_hw"), (k % 4 > 1).alias("filter_active"),
        (k % 7 != 0).alias("same_device"), (k % 9 > 3).alias("zero_copy"), (k % 11 != 0).alias("available"), (k % 13 != 0).alias("admitted"), (k % 40).alias("priority"),
    )
    return planner.rank_candidates(rows).select("request", "label", "score", "place", "chosen")


@query("""WITH r AS (SELECT o_orderkey AS request, ['file', 'url', 'sdp', 'rtp_port', 'ts_udp', 'external_ts', 'external_rtp'][(o_orderkey % 7 + 1)::INT] AS input_type, ['separate', 'muxed'][(o_orderkey % 2 + 1)::INT] AS layout, ['udp', 'rtp'][(o_orderkey % 3 // 2 + 1)::INT] AS transport FROM orders)
SELECT request, input_type <> 'file' AS live, NOT (layout = 'separate' AND transport = 'udp') AS served FROM r""")
def request_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pick = F.col("o_orderkey"), lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("request"), pick(["file", "url", "sdp", "rtp_port", "ts_udp", "external_ts", "external_rtp"], k % 7).alias("input_type"), pick(["separate", "muxed"], k % 2).alias("layout"), pick(["udp", "rtp"], F.expr("o_orderkey % 3 div 2")).alias("transport"))
    return planner.request_class(rows).select("request", "live", "served")


@query("SELECT p_partkey AS request, min(p_partkey) OVER (PARTITION BY p_brand, p_type, nullif(p_size, 1)) AS shared_with FROM part")
def encoding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), "p_brand", "p_type", F.nullif("p_size", F.lit(1)).alias("size"))
    return planner.encoding_groups(rows, ["p_brand", "p_type", "size"])


@query("""SELECT l_suppkey AS resource, sum(l_partkey)::BIGINT AS bytes, sum(l_linenumber)::BIGINT AS items, sum(l_partkey) > 600000 OR sum(l_linenumber) > 1800 AS exceeded FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey""")
def resource_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("resource"), F.col("l_partkey").alias("bytes"), F.col("l_linenumber").alias("items"))
    limits = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("resource"), F.lit(600_000).alias("max_bytes"), F.lit(1_800).alias("max_items"))
    return planner.resource_ledger(items, limits)


NODES = [("in", "Source"), ("demux", "Demux"), ("v", "Decode"), ("a", "Decode"), ("vf", "Filter"), ("ve", "Encode"), ("ae", "Encode"), ("mux", "Mux"), ("out", "Sink"), ("v", "Decode"), ("lone", "Probe")]
EDGES = [
    ("in", "demux", "Packet", "Packet"), ("demux", "v", "Packet", "Packet"), ("demux", "a", "Packet", "Any"), ("v", "vf", "Frame", "Frame"), ("vf", "ve", "Frame", "Frame"), ("a", "ae", "Frame", "Packet"),
    ("ve", "mux", "Packet", "Packet"), ("ae", "mux", "Packet", "Packet"), ("mux", "out", "Bytes", "Bytes"), ("mux", "gone", "Bytes", "Bytes"), ("lone", "lone", "Any", "Any"),
]
_G = f"n(id, kind) AS ({_values(NODES)}), e(s, t, sk, tk) AS ({_values(EDGES)})"


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(NODES, "id string, kind string"), spark.createDataFrame(EDGES, "source string, target string, source_kind string, target_kind string")


@query(f"""WITH {_G} SELECT 'duplicate_id' AS problem, id AS subject FROM n GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'dangling_end', x FROM (SELECT s AS x FROM e UNION ALL SELECT t FROM e) WHERE x NOT IN (SELECT id FROM n)
UNION ALL SELECT 'kind_mismatch', s || '>' || t FROM e WHERE sk <> tk AND sk <> 'Any' AND tk <> 'Any'
UNION ALL SELECT 'self_loop', s FROM e WHERE s = t""")
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.problems(*_graph(spark))


@query(f"""WITH RECURSIVE {_G}, d AS (SELECT DISTINCT id FROM n), w(id, level) AS (SELECT id, 0::BIGINT FROM d WHERE id NOT IN (SELECT t FROM e)
UNION ALL SELECT e.t, w.level + 1 FROM w JOIN e ON e.s = w.id WHERE w.level < 10) SELECT id, max(level) AS level FROM w GROUP BY id""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(*_graph(spark))


@query(f"""WITH {_G}, w(kind, wanted) AS (VALUES ('Decode', 2), ('Mux', 1), ('Clock', 1)) SELECT w.kind, count(n.id) AS n, wanted::BIGINT AS wanted FROM w LEFT JOIN n ON n.kind = w.kind GROUP BY w.kind, wanted HAVING count(n.id) <> wanted""")
def graph_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kind_counts(_graph(spark)[0], {"Decode": 2, "Mux": 1, "Clock": 1})


# --- bytes and text -----------------------------------------------------------------------------------------------------


def _hex(n: str, width: int) -> Column:
    return F.lpad(F.hex(F.expr(n)), width, "0")


def _datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams made from events: 12-byte headers, one or two contributing sources on some, and a payload."""
    rows = units(spark, sf_dir)
    text = F.concat(_hex("128 + sequence % 3", 2), _hex("(case when key_frame then 128 else 0 end) + 96", 2), _hex("sequence % 65536", 4), _hex("pts % 4294967296", 8), _hex("stream_id", 8), F.repeat(F.lit("000000AA"), (F.col("sequence") % 3).cast("int")), F.repeat(F.lit("5A"), (F.col("sequence") % 40).cast("int")))
    return rows.select("sequence", F.unhex(text).alias("data"))


@query("""WITH {U} SELECT sequence, 2::BIGINT AS version, key_frame AS marker, 96::BIGINT AS payload_type, sequence % 65536 AS seq, pts % 4294967296 AS rtp_ts, stream_id AS ssrc, sequence % 3 AS csrc_count, 12 + 4 * (sequence % 3) AS payload_at, sequence % 40 AS payload_bytes FROM u""")
def rtp_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _datagrams(spark, sf_dir).select("sequence", wire.rtp_header(F.col("data")).alias("h")).select("sequence", "h.*")


@query("""WITH {U} SELECT sequence, key_frame AS unit_start, sequence % 8192 AS pid, 3::BIGINT AS adaptation, sequence % 16 AS continuity, sequence % 9 = 0 AS discontinuity, (pts % 8589934592) * 300 + sequence % 300 AS pcr FROM u""")
def ts_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).withColumn("base", F.expr("pts % 8589934592"))
    text = F.concat(F.lit("47"), _hex("(case when key_frame then 16384 else 0 end) + sequence % 8192", 4), _hex("48 + sequence % 16", 2), F.lit("07"), _hex("16 + (case when sequence % 9 = 0 then 128 else 0 end)", 2), _hex("base div 2", 8), _hex("(base % 2) * 32768 + 32256 + sequence % 300", 4), F.lit("FF" * 176))
    return rows.select("sequence", wire.ts_header(F.unhex(text)).alias("h")).select("sequence", "h.*")


@query()
def datagram_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _datagrams(spark, sf_dir).select("sequence", wire.crc32_mpeg2("data").alias("crc"))


def _access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimiter and a slice; every third access unit has a second slice, which is no random-access one."""
    slices = F.concat(F.when(F.col("key_frame"), F.lit("65")).otherwise(F.lit("41")), F.repeat(F.lit("5A"), (F.col("sequence") % 40 + 1).cast("int")))
    text = F.concat(F.lit("0000000109F0"), F.lit("00000001"), slices, F.when(F.col("sequence") % 3 == 0, F.lit("00000141B0")).otherwise(""))
    return units(spark, sf_dir).select("sequence", wire.nal_units(F.unhex(text)).alias("n"))


@query("""WITH {U}, n AS (SELECT sequence, 4::BIGINT AS "at", 2::BIGINT AS bytes, false AS random_access FROM u UNION ALL SELECT sequence, 10, sequence % 40 + 2, key_frame FROM u
UNION ALL SELECT sequence, sequence % 40 + 15, 2, false FROM u WHERE sequence % 3 = 0) SELECT * FROM n""")
def nal_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _access_units(spark, sf_dir).select("sequence", F.explode("n").alias("n"))
    return found.select("sequence", "n.at", "n.bytes", wire.is_random_access(F.col("n.header"), "h264").alias("random_access"))


@query("""WITH {U} SELECT sequence, key_frame AND sequence % 3 <> 0 AS random_access FROM u""")
def nal_access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _access_units(spark, sf_dir).select("sequence", wire.random_access_unit(F.col("n"), "h264").alias("random_access"))


@query("""WITH {U} SELECT sequence, sequence % 6 AS mode, CASE WHEN sequence % 5 <> 0 THEN stream_kind END AS profile FROM u""")
def fmtp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("packetization-mode="), (F.col("sequence") % 6).cast("string"), F.when(F.col("sequence") % 5 != 0, F.concat(F.lit("; Profile = "), F.col("stream_kind"))).otherwise(F.lit(" ;")))
    return units(spark, sf_dir).select("sequence", wire.fmtp(text).alias("m")).select("sequence", F.col("m")["packetization-mode"].cast("long").alias("mode"), F.col("m")["profile"].alias("profile"))


@query("""SELECT s_suppkey AS id, 'v=0' || chr(13) || chr(10) || 'o=- 0 0 IN IP4 10.0.0.' || s_suppkey || chr(13) || chr(10) || 's=' || s_name || chr(13) || chr(10) || 'c=IN IP4 10.0.0.' || s_suppkey || chr(13) || chr(10) || 't=0 0' || chr(13) || chr(10)
 || 'm=video ' || (5000 + 2 * s_suppkey) || ' RTP/AVP 96' || chr(13) || chr(10) || 'a=rtpmap:96 H264/90000' || chr(13) || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'a=fmtp:96 packetization-mode=1' || chr(13) || chr(10) ELSE '' END AS text FROM supplier""")
def sdp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    return rows.select(k.alias("id"), wire.session_description(F.col("s_name"), F.concat(F.lit("10.0.0."), k.cast("string")), 5000 + 2 * k, F.lit(96), F.lit("H264"), F.lit(90_000), F.when(k % 2 == 0, F.lit("packetization-mode=1"))).alias("text"))


@query(f"""WITH {{U}}, a AS (SELECT sequence, ((pts - {ORIGIN + 10 * DAY}) * 1000)::HUGEINT * 90000 AS p, sequence * 7 AS o FROM u)
SELECT sequence, (((CASE WHEN p < 0 THEN -(abs(p) // 1000000000) ELSE p // 1000000000 END + o) % 4294967296 + 4294967296) % 4294967296)::BIGINT AS rtp_ts FROM a""")
def output_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = (F.col("pts") - (ORIGIN + 10 * DAY)) * 1000
    return units(spark, sf_dir).select("sequence", wire.output_timestamp(ns, 90_000, F.col("sequence") * 7).alias("rtp_ts"))


@query(f"""WITH {{U}} SELECT sequence, stream_id AS ssrc, (pts // 1000000 + 2208988800) * 1000000000 + (sequence * 104729 * 1000000000) // 4294967296 AS ntp_ns, pts % 4294967296 AS rtp_ts, 1 + (sequence % 3 <> 0)::BIGINT + (sequence % 2 = 0)::BIGINT AS packets
FROM u WHERE sequence % 7 <> 0""")
def rtcp_sender_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound datagrams of a sender report, mostly a source description and a goodbye; every seventh one is cut short and gives none."""
    report = F.concat(F.lit("80C80006"), _hex("stream_id", 8), _hex("pts div 1000000 + 2208988800", 8), _hex("sequence * 104729", 8), _hex("pts % 4294967296", 8), F.lit("0000000100000002"))
    more = F.concat(F.when(F.col("sequence") % 3 != 0, F.concat(F.lit("81CA0002"), _hex("stream_id", 8), F.lit("01016100"))).otherwise(""), F.when(F.col("sequence") % 2 == 0, F.concat(F.lit("81CB0001"), _hex("stream_id", 8))).otherwise(""))
    text = F.concat(report, more, F.when(F.col("sequence") % 7 == 0, F.lit("81CB0001")).otherwise(""))
    rows = units(spark, sf_dir).select("sequence", wire.rtcp_packets(F.unhex(text)).alias("p")).where("p is not null")
    first = F.element_at("p", 1)
    return rows.select("sequence", first["ssrc"].alias("ssrc"), wire.ntp_nanoseconds(first["ntp_sec"], first["ntp_frac"]).alias("ntp_ns"), first["rtp_ts"].alias("rtp_ts"), F.size("p").cast("long").alias("packets"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://***@') ELSE url END AS url FROM pages""")
def url_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":secret@")))).otherwise(F.col("url")))
    return rows.select("page_id", wire.redacted_url(F.col("url")).alias("url"))


@query("""SELECT p_partkey AS request, ['auto', NULL, 'cbr', 'cvbr', 'crf', 'cvbr', 'vbr', 'auto'][(p_partkey % 8 + 1)::INT] AS mode FROM part""")
def rate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in ("auto", "quality", "cbr", "capped_vbr", "crf", "capped-vbr", "vbr", "")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), wire.rate_control_mode(text).alias("mode"))


@query("""SELECT doc_id, base64(encode(text)) AS base64, n_chars > 0 AS valid FROM documents""")
def text_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", wire.base64_text(data).alias("base64"), wire.valid_utf8(data).alias("valid"))


#: Bytes, and whether they are UTF-8: a lone continuation, a surrogate, an overlong form, a cut sequence, beyond the last code point.
UTF8 = [("", True), ("41", True), ("C3A9", True), ("E282AC", True), ("F09F9880", True), ("80", False), ("EDA080", False), ("C0AF", False), ("E282", False), ("F4908080", False), ("41FF", False)]


@query(f"""WITH {{U}} SELECT sequence, [{', '.join(str(ok).lower() for _, ok in UTF8)}][(sequence % {len(UTF8)} + 1)::INT] AS valid FROM u""")
def utf8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.element_at(F.array(*[F.lit(x) for x, _ in UTF8]), (F.col("sequence") % len(UTF8) + 1).cast("int")))
    return units(spark, sf_dir).select("sequence", wire.valid_utf8(data).alias("valid"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a unit for each event: alone, behind a delimiter in an aggregate, or in three fragments; numbers are left out before some units and inside others, as if packets were lost."""
    rows = units(spark, sf_dir).withColumn("n", F.row_number().over(timestamps._by("sequence")))
    head, body = F.when(F.col("key_frame"), "65").otherwise("41"), F.repeat(F.lit("5A"), (F.col("sequence") % 40 + 3).cast("int"))
    mark = F.when(F.col("key_frame"), "7C").otherwise("5C")
    kind = F.when(F.col("key_frame"), F.lit("5")).otherwise(F.lit("1"))
    parts = F.array(F.concat(mark, F.lit("8"), kind, F.lit("5A")), F.concat(mark, F.lit("0"), kind, F.lit("5A")), F.concat(mark, F.lit("4"), kind, F.substring(body, F.lit(5), F.length(body))))
    bundle = F.concat(F.lit("18000209F0"), _hex("sequence % 40 + 4", 4), head, body)
    texts = F.when(F.col("sequence") % 3 == 0, F.array(F.concat(head, body))).when(F.col("sequence") % 3 == 1, F.array(bundle)).otherwise(parts)
    rows = rows.select("stream_id", "sequence", "n", F.posexplode(texts).alias("i", "text"), F.size(texts).alias("of"))
    lost = ((F.col("sequence") % 11 == 5) & (F.col("i") == 0)) | ((F.col("sequence") % 13 == 4) & (F.col("i") == 2))
    seq = F.sum(1 + lost.cast("long")).over(timestamps._upto("sequence", "i"))
    return rows.select("stream_id", seq.alias("seq"), (F.col("n") * 3000).cast("long").alias("rtp_ts"), (F.col("i") + 1 == F.col("of")).alias("marker"), F.unhex("text").alias("payload"))


@query("""WITH {U}, a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS n, CASE WHEN key_frame THEN '65' ELSE '41' END || repeat('5A', (sequence % 40 + 3)::INT) AS unit FROM u),
b AS (SELECT *, NOT (sequence % 11 = 5 AND n > 1) AND NOT (sequence % 3 = 2 AND sequence % 13 = 4) AS complete FROM a)
SELECT stream_id, n * 3000 AS rtp_ts, CASE WHEN sequence % 3 = 2 THEN 3 ELSE 1 END::BIGINT AS packets, complete, key_frame,
  CASE WHEN complete THEN CASE WHEN sequence % 3 = 1 THEN '0000000109F0' ELSE '' END || '00000001' || unit END AS data FROM b""")
def packet_access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.access_units(_payloads(spark, sf_dir), "h264").withColumn("data", F.hex("data"))


@query("""WITH {U}, n AS (SELECT sequence, unnest(range(0, sequence % 4 + 1)) AS i FROM u WHERE sequence % 9 <> 0) SELECT sequence, i * (sequence % 3 + 1) * 1024 AS ts_offset, sequence % 50 + 1 + i AS bytes FROM n""")
def aac_packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of one to four frames whose index steps by one to three; every ninth is a byte short and gives none."""
    last = F.expr("sequence(0L, sequence % 4)")
    sizes = F.transform(last, lambda i: F.lpad(F.hex((F.col("sequence") % 50 + 1 + i) * 8 + F.when(i > 0, F.col("sequence") % 3).otherwise(0)), 4, "0"))
    bodies = F.transform(last, lambda i: F.repeat(F.lit("AA"), (F.col("sequence") % 50 + 1 + i).cast("int")))
    text = F.concat(_hex("16 * (sequence % 4 + 1)", 4), F.array_join(sizes, ""), F.array_join(bodies, ""))
    text = F.when(F.col("sequence") % 9 == 0, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    frames = units(spark, sf_dir).select("sequence", F.explode(payloads.aac_frames(F.unhex(text), 1024)).alias("f"))
    return frames.select("sequence", "f.ts_offset", F.octet_length("f.data").cast("long").alias("bytes"))


@query("""WITH {U}, a AS (SELECT sequence, (sequence % 32)::INT AS m, sequence // 32 % 4 AS code, sequence // 128 % 8 AS listed FROM u),
b AS (SELECT *, CASE WHEN m < 12 THEN [480, 960, 1920, 2880][m % 4 + 1] WHEN m < 16 THEN [480, 960][m % 2 + 1] ELSE 120 * 2 ** (m % 4) END::BIGINT * CASE code WHEN 0 THEN 1 WHEN 3 THEN listed ELSE 2 END AS d FROM a)
SELECT sequence, CASE WHEN d BETWEEN 1 AND 5760 THEN d END AS samples FROM b""")
def opus_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(_hex("(sequence % 32) * 8 + sequence div 32 % 4", 2), _hex("sequence div 128 % 8", 2))
    return units(spark, sf_dir).select("sequence", payloads.opus_duration(F.unhex(text)).alias("samples"))


@query("""WITH {U}, a AS (SELECT sequence, pts % 8589934592 AS t FROM u)
SELECT sequence, printf('%02X%02X%02X%02X%02X', 33 + 2 * (t >> 30), (t >> 22) & 255, ((t >> 15) & 127) * 2 + 1, (t >> 7) & 255, (t & 127) * 2 + 1) AS field, t AS ticks FROM a""")
def pes_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("sequence", wire.timestamp_field(2, F.col("pts") % (1 << 33)).alias("field"))
    return rows.select("sequence", F.hex("field").alias("field"), wire.timestamp_value(F.col("field")).alias("ticks"))


@query("""WITH {U} SELECT sequence, key_frame AS marker, sequence % 65536 AS seq, sequence * 90 % 4294967296 AS rtp_ts, stream_id + 7 AS ssrc, sequence % 40 AS payload_bytes FROM u WHERE sequence % 40 > 0""")
def rewritten_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams as another source sends them; those without a payload are refused."""
    rows = _datagrams(spark, sf_dir).join(units(spark, sf_dir).select("sequence", "stream_id"), "sequence")
    rows = rows.withColumn("h", wire.rtp_header(F.col("data")))
    rows = rows.select("sequence", wire.rewritten(F.col("data"), F.col("h"), 96, F.col("stream_id") + 7, F.col("sequence") * 90 % (1 << 32)).alias("again")).where("again is not null")
    rows = rows.select("sequence", wire.rtp_header(F.col("again")).alias("h"))
    return rows.select("sequence", "h.marker", "h.seq", "h.rtp_ts", "h.ssrc", "h.payload_bytes")


@query(f"""WITH {{U}}, a AS (SELECT *, count(*) OVER w AS packets, sum(greatest(bytes, 0)) OVER w AS octets FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY pts, sequence ROWS UNBOUNDED PRECEDING))
SELECT sequence, printf('80C80006%08X%08X%08X%08X%08X%08X', stream_id, pts // 1000000 + 2208988800, ((pts % 1000000) << 32) // 1000000, ((pts - {ORIGIN}) * 9 // 100) % 4294967296, packets, (octets % 4294967296)::BIGINT) AS report FROM a""")
def sender_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report at every record: its stream's running packet and byte counts beside both clocks."""
    w = timestamps._upto("pts", "sequence")
    rows = units(spark, sf_dir).select("sequence", "stream_id", "pts", F.count("*").over(w).alias("packets"), F.sum(F.greatest("bytes", F.lit(0))).over(w).alias("octets"))
    fraction = F.expr("shiftleft(pts % 1000000, 32) div 1000000")
    return rows.select("sequence", F.hex(wire.sender_report(F.col("stream_id"), F.expr("pts div 1000000 + 2208988800"), fraction, F.expr(f"((pts - {ORIGIN}) * 9) div 100"), F.col("packets"), F.col("octets"))).alias("report"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 > 0 THEN concat_ws(chr(13) || chr(10), 'v=0', 'o=- ' || (s_nationkey + 1) || ' 3 IN IP4 10.0.0.' || s_suppkey, 's=' || s_name, 'c=IN IP4 10.0.0.' || s_suppkey, 't=0 0', 'm=video ' || (6000 + 2 * s_suppkey) || ' RTP/AVP 33',
  'a=rtcp:' || (6001 + 2 * s_suppkey) || ' IN IP4 10.0.0.' || s_suppkey, 'a=rtpmap:33 MP2T/90000', 'a=ssrc:' || s_suppkey || ' cname:' || s_name) || chr(13) || chr(10) END AS text FROM supplier""")
def transport_sdp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session descriptions of transport streams; an odd port gives none."""
    k = F.col("s_suppkey")
    port = 6000 + 2 * k + (k % 5 == 0).cast("int")
    text = wire.transport_session_description(F.lit("-"), F.col("s_nationkey") + 1, F.lit(3), F.col("s_name"), F.concat(F.lit("10.0.0."), k.cast("string")), port, k, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), text.alias("text"))


# --- folds --------------------------------------------------------------------------------------------------------------


@query()
def reorder_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.row_number().over(timestamps._by("sequence")), F.col("sequence")
    rows = units(spark, sf_dir).select("stream_id", s.alias("arrival"), "pts", (n - 1).alias("n"))
    swapped = F.when(F.col("n") % 5 == 3, F.col("n") + 2).when(F.col("n") % 11 == 7, F.col("n") - 1).otherwise(F.col("n"))
    rows = rows.select("stream_id", "arrival", F.expr("pts div 1000").alias("received"), F.lit(1).alias("ssrc"), ((swapped + 65_500) % 65_536).alias("seq16"), F.lit(96).alias("payload_type"))
    return stateful.reorder(rows, 16, 30 * DAY // 1000)


@query(f"""WITH RECURSIVE {{U}}, x AS (SELECT stream_id, sequence, (((pts // 1000 - (sequence * 7919) % 1000000000) % {1 << 32}) + {1 << 32}) % {1 << 32} AS c, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS n FROM u),
r(stream_id, sequence, n, last, a) AS (SELECT stream_id, sequence, n, c, NULL::BIGINT FROM x WHERE n = 1
UNION ALL SELECT stream_id, sequence, n, last + CASE WHEN 2 * a < {1 << 32} THEN a ELSE 0 END, a FROM (SELECT x.stream_id, x.sequence, x.n, last, (((c - last) % {1 << 32}) + {1 << 32}) % {1 << 32} AS a FROM r JOIN x ON x.stream_id = r.stream_id AND x.n = r.n + 1))
SELECT stream_id, sequence, CASE WHEN a IS NULL OR 2 * a < {1 << 32} THEN last END AS unwrapped, CASE WHEN a IS NULL THEN 'first' WHEN 2 * a < {1 << 32} THEN 'forward' WHEN 2 * a = {1 << 32} THEN 'ambiguous' ELSE 'backward' END AS status FROM r""")
def unwrap_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", "sequence", F.pmod(F.expr("pts div 1000") - (F.col("sequence") * 7919) % 1_000_000_000, F.lit(1 << 32)).alias("counter"))
    return stateful.unwrap_with_rejects(rows, 1 << 32)


@query()
def sr_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("stream_kind"))  # a clock of its own for each
    rows = units(spark, sf_dir).select((F.col("stream_id") * 10 + kind).alias("stream_id"), "sequence", F.col("stream_kind").alias("name"), (F.col("pts") * 1000).alias("source_ns"), F.expr(f"((pts - {ORIGIN}) * 9) div 100 + sequence % 50").alias("ticks"))
    return stateful.report_calibration(rows, 90_000)


@query(f"""WITH RECURSIVE {{U}}, x AS (SELECT stream_id, sequence, ((pts - {ORIGIN}) * 27) % {300 << 33} AS p, sequence % 101 = 0 AS cut, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS n FROM u),
r(stream_id, sequence, n, generation, again, last, anchor, source, ready, published) AS (SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, 1::BIGINT, false, NULL::HUGEINT, NULL::HUGEINT, NULL::HUGEINT, false, NULL::HUGEINT FROM u
UNION ALL SELECT stream_id, sequence, n, generation + (fresh AND NOT again)::INT, CASE WHEN fresh THEN true WHEN last IS NULL THEN again ELSE false END, CASE WHEN fresh OR last IS NULL THEN p ELSE last + a END, CASE WHEN fresh OR last IS NULL THEN p ELSE anchor END,
  CASE WHEN fresh OR last IS NULL THEN greatest(coalesce(published, 0), p::HUGEINT * 1000000000 // 27000000) ELSE source END, NOT (fresh OR last IS NULL),
  CASE WHEN fresh OR last IS NULL THEN published ELSE source + (2 * (last + a - anchor) * 1000000000 + 27000000) // 54000000 END FROM (
    SELECT x.stream_id, x.sequence, x.n, p, generation, again, last, anchor, source, published, a, cut OR coalesce(2 * a >= {300 << 33} OR a = 0 OR a > {12 * HOUR * 27}, false) AS fresh
    FROM (SELECT x.*, r.generation, r.again, r.last, r.anchor, r.source, r.published, (((x.p - r.last) % {300 << 33}) + {300 << 33}) % {300 << 33} AS a FROM r JOIN x ON x.stream_id = r.stream_id AND x.n = r.n + 1) x))
SELECT stream_id, sequence, generation, ready, (CASE WHEN ready THEN published ELSE source END)::BIGINT AS source_ns FROM r WHERE n > 0""")
def pcr_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", "sequence", F.expr(f"((pts - {ORIGIN}) * 27) % {300 << 33}").alias("pcr"), (F.col("sequence") % 101 == 0).alias("discontinuity"))
    return stateful.program_clock(rows, 12 * HOUR * 27)


@query()
def drift_servo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(timestamps._by("sequence"))
    rows = units(spark, sf_dir).select("stream_id", "sequence", (n.cast("long") * 20_000_000).alias("at_ns"), (n.cast("long") * 4_000 + F.col("sequence") % 2_000).alias("phase_ns"))
    return stateful.drift_servo(rows)


@query("""WITH RECURSIVE {U}, l AS (SELECT [1000000, 2500000, 5000000, 8000000] AS rungs),
x AS (SELECT stream_id, sequence, (sequence % 100) / 1000.0 AS loss, sequence * 31 % 210000 AS delay, sequence * 104729 % 30000000 AS t, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS n FROM u),
r(stream_id, sequence, n, k, stable) AS (SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, 4, 0 FROM u
UNION ALL SELECT stream_id, sequence, n, CASE WHEN down AND k > 1 THEN k - 1 WHEN up AND k < 4 THEN k + 1 ELSE k END, CASE WHEN down AND k > 1 OR up AND k < 4 THEN 0 ELSE stable + 1 END FROM (
  SELECT x.stream_id, x.sequence, x.n, k, stable, loss >= 0.05 OR delay >= 200000 OR t > 0 AND t < rungs[k] * 12 // 10 AS down, NOT (loss >= 0.05 OR delay >= 200000 OR t > 0 AND t < rungs[k] * 12 // 10) AND stable >= 8 AND loss < 0.01 AND delay < 50000 AND t > 2 * rungs[k] AS up
  FROM r JOIN x ON x.stream_id = r.stream_id AND x.n = r.n + 1, l))
SELECT stream_id, sequence, rungs[k]::BIGINT AS bitrate FROM r, l WHERE n > 0""")
def abr_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    rows = units(spark, sf_dir).select("stream_id", "sequence", ((s % 100) / 1000).alias("loss"), (s * 31 % 210_000).alias("delay_us"), (s * 104_729 % 30_000_000).alias("throughput"))
    return stateful.bitrate_ladder(rows, [1_000_000, 2_500_000, 5_000_000, 8_000_000])


@query("""WITH RECURSIVE {U}, x AS (SELECT stream_id, sequence, sequence * 37 % 90000 AS q, sequence * 7919 % 60000000 AS res, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS n FROM u),
y AS (SELECT *, CASE WHEN res < 50000000 THEN least(greatest(1000000, (q * 1000000000 + (50000000 - res) - 1) // (50000000 - res)), 6000000) ELSE 6000000 END AS own FROM x),
z AS (SELECT *, n * 1000000 AS rel, n * 1000000 + 40000000 AS due, (1400000000000 + own - 1) // own AS takes FROM y),
r(stream_id, sequence, n, own, starts, takes, late, free) AS (SELECT DISTINCT stream_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, 0::BIGINT FROM u
UNION ALL SELECT z.stream_id, z.sequence, z.n, z.own, greatest(rel, free), z.takes, greatest(rel, free) + z.takes > due, CASE WHEN greatest(rel, free) + z.takes > due THEN free ELSE greatest(rel, free) + z.takes END FROM r JOIN z ON z.stream_id = r.stream_id AND z.n = r.n + 1)
SELECT stream_id, sequence, own AS rate, starts, CASE WHEN NOT late THEN starts + takes END AS ends, late FROM r WHERE n > 0""")
def pacing_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(timestamps._by("sequence")).cast("long")
    rows = units(spark, sf_dir).select("stream_id", "sequence", (n * 1_000_000).alias("release"), (n * 1_000_000 + 40_000_000).alias("deadline"), F.lit(1_400).alias("bytes"), (F.col("sequence") * 37 % 90_000).alias("queued_bytes"), (F.col("sequence") * 7919 % 60_000_000).alias("residence"))
    return stateful.paced(rows, 1_000_000, 6_000_000, 50_000_000)


@query()
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("stream_id", "sequence", (F.col("stream_kind") != "view").alias("push"), "key_frame")
    return stateful.bounded_queue(rows, 4, "drop_non_key")


@query()
def startup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("acquire", "prime", "arm", "release", "run", "reacquire", "prime")])
    rows = units(spark, sf_dir).select("stream_id", "sequence", F.element_at(names, (F.col("sequence") * 5 % 7 + 1).cast("int")).alias("event"), F.expr("sequence div 500").alias("generation"))
    return stateful.startup_states(rows)
