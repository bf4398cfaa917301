"""Cumulative-snapshot collapse of logged conversations, then rendering.

A log often holds a conversation once after every turn. Each turn gets two 64-bit hashes of (its place, role, text); their
running sums over the turns of a conversation, with the number of turns, name every prefix. A conversation whose whole name
is the name of a proper prefix of another is dropped by an anti-join; of equal conversations the one with the smallest
conv_id stays. The rest are maximal and are rendered.

A conversation is not bound to one task: its turns are dealt by (conv_id, stretch of turn numbers), summed per stretch, and
the stretches' totals give every stretch its start. Only the rendering gathers a conversation, as its result is one text.

Defined cases: a null role or text differs from an empty one and is rendered as empty; a null turn comes first; turns with
equal numbers are ordered by role and text, and repeated rows each count; a null conv_id is a conversation of its own, which
sorts first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm._shared import written

STRETCH = 1024
#: ChatML: how a turn is rendered.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


#: A conversation and a stretch of its turns, without nulls, so that what follows one dealing keeps it.
KEY = ["_known", "_id", "_stretch"]


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """_known and _id (the conversation), k (turns up to this one) and s1..s4, which with k name the prefix that ends here.

    Role and text are dealt once, to put the turns in order; from then on only their hashes travel.
    """
    turn = F.col("turn").cast("long")
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("_known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_id"),
        F.coalesce(F.floor(turn / STRETCH).cast("long"), F.lit(-(1 << 62))).alias("_stretch"), turn.alias("turn"), "role", "text",
        *[F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"_m{seed}") for seed in (1, 2)],
    )
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("turn", "role", "text"))
    rows = rows.withColumn("_k", nth.cast("long")).select(*KEY, "_k", "_m1", "_m2")
    earlier = Window.partitionBy("_known", "_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    rows = rows.join(counts, KEY).withColumn("k", F.col("_before") + F.col("_k"))
    # Each hash of place and content in two halves, so that sums of up to 2^31 turns stay exact.
    marks = [F.xxhash64(F.lit(seed), "k", f"_m{seed}") for seed in (1, 2)]
    halves = [x for mark in marks for x in (F.shiftrightunsigned(mark, 32), mark.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = rows.select(*KEY, "_k", "k", *[half.alias(f"_h{i}") for i, half in enumerate(halves)])
    totals = rows.groupBy(*KEY).agg(*[F.sum(f"_h{i}").alias(f"_t{i}") for i in range(4)])
    totals = totals.select(*KEY, *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(4)])
    inside = Window.partitionBy(*KEY).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(totals, KEY)
    return rows.select("_known", "_id", "k", *[(F.col(f"_b{i}") + F.sum(f"_h{i}").over(inside)).alias(f"s{i + 1}") for i in range(4)])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of each conversation that is no prefix of another."""
    name, who = ["k", "s1", "s2", "s3", "s4"], ["_known", "_id"]
    prefixes = written(turn_prefixes(turns), "prefixes")
    whole = prefixes.groupBy(*who).agg(F.max(F.struct(*name)).alias("w")).select(*who, "w.*")
    # Of equal conversations the first; a name that very many share is reduced before the shuffle.
    first = whole.groupBy(*name).agg(F.min(F.struct(*who)).alias("f")).select("f.*", *name)
    # The names of all rows that end no conversation: the proper prefixes.
    proper = prefixes.join(whole.select(*who, F.col("k").alias("_k")), who).where("k < _k").select(*name).distinct()
    kept = first.join(proper, name, "left_anti")
    return kept.select(F.when(F.col("_known"), F.col("_id")).alias("conv_id"), F.col("k").alias("n_turns"))


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of the chosen conversations: every turn as <|im_start|>role, line end, text, <|im_end|>, line end."""
    own = chosen.select(F.col("conv_id").alias("_c"), "n_turns")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").join(own, F.col("conv_id").eqNullSafe(F.col("_c")))
    gathered = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n")))
    return gathered.select("conv_id", "n_turns", F.concat_ws("", said).alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """The rendered maximal conversations."""
    return render(turns, maximal(turns))
