"""Live forms: watermarks, duplicates, gates with state, outputs that come and go, exactly-once commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watermarked(units: DataFrame, delay: str) -> DataFrame:
    """units with event_time (from pts in microseconds) and a watermark. A time without zone can carry none, so pts is converted."""
    return units.withColumn("event_time", F.timestamp_micros("pts")).withWatermark("event_time", delay)


def without_duplicates(units: DataFrame) -> DataFrame:
    """The first of the records with the same stream and sequence inside the watermark."""
    return units.dropDuplicatesWithinWatermark(["stream_id", "sequence"])


def counts_by_window(units: DataFrame, width: str) -> DataFrame:
    """Records and bytes of each kind by window of event time."""
    return units.groupBy(F.window("event_time", width), "stream_kind").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


def start_gate(units: DataFrame) -> DataFrame:
    """Each stream from its first key record on, across micro-batches: the state is one flag a stream.

    Only until a stream has had its key are its records of a trigger (which maxFilesPerTrigger bounds) held together, to
    find the first in order; those of an open stream pass through batch by batch. The flags are
    never dropped: the state has one for every stream there ever was.
    """

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.exists and state.get[0]
        if opened:
            yield from batches
        else:
            rows = pd.concat(list(batches)).sort_values(["pts", "sequence"], ignore_index=True)
            keys = rows["key_frame"].fillna(False).to_numpy(dtype=bool).nonzero()[0]
            opened = bool(len(keys))
            if opened:
                yield rows.iloc[keys[0] :]
        state.update((opened,))

    return units.groupBy("stream_id").applyInPandasWithState(gate, units.schema, "opened boolean", "append", GroupStateTimeout.NoTimeout)


def last_seen(units: DataFrame, gap: int) -> DataFrame:
    """Continuity across micro-batches: stream_id, sequence, pts, reason for each step back and each step of more than gap; the state is the last pts.

    The records of a stream in one trigger, three numbers each, are ordered together.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sequence", ignore_index=True)
        before = rows["pts"].shift(fill_value=state.get[0] if state.exists else rows["pts"].iloc[0])
        reason = pd.Series(None, index=rows.index, dtype=object)
        reason[rows["pts"] < before] = "regression"
        reason[rows["pts"] - before > gap] = "gap"
        yield rows.assign(reason=reason)[reason.notna()]
        state.update((int(rows["pts"].iloc[-1]),))

    narrow = units.select("stream_id", "sequence", "pts").where("pts is not null")
    return narrow.groupBy("stream_id").applyInPandasWithState(watch, "stream_id long, sequence long, pts long, reason string", "last long", "append", GroupStateTimeout.NoTimeout)


def commit_outputs(units: DataFrame, outputs: Callable[[], list[str]], path: str, checkpoint: str):
    """Writes every micro-batch to each output that exists when it begins, in a folder named by the batch: a batch that is run again replaces what it wrote."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name in outputs():
            batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        batch.unpersist()

    return units.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Runs a stream over all there is now, into a table in memory (for tests)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
