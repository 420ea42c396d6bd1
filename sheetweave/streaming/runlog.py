"""Answer rows as a stream: an append-only log, running spend, commits in order, windows over events."""

from __future__ import annotations

import json
import threading

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import ANSWER, ROW_KEY


def read_log(spark: SparkSession, folder: str, schema: str = ANSWER) -> DataFrame:
    """New files of a folder of JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def append_once(rows: DataFrame, folder: str, checkpoint: str, key: list[str] = ROW_KEY) -> StreamingQuery:
    """Write each key's first usable row to Parquet; provider errors are left out, to be answered again.

    Keys already written are the query's own state, so no batch reads what is there; a batch goes to a folder of its own
    number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    fresh = rows.where("outcome <> 'PROVIDER_ERROR'").dropDuplicates(key)
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SpendCap:
    """A cap on spending that calls reserve from before they are made: what is spent and reserved never passes it."""

    def __init__(self, cap: float):
        self.cap, self.spent, self.reserved, self._lock = cap, 0.0, 0.0, threading.Lock()

    def reserve(self, estimate: float) -> bool:
        """Whether a call of this cost may go out; if so it is set aside."""
        with self._lock:
            if self.spent + self.reserved + estimate > self.cap + 1e-12:
                return False
            self.reserved += estimate
            return True

    def settle(self, estimate: float, actual: float) -> None:
        """A call has ended: what was set aside for it is free, what it cost is spent."""
        with self._lock:
            self.reserved, self.spent = self.reserved - estimate, self.spent + actual


def progress(query: StreamingQuery) -> dict:
    """How far a job is: batches done, rows read, rows kept in state, whether it goes on, and what stopped it."""
    last = query.lastProgress
    rows = sum(p.numInputRows for p in query.recentProgress)
    state = sum(o.numRowsTotal for o in last.stateOperators) if last else 0
    return {"batch": last.batchId if last else None, "rows": rows, "state": state, "active": query.isActive, "error": str(query.exception()) if query.exception() else None}


def running_spend(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows and cost so far of each group; for output mode update or complete."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("spent"))


def gap_free(rows: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """Rows in the order of their position within `by`, each as soon as all before it have come.

    What came early waits in the group's state; it is as much as is out of order.
    """

    def commit(key, batches, state):
        upto, waiting = state.get if state.exists else (0, "{}")
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for batch in batches:  # a position that was handed on already is a repeat
            held.update((p, v) for p, v in zip(batch[position].tolist(), batch[value].tolist(), strict=True) if p >= upto)
        ready = []
        while upto in held:
            ready.append((key[0], upto, held.pop(upto)))
            upto += 1
        state.update((upto, json.dumps(held)))
        yield pd.DataFrame(ready, columns=[by, position, value])

    kinds = dict(rows.dtypes)
    out = f"{by} {kinds[by]}, {position} long, {value} {kinds[value]}"
    return rows.groupBy(by).applyInPandasWithState(commit, out, "upto long, waiting string", "append", "NoTimeout")


def late_answers(rows: DataFrame, limit: float) -> DataFrame:
    """Answers over their time limit are timed out and wrong; what they cost stays."""
    late = F.col("latency_s") > limit
    return rows.withColumn("outcome", F.when(late, "TIMED_OUT").otherwise(F.col("outcome"))).withColumn("correct", F.col("correct") & ~late)


def windowed(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) of events in time windows; rows later than `late` are let go in append mode."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) of each user's events without a gap."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
