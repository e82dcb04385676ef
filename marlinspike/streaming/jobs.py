"""Streaming jobs.  Each has a batch twin that gives the same final result."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISHED = ("completed", "failed", "cancelled")


def watch_images(spark: SparkSession, folder: str, files_per_trigger: int = 32, bytes_per_trigger: int | None = None) -> DataFrame:
    """New images of a folder and of those below it, of the watched suffixes whatever their case: (image_id, content)."""
    from ..functions import text
    from ..sources.ingest import WATCH_SUFFIXES

    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    # Spark takes one of the two bounds
    reader = reader.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).where(text.suffix(F.col("path")).isin(*WATCH_SUFFIXES)).select(F.col("path").alias("image_id"), "content")


def watch_folder(spark: SparkSession, folder: str, form: str, schema: str | None = None, files_per_trigger: int = 32, pattern: str | None = None) -> DataFrame:
    """Unbounded rows of a growing folder; ``files_per_trigger`` bounds what is in flight."""
    reader = spark.readStream.format(form).option("maxFilesPerTrigger", files_per_trigger)
    if schema:
        reader = reader.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def run_to_folder(rows: DataFrame, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Process micro-batches into ``out``/results and ``out``/failures.

    ``process`` gives (results, failures).  Each micro-batch overwrites the
    folder of its own number, so a batch that runs again after a failure is not
    written twice; the checkpoint takes the place of lists of finished files.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            results, failures = process(kept)
            results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
            failures.write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        finally:
            kept.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


STATE = "task_id string, status string, processed long, ts timestamp"


def _advance(status: str | None, event: str) -> str:
    """Next status of a task; finished tasks do not change."""
    if status in FINISHED:
        return status
    if event == "cancel":
        return "cancelled" if status in (None, "pending") else status
    return {"enqueue": status or "pending", "claim": "running", "progress": "running", "orphaned": "pending"}.get(event, event if event in FINISHED else status or "pending")


def _step(key, batches, state: GroupState):
    status, processed, last = state.get if state.exists else (None, 0, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "ord"], kind="stable")
    for event, done, ts in zip(rows["event"], rows["processed"], rows["ts"], strict=True):
        status = _advance(status, event)
        processed = max(processed, int(done)) if pd.notna(done) else processed
        last = ts
    state.update((status, processed, last.to_pydatetime() if hasattr(last, "to_pydatetime") else last))
    yield pd.DataFrame({"task_id": [key[0]], "status": [status], "processed": [processed], "ts": [last]})


def task_states(events: DataFrame) -> DataFrame:
    """State of each task after every micro-batch that touches it (update mode).

    ``events``: task_id, ord, event, processed, ts.
    """
    return events.groupBy("task_id").applyInPandasWithState(_step, STATE, "status string, processed long, ts timestamp", "update", GroupStateTimeout.NoTimeout)


def _timed(heartbeat: float, keep: float):
    """As _step, with timers in event time: a running task that falls silent waits again, a finished one is forgotten."""

    def step(key, batches, state: GroupState):
        status, processed, last = state.get if state.exists else (None, 0, None)
        if state.hasTimedOut:
            if status in FINISHED:
                state.remove()
                return
            status = "pending" if status == "running" else status
            now = state.getCurrentWatermarkMs()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "ord"], kind="stable")
            for event, done, ts in zip(rows["event"], rows["processed"], rows["ts"], strict=True):
                status = _advance(status, event)
                processed = max(processed, int(done)) if pd.notna(done) else processed
                last = ts if last is None else max(pd.Timestamp(last), ts)
            now = max(int(pd.Timestamp(last).timestamp() * 1000), state.getCurrentWatermarkMs())
        state.update((status, processed, pd.Timestamp(last).to_pydatetime()))
        state.setTimeoutTimestamp(now + int(1000 * (heartbeat if status == "running" else keep)) + 1)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "processed": [processed], "ts": [pd.Timestamp(last)]})

    return step


def timed_states(events: DataFrame, heartbeat: float = 90.0, keep: float = 24 * 3600.0, late: str = "0 seconds") -> DataFrame:
    """task_states with the limits of the queue: heartbeats within ``heartbeat`` seconds, finished tasks kept ``keep`` seconds.

    Event time decides, so a replay gives the same states.
    """
    grouped = events.withWatermark("ts", late).groupBy("task_id")
    return grouped.applyInPandasWithState(_timed(heartbeat, keep), STATE, "status string, processed long, ts timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def observed(rows: DataFrame, name: str = "progress") -> DataFrame:
    """``rows`` with counts of what passed, which ``ProgressListener`` hands to a callback."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


class ProgressListener(StreamingQueryListener):
    """Calls ``callback(processed)`` with the rows so far after every micro-batch of a query with ``observed`` rows."""

    def __init__(self, callback: Callable[[int], None], name: str = "progress"):
        self.callback, self.name, self.total = callback, name, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.total += row.rows
            self.callback(self.total)

    def onQueryTerminated(self, event) -> None:
        pass


def final_states(events: DataFrame) -> DataFrame:
    """Batch twin of task_states: the state after all events, without Python.

    A cancel ends a task that is only waiting; the first outcome ends any other.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "ord", "event", "processed")))
    finished = lambda s: s.isin(*FINISHED)
    step = lambda s, e: (
        F.when(finished(s), s)
        .when(e["event"] == "cancel", F.when(s.isin("", "pending"), "cancelled").otherwise(s))
        .when(e["event"].isin("claim", "progress"), "running")
        .when(e["event"] == "orphaned", "pending")
        .when(finished(e["event"]), e["event"])
        .otherwise(F.when(s == "", "pending").otherwise(s))
    )
    rows = events.groupBy("task_id").agg(ordered.alias("events"))
    status = F.aggregate("events", F.lit(""), step)
    return rows.select("task_id", status.alias("status"), F.coalesce(F.array_max(F.transform("events", lambda e: e["processed"])), F.lit(0)).alias("processed"), F.element_at("events", -1)["ts"].alias("ts"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: event-time windows with a watermark; also runs on a batch frame."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: sessions that end after a quiet gap, like a cache entry's idle limit."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def start_to_memory(rows: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
