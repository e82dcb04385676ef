"""Task queue as state derived from events.

A task table has task_id, kind, task_name, database_name, status, lane,
total_items, processed_items, failed_items, progress_percentage,
last_processed_index, stage, cancel_requested, created_at, started_at,
completed_at, heartbeat_at and scheduler_pid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import fresh, payload_paths, progress_percent, query_status

STATUSES = ("pending", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
KINDS = ("index_build", "batch_search", "interactive_search")
LANES = ("background", "interactive")
EVENT_KINDS = ("enqueue", "claim", "progress", "finish", "cancel", "heartbeat")
UNASSIGNED = "__unassigned__"
#: Fixed value: the stage note of a task that waits again after its process was lost.
REQUEUED = "调度进程中断，已重新排队"
TASKS = (
    "task_id string, kind string, task_name string, database_name string, status string, lane string, total_items int, processed_items int, "
    "failed_items int, progress_percentage double, last_processed_index int, stage string, cancel_requested boolean, created_at timestamp, "
    "started_at timestamp, completed_at timestamp, heartbeat_at timestamp, scheduler_pid long"
)


def enqueue_row(task_id: str, kind: str, lane: str = "background", num_gpus: int = 0, batch_size: int = 32, **fields) -> dict:
    """Checked fields of a new pending task."""
    if kind not in KINDS:
        raise ValueError(f"unknown task kind: {kind}")
    if lane not in LANES:
        raise ValueError(f"unknown lane: {lane}")
    if num_gpus < 0 or batch_size < 1:
        raise ValueError("num_gpus is 0 or more, batch_size 1 or more")
    return {"task_id": task_id, "kind": kind, "lane": lane, "status": "pending", "cancel_requested": False, "num_gpus": num_gpus, "batch_size": batch_size, **fields}


def replay(events: DataFrame) -> DataFrame:
    """State of each task from its events (task_id, ord, event, and the fields it sets).

    Fields keep their last given value.  The status is the outcome of the last
    finish; else cancelled if a cancel came while no claim had; else running or
    pending.  A cancel of a running task sets the flag only, and events after
    the end change nothing.
    """
    end = F.min(F.when(F.col("event") == "finish", F.col("ord"))).over(Window.partitionBy("task_id"))
    claim = F.min(F.when(F.col("event") == "claim", F.col("ord"))).over(Window.partitionBy("task_id"))
    early = F.min(F.when(F.col("event") == "cancel", F.col("ord"))).over(Window.partitionBy("task_id"))
    rows = events.withColumns({"_end": end, "_claim": claim, "_cancel": early})
    dead = F.coalesce(F.col("_cancel") < F.col("_claim"), F.col("_cancel").isNotNull() & F.col("_claim").isNull())
    rows = rows.withColumn("_stop", F.when(dead, F.col("_cancel")).otherwise(F.col("_end"))).where("_stop is null or ord <= _stop")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    state = rows.groupBy("task_id").agg(
        last("kind"), last("database_name"), last("total_items"), last("processed_items"), last("stage"),
        F.max(F.when(F.col("event") == "finish", F.col("outcome"))).alias("_outcome"),
        F.max((F.col("event") == "claim").cast("int")).alias("_claimed"),
        F.max((F.col("event") == "cancel").cast("int")).alias("_asked"),
        F.min(F.when(F.col("event") == "enqueue", F.col("ts"))).alias("created_at"),
        F.max(F.when(F.col("event") == "finish", F.col("ts"))).alias("completed_at"),
    )
    status = F.when(F.col("_outcome").isNotNull(), F.col("_outcome")).when((F.col("_asked") == 1) & (F.col("_claimed") == 0), "cancelled").when(F.col("_claimed") == 1, "running").otherwise("pending")
    percent = progress_percent(F.coalesce("processed_items", F.lit(0)), F.coalesce("total_items", F.lit(0)))
    return state.withColumn("status", status).withColumn("cancel_requested", F.col("_asked") == 1).withColumn("progress_percentage", F.when(F.col("status") == "completed", 100.0).otherwise(percent)).drop("_outcome", "_claimed", "_asked")


def update_progress(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (task_id, processed, total, failed, last_index, stage); null fields change nothing."""
    rows = tasks.join(updates.select("task_id", F.col("processed").alias("_p"), F.col("total").alias("_t"), F.col("failed").alias("_f"), F.col("last_index").alias("_i"), F.col("stage").alias("_s"), F.lit(True).alias("_u")), "task_id", "left")
    total, done = F.coalesce("_t", "total_items", F.lit(0)), F.coalesce("_p", "processed_items", F.lit(0))
    return rows.withColumns(
        {
            "progress_percentage": F.when(F.col("_u"), progress_percent(done, total)).otherwise(F.col("progress_percentage")),
            "total_items": F.coalesce("_t", "total_items"), "processed_items": F.coalesce("_p", "processed_items"), "failed_items": F.coalesce("_f", "failed_items"),
            "last_processed_index": F.coalesce("_i", "last_processed_index"), "stage": F.coalesce("_s", "stage"),
        }
    ).select(*tasks.columns)


def finish(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Apply (task_id, outcome, stage); only completed pins the percentage to 100."""
    good = F.when(F.col("outcome").isin(*TERMINAL), F.col("outcome")).otherwise(F.raise_error(F.lit("an outcome must be terminal")))
    rows = tasks.join(outcomes.select("task_id", good.alias("_o"), F.col("stage").alias("_s")), "task_id", "left")
    return rows.withColumns(
        {
            "status": F.coalesce("_o", "status"), "stage": F.coalesce("_s", "stage"), "completed_at": F.when(F.col("_o").isNotNull(), now).otherwise(F.col("completed_at")),
            "progress_percentage": F.when(F.col("_o") == "completed", 100.0).otherwise(F.col("progress_percentage")),
        }
    ).select(*tasks.columns)


def request_cancel(tasks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Pending tasks are cancelled, running ones flagged, others left alone."""
    rows = tasks.join(ids.select("task_id").distinct().withColumn("_c", F.lit(True)), "task_id", "left")
    waiting, running = F.col("_c") & (F.col("status") == "pending"), F.col("_c") & (F.col("status") == "running")
    return rows.withColumns(
        {
            "cancel_requested": F.when(waiting | running, True).otherwise(F.col("cancel_requested")),
            "completed_at": F.when(waiting, now).otherwise(F.col("completed_at")),
            "status": F.when(waiting, "cancelled").otherwise(F.col("status")),
        }
    ).select(*tasks.columns)


def recover_orphans(tasks: DataFrame, live_pids: DataFrame, now: Column, running_pids: DataFrame | None = None, own_tasks: DataFrame | None = None) -> DataFrame:
    """Running tasks whose scheduler is gone wait again from where they were, with a note as their stage.

    A pid among ``live_pids``, the known schedulers, is left alone whatever its
    heartbeat.  A number that the system runs but that is not among them
    (``running_pids``) may be another process by now, so it counts only with a
    fresh heartbeat.  ``own_tasks`` (task_id) are known to run and are skipped.
    """
    known = lambda pids, name: pids.select(F.col("pid").alias("scheduler_pid"), F.lit(True).alias(name)).distinct()
    rows = tasks.join(known(live_pids, "_live"), "scheduler_pid", "left")
    rows = rows.join(known(live_pids.limit(0) if running_pids is None else running_pids, "_runs"), "scheduler_pid", "left")
    own = tasks.limit(0).select("task_id") if own_tasks is None else own_tasks.select("task_id").distinct()
    rows = rows.join(own.withColumn("_own", F.lit(True)), "task_id", "left")
    sure = F.coalesce("_own", F.lit(False)) | F.coalesce("_live", F.lit(False))
    healthy = sure | (F.coalesce("_runs", F.lit(False)) & fresh(F.col("heartbeat_at"), now))
    orphan = (F.col("status") == "running") & ~healthy
    empty = lambda c: F.when(F.col("_orphan"), None).otherwise(F.col(c))
    return rows.withColumns({"_orphan": orphan}).withColumns({"scheduler_pid": empty("scheduler_pid"), "started_at": empty("started_at"), "stage": F.when(F.col("_orphan"), REQUEUED).otherwise(F.col("stage"))}).withColumn("status", F.when(F.col("_orphan"), "pending").otherwise(F.col("status"))).select(*tasks.columns)


def clear_terminal(tasks: DataFrame, database: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): finished tasks, of one database if given, are removed."""
    gone = F.col("status").isin(*TERMINAL) & (F.lit(True) if database is None else F.col("database_name").eqNullSafe(database))
    return tasks.where(~gone), tasks.where(gone)


def purge_interactive(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Drop interactive tasks that ended more than ``hours`` ago."""
    old = (F.col("lane") == "interactive") & F.col("status").isin(*TERMINAL) & (F.col("completed_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    return tasks.where(~F.coalesce(old, F.lit(False)))


def list_tasks(tasks: DataFrame, database: str | None = None, status: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """Running, then pending, then the rest; newest first within each."""
    for column, value in (("database_name", database), ("status", status), ("kind", kind)):
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    return tasks.orderBy(F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).otherwise(2), F.desc("created_at"), "task_id").limit(limit)


def counts_by_status(tasks: DataFrame, database: str | None = None) -> DataFrame:
    """A row for each of the five statuses, 0 where there is no task."""
    if database is not None:
        tasks = tasks.where(F.col("database_name") == database)
    every = tasks.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def queue_positions(tasks: DataFrame) -> DataFrame:
    """Pending tasks ahead of each pending task, in both lanes; equal times are not ahead of each other.

    Tasks that were asked to stop are not ahead of others.  Ranked by counts per time, so ties and long queues need no single ordered
    partition of all tasks: only the distinct times are ordered, by day first.
    """
    waiting = tasks.where("status = 'pending' and created_at is not null")
    times = waiting.groupBy("created_at").agg(F.count_if(~F.coalesce("cancel_requested", F.lit(False))).alias("count")).withColumn("day", F.to_date("created_at"))
    inside = Window.partitionBy("day").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)
    days = times.groupBy("day").agg(F.sum("count").alias("count"))
    earlier = days.alias("d").join(days.alias("e"), F.col("e.day") < F.col("d.day"), "left").groupBy("d.day").agg(F.coalesce(F.sum("e.count"), F.lit(0)).alias("before"))
    ahead = times.withColumn("own", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(earlier, "day").select("created_at", (F.col("own") + F.col("before")).alias("position"))
    return tasks.where("status = 'pending'").join(ahead, "created_at", "left").select("task_id", "position")


def next_task(tasks: DataFrame, lane: str) -> DataFrame:
    """The task that a claim would take: oldest pending one of the lane, not asked to stop."""
    return tasks.where((F.col("status") == "pending") & (F.col("lane") == lane) & ~F.coalesce("cancel_requested", F.lit(False))).orderBy("created_at", "task_id").limit(1)


def display_groups(tasks: DataFrame) -> DataFrame:
    """Add group: running, pending or finished, as the screens list them."""
    return tasks.withColumn("group", F.when(F.col("status").isin(*TERMINAL), "finished").otherwise(F.col("status")))


def with_payloads(tasks: DataFrame, payloads: DataFrame) -> DataFrame:
    """Add each task's payload from its own table (task_id, payload), and whether a search task has none that is readable."""
    rows = tasks.join(payloads.groupBy("task_id").agg(F.max("payload").alias("payload")), "task_id", "left")
    search = F.col("kind").isin("batch_search", "interactive_search")
    readable = F.when(F.col("kind") == "batch_search", F.from_json("payload", "array<string>").isNotNull()).otherwise(F.get_json_object("payload", "$.query_image_path").isNotNull())
    return rows.withColumn("payload_unavailable", search & ~F.coalesce(readable, F.lit(False)))


def missing_payloads(tasks: DataFrame) -> DataFrame:
    """One row: search tasks whose payload is unavailable."""
    return tasks.agg(F.count_if("payload_unavailable").alias("missing_payloads"))


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def resume_after(items: DataFrame, last_index: int | None) -> DataFrame:
    return items if last_index is None else items.where(F.col("ord") > last_index)


def payload_queries(tasks: DataFrame) -> DataFrame:
    """(task_id, pos, path) of search tasks, first occurrence of each path."""
    rows = tasks.where(F.col("kind").isin("batch_search", "interactive_search")).select("task_id", F.posexplode(payload_paths(F.col("kind"), F.col("payload"))).alias("pos", "path"))
    return rows.groupBy("task_id", "path").agg(F.min("pos").alias("pos"))


def annotation_tasks(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """Summary of each search task, with a group for queries that no task names.

    ``progress`` has query_id, query_image_path, total, labeled and ord; of
    queries with the same path the last counts.
    """
    search = tasks.where(F.col("kind").isin("batch_search", "interactive_search"))
    last = progress.groupBy("query_image_path").agg(F.max_by(F.struct("query_id", "total", "labeled"), "ord").alias("q"))
    linked = payload_queries(search).join(last, F.col("path") == F.col("query_image_path"), "left").select("task_id", "q.query_id", "q.total", "q.labeled")
    real = linked.where("query_id is not null")
    done = F.count_if(query_status(F.col("total"), F.col("labeled")) == "completed")
    summed = real.groupBy("task_id").agg(F.count("*").alias("query_count"), done.alias("completed_count"))
    rows = search.select("task_id", "task_name", "created_at").join(summed, "task_id", "left")
    loose = progress.join(real.select("query_id").distinct(), "query_id", "left_anti").agg(F.count("*").alias("query_count"), done.alias("completed_count")).where("query_count > 0")
    loose = loose.select(F.lit(UNASSIGNED).alias("task_id"), F.lit(None).cast("string").alias("task_name"), F.lit(None).cast("timestamp").alias("created_at"), "query_count", "completed_count")
    rows = rows.unionByName(loose).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("query_count", "completed_count")})
    share = F.when(F.col("query_count") > 0, F.col("completed_count") / F.col("query_count")).otherwise(0.0)
    return rows.withColumn("annotation_progress", share).withColumn("annotatable", F.col("query_count") > 0)


def unassigned_queries(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """Queries whose path is in no payload, or hidden by a later query with the same path."""
    last = progress.groupBy("query_image_path").agg(F.max_by("query_id", "ord").alias("query_id"))
    named = payload_queries(tasks).join(last, F.col("path") == F.col("query_image_path")).select("query_id").distinct()
    return progress.join(named, "query_id", "left_anti")


def task_of_query(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """Newest task that names each query, else the group of the unassigned."""
    last = progress.groupBy("query_image_path").agg(F.max_by("query_id", "ord").alias("query_id"))
    named = payload_queries(tasks).join(last, F.col("path") == F.col("query_image_path")).join(tasks.select("task_id", "created_at"), "task_id")
    newest = named.groupBy("query_id").agg(F.max_by("task_id", F.struct("created_at", "task_id")).alias("task_id"))
    return progress.select("query_id").join(newest, "query_id", "left").select("query_id", F.coalesce("task_id", F.lit(UNASSIGNED)).alias("task_id"))


def choose_query(rows: DataFrame, preferred: str | None) -> DataFrame:
    """The preferred query if present, else the first that is not completed, else the first (one row)."""
    status = query_status(F.col("total"), F.col("labeled"))
    return rows.agg(
        F.coalesce(
            F.max(F.when(F.col("query_id") == F.lit(preferred), F.col("query_id"))), F.min_by(F.when(status != "completed", F.col("query_id")), F.when(status != "completed", F.col("ord"))), F.min_by("query_id", "ord")
        ).alias("query_id")
    )


def row_at(rows: DataFrame, n: int) -> DataFrame:
    """Row by its place; none outside the bounds."""
    return rows.where(F.col("ord") == n)


def align(paths: DataFrame, results: DataFrame) -> DataFrame:
    """Join results to queries by place; unequal lengths are an error."""
    if (a := paths.count()) != (b := results.count()):
        raise RuntimeError(f"{a} queries but {b} results")
    return paths.join(results, "ord")
