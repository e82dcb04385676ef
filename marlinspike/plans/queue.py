"""Task queries: events stand for tasks, conversations for their payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import tasks
from ..streaming import jobs
from .base import Registry, table

REGISTRY = Registry()
_NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(_NOW).cast("timestamp")


def task_table(spark, d) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("task_id"), F.when(F.col("event_id") % 3 == 0, "interactive_search").otherwise("batch_search").alias("kind"), F.lit("task").alias("task_name"),
        F.concat(F.lit("db"), (F.col("user_id") % 5).cast("string")).alias("database_name"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, "interactive").otherwise("background").alias("lane"),
        F.lit(100).alias("total_items"), F.floor("value").cast("int").alias("processed_items"), F.lit(0).alias("failed_items"), F.lit(0.0).alias("progress_percentage"), F.floor("value").cast("int").alias("last_processed_index"),
        F.lit(None).cast("string").alias("stage"), (F.col("event_id") % 11 == 0).alias("cancel_requested"), F.date_trunc("hour", ts).alias("created_at"), ts.alias("started_at"),
        F.when(status.isin(*tasks.TERMINAL), ts).alias("completed_at"), ts.alias("heartbeat_at"), F.col("user_id").alias("scheduler_pid"),
    )


_TASKS = """
t AS (SELECT 't' || event_id AS task_id, 'db' || (user_id % 5) AS database_name, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'interactive' ELSE 'background' END AS lane, floor(value)::INT AS processed, event_id % 11 = 0 AS cancel_requested, date_trunc('hour', ts) AS created_at, ts, user_id AS pid FROM events)"""


@REGISTRY.add(
    f"""WITH {_TASKS} SELECT task_id, status FROM t WHERE database_name = 'db1' ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, created_at DESC, task_id LIMIT 200"""
)
def task_list_order(spark, d):
    return tasks.list_tasks(task_table(spark, d), database="db1").select("task_id", "status")


@REGISTRY.add(f"WITH {_TASKS} SELECT s.status, count(t.task_id) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) s(status) LEFT JOIN t USING (status) GROUP BY ALL")
def task_counts(spark, d):
    return tasks.counts_by_status(task_table(spark, d))


@REGISTRY.add(f"WITH {_TASKS} SELECT a.task_id, (SELECT count(*) FROM t b WHERE b.status = 'pending' AND NOT b.cancel_requested AND b.created_at < a.created_at) AS position FROM t a WHERE a.status = 'pending'")
def queue_position(spark, d):
    return tasks.queue_positions(task_table(spark, d))


@REGISTRY.add(f"""WITH {_TASKS} SELECT task_id, status FROM t WHERE status = 'pending' AND lane = 'interactive' ORDER BY created_at DESC, task_id LIMIT 200""")
def task_list_filtered(spark, d):
    return tasks.list_tasks(task_table(spark, d), status="pending", kind="interactive_search").select("task_id", "status")


@REGISTRY.add(f"WITH {_TASKS} SELECT CASE WHEN status IN ('running', 'pending') THEN status ELSE 'finished' END AS \"group\", count(*) AS n FROM t GROUP BY ALL")
def display_groups(spark, d):
    return tasks.display_groups(task_table(spark, d)).groupBy("group").agg(F.count("*").alias("n"))


@REGISTRY.add(f"WITH {_TASKS} SELECT task_id FROM t WHERE status = 'pending' AND lane = 'interactive' AND NOT cancel_requested ORDER BY created_at, task_id LIMIT 1")
def next_task(spark, d):
    return tasks.next_task(task_table(spark, d), "interactive").select("task_id")


@REGISTRY.add(f"WITH {_TASKS} SELECT task_id, round(CASE WHEN length(task_id) % 2 = 0 THEN least(100.0::DOUBLE, (processed * 2) * 100.0::DOUBLE / 40) ELSE least(100.0::DOUBLE, (processed * 2)::DOUBLE) END, 6) AS percent FROM t")
def progress_pct(spark, d):
    t = task_table(spark, d)
    even = F.length("task_id") % 2 == 0
    updates = t.select("task_id", (F.col("processed_items") * 2).alias("processed"), F.when(even, 40).alias("total"), F.lit(None).cast("int").alias("failed"), F.lit(None).cast("int").alias("last_index"), F.lit("searching").alias("stage"))
    return tasks.update_progress(t, updates).select("task_id", F.round("progress_percentage", 6).alias("percent"))


@REGISTRY.add(f"WITH {_TASKS} SELECT task_id, CASE WHEN cancel_requested AND status = 'running' THEN 'completed' ELSE status END AS status, CASE WHEN cancel_requested AND status = 'running' THEN 100.0::DOUBLE ELSE 0 END AS percent FROM t")
def task_finish(spark, d):
    t = task_table(spark, d)
    done = t.where("cancel_requested and status = 'running'").select("task_id", F.lit("completed").alias("outcome"), F.lit(None).cast("string").alias("stage"))
    return tasks.finish(t, done, now()).select("task_id", "status", F.col("progress_percentage").alias("percent"))


@REGISTRY.add(f"WITH {_TASKS} SELECT CASE WHEN lane = 'interactive' AND status = 'pending' THEN 'cancelled' ELSE status END AS status, cancel_requested OR (lane = 'interactive' AND status IN ('pending', 'running')) AS flagged, count(*) AS n FROM t GROUP BY ALL")
def task_cancel(spark, d):
    t = task_table(spark, d)
    return tasks.request_cancel(t, t.where("lane = 'interactive'"), now()).groupBy("status", F.col("cancel_requested").alias("flagged")).agg(F.count("*").alias("n"))


@REGISTRY.add(
    f"""WITH {_TASKS}, live AS (SELECT DISTINCT pid FROM t WHERE pid % 4 = 0), os AS (SELECT DISTINCT pid FROM t WHERE pid % 2 = 0),
    lost AS (
      SELECT task_id FROM t WHERE status = 'running' AND pid NOT IN (SELECT pid FROM live) AND pid NOT IN (SELECT pid FROM os)
      UNION ALL SELECT task_id FROM t WHERE status = 'running' AND pid NOT IN (SELECT pid FROM live) AND pid IN (SELECT pid FROM os) AND date_diff('microsecond', ts, TIMESTAMP '{_NOW}') >= 90000000)
    SELECT t.task_id, 'pending' AS status, NULL::BIGINT AS pid, processed AS last_processed_index, '{tasks.REQUEUED}' AS stage, true AS never_started FROM t JOIN lost USING (task_id)
    UNION ALL SELECT task_id, status, pid, processed, NULL, false FROM t WHERE task_id NOT IN (SELECT task_id FROM lost)"""
)
def orphan_recovery(spark, d):
    """A quarter of the pids are known schedulers, whatever their heartbeat; another quarter only run, so their heartbeat decides."""
    t = task_table(spark, d)
    pids = t.select(F.col("scheduler_pid").alias("pid")).distinct()
    found = tasks.recover_orphans(t, pids.where("pid % 4 = 0"), now(), pids.where("pid % 2 = 0"))
    return found.select("task_id", "status", F.col("scheduler_pid").alias("pid"), "last_processed_index", "stage", F.col("started_at").isNull().alias("never_started"))


@REGISTRY.add(f"WITH {_TASKS} SELECT task_id FROM t WHERE NOT (lane = 'interactive' AND status IN ('completed', 'failed', 'cancelled') AND ts < TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR)")
def ttl_purge(spark, d):
    return tasks.purge_interactive(task_table(spark, d), now()).select("task_id")


@REGISTRY.add(f"WITH {_TASKS} SELECT task_id FROM t WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND database_name = 'db2')")
def clear_terminal(spark, d):
    return tasks.clear_terminal(task_table(spark, d), "db2")[0].select("task_id")


def payload_tasks(spark, d) -> DataFrame:
    path = F.concat(F.lit("/q/"), ((F.col("conv_id") * 7 + F.col("turn")) % 3000).cast("string"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", path.alias("p")))).alias("l"))
    listed, kind = F.transform("l", lambda x: x["p"]), F.when(F.col("conv_id") % 3 == 0, "interactive_search").when(F.col("conv_id") % 3 == 1, "batch_search").otherwise("index_build")
    payload = F.when(kind == "interactive_search", F.to_json(F.struct(listed[0].alias("query_image_path")))).otherwise(F.to_json(listed))
    return rows.select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("task_id"), F.lit("task").alias("task_name"), kind.alias("kind"), payload.alias("payload"), F.timestamp_seconds(F.col("conv_id") * 60).alias("created_at"))


def query_progress(spark, d) -> DataFrame:
    """Documents stand for queries; labelled ones are done."""
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, d, "documents").join(known, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("ord"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), F.concat(F.lit("/q/"), F.col("doc_id").cast("string")).alias("query_image_path"), F.lit(2).alias("total"), F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("labeled"))


_LINKS = """
pq AS (SELECT DISTINCT 't' || conv_id AS task_id, conv_id, '/q/' || ((conv_id * 7 + turn) % 3000) AS path FROM conversations WHERE conv_id % 3 = 1 OR (conv_id % 3 = 0 AND turn = (SELECT min(m.turn) FROM conversations m WHERE m.conv_id = conversations.conv_id))),
pr AS (SELECT 'q' || doc_id AS query_id, '/q/' || doc_id AS path, CASE WHEN max(quality) = 1 THEN 2 WHEN max(quality) = 0 THEN 1 ELSE 0 END AS labeled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id),
li AS (SELECT pq.task_id, pq.conv_id, pr.query_id, pr.labeled FROM pq JOIN pr USING (path))"""


@REGISTRY.add(
    f"""WITH {_LINKS}, s AS (SELECT DISTINCT 't' || conv_id AS task_id FROM conversations WHERE conv_id % 3 <> 2)
    SELECT s.task_id, count(li.query_id) AS query_count, count(*) FILTER (li.labeled = 2) AS completed_count, round(CASE WHEN count(li.query_id) > 0 THEN count(*) FILTER (li.labeled = 2) / count(li.query_id)::DOUBLE ELSE 0 END, 6) AS annotation_progress, count(li.query_id) > 0 AS annotatable
    FROM s LEFT JOIN li USING (task_id) GROUP BY s.task_id
    UNION ALL SELECT '__unassigned__', count(*), count(*) FILTER (labeled = 2), round(count(*) FILTER (labeled = 2) / count(*)::DOUBLE, 6), true FROM pr WHERE query_id NOT IN (SELECT query_id FROM li) HAVING count(*) > 0"""
)
def annotation_tasks(spark, d):
    rows = tasks.annotation_tasks(payload_tasks(spark, d), query_progress(spark, d))
    return rows.select("task_id", "query_count", "completed_count", F.round("annotation_progress", 6).alias("annotation_progress"), "annotatable")


@REGISTRY.add(
    """WITH p AS (SELECT conv_id, min(turn) AS first_turn FROM conversations GROUP BY conv_id)
    SELECT count(*) FILTER (conv_id % 3 <> 2 AND (conv_id % 4 = 0 OR conv_id % 4 = 1)) AS missing_payloads FROM p"""
)
def missing_payloads(spark, d):
    """Of the payloads a quarter is not there and another one cannot be read."""
    t = payload_tasks(spark, d)
    number = F.substring("task_id", 2, 20).cast("long") % 4
    off_row = t.where(number != 0).select("task_id", F.when(number == 1, "{broken").otherwise(F.col("payload")).alias("payload"))
    return tasks.missing_payloads(tasks.with_payloads(t.drop("payload"), off_row))


@REGISTRY.add(f"WITH {_LINKS} SELECT query_id FROM pr WHERE query_id NOT IN (SELECT query_id FROM li)")
def unassigned_queries(spark, d):
    return tasks.unassigned_queries(payload_tasks(spark, d), query_progress(spark, d)).select("query_id")


@REGISTRY.add(f"WITH {_LINKS} SELECT query_id, coalesce('t' || max(conv_id), '__unassigned__') AS task_id FROM pr LEFT JOIN li USING (query_id) GROUP BY query_id")
def task_of_query(spark, d):
    return tasks.task_of_query(payload_tasks(spark, d), query_progress(spark, d))


def state_events(spark, d) -> DataFrame:
    kinds = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "purchase", "completed").otherwise("cancel")
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.hour("ts").cast("string")).alias("task_id"), F.col("event_id").alias("ord"), kinds.alias("event"), F.floor("value").cast("long").alias("processed"), F.col("ts").cast("timestamp").alias("ts"))


@REGISTRY.add(
    """WITH RECURSIVE e AS (
      SELECT 'u' || user_id || '-' || hour(ts) AS task_id, row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY ts, event_id) AS n, event_type, floor(value)::BIGINT AS processed, ts FROM events),
    s AS (
      SELECT task_id, 0::BIGINT AS n, '' AS status FROM e WHERE n = 1
      UNION ALL SELECT s.task_id, e.n, CASE WHEN s.status IN ('completed', 'cancelled') THEN s.status WHEN event_type = 'error' THEN CASE WHEN s.status IN ('', 'pending') THEN 'cancelled' ELSE s.status END
        WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'completed' WHEN s.status = '' THEN 'pending' ELSE s.status END
      FROM s JOIN e ON e.task_id = s.task_id AND e.n = s.n + 1)
    SELECT task_id, arg_max(status, s.n) AS status, greatest(0, max(processed)) AS processed, max(ts) AS ts FROM s JOIN e USING (task_id) GROUP BY task_id"""
)
def stream_state_final(spark, d):
    return jobs.final_states(state_events(spark, d))


@REGISTRY.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(rows).withColumn("total", F.round("total", 4))
