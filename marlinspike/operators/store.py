"""Result and annotation store as functions from tables to tables.

Writers return new tables; a caller writes them to a new version directory and
then swaps its pointer (``sources.sinks.VersionedTables``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import query_status, stable_id

QUERIES = (
    "query_id string, query_image_path string, database_name string, top_n int, config_preset string, config_yaml string, "
    "status string, created_at timestamp, updated_at timestamp, processing_time_ms double"
)
CANDIDATES = (
    "candidate_id string, query_id string, rank int, candidate_image_path string, match_type string, confidence_level string, overall_score double, "
    "text_score double, visual_score double, hash_distance int, label string, notes string, labeled_at timestamp, in_current_result boolean"
)
LABELS = ("hit", "miss", "skip")
PROGRESS = ("unlabeled", "partial", "no_hit", "no_candidates")


def upsert_queries(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Merge searches into the queries, keyed by database and path.

    A repeated search keeps query_id and created_at, takes the new settings, and
    goes back to unlabeled.  ``new`` has one row a key with query_image_path,
    database_name, top_n, config_preset, config_yaml and processing_time_ms.
    """
    key = ["database_name", "query_image_path"]
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    is_new = F.coalesce(F.col("n._new"), F.lit(False))
    pick = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce("o.query_id", stable_id(F.col("n.database_name"), F.col("n.query_image_path"))).alias("query_id"),
        F.coalesce("o.query_image_path", "n.query_image_path").alias("query_image_path"),
        F.coalesce("o.database_name", "n.database_name").alias("database_name"),
        pick("top_n"), pick("config_preset"), pick("config_yaml"),
        F.when(is_new, "unlabeled").otherwise(F.col("o.status")).alias("status"),
        F.coalesce("o.created_at", now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        pick("processing_time_ms"),
    )


def upsert_candidates(old: DataFrame, new: DataFrame, searched: DataFrame) -> DataFrame:
    """Merge the candidates of the searched queries, keyed by query and path.

    Scores and rank come from the new result; candidate_id, label, notes and
    labeled_at stay.  Old candidates of a searched query (``searched`` has
    query_id) that are not in the new result stay with in_current_result false;
    those of other queries are unchanged.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, (F.col("o.query_id") == F.col("n.query_id")) & (F.col("o.candidate_image_path") == F.col("n.candidate_image_path")), "full_outer")
    is_new = F.coalesce(F.col("n._new"), F.lit(False))
    pick = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    rows = both.select(
        F.coalesce("o.candidate_id", stable_id(F.col("n.query_id"), F.col("n.candidate_image_path"))).alias("candidate_id"),
        F.coalesce("o.query_id", "n.query_id").alias("query_id"), pick("rank"),
        F.coalesce("o.candidate_image_path", "n.candidate_image_path").alias("candidate_image_path"),
        *[pick(c) for c in ("match_type", "confidence_level", "overall_score", "text_score", "visual_score", "hash_distance")],
        F.col("o.label").alias("label"), F.col("o.notes").alias("notes"), F.col("o.labeled_at").alias("labeled_at"),
        F.col("o.in_current_result").alias("_was"), is_new.alias("_is"),
    )
    rows = rows.join(searched.select("query_id").distinct().withColumn("_searched", F.lit(True)), "query_id", "left")
    return rows.withColumn("in_current_result", F.when(F.col("_searched"), F.col("_is")).otherwise(F.coalesce("_was", F.col("_is")))).drop("_was", "_is", "_searched").select(*[f.split()[0] for f in CANDIDATES.split(", ")])


def apply_labels(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Last label event of each candidate wins, with its notes and time.

    ``events`` has query_id, candidate_id, label, notes, labeled_at and ord; a
    label outside hit, miss, skip fails, an unknown candidate changes nothing.
    """
    known = F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))))
    last = events.withColumn("label", known).groupBy("query_id", "candidate_id").agg(F.max_by(F.struct("label", "notes", "labeled_at"), F.struct("labeled_at", "ord")).alias("new"))
    rows = candidates.join(last, ["query_id", "candidate_id"], "left")
    return rows.withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("label", "notes", "labeled_at")}).select(*candidates.columns)


def refresh_status(queries: DataFrame, candidates: DataFrame, touched: DataFrame, now: Column | None = None) -> DataFrame:
    """Stored status, and time of the last change, of the queries whose labels were written; the others keep theirs.

    No current candidate without a label (or none at all) is completed.
    """
    counts = candidates.where("in_current_result").groupBy("query_id").agg(F.count("*").alias("n"), F.count("label").alias("labeled"))
    rows = queries.join(counts, "query_id", "left").join(touched.select("query_id").distinct().withColumn("_touched", F.lit(True)), "query_id", "left")
    n, labeled = F.coalesce("n", F.lit(0)), F.coalesce("labeled", F.lit(0))
    status = F.when(F.col("_touched"), F.when(n == labeled, "completed").when(labeled > 0, "partial").otherwise("unlabeled")).otherwise(F.col("status"))
    changed = F.when(F.col("_touched"), F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))
    return rows.withColumns({"status": status, "updated_at": changed}).select(*queries.columns)


def touch(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``new`` with updated_at set to ``now`` where a row differs from ``old`` but its writer left the time as it was."""
    others = [c for c in new.columns if c not in ("query_id", "updated_at")]
    before = old.select("query_id", F.struct(*others).alias("_old"), F.col("updated_at").alias("_time"), F.lit(True).alias("_was"))
    rows = new.join(before, "query_id", "left")
    stale = F.coalesce("_was", F.lit(False)) & F.col("updated_at").eqNullSafe(F.col("_time")) & ~F.struct(*others).eqNullSafe(F.col("_old"))
    return rows.withColumn("updated_at", F.when(stale, now).otherwise(F.col("updated_at"))).select(*new.columns)


def delete_queries(queries: DataFrame, candidates: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and their candidates without the given query_ids."""
    ids = gone.select("query_id")
    return queries.join(ids, "query_id", "left_anti"), candidates.join(ids, "query_id", "left_anti")


def stats_summary(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row, also over empty tables; candidates count with their history."""
    rows = queries.join(candidates.select("query_id", "candidate_id", "label"), "query_id", "left")
    out = rows.agg(
        F.count_distinct("query_id").alias("total_queries"),
        F.count_distinct(F.when(F.col("status") == "completed", F.col("query_id"))).alias("completed_queries"),
        F.count_distinct(F.when(F.col("status") == "unlabeled", F.col("query_id"))).alias("unlabeled_queries"),
        F.count("candidate_id").alias("total_candidates"),
        F.count("label").alias("labeled_candidates"),
        F.count_if(F.col("label") == "hit").alias("hit_count"),
        F.count_if(F.col("label") == "miss").alias("miss_count"),
    )
    return out.withColumn("hit_rate", F.when(F.col("labeled_candidates") > 0, F.col("hit_count") / F.col("labeled_candidates")).otherwise(0.0))


def candidate_stats(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query over its current result, with its status and time of creation; hit_rate is null without labels."""
    rows = queries.select("query_id", "query_image_path", "status", "created_at").join(candidates.where("in_current_result").select("query_id", "candidate_id", "label"), "query_id", "left")
    out = rows.groupBy("query_id", "query_image_path", "status", "created_at").agg(
        F.count("candidate_id").alias("total"), F.count("label").alias("labeled"),
        F.count_if(F.col("label") == "hit").alias("hits"), F.count_if(F.col("label") == "miss").alias("misses"), F.count_if(F.col("label") == "skip").alias("skips"),
    )
    return out.withColumn("hit_rate", F.when(F.col("labeled") > 0, F.col("hits") / F.col("labeled")))


def progress(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """total, labeled, hits and derived status of each query's current result."""
    rows = queries.select("query_id", "query_image_path", "created_at").join(candidates.where("in_current_result").select("query_id", "candidate_id", "label"), "query_id", "left")
    out = rows.groupBy("query_id", "query_image_path", "created_at").agg(F.count("candidate_id").alias("total"), F.count("label").alias("labeled"), F.count_if(F.col("label") == "hit").alias("hits"))
    return out.withColumn("derived_status", query_status(F.col("total"), F.col("labeled")))


def progress_filter(counts: DataFrame, kind: str | None) -> DataFrame:
    """Disjoint groups of queries; a completed query with a hit is in none of them."""
    total, labeled, hits = F.col("total"), F.col("labeled"), F.col("hits")
    conditions = {
        None: F.lit(True),
        "unlabeled": (total > 0) & (labeled == 0),
        "partial": (labeled > 0) & (labeled < total),
        "no_hit": (total > 0) & (labeled == total) & (hits == 0),
        "no_candidates": total == 0,
    }
    if kind not in conditions:
        raise ValueError(f"unknown progress filter: {kind}")
    return counts.where(conditions[kind])


def query_results(candidates: DataFrame, history: bool = False) -> DataFrame:
    """Candidates in display order; with history, current ones come first."""
    rows = candidates if history else candidates.where("in_current_result")
    return rows.orderBy("query_id", F.desc("in_current_result"), "match_type", "rank")


def readback(candidates: DataFrame) -> DataFrame:
    """Persisted current result of each query, in rank order."""
    return candidates.where("in_current_result").select(
        "query_id", "match_type", "rank", F.col("candidate_image_path").alias("image_path"), "confidence_level", "overall_score", "text_score", "visual_score", "hash_distance"
    ).orderBy("query_id", "rank")


def annotation_queue(queries: DataFrame, status: str | None = None) -> DataFrame:
    """Queries still to be annotated, oldest first."""
    wanted = F.col("status").isin("unlabeled", "partial") if status is None else F.col("status") == status
    return queries.where(wanted).orderBy("created_at", "query_id")


def next_unlabeled(queries: DataFrame, after: str | None = None) -> DataFrame:
    """Oldest query that is not completed and strictly younger than ``after``; none if that is unknown."""
    waiting = queries.where(F.col("status").isin("unlabeled", "partial"))
    if after is not None:
        # one row at most
        point = queries.where(F.col("query_id") == after).agg(F.max("created_at").alias("_after"))
        waiting = waiting.join(F.broadcast(point), F.col("created_at") > F.col("_after")).drop("_after")
    return waiting.orderBy("created_at", "query_id").limit(1)


def unlabeled_candidates(candidates: DataFrame) -> DataFrame:
    """Without a label, history included."""
    return candidates.where("label is null").orderBy("query_id", "match_type", "rank")


def validate_rows(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside an enumeration; null is allowed."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
