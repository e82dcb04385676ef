"""Store queries: orders stand for searches, line items for their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import store
from ..sources import sinks
from .base import Registry, table

REGISTRY = Registry()


def queries_table(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial").otherwise("unlabeled")
    return table(spark, d, "orders").select(
        F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("query_id"), F.concat(F.lit("/q/"), F.col("o_orderkey").cast("string")).alias("query_image_path"), F.col("o_orderpriority").alias("database_name"),
        F.lit(10).alias("top_n"), F.lit("balanced").alias("config_preset"), F.lit(None).cast("string").alias("config_yaml"), status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_totalprice") / 1000).alias("processing_time_ms"),
    )


def candidates_table(spark, d) -> DataFrame:
    """One candidate for each order and part; of repeated line items the smallest values count."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(*[F.min(c).alias(c) for c in ("l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")])
    label = F.when(F.col("l_returnflag") == "A", "hit").when(F.col("l_returnflag") == "R", "miss")
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("candidate_id"), F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query_id"),
        F.col("l_linenumber").alias("rank"), F.concat(F.lit("/c/"), F.col("l_partkey").cast("string")).alias("candidate_image_path"), F.when(F.col("l_linenumber") % 2 == 1, "exact").otherwise("content").alias("match_type"),
        F.lit("HIGH").alias("confidence_level"), (1 - F.col("l_discount")).alias("overall_score"), F.col("l_tax").alias("text_score"), F.lit(None).cast("double").alias("visual_score"), F.lit(None).cast("int").alias("hash_distance"),
        label.alias("label"), F.lit(None).cast("string").alias("notes"), F.when(label.isNotNull(), F.col("l_shipdate").cast("timestamp")).alias("labeled_at"), (F.col("l_linestatus") == "O").alias("in_current_result"),
    )


_TABLES = """
q AS (SELECT 'q' || o_orderkey AS query_id, '/q/' || o_orderkey AS query_image_path, o_orderpriority AS database_name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'unlabeled' END AS status,
  o_orderdate AS created_at, o_totalprice / 1000 AS processing_time_ms FROM orders),
c AS (SELECT l_orderkey || '-' || l_partkey AS candidate_id, 'q' || l_orderkey AS query_id, min(l_linenumber) AS rank, '/c/' || l_partkey AS candidate_image_path,
  CASE WHEN min(l_linenumber) % 2 = 1 THEN 'exact' ELSE 'content' END AS match_type, 1 - min(l_discount) AS overall_score, CASE min(l_returnflag) WHEN 'A' THEN 'hit' WHEN 'R' THEN 'miss' END AS label,
  min(l_linestatus) = 'O' AS in_current_result, min(l_shipdate) AS shipdate FROM lineitem GROUP BY l_orderkey, l_partkey)"""
_PROGRESS = """
p AS (SELECT q.query_id, q.query_image_path, q.created_at, count(c.candidate_id) AS total, count(c.label) AS labeled, count(*) FILTER (c.label = 'hit') AS hits
  FROM q LEFT JOIN c ON q.query_id = c.query_id AND c.in_current_result GROUP BY ALL)"""


@REGISTRY.add(
    f"""WITH {_TABLES} SELECT count(DISTINCT q.query_id) AS total_queries, count(DISTINCT CASE WHEN status = 'completed' THEN q.query_id END) AS completed_queries,
    count(DISTINCT CASE WHEN status = 'unlabeled' THEN q.query_id END) AS unlabeled_queries, count(candidate_id) AS total_candidates, count(label) AS labeled_candidates,
    count(*) FILTER (label = 'hit') AS hit_count, count(*) FILTER (label = 'miss') AS miss_count, round(count(*) FILTER (label = 'hit') / count(label)::DOUBLE, 6) AS hit_rate
    FROM q LEFT JOIN c USING (query_id)"""
)
def stats_summary(spark, d):
    return store.stats_summary(queries_table(spark, d), candidates_table(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6))


@REGISTRY.add(
    f"""WITH {_TABLES} SELECT q.query_id, q.query_image_path, q.status, q.created_at, count(c.candidate_id) AS total, count(c.label) AS labeled, count(*) FILTER (c.label = 'hit') AS hits, count(*) FILTER (c.label = 'miss') AS misses,
    count(*) FILTER (c.label = 'skip') AS skips, round(CASE WHEN count(c.label) > 0 THEN count(*) FILTER (c.label = 'hit') / count(c.label)::DOUBLE END, 6) AS hit_rate
    FROM q LEFT JOIN c ON q.query_id = c.query_id AND c.in_current_result GROUP BY ALL"""
)
def candidate_stats(spark, d):
    return store.candidate_stats(queries_table(spark, d), candidates_table(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6))


_FILTERS = {
    "unlabeled": "total > 0 AND labeled = 0",
    "partial": "labeled > 0 AND labeled < total",
    "no_hit": "total > 0 AND labeled = total AND hits = 0",
    "no_candidates": "total = 0",
}


def _progress_query(kind):
    @REGISTRY.add(f"WITH {_TABLES}, {_PROGRESS} SELECT query_id, total, labeled, hits FROM p WHERE {_FILTERS[kind]}", name=f"progress_{kind}")
    def run(spark, d):
        return store.progress_filter(store.progress(queries_table(spark, d), candidates_table(spark, d)), kind).select("query_id", "total", "labeled", "hits")

    return run


for _kind in _FILTERS:
    _progress_query(_kind)


@REGISTRY.add(
    f"""WITH {_TABLES}, {_PROGRESS} SELECT derived_status, count(*) AS n FROM (SELECT CASE WHEN total = 0 THEN 'no_candidates' WHEN labeled = 0 THEN 'unlabeled' WHEN labeled < total THEN 'partial' ELSE 'completed' END AS derived_status FROM p) GROUP BY ALL"""
)
def derived_status(spark, d):
    return store.progress(queries_table(spark, d), candidates_table(spark, d)).groupBy("derived_status").agg(F.count("*").alias("n"))


@REGISTRY.add(f"WITH {_TABLES} SELECT query_id, status, created_at FROM q WHERE status IN ('unlabeled', 'partial')")
def annotation_queue(spark, d):
    return store.annotation_queue(queries_table(spark, d)).select("query_id", "status", "created_at")


@REGISTRY.add(f"WITH {_TABLES} SELECT query_id, created_at FROM q WHERE status IN ('unlabeled', 'partial') AND created_at > (SELECT max(created_at) FROM q WHERE query_id = 'q5') ORDER BY created_at, query_id LIMIT 1")
def next_unlabeled(spark, d):
    return store.next_unlabeled(queries_table(spark, d), "q5").select("query_id", "created_at")


@REGISTRY.add(f"WITH {_TABLES} SELECT candidate_id, query_id, match_type, rank FROM c WHERE label IS NULL")
def unlabeled_candidates(spark, d):
    return store.unlabeled_candidates(candidates_table(spark, d)).select("candidate_id", "query_id", "match_type", "rank")


@REGISTRY.add(f"WITH {_TABLES} SELECT query_id, match_type, rank, candidate_image_path AS image_path, round(overall_score, 6) AS overall_score FROM c WHERE in_current_result")
def result_readback(spark, d):
    return store.readback(candidates_table(spark, d)).select("query_id", "match_type", "rank", "image_path", F.round("overall_score", 6).alias("overall_score"))


def _second_search(spark, d):
    """A second search: every order with an even key is searched again, finding its parts on even lines and one new one."""
    q, c = queries_table(spark, d), candidates_table(spark, d)
    again = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("query_id"))
    searched = q.join(again, "query_id").select("query_image_path", "database_name", F.lit(20).alias("top_n"), F.lit("aggressive").alias("config_preset"), F.lit(None).cast("string").alias("config_yaml"), F.lit(1.5).alias("processing_time_ms"))
    fields = ("match_type", "confidence_level", "overall_score", "text_score", "visual_score", "hash_distance")
    found = c.join(again, "query_id").where("rank % 2 = 0").select("query_id", (F.col("rank") + 100).alias("rank"), "candidate_image_path", *fields)
    fresh = again.select("query_id", F.lit(1).alias("rank"), F.lit("/c/new").alias("candidate_image_path"), F.lit("content").alias("match_type"), F.lit("LOW").alias("confidence_level"), F.lit(0.25).alias("overall_score"), F.lit(None).cast("double").alias("text_score"), F.lit(None).cast("double").alias("visual_score"), F.lit(None).cast("int").alias("hash_distance"))
    return q, c, again, searched, found.unionByName(fresh)


_EVEN = "substr(query_id, 2)::BIGINT % 2 = 0"


@REGISTRY.add(f"WITH {_TABLES} SELECT query_id, query_image_path, CASE WHEN {_EVEN} THEN 20 ELSE 10 END AS top_n, CASE WHEN {_EVEN} THEN 'unlabeled' ELSE status END AS status, created_at FROM q")
def result_upsert_queries(spark, d):
    q, _, _, searched, _ = _second_search(spark, d)
    return store.upsert_queries(q, searched, F.lit("2030-01-01").cast("timestamp")).select("query_id", "query_image_path", "top_n", "status", "created_at")


_UPSERTED = f"""{_TABLES}, u AS (
  SELECT query_id, candidate_image_path, CASE WHEN {_EVEN} AND rank % 2 = 0 THEN rank + 100 ELSE rank END AS rank, label, CASE WHEN {_EVEN} THEN rank % 2 = 0 ELSE in_current_result END AS in_current_result FROM c
  UNION ALL SELECT query_id, '/c/new', 1, NULL, true FROM q WHERE {_EVEN})"""


@REGISTRY.add(f"WITH {_UPSERTED} SELECT * FROM u")
def result_upsert(spark, d):
    _, c, again, _, new = _second_search(spark, d)
    return store.upsert_candidates(c, new, again).select("query_id", "candidate_image_path", "rank", "label", "in_current_result")


@REGISTRY.add(f"WITH {_UPSERTED} SELECT in_current_result, label, count(*) AS n FROM u GROUP BY ALL")
def stale_flag(spark, d):
    return result_upsert(spark, d).groupBy("in_current_result", "label").agg(F.count("*").alias("n"))


_LABELED = f"""{_TABLES}, e AS (SELECT candidate_id, query_id, CASE WHEN rank % 3 = 0 THEN 'skip' WHEN rank % 3 = 1 THEN 'hit' ELSE 'miss' END AS label FROM c WHERE rank > 2),
l AS (SELECT c.candidate_id, c.query_id, coalesce(e.label, c.label) AS label, c.in_current_result FROM c LEFT JOIN e USING (candidate_id))"""


def _labeled(spark, d):
    c = candidates_table(spark, d)
    first = c.where("rank > 2").select("query_id", "candidate_id", F.lit("miss").alias("label"), F.lit("first").alias("notes"), F.lit("2030-01-01").cast("timestamp").alias("labeled_at"), F.lit(0).alias("ord"))
    value = F.when(F.col("rank") % 3 == 0, "skip").when(F.col("rank") % 3 == 1, "hit").otherwise("miss")
    second = c.where("rank > 2").select("query_id", "candidate_id", value.alias("label"), F.lit("second").alias("notes"), F.lit("2030-01-01").cast("timestamp").alias("labeled_at"), F.lit(1).alias("ord"))
    events = first.unionByName(second)
    return store.apply_labels(c, events), events


@REGISTRY.add(f"WITH {_LABELED} SELECT candidate_id, label FROM l")
def label_last_write(spark, d):
    return _labeled(spark, d)[0].select("candidate_id", "label")


@REGISTRY.add(
    f"""WITH {_LABELED}, n AS (SELECT query_id, count(*) FILTER (in_current_result) AS n, count(label) FILTER (in_current_result) AS labeled FROM l GROUP BY ALL)
    SELECT q.query_id, CASE WHEN q.query_id IN (SELECT query_id FROM e) THEN CASE WHEN n = labeled THEN 'completed' WHEN labeled > 0 THEN 'partial' ELSE 'unlabeled' END ELSE q.status END AS status,
    CASE WHEN q.query_id IN (SELECT query_id FROM e) THEN TIMESTAMP '2031-01-01' ELSE q.created_at END AS updated_at FROM q LEFT JOIN n USING (query_id)"""
)
def status_refresh(spark, d):
    labeled, events = _labeled(spark, d)
    return store.refresh_status(queries_table(spark, d), labeled, events, F.lit("2031-01-01").cast("timestamp")).select("query_id", "status", "updated_at")


@REGISTRY.add(f"WITH {_TABLES} SELECT query_id, CASE WHEN status = 'partial' THEN TIMESTAMP '2032-01-01' WHEN status = 'unlabeled' THEN TIMESTAMP '2033-01-01' ELSE created_at END AS updated_at FROM q")
def touch_updated(spark, d):
    """Of two kinds of changed queries one sets the time itself; unchanged ones keep theirs."""
    q, at = queries_table(spark, d), lambda day: F.lit(day).cast("timestamp")
    new = q.withColumns({"top_n": F.when(F.col("status") == "completed", F.col("top_n")).otherwise(15), "updated_at": F.when(F.col("status") == "unlabeled", at("2033-01-01")).otherwise(F.col("updated_at"))})
    return store.touch(q, new, at("2032-01-01")).select("query_id", "updated_at")


@REGISTRY.add(f"WITH {_TABLES} SELECT c.query_id, candidate_id, in_current_result, match_type, rank FROM c")
def result_history(spark, d):
    """All candidates, those of earlier results too."""
    return store.query_results(candidates_table(spark, d), history=True).select("query_id", "candidate_id", "in_current_result", "match_type", "rank")


@REGISTRY.add(f"WITH {_TABLES} SELECT count(*) AS n_queries, (SELECT count(*) FROM c JOIN q USING (query_id) WHERE database_name <> '1-URGENT') AS n_candidates FROM q WHERE database_name <> '1-URGENT'")
def delete_cascade(spark, d):
    q = queries_table(spark, d)
    c = candidates_table(spark, d).join(q.select("query_id"), "query_id", "left_semi")
    left, cands = store.delete_queries(q, c, q.where("database_name = '1-URGENT'"))
    return left.agg(F.count("*").alias("n_queries")).join(F.broadcast(cands.agg(F.count("*").alias("n_candidates"))), F.lit(True))


@REGISTRY.add(f"WITH {_TABLES} SELECT q.query_id, q.status, c.rank, c.candidate_image_path, c.match_type, c.label FROM q JOIN c USING (query_id) WHERE status IN ('partial', 'completed')")
def export_flat(spark, d):
    rows = sinks.export_flat(sinks.export_scope(queries_table(spark, d), "labeled"), candidates_table(spark, d))
    return rows.select("query_id", "status", "rank", "candidate_image_path", "match_type", "label")


@REGISTRY.add(
    f"""WITH {_TABLES}, r AS (SELECT q.query_id, c.candidate_id, row_number() OVER (PARTITION BY q.query_id ORDER BY match_type, rank, candidate_image_path) - 1 AS pos, candidate_image_path
      FROM q LEFT JOIN c USING (query_id) WHERE q.created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31')
    SELECT query_id, CASE WHEN candidate_id IS NOT NULL THEN pos::INT END AS pos, candidate_image_path FROM r"""
)
def export_nested_flat(spark, d):
    rows = sinks.export_nested(sinks.export_scope(queries_table(spark, d), "all", ("1996-01-01", "1998-12-31")), candidates_table(spark, d))
    return rows.select("query_id", F.posexplode_outer("candidates").alias("pos", "c")).select("query_id", "pos", "c.candidate_image_path")


@REGISTRY.add(
    f"""WITH {_TABLES}, s AS (SELECT count(DISTINCT q.query_id) AS a, count(DISTINCT CASE WHEN status = 'completed' THEN q.query_id END) AS b, count(DISTINCT CASE WHEN status = 'unlabeled' THEN q.query_id END) AS c1,
      count(candidate_id) AS d, count(label) AS e, count(*) FILTER (label = 'hit') AS f, count(*) FILTER (label = 'miss') AS g FROM q LEFT JOIN c USING (query_id))
    SELECT unnest(['Total Queries', 'Completed Queries', 'Unlabeled Queries', 'Total Candidates', 'Labeled Candidates', 'Hit Candidates', 'Miss Candidates', 'Hit Rate']) AS "Metric",
    unnest([a::VARCHAR, b::VARCHAR, c1::VARCHAR, d::VARCHAR, e::VARCHAR, f::VARCHAR, g::VARCHAR, printf('%.2f%%', 100.0::DOUBLE * f / e)]) AS "Value" FROM s"""
)
def export_statistics(spark, d):
    return sinks.workbook(queries_table(spark, d), candidates_table(spark, d), "db")["Statistics"]


@REGISTRY.add(
    f"""WITH {_TABLES}, kept AS (SELECT * FROM q WHERE status = 'completed')
    SELECT unnest(['Export Date', 'Database', 'Export Scope', 'Total Queries Exported', 'Total Candidates Exported']) AS "Field",
    unnest(['2024-05-06T07:08:09.000000Z', 'db', 'completed', (SELECT count(*) FROM kept)::VARCHAR, (SELECT count(*) FROM kept JOIN c USING (query_id))::VARCHAR]) AS "Value" """
)
def export_metadata(spark, d):
    return sinks.workbook(queries_table(spark, d), candidates_table(spark, d), "db", "completed", now=F.lit("2024-05-06 07:08:09").cast("timestamp"))["Metadata"]


@REGISTRY.add(f"""WITH {_TABLES} SELECT q.query_id AS "Query ID", c.rank AS "Rank", c.candidate_image_path AS "Candidate Image", c.match_type AS "Match Type", c.label AS "Label" FROM q JOIN c USING (query_id)""")
def export_candidate_sheet(spark, d):
    return sinks.workbook(queries_table(spark, d), candidates_table(spark, d), "db")["Candidates"].select("Query ID", "Rank", "Candidate Image", "Match Type", "Label")
