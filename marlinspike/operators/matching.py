"""The two matching paths, their combination, and the form of results.

Features follow the nested record: image_id, ord, extraction_success, error,
text_features (text_embedding, full_text, error) and image_features
(perceptual_hash, image_embedding, error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scores, text
from . import fingerprints, vectors
from .config import clamp_top_n

FEATURES = (
    "image_id string, ord long, extraction_success boolean, error string, "
    "text_features struct<text_embedding: array<float>, full_text: string, error: string>, "
    "image_features struct<perceptual_hash: string, image_embedding: array<float>, error: string>"
)


def vector_rows(features: DataFrame) -> DataFrame:
    """Rows for the vector index; independent of whether there is a hash."""
    return features.select("image_id", "ord", F.col("text_features.text_embedding").alias("vector")).where("vector is not null")


def hash_rows(features: DataFrame) -> DataFrame:
    """Rows for the fingerprint index; independent of whether there is a vector."""
    return features.select("image_id", "ord", F.col("image_features.perceptual_hash").alias("hash")).where("hash <> ''")


def failed_rows(features: DataFrame) -> DataFrame:
    """Outcome rows of failed extractions, in their places."""
    reason = F.coalesce("error", "text_features.error", "image_features.error", F.lit("extraction failed"))
    return features.where("not coalesce(extraction_success, false)").select("image_id", "ord", reason.alias("error"))


def build_stats(features: DataFrame) -> DataFrame:
    """One row: total_images, features_extracted (attempts), features_failed, text_vectors and hash_entries."""
    return features.agg(
        F.count("*").alias("total_images"),
        F.count("*").alias("features_extracted"),
        F.count_if(~F.coalesce("extraction_success", F.lit(False))).alias("features_failed"),
        F.count("text_features.text_embedding").alias("text_vectors"),
        F.count_if(F.col("image_features.perceptual_hash") != "").alias("hash_entries"),
    )


def verify_content(recalled: DataFrame, query_texts: DataFrame, corpus_texts: DataFrame, threshold: float, top_n: int) -> DataFrame:
    """Re-rank recalled pairs by 0.75 vector + 0.25 edit-distance similarity.

    ``recalled`` has query_id, image_id, ord, similarity; the texts have their
    id and full_text.  Pairs with an empty text are dropped.

    A pair's score lies between 0.75 vector and that plus 0.25 times the ratio
    of the lengths.  Pairs that cannot reach the threshold, or the ``top_n``-th
    of their query's lower ends, are dropped by the lengths alone, before any
    text is fetched.  The others are dealt over all tasks.
    """
    spark = recalled.sparkSession
    size = lambda df, key, name: df.select(key, F.length("full_text").alias(name)).where(F.col(name) > 0)
    rows = recalled.join(size(query_texts, "query_id", "q_size"), "query_id").join(size(corpus_texts, "image_id", "c_size"), "image_id")
    ratio = F.least("q_size", "c_size") / F.greatest("q_size", "c_size")
    rows = rows.withColumns({"low": 0.75 * F.col("similarity"), "high": 0.75 * F.col("similarity") + 0.25 * ratio})
    # a query has at most as many pairs as were recalled for it
    lows = F.collect_list("low").over(Window.partitionBy("query_id"))
    floor = F.coalesce(F.get(F.sort_array(lows, asc=False), F.lit(top_n - 1)), F.lit(float("-inf")))
    rows = rows.withColumn("floor", floor).where(F.col("high") >= F.greatest(F.col("floor"), F.lit(threshold)) - 1e-9).drop("low", "high", "floor", "q_size", "c_size")
    # only now the texts, of the pairs that are left
    rows = rows.join(query_texts.select("query_id", F.col("full_text").alias("q_text")), "query_id").join(corpus_texts.select("image_id", F.col("full_text").alias("c_text")), "image_id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, F.xxhash64("query_id", "image_id"))
    rows = rows.withColumn("text_similarity", 1 - text.edit_distance(F.col("q_text"), F.col("c_text")) / F.greatest(F.length("q_text"), F.length("c_text")))
    rows = rows.withColumn("final_score", scores.final_score(F.col("similarity"), F.col("text_similarity"))).where(F.col("final_score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "vector_rank")
    rows = rows.withColumn("channel_rank", F.row_number().over(order)).where(F.col("channel_rank") <= top_n)
    return rows.select("query_id", "image_id", "ord", F.col("similarity").alias("vector_similarity"), "text_similarity", "final_score", "channel_rank")


def content_matches(corpus: DataFrame, queries: DataFrame, recall_k: int, recall_threshold: float, threshold: float, top_n: int, search=None) -> DataFrame:
    """Recall by vectors, then verify.  Both inputs have vector and full_text."""
    found = (search or (lambda q, k, t: vectors.search(corpus, q, k, t)))(queries, recall_k, recall_threshold)
    return verify_content(found, queries, corpus, threshold, top_n)


_MATCH = ["query_id", "image_id", "ord", "match_type", "similarity", "confidence", "distance", "vector_similarity", "text_similarity", "final_score", "channel_rank"]


def combine(exact: DataFrame, content: DataFrame, top_n: int) -> DataFrame:
    """Union in which an exact match hides the content match of the same pair.

    Ranked by similarity, exact first on ties, then by the rank within the
    channel; total_matches counts the union before this cut.
    """
    e = exact.select(
        "query_id", "image_id", "ord", F.lit("exact").alias("match_type"), F.col("confidence").alias("similarity"), "confidence", F.col("distance").cast("int").alias("distance"),
        F.lit(None).cast("double").alias("vector_similarity"), F.lit(None).cast("double").alias("text_similarity"), F.lit(None).cast("double").alias("final_score"), "channel_rank",
    )
    c = content.join(exact.select("query_id", "image_id"), ["query_id", "image_id"], "left_anti").select(
        "query_id", "image_id", "ord", F.lit("content").alias("match_type"), F.col("final_score").alias("similarity"), F.col("final_score").alias("confidence"), F.lit(None).cast("int").alias("distance"),
        "vector_similarity", "text_similarity", "final_score", "channel_rank",
    )
    rows = e.select(*_MATCH).unionByName(c.select(*_MATCH))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.when(F.col("match_type") == "exact", 0).otherwise(1), "channel_rank")
    rows = rows.withColumn("total_matches", F.count("*").over(Window.partitionBy("query_id"))).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= top_n)


def match(corpus: DataFrame, queries: DataFrame, config: dict, search=None) -> DataFrame:
    """Dual-path match of all queries in one plan.

    ``corpus`` has image_id, ord, hash, vector, full_text; ``queries`` have
    query_id, hash, vector, full_text.  A path that the configuration turns off
    adds no work.
    """
    matching = config["matching"]
    n = clamp_top_n(matching.get("output", {}).get("top_k", 3))
    spark = corpus.sparkSession
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), corpus.schema["image_id"].dataType.simpleString()
    exact_conf, content_conf = matching.get("exact_match", {}), matching.get("content_match", {})
    if exact_conf.get("enabled", True):
        exact = fingerprints.exact_matches(corpus.select("image_id", "ord", "hash"), queries, exact_conf.get("hash_max_distance", 5), n)
    else:
        exact = spark.createDataFrame([], f"query_id {q_type}, image_id {c_type}, ord long, distance int, confidence double, channel_rank int")
    if content_conf.get("enabled", True):
        stage1 = content_conf.get("stage1", {})
        content = content_matches(corpus, queries, stage1.get("top_k", 100), stage1.get("threshold", 0.75), content_conf.get("final_threshold", 0.85), n, search)
    else:
        content = spark.createDataFrame([], f"query_id {q_type}, image_id {c_type}, ord long, vector_similarity double, text_similarity double, final_score double, channel_rank int")
    return combine(exact, content, n)


def format_results(matches: DataFrame) -> DataFrame:
    """Result rows by bucket: rank counts within the match type; visual_score is the vector similarity."""
    overall = F.coalesce("similarity", "confidence", F.lit(0.0))
    order = Window.partitionBy("query_id", "match_type").orderBy("rank")
    return matches.select(
        "query_id", "match_type", F.row_number().over(order).alias("type_rank"), F.col("image_id").alias("image_path"), scores.confidence_level(overall).alias("confidence_level"),
        overall.alias("overall_score"), F.col("text_similarity").alias("text_score"), F.col("vector_similarity").alias("visual_score"), F.col("distance").alias("hash_distance"),
    )


def merge_buckets(exact: DataFrame, content: DataFrame) -> DataFrame:
    """One candidate list from two buckets, with match_type and rank filled in."""
    e = exact.withColumn("match_type", F.lit("exact")).withColumn("bucket", F.lit(0))
    c = content.withColumn("match_type", F.lit("content")).withColumn("bucket", F.lit(1))
    both = e.unionByName(c, allowMissingColumns=True)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("bucket", "place"))).drop("bucket")


def query_stats(results: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Batch statistics.

    ``results`` has query_id, rank, similarity; ``queries`` has query_id and
    processing_time_ms.  Means at ranks 1 to 3 are over the queries that have
    that rank, 0 if none has.
    """
    tops = [F.when(F.col("rank") == r, F.col("similarity")) for r in (1, 2, 3)]
    # one row a query, so that the matches are worked out once
    found = results.groupBy("query_id").agg(F.lit(1).alias("hit"), *[f(x).alias(f"{name}{r}") for r, x in enumerate(tops, 1) for f, name in ((F.sum, "sum"), (F.count, "n"))])
    asked = queries.groupBy("query_id").agg(F.count("*").alias("asked"), F.sum("processing_time_ms").alias("ms"), F.count("processing_time_ms").alias("timed"))
    mean = lambda total, n, digits: F.coalesce(scores.rounded(F.try_divide(F.sum(total), F.sum(n)), digits), F.lit(0.0))
    base = asked.join(found, "query_id", "full").agg(
        F.coalesce(F.sum("asked"), F.lit(0)).alias("total_queries"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("asked"))), F.lit(0)).alias("matched_queries"), mean("ms", "timed", 2).alias("avg_time_ms"),
        *[mean(f"sum{r}", f"n{r}", 4).alias(f"avg_top{r}_similarity") for r in (1, 2, 3)],
    )
    share = F.when(F.col("total_queries") > 0, F.format_string("%.2f%%", F.col("matched_queries") * F.lit(100.0) / F.col("total_queries"))).otherwise("0%")
    return base.select("total_queries", "matched_queries", share.alias("match_rate"), "avg_time_ms", F.lit(top_k).alias("top_k"), "avg_top1_similarity", "avg_top2_similarity", "avg_top3_similarity")


# Extensions of the published specification ------------------------------------------------


def also_exact(matches: DataFrame, exact: DataFrame) -> DataFrame:
    """Extension: flag content matches that the exact path finds as well."""
    return matches.join(exact.select("query_id", "image_id", F.lit(True).alias("also_exact_match")), ["query_id", "image_id"], "left").withColumn("also_exact_match", F.coalesce("also_exact_match", F.lit(False)))


def top_per_type(matches: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Extension: a limit of its own for each match type; types without one are not cut."""
    order = Window.partitionBy("query_id", "match_type").orderBy("rank")
    limit = F.lit(2**31 - 1)
    for kind, n in limits.items():
        limit = F.when(F.col("match_type") == kind, n).otherwise(limit)
    return matches.withColumn("type_rank", F.row_number().over(order)).where(F.col("type_rank") <= limit)
