"""Search queries: ids divisible by 100 are queries against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bits, scores, text
from ..operators import config, fingerprints, matching, vectors
from ..sources import sinks
from .base import Registry, table

REGISTRY = Registry()
K, RECALL, FINAL, RADIUS, TOP = 10, 0.2, 0.2, 20, 5
CONFIG = config.deep_merge(
    config.preset("balanced"),
    config.search_config(
        {
            "matching.exact_match.hash_max_distance": RADIUS,
            "matching.content_match.stage1.threshold": RECALL,
            "matching.content_match.stage1.top_k": K,
            "matching.content_match.final_threshold": FINAL,
            "matching.output.top_k": TOP,
        }
    ),
)


def vector_corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))


def as_queries(corpus: DataFrame) -> DataFrame:
    return corpus.where("image_id % 100 = 0").drop("ord").withColumnRenamed("image_id", "query_id")


def hash_corpus(spark: SparkSession, d: str) -> DataFrame:
    return vector_corpus(spark, d).select("image_id", "ord", bits.difference_hash(F.col("vector")).alias("hash"))


def full_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Vector, hash and whole text of each item."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.col("text").alias("full_text"))
    return vector_corpus(spark, d).withColumn("hash", bits.difference_hash(F.col("vector"))).join(texts, "image_id")


def ascii_corpus(spark: SparkSession, d: str) -> DataFrame:
    """full_corpus with ? for characters above ASCII: DuckDB's edit distance counts bytes, so only then it means the same."""
    return full_corpus(spark, d).withColumn("full_text", F.regexp_replace("full_text", r"[^\x00-\x7F]", "?"))


_KNN = f"""
knn AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, image_id) AS vector_rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS image_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity
    FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
  QUALIFY vector_rank <= {K}
)"""
_KNN_COLUMNS = ["query_id", "image_id", "vector_rank"]


def _knn(rows: DataFrame) -> DataFrame:
    return rows.select(*_KNN_COLUMNS, F.round("similarity", 6).alias("similarity"))


_KNN_SQL = f"WITH {_KNN} SELECT query_id, image_id, vector_rank::INT AS vector_rank, round(similarity, 6) AS similarity FROM knn"


@REGISTRY.add(_KNN_SQL)
def knn_topk(spark, d):
    corpus = vector_corpus(spark, d)
    return _knn(vectors.search(corpus, as_queries(corpus), K))


@REGISTRY.add(_KNN_SQL)
def knn_topk_plain(spark, d):
    corpus = vector_corpus(spark, d)
    return _knn(vectors.search_plain(corpus, as_queries(corpus), K))


@REGISTRY.add(f"{_KNN_SQL} WHERE similarity >= {RECALL}")
def knn_topk_threshold(spark, d):
    corpus = vector_corpus(spark, d)
    return _knn(vectors.search(corpus, as_queries(corpus), K, RECALL))


@REGISTRY.add(_KNN_SQL)
def ivf_full_probe(spark, d):
    corpus = vector_corpus(spark, d)
    centres = vectors.train_cells(corpus, 16)
    return _knn(vectors.search_cells(vectors.assign_cells(corpus, centres), centres, as_queries(corpus), K, len(centres)))


@REGISTRY.add()
def ivf_search(spark, d):
    """Inverted lists, of which as many are visited as a calibration on the index asks for."""
    corpus = vector_corpus(spark, d)
    return _knn(vectors.choose_search("IVFFlat", corpus, lists=16, k=K)(as_queries(corpus), K))


@REGISTRY.add()
def pq_search(spark, d):
    """Product quantisation, with the best by codes ranked again by their vectors."""
    corpus = vector_corpus(spark, d)
    books = vectors.train_codebooks(corpus, 16, 6)
    return _knn(vectors.search_codes(vectors.encode(corpus, books), books, as_queries(corpus), K, corpus=corpus))


@REGISTRY.add()
def ivfpq_search(spark, d):
    """Codes of residuals in inverted lists, of which only those that are visited are read."""
    return _knn(vectors.choose_search("IVFPQ", vector_corpus(spark, d), lists=16, parts=16, k=K, code_bits=6)(as_queries(vector_corpus(spark, d)), K))


@REGISTRY.add()
def planes_search(spark, d):
    """Approximate search by random planes, in the place of a graph."""
    corpus = vector_corpus(spark, d)
    return _knn(vectors.search_planes(corpus, as_queries(corpus), K))


@REGISTRY.add("SELECT count(*) AS ntotal, 64 AS dimension, count(*) * 256 AS memory_bytes FROM embeddings WHERE embedding IS NOT NULL")
def vector_index_stats(spark, d):
    return vectors.stats(vector_corpus(spark, d), 64)


_BITS = """
bits AS (SELECT vec_id, array_to_string([CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END FOR i IN range(1, 64)], '') || '0' AS b FROM embeddings)"""
_PAIRS = f"""
near AS (
  SELECT q.vec_id AS query_id, c.vec_id AS image_id, hamming(q.b, c.b) AS distance FROM bits q, bits c WHERE q.vec_id % 100 = 0 AND hamming(q.b, c.b) <= {RADIUS}
)"""
_NEAR_SQL = f"WITH {_BITS}, {_PAIRS} SELECT query_id, image_id, distance::INT AS distance FROM near"


@REGISTRY.add(_NEAR_SQL)
def hamming_radius(spark, d):
    corpus = hash_corpus(spark, d)
    return fingerprints.radius_join(corpus, as_queries(corpus), RADIUS).select("query_id", "image_id", F.col("distance").cast("int").alias("distance"))


@REGISTRY.add(_NEAR_SQL)
def hamming_radius_banded(spark, d):
    corpus = hash_corpus(spark, d)
    return fingerprints.radius_join_banded(corpus, as_queries(corpus), RADIUS).select("query_id", "image_id", F.col("distance").cast("int").alias("distance"))


_CLOSE = 12


@REGISTRY.add(f"WITH {_BITS} SELECT q.vec_id AS query_id, c.vec_id AS image_id, hamming(q.b, c.b)::INT AS distance FROM bits q, bits c WHERE hamming(q.b, c.b) <= {_CLOSE}")
def hamming_pairs(spark, d):
    """Every fingerprint against all, by multi-index hashing or by blocks, whichever costs less."""
    corpus = hash_corpus(spark, d)
    rows = fingerprints.radius_join_indexed(corpus, corpus.drop("ord").withColumnRenamed("image_id", "query_id"), _CLOSE)
    return rows.select("query_id", "image_id", F.col("distance").cast("int").alias("distance"))


_HEX = "md5(text)"


def _text_hashes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("ord"), F.md5(F.col("text").cast("binary")).alias("hash"))


@REGISTRY.add(f"SELECT q.doc_id AS query_id, c.doc_id AS image_id FROM documents q JOIN documents c ON {_HEX.replace('text', 'q.text')} = {_HEX.replace('text', 'c.text')} WHERE q.doc_id % 100 = 0")
def hash_lookup(spark, d):
    corpus = _text_hashes(spark, d)
    return fingerprints.lookup(corpus, as_queries(corpus)).select("query_id", "image_id")


@REGISTRY.add(
    f"""SELECT count(*) AS unique_hashes, sum(n)::BIGINT AS total_entries, sum(n - 1)::BIGINT AS collisions_added, count(*) FILTER (n > 1) AS collisions_loaded, round(avg(n), 6) AS avg_entries_per_hash
    FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY {_HEX})"""
)
def hash_index_stats(spark, d):
    return fingerprints.index_stats(_text_hashes(spark, d)).withColumn("avg_entries_per_hash", F.round("avg_entries_per_hash", 6))


_EXACT = f"""
exact AS (
  SELECT *, greatest(0.0::DOUBLE, 1 - distance / 256.0::DOUBLE) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY distance, first_ord, image_id) AS channel_rank
  FROM near JOIN (SELECT vec_id AS image_id, min(vec_id) OVER (PARTITION BY b) AS first_ord FROM bits) USING (image_id) QUALIFY channel_rank <= {TOP}
)"""


@REGISTRY.add(f"WITH {_BITS}, {_PAIRS}, {_EXACT} SELECT query_id, image_id, distance::INT AS distance, round(confidence, 6) AS confidence, channel_rank::INT AS channel_rank FROM exact")
def exact_match_confidence(spark, d):
    corpus = hash_corpus(spark, d)
    rows = fingerprints.exact_matches(corpus, as_queries(corpus), RADIUS, TOP)
    return rows.select("query_id", "image_id", F.col("distance").cast("int").alias("distance"), F.round("confidence", 6).alias("confidence"), "channel_rank")


@REGISTRY.add(
    """WITH items AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM benchmark)
    SELECT q.item_id AS query_id, c.item_id AS image_id, round(1 - levenshtein(q.text, c.text) / greatest(length(q.text), length(c.text))::DOUBLE, 6) AS text_similarity
    FROM items q, items c WHERE q.item_id % 100 = 0 AND q.text <> '' AND c.text <> ''"""
)
def levenshtein_similarity(spark, d):
    """Items divisible by 100 against all items, the former broadcast in blocks of at most vectors.PLAIN_QUERIES or so."""
    items = table(spark, d, "benchmark").where("text <> ''").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    q = items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("q_text"))
    c, out = items.select(F.col("item_id").alias("image_id"), "text"), None
    blocks = -(-q.count() // vectors.PLAIN_QUERIES) or 1
    for number in range(blocks):
        mine = F.broadcast(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number))
        part = c.join(mine, F.lit(True)).select("query_id", "image_id", F.round(text.text_similarity(F.col("q_text"), F.col("text")), 6).alias("text_similarity"))
        out = part if out is None else out.unionByName(part)
    return out


_CONTENT = f"""
texts AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS full_text FROM documents),
pairs AS (
  SELECT k.*, levenshtein(a.full_text, b.full_text) AS edits, greatest(length(a.full_text), length(b.full_text)) AS longest
  FROM knn k JOIN texts a ON a.doc_id = k.query_id JOIN texts b ON b.doc_id = k.image_id WHERE similarity >= {RECALL} AND a.full_text <> '' AND b.full_text <> ''
),
content AS (
  SELECT *, 0.75::DOUBLE * similarity + 0.25::DOUBLE * text_similarity AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY 0.75::DOUBLE * similarity + 0.25::DOUBLE * text_similarity DESC, vector_rank) AS channel_rank
  FROM (SELECT *, 1 - edits / longest::DOUBLE AS text_similarity FROM pairs) WHERE 0.75::DOUBLE * similarity + 0.25::DOUBLE * text_similarity >= {FINAL} QUALIFY channel_rank <= {TOP}
)"""
# vectors of items without a document are no part of this corpus
_CORPUS_KNN = _KNN.replace("FROM embeddings q, embeddings c WHERE", "FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT doc_id FROM documents) AND c.vec_id IN (SELECT doc_id FROM documents) AND")


@REGISTRY.add(
    f"WITH {_CORPUS_KNN}, {_CONTENT} SELECT query_id, image_id, round(similarity, 6) AS vector_similarity, round(text_similarity, 6) AS text_similarity, round(final_score, 6) AS final_score, channel_rank::INT AS channel_rank FROM content"
)
def content_match(spark, d):
    corpus = ascii_corpus(spark, d)
    rows = matching.content_matches(corpus, as_queries(corpus), K, RECALL, FINAL, TOP)
    return rows.select("query_id", "image_id", *[F.round(c, 6).alias(c) for c in ("vector_similarity", "text_similarity", "final_score")], "channel_rank")


_COMBINED = f"""
both_paths AS (
  SELECT query_id, image_id, 'exact' AS match_type, confidence AS similarity, distance, NULL::DOUBLE AS vector_similarity, NULL::DOUBLE AS text_similarity, channel_rank, 0 AS prio FROM exact
  UNION ALL SELECT query_id, image_id, 'content', final_score, NULL, similarity, text_similarity, channel_rank, 1 FROM content c
  WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = c.query_id AND e.image_id = c.image_id)
),
combined AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS total_matches, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, prio, channel_rank) AS rank FROM both_paths QUALIFY rank <= {TOP}
)"""
_CORPUS_BITS = _BITS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")
_FULL = f"WITH {_CORPUS_BITS}, {_PAIRS}, {_EXACT}, {_CORPUS_KNN}, {_CONTENT}, {_COMBINED}"


@REGISTRY.add(f"{_FULL} SELECT query_id, image_id, match_type, round(similarity, 6) AS similarity, total_matches, rank::INT AS rank FROM combined")
def combined_match(spark, d):
    corpus = ascii_corpus(spark, d)
    return matching.match(corpus, as_queries(corpus), CONFIG).select("query_id", "image_id", "match_type", F.round("similarity", 6).alias("similarity"), "total_matches", "rank")


_LEVEL = "CASE WHEN similarity >= 0.8 THEN 'HIGH' WHEN similarity >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"


@REGISTRY.add(
    f"""{_FULL} SELECT query_id, match_type, (row_number() OVER (PARTITION BY query_id, match_type ORDER BY rank))::INT AS type_rank, image_id AS image_path, {_LEVEL} AS confidence_level,
    round(similarity, 6) AS overall_score, round(text_similarity, 6) AS text_score, round(vector_similarity, 6) AS visual_score, distance::INT AS hash_distance FROM combined"""
)
def dual_path_formatted(spark, d):
    """Both paths, combined and formatted, on texts that mean the same to the SQL."""
    return _dual_path(ascii_corpus(spark, d))


def _dual_path(corpus: DataFrame) -> DataFrame:
    rows = matching.format_results(matching.match(corpus, as_queries(corpus), CONFIG))
    return rows.withColumns({c: F.round(c, 6) for c in ("overall_score", "text_score", "visual_score")})


@REGISTRY.add()
def dual_path_full_text(spark, d):
    """The flagship: both paths, combined and formatted, on the texts as they are."""
    return _dual_path(full_corpus(spark, d))


@REGISTRY.add(
    f"""{_FULL} SELECT query_id, rank::INT AS rank, image_id AS image_path, image_id::VARCHAR AS file_name, match_type, distance::INT AS distance, round(similarity, 4) AS similarity,
    round(similarity, 4) AS confidence, round(vector_similarity, 4) AS vector_similarity, round(text_similarity, 4) AS text_similarity,
    CASE WHEN match_type = 'content' THEN round(similarity, 4) END AS final_score FROM combined"""
)
def result_files(spark, d):
    """Rows of the result files of a batch."""
    corpus = ascii_corpus(spark, d)
    return sinks.result_rows(matching.match(corpus, as_queries(corpus), CONFIG))


@REGISTRY.add(
    f"""WITH {_CORPUS_BITS}, {_PAIRS}, {_EXACT}, {_CORPUS_KNN}, {_CONTENT}, places AS (
      SELECT query_id, image_id, 'exact' AS match_type, 0 AS bucket, channel_rank FROM exact UNION ALL SELECT query_id, image_id, 'content', 1, channel_rank FROM content)
    SELECT query_id, image_id, match_type, (row_number() OVER (PARTITION BY query_id ORDER BY bucket, channel_rank))::INT AS rank FROM places"""
)
def merged_buckets(spark, d):
    corpus = ascii_corpus(spark, d)
    queries = as_queries(corpus)
    exact = fingerprints.exact_matches(corpus.select("image_id", "ord", "hash"), queries, RADIUS, TOP).select("query_id", "image_id", F.col("channel_rank").alias("place"))
    content = matching.content_matches(corpus, queries, K, RECALL, FINAL, TOP).select("query_id", "image_id", F.col("channel_rank").alias("place"))
    return matching.merge_buckets(exact, content).select("query_id", "image_id", "match_type", "rank")


@REGISTRY.add(f"{_FULL} SELECT confidence_level, count(*) AS n FROM (SELECT {_LEVEL} AS confidence_level FROM combined) GROUP BY ALL")
def confidence_buckets(spark, d):
    return dual_path_formatted(spark, d).groupBy("confidence_level").agg(F.count("*").alias("n"))


@REGISTRY.add(
    f"""{_FULL}, times AS (SELECT vec_id AS query_id, vec_id / 8.0::DOUBLE AS ms FROM embeddings WHERE vec_id % 100 = 0 AND vec_id IN (SELECT doc_id FROM documents))
    SELECT (SELECT count(*) FROM times) AS total_queries, (SELECT count(DISTINCT query_id) FROM combined) AS matched_queries,
    printf('%.2f%%', 100.0::DOUBLE * (SELECT count(DISTINCT query_id) FROM combined) / (SELECT count(*) FROM times)) AS match_rate, (SELECT round(avg(ms), 2) FROM times) AS avg_time_ms, {TOP} AS top_k,
    coalesce(round(avg(similarity) FILTER (rank = 1), 4), 0) AS avg_top1_similarity, coalesce(round(avg(similarity) FILTER (rank = 2), 4), 0) AS avg_top2_similarity, coalesce(round(avg(similarity) FILTER (rank = 3), 4), 0) AS avg_top3_similarity FROM combined"""
)
def query_stats(spark, d):
    corpus = ascii_corpus(spark, d)
    queries = as_queries(corpus)
    times = queries.select("query_id", (F.col("query_id") / 8.0).alias("processing_time_ms"))
    return matching.query_stats(matching.match(corpus, queries, CONFIG), times, TOP)


@REGISTRY.add(
    """SELECT count(*) AS total_images, count(*) AS features_extracted, count(*) FILTER (text IS NULL OR length(text) < 20) AS features_failed, count(embedding) AS text_vectors,
    count(*) FILTER (text IS NOT NULL AND text <> '') AS hash_entries FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""
)
def build_stats(spark, d):
    """Feature records: vectors where there are any, text hashes as fingerprints, very short texts as failures."""
    rows = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    features = rows.select(
        F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").alias("ord"), F.coalesce(F.length("text") >= 20, F.lit(False)).alias("extraction_success"), F.lit(None).cast("string").alias("error"),
        F.struct(F.col("embedding").alias("text_embedding"), F.col("text").alias("full_text"), F.lit(None).cast("string").alias("error")).alias("text_features"),
        F.struct(F.when(F.col("text") != "", F.md5(F.col("text").cast("binary"))).alias("perceptual_hash"), F.lit(None).cast("array<float>").alias("image_embedding"), F.lit(None).cast("string").alias("error")).alias("image_features"),
    )
    return matching.build_stats(features)


@REGISTRY.add("SELECT contrast, count(*) AS n FROM (SELECT CASE WHEN vec_id % 100 < 70 THEN 'green' WHEN vec_id % 100 < 90 THEN 'yellow' ELSE 'red' END AS contrast FROM embeddings) GROUP BY ALL")
def load_colors(spark, d):
    return table(spark, d, "embeddings").select(scores.load_color(F.col("vec_id") % 100, 70, 90).alias("contrast")).groupBy("contrast").agg(F.count("*").alias("n"))
