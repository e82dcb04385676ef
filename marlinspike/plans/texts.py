"""Text and name functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scores, text
from ..operators import edit_join
from ..sources import ingest
from .base import Registry, table

REGISTRY = Registry()


def _per_text(spark, d, **columns):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


@REGISTRY.add("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced, regexp_replace(text, '\\s+', '', 'g') AS dense FROM documents")
def text_normalize_ws(spark, d):
    return _per_text(spark, d, spaced=text.normalize_whitespace(F.col("text")), dense=text.remove_whitespace(F.col("text")))


@REGISTRY.add("SELECT doc_id, translate(translate(text, '.,!?', '。，！？'), '，。！？：；（）【】、', ',.!?:;()[],') AS marks FROM documents")
def text_normalize_punct(spark, d):
    wide = F.translate("text", ".,!?", "。，！？")
    return _per_text(spark, d, marks=text.normalize_punctuation(wide))


@REGISTRY.add("SELECT doc_id, nfc_normalize(lower(regexp_replace(regexp_replace(text, '[^\\pL\\pM\\p{Nd}\\pNl_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS plain FROM documents")
def text_strategies(spark, d):
    return _per_text(spark, d, plain=text.normalize_text(F.regexp_replace("text", "\\s+$", " "), ["remove_punctuation"])).select("doc_id", text.normalize_text(F.regexp_replace("plain", r"\s+", " "), ["to_lowercase", "normalize_unicode"]).alias("plain"))


_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@REGISTRY.add(
    f"""SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(other, '\\s+', ' ', 'g'))) AS same FROM (
    SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN translate(replace(text, ' ', '  '), '{_LETTERS[0]}', '{_LETTERS[1]}') WHEN 1 THEN text || ' x' ELSE replace(text, ' ', '') END AS other FROM documents)"""
)
def compare_normalized(spark, d):
    """Each text against another form of it: other case and spacing, a word more, or no spaces."""
    part = F.col("doc_id") % 3
    other = F.when(part == 0, F.translate(F.replace("text", F.lit(" "), F.lit("  ")), *_LETTERS)).when(part == 1, F.concat("text", F.lit(" x"))).otherwise(F.replace("text", F.lit(" "), F.lit("")))
    return table(spark, d, "documents").select("doc_id", text.same_normalized(F.col("text"), other, ["normalize_whitespace", "to_lowercase"]).alias("same"))


@REGISTRY.add(
    """SELECT doc_id, CASE WHEN cjk = 0 AND latin = 0 THEN 'unknown' WHEN cjk >= latin THEN 'zh' ELSE 'en' END AS guess FROM
    (SELECT doc_id, length(regexp_replace(mixed, '[^一-鿿]', '', 'g')) AS cjk, length(regexp_replace(mixed, '[^A-Za-z]', '', 'g')) AS latin FROM (
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '[A-Za-z]', '', 'g') ELSE translate(text, 'aeostn', '啊鹅哦丝特嗯') END AS mixed FROM documents))"""
)
def detect_language(spark, d):
    """Texts in which Chinese characters stand for about half the letters, or no letters are left: all classes occur."""
    mixed = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "[A-Za-z]", "")).otherwise(F.translate("text", "aeostn", "啊鹅哦丝特嗯"))
    return table(spark, d, "documents").select("doc_id", text.detect_language(mixed).alias("guess"))


EDITS = 5


@REGISTRY.add(
    f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM documents),
    c AS (SELECT min(doc_id) AS text_id, text, length(text) AS n FROM t WHERE text IS NOT NULL GROUP BY text),
    p AS (SELECT x, y, k FROM (SELECT a.text_id AS x, b.text_id AS y, CASE WHEN abs(a.n - b.n) <= {EDITS} THEN levenshtein(a.text, b.text) END AS k FROM c a JOIN c b ON a.text_id < b.text_id) WHERE k <= {EDITS}),
    counts AS (SELECT text_id, count(*) AS n_near, min(k) AS nearest FROM (SELECT x AS text_id, k FROM p UNION ALL SELECT y, k FROM p) GROUP BY text_id)
    SELECT doc_id, c.text_id, coalesce(n_near, 0) AS n_near, nearest FROM t LEFT JOIN c USING (text) LEFT JOIN counts ON counts.text_id = c.text_id"""
)
def near_texts(spark, d):
    """Each document's text class, and how many other texts are within EDITS edits, in characters that mean the same to the SQL."""
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return edit_join.near_counts(docs, "doc_id", "text", EDITS)


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"


@REGISTRY.add(
    f"""SELECT page_id, coalesce(nullif(regexp_extract({_PATH}, '[^/.][^/]*?(\\.[^./]+)$', 1), ''), '.jpg') AS extension,
    list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS name FROM pages"""
)
def url_extension(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_extension(F.col("url")).alias("extension"), text.base_name(F.col("url")).alias("name"))


@REGISTRY.add("SELECT min(page_id) AS ord, file_name, arg_min(url, page_id) AS url FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS file_name FROM pages) GROUP BY file_name")
def shard_merge_dedupe(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("file_name"), "url")
    return ingest.merge_shards(rows)


@REGISTRY.add("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND url <> ''")
def resume_antijoin(spark, d):
    """Pages still to fetch: labelled ids stand for finished ones."""
    todo, _ = ingest.download_plan(table(spark, d, "pages").select("page_id", F.col("url").alias("page_url")), table(spark, d, "labels").select(F.col("doc_id").alias("page_id")))
    return todo.select("page_id", F.col("page_url").alias("url"))


@REGISTRY.add(
    f"""SELECT page_id, page_id::VARCHAR || coalesce(nullif(regexp_extract({_PATH}, '[^/.][^/]*?(\\.[^./]+)$', 1), ''), '.jpg') AS file_name FROM pages
    WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND url <> ''"""
)
def resume_plan(spark, d):
    """The same pages with the name that each file gets, from its URL's suffix."""
    todo, _ = ingest.download_plan(table(spark, d, "pages").select("page_id", F.col("url").alias("page_url")), table(spark, d, "labels").select(F.col("doc_id").alias("page_id")))
    return todo.select("page_id", "file_name")


@REGISTRY.add("SELECT part, count(*) AS n FROM (SELECT CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'none' ELSE 'k' || (json_extract_string(props, '$.k')::INT // 10) END AS part FROM events) GROUP BY ALL")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy(F.when(k.isNull(), "none").otherwise(F.concat(F.lit("k"), F.floor(k.cast("int") / 10).cast("string"))).alias("part")).agg(F.count("*").alias("n"))


@REGISTRY.add(
    """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CASE WHEN value > 0 AND event_id > 0 THEN floor((1000000 - event_id) * value / event_id / 60)::INT END AS minutes,
    round(CASE WHEN event_id % 7 > 0 THEN least(100.0::DOUBLE, event_id * 100.0::DOUBLE / (event_id % 7 * 1000)) ELSE 0 END, 6) AS percent FROM events"""
)
def progress_arithmetic(spark, d):
    e = table(spark, d, "events")
    total = F.col("event_id") % 7 * 1000
    return e.select("event_id", scores.stamp(F.col("ts")).alias("stamp"), scores.eta_minutes(F.col("event_id"), F.lit(1_000_000), F.col("value")).alias("minutes"), F.round(scores.progress_percent(F.col("event_id"), total), 6).alias("percent"))


@REGISTRY.add(
    """SELECT event_id, move, CASE WHEN target BETWEEN 0 AND 99999 THEN target ELSE event_id END AS target FROM (
    SELECT event_id, move, CASE move WHEN 'left' THEN CASE WHEN event_id % 6 > 0 THEN event_id - 1 ELSE -1 END WHEN 'right' THEN CASE WHEN event_id % 6 < 5 THEN event_id + 1 ELSE -1 END WHEN 'up' THEN event_id - 6 ELSE event_id + 6 END AS target
    FROM events, (VALUES ('left'), ('right'), ('up'), ('down')) m(move))"""
)
def grid_moves(spark, d):
    e = table(spark, d, "events").select("event_id", F.explode(F.array(*map(F.lit, ("left", "right", "up", "down")))).alias("move"))
    return e.withColumn("target", scores.grid_move(F.col("event_id"), F.col("move"), 6, 100_000))


@REGISTRY.add(
    """WITH cells AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(coalesce(text, ''))) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, i::INT AS place, (CASE WHEN i % 3 > 0 THEN i - 1 ELSE i END)::INT AS "left", (CASE WHEN i % 3 < 2 AND i + 1 < n THEN i + 1 ELSE i END)::INT AS "right",
    (CASE WHEN i >= 3 THEN i - 3 ELSE i END)::INT AS up, (CASE WHEN i + 3 < n THEN i + 3 ELSE i END)::INT AS down FROM cells"""
)
def nav_targets(spark, d):
    """Targets of each place of the grids in which conversations show their messages, three a row."""
    every = Window.partitionBy("conv_id")
    order = every.orderBy("turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    cells = table(spark, d, "conversations").select("conv_id", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(every).alias("n"))
    return cells.select("conv_id", "place", scores.grid_targets(F.col("place"), 3, F.col("n")).alias("to")).select("conv_id", "place", "to.*")


@REGISTRY.add("SELECT strftime(ts, '%Y-%m-%d') AS batch, round(sum(value) / count(*), 4) AS mean_ms FROM events GROUP BY ALL")
def batch_times(spark, d):
    """Mean time of a query in each day's batch."""
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("batch")).agg(F.sum("value").alias("ms"), F.count("*").alias("n"))
    return days.select("batch", F.round(scores.batch_time(F.col("ms"), F.col("n")), 4).alias("mean_ms"))
