"""Writers: exports, index artefacts and versioned tables."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import fingerprints, matching, store
from .batches import Batches, files as _files

EXPORT_FIELDS = ("rank", "candidate_image_path", "match_type", "confidence_level", "overall_score", "text_score", "visual_score", "hash_distance", "label", "notes", "labeled_at")


#: The titles of the workbook's columns and figures.
_QUERY_SHEET = {
    "Query ID": "query_id", "Query Image": "query_image_path", "Database": "database_name", "Top N": "top_n", "Status": "status", "Created At": "created_at", "Processing Time (ms)": "processing_time_ms",
}
_CANDIDATE_SHEET = {
    "Query ID": "query_id", "Rank": "rank", "Candidate Image": "candidate_image_path", "Match Type": "match_type", "Confidence": "confidence_level", "Overall Score": "overall_score",
    "Text Score": "text_score", "Visual Score": "visual_score", "Hash Distance": "hash_distance", "Label": "label", "Notes": "notes", "Labeled At": "labeled_at",
}
_STATISTICS = (
    ("Total Queries", "total_queries"), ("Completed Queries", "completed_queries"), ("Unlabeled Queries", "unlabeled_queries"), ("Total Candidates", "total_candidates"),
    ("Labeled Candidates", "labeled_candidates"), ("Hit Candidates", "hit_count"), ("Miss Candidates", "miss_count"),
)


def export_scope(queries: DataFrame, scope: str = "all", dates: tuple[str, str] | None = None) -> DataFrame:
    """Queries of an export: all, labeled (partial or completed) or completed; an unknown scope means all."""
    if scope == "labeled":
        queries = queries.where(F.col("status").isin("partial", "completed"))
    elif scope == "completed":
        queries = queries.where("status = 'completed'")
    return queries if dates is None else queries.where(F.col("created_at").between(*[F.lit(d).cast("timestamp") for d in dates]))


def export_nested(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a query with all its candidates, history included; an empty list without any."""
    fields = [F.col(f"c.{c}").alias(c) for c in ("match_type", "rank", *[x for x in EXPORT_FIELDS if x not in ("match_type", "rank")])]
    rows = queries.alias("q").join(candidates.alias("c"), F.col("q.query_id") == F.col("c.query_id"), "left")
    packed = F.array_sort(F.collect_list(F.when(F.col("c.query_id").isNotNull(), F.struct(*fields)))).alias("candidates")
    keys = [F.col(f"q.{c}").alias(c) for c in ("query_id", "query_image_path", "database_name", "status", "created_at", "processing_time_ms")]
    return rows.groupBy(*keys).agg(packed)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line with nulls written out, in order of creation."""
    rows.orderBy("created_at", "query_id").write.option("ignoreNullFields", "false").json(path)


def export_flat(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a candidate; queries without candidates have none."""
    q = queries.select("query_id", "query_image_path", "database_name", "status", F.col("created_at").alias("query_created_at"))
    return q.join(candidates.select("query_id", *EXPORT_FIELDS), "query_id")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_csv_file(rows: DataFrame, path: str) -> int:
    """One local CSV file with a byte-order mark, streamed through the driver; returns its rows."""
    import csv

    count = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        for row in rows.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            count += 1
    return count


def workbook(queries: DataFrame, candidates: DataFrame, name: str, scope: str = "all", dates: tuple[str, str] | None = None, now: Column | None = None) -> dict[str, DataFrame]:
    """The four sheets of the workbook export as frames: Queries, Candidates, Statistics and Metadata.

    The first two hold the queries of the scope; the statistics are over all.
    """
    kept = export_scope(queries, scope, dates)
    listed = lambda df, columns: df.select(*[F.col(c).alias(title) for title, c in columns.items()])
    rows = export_flat(kept, candidates)
    pairs = lambda one_row, key, names: one_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), c.cast("string").alias("Value")) for n, c in names])).alias("x")).select("x.*")
    stats = pairs(store.stats_summary(queries, candidates), "Metric", [(n, F.col(c)) for n, c in _STATISTICS] + [("Hit Rate", F.format_string("%.2f%%", F.col("hit_rate") * 100))])
    # one row each
    totals = kept.agg(F.count("*").alias("queries")).join(F.broadcast(rows.agg(F.count("*").alias("candidates"))), F.lit(True))
    when = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    meta = pairs(totals, "Field", [("Export Date", when), ("Database", F.lit(name)), ("Export Scope", F.lit(scope)), ("Total Queries Exported", F.col("queries")), ("Total Candidates Exported", F.col("candidates"))])
    return {"Queries": listed(kept, _QUERY_SHEET), "Candidates": listed(rows, _CANDIDATE_SHEET), "Statistics": stats, "Metadata": meta}


def sheet_counts(sheets: dict[str, DataFrame]) -> dict[str, int]:
    return {title: rows.count() for title, rows in sheets.items()}


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """XLSX of the sheets; needs openpyxl, which is not part of Spark."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("writing XLSX needs the openpyxl package") from e
    book = Workbook()
    book.remove(book.active)
    for title, rows in sheets.items():
        sheet = book.create_sheet(title)
        sheet.append(rows.columns)
        widths = [len(c) for c in rows.columns]
        for row in rows.toLocalIterator():
            sheet.append([str(v) if isinstance(v, datetime) else v for v in row])
            widths = [max(w, len(str(v or ""))) for w, v in zip(widths, row, strict=True)]
        for column, width in zip(sheet.columns, widths, strict=True):
            sheet.column_dimensions[column[0].column_letter].width = min(50, width + 2)
        sheet.freeze_panes = "A2"
    book.save(path)


def export_name(database: str, extension: str, scope: str, now: datetime) -> str:
    return f"{re.sub(r'[^\w-]', '_', database)}_{scope}_{now:%Y%m%d_%H%M%S}.{extension}"


def write_hashes(index: DataFrame, path: str, form: str = "parquet") -> None:
    if form not in ("parquet", "json"):
        raise ValueError(f"unknown format: {form}")
    getattr(index.write, form)(path)


INDEX_SCHEMAS = {"vectors": "image_id string, ord long, vector array<float>", "hashes": "image_id string, ord long, hash string"}


def write_index(features: DataFrame, folder: str) -> None:
    """All artefacts of a new index: features, vectors, hashes and statistics, as its first batch."""
    if Batches(features.sparkSession, folder).committed():
        raise ValueError(f"there is an index in {folder} already")
    _add_batch(features, folder, 0)


def add_to_index(features: DataFrame, folder: str) -> int:
    """Add the records whose id an index does not have; returns how many.

    They are one batch with all artefacts, which readers see once it is
    committed.  A call that fails at any step leaves the index as it was, and
    can be repeated.  Records repeated in the input are added once, the first
    in place.
    """
    log = Batches(features.sparkSession, folder)
    number, known = log.next_number(), log.read("features", matching.FEATURES).select("image_id")
    first = features.groupBy("image_id").agg(F.min_by(F.struct(*[c for c in features.columns if c != "image_id"]), "ord").alias("r")).select("image_id", "r.*").select(*features.columns)
    return _add_batch(first.join(known, "image_id", "left_anti"), folder, number)


def _add_batch(new: DataFrame, folder: str, number: int) -> int:
    spark, log = new.sparkSession, Batches(new.sparkSession, folder)
    batch = log.stage()
    new.write.parquet(f"{batch}/features")
    new = spark.read.parquet(f"{batch}/features")
    count = new.count()
    if number and not count:
        log.drop(batch)
        return 0
    matching.vector_rows(new).write.parquet(f"{batch}/vectors")
    matching.hash_rows(new).write.parquet(f"{batch}/hashes")
    _write_stats(log, batch)
    log.commit(number, batch)
    return count


def _write_stats(log: Batches, batch: str) -> None:
    """Statistics of the index with this batch."""
    whole = {n: log.read(n, s).unionByName(log.spark.read.schema(s).parquet(f"{batch}/{n}")) for n, s in (("features", matching.FEATURES), ("hashes", INDEX_SCHEMAS["hashes"]))}
    # one row each
    matching.build_stats(whole["features"]).join(F.broadcast(fingerprints.index_stats(whole["hashes"])), F.lit(True)).write.parquet(f"{batch}/stats")


def create_corpus(spark: SparkSession, root: str, name: str, config: dict, created_at: str) -> str:
    """Folder of a new corpus with metadata, configuration and an empty store; an existing name is an error.

    What was written is removed again if anything fails.
    """
    import yaml

    from ..operators.config import validate, validate_database_name

    folder = f"{root.rstrip('/')}/{validate_database_name(name)}"
    if problems := validate(config):
        raise ValueError("; ".join(problems))
    _, target, files = _files(spark, folder)
    if files.exists(target):
        raise ValueError(f"there is a corpus {name} already")
    try:
        files.mkdirs(target)
        tables = VersionedTables(spark, f"{folder}/store")
        versions = {n: tables.stage(n, spark.createDataFrame([], schema))[0] for n, schema in (("queries", store.QUERIES), ("candidates", store.CANDIDATES))}
        tables.publish(**versions)
        write_small(spark, f"{folder}/config.yaml", yaml.safe_dump(config, allow_unicode=True, sort_keys=False))
        write_small(spark, f"{folder}/metadata.json", json.dumps({"name": name, "created_at": created_at, "statistics": {"total_images": 0}}, ensure_ascii=False))
    except Exception:
        files.delete(target, True)
        raise
    return folder


def refresh_corpus(spark: SparkSession, folder: str) -> dict:
    """Metadata of a corpus with its statistics taken from the index, written back."""
    metadata = json.loads(read_small(spark, f"{folder}/metadata.json"))
    if batches := Batches(spark, f"{folder}/index").committed():
        metadata["statistics"] = spark.read.parquet(f"{batches[max(batches)]}/stats").first().asDict()
    write_small(spark, f"{folder}/metadata.json", json.dumps(metadata, ensure_ascii=False))
    return metadata


def delete_corpus(spark: SparkSession, root: str, name: str) -> None:
    """Remove a corpus with all it holds; an unknown one is an error."""
    from ..operators.config import validate_database_name

    _, target, files = _files(spark, f"{root.rstrip('/')}/{validate_database_name(name)}")
    if not files.exists(target):
        raise ValueError(f"there is no corpus {name}")
    files.delete(target, True)


def write_shards(entries: DataFrame, path: str, most: int = 2000) -> None:
    """Fetched files in shards of at most ``most`` entries; Spark's commit leaves no half-written one."""
    entries.write.option("maxRecordsPerFile", most).parquet(path)


def write_cells(indexed: DataFrame, path: str) -> None:
    """Inverted lists, a folder each, so that a search reads only the lists it visits."""
    indexed.write.partitionBy("cell_id").parquet(path)


def result_rows(matches: DataFrame) -> DataFrame:
    """Rows of the result files: four decimals, rank over the combined list, file name of the match."""
    from ..functions import scores, text

    return matches.select(
        "query_id", "rank", F.col("image_id").alias("image_path"), text.base_name(F.col("image_id").cast("string")).alias("file_name"), "match_type", "distance",
        *[scores.rounded(F.col(c), 4).alias(c) for c in ("similarity", "confidence", "vector_similarity", "text_similarity", "final_score")],
    )


def write_json_file(value: dict, path: str) -> None:
    """Small driver-side file, replaced at once."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2, default=str)
    os.replace(temporary, path)


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text, on any file system; None if there is no such file."""
    jvm, target, files = _files(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, content: str) -> None:
    """Replace a small file at once: written beside it, then renamed over it."""
    jvm, target, _ = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = beside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(beside, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


class VersionedTables:
    """Tables of whole versions under one manifest.

    A writer adds versions of one table or several, then replaces the manifest,
    so readers see all of a change or nothing of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> dict[str, str]:
        return json.loads(read_small(self.spark, f"{self.root}/CURRENT") or "{}")

    def read(self, name: str, schema: str) -> DataFrame:
        version = self.versions().get(name)
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def stage(self, name: str, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write a version that nobody sees yet: (version, its rows)."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}/{version}")
        return version, self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def publish(self, **versions: str) -> None:
        write_small(self.spark, f"{self.root}/CURRENT", json.dumps(self.versions() | versions))

    def write(self, name: str, rows: DataFrame) -> str:
        version, _ = self.stage(name, rows)
        self.publish(**{name: version})
        return version


def save_results(tables: VersionedTables, searched: DataFrame, found: DataFrame, now) -> None:
    """Store a batch of searches: merge queries and candidates, then publish both at once.

    ``searched`` as in store.upsert_queries, ``found`` with query_image_path,
    database_name and the candidate columns (rank counts within the match type).
    A failure before the end leaves both tables as they were.
    """
    queries, merged = tables.stage("queries", store.upsert_queries(tables.read("queries", store.QUERIES), searched, now))
    ids = merged.select("query_id", "query_image_path", "database_name")
    new = found.join(ids, ["query_image_path", "database_name"]).drop("query_image_path", "database_name")
    touched = searched.join(ids, ["query_image_path", "database_name"]).select("query_id")
    candidates, _ = tables.stage("candidates", store.upsert_candidates(tables.read("candidates", store.CANDIDATES), new, touched))
    tables.publish(queries=queries, candidates=candidates)


def rank_within_type(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "match_type").orderBy("rank")))


class ResultLog:
    """The result store as batches of changed rows, merged when they are read.

    A save writes the queries that were searched, with their candidates, and
    nothing of the others.  Both tables of a batch are committed at once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Batches(spark, root)

    def _latest(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        rows = self.log.read(name, schema, numbered=True)
        columns = [f.split()[0] for f in schema.split(", ")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")

    def queries(self) -> DataFrame:
        return self._latest("queries", store.QUERIES, ["query_id"])

    def candidates(self) -> DataFrame:
        return self._latest("candidates", store.CANDIDATES, ["query_id", "candidate_id"])

    def _commit(self, number: int, queries: DataFrame, candidates) -> None:
        batch = self.log.stage()
        queries.write.parquet(f"{batch}/queries")
        candidates(self.spark.read.parquet(f"{batch}/queries")).write.parquet(f"{batch}/candidates")
        self.log.commit(number, batch)

    def save(self, searched: DataFrame, found: DataFrame, now: Column) -> None:
        """Add a batch of searches, with the meaning of ``save_results``."""
        number, key = self.log.next_number(), ["query_image_path", "database_name"]
        old = self.queries().join(searched.select(*key), key, "left_semi")

        def candidates(merged: DataFrame) -> DataFrame:
            ids = merged.select("query_id", *key)
            before = self.candidates().join(ids.select("query_id"), "query_id", "left_semi")
            return store.upsert_candidates(before, found.join(ids, key).drop(*key), ids)

        self._commit(number, store.upsert_queries(old, searched, now), candidates)

    def label(self, events: DataFrame, now: Column) -> None:
        """Add label events, as in ``store.apply_labels``, and the status of their queries."""
        number, touched = self.log.next_number(), events.select("query_id").distinct()
        own = self.candidates().join(touched, "query_id", "left_semi")
        labeled = store.apply_labels(own, events)
        queries = self.queries().join(touched, "query_id", "left_semi")
        self._commit(number, store.refresh_status(queries, labeled, touched, now), lambda _: labeled)

    def compact(self) -> "ResultLog":
        """A store beside this one with a single batch of the rows as they are now."""
        other = ResultLog(self.spark, f"{self.log.root}-{uuid.uuid4().hex}")
        other._commit(0, self.queries(), lambda _: self.candidates())
        return other
