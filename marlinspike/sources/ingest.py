"""Readers: image lists, folders, archives, JSON lines, and checkpoints of earlier runs."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from .batches import Batches, exists

#: Suffixes of an image folder, and those of the watched folder.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
WATCH_SUFFIXES = (*IMAGE_SUFFIXES, ".webp", ".gif", ".tif", ".tiff")


def dedupe(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """First occurrence of each key, by ord."""
    others = [c for c in rows.columns if c not in (key, "ord")]
    first = rows.groupBy(key).agg(F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in others])
    return first.select(*rows.columns)


def list_files(spark: SparkSession, folder: str, suffixes: Iterable[str] = IMAGE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(image_id, length, modified) of the folder's image files, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(text.suffix(F.col("path")).isin(*suffixes)).select(F.col("path").alias("image_id"), "length", F.col("modificationTime").alias("modified"))


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def scan_folder(spark: SparkSession, folder: str, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Images of a folder in order of their paths: (image_id, ord); places grow with the path and may leave gaps.

    Paths are dealt by range, so no task orders them all.
    """
    found = list_files(spark, folder, suffixes).select(_local(F.col("image_id")).alias("image_id")).distinct()
    return found.orderBy("image_id").withColumn("ord", F.monotonically_increasing_id())


def load_image(spark: SparkSession, source: str | bytes, get: Callable[[str], bytes] | None = None) -> DataFrame:
    """One image as (image_id, content): bytes, a path, or a URL that ``get`` fetches."""
    if isinstance(source, bytes | bytearray):
        return spark.createDataFrame([("memory", bytes(source))], "image_id string, content binary")
    if source.startswith(("http://", "https://")):
        if get is None:
            raise ValueError("a URL needs a function that fetches it")
        return spark.createDataFrame([(source, get(source))], "image_id string, content binary")
    return spark.read.format("binaryFile").load(source).select(_local(F.col("path")).alias("image_id"), "content")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file: trimmed, blanks dropped, byte-order mark removed: (image_id, ord)."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("image_id"), F.monotonically_increasing_id().alias("ord"))
    return lines.where("image_id <> ''")


def existing(listed: DataFrame, files: DataFrame, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Listed images that exist (semi-join on a listing); other suffixes are left out, and none at all is an error."""
    listed = listed.where(text.suffix(F.col("image_id")).isin(*suffixes))
    kept = listed.join(files.select(_local(F.col("image_id")).alias("image_id")), "image_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("none of the listed images exists")
    return kept


def missing(listed: DataFrame, files: DataFrame) -> DataFrame:
    return listed.join(files.select(_local(F.col("image_id")).alias("image_id")), "image_id", "left_anti")


def unzip(archive: str, target: str) -> list[str]:
    """Extract an archive on the driver; entries that would leave the target are an error."""
    root = os.path.realpath(target)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not os.path.realpath(os.path.join(root, name)).startswith(root + os.sep):
                raise ValueError(f"unsafe archive entry: {name}")
        z.extractall(root)
        return sorted(os.path.join(root, n) for n in z.namelist() if not n.endswith("/"))


def read_entries(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of a JSON-lines file; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(parsed.alias("r")).select("r.*")
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select(F.col("_corrupt").alias("line"))


def download_plan(entries: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to fetch, failed) entries: without an id or URL they fail, done ones are left out."""
    good = F.col("page_id").isNotNull() & (F.col("page_url") != "")
    todo = entries.where(F.coalesce(good, F.lit(False))).join(done.select("page_id").distinct(), "page_id", "left_anti")
    named = todo.withColumn("file_name", F.concat(F.col("page_id").cast("string"), text.url_extension(F.col("page_url"))))
    return named, entries.where(~F.coalesce(good, F.lit(False)))


def fetch(todo: DataFrame, get: Callable[[str, float], bytes], workers: int = 4, timeout: float = 30.0) -> DataFrame:
    """Fetch each URL with ``get(url, timeout)``: (page_id, file_name, content, error); a failure is a row, not an exception.

    A task has ``workers`` requests at work and at most four times as many waiting.
    """

    def run(batches):
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        def one(row):
            try:
                return row.page_id, row.file_name, get(row.page_url, timeout), None
            except Exception as e:  # noqa: BLE001 - one row's failure
                return row.page_id, row.file_name, None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                out, flying = [], deque()
                for row in batch.itertuples():
                    flying.append(pool.submit(one, row))
                    if len(flying) >= max(4 * workers, workers + 1):
                        out.append(flying.popleft().result())
                out += [f.result() for f in flying]
                yield pd.DataFrame(out, columns=["page_id", "file_name", "content", "error"])

    return todo.select("page_id", "file_name", "page_url").mapInPandas(run, f"page_id {todo.schema['page_id'].dataType.simpleString()}, file_name string, content binary, error string")


def merge_shards(entries: DataFrame) -> DataFrame:
    """First entry of each file name, by ord."""
    return dedupe(entries, "file_name")


def completed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''").distinct()


def failed(spark: SparkSession, path: str) -> DataFrame:
    """Paths of failure records; malformed lines are skipped."""
    good, _ = read_entries(spark, path, "path string")
    return good.where("path is not null").select("path").distinct()


def scan_store(shards: DataFrame) -> DataFrame:
    """Ids of the files that shards hold, read off their names: (page_id)."""
    return shards.select(text.stem(F.col("file_name")).try_cast("long").alias("page_id")).where("page_id is not null").distinct()


def remaining(files: DataFrame, done: DataFrame, broken: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Files that neither succeeded nor failed; with ``retry_failed`` failed ones are taken again."""
    left = files.join(done.select("path"), "path", "left_anti")
    return left if retry_failed else left.join(broken.select("path"), "path", "left_anti")


def extract(images: DataFrame, extractor: Callable[[list[str]], list[dict]], schema: str) -> DataFrame:
    """Feature records of images by an injected extractor, a batch at a time, in their places.

    ``extractor`` takes image ids and returns a record for each.  If it fails,
    every image of the batch gets a failure record and the job goes on.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            ids, places = batch["image_id"].tolist(), batch["ord"].tolist()
            try:
                records = extractor(ids)
                if len(records) != len(ids):
                    raise RuntimeError(f"{len(ids)} images but {len(records)} records")
                rows = [{"extraction_success": True, "error": None, "text_features": None, "image_features": None} | r for r in records]
            except Exception as e:  # noqa: BLE001 - one batch's failure
                rows = [{"extraction_success": False, "error": f"{type(e).__name__}: {e}", "text_features": None, "image_features": None} for _ in ids]
            yield pd.DataFrame([{"image_id": i, "ord": o} | r for i, o, r in zip(ids, places, rows, strict=True)])

    return images.select("image_id", "ord").mapInPandas(run, schema)


def extract_batches(images: DataFrame, extractor: Callable[[list[str]], list[dict]], schema: str, batch_size: int = 2) -> DataFrame:
    """As extract, with ``batch_size`` images handed over at a time; records keep their places."""
    if batch_size < 1:
        raise ValueError("batch_size is 1 or more")

    def sliced(ids: list[str]) -> list[dict]:
        return [r for at in range(0, len(ids), batch_size) for r in extractor(ids[at : at + batch_size])]

    return extract(images, sliced, schema)


def failure_rows(records: DataFrame, now: Column, worker: Column | None = None, device: Column | None = None) -> DataFrame:
    """Failure log of extraction records: path, error, error_type, worker_id, gpu_id, time."""
    return records.where("not coalesce(extraction_success, false)").select(
        F.col("image_id").alias("path"), "error", F.regexp_extract("error", "^([A-Za-z_]+):", 1).alias("error_type"),
        (F.spark_partition_id() if worker is None else worker).alias("worker_id"), (F.lit(None).cast("int") if device is None else device).alias("gpu_id"), now.alias("time"),
    )


def corpora(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all corpora under a folder, newest first; unreadable ones are skipped."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema("name string, created_at string, statistics struct<total_images: long>").json(f"{root}/*/metadata.json")
    return rows.where("name is not null").select("*", F.col("_metadata.file_path").alias("path")).orderBy(F.desc("created_at"), "name")


ARTEFACTS = ("features", "vectors", "hashes", "stats")


def missing_artefacts(spark: SparkSession, folder: str) -> list[str]:
    """Artefacts that some committed batch of an index lacks; all of them without any batch."""
    found = Batches(spark, folder).committed().values()
    return [a for a in ARTEFACTS if not found or any(not exists(spark, f"{batch}/{a}") for batch in found)]


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All artefacts of an index, on any file system; a missing one is an error."""
    if absent := missing_artefacts(spark, folder):
        raise FileNotFoundError(f"index artefacts missing in {folder}: {', '.join(absent)}")
    batches = Batches(spark, folder).committed()
    # the last batch's statistics are those of the whole index
    return {a: spark.read.parquet(*[f"{b}/{a}" for n, b in batches.items() if a != "stats" or n == max(batches)]) for a in ARTEFACTS}


def searchable(spark: SparkSession, root: str) -> list[str]:
    """Names of the corpora whose index has all of its artefacts, newest first."""
    rows = corpora(spark, root).select("name").collect()  # a row a corpus
    return [r.name for r in rows if not missing_artefacts(spark, f"{root.rstrip('/')}/{r.name}/index")]
