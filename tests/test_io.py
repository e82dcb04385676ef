"""Readers, writers and streaming on temporary folders."""

import json
import os
import time
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlinspike.operators import matching, store
from marlinspike.sources import ingest, sinks
from marlinspike.streaming import jobs


def test_lists_and_folders(spark, tmp_path):
    images = tmp_path / "in"
    (images / "sub").mkdir(parents=True)
    for name in ("b.PNG", "a.jpg", "sub/c.bmp", "x.txt"):
        (images / name).write_bytes(b"1")
    found = [r.image_id for r in ingest.scan_folder(spark, str(images)).orderBy("ord").collect()]
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.jpg", "b.PNG", "c.bmp"]
    listing = tmp_path / "list.txt"
    listing.write_text(f"﻿{found[0]}\n\n  {found[2]}  \n/nowhere.png\n{found[0]}\n", encoding="utf-8")
    listed, files = ingest.read_list(spark, str(listing)), ingest.list_files(spark, str(images))
    assert [r.image_id for r in ingest.dedupe(ingest.existing(listed, files)).orderBy("ord").collect()] == [found[0], found[2]]
    assert [r.image_id for r in ingest.missing(listed, files).collect()] == ["/nowhere.png"]
    with pytest.raises(ValueError):
        ingest.existing(listed.where("image_id = '/nowhere.png'"), files)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/e.png", b"1")
    assert ingest.unzip(str(tmp_path / "z.zip"), str(tmp_path / "out"))[0].endswith("d/e.png")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../e.png", b"1")
    with pytest.raises(ValueError):
        ingest.unzip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_entries_and_downloads(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"page_id":1,"page_url":"http://h/a.png"}\n\nnot json\n{"page_id":2,"page_url":"http://h/b"}\n{"page_id":3}\n')
    entries, rejects = ingest.read_entries(spark, str(path), "page_id long, page_url string")
    assert entries.count() == 3 and [r.line for r in rejects.collect()] == ["not json"]
    todo, failed = ingest.download_plan(entries, spark.createDataFrame([(1,)], "page_id long"))
    assert [(r.page_id, r.file_name) for r in todo.collect()] == [(2, "2.jpg")] and [r.page_id for r in failed.collect()] == [3]

    def get(url, timeout):
        assert timeout == 30.0
        if url.endswith("b"):
            raise OSError("gone")
        return b"x"

    got = {r.page_id: (r.content, r.error) for r in ingest.fetch(ingest.download_plan(entries, entries.limit(0))[0], get).collect()}
    assert got == {1: (bytearray(b"x"), None), 2: (None, "OSError: gone")}
    many = spark.createDataFrame([(i, f"http://h/{i}", f"{i}.jpg") for i in range(40)], "page_id long, page_url string, file_name string")
    assert sorted(r.page_id for r in ingest.fetch(many, lambda url, timeout: url.encode(), workers=2).collect()) == list(range(40))
    shards = spark.createDataFrame([("1.jpg",), ("22.tar.gz",), ("x.jpg",), ("1.jpg",), ("7",)], "file_name string")
    assert sorted(r.page_id for r in ingest.scan_store(shards).collect()) == [1, 7]
    sinks.write_shards(many.coalesce(1), str(tmp_path / "shards"), 15)
    assert len(list((tmp_path / "shards").glob("part*"))) == 3
    files = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    assert [r.path for r in ingest.remaining(files, files.where("path = '/a'"), files.where("path = '/b'")).collect()] == ["/c"]
    assert ingest.remaining(files, files.where("path = '/a'"), files.where("path = '/b'"), True).count() == 2


def test_extract_index_and_load(spark, tmp_path):
    images = spark.createDataFrame([(f"i{k}", k) for k in range(6)], "image_id string, ord long").repartition(2)

    def extractor(ids):
        if "i5" in ids:
            raise RuntimeError("broken")
        return [{"text_features": {"text_embedding": [1.0, 2.0], "full_text": i, "error": None}, "image_features": {"perceptual_hash": "ff", "image_embedding": None, "error": None}} for i in ids]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        features = ingest.extract(images, extractor, matching.FEATURES)
        sinks.write_index(features, str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = ingest.load_index(spark, str(tmp_path / "index"))
    stats = index["stats"].first()
    assert (stats.total_images, stats.features_failed, stats.text_vectors, stats.unique_hashes, stats.total_entries) == (6, 1, 5, 1, 5)
    assert [r.error for r in matching.failed_rows(index["features"]).collect()] == ["RuntimeError: broken"]
    with pytest.raises(FileNotFoundError):
        ingest.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sinks.write_hashes(index["hashes"], str(tmp_path / "h"), "xml")


def test_index_grows(spark, tmp_path):
    def records(ids, place=0):
        rows = [(f"i{k}", place + n, True, None, ([float(k), 1.0], f"t{k}", None), (f"{k:02x}", None, None)) for n, k in enumerate(ids)]
        return spark.createDataFrame(rows, matching.FEATURES)

    folder = str(tmp_path / "index")
    sinks.write_index(records([1, 2, 3]), folder)
    assert sinks.add_to_index(records([3, 4, 5, 4], 10), folder) == 2 and sinks.add_to_index(records([5]), folder) == 0
    index = ingest.load_index(spark, folder)
    assert sorted(r.image_id for r in index["vectors"].collect()) == sorted(r.image_id for r in index["hashes"].collect()) == [f"i{k}" for k in range(1, 6)]
    assert {r.image_id: r.ord for r in index["features"].collect()}["i4"] == 11
    assert (index["stats"].first().total_images, index["stats"].first().unique_hashes) == (5, 5)


@pytest.mark.parametrize("step", ["features", "vectors", "hashes", "stats", "commit"])
def test_index_growth_survives_a_failure_after_every_step(spark, tmp_path, monkeypatch, step):
    from marlinspike.sources import batches

    def records(ids):
        return spark.createDataFrame([(f"i{k}", k, True, None, ([float(k), 1.0], f"t{k}", None), (f"{k:02x}", None, None)) for k in ids], matching.FEATURES)

    folder, lost = str(tmp_path / "index"), lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost"))
    sinks.write_index(records([1, 2]), folder)
    where = {"features": (sinks.matching, "vector_rows"), "vectors": (sinks.matching, "hash_rows"), "hashes": (sinks, "_write_stats"), "stats": (batches.Batches, "commit")}
    if step == "commit":  # it was committed, but the writer does not know
        commit = batches.Batches.commit
        monkeypatch.setattr(batches.Batches, "commit", lambda *a: (commit(*a), lost()))
    else:
        monkeypatch.setattr(*where[step], lost)
    with pytest.raises(RuntimeError):
        sinks.add_to_index(records([2, 3, 4]), folder)
    monkeypatch.undo()
    if step != "commit":
        assert ingest.load_index(spark, folder)["vectors"].count() == ingest.load_index(spark, folder)["stats"].first().total_images == 2
    sinks.add_to_index(records([2, 3, 4]), folder)
    index = ingest.load_index(spark, folder)
    for name in ("features", "vectors", "hashes"):
        assert sorted(r.image_id for r in index[name].collect()) == ["i1", "i2", "i3", "i4"]
    assert index["stats"].first().total_entries == 4
    assert batches.Batches(spark, folder).clear_unfinished() == (step != "commit") and ingest.load_index(spark, folder)["hashes"].count() == 4
    with pytest.raises(ValueError):
        sinks.write_index(records([9]), folder)


def test_a_batch_number_is_committed_once(spark, tmp_path):
    from marlinspike.sources import batches

    log = batches.Batches(spark, str(tmp_path / "log"))
    one, two = log.stage(), log.stage()
    for folder, n in ((one, 1), (two, 2)):
        spark.range(n).write.parquet(f"{folder}/rows")
    log.commit(0, one)
    with pytest.raises(batches.Conflict):
        log.commit(0, two)
    assert log.read("rows", "id long").count() == 1
    log.commit(log.next_number(), two)
    assert log.read("rows", "id long").count() == 3 and [r.batch for r in log.read("rows", "id long", numbered=True).orderBy("batch", "id").collect()] == [0, 1, 1]


def test_searchable_corpora_have_all_artefacts(spark, tmp_path):
    import shutil

    rows = spark.createDataFrame([("i1", 0, True, None, ([1.0], "t", None), ("ff", None, None))], matching.FEATURES)
    for name in ("one", "two", "three"):
        folder = sinks.create_corpus(spark, str(tmp_path), name, {}, f"2026-01-0{len(name)}")
        if name != "three":
            sinks.write_index(rows, f"{folder}/index")
    assert sorted(ingest.searchable(spark, str(tmp_path))) == ["one", "two"]
    shutil.rmtree(next((tmp_path / "one" / "index" / "batches").glob("*/hashes")))
    assert ingest.searchable(spark, str(tmp_path)) == ["two"]
    assert ingest.missing_artefacts(spark, str(tmp_path / "one" / "index")) == ["hashes"]


def test_result_log_writes_what_changed(spark, tmp_path):
    searches = "query_image_path string, database_name string, top_n int, config_preset string, config_yaml string, processing_time_ms double"
    fields = "query_image_path string, database_name string, rank int, candidate_image_path string, match_type string, confidence_level string, overall_score double, text_score double, visual_score double, hash_distance int"
    searched = lambda *paths: spark.createDataFrame([(p, "db", 10, None, None, 1.0) for p in paths], searches)
    found = lambda path, *hits: spark.createDataFrame([(path, "db", n, h, "content", "HIGH", 0.9, None, None, None) for n, h in enumerate(hits, 1)], fields)
    at = lambda day: F.lit(f"2026-01-{day:02d}").cast("timestamp")
    log, tables = sinks.ResultLog(spark, str(tmp_path / "log")), sinks.VersionedTables(spark, str(tmp_path / "store"))
    many = spark.range(500).selectExpr("concat('/m', id) query_image_path", "'db' database_name", "10 top_n", "cast(null as string) config_preset", "cast(null as string) config_yaml", "1.0D processing_time_ms")
    hits = many.selectExpr("query_image_path", "database_name", "1 rank", "'/x' candidate_image_path", "'content' match_type", "'HIGH' confidence_level", "0.9D overall_score", "cast(null as double) text_score", "cast(null as double) visual_score", "cast(null as int) hash_distance")
    for day, (s, f) in enumerate([(many, hits), (searched("/a"), found("/a", "/x", "/y")), (searched("/a", "/m3"), found("/a", "/y", "/z")), (searched("/b"), found("/b"))], 1):
        log.save(s, f, at(day))
        sinks.save_results(tables, s, f, at(day))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(log.queries()) == key(tables.read("queries", store.QUERIES).select(*log.queries().columns))
    assert key(log.candidates()) == key(tables.read("candidates", store.CANDIDATES).select(*log.candidates().columns))
    folders = log.log.committed()
    size = lambda n: sum(p.stat().st_size for p in (tmp_path / "log" / "batches" / folders[n].rsplit("/", 1)[1]).rglob("*.parquet"))
    rows = lambda n, t: spark.read.parquet(f"{folders[n]}/{t}").count()
    assert [rows(n, "queries") for n in folders] == [500, 1, 2, 1] and [rows(n, "candidates") for n in folders] == [500, 2, 4, 0] and size(1) < size(0)
    one = log.candidates().where("candidate_image_path = '/y'").first()
    log.label(spark.createDataFrame([(one.query_id, one.candidate_id, "hit", "n", 1)], "query_id string, candidate_id string, label string, notes string, ord long").withColumn("labeled_at", at(9)), at(9))
    folders = log.log.committed()
    assert rows(4, "queries") == 1 and log.queries().where("status = 'partial'").count() == 1 and log.candidates().where("label = 'hit'").count() == 1
    small = log.compact()
    assert key(small.queries()) == key(log.queries()) and key(small.candidates()) == key(log.candidates()) and len(small.log.committed()) == 1


def test_corpora(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    folder = sinks.create_corpus(spark, root, "one", {"index": {"type": "Flat"}}, "2026-01-01T00:00:00")
    sinks.create_corpus(spark, root, "two", {}, "2026-01-02T00:00:00")
    assert [r.name for r in ingest.corpora(spark, root).collect()] == ["two", "one"]
    tables = sinks.VersionedTables(spark, f"{folder}/store")
    assert tables.read("queries", store.QUERIES).count() == 0 and set(tables.versions()) == {"queries", "candidates"}
    for name, config in (("one", {}), ("a/b", {}), ("three", {"index": {"type": "Tree"}})):
        with pytest.raises(ValueError):
            sinks.create_corpus(spark, root, name, config, "x")
    monkeypatch.setattr(sinks, "write_small", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        sinks.create_corpus(spark, root, "four", {}, "x")
    monkeypatch.undo()
    assert not (tmp_path / "four").exists() and not (tmp_path / "three").exists()
    rows = [("i1", 0, True, None, ([1.0], "t", None), ("ff", None, None))]
    sinks.write_index(spark.createDataFrame(rows, matching.FEATURES), f"{folder}/index")
    assert sinks.refresh_corpus(spark, folder)["statistics"]["total_images"] == 1
    assert json.loads((tmp_path / "one" / "metadata.json").read_text())["statistics"]["unique_hashes"] == 1
    sinks.delete_corpus(spark, root, "one")
    assert not (tmp_path / "one").exists()
    with pytest.raises(ValueError):
        sinks.delete_corpus(spark, root, "one")


def test_results_are_saved_as_a_whole(spark, tmp_path, monkeypatch):
    tables = sinks.VersionedTables(spark, str(tmp_path / "store"))
    searched = spark.createDataFrame([("/a", "db", 10, None, None, 1.0)], "query_image_path string, database_name string, top_n int, config_preset string, config_yaml string, processing_time_ms double")
    fields = "query_image_path string, database_name string, rank int, candidate_image_path string, match_type string, confidence_level string, overall_score double, text_score double, visual_score double, hash_distance int"
    found = lambda *paths: spark.createDataFrame([("/a", "db", n, p, "content", "HIGH", 0.9, None, None, None) for n, p in enumerate(paths, 1)], fields)
    now = F.lit("2026-01-01").cast("timestamp")
    sinks.save_results(tables, searched, found("/x", "/y"), now)
    before = tables.versions()
    real = store.upsert_candidates
    monkeypatch.setattr(sinks.store, "upsert_candidates", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sinks.save_results(tables, searched, found("/z"), now)
    monkeypatch.setattr(sinks.store, "upsert_candidates", real)
    assert tables.versions() == before and tables.read("queries", store.QUERIES).first().status == "unlabeled"
    sinks.save_results(tables, searched, found("/y"), now)
    rows = {r.candidate_image_path: r.in_current_result for r in tables.read("candidates", store.CANDIDATES).collect()}
    assert rows == {"/x": False, "/y": True} and sinks.read_small(spark, str(tmp_path / "none")) is None


def test_encoders(spark, tmp_path):
    import numpy as np

    from marlinspike.sources import encoders

    rows = spark.createDataFrame([(0, "中文 题"), (1, "  some  text "), (2, None), (3, " "), (4, "12 34"), (5, "some text")], "i long, full_text string")
    models = {lang: (lambda texts, lang=lang: encoders.hashed_ngrams([lang + t for t in texts], 8)) for lang in ("zh", "en")}
    got = {r.i: np.array(r.text_embedding) for r in encoders.encode_texts(rows, models, 8).collect()}
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-6 for i in (0, 1, 5)) and not any(got[i].any() for i in (2, 3, 4)) and (got[1] == got[5]).all()
    for bad in ({"en": models["en"]}, models | {"zh": lambda texts: np.ones((len(texts), 3))}):
        with pytest.raises(Exception, match="model for zh"):
            encoders.encode_texts(rows, bad, 8).collect()
    slope = np.tile(np.arange(64.0), (64, 1))
    assert encoders.perceptual_hash(slope) == "f" * 16 and encoders.perceptual_hash(-slope) == "0" * 16
    assert encoders.perceptual_hash(slope, "aHash") == "0f" * 8 and len(encoders.perceptual_hash(slope, "pHash", 16)) == 64
    noise = np.random.default_rng(1).integers(0, 256, (64, 64))
    for kind in encoders.HASHES:  # a brighter picture has the same hash, another one a different one
        assert encoders.perceptual_hash(noise / 2 + 9, kind) == encoders.perceptual_hash(noise, kind) != encoders.perceptual_hash(noise.T, kind)
    for args in (("xHash", 8), ("dHash", 4)):
        with pytest.raises(ValueError):
            encoders.perceptual_hash(slope, *args)
    pgm = b"P5\n64 64\n255\n" + noise.astype(np.uint8).tobytes()
    images = spark.createDataFrame([("a", pgm), ("b", b"junk"), ("c", None)], "image_id string, content binary")
    assert [r.perceptual_hash for r in encoders.hash_images(images, encoders.read_pgm).orderBy("image_id").collect()] == [encoders.perceptual_hash(noise), None, None]
    assert encoders.thumbnail(slope, 16).shape == (16, 16) and encoders.thumbnail(slope, 400).shape == (64, 64)
    black = encoders.binarise(np.where(slope < 20, 30, 200))
    assert set(np.unique(black)) == {0, 255} and (black[:, 20:] == 255).all() and not black[:, :20].any()
    (tmp_path / "x.pgm").write_bytes(pgm)
    assert bytes(ingest.load_image(spark, str(tmp_path / "x.pgm")).first().content) == bytes(ingest.load_image(spark, pgm).first().content) == bytes(ingest.load_image(spark, "http://h/x", lambda url: pgm).first().content)
    with pytest.raises(ValueError):
        ingest.load_image(spark, "https://h/x")
    places = spark.createDataFrame([(f"i{k}", k) for k in range(7)], "image_id string, ord long")
    record = lambda ids: [{"text_features": None, "image_features": None} for _ in ids] if len(ids) <= 3 else None
    done = ingest.extract_batches(places, record, matching.FEATURES, 3)
    assert sorted((r.image_id, r.ord, r.extraction_success) for r in done.collect()) == [(f"i{k}", k, True) for k in range(7)]
    with pytest.raises(ValueError):
        ingest.extract_batches(places, record, matching.FEATURES, 0)
    broken = ingest.extract(places.limit(1), lambda ids: 1 / 0, matching.FEATURES)
    row = ingest.failure_rows(broken, F.lit("2026-01-01").cast("timestamp"), device=F.lit(3)).first()
    assert (row.path, row.error_type, row.gpu_id) == ("i0", "ZeroDivisionError", 3) and row.worker_id is not None


def test_versions_and_exports(spark, tmp_path):
    from test_core import store_frames

    q, c = store_frames(spark)
    versions = sinks.VersionedTables(spark, str(tmp_path / "q"))
    assert versions.read("queries", store.QUERIES).count() == 0
    versions.write("queries", q)
    versions.write("queries", versions.read("queries", store.QUERIES).limit(2))
    assert versions.read("queries", store.QUERIES).count() == 2
    nested = {r.query_id: [x.candidate_image_path for x in r.candidates] for r in sinks.export_nested(q, c).collect()}
    assert nested["q_nocands"] == [] and nested["q_history"] == ["/e1", "/e_old"]
    sinks.write_jsonl(sinks.export_nested(q, c), str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part*")) for x in f.read_text().splitlines()]
    assert [x["query_id"] for x in lines] == [r.query_id for r in q.orderBy("created_at").collect()] and lines[0]["candidates"][0]["label"] is None
    assert sinks.export_flat(q, c).count() == 9 and sinks.write_csv_file(sinks.export_flat(q, c), str(tmp_path / "f.csv")) == 9
    assert (tmp_path / "f.csv").read_bytes().startswith(b"\xef\xbb\xbfquery_id")
    assert sinks.export_scope(q, "completed").count() == 0 and sinks.export_scope(q, "odd").count() == 6 and sinks.export_scope(q, "all", ("2026-01-02", "2026-01-03")).count() == 2
    assert sinks.export_name("题 库/1", "csv", "all", datetime(2026, 1, 2, 3, 4, 5)) == "题_库_1_all_20260102_030405.csv"
    sheets = sinks.workbook(q, c, "db")
    assert list(sheets) == ["Queries", "Candidates", "Statistics", "Metadata"] and sinks.sheet_counts(sheets) == {"Queries": 6, "Candidates": 9, "Statistics": 8, "Metadata": 5}
    assert {r.Metric: r.Value for r in sheets["Statistics"].collect()}["Hit Rate"] == "40.00%"
    assert {r.Field: r.Value for r in sinks.workbook(q, c, "db", "completed")["Metadata"].collect()}["Total Queries Exported"] == "0"


def test_folder_stream_restarts_once(spark, tmp_path):
    source, out = tmp_path / "src", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"x":1}\n{"x":-2}\n')

    def process(batch):
        return batch.where("x > 0"), batch.where("x <= 0").withColumn("error", F.lit("negative"))

    for name in (None, "b.json"):
        if name:
            (source / name).write_text('{"x":3}\n')
        jobs.run_to_folder(jobs.watch_folder(spark, str(source), "json", "x int"), process, out, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.x for r in spark.read.parquet(f"{out}/results").collect()) == [1, 3]
    assert [r.x for r in spark.read.parquet(f"{out}/failures").collect()] == [-2]


def test_task_stream_equals_batch_twin(spark, tmp_path):
    schema = "task_id string, ord long, event string, processed long, ts timestamp"
    rows = [("a", 0, "enqueue", None, datetime(2026, 1, 1)), ("a", 1, "claim", None, datetime(2026, 1, 2)), ("b", 2, "enqueue", None, datetime(2026, 1, 3)), ("b", 3, "cancel", None, datetime(2026, 1, 4)), ("a", 4, "progress", 7, datetime(2026, 1, 5)), ("a", 5, "cancel", None, datetime(2026, 1, 6)), ("a", 6, "completed", 9, datetime(2026, 1, 7)), ("b", 7, "claim", None, datetime(2026, 1, 8)), ("c", 8, "claim", 1, datetime(2026, 1, 9)), ("c", 9, "orphaned", None, datetime(2026, 1, 10))]
    for k in range(0, 10, 5):
        spark.createDataFrame(rows[k : k + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = jobs.watch_folder(spark, str(tmp_path / "ev"), "parquet", schema, 1)
    jobs.start_to_memory(jobs.task_states(stream), "task_states", "update", str(tmp_path / "cp")).awaitTermination(90)
    last = {r.task_id: (r.status, r.processed) for r in spark.sql("select * from task_states order by ts").collect()}
    twin = {r.task_id: (r.status, r.processed) for r in jobs.final_states(spark.createDataFrame(rows, schema)).collect()}
    assert last == twin == {"a": ("completed", 9), "b": ("cancelled", 0), "c": ("pending", 1)}


def test_timers_of_the_task_stream(spark, tmp_path):
    schema = "task_id string, ord long, event string, processed long, ts timestamp"
    at = lambda minute, second=0: datetime(2026, 1, 1, 0, minute, second)
    batches = [
        [("quiet", 0, "claim", 3, at(0)), ("busy", 1, "claim", 1, at(0)), ("done", 2, "completed", 9, at(0))],
        [("busy", 3, "progress", 2, at(1))],
        [("busy", 4, "progress", 4, at(2))],
        [("busy", 5, "progress", 5, at(3))],
        [("busy", 6, "progress", 6, at(4))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    for n, f in enumerate(sorted((tmp_path / "ev").glob("part*"), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    counts = []
    listener = jobs.ProgressListener(counts.append)
    spark.streams.addListener(listener)
    try:
        stream = jobs.observed(jobs.watch_folder(spark, str(tmp_path / "ev"), "parquet", schema, 1))
        jobs.start_to_memory(jobs.timed_states(stream), "timed_states", "update", str(tmp_path / "cp")).awaitTermination(120)
        for _ in range(50):
            if listener.total >= 7:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = spark.sql("select * from timed_states").collect()
    assert {r.status for r in rows if r.task_id == "quiet"} == {"running", "pending"}
    assert {r.status for r in rows if r.task_id == "busy"} == {"running"} and {r.status for r in rows if r.task_id == "done"} == {"completed"}
    assert listener.total == 7


def test_watched_images(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    for name in ("a.WEBP", "b.tiff", "c.txt", "d.jpg"):
        (folder / name).write_bytes(b"1")
    stream = jobs.watch_images(spark, str(tmp_path / "in"), bytes_per_trigger=1 << 20).select("image_id")
    jobs.start_to_memory(stream, "watched", "append", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.image_id.rsplit("/", 1)[1] for r in spark.sql("select * from watched").collect()) == ["a.WEBP", "b.tiff", "d.jpg"]
