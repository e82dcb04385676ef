"""Every registered query against its SQL, on the small tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
pd = pytest.importorskip("pandas")
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, str | bool):
        return value
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    number = float(value)
    return None if math.isnan(number) else round(number, 4) + 0.0


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_resume_plan_has_every_page_to_fetch(spark, data):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    done = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r.page_id: r.file_name for r in entry.queries()["resume_plan"](spark, data).collect()}
    assert got.keys() == {i for i, url in urls.items() if i is not None and url and i not in done}
    assert any(name == f"{i}.html" for i, name in got.items())


@pytest.mark.parametrize("name", ["ivf_search", "pq_search", "planes_search"])
def test_recall(spark, data, name):
    exact = {(r.query_id, r.image_id) for r in entry.queries()["knn_topk"](spark, data).collect()}
    near = {(r.query_id, r.image_id) for r in entry.queries()[name](spark, data).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_flagship_on_whole_texts(spark, data):
    from marlinspike.functions.text import edit_distance_of

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = [r for r in entry.queries()["dual_path_full_text"](spark, data).collect() if r.match_type == "content"]
    assert rows
    for r in rows:
        a, b = texts[r.query_id], texts[r.image_path]
        assert abs(r.text_score - (1 - edit_distance_of(a, b) / max(len(a), len(b)))) < 1e-6
