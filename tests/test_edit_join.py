"""Joins within an edit distance against all pairs."""

import random

import pytest

from marlinspike.functions.text import edit_distance_of
from marlinspike.operators import edit_join


def edited(rng, text, edits, alphabet):
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:at] + (rng.choice(alphabet) if kind < 2 else "") + text[at + (kind > 0) :]
    return text


def some_texts(rng, alphabet):
    base = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 30, 80)]
    return sorted({edited(rng, t, e, alphabet) for t in base for e in range(6)} | set(base))


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_join_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    left, right = some_texts(rng, "abé漢😀"), some_texts(rng, "abé漢😀")
    frame = lambda texts: spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x")], "text_id long, text string, distance string")
    got = sorted(map(tuple, edit_join.edit_join(frame(left), frame(right), distance).collect()))
    want = sorted((i, j, k) for i, a in enumerate(left) for j, b in enumerate(right) if (k := edit_distance_of(a, b)) <= distance)
    assert got == want and any(k == distance for _, _, k in want)
    got = sorted(map(tuple, edit_join.near_texts(frame(left), distance).collect()))
    assert got == sorted((i, j, k) for i, a in enumerate(left) for j, b in enumerate(left) if i < j and (k := edit_distance_of(a, b)) <= distance)


def test_hot_segments_are_split(spark, monkeypatch):
    monkeypatch.setattr(edit_join, "TOGETHER", 3)
    texts = [f"the same long beginning of many texts {i:04d}" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    got = sorted(map(tuple, edit_join.near_texts(rows, 2).collect()))
    assert got == sorted((i, j, k) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (k := edit_distance_of(a, b)) <= 2)


def test_counts_of_copies_nulls_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "some test"), (4, None), (5, "else"), (6, "")], schema)
    got = {r.doc_id: tuple(r)[1:] for r in edit_join.near_counts(rows, "doc_id", "text", 3).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 4: (None, 0, None), 5: (5, 0, None), 6: (6, 0, None)}
    assert edit_join.near_counts(spark.createDataFrame([], schema), "doc_id", "text", 3).count() == 0
    with pytest.raises(ValueError):
        edit_join.near_counts(rows, "doc_id", "text", -1)


def test_no_nested_loop(spark):
    rows = spark.range(100).selectExpr("id as text_id", "repeat(string(id), 10) as text")
    plan = edit_join.edit_join(rows, rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
