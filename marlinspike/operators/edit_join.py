"""Joins of texts within an edit distance, as equi-joins on segments.

A text is cut into one segment more than the distance.  Of two texts that are
near, the other holds one of these segments unchanged, at a place that the
errors before and behind it allow.  So both sides give keys, and no pair is
looked at that shares none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import TOGETHER, hot_keys, in_parts


def text_classes(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): each different text once under its smallest id, and the class of each row.

    Null texts are in no class; members have ``key`` and text_id.
    """
    named = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.sha2(text, 256).alias("digest"))
    classes = named.groupBy("digest").agg(F.min("id").alias("text_id"), F.any_value("text").alias("text"))
    members = named.select("id", "digest").join(classes.select("digest", "text_id"), "digest").select(F.col("id").alias(key), "text_id")
    return classes.select("text_id", "text"), members


def _segment(length: Column, i: Column, distance: int) -> tuple[Column, Column]:
    """(place, size) of segment ``i`` of a text; the last segments take the characters left over."""
    n = distance + 1
    size, short = F.floor(length / n).cast("int"), (n - length % n).cast("int")
    return i * size + F.greatest(F.lit(0), i - short), size + (i >= short).cast("int")


def _key(length: Column, i: Column, piece: Column) -> Column:
    return F.xxhash64(length, i, piece)


def _piece(text: Column, place: Column, size: Column) -> Column:
    return text.substr((place + 1).cast("int"), size.cast("int"))


def _segments(rows: DataFrame, distance: int) -> DataFrame:
    """(text_id, key) of texts that are looked for; texts without a segment for each number have none."""
    cut = rows.where(F.length("text") > distance).select("text_id", "text", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("i"))
    place, size = _segment(F.col("n"), F.col("i"), distance)
    return cut.select("text_id", _key(F.col("n"), F.col("i"), _piece(F.col("text"), place, size)).alias("key"))


def _probes(rows: DataFrame, distance: int, shortest: int) -> DataFrame:
    """(text_id, key) of texts that look for others, of lengths from ``shortest`` to ``distance`` more than their own.

    Segment i may have moved by i errors before it and by distance - i behind it.
    """
    asked = rows.select("text_id", "text", F.explode(F.sequence(F.lit(shortest), F.lit(distance))).alias("more"))
    asked = asked.withColumn("n", F.length("text") + F.col("more")).where(F.col("n") > distance)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("i"))
    place, size = _segment(F.col("n"), F.col("i"), distance)
    asked = asked.withColumns({"place": place, "size": size})
    before, behind = F.col("i"), distance - F.col("i")
    low = F.greatest(F.lit(0), F.col("place") - before, F.col("place") - F.col("more") - behind)
    high = F.least(F.length("text") - F.col("size"), F.col("place") + before, F.col("place") - F.col("more") + behind)
    asked = asked.withColumns({"low": low, "high": high}).where("low <= high").select("text_id", "text", "n", "i", "size", F.explode(F.sequence("low", "high")).alias("at"))
    return asked.select("text_id", _key(F.col("n"), F.col("i"), _piece(F.col("text"), F.col("at"), F.col("size"))).alias("key"))


def _shortened(rows: DataFrame, distance: int, longest: int) -> DataFrame:
    """(text_id, key) of short texts: of themselves and of what is left without up to ``distance`` characters; near texts have one in common."""
    left = rows.where(F.length("text") <= longest).select("text_id", "text")
    for _ in range(distance):
        at = left.select("text_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("at"))  # at 0 nothing goes
        left = at.select("text_id", F.when(F.col("at") == 0, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), F.col("at") - 1), F.col("text").substr(F.col("at") + 1, F.length("text")))).alias("text")).distinct()
    return left.select("text_id", F.col("text").alias("key"))


def _candidates(left: DataFrame, right: DataFrame, distance: int, shortest: int, total: int) -> DataFrame:
    """(left_id, right_id) that share a key, once for each; keys of many rows are dealt over several tasks."""
    looked_for = _segments(right, distance).withColumnRenamed("text_id", "right_id")
    looking = _probes(left, distance, shortest).withColumnRenamed("text_id", "left_id")
    hot = hot_keys(looked_for, ["key"], total * (distance + 1), TOGETHER)
    cut, others = in_parts(looked_for, looking, hot, ["key"], "right_id")
    found = others.join(cut, ["key", "part"]).select("left_id", "right_id")
    # texts no longer than the distance have no segments; their partners are short as well
    brief = _shortened(left, distance, 2 * distance).withColumnRenamed("text_id", "left_id").join(_shortened(right, distance, distance).withColumnRenamed("text_id", "right_id"), "key").select("left_id", "right_id")
    return found.unionByName(brief)


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs with their distance, which is computed in a band along the diagonal only."""
    texts = pairs.join(left.select(F.col("text_id").alias("left_id"), F.col("text").alias("a")), "left_id").join(right.select(F.col("text_id").alias("right_id"), F.col("text").alias("b")), "right_id")
    found = texts.select("left_id", "right_id", F.levenshtein("a", "b", distance).alias("distance")).where(F.col("distance") >= 0)
    return found.groupBy("left_id", "right_id").agg(F.min("distance").alias("distance"))


def edit_join(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(left_id, right_id, distance): pairs of texts at most ``distance`` edits apart, equal ones included.

    Both sides have text_id and text, each text once (see text_classes); null
    texts match nothing, empty ones match texts of up to ``distance``
    characters.  Should an id have several texts, a pair has its least
    distance.  A side without rows gives no rows; other columns are ignored.
    """
    _check(distance)
    left, right = left.where(F.col("text").isNotNull()), right.where(F.col("text").isNotNull())
    return _verified(_candidates(left, right, distance, -distance, right.count()).distinct(), left, right, distance)


def near_texts(texts: DataFrame, distance: int) -> DataFrame:
    """(left_id, right_id, distance): pairs of different rows of one table of texts, left_id < right_id, each once."""
    _check(distance)
    texts = texts.where(F.col("text").isNotNull())
    # the shorter text of a pair asks, so half of the lengths are left out
    found = _candidates(texts, texts, distance, 0, texts.count()).where("left_id <> right_id")
    pairs = found.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    return _verified(pairs, texts, texts, distance)


def near_counts(rows: DataFrame, key: str, text: str, distance: int) -> DataFrame:
    """A row for each row: ``key``, text_id (smallest id with the same text), n_near (other texts within ``distance``), nearest (their least distance).

    Null texts have null text_id and no neighbours.  Copies are compared once, as one text.
    """
    classes, members = text_classes(rows, key, text)
    pairs = near_texts(classes, distance)
    # both ends of a pair from one pass over the pairs
    ends = F.explode(F.array("left_id", "right_id")).alias("text_id")
    counts = pairs.select(ends, "distance").groupBy("text_id").agg(F.count("*").alias("n_near"), F.min("distance").alias("nearest"))
    # the class of a row by its text's digest; a class's count by its id
    found = members.join(counts, "text_id", "left")
    missing = rows.where(F.col(text).isNull()).select(key)
    return found.unionByName(missing, allowMissingColumns=True).select(key, "text_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")


def _check(distance: int) -> None:
    if not isinstance(distance, int) or distance < 0:
        raise ValueError("the distance is a whole number, 0 or more")
