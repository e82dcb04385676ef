"""Equi-joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a key that one task joins, at least; keys of more rows are split, fewer than MOST_HOT of them.
TOGETHER, MOST_HOT = 10_000, 20_000


def hot_keys(rows: DataFrame, keys: list[str], total: int, together: int = TOGETHER) -> DataFrame:
    """(keys, parts): keys of over ``together`` rows and in how many parts to cut them.

    ``total`` is the number of rows; the result has fewer than MOST_HOT rows, so
    it can be broadcast.
    """
    most = max(together, total // MOST_HOT)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return counts.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def in_parts(rows: DataFrame, others: DataFrame, hot: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``keys`` with a column part to join on too.

    Rows of a hot key go to parts by the hash of the column ``by``; the others'
    rows of it are repeated for each part.
    """
    hot = F.broadcast(hot)
    cut = rows.join(hot, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    all_parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return cut, others.join(hot, keys, "left").withColumn("part", F.explode(all_parts)).drop("parts")
