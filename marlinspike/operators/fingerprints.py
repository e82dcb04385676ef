"""Fingerprint index: lookup, Hamming-radius join and statistics.

An index is a frame (image_id, ord, hash), one row an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bits, joins

#: Most different hashes of a block; a task compares two blocks at once, at about a nanosecond a pair of 64 bits.
BLOCK = 30_000
#: Pairs that are compared in one step, and pairs that are handed on at once.
STEP, FOUND = 1 << 16, 1 << 18
#: Most values of a band that a query asks for.
MOST_PROBES = 1 << 12
#: Cost of a row that is shuffled, and of a candidate that a join verifies, in pairs of compared blocks.
ROW, CANDIDATE = 1000, 50


def lookup(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Ids with exactly the query's hash: (query_id, image_id, ord)."""
    return queries.select("query_id", "hash").join(index.where("hash is not null"), "hash").select("query_id", "image_id", "ord")


def first_seen(index: DataFrame) -> DataFrame:
    """Add first_ord, the place at which each hash was first added; ties of a search go by it."""
    first = index.groupBy("hash").agg(F.min("ord").alias("first_ord"))
    return index.join(first, "hash")


def _bands(hash_: Column, units: Column, bands: int, kind: str) -> Column:
    """(kind, length, band, value) of a string cut into bands of its bits (hexadecimal digits) or characters.

    Two strings of equal length that differ in fewer units than there are bands
    agree in one.  A string of fewer units than bands is within the radius of
    all of its length, and has a single band without a value.
    """
    size, count = F.length(units), F.lit(bands)

    def cut(i: Column) -> Column:
        lo, hi = F.floor(i * size / count).cast("int"), F.floor((i + 1) * size / count).cast("int")
        return F.struct(F.lit(kind).alias("kind"), F.length(hash_).alias("length"), i.alias("band"), F.substring(units, lo + 1, hi - lo).alias("value"))

    whole = F.struct(F.lit(kind).alias("kind"), F.length(hash_).alias("length"), F.lit(0).alias("band"), F.lit("").alias("value"))
    return F.when(size < count, F.array(whole)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), cut))


# Comparison by blocks ---------------------------------------------------------------


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _hexed(column: str) -> Column:
    return F.col(column).rlike("^[0-9a-fA-F]+$")


def _numbers(hashes: list[str], digits: int) -> np.ndarray:
    """Hexadecimal strings of so many digits as rows of 64-bit numbers."""
    wide = -(-digits // 16) * 16
    return np.frombuffer(bytes.fromhex("".join(h.rjust(wide, "0") for h in hashes)), np.uint64).reshape(len(hashes), -1)


def _band_masks(digits: int, bands: int) -> np.ndarray:
    """The bits of each band that ``_bands`` cuts hashes of so many digits in; a single empty one if there are fewer bits."""
    size = 4 * digits
    if size < bands:
        return _numbers(["0"], digits)
    ends = [(size - i * size // bands, size - (i + 1) * size // bands) for i in range(bands)]
    return _numbers([f"{(1 << hi) - (1 << lo):x}" for hi, lo in ends], digits)


def _compare(digits: int, max_distance: int, masks: np.ndarray, nearest: int | None):
    """Rows (band, q_hashes, c_hashes) become rows (q_hash, c_hash, distance) within the radius.

    A pair counts in the first band in which both agree, so in one cell only.
    With ``nearest`` so many of a cell's rows are kept for each query, and all
    that are as near as the last of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, asked, held in zip(*(batch.column(i) for i in range(3)), strict=True):
                asked, held, parts, count = asked.values, held.values, [], 0
                q, c = _numbers(asked.to_pylist(), digits), _numbers(held.to_pylist(), digits)
                words, step = [np.ascontiguousarray(c[:, w]) for w in range(c.shape[1])], max(1, STEP // len(c))
                for lo in range(0, len(q), step):
                    some = q[lo : lo + step]
                    far = np.bitwise_count(some[:, :1] ^ words[0])
                    if len(words) > 1:
                        far = sum((np.bitwise_count(some[:, w : w + 1] ^ words[w]) for w in range(1, len(words))), far.astype(np.int32))
                    i, j = np.divmod(np.flatnonzero(far <= max_distance), len(c))
                    distance = far[i, j].astype(np.int32)
                    if earlier := band.as_py():
                        fresh = ((some[i] ^ c[j])[:, None, :] & masks[None, :earlier]).any(axis=2).all(axis=1)
                        i, j, distance = i[fresh], j[fresh], distance[fresh]
                    if nearest is not None and len(i) > nearest:
                        order = np.lexsort((distance, i))
                        first = np.searchsorted(i[order], np.arange(len(some)))
                        last = np.minimum(first + nearest, np.append(first[1:], len(order))) - 1
                        kept = distance <= distance[order][np.maximum(last, 0)][i]
                        i, j, distance = i[kept], j[kept], distance[kept]
                    parts.append((i + lo, j, distance))
                    count += len(i)
                    if count >= FOUND or lo + step >= len(q):
                        i, j, distance = (np.concatenate(p) for p in zip(*parts, strict=True))
                        yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), held.take(pa.array(j)), pa.array(distance)], ["q_hash", "c_hash", "distance"])
                        parts, count = [], 0

    return run


def _block_matches(q: DataFrame, c: DataFrame, digits: int, max_distance: int, asked: int, held: int, bands: int = 1, nearest: int | None = None) -> DataFrame:
    """(q_hash, c_hash, distance) of different hashes of one length: each block of queries meets each block of the index.

    Blocks hold BLOCK hashes or so, and a cell of two blocks is worked on at
    once, so no task holds more, and none gets all.  With more than one band
    only blocks that agree in one meet.
    """
    counts = -(-asked // BLOCK), -(-held // BLOCK)
    keys = ["kind", "length", "band", "value", "q_block", "c_block"]
    bit_text = lambda x: F.array_join(F.transform(F.split(F.lower(x), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")

    def blocks(df: DataFrame, x: str, own: int) -> DataFrame:
        """A row for each band, value and block, repeated for each block of the other side."""
        # the bits are a column of their own, or they would be worked out again for each band
        df = df.withColumn("units", bit_text(F.col(x))) if bands > 1 else df
        columns = F.explode(_bands(F.col(x), F.col("units"), bands, "bits")) if bands > 1 else F.struct(F.lit("all").alias("kind"), F.lit(digits).alias("length"), F.lit(0).alias("band"), F.lit("").alias("value"))
        name, other = (("q_block", "c_block"), ("c_block", "q_block"))[own]
        rows = df.select(x, columns.alias("b"), F.pmod(F.xxhash64(x), F.lit(counts[own])).cast("int").alias(name)).select(x, "b.*", name)
        rows = rows.groupBy("kind", "length", "band", "value", name).agg(F.collect_list(x).alias(x))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(counts[1 - own] - 1))))

    # dealt by number: cells are small, so that a broadcast or coalescing would leave them to a few tasks
    tasks = _tasks(q)
    cells = blocks(q, "q_hash", 0).repartition(tasks, *keys).join(blocks(c, "c_hash", 1).repartition(tasks, *keys).hint("merge"), keys)
    run = _compare(digits, max_distance, _band_masks(digits, bands), nearest)
    return cells.select("band", "q_hash", "c_hash").mapInArrow(run, "q_hash string, c_hash string, distance int")


def _odd_pairs(q: DataFrame, c: DataFrame, max_distance: int) -> DataFrame:
    """Pairs of different hashes within the radius of which one is not hexadecimal, or whose lengths differ.

    Where one of the two is not hexadecimal, characters count, so those pairs
    are joined by bands of characters.  Strings of unequal length are as far
    apart as the longer one is long: they match if both have at most
    max_distance characters, and are joined by length.
    """
    distance = bits.hamming_distance(F.col("q_hash"), F.col("c_hash"))
    n = max_distance + 1

    def banded(df: DataFrame, x: str) -> DataFrame:
        return df.withColumn("b", F.explode(_bands(F.col(x), F.col(x), n, "chars")))

    odd_q = banded(q.where(~_hexed("q_hash")), "q_hash").join(banded(c, "c_hash"), "b")
    odd_c = banded(q.where(_hexed("q_hash")), "q_hash").join(banded(c.where(~_hexed("c_hash")), "c_hash"), "b")
    same = odd_q.unionByName(odd_c).drop("b").where(distance <= max_distance).select("q_hash", "c_hash", distance.alias("distance")).distinct()
    lengths = F.filter(F.sequence(F.lit(1), F.lit(max(max_distance, 1))), lambda x: x != F.length("q_hash"))
    short_q = q.where(F.length("q_hash") <= max_distance).withColumn("length", F.explode(lengths))
    short_c = c.where(F.length("c_hash") <= max_distance).withColumn("length", F.length("c_hash"))
    short = short_q.join(short_c, "length").select("q_hash", "c_hash", distance.alias("distance"))
    return same.unionByName(short)


# Multi-index hashing -----------------------------------------------------------------


def ball(width: int, radius: int) -> int:
    """Values of ``width`` bits within ``radius`` of one."""
    return sum(comb(width, r) for r in range(radius + 1))


def band_widths(digits: int, bands: int) -> list[int]:
    """Hexadecimal digits of each band of a hash."""
    return [(i + 1) * digits // bands - i * digits // bands for i in range(bands)]


def plan_bands(digits: int, max_distance: int, queries: int, rows: int) -> int | None:
    """How many bands to cut hashes of so many digits in, or None if a nested loop costs less.

    Of m bands one differs in max_distance // m bits at most.  Fewer bands are
    wider and select more, but a query then has more values to ask for.
    """
    best, least = None, queries * rows
    for m in range(max(1, -(-digits // MOST_DIGITS)), min(digits, max_distance + 1) + 1):
        balls = [(4 * w, ball(4 * w, max_distance // m)) for w in band_widths(digits, m)]
        if max(n for _, n in balls) > MOST_PROBES:
            continue
        asked = sum(n for _, n in balls)
        met = sum(n / 2**w for w, n in balls)
        cost = ROW * (m * rows + asked * queries) + CANDIDATE * queries * rows * met
        if cost < least:
            best, least = m, cost
    return best


#: Digits of a band: its value is a number of 60 bits.
MOST_DIGITS = 15


def _band_rows(hashes: DataFrame, column: str, digits: int, bands: int) -> DataFrame:
    """A row for each band: (column, words, band, width in bits, value)."""
    structs, at = [], 1
    for i, w in enumerate(band_widths(digits, bands)):
        value = F.conv(F.substring(column, at, w), 16, 10).cast("long")
        structs.append(F.struct(F.lit(i).alias("band"), F.lit(4 * w).alias("width"), value.alias("value")))
        at += w
    return hashes.select(column, "words", F.explode(F.array(*structs)).alias("b")).select(column, "words", "b.*")


def _band_matches(q: DataFrame, c: DataFrame, digits: int, max_distance: int, bands: int, rows: int) -> DataFrame:
    """(q_hash, c_hash, distance) of hashes of one length: bands of the index meet all values near a query's."""
    spark, radius = q.sparkSession, max_distance // bands
    masks = [(w, sum(1 << i for i in at)) for w in {4 * w for w in band_widths(digits, bands)} for r in range(radius + 1) for at in combinations(range(w), r)]
    masks = F.broadcast(spark.createDataFrame(masks, "width int, mask long"))  # MOST_PROBES for each of two widths at most
    held = _band_rows(c, "c_hash", digits, bands).withColumnRenamed("words", "c_words").drop("width")
    asked = _band_rows(q, "q_hash", digits, bands).join(masks, "width").withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("width", "mask").withColumnRenamed("words", "q_words")
    keys = ["band", "value"]
    held, asked = joins.in_parts(held, asked, joins.hot_keys(held, keys, bands * rows), keys, "c_hash")
    count = -(-digits // 8)
    distance = sum((F.bit_count(F.get("q_words", F.lit(i)).bitwiseXOR(F.get("c_words", F.lit(i)))) for i in range(count)), F.lit(0))
    return held.join(asked, [*keys, "part"]).where(distance <= max_distance).select("q_hash", "c_hash", distance.cast("int").alias("distance")).distinct()


def near_hashes(index: DataFrame, queries: DataFrame, max_distance: int, bands: Callable[[int, int, int], int | None], banded: bool = False, nearest: int | None = None) -> DataFrame | None:
    """(q_hash, c_hash, distance): all pairs of different hashes within the radius; None if either side has no hash.

    ``bands(digits, asked, held)`` says in how many bands to cut hexadecimal
    hashes of one length for multi-index hashing, or None to compare blocks;
    with ``banded`` only blocks of hashes that agree in a band.  With
    ``nearest`` at least so many of the nearest are there for each query, and
    all that are as near.
    """
    q, c = (df.select(F.col("hash").alias(x)).where(F.col(x) != "").repartition(_tasks(df), x).distinct() for df, x in ((queries, "q_hash"), (index, "c_hash")))
    # a row for each length of a hash
    sizes = lambda df, x: {(r[0], r[1]): r[2] for r in df.groupBy(F.length(x), _hexed(x)).count().collect()}
    asked, held = sizes(q, "q_hash"), sizes(c, "c_hash")
    if not asked or not held:
        return None
    met = []
    for digits in sorted({n for n, hexed in asked.keys() & held.keys() if hexed}):
        own_q, own_c = (df.where(_hexed(x) & (F.length(x) == digits)) for df, x in ((q, "q_hash"), (c, "c_hash")))
        count = bands(digits, asked[digits, True], held[digits, True])
        if count:
            words = lambda df, x: df.withColumn("words", bits.hash_words(F.col(x)))
            met.append(_band_matches(words(own_q, "q_hash"), words(own_c, "c_hash"), digits, max_distance, count, held[digits, True]))
        else:
            met.append(_block_matches(own_q, own_c, digits, max_distance, asked[digits, True], held[digits, True], max_distance + 1 if banded else 1, nearest))
    lengths = [{n for n, _ in side if n <= max_distance} for side in (asked, held)]
    if not all(hexed for _, hexed in asked.keys() | held.keys()) or any(n != m for n in lengths[0] for m in lengths[1]):
        met.append(_odd_pairs(q, c, max_distance))
    out = met[0] if met else _odd_pairs(q, c, max_distance)
    for part in met[1:]:
        out = out.unionByName(part)
    return out


def _of_ids(met: DataFrame | None, index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, image_id, ord, distance) of pairs of hashes; ids of a hash that many share are dealt out."""
    q, c = queries.select("query_id", F.col("hash").alias("q_hash")), index.select("image_id", "ord", F.col("hash").alias("c_hash")).where("c_hash <> ''")
    if met is None:
        return q.join(c, F.lit(False)).select("query_id", "image_id", "ord", F.lit(0).alias("distance"))
    ids, asks = joins.in_parts(c, met, joins.hot_keys(c, ["c_hash"], 0), ["c_hash"], "image_id")
    found = ids.join(asks, ["c_hash", "part"]).select("image_id", "ord", "q_hash", "distance")
    return q.join(found, "q_hash").select("query_id", "image_id", "ord", "distance")


def radius_join_nested(index: DataFrame, queries: DataFrame, max_distance: int) -> DataFrame:
    """All pairs within the radius, by comparing all blocks of different hashes; exact for any input."""
    return _of_ids(near_hashes(index, queries, max_distance, lambda digits, asked, held: None), index, queries)


def radius_join_banded(index: DataFrame, queries: DataFrame, max_distance: int) -> DataFrame:
    """All pairs within the radius, by an equi-join on bands (pigeonhole); exact for any input.

    Hexadecimal strings of one length are cut by bits, and blocks of those that
    agree in a band are compared.  For the others see ``_odd_pairs``.
    """
    return _of_ids(near_hashes(index, queries, max_distance, lambda digits, asked, held: None, banded=True), index, queries)


def _planned(max_distance: int, bands: int | None = None) -> Callable[[int, int, int], int | None]:
    return lambda digits, asked, held: min(max(bands, -(-digits // MOST_DIGITS)), digits) if bands else plan_bands(digits, max_distance, asked, held)


def radius_join_indexed(index: DataFrame, queries: DataFrame, max_distance: int, bands: int | None = None) -> DataFrame:
    """All pairs within the radius, by multi-index hashing; exact for any input and any number of ``bands``,
    by default the cheapest one.

    Works on distinct hashes.  Hexadecimal ones of one length are cut into a few
    wide bands, and a query asks for all values of a band within its share of
    the radius; bands that many rows share are dealt out.  Where so large a
    radius leaves nothing to select blocks are compared; for strings that are
    not hexadecimal or differ in length see ``_odd_pairs``.
    """
    return _of_ids(near_hashes(index, queries, max_distance, _planned(max_distance, bands)), index, queries)


def radius_join(index: DataFrame, queries: DataFrame, max_distance: int) -> DataFrame:
    """All (query, id) pairs within ``max_distance``: (query_id, image_id, ord, distance), the cheaper way."""
    return radius_join_indexed(index, queries, max_distance)


def exact_matches(index: DataFrame, queries: DataFrame, max_distance: int, top_n: int) -> DataFrame:
    """Nearest ``top_n`` ids of each query within the radius, with their confidence.

    Ordered by distance; equal distances by the place at which the hash, then
    the id, was added.  Ids of a hash are equally near, so only ``top_n`` hashes
    of a query and ``top_n`` ids of a hash (more where they tie) meet, however
    many share one.
    """
    met = near_hashes(index, queries, max_distance, _planned(max_distance), nearest=top_n)
    if met is None:
        return _of_ids(None, index, queries).select("query_id", "image_id", "ord", "distance", bits.exact_confidence(F.col("distance")).alias("confidence"), F.lit(0).alias("channel_rank"))
    held = index.where("hash <> ''").select("image_id", "ord", F.col("hash").alias("c_hash"))
    met = met.withColumn("place", F.rank().over(Window.partitionBy("q_hash").orderBy("distance"))).where(F.col("place") <= top_n).drop("place")
    met = met.join(held.groupBy("c_hash").agg(F.min("ord").alias("first_ord")), "c_hash")
    met = met.withColumn("place", F.rank().over(Window.partitionBy("q_hash").orderBy("distance", "first_ord"))).where(F.col("place") <= top_n).drop("place")
    ids = held.withColumn("place", F.rank().over(Window.partitionBy("c_hash").orderBy("ord"))).where(F.col("place") <= top_n).drop("place")
    hits = queries.select("query_id", F.col("hash").alias("q_hash")).join(met.join(ids, "c_hash"), "q_hash")
    order = Window.partitionBy("query_id").orderBy("distance", "first_ord", "ord")
    hits = hits.withColumn("channel_rank", F.row_number().over(order)).where(F.col("channel_rank") <= top_n)
    return hits.select("query_id", "image_id", "ord", "distance", bits.exact_confidence(F.col("distance")).alias("confidence"), "channel_rank")


def index_stats(index: DataFrame) -> DataFrame:
    """unique_hashes, total_entries, collisions (both definitions), avg_entries_per_hash."""
    sizes = index.where("hash is not null and hash <> ''").groupBy("hash").count()
    return sizes.agg(
        F.count("*").alias("unique_hashes"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_entries"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("collisions_added"),
        F.count_if(F.col("count") > 1).alias("collisions_loaded"),
        F.coalesce(F.avg("count"), F.lit(0.0)).alias("avg_entries_per_hash"),
    )
