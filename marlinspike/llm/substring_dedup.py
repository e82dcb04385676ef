"""Exact substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``window - k + 1`` consecutive k-word
hashes the smallest (the last of equals).  The choice depends on these words
only, so two equal runs of ``window`` words have the same anchor at the same
place: joining documents on anchors misses no repeat of that length.

Each anchor serves a run of windows, from so many words before it to so many
after it: its reach.  Documents are joined on repeated anchors, and matches are
extended in two steps.

1. To the whole reach: occurrences whose anchor and reach are the same form a
   class.  A class of two or more is a repeat over its whole reach, and one
   occurrence is enough to stand for it.
2. Where an anchor has several classes, which is at the edges of a repeat, one
   occurrence of each is extended word by word: l words to the left and the
   rest of the window to the right, for every l.  Occurrences that agree in
   anchor, l and the words on both sides meet under the hash of these words.

Matches that overlap or touch are merged into maximal repeats, and words
outside them are kept.  Occurrences are counted, never paired, so a passage in a
third of all documents costs in proportion to its words; classes, anchors and
windows of very many rows are joined by broadcast, not in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .shared import MOST_BITS, Scratch, bit_table, has_bit, join_counted, table_bits

WINDOW = 35
SEED = 8
#: Most occurrences that are looked up in a table; of more a list goes to each document.
TABLED = (1 << MOST_BITS) // 4
#: Windows that are worked on at once; a longer document is taken in slices.
SLICE = 1 << 17


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive keys, the last of equals."""
    n = len(keys) - width + 1
    at = np.arange(len(keys))
    best, span = at, 1
    while 2 * span <= width:
        a, b = best[:-span], best[span:]
        best = np.where(keys[b] <= keys[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(keys[b] <= keys[a], b, a)


def anchors(buf: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Yield the occurrences of anchors in a block, in slices: (first, at, m, anchor, reach, windows).

    ``first`` holds the first word of each document.  An occurrence serves the
    ``m`` windows that start at the words ``at``, ``at`` + 1 and so on;
    ``anchor`` and ``reach`` are hashes, and ``windows()`` gives for each
    window that starts in the slice its hash, its occurrence, and its number there.
    """
    starts, ends, first = K.words(buf, offsets, K.NON_SPACE)
    hashes = K.span_hashes(buf, starts, ends)
    ends = np.repeat(first[1:], np.diff(first))
    for lo in range(0, len(hashes) - window + 1, SLICE):
        hi = min(lo + SLICE, len(hashes) - window + 1)
        own = hashes[lo : hi + window - 1]
        begins = np.flatnonzero(np.arange(lo, hi) + window <= ends[lo:hi])
        if not len(begins):
            continue
        seeds = K.window_hashes(own, k)
        chosen = _sliding_min(seeds, window - k + 1)[begins]
        doc = ends[lo + begins]
        opens = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
        m = np.diff(np.append(opens, len(begins)))
        at, anchor = begins[opens], chosen[opens]
        reach = K.range_hashes(own, at, at + m + window - 1)
        reach = K.mix(reach + (m.astype(np.uint64) << np.uint64(16)) + (anchor - at).astype(np.uint64))

        def windows(own=own, begins=begins, opens=opens, m=m):
            of = np.repeat(np.arange(len(opens)), m)
            return K.window_hashes(own, window)[begins], of, np.arange(len(of)) - opens[of]

        yield first, at + lo, m, seeds[anchor], reach, windows


def _anchor_rows(docs: DataFrame, window: int, k: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for _, _, buf, offsets in K.blocks(batch.column(0)):
                for _, _, _, anchor, _, _ in anchors(buf, offsets, window, k):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    return docs.select("text").mapInArrow(rows, "anchor long")


def _occurrences(docs: DataFrame, window: int, k: int, table: np.ndarray) -> DataFrame:
    """(anchor, reach, key, at, m) of the anchors that may be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches):
        for batch in batches:
            for lo, _, buf, offsets in K.blocks(batch.column(1)):
                for first, at, m, anchor, reach, _ in anchors(buf, offsets, window, k):
                    known = has_bit(shared.value, anchor)
                    at, m, anchor, reach = at[known], m[known], anchor[known], reach[known]
                    doc = np.searchsorted(first, at, "right") - 1
                    place = (at - first[doc]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(reach.view(np.int64)), batch.column(0).take(pa.array(doc + lo)), pa.array(place), pa.array(m.astype(np.int32))],
                        ["anchor", "reach", "key", "at", "m"],
                    )

    return docs.select("key", "text").mapInArrow(rows, "anchor long, reach long, key long, at int, m int")


def _place_hash(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    return K.mix(key.view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _place_rows(places: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))], ["place"])

    return places.select("key", "at").mapInArrow(rows, "place long")


def _window_rows(docs: DataFrame, places: DataFrame, count: int, window: int, k: int, tabled: int) -> DataFrame:
    """(hash, key, at): the windows of the occurrences at ``places`` (key, at).

    Up to ``tabled`` of them are looked up in a bit table, in one pass over the
    documents; of more the list of each document is joined to its text.
    """
    if count <= tabled:
        shared = docs.sparkSession.sparkContext.broadcast(bit_table(_place_rows(places), table_bits(2 * count)))
        source = docs.select("key", "text")
    else:
        shared = None
        source = docs.select("key", "text").join(places.groupBy("key").agg(F.collect_set("at").alias("places")).hint("shuffle_hash"), "key")

    def rows(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, buf, offsets in K.blocks(batch.column(1)):
                for first, at, _, _, _, windows in anchors(buf, offsets, window, k):
                    doc = np.searchsorted(first, at, "right") - 1
                    place = at - first[doc]
                    if shared is not None:
                        wanted = has_bit(shared.value, _place_hash(keys[doc + lo], place))
                    else:
                        wanted = np.zeros(len(at), bool)
                        for d in np.unique(doc).tolist():
                            mine = doc == d
                            wanted[mine] = np.isin(place[mine], batch.column(2)[lo + d].values.to_numpy())
                    if not wanted.any():
                        continue
                    hashes, of, number = windows()
                    kept = np.flatnonzero(wanted[of])
                    of, begin = of[kept], place[of[kept]] + number[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[kept].view(np.int64)), pa.array(keys[doc[of] + lo]), pa.array(begin.astype(np.int32))], ["hash", "key", "at"])

    return source.mapInArrow(rows, "hash long, key long, at int")


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return list(zip(starts[np.append(0, cut)].tolist(), ends[np.append(cut, len(ends)) - 1].tolist(), strict=True)) if len(starts) else []


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", tabled: int = TABLED) -> DataFrame:
    """Drop the words covered by a window of words that also starts anywhere else.

    Words are split at ASCII white space and compared unchanged; windows are
    judged on the input, and their first occurrence is removed like the others.
    Returns for each document: doc_id, n_words, n_removed, spans of removed
    words (start, end), which are its maximal repeats, and kept_text, the other
    words joined by one space.  Null, empty and short texts have no windows and
    lose nothing.  Rows that repeat a doc_id are separate documents, and copies
    of each other if their texts are equal; only the two named columns are
    read; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    repeated = scratch.write(_anchor_rows(docs, window, seed).groupBy("anchor").count().where("count > 1").select("anchor"), "repeated")
    found = scratch.write(_occurrences(docs, window, seed, bit_table(repeated, table_bits(repeated.count()))), "found")
    total = found.count()

    # step 1: classes of the same reach
    classes = found.groupBy("anchor", "reach").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("rep"))
    classes = scratch.write(classes, "classes")
    whole = join_counted(found, classes.where("n > 1").select("anchor", "reach", "n"), ["anchor", "reach"], "n", total)
    hits = scratch.write(whole.select("key", F.col("at").alias("start"), (F.col("at") + F.col("m") + (window - 1)).alias("end")), "whole")

    # step 2: anchors of several classes, from one occurrence of each
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1")
    places = scratch.write(join_counted(classes.select("anchor", "rep"), scratch.write(mixed, "mixed"), ["anchor"], "classes", total).select("rep.key", "rep.at"), "places")
    windows = scratch.write(_window_rows(docs, places, places.count(), window, seed, tabled), "windows")
    twice = scratch.write(windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    edges = join_counted(windows, twice, ["hash"], "n", windows.count())
    hits = hits.unionByName(edges.select("key", F.col("at").alias("start"), (F.col("at") + window).alias("end")))
    hits = scratch.write(hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("hits")), "hits")
    scratch.drop("repeated", "found", "classes", "whole", "mixed", "places", "windows", "twice")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            lists = batch.column(2)
            for lo, hi, buf, offsets in K.blocks(batch.column(1)):
                starts, ends, first = K.words(buf, offsets, K.NON_SPACE)
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    gone = []
                    if lists[lo + i].is_valid:
                        own = lists[lo + i].values
                        gone = _merged(own.field("start").to_numpy(), own.field("end").to_numpy())
                    n_words.append(b - a)
                    n_removed.append(sum(e - s for s, e in gone))
                    spans.append([{"start": s, "end": e} for s, e in gone])
                    keep = np.ones(b - a, bool)
                    for s, e in gone:
                        keep[s:e] = False
                    words = a + np.flatnonzero(keep)
                    kept.append(b" ".join(buf[s:e].tobytes() for s, e in zip(starts[words].tolist(), ends[words].tolist(), strict=True)).decode())
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    # the lists of spans are hashed and the texts stream past, unsorted
    joined = docs.join(hits.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept_text string")
