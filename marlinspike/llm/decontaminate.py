"""Benchmark decontamination with suffix arrays over the training text.

Each Arrow batch of documents is a shard.  Its words are numbered by the
benchmark's vocabulary (0: in no item), and its suffix array is built by prefix
doubling over whole numbers.  It holds the suffixes that can start a match:
those in runs of known words that are long enough and hold a word that starts a
window.  No other suffix can match, so leaving them out loses nothing.  Every
test suffix with a window's length left is binary-searched in it; the interval
found holds all verbatim occurrences and their places.  Each occurrence is then
searched in the suffix array of the benchmark, where one of the two neighbours
has the longest common prefix, which is the longest verbatim match from there.

Suffixes are compared word by word first, then, where they go on alike, by
hashes of their beginnings, so a long copy costs no more than a short one.

The benchmark is taken in blocks of a fixed size, each of which is broadcast.
One block is one pass over the documents; of more, each pass writes what it
found, for distinct texts, and the documents are joined to the sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .shared import Scratch, free_name, with_column

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BENCHMARK_BLOCK = 8 << 20
#: Words that are compared one by one before hashes are.
_NEAR = 8
_LEAK = (
    "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<start: int, end: int>>, "
    "longest: int, longest_item: string, longest_start: int>"
)


class Words:
    """Numbered words of several texts, and what is needed to compare their suffixes.

    ``ids`` are the words, ``stop`` is where the suffix that starts at a word
    ends: behind the text or, for a shard, before the next unknown word.
    """

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, stop: np.ndarray):
        self.ids, self.stop = ids, stop
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * K._power(K._Q, len(hashes)), out=self.sums[1:])

    def begins(self, at: np.ndarray, length: np.ndarray, unit: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * unit[at]


def suffix_array(ids: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The places ``at`` in the order of the suffixes ids[place:stop[place]].

    Where a suffix does not end, its place's successor must be among them.  One
    that ends is smaller; equal ones keep their order.
    """
    if not len(at):
        return at
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[at] = np.unique(ids[at], return_inverse=True)[1] + 1
    longest, step = int((stop[at] - at).max()), 1
    while True:
        then = at + step
        key = rank[at] * (len(at) + 1) + np.where(then < stop[at], rank[np.minimum(then, len(ids))], 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        dense = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        if dense[-1] == len(at) or 2 * step > longest:
            return at[order]
        rank[at[order]] = dense
        step *= 2


def common(a: Words, at: np.ndarray, b: Words, other: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``at`` of a and at ``other`` of b."""
    room = np.minimum(a.stop[at] - at, b.stop[other] - other)
    length, alive = np.zeros(len(at), np.int64), np.flatnonzero(room > 0)
    for k in range(_NEAR):
        alive = alive[a.ids[at[alive] + k] == b.ids[other[alive] + k]]
        length[alive] = k + 1
        alive = alive[room[alive] > k + 1]
        if not len(alive):
            return length
    unit = K._power(K._inverse(K._Q), max(len(a.sums), len(b.sums)))
    x, y = at[alive], other[alive]
    low, high = length[alive], room[alive]
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.begins(x, middle, unit) == b.begins(y, middle, unit)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    length[alive] = low
    return length


def smaller(order: np.ndarray, a: Words, b: Words, at: np.ndarray, depth: int | None = None, equal: bool = False) -> np.ndarray:
    """How many of a's suffixes, in ``order``, are smaller than each of b's at ``at``.

    With ``depth`` only so many words are compared; with ``equal`` suffixes that
    agree in them count too.
    """
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        mine, theirs = order[middle], at[open_]
        length = common(a, mine, b, theirs)
        x, y = mine + length, theirs + length
        # a suffix that ends is smaller than one that goes on
        x = np.where(x < a.stop[mine], a.ids[np.minimum(x, len(a.ids) - 1)], 0)
        y = np.where(y < b.stop[theirs], b.ids[np.minimum(y, len(b.ids) - 1)], 0)
        less = x < y
        if depth is not None:
            less = np.where(length >= depth, equal, less)
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


class TestIndex:
    """Vocabulary, windows and suffix array of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([text for _, text in items], pa.string())
        hashes, item_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for lo, hi, buf, offsets in K.blocks(texts):
            buf = K.LOWER[buf]
            starts, ends, first = K.words(buf, offsets, K.ALNUM)
            hashes.append(K.span_hashes(buf, starts, ends))
            item_of.append(np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(first)))
        hashes, self.item_of = np.concatenate(hashes), np.concatenate(item_of)
        self.names = [name for name, _ in items]
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ends = np.searchsorted(self.item_of, np.arange(len(items)), "right")
        stop = ends[self.item_of].astype(np.int32)
        self.words = Words((ids + 1).astype(np.int32), hashes, stop)
        self.order = suffix_array(self.words.ids, np.arange(len(stop), dtype=np.int32), stop)
        # the words that start a window, by the window's size
        size = np.minimum(np.bincount(self.item_of, minlength=len(items)), window)[self.item_of]
        begins = np.flatnonzero(stop - np.arange(len(stop)) >= size)
        self.windows = []
        for own in np.unique(size[begins]).tolist():
            at = begins[size[begins] == own]
            opens = np.zeros(len(self.vocabulary) + 1, bool)
            opens[self.words.ids[at]] = True
            self.windows.append((own, at, opens))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, 0 for those that are in no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        near = np.searchsorted(self.vocabulary, hashes)
        near[near == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[near] == hashes, near + 1, 0).astype(np.int32)


def _scan(index: TestIndex, buf: np.ndarray, offsets: np.ndarray):
    """Per document of a shard: words, spans, items and the longest match."""
    buf = K.LOWER[buf]
    starts, ends, first = K.words(buf, offsets, K.ALNUM)
    n = len(starts)
    counts = np.diff(first)
    hashes = K.span_hashes(buf, starts, ends)
    ids = index.number(hashes)
    at = np.arange(n)
    stop = np.minimum(np.minimum.accumulate(np.where(ids > 0, n, at)[::-1])[::-1], np.repeat(first[1:], counts))
    run = stop - at
    opens = np.zeros(n, bool)
    for size, _, own in index.windows:
        opens |= (run >= size) & own[ids]
    if not opens.any():
        return counts, {}
    # whole runs that hold a word at which a match can start
    run_of = np.cumsum(np.concatenate([[True], stop[1:] != stop[:-1]])) - 1
    shard = Words(ids, hashes, stop)
    array = suffix_array(ids, np.flatnonzero((np.bincount(run_of, opens) > 0)[run_of] & (ids > 0)), stop)
    places, sizes, pairs = [], [], set()
    for size, tests, own in index.windows:
        suffixes = array[(run[array] >= size) & own[ids[array]]]
        if not len(suffixes):
            continue
        lo = smaller(suffixes, shard, index.words, tests, size)
        hi = smaller(suffixes, shard, index.words, tests, size, equal=True)
        hit = np.flatnonzero(hi > lo)
        # test suffixes with the same window have the same interval
        for begin, end, items in _intervals(lo[hit], hi[hit], index.item_of[tests[hit]]):
            where = suffixes[begin:end]
            places.append(where)
            sizes.append(np.full(len(where), size))
            docs = np.unique(np.searchsorted(first, where, "right") - 1).tolist()
            pairs.update((d, i) for d in docs for i in items)
    if not places:
        return counts, {}
    where, size = np.concatenate(places), np.concatenate(sizes)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + size, -1)
    hit = np.cumsum(cover[:-1]) > 0
    where = np.unique(where)
    length, test = longest(index, shard, where)
    doc = np.searchsorted(first, where, "right") - 1
    found: dict[int, set[str]] = {}
    for d, i in pairs:
        found.setdefault(d, set()).add(index.names[i])
    out = {}
    for d, names in found.items():
        a, b = int(first[d]), int(first[d + 1])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        best = mine.start + int(np.argmax(length[mine]))
        out[d] = (edges.reshape(-1, 2).tolist(), names, int(length[best]), index.names[index.item_of[test[best]]], int(where[best] - a))
    return counts, out


def _intervals(lo: np.ndarray, hi: np.ndarray, items: np.ndarray):
    order = np.lexsort((items, lo))
    cut = np.flatnonzero(np.diff(lo[order])) + 1
    for group in np.split(order, cut) if len(order) else []:
        yield int(lo[group[0]]), int(hi[group[0]]), np.unique(items[group]).tolist()


def longest(index: TestIndex, shard: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of, and test position of, the longest match from each place of a shard."""
    spot = smaller(index.order, index.words, shard, at)
    best, test = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for shift in (-1, 0):
        other = index.order[np.clip(spot + shift, 0, len(index.order) - 1)]
        length = common(shard, at, index.words, other)
        test = np.where(length > best, other, test)
        best = np.maximum(best, length)
    return best, test


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of items; the first may be empty, the others are not."""
    held, size, first = [], 0, True
    for row in benchmark.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= block_bytes:
            yield held
            held, size, first = [], 0, False
    if held or first:
        yield held


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", name: str = "leak", block_bytes: int = BENCHMARK_BLOCK
) -> tuple[DataFrame, str]:
    """Add a struct column on the benchmark passages in each document.

    Words are runs of ASCII letters and digits and of all characters above
    ASCII, A-Z lower-cased.  A window is ``window`` consecutive words of an
    item, or all words of a shorter one.  Fields: n_words; n_hit, the words
    inside any occurrence of a window; items, the ids (as text, ascending)
    whose windows occur; spans of hit words; and the longest verbatim match
    with its item and place.

    Null and empty texts have no words; null, empty and wordless items have no
    windows; an empty benchmark leaves all documents clean, and an empty table
    of documents gives none.  Of longest matches of the same length the first
    in the document counts.  Each input row gives one row, repeated or not,
    with all its columns.  Returns the frame
    and the column's name: ``name``, or ``name`` with underscores added where
    the documents have such a column.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and length(text) > 0")
    name = free_name(docs, name)
    blocks = _blocks(rows, block_bytes)
    held, following = next(blocks), next(blocks, None)
    if not following:
        shared = spark.sparkContext.broadcast(TestIndex(held, window))
        return with_column(docs, name, _LEAK, lambda batch: _leaks(shared, batch, text_col)), name
    scratch, parts, number = Scratch(spark, "leaks"), None, 0
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("length(text) > 0").withColumn("key", F.md5(F.col("text").cast("binary")))
    while held:
        shared = spark.sparkContext.broadcast(TestIndex(held, window))
        found = with_column(texts, "leak", _LEAK, lambda batch, shared=shared: _leaks(shared, batch, "text"))
        found = scratch.write(found.where("leak.n_hit > 0").groupBy("key").agg(F.first("leak").alias("leak")), f"block-{number}")
        parts = found if parts is None else parts.unionByName(found)
        held, following, number = following, next(blocks, None) if following else None, number + 1
    key, hits = free_name(docs, "text_key"), free_name(docs, "text_hits")
    hits_of = scratch.write(parts.groupBy("key").agg(F.collect_list("leak").alias(hits)).withColumnRenamed("key", key), "hits")
    keyed = docs.withColumn(key, F.md5(F.col(text_col).cast("string").cast("binary"))).join(hits_of, key, "left")
    return with_column(keyed, name, _LEAK, lambda batch: _sums(batch, text_col, hits)).drop(key, hits), name


def _leak(n_words: int, spans: list, items: set[str], length: int, item: str | None, start: int | None) -> dict:
    return {
        "n_words": n_words, "n_hit": sum(b - a for a, b in spans), "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in spans],
        "longest": length, "longest_item": item, "longest_start": start,
    }


def _leaks(shared, batch: pa.RecordBatch, text_col: str) -> list[dict]:
    out = []
    for lo, hi, buf, offsets in K.blocks(batch.column(batch.schema.get_field_index(text_col)), 4 << 20):
        counts, found = _scan(shared.value, buf, offsets)
        out += [_leak(int(counts[i]), *found.get(i, ([], set(), 0, None, None))) for i in range(hi - lo)]
    return out


def _sums(batch: pa.RecordBatch, text_col: str, hits: str) -> list[dict]:
    """The leaks of all blocks of the benchmark as one."""
    out, parts = [], batch.column(batch.schema.get_field_index(hits)).to_pylist()
    for lo, hi, buf, offsets in K.blocks(batch.column(batch.schema.get_field_index(text_col)), 4 << 20):
        counts = np.diff(K.words(buf, offsets, K.ALNUM)[2])
        for i in range(hi - lo):
            own = parts[lo + i] or []
            spans = _merge([[s["start"], s["end"]] for p in own for s in p["spans"]])
            best = max(own, key=lambda p: (p["longest"], -p["longest_start"]), default={"longest": 0, "longest_item": None, "longest_start": None})
            out.append(_leak(int(counts[i]), spans, {x for p in own for x in p["items"]}, best["longest"], best["longest_item"], best["longest_start"]))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    found, name = find_leaks(docs, benchmark, **options)
    return found.where(F.col(name)["n_hit"] == 0).select(*docs.columns)
