"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents are tokenised and cut into full sequences and one remainder.
Remainders are counted by length class (``unit`` tokens a class), which gives a
histogram of fixed size whatever the corpus.  A linear program over patterns
(multisets of classes that fit a sequence) is solved by column generation: the
simplex basis prices the classes, and knapsack dynamic programming finds the
pattern with the best price.  Pattern counts are rounded down; what that leaves,
less than one sequence a pattern, is packed first-fit decreasing.

Each piece then gets its rank within its class from salted counts, and the rank
gives sequence and slot through a table of pattern blocks, whose size depends on
the number of classes only.
"""

from __future__ import annotations

import base64
import logging
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import Scratch

SEQUENCE = 2048
UNIT = 8
END_ID = 1
#: About so many pieces of a class are ranked together.
TOGETHER = 20_000
_encoders: dict[tuple[str, str, bool], object] = {}


class Encoder:
    """Byte-level BPE ids of texts.

    Texts within Latin-1 go through the faster of two libraries that hold the
    same vocabulary; others through the one that defines the ids, as their
    notions of letters may differ in newer scripts.  With ``added`` the literal
    of an added token, such as an end mark, is that token, as in the defining
    library's default call; else it is spelt out like other text.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.load = lambda: Tokenizer.from_file(json_path)
        self.defining, self.added, self.literals = None, added, None
        if added:
            tokens = self.load().get_added_tokens_decoder().values()
            # the library may match lower-cased or trimmed text too, so the search is as wide
            self.literals = re.compile("|".join(re.escape(t.content.strip()) for t in tokens), re.IGNORECASE) if tokens else None

    def __call__(self, text: str) -> list[int]:
        if text.isascii() or self._latin(text):
            if self.literals is None or not self.literals.search(text):
                return self.fast.encode_ordinary(text)
        if self.defining is None:
            self.defining = self.load()
            self.defining.encode_special_tokens = not self.added
        return self.defining.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True


def encoder(json_path: str | None = None, ranks_path: str | None = None, added: bool = False) -> Encoder:
    """One encoder a worker; the default files are the installed public ones."""
    import public_tokenizers

    key = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), added)
    if key not in _encoders:
        _encoders[key] = Encoder(*key[:2], public_tokenizers.PATTERN, added)
    return _encoders[key]


def cut(docs: DataFrame, text_col: str, sequence: int, end_id: int, with_ids: bool, files: tuple[str | None, str | None]) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of all documents."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def pieces(batches):
        encode = encoder(*files, added=True)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                for start in range(0, len(ids), sequence):
                    own = ids[start : start + sequence]
                    made = (doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), own.astype(np.int32))
                    for column, value in zip(rows, made, strict=False):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_col).mapInArrow(pieces, schema)


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total price of a multiset of classes within the capacity, and its counts."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(prices > 0)
    own, worth = sizes[useful], prices[useful]
    order = np.argsort(own, kind="stable")
    own, worth, useful = own[order], worth[order], useful[order]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(own, room, "right")
        if n:
            value = best[room - own[:n]] + worth[:n]
            k = int(np.argmax(value))
            if value[k] > best[room] + 1e-12:
                best[room], chosen[room] = value[k], k
    counts, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[useful[chosen[room]]] += 1
            room -= own[chosen[room]]
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, patience: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows of counts), how often each is used in the linear optimum, and a lower bound of that.

    Minimises the number of sequences subject to packing each class exactly
    ``demand`` times.  The bound comes from the prices: divided by the best
    pattern's price they are a solution of the dual program.  It equals the sum
    of the uses where they are optimal.  Where ``patience`` pivots in a row gain
    nothing, the basis, which is feasible at every step, is taken as it is.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(basis))
    level = inverse @ demand
    best, idle, step, kept, bound = float(level.sum()), 0, 0, (basis.copy(), level.copy()), 0.0
    while idle < patience and step < 50 * m + 1000:
        prices = inverse.sum(axis=0)
        value, column = knapsack(prices, sizes, capacity)
        bound = max(bound, float(np.maximum(prices, 0) @ demand) / max(value, 1.0))
        if value <= 1 + 1e-7:
            break
        move = inverse @ column
        able = move > 1e-7
        if not able.any():
            break
        ratio = np.where(able, np.maximum(level, 0) / np.where(able, move, 1), np.inf)
        theta = ratio.min()
        # of rows that leave together the one with the largest pivot keeps the basis well-conditioned
        out = int(np.argmax(np.where(ratio <= theta + 1e-9, move, -np.inf)))
        level -= theta * move
        level[out] = theta
        inverse[out] /= move[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        basis[:, out] = column
        step += 1
        if step % 400 == 0:  # sheds rounding errors
            try:
                inverse = np.linalg.inv(basis)
            except np.linalg.LinAlgError:
                break
            level = inverse @ demand
        total = float(level.sum())
        if not np.isfinite(total) or level.min() < -1e-6 * max(1.0, best):
            break
        idle += 1
        if 0 < total < best * (1 - 1e-7):
            best, idle, kept = total, 0, (basis.copy(), level.copy())
    basis, level = kept
    return basis.T.round().astype(np.int64), np.maximum(level, 0), min(bound, best)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: count} and the number of sequences of each; every piece is placed."""
    used: list[tuple[dict[int, int], int]] = []
    left = dict(histogram)
    if whole := left.pop(capacity, 0):
        used.append(({capacity: 1}, whole))
    sizes = np.array(sorted(left))
    if len(sizes):
        demand = np.array([left[s] for s in sizes.tolist()], np.float64)
        patterns, level, bound = solve_patterns(sizes, demand, capacity)
        if level.sum() > bound * 1.001 + 1:
            logging.getLogger(__name__).warning("the patterns use %.1f sequences; the optimum is %.1f at least", level.sum(), bound)
        for row, times in zip(patterns, np.floor(level + 1e-6).astype(np.int64).tolist(), strict=True):
            pattern = {int(s): int(c) for s, c in zip(sizes, row, strict=True) if c}
            if pattern:
                times = min([times, *(left[s] // c for s, c in pattern.items())])
            if times > 0 and pattern:
                used.append((pattern, times))
                for s, c in pattern.items():
                    left[s] -= c * times
    rest = {s: c for s, c in left.items() if c}
    while rest:
        pattern, room = {}, capacity
        for s in sorted(rest, reverse=True):
            if take := min(rest[s], room // s):
                pattern[s] = take
                room -= take * s
        times = min(rest[s] // c for s, c in pattern.items())
        used.append((pattern, times))
        rest = {s: n for s, c in rest.items() if (n := c - times * pattern.get(s, 0))}
    return used


def pack(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    unit: int = UNIT,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    files: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Pack all documents into sequences of at most ``sequence`` tokens.

    Returns one row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset, and with ``with_ids`` the token ids.  A
    document's ids end with ``end_id``; a null or empty text has that id alone.
    Each input row is a document of its own, repeated or not.  Pieces lie
    gapless in their sequence, longest class first.  Of the input only the two
    named columns are read; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = scratch.write(cut(docs, "text", sequence, end_id, with_ids, files), "pieces")
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    pieces = made.withColumn("class", ((F.col("length") + unit - 1) / unit).cast("int"))
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # sequence / unit rows at most

    # ranks within a class: its salts one after the other, each counted on its own; their number grows with the class
    salts = F.lit(1)
    for size, count in histogram.items():
        if count > TOGETHER:
            salts = F.when(F.col("class") == size, -(-count // TOGETHER)).otherwise(salts)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    counts = scratch.write(pieces.groupBy("class", "salt").count(), "counts")
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("class", "salt", "before")
    own = Window.partitionBy("class", "salt").orderBy(*order)
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(counts, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("own"))

    rows, begun, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, sequence // unit):
        for size, count in pattern.items():
            rows.append((size, begun[size], begun[size] + count * times, count, first))
            begun[size] += count * times
        first += times
    blocks = spark.createDataFrame(rows, "b_class int, rank_from long, rank_to long, per long, first_sequence long")
    placed = ranked.join(F.broadcast(blocks), (F.col("class") == F.col("b_class")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
