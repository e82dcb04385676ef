"""Vector code compression: product quantisation in whole numbers, with kd-trees.

A vector is cut into equal parts, and each part has a codebook.  In every round
the driver builds a kd-tree over each codebook and broadcasts them; tasks look
up the nearest entry of every part by branch and bound.  A node is left out only
if its box is farther away than the best entry so far, so nodes at an equal
bound are visited and the lowest of equally near entries is found.  Sums and
counts of each entry's parts are whole numbers: they are added up in a task, then
over tasks, in any order, and divided on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf, and vectors that are looked up together.
LEAF, BLOCK = 8, 4096
#: Components beyond this are set to it, so that squared distances stay within 64 bits.
MOST = 1 << 26


class Tree:
    """A kd-tree over the entries of a codebook; an entry's number is its row."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(entries)) if numbers is None else numbers
        own = entries[numbers]
        self.low, self.high = own.min(axis=0), own.max(axis=0)
        self.numbers, self.own, self.sides = numbers, own, ()
        axis = int(np.argmax(self.high - self.low))
        if len(numbers) > LEAF and self.high[axis] > self.low[axis]:
            order = numbers[np.argsort(own[:, axis], kind="stable")]
            cut = len(order) // 2
            self.sides = (Tree(entries, np.sort(order[:cut])), Tree(entries, np.sort(order[cut:])))

    def bound(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to the box around the entries."""
        gap = np.maximum(self.low - points, points - self.high)
        np.maximum(gap, 0, out=gap)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each point, the lowest of equals, and its squared distance."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        found = np.full(len(points), np.iinfo(np.int64).max)
        self._search(points, np.arange(len(points)), best, found)
        return found, best

    def _search(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if not self.sides:
            gap = points[rows][:, None, :] - self.own[None]
            far = np.einsum("ijk,ijk->ij", gap, gap)
            at = far.argmin(axis=1)  # the first of equals has the lowest number
            near, number = far[np.arange(len(rows)), at], self.numbers[at]
            better = (near < best[rows]) | ((near == best[rows]) & (number < found[rows]))
            best[rows[better]], found[rows[better]] = near[better], number[better]
            return
        bounds = [side.bound(points[rows]) for side in self.sides]
        left_first = bounds[0] <= bounds[1]
        for first, turn in ((0, left_first), (1, ~left_first)):
            for side in (first, 1 - first):
                # an equal bound is visited: it may hold an entry as near and lower
                open_ = np.flatnonzero(turn & (bounds[side] <= best[rows]))
                if len(open_):
                    self.sides[side]._search(points, rows[open_], best, found)


def whole_numbers(batch_column: pa.Array, width: int) -> np.ndarray:
    values = np.asarray(batch_column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)


def _clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    out = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("vector"), F.col(label_col).alias("label"))
    return out.where((F.size("vector") > 0) & ~F.exists(F.col("vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _parts(points: np.ndarray, count: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(points, count, axis=1)]


def _lookups(batches, width: int, trees: list[Tree]):
    """For each block of each batch: (batch slice, parts, codes, squared distances)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            cut = _parts(whole_numbers(part.column(part.schema.get_field_index("vector")), width), len(trees))
            found = [tree.nearest(p) for tree, p in zip(trees, cut, strict=True)]
            yield part, cut, [f[0] for f in found], [f[1] for f in found]


def _sums(rows: DataFrame, width: int, trees) -> DataFrame:
    """(slot, total): sums of the parts of each entry, position by position, then their count."""

    def add(batches):
        own = width // len(trees.value)
        total = np.zeros((len(trees.value), max(len(t.numbers) for t in trees.value), own + 1), np.int64)
        for _, cut, codes, _ in _lookups(batches, width, trees.value):
            for p, (points, code) in enumerate(zip(cut, codes, strict=True)):
                np.add.at(total[p, :, :own], code, points)
                total[p, :, own] += np.bincount(code, minlength=total.shape[1])
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["slot", "total"])

    return rows.select("vector").mapInArrow(add, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))


def train(rows: DataFrame, width: int, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after so many rounds; an entry that no part is nearest to stays."""
    spark = rows.sparkSession
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])
        sums = _sums(rows, width, trees).toArrow()  # an entry each of the codebooks: bounded by the parameters
        own, entries = width // len(books), len(books[0])
        total = np.zeros(len(books) * entries * (own + 1), np.int64)
        total[sums["slot"].to_numpy()] = sums["total"].to_numpy()
        total = total.reshape(len(books), entries, own + 1)
        count = total[:, :, own:]
        books = [np.where(c > 0, t // np.maximum(c, 1), b) for t, c, b in zip(total[:, :, :own], count, books, strict=True)]
        trees.destroy()
    return books


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in books for x in book.reshape(-1).tolist())


def encode(rows: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for part, _, codes, errors in _lookups(batches, width, trees.value):
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c in codes), strict=True)]
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([part.column(names.index("vec_id")), part.column(names.index("label")), pa.array(text, pa.string()), pa.array(sum(errors), pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], list[np.ndarray]]:
    """Codes of all vectors: (codes, decode, codebooks).

    codes: (vec_id, label, code, error, label_error), a row for each kept row.
    decode: adds to rows with a code the vector that it stands for.
    Components x count as floor(1024 x), held to 2**26 either way, far beyond
    any embedding.  Rows are left out if their vector is null or empty, holds null or
    components that are not finite, or is not as long as that of the smallest
    kept vec_id; a length that the number of parts does not divide is filled up
    with zeros.  Codebooks start as the vectors of the smallest vec_ids: null
    ones come last, and rows that repeat one go by their vectors; with fewer
    rows than entries there are fewer entries.  Equal rows get equal codes and
    each its row.  Null labels count as one label.  Only the three named columns
    are read; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = _clean(vectors, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(first[0][0]) if first else 0
    long = -(-width // parts) * parts
    # of another length: left out, also among the first
    rows = rows.where(F.size("vector") == width)
    if any(len(r[0]) != width for r in first):
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if long > width:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), long - width)))
    if not first:
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields if f.name != 'vector')}, code string, error long, label_error long"
        return spark.createDataFrame([], schema), lambda df: df.withColumn("decoded", F.array().cast("array<double>")), []
    start = np.array([[*r[0], *[0.0] * (long - width)] for r in first], np.float64)
    books = train(rows, long, _parts(np.clip(np.floor(start * SCALE), -MOST, MOST).astype(np.int64), parts), rounds)

    scratch = Scratch(spark, "codes")
    # nulls are one label: a key that is never null
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = scratch.write(encode(rows, long, books).withColumn("key", key), "coded")
    labels = scratch.write(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    out = join_counted(coded, labels, ["key"], "n", coded.count()).select("vec_id", "label", "code", "error", "label_error")

    def decode(df: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(books)
        digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

        def run(batches):
            for batch in batches:
                code = batch.column(batch.schema.get_field_index("code")).to_pylist()
                made = [np.concatenate([(b[int(c[p * digits : (p + 1) * digits], 16)] + 0.5) / SCALE for p, b in enumerate(shared.value)])[:width].tolist() for c in code]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, "decoded"])

        return df.mapInArrow(run, f"{kinds}, decoded array<double>")

    return out, decode, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
