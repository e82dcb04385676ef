"""Vector search: exact, by inverted lists, by codes of residuals in them, and by random planes.

A corpus is a frame (image_id, ord, vector); queries are (query_id, vector).
Searches return (query_id, image_id, ord, similarity, vector_rank); equal
similarities go by ord.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import bits, joins

#: Most bytes of query vectors, and of their best rows, that a task holds at once; more queries take more passes.
QUERY_BLOCK = 64 << 20
#: Scores that are worked out at once.
SCORES = 1 << 20
#: Most times the wanted rows that codes select for the exact ranking.
MOST_WIDEN = 100
#: Most numbers of lists that are broadcast.
MOST_VISITED = 1_000_000
#: From so many tasks at once on, a query's rows are merged in two steps.
WIDE_CLUSTER, MERGES = 256, 64
#: Most queries that are broadcast in a nested-loop join.
PLAIN_QUERIES = 1000
#: Share of true neighbours that a calibrated search is to find on its sample, which is bounded.
TARGET, CALIBRATION_QUERIES = 0.97, 200


def _top(scored: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Rank, cut to k, and only then apply the threshold.

    A task hands on k rows a query at most.  On a wide cluster they are first
    merged in MERGES groups, so that no task gets all of a query's rows.
    """
    by = [F.desc("similarity"), "ord"]
    if scored.sparkSession.sparkContext.defaultParallelism > WIDE_CLUSTER:
        group = F.pmod(F.xxhash64("image_id"), F.lit(MERGES))
        scored = scored.withColumn("merge", group).withColumn("place", F.row_number().over(Window.partitionBy("query_id", "merge").orderBy(*by))).where(F.col("place") <= k).drop("merge", "place")
    out = scored.withColumn("vector_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("vector_rank") <= k)
    return out if threshold is None else out.where(F.col("similarity") >= threshold)


class Best:
    """The k best rows of each query, by falling score and then by place; takes blocks of scores as they come."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.held = k, np.full(queries, -np.inf), 0
        self.most = max(2 * queries * k, 1 << 18)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, scores: np.ndarray, ids: pa.Array, places: np.ndarray) -> None:
        """``scores`` has a row for each query and a column for each of ``ids``."""
        n = scores.shape[1]
        floor = self.floor
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        q, c = np.nonzero(scores >= floor[:, None])
        if len(q):
            self.parts.append((q, scores[q, c], places[c], ids.take(pa.array(c))))
            self.held += len(q)
            if self.held > self.most:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        q, score, place = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        ids = pa.concat_arrays([p[3] for p in self.parts])
        order = np.lexsort((place, -score, q))
        first = np.searchsorted(q[order], np.arange(len(self.floor)))
        rank = np.arange(len(order)) - first[q[order]]
        kth = rank == self.k - 1
        self.floor[q[order][kth]] = score[order][kth]
        order = order[rank < self.k]
        self.parts = [(q[order], score[order], place[order], ids.take(pa.array(order)))]
        self.held = len(order)
        return self.parts[0]

    def batch(self, query_ids: pa.Array) -> pa.RecordBatch | None:
        rows = self.cut()
        if rows is None:
            return None
        q, score, place, ids = rows
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids, pa.array(place), pa.array(score)], ["query_id", "image_id", "ord", "similarity"])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def _id_array(values: list, kind: str) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array(values, to_arrow_type(T._parse_datatype_string(kind)))


def fit_dimension(vectors: DataFrame, dimension: int, strict: bool = False, column: str = "vector") -> DataFrame:
    """Drop vectors of another length (queries), or fail on them (corpus)."""
    fits = F.size(column) == dimension
    if strict:
        return vectors.withColumn(column, F.when(fits, F.col(column)).otherwise(F.raise_error(F.lit(f"a vector's length is not {dimension}"))))
    return vectors.where(F.col(column).isNotNull() & fits)


def search_plain(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Exact search as one declarative plan, as a baseline; more than PLAIN_QUERIES queries go to ``search``."""
    if queries.limit(PLAIN_QUERIES + 1).count() > PLAIN_QUERIES:
        return search(corpus, queries, k, threshold)
    q = queries.select("query_id", bits.normalize(F.col("vector")).alias("q_unit"))
    c = corpus.select("image_id", "ord", bits.normalize(F.col("vector")).alias("c_unit"))
    pairs = c.join(F.broadcast(q), F.lit(True)).select("query_id", "image_id", "ord", bits.inner_product(F.col("q_unit"), F.col("c_unit")).alias("similarity"))
    return _top(pairs, k, threshold)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _local_top(query_ids: pa.Array, matrix: np.ndarray, k: int):
    """The k best rows of each query over all of a task's batches, by blocked matrix products."""

    def run(batches):
        unit, best = _unit(matrix), Best(len(matrix), k)
        step = max(1, SCORES // len(matrix))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                # twelve digits: equal vectors get equal scores, whatever block they are in
                best.add(np.round(unit @ _unit(_matrix(part.column(2), part.num_rows)).T, 12), part.column(0), part.column(1).to_numpy())
        if (made := best.batch(query_ids)) is not None:
            yield made

    return run


def query_blocks(queries: DataFrame, dimension: int, row_bytes: int):
    """(ids, vectors) of blocks of queries, each of QUERY_BLOCK bytes at most."""
    ids, held = [], []
    for row in fit_dimension(queries.select("query_id", "vector"), dimension).toLocalIterator():
        ids.append(row[0])
        held.append(row[1])
        if len(held) * row_bytes >= QUERY_BLOCK:
            yield ids, np.array(held, np.float64)
            ids, held = [], []
    if held:
        yield ids, np.array(held, np.float64)


def candidates(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, image_id, ord, similarity): the k nearest to each query that each task has read."""
    first = corpus.select(F.size("vector")).where("vector is not null").first()
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), corpus.schema["image_id"].dataType.simpleString()
    schema = f"query_id {q_type}, image_id {c_type}, ord long, similarity double"
    found = corpus.sparkSession.createDataFrame([], schema)
    if first is None:
        return found
    rows = fit_dimension(corpus.select("image_id", F.col("ord").cast("long").alias("ord"), "vector"), first[0])
    parts = [rows.mapInArrow(_local_top(_id_array(ids, q_type), held, k), schema) for ids, held in query_blocks(queries, first[0], max(8 * first[0], 32 * k))]
    for number, part in enumerate(parts):
        found = found.unionByName(part) if number else part
    return found


def search(corpus: DataFrame, queries: DataFrame, k: int = 100, threshold: float | None = None) -> DataFrame:
    """Exact top-k cosine search by blocked matrix products.

    The queries are taken in blocks of bounded bytes; each block goes to all
    tasks, and a task keeps the k best rows of each query over all that it
    reads.  So k rows a query and task are shuffled at most, however large the
    corpus and its batches.  An empty corpus gives no rows.
    """
    return _top(candidates(corpus, queries, k), k, threshold)


def shrink_lists(n: int, lists: int) -> int:
    """Fewer lists than asked for where there are under 39 vectors a list."""
    return lists if n >= 39 * lists else max(1, n // 39)


#: More lists than this are trained in two steps, a few coarse ones first.
COARSE = 256


def _sampled(corpus: DataFrame, sample_rows: int, n: int) -> DataFrame:
    """At most ``sample_rows`` rows: those of the smallest hash of the id."""
    return corpus.orderBy(F.xxhash64("image_id"), "image_id").limit(sample_rows) if n > sample_rows else corpus


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of a bounded sample; an empty one moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        far = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
        own = far.argmin(axis=1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        for i, at in zip(np.flatnonzero(size == 0), np.argsort(-far[np.arange(len(x)), own], kind="stable"), strict=False):
            centres[i] = x[at]
    return centres


def train_cells(corpus: DataFrame, lists: int, seed: int = 7, sample_rows: int = 100_000) -> np.ndarray:
    """Centres of the inverted lists, from a sample of at most ``sample_rows`` vectors, or 39 a list.

    Many lists are trained in two steps: some square root of them as coarse
    ones, then each coarse one's share from its part of the sample, a task each.
    """
    n = corpus.count()
    k = shrink_lists(n, lists)
    sample = _sampled(corpus.select("image_id", "vector"), max(sample_rows, 39 * k), n).withColumn("unit", bits.normalize(F.col("vector")))
    coarse = k if k <= COARSE else int(np.ceil(np.sqrt(k)))
    model = KMeans(k=coarse, seed=seed, maxIter=15).fit(sample.select(array_to_vector("unit").alias("features")))
    centres = np.array(model.clusterCenters())
    if coarse == k:
        return centres
    parts = assign_cells(sample.select("image_id", "vector"), centres)
    sizes = dict(parts.groupBy("cell_id").count().collect())  # a row a coarse list
    total = sum(sizes.values())
    share = {c: max(1, round(k * size / total)) for c, size in sizes.items()}

    def train(key, table):
        made = _lloyd(_matrix(table["unit"], table.num_rows), share[key[0].as_py()], 15, seed)
        return pa.table({"centre": pa.array(made.tolist(), pa.list_(pa.float64()))})

    fine = parts.select("cell_id", "unit").groupBy("cell_id").applyInArrow(train, "centre array<double>")
    return np.array([r[0] for r in fine.collect()])  # the centres, whose number is a parameter


def _nearest(vectors: DataFrame, centres: np.ndarray, count: int, name: str) -> DataFrame:
    """Add the numbers of the ``count`` nearest centres of each unit vector, by product (ties by number).

    Centres are broadcast as one matrix and multiplied with blocks of vectors.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    at, count = vectors.columns.index("unit"), min(count, len(centres))

    def run(batches):
        step = max(1, SCORES // len(shared.value))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                scores = np.round(_matrix(batch.column(at), batch.num_rows) @ shared.value.T, 12)
                near = np.argsort(-scores, axis=1, kind="stable")[:, :count] if count > 1 else scores.argmax(axis=1)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, count, dtype=np.int32)), pa.array(near.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    return vectors.mapInArrow(run, f"{kinds}, {name} array<int>")


def assign_cells(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add cell_id; write the result partitioned by it to prune files at search time."""
    units = corpus.withColumn("unit", bits.normalize(F.col("vector")))
    return _nearest(units, centres, 1, "cells").withColumn("cell_id", F.get("cells", F.lit(0))).drop("cells")


def _visits(queries: DataFrame, centres: np.ndarray, probe: int) -> DataFrame:
    """(query_id, unit, cell_id): the ``probe`` nearest lists of each query."""
    q = queries.select("query_id", bits.normalize(F.col("vector")).alias("unit"))
    return _nearest(q, centres, probe, "cells").select("query_id", "unit", F.explode("cells").alias("cell_id"))


def _search_parts(cells: DataFrame, visits: DataFrame, k: int, score) -> DataFrame:
    """(query_id, image_id, ord, similarity): the k best of each query in each part of each list that it visits.

    ``cells`` has cell_id, image_id, ord and what ``score(cell, table, units)``
    takes; lists of many rows are split by their counts, so a task holds a
    bounded part of one.
    """
    q_type, c_type = visits.schema["query_id"].dataType.simpleString(), cells.schema["image_id"].dataType.simpleString()
    visited = visits.select("cell_id").distinct()
    cells = cells.join(F.broadcast(visited) if visited.limit(MOST_VISITED + 1).count() <= MOST_VISITED else visited, "cell_id", "left_semi")
    # no more hot lists than there are lists, so the size of a part need not grow with the index
    cells, visits = joins.in_parts(cells, visits, joins.hot_keys(cells, ["cell_id"], 0), ["cell_id"], "image_id")

    def best_of(key, rows, asks):
        kinds = pa.schema([("query_id", asks.schema.field("query_id").type), ("image_id", rows.schema.field("image_id").type), ("ord", pa.int64()), ("similarity", pa.float64())])
        if not rows.num_rows or not asks.num_rows:
            return kinds.empty_table()
        units, ids, places = _matrix(asks["unit"], asks.num_rows), rows["image_id"].combine_chunks(), rows["ord"].to_numpy()
        best, out = Best(asks.num_rows, k), []
        scorer = score(key[0].as_py(), rows, units)
        step = max(1, SCORES // asks.num_rows)
        for lo in range(0, rows.num_rows, step):
            best.add(np.round(scorer(lo, min(lo + step, rows.num_rows)), 12), ids.slice(lo, step), places[lo : lo + step])
        made = best.batch(asks["query_id"].combine_chunks())
        return pa.Table.from_batches([made]).cast(kinds) if made is not None else kinds.empty_table()

    keys = ["cell_id", "part"]
    rows = cells.withColumn("ord", F.col("ord").cast("long")).groupBy(*keys).cogroup(visits.groupBy(*keys))
    return rows.applyInArrow(best_of, f"query_id {q_type}, image_id {c_type}, ord long, similarity double")


def search_cells(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probe: int, threshold: float | None = None) -> DataFrame:
    """Search the ``probe`` nearest lists of each query; with all lists it is exact."""

    def products(cell, table, units):
        rows = _matrix(table["unit"], table.num_rows)
        return lambda lo, hi: units @ rows[lo:hi].T

    return _top(_search_parts(indexed.select("cell_id", "image_id", "ord", "unit"), _visits(queries, centres, probe), k, products), k, threshold)


def calibrate_probe(indexed: DataFrame, centres: np.ndarray, k: int, target: float = TARGET, most: int = CALIBRATION_QUERIES) -> int:
    """Lists that a search has to visit for ``target`` of the true ``k`` neighbours.

    Measured by exact search for at most ``most`` vectors of the index (smallest
    hash of the id): how far down each one's list of lists its neighbours lie.
    """
    sample = indexed.orderBy(F.xxhash64("image_id"), "image_id").limit(most).select(F.col("image_id").alias("query_id"), F.col("unit").alias("vector"))
    near = search(indexed.select("image_id", "ord", F.col("unit").alias("vector")), sample, k).select("query_id", "image_id")
    order = _nearest(sample.withColumnRenamed("vector", "unit"), centres, len(centres), "cells").select("query_id", "cells")
    # at most ``most`` queries with k neighbours each
    ranks = near.join(indexed.select("image_id", "cell_id"), "image_id").join(order, "query_id").groupBy(F.array_position("cells", F.col("cell_id")).alias("rank")).count().collect()
    total, seen = sum(r["count"] for r in ranks), 0
    for r in sorted(ranks, key=lambda r: r["rank"]):
        seen += r["count"]
        if seen >= target * total:
            return int(r["rank"])
    return len(centres)


def train_codebooks(corpus: DataFrame, parts: int, bits_per_code: int = 8, seed: int = 7, sample_rows: int = 100_000) -> list[np.ndarray]:
    """A codebook for each of ``parts`` equal slices of the unit vectors."""
    n = corpus.count()
    sample = (corpus.orderBy(F.xxhash64("image_id"), "image_id").limit(sample_rows) if n > sample_rows else corpus).withColumn("unit", bits.normalize(F.col("vector")))
    width = sample.select(F.size("unit")).first()[0] // parts
    k = min(2**bits_per_code, max(1, n // 4))
    books = []
    for j in range(parts):
        features = sample.select(array_to_vector(F.slice("unit", j * width + 1, width)).alias("features"))
        books.append(np.array(KMeans(k=k, seed=seed, maxIter=10).fit(features).clusterCenters()))
    return books


def encode(corpus: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Add codes: the nearest codebook entry of each slice."""
    width = books[0].shape[1]
    kept = [c for c in corpus.columns if c != "vector"]
    types = ", ".join(f"{c} {corpus.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("vector")
            n = batch.num_rows
            unit = _unit(np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)) if n else np.zeros((0, width * len(books)))
            codes = np.stack([((unit[:, j * width : (j + 1) * width, None] - b.T[None]) ** 2).sum(axis=1).argmin(axis=1) for j, b in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(codes.tolist(), pa.list_(pa.int32()))], [*kept, "codes"])

    return corpus.mapInArrow(run, f"{types}, codes array<int>")


def search_codes(encoded: DataFrame, books: list[np.ndarray], queries: DataFrame, k: int, threshold: float | None = None, corpus: DataFrame | None = None, widen: int = 10) -> DataFrame:
    """Search by inner products from lookup tables of each query and codebook.

    Inner product, not distance, so that thresholds mean the same as in the
    other searches.  The queries are taken in blocks of bounded bytes, as in
    ``search``; a task keeps its best rows of each query.  With
    ``corpus`` the best ``widen`` times k by codes are ranked again by their
    exact products, which makes up for what the codes lose.
    """
    width, wide = books[0].shape[1], k * widen if corpus is not None else k
    c_type, q_type = encoded.schema["image_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, image_id {c_type}, ord long, similarity double"
    rows, found = encoded.select("image_id", F.col("ord").cast("long").alias("ord"), "codes"), encoded.sparkSession.createDataFrame([], schema)
    # a query's lookup tables, and its best rows: twice as many until they are cut, which takes four copies
    for number, (ids, held) in enumerate(query_blocks(queries, width * len(books), len(books) * len(books[0]) * 8 + 8 * 32 * wide)):
        unit = _unit(held)
        tables = [unit[:, j * width : (j + 1) * width] @ b.T for j, b in enumerate(books)]
        part = rows.mapInArrow(_code_top(_id_array(ids, q_type), tables, wide), schema)
        found = found.unionByName(part) if number else part
    found = _top(found, wide, None if corpus is not None else threshold)
    if corpus is None:
        return found
    return rerank(found, corpus, queries, k, threshold)


def train_residual_books(indexed: DataFrame, centres: np.ndarray, parts: int, bits_per_code: int = 8, seed: int = 7, sample_rows: int = 20_000) -> list[np.ndarray]:
    """A codebook for each of ``parts`` slices of what the vectors differ from their list's centre, from a bounded sample; a task each."""
    spark, n = indexed.sparkSession, indexed.count()
    sample = _sampled(indexed.select("image_id", "unit", "cell_id"), sample_rows, n).select("unit", "cell_id").toArrow()
    rest = (_matrix(sample["unit"], sample.num_rows) - centres[sample["cell_id"].to_numpy()]).astype(np.float32)
    k, shared = min(2**bits_per_code, max(1, len(rest) // 4)), spark.sparkContext.broadcast(rest)

    def train(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                own = np.array_split(shared.value, parts, axis=1)[part].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_lloyd(own, k, 12, seed).tolist()], pa.list_(pa.list_(pa.float64())))], ["part", "book"])

    made = spark.range(0, parts, 1, parts).mapInArrow(train, "part long, book array<array<double>>").collect()
    return [np.array(r["book"]) for r in sorted(made, key=lambda r: r["part"])]


def encode_cells(indexed: DataFrame, centres: np.ndarray, books: list[np.ndarray]) -> DataFrame:
    """(image_id, ord, cell_id, codes): a byte or two for each slice of the vector's difference from its centre."""
    shared = indexed.sparkSession.sparkContext.broadcast((centres, books))
    kind = np.uint8 if max(map(len, books)) <= 256 else np.uint16
    c_type = indexed.schema["image_id"].dataType.simpleString()

    def run(batches):
        middles, tables = shared.value
        for batch in batches:
            n = batch.num_rows
            cells = batch.column(2).to_numpy()
            rest = _matrix(batch.column(3), n) - middles[cells]
            cut = np.array_split(rest, len(tables), axis=1)
            codes = np.stack([((b**2).sum(axis=1) - 2 * (x @ b.T)).argmin(axis=1) for x, b in zip(cut, tables, strict=True)], axis=1).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary())], ["image_id", "ord", "cell_id", "codes"])

    rows = indexed.select("image_id", F.col("ord").cast("long").alias("ord"), "cell_id", "unit")
    return rows.mapInArrow(run, f"image_id {c_type}, ord long, cell_id int, codes binary")


def search_cell_codes(
    encoded: DataFrame, centres: np.ndarray, books: list[np.ndarray], queries: DataFrame, k: int, probe: int, threshold: float | None = None, corpus: DataFrame | None = None, widen: int = 10
) -> DataFrame:
    """Search the codes in the ``probe`` nearest lists of each query.

    A vector is its list's centre and the codes of its difference from it, so
    its product with a query is that of the centre and of the codes' entries,
    looked up in a table of each query and codebook.  With ``corpus`` the best
    ``widen`` times k are ranked again by their exact products.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((centres, books))
    kind, wide = np.uint8 if max(map(len, books)) <= 256 else np.uint16, k * widen if corpus is not None else k

    def lookups(cell, table, units):
        middles, entries = shared.value
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), kind).reshape(table.num_rows, -1)
        cut = np.array_split(units, len(entries), axis=1)
        tables = [x @ b.T for x, b in zip(cut, entries, strict=True)]
        base = units @ middles[cell]
        return lambda lo, hi: base[:, None] + sum(t[:, codes[lo:hi, j]] for j, t in enumerate(tables))

    found = _top(_search_parts(encoded, _visits(queries, centres, probe), wide, lookups), wide, None if corpus is not None else threshold)
    return found if corpus is None else rerank(found, corpus, queries, k, threshold)


def calibrate_widen(indexed: DataFrame, encoded: DataFrame, centres: np.ndarray, books: list[np.ndarray], k: int, probe: int, target: float = TARGET, most: int = CALIBRATION_QUERIES) -> int:
    """How many times ``k`` rows by codes hold ``target`` of the true neighbours that the visited lists hold, MOST_WIDEN at most.

    Measured like ``calibrate_probe``.
    """
    sample = indexed.orderBy(F.xxhash64("image_id"), "image_id").limit(most).select(F.col("image_id").alias("query_id"), F.col("unit").alias("vector"))
    near = search(indexed.select("image_id", "ord", F.col("unit").alias("vector")), sample, k).select("query_id", "image_id")
    ranks = search_cell_codes(encoded, centres, books, sample, k * MOST_WIDEN, probe).join(near, ["query_id", "image_id"]).select("vector_rank").collect()
    if not ranks:
        return MOST_WIDEN
    ranks = sorted(r[0] for r in ranks)  # at most ``most`` queries with k neighbours each
    return min(MOST_WIDEN, max(1, -(-ranks[int(np.ceil(target * len(ranks))) - 1] // k)))


def rerank(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Candidates (query_id, image_id) in the order of their exact products."""
    q = queries.select("query_id", bits.normalize(F.col("vector")).alias("q_unit"))
    c = corpus.select("image_id", "ord", bits.normalize(F.col("vector")).alias("c_unit"))
    pairs = found.select("query_id", "image_id").distinct().join(q, "query_id").join(c, "image_id")
    return _top(pairs.select("query_id", "image_id", "ord", bits.inner_product(F.col("q_unit"), F.col("c_unit")).alias("similarity")), k, threshold)


def _code_top(query_ids: pa.Array, tables: list[np.ndarray], k: int):
    def run(batches):
        best, step = Best(len(query_ids), k), max(1, SCORES // len(query_ids))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                codes = np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, -1)
                best.add(np.round(sum(t[:, codes[:, j]] for j, t in enumerate(tables)), 12), part.column(0), part.column(1).to_numpy())
        if (made := best.batch(query_ids)) is not None:
            yield made

    return run


# Approximate search by random planes ------------------------------------------------


def _flips(planes: int) -> list[int]:
    """The bits in which a bucket and those next to it differ: none, one or two of the planes."""
    return [0, *(1 << i for i in range(planes)), *(1 << i | 1 << j for i in range(planes) for j in range(i))]


def _plane_buckets(unit: np.ndarray, normals: np.ndarray, probe: int) -> np.ndarray:
    """The ``probe`` nearest buckets of each vector in one table, its own first."""
    planes = len(normals)
    margin = unit @ normals.T
    own = ((margin > 0) << np.arange(planes)).sum(axis=1)
    if probe == 1:
        return own[:, None]
    flips = np.array(_flips(planes))
    cost = margin**2 @ (flips[None] >> np.arange(planes)[:, None] & 1)
    return own[:, None] ^ flips[np.argsort(cost, axis=1, kind="stable")[:, :probe]]


def _normals(tables: int, planes: int, dimension: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, planes, dimension))


def plane_keys(vectors: DataFrame, dimension: int, tables: int, planes: int, probe: int = 1, seed: int = 11) -> DataFrame:
    """Add keys: for each table the bucket of signs against ``planes`` random planes, and the next nearest buckets.

    With ``probe`` above 1 the buckets that a vector is closest to by one or two
    of the planes are listed too.
    """
    normals, kept = _normals(tables, planes, dimension, seed), vectors.columns
    types = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in kept)
    at = kept.index("vector")

    def run(batches):
        step = max(1, SCORES // len(_flips(planes)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                unit = _unit(_matrix(batch.column(at), batch.num_rows))
                made = np.concatenate([_plane_buckets(unit, normals[t], probe) + (t << planes) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.tolist(), pa.list_(pa.int64()))], [*kept, "keys"])

    return vectors.mapInArrow(run, f"{types}, keys array<long>")


def calibrate_planes(rows: DataFrame, dimension: int, k: int, tables: int = 16, target: float = TARGET, most: int = CALIBRATION_QUERIES, seed: int = 11) -> tuple[int, int] | None:
    """(planes, probe) that find ``target`` of the true ``k`` neighbours with the fewest candidates.

    Measured by exact search for at most ``most`` vectors of the index (smallest
    hash of the id): among a query's buckets of all tables, how far down the
    nearest of those that hold each neighbour is.  None if half of the index
    would have to be looked at, as with vectors that do not cluster: then the
    exact search costs less.
    """
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("image_id"), "image_id").limit(most).select(F.col("image_id").alias("query_id"), "vector")
    near = search(rows, sample, k).select("query_id", "image_id").join(rows.select("image_id", "vector"), "image_id")
    # at most ``most`` queries with k neighbours each
    asked, found = sample.toArrow(), near.select("query_id", "vector").toArrow()
    if not found.num_rows:
        return None
    number = {q: i for i, q in enumerate(asked["query_id"].to_pylist())}
    whose = np.array([number[q] for q in found["query_id"].to_pylist()])
    unit, other = _unit(_matrix(asked["vector"], asked.num_rows)), _unit(_matrix(found["vector"], found.num_rows))
    best = None
    for planes in range(2, max(3, int(np.log2(max(n, 4))))):
        count = len(_flips(planes))
        first = np.full(len(whose), count)
        for normals in _normals(tables, planes, dimension, seed):
            order, own = _plane_buckets(unit, normals, count), _plane_buckets(other, normals, 1)
            hit = order[whose] == own
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), count))
        probe = int(np.sort(first)[int(np.ceil(target * len(first))) - 1]) + 1
        if probe <= count and (best is None or tables * probe / 2**planes < best[0]):
            best = tables * probe / 2**planes, planes, probe
    return best[1:] if best and best[0] < 0.5 else None


def search_planes(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, tables: int = 16, planes: int | None = None, probe: int | None = None) -> DataFrame:
    """Approximate search: vectors that share a bucket of random planes, ranked by their exact products.

    More planes make smaller buckets, more tables and probes find more.  By
    default both are calibrated on the index, and the search is exact where
    buckets would not save work.
    """
    first = corpus.select(F.size("vector")).where("vector is not null").first()
    if first is None:
        return search(corpus, queries, k, threshold)
    dimension = first[0]
    rows = fit_dimension(corpus.select("image_id", F.col("ord").cast("long").alias("ord"), "vector"), dimension)
    if planes is None:
        chosen = calibrate_planes(rows, dimension, k, tables)
        if chosen is None:
            return search(rows, queries, k, threshold)
        planes, probe = chosen[0], probe or chosen[1]
    cells = plane_keys(rows, dimension, tables, planes).select("image_id", "ord", "vector", F.explode("keys").alias("cell_id"))
    asked = fit_dimension(queries.select("query_id", "vector"), dimension)
    visits = plane_keys(asked, dimension, tables, planes, probe or 1).select("query_id", bits.normalize(F.col("vector")).alias("unit"), F.explode("keys").alias("cell_id"))

    def products(cell, table, units):
        held = _unit(_matrix(table["vector"], table.num_rows))
        return lambda lo, hi: units @ held[lo:hi].T

    # a vector is found in several tables, with the same product
    return _top(_search_parts(cells, visits, k, products).distinct(), k, threshold)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results (query_id, image_id) that were found."""
    total = exact.count()
    return found.join(exact.select("query_id", "image_id"), ["query_id", "image_id"], "left_semi").count() / total if total else 1.0


INDEX_TYPES = ("Flat", "IVFFlat", "IVFPQ", "HNSW")


def choose_search(index_type: str, corpus: DataFrame, lists: int = 100, probe: int | None = None, parts: int = 8, k: int = 10, code_bits: int = 8) -> Callable[[DataFrame, int, float | None], DataFrame]:
    """Search function of an index type.

    Both inverted-list types take the number of ``lists`` and of those to visit
    (``probe``); without the latter it is calibrated for ``k`` neighbours.
    ``parts`` and ``code_bits`` shape the codes.  The place of a graph (HNSW) is
    taken by calibrated random planes.  Inverted lists are kept in Spark's cache
    until ``unpersist`` of the function's ``index``.
    """
    if index_type not in INDEX_TYPES:
        raise ValueError(f"unknown index type: {index_type}")
    if index_type in ("IVFFlat", "IVFPQ"):
        centres = train_cells(corpus, lists)
        indexed = assign_cells(corpus, centres).persist()
        visits = probe or calibrate_probe(indexed, centres, k)
        if index_type == "IVFFlat":
            run = lambda queries, n, threshold=None: search_cells(indexed, centres, queries, n, visits, threshold)
            run.index = indexed
        else:
            books = train_residual_books(indexed, centres, parts, code_bits)
            encoded = encode_cells(indexed, centres, books).persist()
            widen = calibrate_widen(indexed, encoded, centres, books, k, visits)
            run = lambda queries, n, threshold=None: search_cell_codes(encoded, centres, books, queries, n, visits, threshold, corpus, widen)
            indexed.unpersist()  # the codes stand on their own from here on
            run.index, run.widen = encoded, widen
        run.probe, run.lists = visits, len(centres)
        return run
    if index_type == "HNSW":
        return lambda queries, n, threshold=None: search_planes(corpus, queries, n, threshold)
    return lambda queries, n, threshold=None: search(corpus, queries, n, threshold)


def stats(corpus: DataFrame, dimension: int) -> DataFrame:
    return corpus.where("vector is not null").agg(F.count("*").alias("ntotal"), F.lit(dimension).alias("dimension"), (F.count("*") * dimension * 4).alias("memory_bytes"))
