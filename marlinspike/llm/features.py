"""Hashed byte n-gram features and bounded training samples for the text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K

#: Documents whose dense feature rows are held at once.
ROWS = 256
#: Bytes that are looked at together.
SLICE = 1 << 20
#: Most labels whose ids are chosen by a job each; those of more are ranked in one.
FEW_LABELS = 16


def ngram_counts(buf: np.ndarray, offsets: np.ndarray, dims: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Dense counts (documents x dims) of hashed byte n-grams; none crosses a document's end."""
    n, rows = len(buf), len(offsets) - 1
    out = np.zeros(rows * dims, np.int64)
    shift = np.uint64(64 - int(np.log2(dims)))
    # in slices, so that a very long text needs little memory; n-grams belong to the slice they start in
    for lo in range(0, n, SLICE):
        hi = min(lo + SLICE, n)
        end = min(hi + max(sizes) - 1, n)
        doc = np.searchsorted(offsets, np.arange(lo, end), "right") - 1
        key, wide = np.zeros(end - lo, np.uint64), buf[lo:end].astype(np.uint64)
        for size in range(1, max(sizes) + 1):
            m = min(hi, n - size + 1) - lo
            if m <= 0:
                break
            key = key[: end - lo - size + 1] * np.uint64(257) + wide[size - 1 :] + np.uint64(1)
            if size in sizes:
                same = doc[:m] == doc[size - 1 : m + size - 1]
                bucket = ((key[:m] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64) + doc[:m] * dims
                out += np.bincount(bucket[same], minlength=rows * dims)
    return out.reshape(rows, dims)


def repeat_shares(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> np.ndarray:
    """Per document: words equal to the one before, and k-word windows seen before, as shares of its words."""
    starts, ends, first = K.words(buf, offsets, K.NON_SPACE)
    hashes, rows = K.span_hashes(buf, starts, ends), len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(first))
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[1:][same], minlength=rows)
    at = K.window_starts(first, k)
    windows = K.window_hashes(hashes, k)[at]
    order = np.lexsort((windows, doc[at]))
    w, d = windows[order], doc[at][order]
    seen = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    repeated = np.bincount(d[1:][seen], minlength=rows)
    return np.stack([again, repeated], axis=1) / np.maximum(np.diff(first), 1)[:, None]


def feature_blocks(texts: pa.Array, dims: int, sizes: tuple[int, ...], repeats: float = 0.0) -> Iterator[tuple[int, int, np.ndarray]]:
    """Yield (first row, end row, float32 log counts) over whole texts, a block of rows at a time.

    With ``repeats`` the last two columns hold the shares of repeated words and
    windows instead, as multiples of the row's length times ``repeats``.
    """
    for lo, hi, buf, offsets in K.blocks(texts, most_rows=ROWS):
        x = np.log1p(ngram_counts(buf, offsets, dims, sizes)).astype(np.float32)
        if repeats:
            x[:, -2:] = 0
            x[:, -2:] = repeat_shares(buf, offsets) * np.linalg.norm(x, axis=1, keepdims=True) * repeats
        yield lo, hi, x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in place; zero rows stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(norm > 0, norm, 1)
    return x


def id_crc(column) -> F.Column:
    """crc32 of the id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def training_sample(docs: DataFrame, known: DataFrame, per_label: int, labels: list, dims: int, sizes: tuple[int, ...], repeats: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Features and label indexes of documents of at most ``per_label`` ids of each label.

    ``docs`` has doc_id and text, ``known`` doc_id and label.  The ids with the
    smallest hash are taken, so the choice does not depend on partitioning.
    Only numbers are looked at to choose them, and only features, not texts,
    reach the driver.
    """
    spark = docs.sparkSession
    kind = known.schema["label"].dataType.simpleString()
    keyed = known.where("doc_id is not null").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "label", F.xxhash64("doc_id").alias("pick"))
    picked = []
    if len(labels) > FEW_LABELS:
        # a limit on row_number is applied before the shuffle too
        ranked = keyed.join(F.broadcast(spark.createDataFrame([(v,) for v in labels], f"label {kind}")), "label", "left_semi")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("pick", "doc_id")))
        picked = ranked.where(F.col("rank") <= per_label).collect()
    for value in labels if len(labels) <= FEW_LABELS else []:
        picked += keyed.where(F.col("label") == F.lit(value)).orderBy("pick", "doc_id").limit(per_label).collect()
    if not picked:
        return np.zeros((0, dims), np.float32), np.zeros(0, np.int64)
    # at most per_label ids a label, whatever the corpus
    chosen = spark.createDataFrame([(r["doc_id"], r["label"]) for r in picked], f"doc_id long, p_label {kind}")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "p_label", "doc_id")

    def featurise(batches):
        for batch in batches:
            for lo, hi, x in feature_blocks(batch.column(0), dims, sizes, repeats):
                packed = pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, batch.column(1)[lo:hi], batch.column(2)[lo:hi]], ["x", "label", "doc_id"])

    found = rows.mapInArrow(featurise, f"x binary, label {kind}, doc_id long").toArrow()
    if not found.num_rows:
        return np.zeros((0, dims), np.float32), np.zeros(0, np.int64)
    y = np.array([labels.index(v) for v in found["label"].to_pylist()])
    half = np.concatenate([np.frombuffer(c.buffers()[2], np.float16, len(c) * dims).reshape(-1, dims) for c in found["x"].chunks if len(c)])
    order = np.lexsort((half[:, 0], y, found["doc_id"].to_numpy()))
    return half[order].astype(np.float32), y[order]
