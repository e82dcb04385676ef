"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded, hash-chosen sample of labelled documents is turned into hashed byte
n-gram features and shares of repeated words, weighted by inverse document frequency and reduced by a
truncated singular value decomposition.  The sample's latent vectors are
broadcast; every document is projected and its exact cosine products with all
of them are computed block by block.  Its nearest neighbours vote with their
labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import feature_blocks, id_crc, training_sample, unit_rows
from .shared import free_name, with_column

DIMS = 4096
SIZES = (1, 3)
RANK = 64
#: Weight of repeated words and windows against the n-grams.
REPEATS = 2.0
NEIGHBOURS = 25
#: Most labelled rows of each label that the classifier is fitted on.
PER_LABEL = 1000
THRESHOLD = 0.3


@dataclass
class LatentNeighbours:
    """Labelled vectors in latent space; a few MB whatever the corpus."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, seed: int = 7):
        n, dims = x.shape
        weights = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        rows = x
        rows *= weights
        unit_rows(rows)
        rank = max(1, min(rank, n, dims))
        probe = np.random.default_rng(seed).standard_normal((dims, min(rank + 16, dims))).astype(np.float32)
        for _ in range(4):
            probe, _ = np.linalg.qr(rows.T @ (rows @ probe))
        _, _, right = np.linalg.svd(rows @ probe, full_matrices=False)
        basis = (probe @ right.T)[:, :rank].astype(np.float32)
        return cls(weights, basis, unit_rows(rows @ basis), labels.astype(np.float32), neighbours)

    def project(self, x: np.ndarray) -> np.ndarray:
        return unit_rows(unit_rows(x * self.weights) @ self.basis)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours of each row.

        A row without features, or whose neighbours have no positive
        similarity, gets the share among all labelled vectors.
        """
        base = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(x), base)
        cosine = self.project(x) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 0, vote / np.where(total > 0, total, 1), base), 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, label: str = "quality") -> LatentNeighbours:
    """Fit on labelled rows outside the held-out fifth (crc32 of doc_id mod 5 = 0).

    Labels other than 0 and 1, null ids and ids without a document are not
    used; an id labelled more than once counts with its largest label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    x, y = training_sample(docs, known, per_label, [0, 1], DIMS, SIZES, REPEATS)
    return LatentNeighbours.fit(x, y) if len(y) else LatentNeighbours(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))


def score_quality(docs: DataFrame, model: LatentNeighbours, text_col: str = "text", name: str = "quality_score") -> tuple[DataFrame, str]:
    """Add the score (0 to 1, higher: label 1 likelier) of every whole text.

    Null, empty and very short texts get a score too.  Each input row gives one
    row with all its columns.  Returns the frame and the column's name, which
    has underscores added where the documents have such a column.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs, name)

    def add(batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index(text_col))
        out = [shared.value.score(x) for _, _, x in feature_blocks(texts, DIMS, SIZES, REPEATS)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return with_column(docs, name, "double", add), name


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    found, name = score_quality(docs, fit_quality(docs, labels))
    return found.where(F.col(name) >= threshold).select(*docs.columns)
