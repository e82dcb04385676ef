"""Language identification in two steps: the family, then the language within it.

One-versus-rest linear support vector machines predict the language family.
Within a family, a linear machine for each pair of languages votes.  All are
trained here, on hashed byte n-grams of a bounded, hash-chosen sample of the
documents whose language is known.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .features import feature_blocks, id_crc, training_sample, unit_rows
from .shared import free_name, with_column

DIMS = 4096
SIZES = (1, 2, 3)
#: Most training rows of each language.
PER_LANGUAGE = 1000
#: Most training rows of all languages together, which bounds the driver's memory (about 50 kB a row); with
#: more than 16 languages each has an equal share of them, and one row at least.
ALL_ROWS = 16_000
#: Machines that are trained together.
TOGETHER = 64
UNDETERMINED = "und"
#: Families of the languages; one that is not listed is a family of its own.
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"], "germanic"),
    **dict.fromkeys(["fr", "es", "pt", "it", "ro", "ca", "gl"], "romance"),
    **dict.fromkeys(["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"], "slavic"),
    **dict.fromkeys(["fi", "et"], "finnic"),
}


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear machine with squared hinge loss, by accelerated gradient descent.

    ``x`` has unit rows and a constant last column; ``y`` is -1 or 1.  The two
    classes weigh the same.  With several columns in ``y`` each has a machine,
    in the column of the result.
    """
    share = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y < 0).sum(axis=0))).astype(np.float32)
    w = ahead = np.zeros(x.shape[1:] + y.shape[1:], np.float32)
    rate, momentum = 1 / (2 * 2.0 + penalty), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = penalty * ahead - 2 * (x.T @ (share * slack * y))
        nxt = ahead - rate * gradient
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = nxt + np.float32((momentum - 1) / faster) * (nxt - w)
        w, momentum = nxt, faster
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * z, -30, 30)))


@dataclass
class LanguageTree:
    """Family machines, and pair machines within each family."""

    weights: np.ndarray
    families: list[str]
    family_machines: np.ndarray
    members: list[list[str]]
    pair_machines: list[list[tuple[int, int, np.ndarray]]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, languages: list[str], families: dict[str, str]):
        weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        rows = cls._rows(x, weights)
        family_of = np.array([families.get(name, f"only {name}") for name in languages])
        names = sorted(set(family_of[np.unique(y)].tolist())) if len(y) else []
        own = family_of[y] if len(y) else np.zeros(0, str)
        machines = []
        for at in range(0, len(names) if len(names) > 1 else 0, TOGETHER):
            sides = np.where(own[:, None] == np.array(names[at : at + TOGETHER]), 1, -1).astype(np.float32)
            machines += list(train_machine(rows, sides).T)
        members, pairs = [], []
        for f in names:
            inside = sorted(k for k in np.unique(y).tolist() if family_of[k] == f)
            members.append([languages[k] for k in inside])
            made = []
            for (i, a), (j, b) in combinations(enumerate(inside), 2):
                both = (y == a) | (y == b)
                made.append((i, j, train_machine(rows[both], np.where(y[both] == a, 1, -1).astype(np.float32))))
            pairs.append(made)
        return cls(weights, names, np.array(machines, np.float32).reshape(len(machines), rows.shape[1]), members, pairs)

    @staticmethod
    def _rows(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        rows = np.empty((len(x), x.shape[1] + 1), np.float32)
        np.multiply(x, weights, out=rows[:, :-1])
        unit_rows(rows[:, :-1])
        rows[:, -1] = 0.1
        return rows

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row; ties go to the name that sorts first."""
        n = len(x)
        if not self.families:
            return np.full(n, UNDETERMINED, object), np.zeros(n)
        rows = self._rows(x, self.weights)
        if len(self.families) > 1:
            margin = rows @ self.family_machines.T
            family = margin.argmax(axis=1)
            p = _sigmoid(margin)
            score = (p / p.sum(axis=1, keepdims=True))[np.arange(n), family]
        else:
            family, score = np.zeros(n, np.int64), np.ones(n)
        out = np.empty(n, object)
        for f, (names, machines) in enumerate(zip(self.members, self.pair_machines, strict=True)):
            mine = np.flatnonzero(family == f)
            votes, belief = np.zeros((len(mine), len(names))), np.zeros((len(mine), len(names)))
            for i, j, w in machines:
                z = rows[mine] @ w
                votes[:, i] += z >= 0
                votes[:, j] += z < 0
                belief[:, i] += _sigmoid(z)
                belief[:, j] += _sigmoid(-z)
            best = (votes + belief / (len(names) + 1)).argmax(axis=1)
            out[mine] = np.array(names, object)[best]
            if len(names) > 1:
                score[mine] *= belief[np.arange(len(mine)), best] / (len(names) - 1)
        return out, np.clip(score, 0.0, 1.0)


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILIES, text_col: str = "text", lang_col: str = "lang") -> LanguageTree:
    """Fit on documents with a language, outside crc32(doc_id) mod 3 = 1.

    Every other language is learned, however rare.  Null and empty languages
    are not, nor rows with null ids or texts.
    """
    rows = docs.select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("label") > 0) & (id_crc(F.col("doc_id")) % 3 != 1))
    languages = sorted(r["label"] for r in rows.select("label").distinct().collect())
    per_language = min(per_language, max(1, ALL_ROWS // max(1, len(languages))))
    x, y = training_sample(rows.select("doc_id", "text"), rows.select("doc_id", "label"), per_language, languages, DIMS, SIZES)
    return LanguageTree.fit(x, y, languages, families)


def identify(docs: DataFrame, model: LanguageTree, text_col: str = "text", name: str = "language_found") -> tuple[DataFrame, str]:
    """Add a struct (lang, score) on the language of every whole text.

    A null text, or one without any letter, gets ``und`` and 0.  Each input row
    gives one row with all its columns.  Returns the frame and the column's
    name, which has underscores added where the documents have such a column.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs, name)

    def add(batch: pa.RecordBatch):
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        found, scores = [], []
        for _, _, x in feature_blocks(texts, DIMS, SIZES):
            lang, score = shared.value.predict(x)
            found.append(lang)
            scores.append(score)
        lang = np.concatenate(found) if found else np.zeros(0, object)
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(np.where(letters, lang, UNDETERMINED), pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names=["lang", "score"])

    return with_column(docs, name, "struct<lang: string, score: double>", add), name
