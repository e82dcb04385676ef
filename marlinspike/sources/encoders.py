"""Encoders of texts and images, with injected models or stand-ins that need none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text

HASHES = ("dHash", "aHash", "pHash")


def hashed_ngrams(texts: list[str], dimension: int = 64, size: int = 3) -> np.ndarray:
    """A stand-in for a model: counts of hashed character n-grams."""
    import zlib

    out = np.zeros((len(texts), dimension))
    for row, t in zip(out, texts, strict=True):
        for i in range(max(1, len(t) - size + 1)):
            row[zlib.crc32(t[i : i + size].encode()) % dimension] += 1
    return out


def encode_texts(rows: DataFrame, models: dict[str, Callable[[list[str]], np.ndarray]], dimension: int, text_col: str = "full_text", name: str = "text_embedding") -> DataFrame:
    """Add the unit vector of each text, from the model of its language.

    White space is normalised first.  Null and empty texts and those of an
    unknown language get a zero vector.  A model with vectors of another length
    than ``dimension`` is an error, as is a language (zh, en) without a model.
    """
    clean = text.simple_normalize(F.col(text_col))
    language = F.when(clean == "", "unknown").otherwise(text.detect_language(clean))

    def encode(texts: pd.Series, languages: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dimension), np.float32)
        for lang in ("zh", "en"):
            at = np.flatnonzero(languages.to_numpy() == lang)
            if not len(at):
                continue
            if lang not in models:
                raise RuntimeError(f"there is no model for {lang}")
            made = np.asarray(models[lang](texts.iloc[at].tolist()), np.float64)
            if made.shape != (len(at), dimension):
                raise ValueError(f"the model for {lang} gives vectors of shape {made.shape[1:]}, not {dimension}")
            norm = np.linalg.norm(made, axis=1, keepdims=True)
            out[at] = made / np.where(norm == 0, 1, norm)
        return pd.Series(list(out))

    return rows.withColumn(name, F.pandas_udf(encode, "array<float>")(clean, language))


def _shrink(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the pixels that each cell of a smaller grid covers."""
    rows = np.linspace(0, pixels.shape[0], height + 1)
    columns = np.linspace(0, pixels.shape[1], width + 1)
    cut = lambda edges, i: slice(int(edges[i]), max(int(np.ceil(edges[i + 1])), int(edges[i]) + 1))
    return np.array([[pixels[cut(rows, i), cut(columns, j)].mean() for j in range(width)] for i in range(height)])


def perceptual_hash(pixels: np.ndarray, algorithm: str = "dHash", size: int = 8) -> str:
    """Hexadecimal hash of a grey image, size * size bits: difference, mean or cosine transform."""
    if algorithm not in HASHES:
        raise ValueError(f"one of {', '.join(HASHES)}")
    if not 8 <= size <= 32:
        raise ValueError("hash_size is 8 to 32")
    if algorithm == "dHash":
        small = _shrink(pixels, size, size + 1)
        bits = small[:, 1:] > small[:, :-1]
    elif algorithm == "aHash":
        small = _shrink(pixels, size, size)
        bits = small > small.mean()
    else:
        n = 4 * size
        small = _shrink(pixels, n, n)
        wave = np.cos(np.pi / n * np.outer(np.arange(size), np.arange(n) + 0.5))
        low = wave @ small @ wave.T
        bits = low > np.median(low.ravel()[1:])
    number = int("".join("1" if b else "0" for b in bits.ravel()), 2)
    return f"{number:0{-(-size * size // 4)}x}"


def hash_images(images: DataFrame, decode: Callable[[bytes], np.ndarray], algorithm: str = "dHash", size: int = 8, name: str = "perceptual_hash") -> DataFrame:
    """Add the hash of each image's content; ``decode`` gives grey pixels, and what it cannot read has a null hash."""

    def one(content: bytes | None) -> str | None:
        try:
            return None if content is None else perceptual_hash(np.asarray(decode(bytes(content)), np.float64), algorithm, size)
        except (ValueError, OSError):
            return None

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(one).astype(object)

    return images.withColumn(name, F.pandas_udf(run, "string")(F.col("content")))


def read_pgm(content: bytes) -> np.ndarray:
    """Pixels of a binary PGM image, the plainest grey format."""
    parts = content.split(maxsplit=4)
    if len(parts) < 4 or parts[0] != b"P5" or int(parts[3]) > 255:
        raise ValueError("not a binary PGM of 8 bits")
    width, height = int(parts[1]), int(parts[2])
    return np.frombuffer(content[-width * height :], np.uint8).reshape(height, width)


def thumbnail(pixels: np.ndarray, edge: int = 400) -> np.ndarray:
    """Grey pixels whose longer side is at most ``edge``."""
    scale = min(1.0, edge / max(pixels.shape))
    return _shrink(pixels, max(1, round(pixels.shape[0] * scale)), max(1, round(pixels.shape[1] * scale))) if scale < 1 else pixels


def binarise(pixels: np.ndarray) -> np.ndarray:
    """Black and white at the threshold that separates the two groups of grey best (Otsu)."""
    counts = np.bincount(pixels.astype(np.uint8).ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return np.where(pixels > int(spread.argmax()), 255, 0).astype(np.uint8)


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luma of a pixel."""
    return 0.299 * red + 0.587 * green + 0.114 * blue
