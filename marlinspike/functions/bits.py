"""Fingerprints as hexadecimal strings, and vectors as float arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _words(hex_text: Column) -> Column:
    """The string's 32-bit words as longs, the last one shorter if need be."""
    starts = F.sequence(F.lit(0), F.floor((F.length(hex_text) - 1) / 8).cast("int"))
    return F.transform(starts, lambda i: F.conv(F.substring(hex_text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal strings.

    Strings of unequal length are as far apart as the longer one is long; where
    either is not hexadecimal, differing characters count.
    """
    hexed = a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    bits = F.aggregate(F.zip_with(_words(a), _words(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    chars = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).when(a == b, 0).when(hexed, bits).otherwise(chars)


def hash_words(hex_text: Column) -> Column:
    """The 32-bit words of a hexadecimal string; null for other strings."""
    return F.when(hex_text.rlike("^[0-9a-fA-F]+$"), _words(hex_text))


def word_distance(a_words: Column, b_words: Column, a: Column, b: Column) -> Column:
    """hamming_distance(a, b) with their hash_words at hand."""
    same = F.aggregate(F.zip_with(a_words, b_words, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    chars = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    hexed = a_words.isNotNull() & b_words.isNotNull()
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).when(hexed, same).when(a == b, 0).otherwise(chars)


def exact_confidence(distance: Column) -> Column:
    """1 - d/256 for every fingerprint size, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - distance / F.lit(256.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))[0]


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def difference_hash(v: Column) -> Column:
    """Hexadecimal difference hash of a vector: bit i says whether entry i+1 exceeds entry i."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 4).cast("int"))

    def digit(k: Column) -> Column:
        # only the vector is referred to: an array of bits would be made again for each digit
        value = sum((F.when(F.get(v, k * 4 + j + 1) > F.get(v, k * 4 + j), 8 >> j).otherwise(0) for j in range(4)), F.lit(0))
        return F.substr(F.lit("0123456789abcdef"), F.call_function("shiftright", value, F.greatest(F.lit(0), k * 4 + 4 - F.size(v))) + 1, F.lit(1))

    return F.array_join(F.transform(words, digit), "")
