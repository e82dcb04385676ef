"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets.  Two
multinomials are estimated over them: one from a trusted target set and one
from the whole raw corpus, of which every document is counted.  A document's
score is the mean log ratio of its n-grams, and a fixed threshold decides.
The weights are whole numbers, so a score does not depend on the order of
summation.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .native import WORD, let
from .shared import broadcast_if_small, free_name

BUCKETS = 1 << 14
THRESHOLD = -0.1
_SCALE, _SMOOTH = 1 << 16, 0.5
_SPACE = "[\\x20\\x09-\\x0D]"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.xxhash64(w))


def _buckets(hashes: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    mask = F.lit(BUCKETS - 1)
    one = F.transform(hashes, lambda h: h.bitwiseAND(mask).cast("int"))
    two = F.zip_with(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))),
        F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda a, b: F.shiftrightunsigned(a, 17).bitwiseXOR(b).bitwiseXOR(F.shiftrightunsigned(b, 31)).bitwiseAND(mask).cast("int"),
    )
    return F.concat(one, two)


def _repeat_words(hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    count = F.size(hashes) - 4
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))

    def covered(starts: Column) -> Column:
        step = lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(F.lit(5), s - acc["at"])).alias("n"))
        # each start adds its distance from the one before, 5 at most; the first adds 5
        return F.aggregate(starts, F.struct(F.lit(-5).alias("at"), F.lit(0).alias("n")), step)["n"]

    def starts(ordered: Column) -> Column:
        same = lambda s, k: (F.get(ordered, k - 1)["h"] == s["h"]) | (F.get(ordered, k + 1)["h"] == s["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda s, k: F.coalesce(same(s, k), F.lit(False))), lambda s: s["i"]))

    def repeats(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(ordered, starts), covered))

    return F.when(count >= 2, let(windows, repeats)).otherwise(F.lit(0))


def ngram_weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Log ratio of each bucket, target against raw corpus, times 2**16.

    ``docs`` has doc_id and text, ``trusted`` has doc_id.  All documents make
    up the raw corpus, and all with a trusted id the target.
    """
    picked = trusted.select("doc_id").where("doc_id is not null").distinct()
    flagged = docs.select("doc_id", "text").join(broadcast_if_small(picked).withColumn("in_target", F.lit(1)), "doc_id", "left")
    grams = flagged.select(F.coalesce("in_target", F.lit(0)).alias("t"), F.explode(let(_word_hashes(F.col("text")), _buckets)).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * BUCKETS
    base = math.log((sum(target) + _SMOOTH * BUCKETS) / (sum(raw) + _SMOOTH * BUCKETS))
    return [round(_SCALE * (math.log((t + _SMOOTH) / (r + _SMOOTH)) - base)) for t, r in zip(target, raw, strict=True)]


def apply_rules(docs: DataFrame, weights: list[int], threshold: float = THRESHOLD, text_col: str = "text", name: str = "rules") -> tuple[DataFrame, str]:
    """Add a struct column with the base counts, the score and the decision.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    score (mean log ratio; 0 without words), base_failed and kept.  A null or
    empty text has no words and so fails.  Each input row gives one row with
    all its columns.  Returns the frame and the column's name, which has
    underscores added where the documents have such a column.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to one literal
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def fields(hashes: Column) -> Column:
        total = F.aggregate(_buckets(hashes), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
        grams = F.greatest(2 * F.size(hashes) - 1, F.lit(1))
        return F.struct(
            F.size(hashes).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, _SPACE + "+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(hashes).cast("long").alias("n_repeat_words"),
            (total / grams / F.lit(float(_SCALE))).alias("score"),
        )

    def decide(f: Column) -> Column:
        failed = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
        kept = ~failed & (f["score"] >= threshold)
        return F.struct(*[f[n].alias(n) for n in (*_BASE, "score")], failed.alias("base_failed"), kept.alias("kept"))

    name = free_name(docs, name)
    return docs.withColumn(name, let(let(_word_hashes(text), fields), decide)), name


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """Learn the two multinomials and apply the rules to every document."""
    weights = ngram_weights(docs, trusted)
    return apply_rules(docs, weights, threshold)
