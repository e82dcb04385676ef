"""Source divergence audit by upper-bound term search.

Each language keeps the terms that enough of its documents hold.  A group is a
source within a language; its term probabilities p are compared with those of
the whole language and of the language's other sources, in whole numbers:
f = floor((p - q)**2 / (p + q)).

Terms of a group.  All terms that occur equally often in a group share p.  So
the terms of a group are put in buckets by their count, and f, which falls as q
rises to p, is bounded by the bucket's least q.  Buckets are evaluated best bound
first, in waves that double the number of terms, until the bounds of those
unseen lie strictly below the group's k-th value; a bucket at an equal bound is
evaluated, as ties go by the term.

Pairs of groups.  A term that neither group holds adds the same constant, and
one that a single group holds adds a value by its count, so both are sums over
count buckets; postings of a term, one row a group that holds it, give the terms
that both hold.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import BROADCAST_ROWS, Scratch, join_counted

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Fixed form of a term, on the bytes of a text whose A-Z are lower-cased.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Terms that a task holds before it hands on their counts, and bytes of text that are split at once.
HELD, PIECE = 500_000, 1 << 22


def _document_terms(text: bytes) -> Counter:
    out: Counter = Counter()
    text, at = text.lower(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _TERM.match(text, end, end + 1):
            end += 1
        out.update(_TERM.findall(text, at, end))
        at = end
    return out


def _term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of each term, added up in a task first."""

    def rows(batches):
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0

        def flush():
            langs, sources, terms, c, d = [], [], [], [], []
            for (lang, source), own in held.items():
                langs += [lang] * len(own)
                sources += [source] * len(own)
                terms += own
                c += [x[0] for x in own.values()]
                d += [x[1] for x in own.values()]
            held.clear()
            made = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64())]
            return pa.RecordBatch.from_arrays(made, ["lang", "source", "term", "c", "d"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = held.setdefault((lang, source), {})
                size -= len(own)
                for term, n in _document_terms(text).items():
                    if entry := own.get(term):
                        entry[0] += n
                        entry[1] += 1
                    else:
                        own[term] = [n, 1]
                size += len(own)
                if size > HELD:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("lang", "source", "text").mapInArrow(rows, "lang string, source string, term string, c long, d long").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)); products beyond 64 bits are decimals."""
    top, bottom = count + 2, total + 2 * terms
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * top.cast("decimal(19,0)"), bottom.cast("decimal(19,0)"))
    return F.when(top < (1 << 62) // UNIT, F.call_function("div", F.lit(UNIT) * top, bottom)).otherwise(exact) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _top_terms(kept: DataFrame, groups: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has more of than its language, by upper bounds.

    ``kept`` has (lang, source, term, c, p, q); ``groups`` is only its keys.
    """
    keys = ["lang", "source"]
    buckets = kept.groupBy(*keys, "c").agg(F.count("*").alias("n"), F.first("p").alias("p"), F.min("q").alias("least_q")).where("p > least_q")
    buckets = buckets.withColumn("bound", _f(F.col("p"), F.col("least_q")))
    order = Window.partitionBy(*keys).orderBy(F.desc("bound"), "c")
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # so many terms lie ahead: waves hold at least as many as all before them, and have no gaps
    doubling = F.when(F.col("ahead") < top, 0).otherwise(F.floor(F.log2(F.col("ahead") / top)).cast("int") + 1)
    buckets = buckets.withColumn("doubling", doubling).withColumn("wave", F.dense_rank().over(Window.partitionBy(*keys).orderBy("doubling")) - 1)
    buckets = scratch.write(buckets.select(*keys, "c", "n", "bound", "wave"), "buckets")
    total, best, wave = kept.count(), None, 0
    by_value = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    while True:
        open_ = buckets.where(F.col("wave") == wave)
        if best is not None:
            kth = best.where(F.col("rank") == top).select(*keys, F.col("value").alias("kth"))
            open_ = open_.join(kth, keys, "left").where("kth is null or bound >= kth").drop("kth")
        open_ = scratch.write(open_, f"open-{wave}")
        if open_.isEmpty():
            scratch.drop("buckets", f"open-{wave}")
            return best
        seen = join_counted(kept, open_.select(*keys, "c", "n"), [*keys, "c"], "n", total).where("p > q")
        seen = seen.select(*keys, F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
        if best is not None:
            seen = seen.unionByName(best.drop("rank"))
        ranked = seen.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
        best = scratch.write(ranked, f"best-{wave}")
        scratch.drop(f"open-{wave}", f"best-{wave - 1}")
        wave += 1


def _pairs(kept: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value): the divergence of each two sources of a language, both ways round."""
    zero = _share(F.lit(0), F.col("total"), F.col("terms"))
    own = groups.withColumn("zero", F.when(F.col("terms") > 0, zero).otherwise(1)).select("lang", "source", "terms", "zero")
    other = own.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    both = own.join(other, "lang").where("source <> item")  # a row of the result each

    # terms of one group against the other's zero, by count; what both hold is mended below
    counts = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    alone = both.join(counts, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * (_f(F.col("p"), F.col("other_zero")) - _f(F.col("zero"), F.col("other_zero")))).alias("alone")
    )
    posting = kept.join(own.select("lang", "source", "zero"), ["lang", "source"]).select("lang", "term", "source", "p", "zero")
    met = posting.join(posting.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("other_zero")), ["lang", "term"]).where("source < item")
    p, q, z, y = (F.col(c) for c in ("p", "q", "zero", "other_zero"))
    met = met.groupBy("lang", "source", "item").agg(F.sum(_f(p, q) - _f(p, y) - _f(z, q) + _f(z, y)).alias("met"))
    met = scratch.write(met, "met")
    met = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "met"))
    alone = scratch.write(alone, "alone")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    keys = ["lang", "source", "item"]
    whole = both.join(alone, keys, "left").join(back, keys, "left").join(met, keys, "left")
    value = F.col("terms") * _f(F.col("zero"), F.col("other_zero"))
    for part in ("alone", "back", "met"):
        value = value + F.coalesce(F.col(part), F.lit(0))
    return whole.select(*keys, F.when(F.col("terms") > 0, value).otherwise(0).alias("value"))


def audit_sources(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """How far the sources of a language diverge from it and from each other.

    Returns (lang, source, part, item, value, rank).  Part ``pair`` has a row for
    each other source of the language, whose value is the sum of f over the
    language's terms; part ``term`` the ``top`` terms that a source has more of
    than its language.  Terms are runs of letters and characters above ASCII,
    A-Z lower-cased, kept if ``least_docs`` documents of the language hold them.
    Ranks go by falling value, then by item.  Null text, lang and source count as
    empty strings; documents without terms still make a group; repeated rows are
    separate documents.  Only the three named columns are read; an empty table
    gives none.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    counts = scratch.write(_term_counts(docs), "counts")
    groups = scratch.write(docs.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups")

    terms = counts.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("d").alias("d"), F.count("*").alias("held")).where(F.col("d") >= least_docs)
    terms = scratch.write(terms.select("lang", "term", "lang_c"), "terms")
    # a language's terms go to the rows of the same term: a term has a row a source at most
    kept = scratch.write(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "c", "lang_c"), "kept")
    scratch.drop("counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_c").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("total"), F.count("*").alias("rows"))
    zero = {"total": 0, "rows": 0, "terms": 0, "lang_total": 0}
    groups = scratch.write(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero).drop("docs"), "sized")

    # p of the group and q of its language, where a term occurs
    kept = join_counted(kept, groups.where("rows > 0"), ["lang", "source"], "rows", kept.count())
    p, q = _share(F.col("c"), F.col("total"), F.col("terms")), _share(F.col("lang_c"), F.col("lang_total"), F.col("terms"))
    kept = scratch.write(kept.select("lang", "source", "term", "c", p.alias("p"), q.alias("q")), "shares")
    few = groups.count() <= BROADCAST_ROWS
    pairs = _pairs(kept, F.broadcast(groups) if few else groups, scratch)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    out = pairs
    found = _top_terms(kept, groups, top, scratch)
    if found is not None:
        out = out.unionByName(found.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
