"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 21, 21 and 22 bits, each of
them a word of the binary Golay code (23 bits, the rest zero).  The code is
perfect: every word has one codeword within 3 bits, and those that are 3 bits
away from it have exactly five more within 4.  So a word is decoded to one or six
codeword indexes, and if two words differ in one bit, the nearest codeword of
either is among the indexes of the other.

Pigeonhole over the segments: two fingerprints that differ in 4 bits at most

* agree in a whole segment, or
* differ in every segment, and then in exactly one bit in two of them.

The first are joined on each segment.  For the second, each pair of segments
gives keys of two codeword indexes.  The parity of a segment changes with one
bit, so a fingerprint with an odd first segment puts only its nearest codewords
in the index, and one with an even segment asks under all its indexes, up to 36 keys.

Keys gather fingerprints in buckets, and the join verifies distances.  Equal
fingerprints are one class.  Within a bucket pairs are not enumerated: members
are tested against a centre, links give components, and the next round takes
another centre of the buckets that still hold several components.  The last
round is exact: what is left in a bucket is dealt out once more by pieces of the
bits that the bucket does not fix, one of which a pair must share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .components import connected_components
from .shared import Scratch, bit_table, has_bit, join_counted, table_bits

SHINGLE, BITS, SEED = 4, 4, 42
#: Bytes of text, and shingles, that are worked on at once.
PIECE, SLICE = 1 << 20, 1 << 16
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: The centre of a bucket in each round is its member with the least fingerprint XOR one of these.
CENTRES = (0, -1)
#: Most members of a bucket, in the last round, that one task joins to all the others.
SPLIT = 2000
#: Sides of a bucket: only rows of different sides, or of side BOTH, are compared.
INDEX, PROBE, BOTH = 0, 1, 2


# Fingerprints ------------------------------------------------------------------------


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about PIECE bytes."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Bits that are set in over half of the hashes of all k-word shingles; no words give zero."""
    from xxhash import xxh64_intdigest as digest

    counts, total, carry = np.zeros(64, np.int64), 0, []

    def add(words: list[bytes], size: int) -> None:
        nonlocal counts, total
        joined, ends = b" ".join(words), list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: len(ends) - size])]
        for lo in range(0, len(starts), SLICE):
            spans = zip(starts[lo : lo + SLICE], ends[lo + size - 1 : lo + SLICE + size - 1], strict=True)
            hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(starts)

    for words in _word_lists((text or b"").lower()):
        words = carry + words
        if len(words) >= k:
            add(words, k)
            carry = words[len(words) - k + 1 :]
        else:
            carry = words
    if not total and carry:
        add(carry, len(carry))
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _print_rows(docs: DataFrame, k: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            made = np.array([fingerprint(t, k) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


# Golay keys --------------------------------------------------------------------------


def _remainder(v: int) -> int:
    for at in range(22, 10, -1):
        if v >> at & 1:
            v ^= GENERATOR << (at - 11)
    return v


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainders, leaders, further), all made from the generator polynomial.

    Remainder of each value of each of a word's three bytes; by remainder the
    error to the nearest codeword; and by remainder what turns the nearest
    codeword's index into that of each of the five others within 4 bits, or -1.
    """
    single = [_remainder(1 << i) for i in range(23)]
    remainders = np.zeros((3, 256), np.int64)
    for i, r in enumerate(single):
        remainders[i // 8, (np.arange(256) >> (i % 8) & 1).astype(bool)] ^= r
    leaders = np.zeros(2048, np.int64)
    threes = []
    for size in range(1, 4):
        for at in combinations(range(23), size):
            r, e = 0, 0
            for i in at:
                r, e = r ^ single[i], e | 1 << i
            leaders[r] = e
            if size == 3:
                threes.append((r, e))
    codewords = np.array([m << 11 | _remainder(m << 11) for m in range(4096)])
    sevens = codewords[np.bitwise_count(codewords) == 7]
    further = np.full((2048, 5), -1, np.int64)
    for r, e in threes:
        further[r] = sevens[sevens & e == e] >> 11
    return remainders, leaders, further


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of each 23-bit word, and those of the five others within 4 bits, or -1."""
    remainders, leaders, further = golay()
    r = remainders[0][words & 255] ^ remainders[1][words >> 8 & 255] ^ remainders[2][words >> 16]
    nearest = (words ^ leaders[r]) >> 11
    others = further[r]
    return nearest, np.where(others < 0, -1, others ^ nearest[:, None])


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def _key(kind: int, value: np.ndarray) -> np.ndarray:
    """A bucket: the kind of key and its value as a uniform hash, one to one."""
    return K.mix(value.astype(np.uint64) + np.uint64(kind << 56))


def index_keys(prints: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(kind, side, rows, buckets) of whole segments, and of the nearest codewords of pairs of segments."""
    parts = _segments(prints)
    for kind, part in enumerate(parts):
        yield kind, BOTH, np.arange(len(prints)), _key(kind, part)
    near, odd = [decode(p)[0] for p in parts], [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    for kind, (i, j) in enumerate(PAIRS, len(SEGMENTS)):
        rows = np.flatnonzero(odd[i])
        yield kind, INDEX, rows, _key(kind, (near[i][rows] << 13) + (near[j][rows] << 1) + odd[j][rows])


def probe_keys(prints: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(kind, side, rows, buckets) under which pairs of segments with one error each meet the index."""
    parts = _segments(prints)
    found, odd = [decode(p) for p in parts], [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    every = [np.concatenate([near[:, None], others], axis=1) for near, others in found]
    for kind, (i, j) in enumerate(PAIRS, len(SEGMENTS)):
        rows = np.flatnonzero(odd[i] == 0)
        a, b = every[i][rows][:, :, None], every[j][rows][:, None, :]
        value = (a << 13) + (b << 1) + (1 - odd[j][rows])[:, None, None]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        yield kind, PROBE, rows[row], _key(kind, value[row, x, y])


def _key_rows(classes: DataFrame, keys, table: np.ndarray | None = None) -> DataFrame:
    """(bucket, fp, kind, side) of all keys, or of those whose bit is set in the table."""
    shared = None if table is None else classes.sparkSession.sparkContext.broadcast(table)

    def rows(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for kind, side, row, bucket in keys(prints):
                if shared is not None:
                    known = has_bit(shared.value, bucket)
                    row, bucket = row[known], bucket[known]
                made = [pa.array(bucket.view(np.int64)), pa.array(prints[row].view(np.int64)), pa.array(np.full(len(row), kind, np.int8)), pa.array(np.full(len(row), side, np.int8))]
                yield pa.RecordBatch.from_arrays(made, ["bucket", "fp", "kind", "side"])

    return classes.select("fp").mapInArrow(rows, "bucket long, fp long, kind byte, side byte")


# Links -------------------------------------------------------------------------------


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _pieces(bits: int) -> Column:
    """Numbered pieces of the bits that a bucket leaves open: more of them than a pair can differ in there."""

    def of(spans: list[tuple[int, int]], count: int) -> Column:
        open_bits = [i for at, width in spans for i in range(at, at + width)]
        cuts = [open_bits[n * len(open_bits) // count : (n + 1) * len(open_bits) // count] for n in range(count)]
        mask = lambda cut: (m := sum(1 << i for i in cut)) - (m >> 63 << 64)
        return F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask(c)).cast("long")).alias("value")) for n, c in enumerate(cuts)])

    out = None
    for kind in range(len(SEGMENTS)):  # a whole segment is equal: all errors are in the others
        made = of([s for n, s in enumerate(SEGMENTS) if n != kind], bits + 1)
        out = F.when(F.col("kind") == kind, made) if out is None else out.when(F.col("kind") == kind, made)
    for kind, pair in enumerate(PAIRS, len(SEGMENTS)):  # an error in each of two segments
        out = out.when(F.col("kind") == kind, of([s for n, s in enumerate(SEGMENTS) if n not in pair], bits - 1))
    return out


def _exact_links(rows: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """Components (a, b) that a pair within a bucket links, all pairs considered; from (bucket, fp, kind, side, component)."""
    cut = rows.withColumn("piece", F.explode(_pieces(bits))).select(F.xxhash64("bucket", "piece.n", "piece.value").alias("cell"), "fp", "side", "component")
    cut = scratch.write(cut, "cells")
    sizes = cut.groupBy("cell").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    sizes = scratch.write(sizes.select("cell", "n"), "cell-sizes")
    cut = join_counted(cut, sizes, ["cell"], "n", cut.count()).withColumn("parts", F.ceil(F.col("n") / SPLIT).cast("int"))
    left = cut.where(F.col("side") != PROBE).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    right = cut.where(F.col("side") != INDEX).select("cell", F.col("fp").alias("other"), F.col("component").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["cell", "part"]).where((F.col("component") != F.col("c")) & _near("fp", "other", bits))
    return pairs.select(F.greatest("component", "c").alias("a"), F.least("component", "c").alias("b")).distinct()


def _lists(rows: DataFrame, flip: int) -> DataFrame:
    """Of each bucket: its rows (n) and those of each side, its least and greatest component, and a centre of each side."""
    member = F.struct(F.col("fp").bitwiseXOR(F.lit(flip)).alias("place"), "fp", "component")
    held, asked = F.col("side") != PROBE, F.col("side") != INDEX
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.count_if(held).alias("n_held"), F.count_if(asked).alias("n_asked"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.min(F.when(held, member)).alias("held"), F.min(F.when(asked, member)).alias("asked"),
    )


def _against_centre(rows: DataFrame) -> DataFrame:
    """Add the centre of the other side, and its fingerprint as ``other``."""
    return rows.withColumn("centre", F.when(F.col("side") == PROBE, F.col("held")).otherwise(F.col("asked"))).withColumn("other", F.col("centre.fp"))


def simhash_components(docs: DataFrame, k: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and the component that links of at most ``bits`` (4) differing bits put it in.

    Returns one row for each input row: doc_id, fp (the fingerprint as a signed
    long), n_equal (rows with the same fingerprint) and component_id, the
    smallest doc_id reachable.  A-Z are lower-cased, shingles counted as often
    as they occur; a text of fewer than k words has one shingle, its words.
    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Rows that repeat a doc_id are linked by their own fingerprints; a
    null doc_id is never a component's name while another is there.  Only the
    two named columns are read; an empty table gives none.
    """
    if bits != BITS:
        raise ValueError(f"the keys are made for {BITS} differing bits")
    scratch = Scratch(docs.sparkSession, "simhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = scratch.write(_print_rows(docs, k), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")

    # a key is asked for only where the index may have it, and a bucket stays if it has something to compare
    index = scratch.write(_key_rows(classes, index_keys), "index")
    held = index.where(F.col("side") == INDEX)
    slots = index.unionByName(_key_rows(classes, probe_keys, bit_table(held.select("bucket"), table_bits(held.count()))))
    slots = scratch.write(slots, "slots")

    # first round: everyone against the centre of the bucket; after it a bucket with one row on a side is done
    lists = _lists(slots.withColumn("component", F.col("fp")), 0).where("n > 1 and n_held > 0 and n_asked > 0")
    posting = join_counted(slots, scratch.write(lists, "lists"), ["bucket"], "n", slots.count())
    posting = _against_centre(posting.withColumn("component", F.col("fp")))
    posting = scratch.write(posting.withColumn("open", F.expr("n > 2 and n_held > 1 and n_asked > 1")).select("bucket", "fp", "kind", "side", "other", "open"), "posting")
    links = scratch.write(posting.where(_near("fp", "other", bits) & (F.col("fp") != F.col("other"))).select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct(), "links-0")
    scratch.drop("index", "slots", "lists")
    posting = posting.where("open").select("bucket", "fp", "kind", "side")
    labels, total = scratch.write(connected_components(links, scratch, "cc-0"), "labels-0"), posting.count()

    for step in range(1, len(CENTRES) + 1):
        named = posting.join(labels, posting.fp == labels.node, "left").withColumn("component", F.coalesce("component", "fp")).drop("node")
        named = scratch.write(named, f"named-{step}")
        lists = scratch.write(_lists(named, CENTRES[step % len(CENTRES)]).where("lo <> hi"), f"lists-{step}")
        if lists.isEmpty():
            break
        left = join_counted(named, lists, ["bucket"], "n", total)
        if step == len(CENTRES):
            links = _exact_links(left.select("bucket", "fp", "kind", "side", "component"), bits, scratch)
        else:
            left = _against_centre(left).withColumn("c", F.col("centre.component")).where((F.col("component") != F.col("c")) & _near("fp", "other", bits))
            links = left.select(F.greatest("component", "c").alias("a"), F.least("component", "c").alias("b")).distinct()
        # links of components: a component's name is no node of the labels so far
        joined = scratch.write(connected_components(links, scratch, f"cc-{step}"), f"joined-{step}")
        moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        labels = scratch.write(moved.unionByName(joined), f"labels-{step}")
        scratch.drop(f"named-{step}", f"lists-{step}", f"labels-{step - 1}", f"joined-{step}", "links-0", "cells", "cell-sizes")

    rooted = classes.join(labels, classes.fp == labels.node, "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    names = scratch.write(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "names")
    whole = scratch.write(join_counted(rooted.select("fp", "n", "root"), names, ["root"], "members", rooted.count()).select("fp", "n", "component_id"), "whole")
    return join_counted(prints, whole, ["fp"], "n", prints.count()).select("doc_id", "fp", F.col("n").alias("n_equal"), "component_id")
