"""N-gram Jaccard self-join by prefix filters under several global orders.

A document's set holds its distinct k-word shingles.  If two sets have a
Jaccard similarity of at least t, they share a token among the first
``n - ceil(t*n) + 1`` tokens of each, under *any* global order of the tokens.
Three orders are used and a pair must pass all three before any set is fetched
and verified:

* A, rare first: by the token's count in a hashed sketch of document
  frequencies over the whole corpus, then by hash.  This order is indexed;
  common tokens go last and so make no large posting lists.  A pair's shared
  token must also come early enough for the overlap that the sizes of the two
  ask for.
* B, ascending hash, and C, descending hash: the prefixes of both are kept as
  16-bit digests, in order.  A candidate of A must share a prefix token under B
  and under C.  The filters are then intersected: what one document has in its
  two prefixes, where the other's reach as far, and the other lacks is missing
  from the overlap, and both prefixes together must not lack too much.

Within long posting lists the parities of hash classes of tokens, which bound
the overlap too, are compared first.

Pairs are not enumerated within a posting list.  Copies with equal sets are
collapsed first.  Then each member of a list is joined to the list's first
document; verified links give components; the next round takes the largest
document that is still outside; the last round joins what remains in
different components, which is exact.  Members of one component need no
further check, so a family of n near copies costs about n verifications.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .components import connected_components
from .shared import BROADCAST_ROWS, Scratch, arrays_fit, bit_table, broadcast_if_small, has_bit, in_one_task, join_counted, table_bits

#: Characters of text for each bucket of the sketch, and the least and largest sketch (2**24 buckets, 16 MB on the driver).
#: A token stands out once it is commoner than a bucket's mean, so it is moved to the end at every size.
CHARS_A_BUCKET, LEAST_SKETCH, MOST_SKETCH = 1 << 12, 14, 24
#: Buckets whose counts travel together.
BLOCK = 1 << 12
PARITY_BITS = 512
#: Most members of a posting list, in the last round, that one task joins to all the others.
SPLIT = 2000
#: The centre of a posting list in each round is its member with the least id XOR one of these.
CENTRES = (0, -1, 0x5555555555555555, 0x3333333333333333)
#: Centre rounds end, and the exact last round begins, once a round adds fewer than one in so many links.
FEW = 50


def shingle_sets(texts: pa.Array, k: int):
    """Yield (row, ascending distinct uint64 shingle hashes) for each text.

    Lower-cases A-Z only.  A text of fewer than k words has its whole word
    sequence as the one shingle; one without words has an empty set.
    """
    for lo, hi, buf, offsets in K.blocks(texts):
        buf = K.LOWER[buf]
        starts, ends, first = K.words(buf, offsets, K.NON_SPACE)
        hashes = K.span_hashes(buf, starts, ends)
        windows = K.window_hashes(hashes, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield lo + i, np.unique(windows[a : b - k + 1])
            elif b > a:
                yield lo + i, K.whole_hash(hashes[a:b]).reshape(1)
            else:
                yield lo + i, np.zeros(0, np.uint64)


def _least(n, percent: int):
    """Smallest overlap that a set of n can have with a similar one."""
    return (percent * n + 99) // 100


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=sizes[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat))


def sketch_bits(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max((chars // CHARS_A_BUCKET).bit_length(), LEAST_SKETCH), MOST_SKETCH)


def count_sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """A level (8 log2 of the count, 255 at most) for each hash bucket of shingles' document frequencies.

    Every document is counted.  A task's counts are packed in blocks of buckets,
    a few bytes a bucket at most; blocks are summed as they come.
    """

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), k):
                np.add.at(total, (found & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        parts = total.reshape(-1, BLOCK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used.tolist()], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}  # at most all blocks of the sketch
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.uint32)
                sums[block] = sums[block] + own if block in sums else own.astype(np.int64)
        levels = [np.minimum(255, 8 * np.log2(v + 1)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, levels binary").toArrow()
    out = np.zeros(1 << bits, np.uint8)
    for block, levels in zip(rows["block"].to_pylist(), rows["levels"].to_pylist(), strict=True):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(levels, np.uint8)
    return out


def _fingerprints(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, low, high, parity).

    Set size, digest of the set, prefix under order A, digests in ascending
    order of the prefixes under B and C, parities of PARITY_BITS hash classes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    mask = np.uint64(len(sketch) - 1)

    def fingerprint(batches):
        levels = shared.value.astype(np.uint64) << np.uint64(55)
        for batch in batches:
            sizes, keys, prefixes, low, high, parity = [], [], [], [], [], []
            for _, found in shingle_sets(batch.column(1), k):
                n = len(found)
                sizes.append(n)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                order = levels[(found & mask).astype(np.int64)] | (found >> np.uint64(9))
                take = n - _least(n, percent) + 1 if n else 0
                prefixes.append(np.sort(np.partition(order, take - 1)[:take] if take < n else order))
                digest = ((found >> np.uint64(48)).astype(np.int32) - (1 << 15)).astype(np.int16)
                low.append(digest[:take])
                high.append(digest[n - take :])
                parity.append(np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.uint64))
            digest = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _list_array(prefixes), _list_array(low), _list_array(high), _list_array(parity)],
                ["doc_id", "n", "k1", "k2", "prefix", "low", "high", "parity"],
            )

    schema = "doc_id long, n int, k1 long, k2 long, prefix array<long>, low array<short>, high array<short>, parity array<long>"
    return docs.select("doc_id", "text").mapInArrow(fingerprint, schema)


#: What the prefixes of a set under B and C hold that the other one's, as far as they reach, do not.
_LACKS = (
    "size(array_except(filter({a}.low, v -> v < element_at({b}.low, -1)), {b}.low)) + "
    "size(array_except(filter({a}.high, v -> v > {b}.high[0]), {b}.high))"
)
#: Sets that differ in d tokens have at most d hash classes of different parity.
_UNLIKE = "aggregate(zip_with({a}.parity, {b}.parity, (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)"

#: Bytes of the digests and parities in a pair's column f.
_FILTER_BYTES = f"2L * (size(f.low) + size(f.high)) + {PARITY_BITS // 8}"


def _need(n: str, m: str, percent: int) -> str:
    """Overlap that similar sets of n and m tokens have."""
    return f"(({percent} * ({n} + {m}) + {percent + 99}) div {percent + 100})"


def _passes(a: str, b: str, n: str, m: str, percent: int) -> str:
    """The condition on the structs a and b (low, high, parity) of sets of n and m tokens under orders B and C."""
    need = _need(n, m, percent)
    return (
        f"arrays_overlap({a}.low, {b}.low) and arrays_overlap({a}.high, {b}.high) and {_like(a, b, n, m, percent)} "
        f"and {n} - ({_LACKS.format(a=a, b=b)}) >= {need} and {m} - ({_LACKS.format(a=b, b=a)}) >= {need}"
    )


def _like(a: str, b: str, n: str, m: str, percent: int) -> str:
    return f"{n} + {m} - {_UNLIKE.format(a=a, b=b)} >= 2 * {_need(n, m, percent)}"


def _slots(own: DataFrame, table: np.ndarray) -> DataFrame:
    """(token, rep, n, pos, mark) of the prefix tokens whose bit is set; a false positive proves single later."""
    shared = own.sparkSession.sparkContext.broadcast(table)

    def rows(batches):
        for batch in batches:
            lists = batch.column(2)
            tokens, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            kept = np.flatnonzero(has_bit(shared.value, K.mix(tokens.view(np.uint64))))
            doc = np.repeat(np.arange(len(sizes)), sizes)[kept]
            pos = kept - (np.cumsum(sizes) - sizes)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[kept]), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(pos.astype(np.int32)), batch.column(3).take(pa.array(doc))], ["token", "rep", "n", "pos", "mark"])

    # the mark is that of a class: a doc_id may stand for several
    marked = own.select("doc_id", "n", "prefix", F.xxhash64("doc_id", "k1", "k2").alias("mark"))
    return marked.mapInArrow(rows, "token long, rep long, n int, pos int, mark long")


def _mixed(tokens: DataFrame) -> DataFrame:
    """Tokens as uniform hashes; the order's tokens begin with the level of their bucket."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(K.mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["hash"])

    return tokens.select("token").mapInArrow(rows, "hash long")


def _full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set): whole sets, in ascending order of the signed hash, of some documents."""

    def sets(batches):
        for batch in batches:
            found = [np.sort(s.view(np.int64)).view(np.uint64) for _, s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(found)], ["doc_id", "set"])

    # rows that repeat a doc_id stand for one document here: its first set
    wanted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return wanted.mapInArrow(sets, "doc_id long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the exact test."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", F.expr("size(array_intersect(sa, sb))"))
    return joined.where(f"100 * common >= {percent} * (size(sa) + size(sb) - common)").select("a", "b").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents that are linked by Jaccard >= percent/100 on k-word shingles.

    Returns one row for each input row: (doc_id, n_shingles, class_id,
    component_id).  class_id is the smallest doc_id with an equal set,
    component_id the smallest reachable by links.  Null, empty or blank texts
    have an empty set, no links, and are their own component.  Rows that
    repeat a doc_id count as one document whose sets all link it, so all of
    them that have a set are in one component.  Columns
    other than the two named ones are not read.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark, "jaccard")
    sketch = count_sketch(docs, k, sketch_bits(docs))
    prints = scratch.write(_fingerprints(docs, k, percent, sketch).withColumn("row", F.monotonically_increasing_id()), "prints")
    # the first row of a class stands for it; with equal rows only one does, or posting lists would count it again
    firsts_of = [F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min_by("row", "doc_id").alias("row"), F.count("*").alias("rows")]
    classes = scratch.write(prints.where("n > 0").groupBy("k1", "k2").agg(*firsts_of), "classes")

    # order A: posting lists of the class representatives; a token that only one has is dropped
    firsts = broadcast_if_small(classes.select("row"))
    own = prints.join(firsts, "row", "left_semi")
    often = scratch.write(own.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select("token"), "often")
    slots = scratch.write(_slots(own, bit_table(_mixed(often), table_bits(often.count()))), "slots")
    scratch.drop("often")
    # the prefixes, most of the table, are not read again
    prints = scratch.write(prints.drop("prefix"), "kept")
    scratch.drop("prints")
    own = prints.join(firsts, "row", "left_semi")
    lists = slots.groupBy("token").agg(F.count("*").alias("members"), F.min("rep").alias("centre"), F.bit_xor("mark").alias("mark")).where("members > 1")
    # of tokens with the same members (a passage's shingles) the first comes earliest in all of them and says as much as all
    lists = lists.groupBy("members", "centre", "mark").agg(F.min("token").alias("token")).select("token", "centre")
    posting = scratch.write(slots.join(broadcast_if_small(scratch.write(lists, "heads")), "token").select("token", "rep", "n", "pos", "centre"), "posting")
    scratch.drop("heads", "slots")
    # rows that repeat a doc_id are told apart by their class
    filters = own.select(F.col("doc_id").alias("rep"), F.struct("low", "high", "parity").alias("f"))

    # a pair of sizes n and m must overlap in so many: one shared token lies as early as this in both
    need = _need("n", "m", percent)
    early = f"pos <= n - {need} and pos2 <= m - {need}"
    links, tested, labels, count = None, None, None, 0
    for step in range(len(CENTRES) + 1):
        last = step == len(CENTRES) or step > 1 and fresh * FEW < count
        left = posting.withColumn("component", F.col("rep"))
        if step:
            left = posting.drop("centre").join(labels, posting.rep == labels.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
            left = scratch.write(left, f"named-{step}")
            flip = F.lit(CENTRES[step % len(CENTRES)])
            lists = left.groupBy("token").agg(
                F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.col("rep").bitwiseXOR(flip)).alias("centre")
            ).where("lo <> hi")
            lists = scratch.write(lists.select("token", F.col("centre").bitwiseXOR(flip).alias("centre")), f"lists-{step}")
            if lists.isEmpty():
                break
            left = left.join(lists, "token")
        if not last:
            middle = left.where("rep = centre").select("token", F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("component").alias("other"))
            pairs = left.join(middle, "token").where("rep <> centre" if step == 0 else "component <> other")
        else:
            # a long list is cut into parts, and each part joined to all: no task joins more than SPLIT members to the list
            parts = scratch.write(left.groupBy("token").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")), "parts")
            left = left.join(filters.select("rep", F.struct("f.parity").alias("f")), "rep").join(parts, "token")
            partner = left.select("token", F.col("rep").alias("centre"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("f").alias("g"), F.col("component").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            pairs = left.drop("centre").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).join(partner, ["token", "part"]).where("component < other").where(early).where(_like("f", "g", "n", "m", percent))
        ordered = F.col("rep") > F.col("centre")
        pairs = pairs.where(early).select(
            F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b"), F.when(ordered, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(ordered, F.col("m")).otherwise(F.col("n")).alias("m")
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = broadcast_if_small(scratch.write(pairs, f"early-{step}"))
        # orders B and C, before any set is fetched
        pairs = pairs.join(filters.withColumnRenamed("rep", "a"), "a")
        pairs, other = scratch.write(pairs, f"half-{step}"), filters.select(F.col("rep").alias("b"), F.col("f").alias("g"))
        if arrays_fit(pairs, _FILTER_BYTES):
            pairs = F.broadcast(pairs)
        else:  # only the filters that a pair asks for are shuffled
            other = other.join(broadcast_if_small(pairs.select("b").distinct()), "b", "left_semi")
        pairs = pairs.join(other, "b")
        pairs = pairs.where(_passes("f", "g", "n", "m", percent)).select("a", "b").distinct()
        pairs = scratch.write(pairs, f"pairs-{step}")
        passed = pairs.count()
        ids = in_one_task(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), 2 * passed)
        ids = scratch.write(ids.distinct(), f"ids-{step}")
        sets = scratch.write(_full_sets(docs, broadcast_if_small(ids), k), f"sets-{step}")
        found = scratch.write(_verified(F.broadcast(pairs) if passed <= BROADCAST_ROWS else pairs, sets, percent), f"links-{step}")
        scratch.drop(f"sets-{step}", f"ids-{step}", f"early-{step}", f"half-{step}", f"named-{step}", f"lists-{step}", f"labels-{step - 1}")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = found.count()
        count += fresh
        labels = scratch.write(connected_components(in_one_task(links, count), scratch, f"cc-{step}"), f"labels-{step}")
        if last:
            break

    # a doc_id with several sets links them
    several = prints.groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = prints.where("n > 0").join(broadcast_if_small(scratch.write(several, "several")), "doc_id").select("doc_id", "k1", "k2").distinct()
    inner = scratch.write(several.join(classes, ["k1", "k2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "inner")
    if not inner.isEmpty():
        labels = scratch.write(connected_components(inner.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch, "cc-own"), "labels-own")
    whole = classes.join(labels, classes.rep == labels.node, "left").select("k1", "k2", "rows", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    whole = scratch.write(whole, "whole")
    size = F.col("n").cast("long").alias("n_shingles")
    # documents without words have the same set, but no class: they do not take part in the join
    said = join_counted(prints.where("n > 0").select("doc_id", "n", "k1", "k2"), whole, ["k1", "k2"], "rows", prints.where("n > 0").count())
    mute = prints.where("n = 0").select("doc_id", size, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return said.select("doc_id", size, "class_id", "component_id").unionByName(mute)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is their component's smallest."""
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(first, id_col, "left_semi").select(*docs.columns)
