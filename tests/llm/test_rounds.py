"""SimHash, vector codes and source divergence against brute force, on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from marlinspike.llm import chat_format, divergence, license_scan, oracles, queries, simhash, vector_codes

DOCS = "doc_id long, text string, lang string, source string, fp long, term string, rank int"


@pytest.fixture(scope="module")
def small(spark, data):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


# SimHash -----------------------------------------------------------------------------


def print_of(text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    shingles = [w[i : i + 4] for i in range(len(w) - 3)] or ([w] if w else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, prints):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, f"{p:016x}", least.get(find(i))) for i, ((k, *_), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def got(found):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect()), key=str)


def test_simhash_matches_brute_force(spark, data, small):
    want = components(small, [print_of(r[1]) for r in small])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, data).collect()), key=str) == want
    assert len({c for *_, c in want}) < len(want)


def awkward_texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["alpha", "Béta", "gamma", "delta", "x" * 40, "ß"]) + str(rng.randrange(30)) for _ in range(n))
    a = say(300)
    near = [" ".join("changed" if i == k else w for i, w in enumerate(a.split())) for k in range(0, 300, 12)]
    return [None, "", " \n\t", "one", "ONE", "one two three", "one  two\x0bthree", "one\x1ctwo", a, a, a.upper(), a.replace(" ", "\n"), a.replace(" ", " "), "w " * 3000, "y" * 5000, say(4000), *near, *(say(20) for _ in range(30))]


def test_simhash_of_awkward_rows(spark, monkeypatch):
    rows = [(i * 3 if i % 17 else None, t, "en", "s", 1, "t", 2) for i, t in enumerate(awkward_texts(), 1)]
    rows += rows[2:12]
    want = components(rows, [print_of(r[1]) for r in rows])
    docs = spark.createDataFrame(rows, DOCS)
    assert got(simhash.simhash_components(docs)) == want
    # one centre round, then the exact round with buckets in many parts; words split in small pieces
    monkeypatch.setattr(simhash, "CENTRES", (0,))
    monkeypatch.setattr(simhash, "SPLIT", 2)
    monkeypatch.setattr(simhash, "PIECE", 50)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert got(simhash.simhash_components(docs)) == want
    assert simhash.fingerprint(awkward_texts()[15].encode()) == print_of(awkward_texts()[15])
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def near_prints(n, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, n, dtype=np.uint64)
    b = a.copy()
    for i in range(n):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    return a, b


def test_simhash_links_of_chains_and_clusters(spark, monkeypatch):
    """Fingerprints given as such: clusters whose members are far from each other, chains, and strangers in one bucket."""
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    prints = {centre}
    for _ in range(400):  # within 8 bits of each other, so one component of many partial links
        p = centre
        for bit in rng.choice(64, 4, replace=False).tolist():
            p ^= 1 << bit
        prints.add(p)
    chain = int(rng.integers(0, 2**64, dtype=np.uint64))
    for bit in range(0, 60, 4):
        chain ^= 0b1111 << bit
        prints.add(chain)
    low = int(rng.integers(0, 2**21))
    prints |= {low | int(rng.integers(0, 2**43)) << 21 for _ in range(400)}
    prints = sorted(prints)
    rows = [(i, str(p)) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "fingerprint", lambda text, k: int(text))
    monkeypatch.setattr(simhash, "_print_rows", lambda docs, k: docs.selectExpr("doc_id", "cast(case when cast(text as decimal(20)) >= 9223372036854775808 then cast(text as decimal(20)) - 18446744073709551616 else cast(text as decimal(20)) end as long) as fp"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.simhash_components(docs)) == components(rows, prints)
    monkeypatch.setattr(simhash, "CENTRES", (0,))
    monkeypatch.setattr(simhash, "SPLIT", 50)
    assert got(simhash.simhash_components(docs)) == components(rows, prints)


def test_golay_keys_miss_no_pair():
    a, b = near_prints(3000)

    def tables(prints):
        held, asked = [set() for _ in prints], [set() for _ in prints]
        for _, side, rows, keys in simhash.index_keys(prints):
            for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
                held[r].add(k)
                if side == simhash.BOTH:
                    asked[r].add(k)
        for _, _, rows, keys in simhash.probe_keys(prints):
            for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
                asked[r].add(k)
        return held, asked

    (ha, qa), (hb, qb) = tables(a), tables(b)
    assert all(ha[i] & qb[i] or hb[i] & qa[i] for i in range(len(a)))
    assert sum(bool(ha[i] & qb[i - 1] or hb[i - 1] & qa[i]) for i in range(len(a))) < 10
    nearest, others = simhash.decode(np.arange(1 << 23))
    assert np.bincount(nearest, minlength=4096).tolist() == [2048] * 4096
    assert set((others >= 0).sum(axis=1).tolist()) == {0, 5}


# Vector codes ------------------------------------------------------------------------


def codes_of(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    own = len(kept[0][1]) // parts
    cut = lambda v: [v[p * own : (p + 1) * own] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else e for n, e in enumerate(books[p])]
    out, sums = [], Counter()
    for i, v, label in kept:
        found = [near(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
        sums[label] += out[-1][3]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, sums[label]) for i, label, c, e in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def vector_rows():
    rng = random.Random(6)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(8)], rng.choice([0, 1, 2, None])) for i in range(60)]
    rows += [(100 + i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(8)], 7) for i in range(40)]  # many ties
    rows += [(-5, None, 1), (-4, [], 1), (-3, [None] * 8, 1), (-2, [float("nan")] * 8, 1), (-1, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, None)]
    return rows + [rows[3], rows[3], rows[50], (3, [0.25] * 8, 2)]


@pytest.mark.parametrize("entries", [5, 16, 256])
def test_vector_codes_match_brute_force(spark, entries):
    rows = vector_rows()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as code", "1 as error")
    codes, decode, books = vector_codes.compress_vectors(vectors, entries=entries)
    want, digest = codes_of(rows, entries)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()), key=str) == want
    assert vector_codes.digest(books) == digest
    if entries == 256:  # each vector has an entry of its own
        given = {r[0]: r[1] for r in rows[:60]}
        assert all(max(abs(a - b) for a, b in zip(r.decoded, given[r.vec_id], strict=True)) < 0.3 for r in decode(codes).collect() if r.vec_id in range(60) and r.vec_id != 3)


def test_vector_codes_match_sql(spark):
    rows = [r for r in vector_rows() if r[1] != []]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, _, books = vector_codes.compress_vectors(vectors)
    want = sorted(con.execute(oracles.VECTOR_CODES).fetchall(), key=str)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, vector_codes.digest(books)) for r in codes.collect()), key=str) == want


def test_vector_codes_of_empty_uneven_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.compress_vectors(spark.createDataFrame([], schema))[0].collect() == []
    assert vector_codes.compress_vectors(spark.createDataFrame([(1, None, "a")], schema))[0].collect() == []
    rows = [(1, [1.0] * 6, "a"), (2, [2.0] * 6, None), (3, [1.0] * 5, "a"), (4, [3e38] * 6, "a"), (5, [-3e38] * 6, "a")]
    codes, decode, books = vector_codes.compress_vectors(spark.createDataFrame(rows, schema))
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == [(1, "00000000", 0), (2, "01010100", 0), (4, "02020200", 0), (5, "03030300", 0)]  # the last part is all filled up
    assert all(len(r.decoded) == 6 for r in decode(codes).collect())
    assert [b.shape for b in books] == [(4, 2)] * 4


def test_trees_find_the_lowest_of_equals():
    rng = np.random.default_rng(2)
    for spread, width in ((2, 3), (1, 2), (200, 16), (10**8, 4)):
        book, points = rng.integers(-spread, spread + 1, (256, width)), rng.integers(-spread, spread + 1, (3000, width))
        code, far = vector_codes.Tree(book).nearest(points)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


# Source divergence -------------------------------------------------------------------


def audit(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(counts[x, s]) for x, s in groups if x == lang}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, own in p.items():
            pairs = [(-sum(f(own[t], p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            tops = [(-f(own[t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(tops)[:top])):
                out += [(lang, s, part, i.decode(), -v, n) for n, (v, i) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_matches_brute_force(spark, data, small):
    assert sorted(map(tuple, queries.op13_source_divergence(spark, data).collect())) == audit(small)


def test_divergence_of_awkward_rows(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)] + ["É", "é", "日本", "x" * 3000]
    say = lambda n, s: " ".join(words[min(int(rng.expovariate(1 / s)), len(words) - 1)] for _ in range(n))
    rows = [(i, say(rng.randrange(80), 10 + 9 * (i % 5)), ["en", "fr", None][i % 3], [f"s{i % 5}", "hot", None][i % 2 if i % 7 else 2]) for i in range(300)]
    rows += [(900, None, "en", "mute"), (901, "", "xx", "mute"), (902, "a1b2 C_D", "xx", "other"), (903, "9 9 9", None, None)]
    rows += [(1000 + i, "same same ties ties", "tie", f"t{i % 3}") for i in range(30)]
    rows += rows[:5]
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 40)
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], DOCS)
    for top in (10, 1, 3):
        assert sorted(map(tuple, divergence.audit_sources(docs, top=top).collect())) == audit(rows, top=top)
    assert divergence.audit_sources(docs.limit(0)).collect() == []
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(oracles.SOURCE_DIVERGENCE).fetchall()) == audit(rows)


def test_divergence_shares_of_huge_counts_are_exact(spark):
    big = [(10**17, 3 * 10**18, 5), (9 * 10**9, 9 * 10**9, 1), (7, 100, 3), (0, 4 * 10**18, 10**6)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(big, "c long, n long, v long").select("c", "n", "v", divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in rows)


# Chat formatting ---------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def chat_rows():
    first, second = "first message here\nwith another line", "My reply text"
    third = "Third one"
    quote = lambda text: "\n".join("> " + x if not x.startswith(">") else ">" + x for x in text.split("\n"))
    one = f"{second}\nOn Mon, X wrote:\n{quote(first)}"
    two = f"{third}\nOn Tue, Y wrote:\n{quote(one)}"
    three = f"Fourth\nOn Wed, Z wrote:\n{quote(two)}"
    long = "It was a long line of words that somebody wrote without a break, and then went on.\nAnother line came after it with words of its own."
    rewrapped = "> words that somebody wrote without\n> a break, and then went on. Another line\n> came after it\nI see."
    rows = [(1, 0, "a", first), (1, 1, "b", one), (1, 2, "a", two), (1, 3, "b", three)]
    rows += [(2, 0, "a", long), (2, 1, "b", "It was a long line of nothing"), (2, 2, "c", rewrapped), (2, 3, "d", "> It was a long line\nWhich?"), (2, 4, "e", "> a long line of\nNo, too short a part."), (2, 5, "f", "> words that somebody said without a break\nNobody said so.")]
    return rows + [(3, 0, "a", "no"), (3, 1, "b", "> On Mon, X wrote:"), (3, 2, "b", "On Mon, X wrote:\n> no")]


def test_chat_attributions_inside_quotations_and_rewrapped_parts(spark):
    rows = chat_rows()
    linked = chat_format.link_quotes(spark.createDataFrame(rows, CHAT)).collect()
    got = {(r.conv_id, r.turn): (r.content, r.n_quotes, r.n_linked, r.reply_to) for r in linked}
    assert got[1, 1] == ("My reply text", 1, 1, 0)
    assert got[1, 2] == ("Third one", 2, 2, 1)
    assert got[1, 3] == ("Fourth", 3, 3, 2)
    assert got[2, 2] == ("I see.", 1, 1, 0) and got[2, 3] == ("Which?", 1, 1, 1)
    assert got[2, 4][2:] == got[2, 5][2:] == (0, None)
    assert got[3, 1] == ("", 0, 0, None) and got[3, 2][3] == 0
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(oracles.CHAT_FORMAT)
    names = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in linked)


def test_chat_of_long_messages_and_many_lengths(spark):
    rng = random.Random(1)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(3000)]
    rows = [(1, 0, "a", "\n".join(lines))]
    spans = [(rng.randrange(2900), rng.choice([1, 2, 3, 7, 30, 90])) for _ in range(40)]
    for turn, (at, n) in enumerate(spans, 1):
        words = " ".join(lines[at : at + n]).split()[2:]
        rows.append((1, turn, "b", "\n".join("> " + " ".join(words[i : i + 5]) for i in range(0, len(words), 5)) + f"\nanswer {turn}"))
    got = {r.turn: (r.n_linked, r.reply_to) for r in chat_format.link_quotes(spark.createDataFrame(rows, CHAT)).collect()}
    assert all(got[t] == (1, 0) for t in range(1, 41))


def test_chat_without_quotations_in_turn_order(spark):
    rows = [(1, 5, "a", "x"), (1, 2, "b", "y"), (1, 5, "a", "x"), (None, 1, "a", "z"), (2, None, "a", "z"), (2, 10_000, "a", None)]
    got = sorted(((r.conv_id, r.turn, r.position, r.thread, r.reply_to) for r in chat_format.link_quotes(spark.createDataFrame(rows, CHAT)).collect()), key=str)
    assert got == sorted([(1, 5, 1, 5, None), (1, 5, 1, 5, None), (1, 2, 0, 2, None), (None, 1, None, None, None), (2, None, None, None, None), (2, 10_000, 0, 10_000, None)], key=str)


# License scans -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-notice"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        ("This work is licensed under the GNU Affero General Public License, version 3.", None),
        ("Licensed under CC BY-ND 4.0.", None),
        ("Licensed under CC BY-NC-SA 4.0.", None),
        ("Licensed under CC BY 3.0.", None),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0-notice"),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Copyright 2019. Released under the MIT License.", "MIT-notice"),
        (license_scan.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"), "GPL-2.0"),
        (license_scan.TEMPLATES["LGPL-2.1"].replace("2.1", "3"), None),
    ],
)
def test_license_words_that_decide(text, license):
    scanner, prose = license_scan.Scanner(license_scan.TEMPLATES), "plain prose stands here and goes on for a while, "
    for whole in (text, prose + text, text + " " + prose * 30, prose * 30 + "\n" + text.replace(" ", "\n", 3) + "\n" + prose):
        found = {r["license"] for r in scanner.scan(whole) if r["confirmed"]}
        assert found == ({license} if license else set())


def test_license_templates_are_found_and_told_apart():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, template in license_scan.TEMPLATES.items():
        rows = scanner.scan(template)
        assert [(r["license"], r["n_missing"], r["n_extra"]) for r in rows if r["confirmed"]] == [(name, 0, 0)]


def test_license_scan_of_thousands_of_notices():
    import time

    rng = random.Random(2)
    short = [t for t in license_scan.TEMPLATES.values() if len(t) < 80]
    lines = [rng.choice(short) for _ in range(8000)]
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for joined in ("\n", " "):
        began = time.process_time()
        rows = [r for r in scanner.scan(joined.join(lines)) if r["confirmed"]]
        assert len(rows) == 8000
        assert time.process_time() - began < 5


def test_spans_that_do_not_overlap():
    rng, taken, kept = random.Random(7), license_scan.Taken(), []
    for _ in range(2000):
        a = rng.randrange(3000)
        b = a + rng.randint(1, 9)
        free = all(b <= x or a >= y for x, y in kept)
        assert taken.add(a, b) == free
        if free:
            kept.append((a, b))
