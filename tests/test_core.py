"""Functions, matching, configuration, store and queue on small inline tables."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlinspike.functions import bits, scores, text
from marlinspike.operators import config, fingerprints, matching, store, tasks, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text(spark):
    s = F.lit
    got = one(spark, text.remove_whitespace(s("a　b  c\n")), text.normalize_whitespace(s(" a　 b\n")), text.simple_normalize(s(None).cast("string")), text.normalize_punctuation(s("a，b（c）“d”")), text.normalize_punctuation(s("“d”"), True))
    assert got == ("abc", "a b", "", "a,b(c)“d”", '"d"')
    assert one(spark, text.remove_punctuation(s("a, b-c。《d》_e")), text.to_lowercase(s("ÀB")), text.normalize_text(s("A  B！"), ["normalize_whitespace", "normalize_punctuation", "to_lowercase"])) == ("a bcd_e", "àb", "a b!")
    with pytest.raises(ValueError):
        text.normalize_text(s("a"), ["sort"])
    assert one(spark, text.same_normalized(s("A b"), s("ab"), ["remove_whitespace", "to_lowercase"]), text.normalize_unicode(s("é"))) == (True, "é")
    assert [one(spark, text.detect_language(s(x)))[0] for x in ("中文ab", "中abc", "12")] == ["zh", "en", "unknown"]
    assert [one(spark, text.url_extension(s(x)))[0] for x in ("http://a.b/c/d.png?x=1.gif", "http://a.b/c", "/x/y.tar.gz")] == [".png", ".jpg", ".gz"]
    assert one(spark, text.base_name(s("/a/b.c.d")), text.stem(s("/a/b.c.d")), text.suffix(s("/a/B.PNG"))) == ("b.c.d", "b.c", ".png")
    assert one(spark, text.display_name(s("HIT"), text.LABEL_NAMES), text.display_name(s("odd"), text.LABEL_NAMES), text.short_id(s("abcdefghij")), text.short_time(s("2024-01-02T03:04:05")), text.thousands(s(12345))) == ("hit", "odd", "abcdefgh", "2024-01-02 03:04", "12,345")
    assert one(spark, text.sort_options(s("b; a;c")), text.normalize_latex(s(r"\dfrac{1}{2}\, x"))) == ("a;b;c", r"\frac{1}{2}x")


def test_similarity_bound_changes_nothing(spark):
    words = ["", "a", "abc", "abd", "xbcd", "kitten", "sitting", "é漢字", "abcabcabc"]
    rows = spark.createDataFrame([(a, b, t) for a in words for b in words for t in (0.0, 0.3, 0.5, 0.9, 1.0)], "a string, b string, t double")
    for r in rows.select("t", text.text_similarity(F.col("a"), F.col("b")).alias("full"), text.similarity_at_least(F.col("a"), F.col("b"), F.col("t")).alias("bounded")).collect():
        assert r.bounded is None and r.full < r.t or r.bounded is not None and math.isclose(r.bounded, r.full)


def test_bits(spark):
    pairs = [("ff", "fe", 1), ("ff", "FF", 0), ("abc", "ab", 3), ("zz", "zy", 1), ("0" * 64, "f" * 64, 256), ("123456789", "023456789", 1)]
    for a, b, want in pairs:
        assert one(spark, bits.hamming_distance(F.lit(a), F.lit(b)))[0] == want
    got = one(spark, bits.exact_confidence(F.lit(8)), bits.exact_confidence(F.lit(300)), bits.normalize(F.array(F.lit(3.0), F.lit(4.0))), bits.normalize(F.array(F.lit(0.0))))
    assert got == (0.96875, 0.0, [0.6, 0.8], [0.0])


def test_scores(spark):
    assert [one(spark, scores.confidence_level(F.lit(x)))[0] for x in (0.95, 0.8, 0.79, 0.5, 0.49)] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [one(spark, scores.query_status(F.lit(a), F.lit(b)))[0] for a, b in ((0, 0), (2, 0), (2, 1), (2, 2))] == ["no_candidates", "unlabeled", "partial", "completed"]
    assert [one(spark, scores.progress_percent(F.lit(p), F.lit(t)))[0] for p, t in ((5, 10), (5, 20), (5, 0), (30, 20))] == [50.0, 25.0, 0.0, 100.0]
    assert [config.clamp_workers(v, 4, 2) for v in (0, -5, 99, 3, None, "abc", 2.9)] == [1, 1, 4, 3, 2, 2, 2]
    assert [one(spark, scores.clamp(F.lit(v).cast("string"), 1, 4, 2))[0] for v in ("0", "-5", "99", "3", None, "abc", "2.9")] == [1, 1, 4, 3, 2, 2, 2]
    now = F.lit("2024-01-01 00:02:00").cast("timestamp")
    assert [one(spark, scores.fresh(F.lit(t).cast("timestamp"), now))[0] for t in ("2024-01-01 00:01:00", "2024-01-01 00:00:30", None)] == [True, False, False]
    assert one(spark, scores.parse_time(F.lit("2024-01-01T01:00:00Z")), scores.parse_time(F.lit("nope")))[1] is None
    assert one(spark, scores.payload_paths(F.lit("batch_search"), F.lit('["/a",null,"/b"]')), scores.payload_paths(F.lit("interactive_search"), F.lit('{"query_image_path":"/c"}')), scores.payload_paths(F.lit("index_build"), F.lit('["/a"]'))) == (["/a", "/b"], ["/c"], [])
    moves = [one(spark, scores.grid_move(F.lit(i), F.lit(d), 3, 8))[0] for i, d in ((0, "left"), (2, "right"), (4, "right"), (5, "down"), (4, "down"), (1, "up"), (7, "right"), (3, "up"))]
    assert moves == [0, 2, 5, 5, 7, 1, 7, 0]
    assert round(one(spark, scores.contrast(F.lit("#ffffff"), F.lit("#000000")))[0], 2) == 21.0
    assert one(spark, scores.eta_text(F.lit(10), F.lit(100), F.lit(60.0)), scores.eta_text(F.lit(0), F.lit(100), F.lit(60.0)), scores.eta_text(F.lit(99), F.lit(100), F.lit(60.0))) == ("剩 9 分", "—", "即将完成")


def test_config():
    assert config.preset("balanced")["matching"]["exact_match"]["hash_max_distance"] == 5 and config.list_presets() == ["conservative", "balanced", "aggressive"]
    merged = config.deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2], "e": None}})
    assert merged == {"a": {"b": 1, "c": [2], "e": None}, "d": 1} and config.nested_get(merged, "a.e", 7) == 7
    assert config.validate({"index": {"type": "IVFFlat", "nlist": 10, "nprobe": 20}}) == ["index.nprobe: at most nlist"]
    assert config.validate({"features": {"perceptual_hash": {"hash_size": 64}}, "matching": {"content_match": {"final_threshold": 2}}}) and not config.validate(config.preset("aggressive"))
    specs = {s.path: s for s in config.param_specs({"index": {"type": "IVFFlat", "nlist": 256, "nprobe": 16}, "features": {"perceptual_hash": {"hash_size": 8}}})}
    assert specs["matching.exact_match.hash_max_distance"].most == 64 and specs["index.nprobe"].most == 256
    assert not any("exact" in s.path or "index" in s.path for s in config.param_specs({"index": {"type": "Flat"}}))
    assert config.search_config({"a.b": 1, "a.c": None}) == {"a": {"b": 1}} and config.resolve("x", {"x": ""}, {"x": 2}) == 2
    assert config.load_yaml("a: [") == {} and config.load_yaml("a: 1") == {"a": 1}
    assert config.config_key({"a": 1, "b": 2}) == config.config_key({"b": 2, "a": 1})
    assert config.clamp_top_n(99) == 20
    with pytest.raises(ValueError):
        config.require_top_n(0)
    assert [config.validate_database_name(n) for n in ("题库_1-a", "a" * 100)]
    for bad in ("", "a" * 101, "a b", "a/b"):
        with pytest.raises(ValueError):
            config.validate_database_name(bad)


def vector_frames(spark):
    import random

    rng = random.Random(2)
    rows = [(i, i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(400, 400, [0.0] * 8), (401, 401, None)]
    corpus = spark.createDataFrame(rows, "image_id long, ord long, vector array<float>")
    queries = corpus.where("image_id % 100 = 0").selectExpr("image_id query_id", "vector").unionByName(spark.createDataFrame([(999, [1.0])], "query_id long, vector array<float>"))
    return corpus, queries


def test_vector_search(spark):
    corpus, queries = vector_frames(spark)
    key = lambda df: sorted((r.query_id, r.image_id, r.vector_rank, round(r.similarity, 6)) for r in df.collect() if r.query_id != 400)
    plain = key(vectors.search_plain(corpus.where("vector is not null"), vectors.fit_dimension(queries, 8), 7))
    assert key(vectors.search(corpus, queries, 7)) == plain
    good = corpus.where("vector is not null")
    centres = vectors.train_cells(good, 50)
    assert len(centres) == vectors.shrink_lists(401, 50) == 10
    cells = vectors.assign_cells(good, centres)
    asked = vectors.fit_dimension(queries, 8)
    assert key(vectors.search_cells(cells, centres, asked, 7, 10)) == plain
    probe = vectors.calibrate_probe(cells, centres, 7)
    part = {x[:2] for x in key(vectors.search_cells(cells, centres, asked, 7, probe))}
    assert 1 <= probe <= 10 and len(part & {x[:2] for x in plain}) >= 0.9 * len(plain)
    books = vectors.train_codebooks(good, 4, 6)
    coded = {x[:2] for x in key(vectors.search_codes(vectors.encode(good, books), books, asked, 7, corpus=good))}
    assert len(coded & {x[:2] for x in plain}) >= 0.9 * len(plain)
    assert vectors.search_codes(vectors.encode(good, books), books, asked, 7).count() == 7 * asked.count()
    planes = {x[:2] for x in key(vectors.search_planes(corpus, asked, 7))}
    assert len(planes & {x[:2] for x in plain}) >= 0.9 * len(plain)
    assert vectors.search_planes(corpus.limit(0), queries, 5).count() == 0
    assert vectors.search(corpus.limit(0), queries, 5).count() == 0
    assert vectors.search(corpus, queries, 50, 0.5).where("similarity < 0.5").count() == 0
    with pytest.raises(ValueError):
        vectors.choose_search("Tree", corpus)


def test_radius_joins_agree(spark, monkeypatch):
    import random

    rng = random.Random(4)
    hashes = ["".join(rng.choice("01") for _ in range(16)) for _ in range(120)] + ["".join(rng.choice("0123456789abcdefABCDEF") for _ in range(n)) for n in (1, 2, 3, 4, 16, 16, 17) * 6] + ["zz", "zy", "ab", "abc", "x" * 16, "g" + "0" * 15, "", None, "FF" * 8]
    corpus = spark.createDataFrame([(i, i, h) for i, h in enumerate(hashes)], "image_id long, ord long, hash string")
    queries = corpus.selectExpr("image_id query_id", "hash")
    for d in (0, 1, 2, 5, 13, 20, 63, 64):
        a = sorted(map(tuple, fingerprints.radius_join_nested(corpus, queries, d).collect()))
        banded = fingerprints.radius_join_banded(corpus, queries, d)
        assert a == sorted(map(tuple, banded.collect())) and len(a) >= 160
    assert "NestedLoop" not in banded._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in banded._jdf.queryExecution().executedPlan().toString()
    bands = fingerprints._bands(F.col("hash"), F.col("hash"), 6, "chars")
    assert not corpus.where("length(hash) >= 6").select(F.explode(bands).alias("b")).where("b.value = ''").count()
    monkeypatch.setattr(fingerprints, "BLOCK", 30)
    assert sorted(map(tuple, fingerprints.radius_join_nested(corpus, queries, 64).collect())) == a
    top = fingerprints.exact_matches(corpus, queries, 5, 3).collect()
    assert max(r.channel_rank for r in top) == 3
    stats = fingerprints.index_stats(spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "a"), (4, 4, "b")], "image_id long, ord long, hash string")).first()
    assert tuple(stats) == (2, 4, 2, 1, 2.0)


def test_radius_join_by_multi_index_hashing(spark, monkeypatch):
    import random

    from marlinspike.functions import joins

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(150)]
    hashes = [f"{rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12))):016x}" for _ in range(500)] + [f"{rng.getrandbits(256):064x}" for _ in range(3)] * 2
    hashes += ["0" * 16] * 60 + ["zz", "zy", "ab", "AB", "abc", "", None]
    corpus = spark.createDataFrame([(i, i, h) for i, h in enumerate(hashes)], "image_id long, ord long, hash string")
    queries = corpus.where("image_id % 2 = 0").selectExpr("image_id query_id", "hash")
    monkeypatch.setattr(joins, "TOGETHER", 7)
    monkeypatch.setattr(joins.hot_keys, "__defaults__", (7,))
    for d, bands in ((0, 1), (2, None), (5, 3), (8, 3), (8, 5), (12, 4)):
        want = sorted(map(tuple, fingerprints.radius_join_nested(corpus, queries, d).collect()))
        found = fingerprints.radius_join_indexed(corpus, queries, d, bands)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 300
        if bands:
            assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(fingerprints.plan_bands(16, d, 200_000, 400_000) for d in (5, 8)) and fingerprints.plan_bands(16, 64, 1000, 1000) is None


def clustered(spark, n, dimension=16, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = 0.35 * rng.standard_normal((n, dimension)) + rng.standard_normal((n // 100, dimension))[rng.integers(0, n // 100, n)]
    return spark.createDataFrame([(i, i, v) for i, v in enumerate(x.tolist())], "image_id long, ord long, vector array<float>").repartition(6).persist()


def test_top_k_rows_do_not_depend_on_batches(spark):
    corpus = clustered(spark, 6000)
    queries = corpus.where("image_id % 500 = 0").selectExpr("image_id query_id", "vector")
    want, before = None, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "50"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = vectors.candidates(corpus, queries, 20)
        assert found.count() == 20 * queries.count() * corpus.rdd.getNumPartitions()
        got = sorted((r.query_id, r.vector_rank, r.image_id) for r in vectors.search(corpus, queries, 20).collect())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    corpus.unpersist()


def test_best_rows_of_blocks():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    scores = rng.integers(0, 9, (5, 700)) / 8
    places = rng.permutation(700)
    best = vectors.Best(5, 6)
    best.most = 40
    for lo in range(0, 700, 90):
        best.add(scores[:, lo : lo + 90], pa.array([f"i{i}" for i in range(lo, min(lo + 90, 700))]), places[lo : lo + 90])
    got = list(zip(*[c.to_pylist() for c in best.batch(pa.array(list("abcde"))).columns], strict=True))
    want = [("abcde"[q], f"i{i}", int(places[i]), float(scores[q, i])) for q in range(5) for i in sorted(range(700), key=lambda i: (-scores[q, i], places[i]))[:6]]
    assert got == want


@pytest.mark.parametrize("kind", ["IVFFlat", "IVFPQ", "HNSW"])
def test_approximate_search_visits_little_and_keeps_its_recall(spark, kind):
    corpus = clustered(spark, 10_000)
    queries = corpus.where("image_id % 100 = 0").selectExpr("image_id query_id", "vector")
    run = vectors.choose_search(kind, corpus, lists=100, parts=8, k=10)
    if kind == "HNSW":
        planes, probe = vectors.calibrate_planes(corpus, 16, 10)
        assert 16 * probe / 2**planes < 0.2  # of the index, tables counted apart
    else:
        assert run.probe <= run.lists // 5
    assert vectors.recall(run(queries, 10), vectors.search(corpus, queries, 10)) >= 0.9
    corpus.unpersist()


def test_lists_trained_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(vectors, "COARSE", 4)
    corpus = clustered(spark, 4000)
    queries = corpus.where("image_id % 400 = 0").selectExpr("image_id query_id", "vector")
    centres = vectors.train_cells(corpus, 64)
    assert 56 <= len(centres) <= 72
    cells = vectors.assign_cells(corpus, centres)
    exact = sorted((r.query_id, r.vector_rank, r.image_id) for r in vectors.search(corpus, queries, 5).collect())
    assert sorted((r.query_id, r.vector_rank, r.image_id) for r in vectors.search_cells(cells, centres, queries, 5, len(centres)).collect()) == exact
    assert vectors.calibrate_probe(cells.persist(), centres, 5) < len(centres) // 3


def test_matching_paths(spark):
    corpus = spark.createDataFrame([("c", 0, "00", [1.0, 0.5], "same question"), ("d", 1, "01", [0.0, 1.0], ""), ("e", 2, "ff", [1.0, 0.0], "same questiom")], "image_id string, ord long, hash string, vector array<float>, full_text string")
    queries = spark.createDataFrame([(f"q{i}", "00", [1.0, float(i)], "same question") for i in range(3)], "query_id string, hash string, vector array<float>, full_text string")
    conf = config.deep_merge(config.preset("balanced"), {"matching": {"content_match": {"stage1": {"threshold": 0.5, "top_k": 20}, "final_threshold": 0.0}, "output": {"top_k": 5}}})
    rows = matching.match(corpus, queries, conf).collect()
    kinds = {(r.query_id, r.image_id): r.match_type for r in rows}
    assert kinds["q0", "c"] == "exact" and kinds["q0", "d"] == "exact" and kinds["q0", "e"] == "content"
    assert all(r.total_matches == 3 for r in rows if r.query_id == "q0")
    conf["matching"]["exact_match"]["enabled"] = False
    assert {r.match_type for r in matching.match(corpus, queries, conf).collect()} == {"content"}
    conf["matching"]["content_match"]["enabled"] = False
    assert matching.match(corpus, queries, conf).count() == 0
    formatted = matching.format_results(spark.createDataFrame([("q", "x", "exact", 1, 0.98, 0.98, 3, None, None), ("q", "y", "content", 2, 0.62, None, None, 0.7, 0.4)], "query_id string, image_id string, match_type string, rank int, similarity double, confidence double, distance int, vector_similarity double, text_similarity double")).collect()
    assert [(r.confidence_level, r.hash_distance, r.visual_score, r.text_score) for r in sorted(formatted, key=lambda r: r.image_path)] == [("HIGH", 3, None, None), ("MEDIUM", None, 0.7, 0.4)]


def test_edit_distance(spark):
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(prev[j] + (x != y), prev[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(3)
    pairs = [("".join(rng.choice("ab漢😀") for _ in range(rng.randrange(90))), "".join(rng.choice("abc漢") for _ in range(rng.randrange(90)))) for _ in range(300)]
    pairs += [("", ""), ("", "abc"), ("kitten", "sitting"), ("abc", "abc"), ("a" * 200, "a" * 100 + "b" + "a" * 99)]
    assert all(text.edit_distance_of(a, b) == plain(a, b) for a, b in pairs)
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select(text.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in rows] == [*[plain(a, b) for a, b in pairs], None]


def test_verification_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = {i: say(rng.randrange(60)) for i in range(40)} | {i: None for i in (40, 41)} | {42: ""}
    asked = {f"q{i}": say(rng.randrange(60)) for i in range(6)}
    recalled = [(q, i, i, round(rng.random(), 3), rank) for q in asked for rank, i in enumerate(rng.sample(sorted(texts), 25), 1)]
    frames = spark.createDataFrame(recalled, "query_id string, image_id long, ord long, similarity double, vector_rank int"), spark.createDataFrame(list(asked.items()), "query_id string, full_text string"), spark.createDataFrame(list(texts.items()), "image_id long, full_text string")
    for threshold, top in ((0.0, 3), (0.4, 5), (0.9, 2)):
        want = {}
        for q, i, _, v, rank in recalled:
            if asked[q] and texts[i]:
                score = 0.75 * v + 0.25 * (1 - text.edit_distance_of(asked[q], texts[i]) / max(len(asked[q]), len(texts[i])))
                if score >= threshold:
                    want.setdefault(q, []).append((-score, rank, i))
        got = {(r.query_id, r.channel_rank): r.image_id for r in matching.verify_content(*frames, threshold, top).collect()}
        assert got == {(q, n): i for q, rows in want.items() for n, (_, _, i) in enumerate(sorted(rows)[:top], 1)}


def test_budget_and_grid(spark):
    assert config.index_section("index: {type: Flat}") == {"type": "Flat"} and config.index_section("a: [") == config.index_section(None) == config.index_section("index: 3") == {}
    assert one(spark, scores.grid_targets(F.lit(5), 3, F.lit(8)), scores.grid_targets(F.lit(0), 3, F.lit(1))) == ((4, 5, 2, 5), (0, 0, 0, 0))
    with pytest.raises(ValueError):
        scores.grid_targets(F.lit(0), 0, F.lit(3))
    assert one(spark, scores.batch_time(F.lit(10.0), F.lit(4)), scores.batch_time(F.lit(10.0), F.lit(0)), scores.position_text(F.lit(0)), scores.position_text(F.lit(3))) == (2.5, None, "next", "3 ahead")


def store_frames(spark):
    names = ["q_unlabeled", "q_partial", "q_nohit", "q_nocands", "q_done_hit", "q_history"]
    q = [(n, f"/{n}.png", "db1", 10, None, None, "unlabeled", datetime(2026, 1, i + 1), None, None) for i, n in enumerate(names)]
    c = [("q_unlabeled", "/a1", None, 1, True), ("q_unlabeled", "/a2", None, 2, True), ("q_partial", "/b1", "miss", 1, True), ("q_partial", "/b2", None, 2, True), ("q_nohit", "/c1", "miss", 1, True), ("q_nohit", "/c2", "skip", 2, True), ("q_done_hit", "/d1", "hit", 1, True), ("q_history", "/e1", "hit", 1, True), ("q_history", "/e_old", None, 9, False)]
    rows = [(p, n, r, p, "content", "HIGH", 0.9, None, None, None, lab, None, None, cur) for n, p, lab, r, cur in c]
    return spark.createDataFrame(q, store.QUERIES), spark.createDataFrame(rows, store.CANDIDATES)


def test_progress_groups(spark):
    q, c = store_frames(spark)
    counts = store.progress(q, c)
    got = {k: {r.query_id for r in store.progress_filter(counts, k).collect()} for k in store.PROGRESS}
    assert got == {"unlabeled": {"q_unlabeled"}, "partial": {"q_partial"}, "no_hit": {"q_nohit"}, "no_candidates": {"q_nocands"}}
    assert store.progress_filter(counts, None).count() == 6
    with pytest.raises(ValueError):
        store.progress_filter(counts, "other")
    history = counts.where("query_id = 'q_history'").first()
    assert (history.total, history.labeled) == (1, 1)
    assert store.query_results(c, True).where("query_id = 'q_history'").collect()[-1].candidate_image_path == "/e_old"
    summary = store.stats_summary(q, c).first()
    assert (summary.total_queries, summary.total_candidates, summary.labeled_candidates, summary.hit_count, summary.hit_rate) == (6, 9, 5, 2, 0.4)
    empty = store.stats_summary(q.limit(0), c.limit(0)).first()
    assert (empty.total_queries, empty.hit_rate) == (0, 0.0)
    assert store.next_unlabeled(q, "q_partial").first().query_id == "q_nohit" and store.next_unlabeled(q, "nobody").count() == 0
    left, cands = store.delete_queries(q, c, q.where("query_id = 'q_partial'"))
    assert (left.count(), cands.count()) == (5, 7)


def search(spark, state, paths, top_n=10, when="2026-02-01"):
    q, c = state
    schema = "query_image_path string, database_name string, top_n int, config_preset string, config_yaml string, processing_time_ms double"
    q = store.upsert_queries(q, spark.createDataFrame([("/img/query.png", "db1", top_n, None, None, 1.0)], schema), F.lit(when).cast("timestamp"))
    query_id = q.first().query_id
    found = [(query_id, i + 1, p, "content", "HIGH", 0.9 - 0.1 * i, None, None, None) for i, p in enumerate(paths)]
    fields = "query_id string, rank int, candidate_image_path string, match_type string, confidence_level string, overall_score double, text_score double, visual_score double, hash_distance int"
    c = store.upsert_candidates(c, spark.createDataFrame(found, fields), q.select("query_id"))
    return spark.createDataFrame(q.collect(), store.QUERIES), spark.createDataFrame(c.collect(), store.CANDIDATES)


def label(spark, state, path, value):
    q, c = state
    row = c.where(F.col("candidate_image_path") == path).first()
    event = spark.createDataFrame([(row.query_id, row.candidate_id, value, "note", datetime(2026, 3, 1), 0)], "query_id string, candidate_id string, label string, notes string, labeled_at timestamp, ord long")
    c = spark.createDataFrame(store.apply_labels(c, event).collect(), store.CANDIDATES)
    return spark.createDataFrame(store.refresh_status(q, c, event).collect(), store.QUERIES), c


def by_path(state):
    return {r.candidate_image_path: r for r in state[1].collect()}


def test_upsert_sequences(spark):
    empty = spark.createDataFrame([], store.QUERIES), spark.createDataFrame([], store.CANDIDATES)
    s = search(spark, empty, ["c1"])
    first = s[0].first()
    s = search(spark, s, ["c1"], top_n=20, when="2026-02-02")
    assert s[0].count() == 1 and s[0].first().top_n == 20 and (s[0].first().query_id, s[0].first().created_at) == (first.query_id, first.created_at)
    s = label(spark, search(spark, empty, ["c1", "c2"]), "c1", "hit")
    s = search(spark, s, ["c2", "c1"])
    row = by_path(s)["c1"]
    assert (row.label, row.notes, row.rank) == ("hit", "note", 2) and s[0].first().status == "unlabeled"
    again = search(spark, s, ["c2", "c1"])
    assert sorted(map(str, again[1].collect())) == sorted(map(str, s[1].collect()))
    s = label(spark, search(spark, empty, ["c1", "c2"]), "c2", "miss")
    s = search(spark, s, ["c1"])
    assert by_path(s)["c2"].in_current_result is False and by_path(s)["c2"].label == "miss"
    s = search(spark, s, ["c1", "c2"])
    assert by_path(s)["c2"].in_current_result and by_path(s)["c2"].label == "miss"
    s = search(spark, label(spark, search(spark, empty, ["c1"]), "c1", "hit"), ["c1", "new"])
    assert by_path(s)["new"].label is None
    s = label(spark, search(spark, empty, ["keep", "drops"]), "keep", "hit")
    s = label(spark, search(spark, s, ["keep"]), "keep", "hit")
    assert s[0].first().status == "completed"
    s = label(spark, label(spark, search(spark, empty, ["c1", "c2"]), "c1", "hit"), "c2", "miss")
    assert s[0].first().status == "completed"
    s = label(spark, search(spark, s, ["c1", "c3"]), "c3", "miss")
    assert s[0].first().status == "completed" and s[1].where("label is not null and not in_current_result").count() == 1
    s = search(spark, s, [])
    assert s[1].where("in_current_result").count() == 0
    with pytest.raises(Exception, match="unknown label"):
        label(spark, s, "c1", "bogus")


def task_rows(spark, rows):
    base = {f.split()[0]: None for f in tasks.TASKS.split(", ")} | {"lane": "background", "status": "pending", "cancel_requested": False, "progress_percentage": 0.0, "kind": "batch_search"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], tasks.TASKS)


def test_queue(spark):
    t = task_rows(spark, [{"task_id": f"t{i}", "created_at": datetime(2026, 1, 1, i)} | r for i, r in enumerate([{}, {"status": "running", "total_items": 10, "scheduler_pid": 5, "last_processed_index": 39, "heartbeat_at": datetime(2026, 1, 1)}, {"lane": "interactive"}, {"status": "completed", "lane": "interactive", "completed_at": datetime(2026, 1, 1)}, {"cancel_requested": True}])])
    now = F.lit("2026-01-03").cast("timestamp")
    assert [r.task_id for r in tasks.list_tasks(t).collect()] == ["t1", "t4", "t2", "t0", "t3"]
    assert {r.status: r.n for r in tasks.counts_by_status(t).collect()} == {"pending": 3, "running": 1, "completed": 1, "failed": 0, "cancelled": 0}
    assert {r.task_id: r.position for r in tasks.queue_positions(t).collect()} == {"t0": 0, "t2": 1, "t4": 2}
    assert tasks.next_task(t, "background").first().task_id == "t0" and tasks.next_task(t, "interactive").first().task_id == "t2"
    schema = "task_id string, processed int, total int, failed int, last_index int, stage string"
    step = lambda p, total: tasks.update_progress(t, spark.createDataFrame([("t1", p, total, None, None, None)], schema)).where("task_id = 't1'").first().progress_percentage
    assert [step(5, None), step(5, 20), step(5, 0)] == [50.0, 25.0, 0.0]
    done = tasks.finish(t, spark.createDataFrame([("t1", "completed", None), ("t0", "failed", "x")], "task_id string, outcome string, stage string"), now)
    assert {r.task_id: r.progress_percentage for r in done.collect() if r.task_id in ("t0", "t1")} == {"t0": 0.0, "t1": 100.0}
    cancelled = {r.task_id: (r.status, r.cancel_requested) for r in tasks.request_cancel(t, t.select("task_id"), now).collect()}
    assert cancelled["t0"] == ("cancelled", True) and cancelled["t1"] == ("running", True) and cancelled["t3"] == ("completed", False)
    pids, nobody, soon = spark.createDataFrame([(5,)], "pid long"), spark.createDataFrame([], "pid long"), F.lit("2026-01-01 00:01:00").cast("timestamp")
    after = lambda *args: tasks.recover_orphans(t, *args).where("task_id = 't1'").first()
    back = after(nobody, now)
    assert (back.status, back.scheduler_pid, back.last_processed_index, back.stage) == ("pending", None, 39, tasks.REQUEUED)
    # a known scheduler is left alone, stale heartbeat or not; another process with its number only with a fresh one
    assert after(pids, now).status == "running" and after(nobody, now, pids).status == "pending" and after(nobody, soon, pids).status == "running"
    assert after(nobody, soon).status == "pending" and after(nobody, now, None, spark.createDataFrame([("t1",)], "task_id string")).status == "running"
    assert tasks.purge_interactive(t, now).count() == 4 and tasks.clear_terminal(t)[1].count() == 1
    with pytest.raises(ValueError):
        tasks.enqueue_row("x", "other")
    events = spark.createDataFrame([("a", 0, "enqueue", None), ("a", 1, "claim", None), ("a", 2, "cancel", None), ("b", 0, "enqueue", None), ("b", 1, "cancel", None), ("b", 2, "claim", None), ("c", 0, "enqueue", None), ("c", 1, "claim", None), ("c", 2, "finish", "failed"), ("d", 0, "enqueue", None)], "task_id string, ord long, event string, outcome string")
    events = events.selectExpr("*", "'k' kind", "'db' database_name", "10 total_items", "int(ord) processed_items", "string(null) stage", "timestamp_seconds(ord) ts")
    assert {r.task_id: (r.status, r.cancel_requested) for r in tasks.replay(events).collect()} == {"a": ("running", True), "b": ("cancelled", True), "c": ("failed", False), "d": ("pending", False)}


def test_annotation_tasks(spark):
    t = spark.createDataFrame([("t1", "n", "batch_search", '["/a","/a","/b"]', datetime(2026, 1, 1)), ("t2", "n", "interactive_search", '{"query_image_path":"/b"}', datetime(2026, 1, 2)), ("t3", "n", "batch_search", None, datetime(2026, 1, 3)), ("t4", "n", "index_build", '["/a"]', datetime(2026, 1, 4))], "task_id string, task_name string, kind string, payload string, created_at timestamp")
    p = spark.createDataFrame([("qa", "/a", 2, 2, 0), ("qb", "/b", 2, 1, 1), ("qz", "/z", 0, 0, 2)], "query_id string, query_image_path string, total int, labeled int, ord long")
    got = {r.task_id: (r.query_count, r.completed_count, r.annotatable) for r in tasks.annotation_tasks(t, p).collect()}
    assert got == {"t1": (2, 1, True), "t2": (1, 0, True), "t3": (0, 0, False), tasks.UNASSIGNED: (1, 0, True)}
    assert {r.query_id: r.task_id for r in tasks.task_of_query(t, p).collect()} == {"qa": "t1", "qb": "t2", "qz": tasks.UNASSIGNED}
    assert tasks.choose_query(p, "qb").first()[0] == "qb" and tasks.choose_query(p, "none").first()[0] == "qb" and tasks.choose_query(p.where("query_id = 'qa'"), None).first()[0] == "qa"
    with pytest.raises(RuntimeError):
        tasks.align(p, p.limit(1))


def test_blocks_of_hashes_against_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)]
    hashes = [f"{rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))):016x}" for _ in range(90)] + ["0" * 16] * 9 + [f"{rng.getrandbits(20):05x}" for _ in range(9)] + ["zz", "FF", "ff"]
    corpus = spark.createDataFrame([(i, i, h) for i, h in enumerate(hashes)], "image_id long, ord long, hash string")
    queries = corpus.where("image_id % 3 = 0").selectExpr("image_id query_id", "hash")

    def far(a, b):
        if len(a) != len(b):
            return max(len(a), len(b))
        return sum(x != y for x, y in zip(a, b, strict=True)) if "z" in a + b else bin(int(a, 16) ^ int(b, 16)).count("1")

    pairs = sorted((q, c, c, far(hashes[q], hashes[c])) for q in range(0, len(hashes), 3) for c in range(len(hashes)))
    want = [p for p in pairs if p[3] <= 20]
    monkeypatch.setattr(fingerprints, "BLOCK", 16)
    monkeypatch.setattr(fingerprints, "STEP", 32)
    for join in (fingerprints.radius_join_nested, fingerprints.radius_join_banded):
        found = join(corpus, queries, 20)
        assert sorted(map(tuple, found.collect())) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    first = {h: hashes.index(h) for h in hashes}
    top = {}
    for q, c, _, d in sorted(want, key=lambda p: (p[0], p[3], first[hashes[p[1]]], p[1])):
        top.setdefault(q, []).append((q, c, d))
    got = sorted((r.query_id, r.channel_rank, r.image_id, r.distance) for r in fingerprints.exact_matches(corpus, queries, 20, 4).collect())
    assert got == sorted((q, i + 1, c, d) for q, rows in top.items() for i, (_, c, d) in enumerate(rows[:4]))


def test_difference_hash_names_the_vector_only(spark):
    expression = spark.createDataFrame([([1.0, 2.0, 1.0, 3.0, 3.0, 4.0],)], "v array<float>").select(bits.difference_hash(F.col("v")).alias("h"))
    assert expression.first().h == "a2"
    # one walk over the digits, in which no array of bits is made again for each
    assert expression._jdf.queryExecution().analyzed().toString().count("transform(") == 1


def test_tables_and_best_rows_of_a_block_of_queries_are_bounded(spark, monkeypatch):
    corpus, queries = vector_frames(spark)
    good, asked = corpus.where("vector is not null"), corpus.where("image_id < 40").selectExpr("image_id query_id", "vector")
    books, made, plain = vectors.train_codebooks(good, 4, 4), [], vectors._code_top
    coded = vectors.encode(good, books)
    key = lambda df: sorted((r.query_id, r.image_id, r.vector_rank) for r in df.collect())
    want = key(vectors.search_codes(coded, books, asked, 3, corpus=good))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100_000)
    monkeypatch.setattr(vectors, "_code_top", lambda ids, tables, k: made.append(sum(t.nbytes for t in tables) + len(ids) * k * 32 * 8) or plain(ids, tables, k))
    assert key(vectors.search_codes(coded, books, asked, 3, corpus=good)) == want
    assert len(made) > 1 and max(made) <= 1.1 * vectors.QUERY_BLOCK


def test_query_stats_work_out_the_matches_once(spark):
    results = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.7), (9, 1, 0.2)], "query_id long, rank int, similarity double").withColumn("similarity", F.expr("similarity + 0 * length(uuid())"))
    asked = spark.createDataFrame([(1, 10.0), (2, None), (3, 20.0)], "query_id long, processing_time_ms double")
    found = matching.query_stats(results, asked, 5)
    assert tuple(found.first()) == (3, 2, "66.67%", 15.0, 5, 0.6, 0.5, 0.0)
    assert found._jdf.queryExecution().analyzed().toString().count("uuid(") == 1
    assert tuple(matching.query_stats(results.limit(0), asked.limit(0), 5).first()) == (0, 0, "0%", 0.0, 5, 0.0, 0.0, 0.0)
