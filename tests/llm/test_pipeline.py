"""The corpus pipeline, each stage against brute force on its own input."""

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from marlinspike.llm import pii, quality_classifier


def test_stages(spark, data, tmp_path):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == documents.columns
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in seen.items()}
    model = quality_classifier.fit_quality(documents, spark.read.parquet(f"{data}/labels.parquet"))
    scored, score = quality_classifier.score_quality(documents, model)
    assert rows["ngram_jaccard"].keys() == {r.doc_id for r in scored.collect() if r[score] >= 0.3}
    assert 0 < len(rows["ngram_jaccard"]) < documents.count()
    groups = brute.jaccard([(i, r.text) for i, r in rows["ngram_jaccard"].items()])
    assert rows["decontamination"].keys() == {c for _, c in groups.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hit = brute.leaks([(i, r.text) for i, r in rows["decontamination"].items()], items)
    assert rows["pii"].keys() == {i for i, v in hit.items() if not v[1]}
    assert rows["packing"].keys() == rows["pii"].keys()
    kinds = [f"<{k.upper()}>" for k in pii.KINDS]
    for i, r in rows["packing"].items():
        assert not brute.pii(r.text)
        if r.text == rows["pii"][i].text:
            assert not brute.pii(r.text)
        else:
            assert any(k in r.text for k in kinds)
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: encoder.encode(r.text or "", add_special_tokens=False).ids + [1] for i, r in rows["packing"].items()}
    placed = {}
    for r in docs.collect():
        assert r.ids_crc32 == brute.crc_ids(tokens[r.doc_id][r.start : r.start + r.length])
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == {i: len(t) for i, t in tokens.items()}
