"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from usagelens.llm import queries
from usagelens.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, single, cut, clean = kept
    scored = {r.doc_id: r.predicted for r in entry.queries()["op2_quality_classifier"](spark, SF).collect()}
    assert set(good) == {i for i, p in scored.items() if p}
    shingles = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in good.items()}
    alike = [(a, b) for a in good for b in good if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    up = {i: i for i in good}
    for _ in good:
        for a, b in alike:
            up[a] = up[b] = min(up[a], up[b])
    assert set(single) == {i for i in good if up[i] == i}
    seen = {}
    for i, t in single.items():
        raw = t.encode()
        for k in range(len(raw) - corpus_pipeline.PASSAGE + 1):
            seen.setdefault(hash(raw[k : k + corpus_pipeline.PASSAGE]), []).append((i, k))
    for i, t in single.items():
        repeated = any(len(seen[hash(t.encode()[k : k + corpus_pipeline.PASSAGE])]) > 1 for k in range(len(t.encode()) - corpus_pipeline.PASSAGE + 1))
        assert (cut[i] != t) == repeated
    items = [r.text.split() for r in queries.table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[k : k + 14]) for w in items for k in range(max(1, len(w) - 13))}
    for t in clean.values():
        w = t.split()
        assert not any(tuple(w[k : k + 14]) in windows for k in range(len(w)))
    assert set(clean) <= set(cut) and len(clean) > 0.8 * len(cut)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        ids = library.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(clean[r.doc_id].encode()).hexdigest())


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < found.count() == found.select("doc_id").distinct().count()


def test_every_operator_is_registered():
    held = entry.queries()
    assert {n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in held)} == set(range(1, 11))
    assert "pipeline" in held and set(queries.ORACLES) <= set(held)
