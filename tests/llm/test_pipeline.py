"""The corpus pipeline against a plain version of its stages."""

import hashlib

import numpy as np
from test_llm_operators import WORD, components_by_force

import corpus_pipeline
from tidelog.llm import bpe

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    """Documents with each line's first copy, one replaced, inserted or deleted word apart counting as a copy."""
    order = sorted((r["doc_id"], n, tuple(WORD.findall(line))) for r in rows for n, line in enumerate(r["text"].split("\n")) if WORD.search(line))
    firsts = {}
    for i, n, w in order:
        firsts.setdefault(w, (i, n))
    seen, gone = {}, set()
    for w, first in sorted(firsts.items(), key=lambda x: x[1]):
        if len(w) >= 10:
            keys = {("whole", w), *(("cut", k, w[:k] + w[k + 1 :]) for k in range(len(w)))}
            near = keys & seen.keys() or any(("whole", k[2]) in seen for k in keys if k[0] == "cut") or ("any", w) in seen
            if near:
                gone.add(w)
            for k in keys:
                seen[k] = True
                if k[0] == "cut":
                    seen["any", k[2]] = True
    keep = {(i, n) for w, (i, n) in firsts.items() if w not in gone}
    out = {}
    for r in rows:
        text = "\n".join(line for n, line in enumerate(r["text"].split("\n")) if not WORD.search(line) or (r["doc_id"], n) in keep)
        if WORD.search(text):
            out[r["doc_id"]] = text
    return out


def test_stages_and_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.count() == docs.count() and kept.columns == docs.columns
    rows = [r for r in kept.collect()]
    lined = corpus_pipeline.deduplicate_lines(spark, kept, SF)
    assert lined.columns == docs.columns
    want = plain_lines(rows)
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want
    joined = corpus_pipeline.join_near_duplicates(spark, lined, SF)
    parts = components_by_force(want)
    assert {r["doc_id"] for r in joined.collect()} == {i for i, (_, c) in parts.items() if c == i}
    mixed = corpus_pipeline.mix_sources(spark, joined, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in joined.collect()}
    automaton = bpe.load(bpe.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in joined.collect()}
    encoded = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert len(encoded) == mixed.count()
    for r in encoded:
        ids = automaton.encode(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["n_tokens"] == len(np.frombuffer(ids, "<u4"))
