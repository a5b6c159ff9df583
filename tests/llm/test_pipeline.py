from __future__ import annotations

from collections import Counter

import corpus_pipeline
from emulsion.llm import mixing
from emulsion.llm.common import settle, table
from tokenizers import Tokenizer

from . import corpus
from .test_near_dedup import brute
from .test_secret_scan import base_spans


def test_stages_in_turn(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language_id", "minhash_dedup", "secret_redaction", "source_mix", "bpe"]
    start = {r["doc_id"]: r for r in docs.collect()}

    told = settle(named["language_id"](spark, docs, sf), "t")
    rows = {r["doc_id"]: r for r in told.collect()}
    assert told.columns == columns and all(rows[i]["text"] == start[i]["text"] for i in rows)
    assert {i for i, r in start.items() if (r["text"] or "").split()} == set(rows)
    assert sum(rows[i]["lang"] == start[i]["lang"] for i in rows) >= 0.98 * len(rows)

    single = settle(named["minhash_dedup"](spark, told, sf), "t")
    want = {c for _, _, c in brute([(i, r["text"]) for i, r in rows.items()], 5, 80)}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == want and single.count() == len(want)

    clean = settle(named["secret_redaction"](spark, single, sf), "t")
    after = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and set(after) == want
    for i in want:
        had = base_spans(rows[i]["text"])
        assert not base_spans(after[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"])
        if not had and after[i]["text"] != rows[i]["text"]:
            assert "<SECRET>" in after[i]["text"]

    mixed = settle(named["source_mix"](spark, clean, sf), "t")
    assert mixed.columns == columns
    words = lambda t: len(t.split())
    size: Counter = Counter()
    for r in after.values():
        size[r["source"]] += words(r["text"])
    target, got = mixing.allocate(list(size.items())), Counter()
    for r in mixed.collect():
        got[r["source"]] += words(r["text"])
        assert after[r["doc_id"]]["text"].startswith(r["text"].strip()) or r["text"] in after[r["doc_id"]]["text"]
    assert all(abs(got[s] - target[s]) < 1 for s in size)

    coder = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    out = named["bpe"](spark, mixed, sf).collect()
    want = Counter((r["doc_id"], tuple(coder.encode(r["text"], add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want


def test_run_and_edge_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = corpus.documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "t")
    assert docs.count() > 0
    docs = corpus.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "t")
    assert docs.count() == 0
