from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from emulsion.llm import bpe
from emulsion.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import corpus

HARD = [
    "Hello wörld's 123 ΣΑΣ <|endoftext|> x", "", "İstanbul ﬁ ǅ\x85x \xa0y", "a\x1cb\x00c", "<|startoftext|>hi<|end", "aaaaaaaaaaaaaaaaa hahahaha !!!!!!! ......... " + "ha" * 3000,
    "été नमस्ते 你好世界 👍🏽👨‍👩‍👧 ​ ſſ K Å", "<|endoftext|><|endoftext|>", " \n\t ",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_path())


def test_same_as_the_library(reference, monkeypatch):
    rnd = random.Random(1)
    texts = HARD + ["".join(rnd.choice("abAB é!?'s<|\n\t12ΣñŁﬁ中́") for _ in range(200)) for _ in range(300)]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' limit 200").fetchall()]
    coder = bpe.Coder(tokenizer_path())
    monkeypatch.setattr(bpe, "KEPT_WORDS", 500)
    for group in bpe.groups(texts, 5000):
        for text, ids in zip(group, coder.encode(group), strict=True):
            want = reference.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert coder.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_overlapping_pairs():
    nxt = np.array([1, 2, 3, 4, -1, 6, -1])
    assert bpe._every_other(np.array([0, 1, 2, 3, 5]), nxt).tolist() == [True, False, True, False, True]


def test_documents(spark, reference):
    docs = corpus.documents(spark).withColumn("ids", F.lit(1))
    got = bpe.encode_decode(docs, tokenizer_path(), with_ids=True, with_text=True).collect()
    want = {}
    for i, t, *_ in corpus.rows():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want.setdefault(i, []).append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert len(got) == len(corpus.rows())
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"], r["decoded"]) in want[r["doc_id"]]
    assert bpe.encode_decode(corpus.empty(spark), tokenizer_path()).count() == 0


def test_text_of_ten_megabytes(spark, reference):
    text = "".join(f"word{i % 977} énd, " for i in range(700_000))
    row = bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path()).first()
    want = reference.encode(text, add_special_tokens=False).ids
    assert row["n_tokens"] == len(want) and row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
