"""Speculate-and-verify BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from wxframe.llm import bpe
from wxframe.llm.queries import BYTE_BPE, op2_bpe


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    return bpe.Model(bpe.load(BYTE_BPE))


def texts():
    rnd = random.Random(5)
    signs = list("abehnorst'  .,!1234\n\t\x1c éßñ日本") + ["<|endoftext|>", "ing", " the", "’s", "🙂", "́"]
    out = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 200))) for _ in range(400)]
    return out + ["", " ", "a" * 20_000, "ab" * 5_000, "<|endoftext|><|endoftext|>", "don't  we'LL\n\n  x "]


def test_ids_equal_the_library(model, truth):
    t = texts()
    ids, counts = model.encode(t)
    at = np.concatenate([[0], np.cumsum(counts)])
    want = [e.ids for e in truth.encode_batch(t, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_some_words_fail_the_check_and_are_merged(model):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aehinorst") for _ in range(12)) for _ in range(2000)]
    failed = [w for w in words if model.greedy(w.encode()) != model.exact(w.encode())]
    assert failed and len(failed) < len(words)
    for w in words:
        g = np.array(model.greedy(w.encode()))
        assert bool(model.compatible(g[:-1], g[1:]).all()) == (w not in set(failed))


def test_cache_restart_gives_the_same(model, monkeypatch):
    t = texts()[:50]
    before = model.encode(t)[0].tolist()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    assert model.encode(t)[0].tolist() == before


def test_frame_round_trip_with_edge_rows(spark, truth):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "ünï<|endoftext|>x"), (4, "long " * 30_000)]
    df = spark.createDataFrame([Row(doc_id=i, text=t, ids2="x", decoded2=1) for i, t in rows],
                               "doc_id long, text string, ids2 string, decoded2 int")
    v = bpe.vocabulary(spark, BYTE_BPE)
    got = bpe.decode(bpe.encode(df, v), v)
    assert got.columns == [*df.columns, "ids", "decoded"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "")
        want = truth.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(want, "<u4").tobytes()
    assert bpe.decode(bpe.encode(df.limit(0), v), v).count() == 0


def test_query_digests(spark, sf_small, truth):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in op2_bpe(spark, sf_small).collect():
        ids = truth.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(truth.decode(ids, skip_special_tokens=False).encode()).hexdigest()
