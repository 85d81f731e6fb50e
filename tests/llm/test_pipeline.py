"""Pipeline stages on a small corpus with planted cases, and on the given tables."""

import hashlib
import os
import random
import tempfile

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_ngram_join import brute as brute_classes
from wxframe.llm.queries import BYTE_BPE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    """(folder, rows): good and bad documents, copies, near copies, shared passages, benchmark leaks, odd rows."""
    rnd = random.Random(11)
    rows = [(k, "\n".join(sentence(rnd, 30) for _ in range(3))) for k in range(60)]
    passage, item = sentence(rnd, 70), sentence(rnd, 24)
    rows += [(100 + k, f"{sentence(rnd, 40)}\n{passage}\n{sentence(rnd, 40)}") for k in range(6)]
    rows += [(200 + k, f"{sentence(rnd, 40)} {item} {sentence(rnd, 20)}") for k in range(4)]
    base = sentence(rnd, 120).split(" ")
    rows += [(300 + k, " ".join(w if j != 7 * k else "other" for j, w in enumerate(base))) for k in range(3)]
    rows += [(400 + k, "SPAM!! " * (40 + k)) for k in range(30)]
    rows += [(500, None), (501, ""), (502, rows[5][1]), (503, "long " + sentence(rnd, 20_000)), (None, sentence(rnd, 30))]
    rows += [rows[6]]
    folder = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not (t or "").startswith("SPAM")), 0) for i, t in rows if i is not None and i < 450 and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, sentence(rnd, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item, passage


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order(spark, corpus):
    folder, rows, item, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    quality, lines, near, leaks, last = (f for _, f in P.STAGES)

    kept = quality(spark, docs, folder)
    assert kept.columns == docs.columns
    got = texts(kept)
    assert not any((t or "").startswith("SPAM") for t in got.values())
    assert set(range(60)) | set(range(100, 106)) <= set(got)             # clean documents stay
    kept = kept.checkpoint()

    cut = lines(spark, kept, folder)
    assert cut.columns == docs.columns
    got = texts(cut)
    assert [k for k in got if k in range(100, 106) and passage in got[k]] == [100]
    assert 502 not in got and got[5] == rows[5][1]                       # a copy of document 5 holds nothing else
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text)
    cut = cut.checkpoint()

    one = near(spark, cut, folder)
    assert one.columns == docs.columns
    before = [(i, t) for i, t in texts(cut).items() if i is not None]
    want = {i for i, _, c in brute_classes(before) if i == c}
    assert {i for i in texts(one) if i is not None} == want and {300, 301, 302} & want == {300}
    one = one.checkpoint()

    clean = leaks(spark, one, folder)
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in brute_windows(list(texts(one).items()), items) if n}
    assert set(texts(clean)) == set(texts(one)) - hit and {200, 201, 202, 203} <= hit

    truth = Tokenizer.from_file(BYTE_BPE)
    out = {r.doc_id: r for r in last(spark, clean, folder).collect()}
    for i, t in texts(clean).items():
        ids = truth.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_run_equals_the_stages(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_empty_tables_and_clashing_columns(spark):
    folder = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = ", quality_score string, line_key string, gone_id string, benchmark_hits string, ids string, n_tokens string"
    rows = [(1, "a b c", "en", "s", 5, *"abcdef"), (2, None, None, None, None, *"abcdef")]
    for docs in (spark.createDataFrame([], DOCS + extra), spark.createDataFrame(rows, DOCS + extra)):
        now = docs
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == docs.columns
        assert now.count() == docs.count() == P.STAGES[-1][1](spark, now, folder).count()


def test_entry_lists_the_queries():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert os.path.exists(os.path.join(os.path.dirname(P.__file__), "wxframe", "llm"))


def test_encoding_takes_one_python_worker_a_task(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    plan = P.encode(spark, rows, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
