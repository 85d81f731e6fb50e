"""Runs of repeated words against plain searches."""

import hashlib
import random
import re
import zlib

import numpy as np

from wxframe.llm import periodic as P

SCHEMA = "doc_id long, text string"


def plain_runs(w, min_words=6, exponent=4):
    """Maximal stretches of each period, longest equal stretches first; the smallest period of a stretch counts."""
    best = {}
    n = len(w)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_words, exponent * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapse(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def texts():
    rnd = random.Random(11)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, " a" * 7, "a b " * 4, "a b " * 3 + "a", "é x " * 9, "a " * 1000]
    for _ in range(250):
        w = [rnd.choice("ab" if rnd.random() < .5 else "abcdefgh") for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            block = [rnd.choice("abcd") for _ in range(rnd.choice([1, 2, 3, 5, 8, 40]))]
            k = rnd.randrange(len(w) + 1)
            w[k:k] = (block * 9)[:int(len(block) * rnd.uniform(2, 9))]
        out.append(rnd.choice([" ", "\n", "\x0b  "]).join(w))
    for p in (1, 2, 30, 31, 32, 62, 93, 124, 200):                # around the cover's cycle
        block = [f"w{rnd.randrange(5)}" for _ in range(p)]
        w = block * 6
        w[rnd.randrange(len(w))] = "x"
        out.append(" ".join(["q"] * rnd.randrange(40) + w + block * 4 + ["z"]))
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    out += [" ".join(fib[-1]), " ".join("aab" * 200 + fib[-1] + "aab" * 200)]
    return out


def test_runs_equal_plain_search(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(3)
    seen = 0
    for r in P.annotate(docs).collect():
        w = split(r.text)
        want = plain_runs(w)
        seen += len(want)
        assert [tuple(x) for x in r.periodic.runs] == want and r.periodic.n_words == len(w)
        assert r.periodic.text == " ".join(collapse(w, want))
    assert seen > 300
    for r in P.annotate(docs, "found", min_words=3, exponent=2).collect():
        w = split(r.text)
        assert [tuple(x) for x in r.found.runs] == plain_runs(w, 3, 2)


def test_small_blocks_of_places(monkeypatch):
    codes, first = [], [0]
    for t in texts():
        w = split(t)
        codes += w
        first.append(len(codes))
    number = {w: k for k, w in enumerate(dict.fromkeys(codes))}
    codes, first = np.array([number[w] for w in codes], np.int64), np.array(first)
    whole = P.find_runs(codes, first)
    monkeypatch.setattr(P, "BLOCK", 50)
    for a, b in zip(whole, P.find_runs(codes, first)):
        assert np.array_equal(a, b)


def test_extensions_are_exact():
    rnd = np.random.default_rng(3)
    w = rnd.integers(0, 2, 700)
    w[200:500] = np.tile(rnd.integers(0, 2, 50), 6)
    codes = np.concatenate([[2], w, [3]])
    e = P.Extensions(codes, np.array([[1, 701]]))
    i = rnd.integers(1, 700, 4000)
    j = rnd.integers(1, 700, 4000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    for a, b, n in zip(i, j, e.lengths(i, j, np.zeros(len(i), int))):
        k = 0
        while codes[a + k] == codes[b + k]:
            k += 1
        assert n == k
    assert set(np.flatnonzero(e.rank >= 0) % P.CYCLE) == set(P.COVER)      # no other suffix was sorted


def test_very_long_texts(spark):
    rows = [(1, "a " * 300_000), (2, " ".join(f"w{k % 70_000}" for k in range(300_000))), (3, "b " * 3)]
    found = {r.doc_id: [tuple(x) for x in r.periodic.runs] for r in P.annotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: [(0, 300_000, 1)], 2: [(0, 300_000, 70_000)], 3: []}


def test_empty_table_and_other_columns(spark):
    assert P.annotate(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([("k", 5, "r")], "text string, n_words int, runs string")
    assert P.annotate(docs, "x").columns == ["text", "n_words", "runs", "x"]


def want_row(i, text):
    w = split(text)
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(collapse(w, runs))))


def test_query_over_the_table(spark, sf_small):
    from wxframe.llm.queries import queries
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: want_row(r.doc_id, r.text) for r in rows if len(split(r.text)) < 3000}
    got = {r.doc_id: tuple(r) for r in queries()["op13_periodic"](spark, sf_small).collect()}
    assert len(got) == len(rows) and {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 3


def test_planted_stretches(spark):
    from wxframe.llm.queries import _with_tandems
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 97))) for i in range(400)] + [(i, None) for i in range(400, 440)],
                                 SCHEMA)
    planted = _with_tandems(docs)
    rows = {r.doc_id: r.text for r in planted.collect()}
    digests = {r.doc_id: r.periodic.text for r in P.annotate(planted).collect()}
    for r in docs.collect():
        assert hashlib.sha256(digests[r.doc_id].encode()).hexdigest() == want_row(r.doc_id, r.text)[-1]
    assert sum(rows[i] != " ".join(f"w{k}" for k in range(i % 97)) for i in range(400)) > 20
