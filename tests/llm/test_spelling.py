"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from wxframe.llm import spelling as S

SCHEMA = "doc_id long, text string"


def words(rows, min_letters=5, min_count=3, every=97):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= min_letters and k >= min_count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def near_pairs(n):
    """All pairs of words that have equal halves at an end: one edit leaves a half of either word whole."""
    out, blocks = {w: set() for w in n}, {}
    for w in n:
        for k in {len(w) // 2, (len(w) - 1) // 2, (len(w) + 1) // 2}:
            blocks.setdefault(("head", w[:k]), set()).add(w)
            blocks.setdefault(("tail", w[len(w) - k:]), set()).add(w)
    for block in blocks.values():
        for a in block:
            out[a].update(b for b in block if b not in out[a] and is_near(a, b))
    return out


def brute(n, ratio=2, pairs=None):
    near = pairs or {a: {b for b in n if is_near(a, b)} for a in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = top if top and n[top] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdiqyzéèÿ") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rnd.randint(0, 60)):
            w = rnd.choice(base[:1 + int(60 * rnd.random() ** 2)])
            while rnd.random() < .3:
                p = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:p] + w[p + 1:], w[:p] + rnd.choice("aiqé") + w[p:], w[:p] + rnd.choice("aiqé") + w[p + 1:]])
            text.append(w.upper() if rnd.random() < .1 else w)
        rows.append((k if k % 10 else None, rnd.choice([" ", ", ", "1", "\n", "ß×", "œ", "中"]).join(text)))
    return rows + [(500, None), (501, ""), (502, "12 34 œ"), (503, "Éclair éclair Éclair"), (503, "abcdq " * 4)]


def test_variants_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for every in (97, 3, 0):
        want = words(rows, every=every)
        assert {(r.word, r.n) for r in S.vocabulary(docs, typo_every=every).collect()} == set(want.items())
        assert got(S.variants(docs, typo_every=every)) == brute(want)
    assert got(S.variants(docs, min_letters=2, min_count=1, symbols=2, ratio=3, typo_every=5)) == \
        brute(words(rows, 2, 1, 5), 3)


def test_every_edge_is_listed_at_one_end():
    words = [w for n in range(1, 5) for w in itertools.product((1, 2, 3), repeat=n)]
    own, around = {}, {}
    for n in range(1, 5):
        of = [w for w in words if len(w) == n]
        for rows, keys in S.reduced_keys(np.array(of), 3, False):
            own.update(zip((of[r] for r in rows), keys.tolist()))
        for rows, keys in S.reduced_keys(np.array(of), 3, True):
            for r, k in zip(rows, keys.tolist()):
                around.setdefault(of[r], []).append(k)
    assert len(set(own.values())) == len(words)
    for a in words:
        assert len(around[a]) == len(set(around[a])) and own[a] in around[a]
        for b in words:
            if a != b:
                assert (own[b] in around[a]) + (own[a] in around[b]) == is_near(a, b)


def test_chains_of_forms(spark):
    n = {"aaaaa" + "b" * k: 3 * 2 ** k for k in range(20)}
    docs = [(k, " ".join([w] * min(c, 50_000))) for k, (w, c) in enumerate(n.items())]
    n = {w: min(c, 50_000) for w, c in n.items()}
    assert got(S.variants(spark.createDataFrame(docs, SCHEMA))) == brute(n)
    ties = [(1, "abcde " * 3 + "abcdf " * 9 + "abcdd " * 9 + "abcdé " * 9)]
    assert {r.word: r.form for r in S.variants(spark.createDataFrame(ties, SCHEMA)).collect()}["abcde"] == "abcdd"


def test_long_words_empty_tables_and_other_columns(spark):
    long = "abcdefgh" * 2500
    rows = [(1, f"{long} {long}x {long[:-1]} " * 3), (2, f"{long}")]
    for every in (0, 1, 97):
        assert got(S.variants(spark.createDataFrame(rows, SCHEMA), typo_every=every)) == brute(words(rows, every=every))
    assert S.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert S.variants(spark.createDataFrame([(1, None), (2, "ab 12")], SCHEMA)).collect() == []
    docs = spark.createDataFrame([("x", "hello hallo " * 3, 1, "w")], "name string, body string, n int, word string")
    assert {r.word for r in S.variants(docs, "name", "body").collect()} == {"hello", "hallo"}


def test_query_over_the_table(spark, sf_small):
    from wxframe.llm.queries import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    n = words(rows)
    assert got(queries()["op11_spelling"](spark, sf_small)) == brute(n, pairs=near_pairs(n))
