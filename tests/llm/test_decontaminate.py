"""Wu-Manber scan against a word-by-word search."""

import random
import re

from pyspark.sql import Row

from wxframe.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            p = words(item)
            size = min(window, len(p))
            for k in range(len(p) - size + 1 if size else 0):
                for j in range(len(w) - size + 1):
                    if w[j:j + size] == p[k:k + size]:
                        hit.update(range(j, j + size))
                        if item_id is not None:
                            ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in df.collect()), key=str)


def cases():
    rnd = random.Random(3)
    vocab = ["a", "b", "the", "été", "x1", "ß", "日本"]
    text = lambda n: "".join(rnd.choice(vocab).upper() + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rnd.randint(1, 30))) for i in range(12)] + [(12, ""), (13, None), (None, "a b the"), (3, "x1 x1"), (3, "x1 x1")]
    docs = [(i, text(rnd.randint(0, 60)) + (items[i % 12][1] or "")) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "!!"), (None, "a b the"), (1, "x1 x1"), (1, "x1 x1"), (60, text(3000))]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.scan(d, i)) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    whole, cut = D.scan(d, i), D.scan(d, i, block_bytes=60)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([Row(doc_id=1, text="a b", n_words="x", found=1, benchmark_hits=2)])
    assert got(D.scan(d, none)) == [(1, 2, 0, ())]
    assert D.scan(d.limit(0), none).count() == 0
    kept = D.drop_contaminated(d, spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert kept.columns == d.columns and kept.count() == 0
    assert D.drop_contaminated(d, none).collect() == d.collect()
