"""Self-join against all pairs."""

import random
import re
import tracemalloc

import numpy as np

from wxframe.llm import ngram_join as J
from wxframe.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted(sets, key=lambda r: len(r[1]))
    for k, (i, a) in enumerate(by_size):
        for j, b in by_size[k + 1:]:
            if len(a) * 5 < len(b) * 4:
                break
            n = len(a & b)
            if a and 100 * n >= 80 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def near_copies(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([4, 6, 12, 40, 150]))]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < .3:
                base = w                                   # chains drift away from the first
            rows.append(" ".join(w).upper() if rnd.random() < .2 else "\n ".join(w))
    line = " ".join(word() for _ in range(20))             # shared by many that are not near
    rows += [line + " " + " ".join(word() for _ in range(rnd.choice([2, 4, 6, 30]))) for _ in range(40)]
    rows += ["", " \t\n", "one", "One", "a b c d", "a b c d", "a b c d e"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_random_near_copies(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, SCHEMA)
    want = [tuple(r) for r in brute(rows)]
    assert sorted(got(J.classes(df))) == want
    assert sorted(got(J.classes(df, common=1))) == want     # most tokens late in the first order


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(got(J.classes(df))) == brute([tuple(r) for r in df.collect()])


def test_edge_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = [(5, text), (5, text), (9, text), (None, text), (None, None), (7, None), (8, ""), (3, "x " * 40_000), (4, "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", gone_id string, component_id int")
    assert got(J.classes(df)) == sorted([(5, 26, 5), (5, 26, 5), (9, 26, 5), (None, 26, None), (None, 0, None), (7, 0, 7), (8, 0, 8),
                                         (3, 1, 3), (4, 1, 4)], key=str)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "5", "None", "None", "7", "8", "3", "4"])
    assert J.classes(df.limit(0)).count() == 0


def test_prefix_bound_never_loses_a_link():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 200, rnd.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.append(a[rnd.random(len(a)) > .1], rnd.integers(0, 200, 3).astype(np.uint64)))
        n = len(np.intersect1d(a, b))
        assert J.linked(a, b, (4, 5)) == (n * 5 >= 4 * (len(a) + len(b) - n))


def test_sketches_admit_every_link_and_few_others(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = rnd.integers(0, 2**64, rnd.integers(1, 400), dtype=np.uint64)
        for share in (.02, .05, .1, .12, .2, .3, .5, 1):
            other = np.unique(np.append(base[rnd.random(len(base)) > share],
                                        rnd.integers(0, 2**64, int(share * len(base)), dtype=np.uint64)))
            a = np.unique(base)
            if len(other):
                rows.append((J.sketch(a, (4, 5)).tolist(), J.sketch(other, (4, 5)).tolist(), len(a), len(other),
                             J.linked(a, other, (4, 5)), len(np.intersect1d(a, other)) / len(np.union1d(a, other))))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, n long, k long, linked boolean, j double")
    df = df.withColumn("ok", J._screen("x", "y", df.n, df.k, (4, 5)))
    assert df.where("linked").count() > 60 and df.where("linked and not ok").count() == 0
    assert df.where("j < 0.6 and n > 50 and ok").count() == 0


def test_copies_around_a_centre_that_is_no_copy(spark):
    """The smallest holder of many common tokens links with none of the copies."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = [" ".join(base[:60] + [word() for _ in range(60)])]
    for _ in range(40):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert sorted(got(J.classes(df))) == want
    assert want[0][2] == 0 and all(c != 0 for i, _, c in want if i)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1080)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == sorted((x, find(x)) for x in root)
    assert components(df.limit(0)).count() == 0


def test_a_pair_is_met_once(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(600)]
    rows = [(k, " ".join(words[:200 * k] + [f"new{k}"] + words[200 * k:])) for k in range(4)]
    assert len(brute(rows)) == 4 and {r[2] for r in brute(rows)} == {0}
    join = J.Join(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 5, (4, 5), 32)
    none = spark.createDataFrame([], "id long, component long")
    e = join._apart(none)
    F = J.F
    met = e.alias("x").join(e.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id"))
                            & join._admits("x", "y"))
    assert sorted(tuple(r) for r in met.select("x.id", "y.id").collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert join.second_round(e).count() == 6


def test_small_components_take_few_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)}
        assert found.rdd.getNumPartitions() <= 64 + 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_prefixes_from_heads(spark):
    """A head gives the prefix of its whole set, or nothing; what is missing is made from the text."""
    rnd = np.random.default_rng(5)
    for _ in range(300):
        tokens = np.unique(rnd.integers(0, 2**64, rnd.integers(1, 200), dtype=np.uint64))
        late = np.sort(rnd.permutation(tokens)[:rnd.integers(0, len(tokens) + 1)])
        common, n = (late, rnd.permutation(len(late)).astype(np.int32)), len(tokens)
        whole = J._prefix(tokens, n, common, (4, 5))
        found = J._prefix(tokens[:J.head_length(n, (4, 5))], n, common, (4, 5))
        assert len(whole) == J.prefix_length(n, (4, 5)) and (found is None or np.array_equal(found, whole))
    rows = [(i, t) for i, t in near_copies() if t]
    df = spark.createDataFrame(rows, SCHEMA)
    join = J.Join(df, "doc_id", "text", 5, (4, 5), 32)
    sets = J.token_sets(J.pa.array([t for _, t in rows]))
    late = np.unique(np.concatenate([s[:J.prefix_length(len(s), (4, 5))] for s in sets]))[::2]
    common = (late, np.arange(len(late), dtype=np.int32))
    heads = spark.createDataFrame([(i, len(s), J._signed(s[:J.head_length(len(s), (4, 5))]).tolist())
                                   for (i, _), s in zip(rows, sets, strict=True)], "id long, n long, head array<long>")
    want = sorted((int(t), i, len(s)) for (i, _), s in zip(rows, sets, strict=True)
                  for t in J._signed(J._prefix(s, len(s), common, (4, 5))))
    entries = join._entries(heads, spark.sparkContext.broadcast(common))
    assert sorted(tuple(r) for r in entries.select("token", "id", "n").collect()) == want


def test_hashing_takes_little_memory():
    text = J.pa.array([" ".join(f"word{k % 977}" for k in range(500_000))])
    data, offs = J.text_buffer(text)
    tracemalloc.start()
    try:
        flat, starts, ends, _ = J.words_of(data, offs, J.SPACE_WORDS)
        J.word_hashes(flat, starts, ends)
        assert tracemalloc.get_traced_memory()[1] < 12 * len(data)
    finally:
        tracemalloc.stop()
