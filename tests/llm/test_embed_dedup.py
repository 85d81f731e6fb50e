"""Cross-polytope links against all pairs."""

import numpy as np

from wxframe.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=E.COSINE):
    """(links per row, set of row pairs) in double precision."""
    ok, unit = [], []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
        x = x.astype(np.float32).astype(np.float64)
        good = len(x) > 0 and np.isfinite(x).all() and (x != 0).any() and label is not None
        ok.append(good)
        unit.append(x / np.sqrt(x @ x) if good else None)
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if ok[i] and ok[j] and rows[i][2] == rows[j][2]
            and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine}


def check(rows, out, least=0.99):
    pairs = brute(rows)
    links, root = np.zeros(len(rows), int), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        links[[i, j]] += 1
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = {r.vec_id: r for r in out}
    assert len(out) == len(rows)
    n = sum(r.n_links for r in out)
    assert least * links.sum() <= n <= links.sum()
    if n == links.sum():
        ids = [r[0] for r in rows]
        for k, (i, _, _) in enumerate(rows):
            want = min(ids[m] for m in range(len(rows)) if find(m) == find(k))
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k], want, want == i)
    return n, links.sum()


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    check(rows, E.near_duplicates(df).collect())


def clusters():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(20):
        c = rng.normal(size=48)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (c + rng.normal(size=48) * rng.choice([0, .1, .25, .3])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return rows


def test_tiles_give_the_same(spark):
    rows = clusters()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = E.near_duplicates(df).collect()
    check(rows, whole)
    cut = E.near_duplicates(df, tile=7).collect()
    assert sorted(whole) == sorted(cut)


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (9, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
            (10, [float("nan"), 1.0, 2.0], 1), (11, [float("inf"), 1.0, 2.0], 1), (12, [], 1), (13, [1.0, 2.0], 1), (14, [7.0], 1), (15, [9.0], 1),
            (16, [-0.0, 1.0], 3), (17, [0.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA + ", key string, n_links int")
    got = {r.vec_id: tuple(r)[1:] for r in E.near_duplicates(df).collect()}
    assert got[5] == (2, 2, False) and got[9] == (2, 2, False) and got[2] == (2, 2, True)
    assert all(got[k] == (0, k, True) for k in (3, 4, 6, 7, 8, 10, 11, 12, 13))
    assert got[14] == (1, 14, True) and got[15] == (1, 14, False) and got[16] == (1, 16, True) and got[17] == (1, 16, False)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_nameless_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], SCHEMA)
    got = sorted(map(tuple, E.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)], key=str)


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(E.hadamard(x), x @ h)
