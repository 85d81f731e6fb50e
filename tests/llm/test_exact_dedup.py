"""Exact de-duplication against a dictionary, with real and forced hash collisions."""

import hashlib
import re

from pyspark.sql import functions as F

from wxframe.llm import exact_dedup as X

SCHEMA = "doc_id long, text string"


def brute(rows):
    def body(t):
        return re.sub("[\x20\x09-\x0d]+", " ", t or "")

    groups = {}
    for i, t in rows:
        groups.setdefault(body(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[body(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(body(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (4, None), (8, ""), (7, " "), (6, "\n\x0b"), (2, "A b c"),
        (1, "é x"), (10, "é x"), (3, "a b c"), (None, "only"), (None, "a b c"), (11, "long " * 300_000),
        (12, "long  " * 300_000), (13, "long " * 299_999 + "lonG ")] + [(100 + k, "copy") for k in range(3000)]


def test_groups_equal_brute_force(spark):
    assert got(X.groups(spark.createDataFrame(ROWS, SCHEMA))) == brute(ROWS)


def test_bytes_decide_where_hashes_collide(spark):
    weak = lambda body: F.substring(F.unhex(F.md5(F.col(body).cast("binary"))), 1, 1)
    nothing = lambda body: F.lit(b"")
    rows = ROWS + [(5000 + k, f"text {k % 700}") for k in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for digest in (weak, nothing):
        assert got(X.groups(docs, digest=digest)) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert X.groups(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a", "x", 1, "s"), (2, "a ", "y", 2, "t"), (3, "a", "z", 3, None)],
                                 "`doc.id` long, text string, h string, n int, _sha string")
    assert {tuple(r)[:4] for r in X.groups(docs, "doc.id").collect()} == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)}
    kept = X.deduplicate(docs, "doc.id")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a", "x", 1, "s"), (2, "a ", "y", 2, "t")]


def test_hot_text_is_shuffled_once_per_task(spark):
    """Texts are pre-aggregated before their only shuffle, and no plan runs Python."""
    docs = spark.createDataFrame([(k, "hot") for k in range(1000)], SCHEMA)
    plan = X.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
    assert "body" not in plan.split("SortMergeJoin")[0]


def test_query_over_the_table(spark, sf_small):
    from wxframe.llm.queries import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries()["op12_exact_dedup"](spark, sf_small)) == brute(rows)
