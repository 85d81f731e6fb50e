"""Co-training: held-out accuracy, edge rows, determinism."""

import numpy as np
from pyspark.sql import functions as F

from wxframe.llm import quality as Q

SF = "/root/testdata/sf0.1"
SMALL = Q.Settings(labelled=800, pool=300, rounds=2)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0
    model = Q.train(docs, labels.where(~test), settings=SMALL)
    got = Q.score(docs.join(labels.where(test).select("doc_id", "quality"), "doc_id"), model, "s") \
        .select("quality", F.col("s.p_good").alias("p")).collect()
    y, p = np.array([r.quality for r in got]), np.array([r.p for r in got])
    assert ((p >= .5) == (y == 1)).mean() > 0.97
    assert (p[y == 1] >= .5).mean() > 0.99          # clean documents stay
    assert model.pseudo and len(model.pseudo) == SMALL.rounds


def test_edge_rows_and_columns(spark):
    rows = [(k, "good words here are plain and many " * (k % 4 + 1) if k % 3 else "bad!! " * 30, "en", f"s{k % 2}", 9) for k in range(60)]
    rows += [(90, None, None, None, None), (91, "", "en", "s", 0), (92, "x " * 50_000, "en", "s", 10**12), (1, *rows[1][1:]), (None, "bad!! " * 30, "en", "s0", 9)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, quality_score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(7, None, 0), (None, 1, 0), (777, 1, 0)], "doc_id long, quality int, toxic int")
    kept = Q.keep_good(docs, labels, SMALL)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i < 60) == sorted([k for k in range(60) if k % 3] + [1]) and None not in ids
    scores = lambda d, parts: sorted(map(str, Q.score(d, Q.train(d.repartition(parts), labels, settings=SMALL), "s")
                                     .select("doc_id", "s").collect()))
    assert scores(docs, 3) == scores(docs.repartition(7), 5)


def test_no_labels_keep_all(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.keep_good(docs, none).collect() == docs.collect()
    assert Q.keep_good(docs.limit(0), none).count() == 0
