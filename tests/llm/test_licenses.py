"""Licence scan: planted notices, near misses, edge rows."""

import pytest

from wxframe.llm import licenses as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_fixed_texts_have_an_anchor(spark):
    import re
    for ts in L.TEMPLATES.values():
        for t in ts:
            assert re.search(r"(?i)\b(?:" + "|".join(L.ANCHORS) + ")", t), t
    rows = spark.createDataFrame([(t,) for ts in L.TEMPLATES.values() for t in ts], "t string")
    for r in rows.select("t", L.pairs(L.words(rows.t)).alias("p")).collect():
        assert r.p == L._pairs_of(r.t)


def test_planted_notices_and_near_misses(spark, model):
    body = "Onthe stands a house.\nIt has a door"
    rows, want = [], {}
    for f, ts in L.TEMPLATES.items():
        for t in ts:
            for text in (t, f"{body}.\n{t}\n{body}", t.upper(), t.replace(" ", "\n", 3)):
                want[len(rows)] = [f]
                rows.append((len(rows), text))
    for t in ["The licence plate was stolen last night.", "We have all the rights to be here.", "She had no permission to speak.", body, "", None,
              "licensed " * 5_000, "The patients kept their license to practise medicine under the new rules."]:
        want[len(rows)] = []
        rows.append((len(rows), t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.families for r in L.families(df, model).collect()}
    wrong = {k: (rows[k][1], got[k], want[k]) for k in want if got[k] != want[k]}
    assert len(wrong) <= 0.03 * len(rows), wrong
    assert all(not got[k] for k in want if not want[k])


def test_edge_rows_and_native_plan(spark, model):
    mit = L.TEMPLATES["MIT"][0]
    rows = [(1, mit), (1, mit), (None, mit), (2, None), (3, ""), (4, "word " * 100_000 + ".\n" + mit)]
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], "doc_id long, text string, id string, family string")
    out = L.families(df, model)
    assert sorted((str(r.doc_id), r.n_paragraphs, tuple(r.families)) for r in out.collect()) == sorted(
        [("1", 2, ("MIT",)), ("1", 2, ("MIT",)), ("None", 1, ("MIT",)), ("2", 0, ()), ("3", 0, ()), ("4", 1, ("MIT",))])
    assert L.families(df.limit(0), model).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_training_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = L.train(spark, empty)
    df = spark.createDataFrame([(1, L.TEMPLATES["GPL"][0])], "doc_id long, text string")
    assert L.families(df, model).collect()[0].families == ["GPL"]


def test_notices_that_are_no_template(spark, model):
    notices = [("Creative Commons Attribution 4.0 International", "CC-BY"), ("CC BY-SA 4.0", "CC-BY-SA"), ("Apache-2.0", "Apache-2.0"),
               ("BSD-3-Clause", "BSD"), ("Available under the Apache License 2.0", "Apache-2.0"), ("The MIT License (MIT)", "MIT"),
               ("The sources are under the MIT license.", "MIT"), ("We publish it under GPL-3.0-or-later", "GPL"),
               ("Photos: CC BY-NC 4.0", "CC-BY-NC"), ("Shared under the Mozilla Public License 2.0", "MPL-2.0")]
    plain = ["MIT researchers met in the spring.", "An Apache chief spoke to the crowd.", "The painter of the commons is unknown.", "Version 2.0 was late."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _ in notices] + plain)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in L.families(df, model).collect()}
    want = {k: [f] for k, (_, f) in enumerate(notices)} | {len(notices) + k: [] for k in range(len(plain))}
    assert got == want


def test_words_and_scores_are_worked_out_once(spark, model):
    plan = L.families(spark.read.parquet(f"{SF}/documents.parquet"), model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert plan.count("UDF(") <= 8


def test_a_step_of_the_fit_is_one_task_and_the_heap_is_cleared_after_it(spark):
    sc = spark.sparkContext
    beans = sc._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName())
    before = full()
    sc.setJobGroup("licences", "fit")
    try:
        L.train(spark, spark.createDataFrame([(1, "A house stands by the road.")], "doc_id long, text string"), L.Settings(steps=2))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("licences") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s and "treeAggregate" in s.name]
    assert len(tasks) >= 2 and set(tasks) == {1}, tasks
    assert full() > before
