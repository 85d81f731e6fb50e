"""File sources and sinks on small folders built from the test tables."""

import datetime as dt
import gzip
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wxframe.operators import timegrid as TG
from wxframe.sources import files as FS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="wxframe-test-", dir="/tmp")


def _station_files(root):
    ev = pd.read_parquet(f"{SF}/events.parquet")
    ev = ev[ev["event_type"] == "click"].sort_values("event_id")
    ev["station"] = "S" + (ev["user_id"] % 3).astype(str)
    ev["month"] = ev["ts"].dt.strftime("%Y%m")
    written = 0
    for (st, mo), g in ev.groupby(["station", "month"]):
        d = os.path.join(root, mo)
        os.makedirs(d, exist_ok=True)
        out = pd.DataFrame({"time": g["ts"].dt.floor("h").dt.strftime("%Y-%m-%d %H:%M:%S"),
                            "airTemperature": g["value"]})
        if st == "S2":                      # gzip input is read natively
            with gzip.open(os.path.join(d, f"{st}.csv.gz"), "wt") as fh:
                out.to_csv(fh, index=False)
        else:
            out.to_csv(os.path.join(d, f"{st}.csv"), index=False)
        written += len(out)
    return written


def test_station_csv_scan_dedupe_and_sink(spark, scratch):
    root = os.path.join(scratch, "stations")
    n = _station_files(root)
    df = FS.read_station_csv(spark, root, year=2024)
    assert df.count() == n
    assert sorted(r.station for r in df.select("station").distinct().collect()) == ["S0", "S1", "S2"]
    assert [r.month for r in df.select("month").distinct().collect()] == ["202401"]
    clean = TG.dedupe_time(TG.shift_time(df, "time"), ["station"], "time", "_ingest")
    expect = df.select("station", "time").distinct().count()
    assert clean.count() == expect
    out = os.path.join(scratch, "obs")
    FS.write_obs(clean.drop("_ingest"), out)
    back = spark.read.parquet(out)
    assert back.count() == expect and "year" in back.columns


def test_monthly_sink_overwrites_only_present_months(spark, scratch):
    path = os.path.join(scratch, "monthly")
    rows = [(dt.datetime(2024, m, 1), float(m)) for m in (1, 2)]
    df = spark.createDataFrame(rows, "valid_time timestamp_ntz, t2m double")
    FS.write_monthly(df, path)
    FS.write_monthly(spark.createDataFrame([(dt.datetime(2024, 2, 1), 20.0)], "valid_time timestamp_ntz, t2m double"), path)
    back = {(r.month, r.t2m) for r in spark.read.parquet(path).collect()}
    assert back == {(1, 1.0), (2, 20.0)}


def _write_member(spark, base, parts, member, df):
    p = os.path.join(base, *[f"{k}={v}" for k, v in parts], f"member={member}")
    df.write.mode("overwrite").parquet(p)


def test_reanalysis_months_need_all_members(spark, scratch):
    base = os.path.join(scratch, "era5")
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), -26.0, 113.0, 1.0)],
                                "valid_time timestamp_ntz, latitude double, longitude double, x double")
    for m in FS.REANALYSIS_MEMBERS:
        _write_member(spark, base, [("year", 2024), ("month", 1)], m, one)
    _write_member(spark, base, [("year", 2024), ("month", 2)], "accum", one)
    with pytest.raises(FS.IncompleteMonthError):
        FS.read_reanalysis(spark, base)
    got = FS.read_reanalysis(spark, base, strict=False)
    assert got["accum"].select("month").distinct().collect()[0].month == 1


def test_forecast_runs_catalog_and_date_range(spark, scratch):
    base = os.path.join(scratch, "fc")
    for day in (1, 8, 15):
        t = dt.datetime(2024, 1, day)
        rows = [(t + dt.timedelta(hours=h), 3.0, -26.0, 113.0, float(day)) for h in range(0, 24 * 7, 24)]
        df = spark.createDataFrame(rows, "time timestamp_ntz, step double, latitude double, longitude double, t2m double")
        _write_member(spark, base, [("year", 2024), ("month", 1), ("day", day)], "single", df)
        if day != 15:
            _write_member(spark, base, [("year", 2024), ("month", 1), ("day", day)], "pressure", df)
    members = FS.read_forecast(spark, base)
    single = members["single"]
    assert sorted(r.run_date for r in FS.available_run_dates(single).collect()) == ["2024-01-01", "2024-01-08"]
    win = FS.load_date_range_files(single, "2024-01-09", "2024-01-10")
    assert {r.t2m for r in win.collect()} == {8.0}      # the 01-01 run is older than the 7-day look-back
    plan = win._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()      # completeness shuffles no row


def _csv(root, month, name, text):
    os.makedirs(os.path.join(root, month), exist_ok=True)
    with open(os.path.join(root, month, name), "w") as fh:
        fh.write(text)


def test_columns_by_header_and_bad_values(spark, scratch):
    root = os.path.join(scratch, "headers")
    _csv(root, "202401", "A.csv", "time,rainfall,airTemperature\n2024-01-01 00:00:00,5.5,30.0\n")
    _csv(root, "202401", "B.csv", '"extra","airTemperature","time"\r\n"x,y","NaN","2024-01-01 00:00:00"\r\nz,inf,2024-01-01 01:00:00\r\n')
    _csv(root, "202401", "C.csv", "airTemperature\n7.0\n")
    _csv(root, "202401", "D.csv", "time,airTemperature\nnot a time,1\n2024-01-01 00:00:00\n\n2024-01-01 02:00:00,abc\n")
    got = sorted((r.station, r.time.hour, r.airTemperature, r.rainfall) for r in FS.read_station_csv(spark, root).collect())
    assert got == [("A", 0, 30.0, 5.5), ("B", 0, None, None), ("B", 1, None, None), ("D", 0, None, None), ("D", 2, None, None)]


def test_first_month_wins_whatever_the_file_sizes(spark, scratch):
    root = os.path.join(scratch, "order")
    _csv(root, "202401", "A.csv", "time,airTemperature\n2024-02-01 00:00:00,1.0\n")
    more = "".join(f"2024-02-{d:02d} {h:02d}:00:00,9.0\n" for d in range(2, 28) for h in range(24))
    _csv(root, "202402", "A.csv", "time,airTemperature\n2024-02-01 00:00:00,2.0\n" + more)
    clean = TG.dedupe_time(FS.read_station_csv(spark, root), ["station"], "time", "_ingest")
    assert clean.where("time = timestamp_ntz'2024-02-01 00:00:00'").collect()[0].airTemperature == 1.0


def test_streaming_ingest_matches_batch(spark, scratch):
    from wxframe.streaming.ingest import ingested, start_ingest
    root = os.path.join(scratch, "stream_in")
    _station_files(root)
    out, ckpt = os.path.join(scratch, "stream_out"), os.path.join(scratch, "stream_ckpt")
    run = lambda: start_ingest(spark, root, out, checkpoint=ckpt).awaitTermination(300)
    run()
    rows = lambda df: sorted(map(str, df.select("station", "time", "airTemperature").collect()))
    batch = lambda: TG.dedupe_time(TG.shift_time(FS.read_station_csv(spark, root), "time"), ["station"], "time", "_ingest")
    assert rows(ingested(spark, out)) == rows(batch())
    run()                                          # no new files: nothing more
    assert rows(ingested(spark, out)) == rows(batch())
    # a time of an earlier month again in a later batch: the earlier file's row stays
    _csv(root, "202402", "S0.csv", "time,airTemperature\n" + str(FS.read_station_csv(spark, root).where("station = 'S0'")
                                                              .collect()[0].time) + ",-99\n2024-02-20 00:00:00,3\n")
    run()
    assert rows(ingested(spark, out)) == rows(batch())


def test_skip_existing_leaves_months_and_raises_on_real_errors(spark, scratch):
    path = os.path.join(scratch, "skip")
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "valid_time timestamp_ntz, t2m double")
    FS.write_monthly(one, path, skip_existing=True)
    both = spark.createDataFrame([(dt.datetime(2024, m, 1), 9.0) for m in (1, 2)], "valid_time timestamp_ntz, t2m double")
    FS.write_monthly(both, path, skip_existing=True)
    assert {(r.month, r.t2m) for r in spark.read.parquet(path).collect()} == {(1, 1.0), (2, 9.0)}
    bad = os.path.join(scratch, "not_parquet")
    _csv(bad, "year=2024", "x.parquet", "text")
    with pytest.raises(Exception):
        FS.write_monthly(one, bad, skip_existing=True)


def test_a_month_is_few_files(spark, scratch):
    path = os.path.join(scratch, "files")
    rows = [(dt.datetime(2024, 1 + k % 2, 1 + k % 28), float(k)) for k in range(500)]
    FS.write_monthly(spark.createDataFrame(rows, "valid_time timestamp_ntz, t2m double").repartition(20), path)
    folder = os.path.join(path, "year=2024", "month=1")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) <= 2


def test_grid_points_and_csv_sink_round_trip(spark, scratch):
    from wxframe.operators import select as S
    p = os.path.join(scratch, "grid.csv")
    with open(p, "w") as fh:
        fh.write("name,lat,lon\n" + "".join(f",{-26.0 - 0.25 * i},{113.0 + 0.25 * j}\n" for i in range(3) for j in range(4)))
    grid = FS.read_grid_points(spark, p)
    assert grid.count() == 12 and grid.where("name IS NULL").count() == 12
    st = spark.createDataFrame([("A", -26.1, 113.5), ("B", -30.0, 113.5)], "station string, lat double, lon double")
    inside = S.filter_by_extent(st, grid, grid_lat="lat", grid_lon="lon")
    out = os.path.join(scratch, "inside_csv")
    FS.write_csv(inside, out)
    back = spark.read.option("header", True).csv(out)
    assert [r.station for r in back.collect()] == ["A"]


def test_completeness_opens_no_data_file(spark, scratch):
    """Members are known from folder names: files that no reader could open don't matter where no data is wanted."""
    base = os.path.join(scratch, "catalog")
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "valid_time timestamp_ntz, x double")
    for m in FS.REANALYSIS_MEMBERS:
        _write_member(spark, base, [("year", 2024), ("month", 1)], m, one)
    for month, member in ((1, "extra"), (2, "extra"), (3, "pressure")):
        p = os.path.join(base, "year=2024", f"month={month}", f"member={member}")
        os.makedirs(p, exist_ok=True)
        with open(os.path.join(p, "part-0.parquet"), "w") as fh:
            fh.write("not a table")
    rows = FS.member_catalog(spark, base)
    assert sorted(rows.columns) == ["member", "month", "year"]
    assert {(r.month, r.member) for r in rows.collect()} >= {(2, "extra"), (3, "pressure"), (1, "accum")}
    assert FS.complete_units(rows, ["year", "month"], FS.REANALYSIS_MEMBERS, strict=False) == [202401]
    got = FS.read_reanalysis(spark, base, strict=False)
    assert got["accum"].count() == got["instant"].count() == 1
    with pytest.raises(FS.IncompleteMonthError, match="202403"):
        FS.read_reanalysis(spark, base)


def test_manifest_beside_the_runs_filters_the_scan(spark, scratch):
    from wxframe.operators import merge as M
    path = os.path.join(scratch, "runs")
    t0 = dt.datetime(2024, 1, 1)

    def run(day, value, hours=10):
        rows = [(dt.date(2024, 1, day), t0 + dt.timedelta(days=day - 1, hours=h), float(c), value) for h in range(hours) for c in range(3)]
        return spark.createDataFrame(rows, "file_date date, time timestamp_ntz, cell double, v double")

    def add(df):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_date").parquet(path)
        FS.write_manifest(df, path)

    add(run(1, 1.0, hours=30))
    add(run(2, 2.0))
    runs = spark.read.parquet(path)
    assert "_manifest" not in "".join(runs.inputFiles())
    out = M.dedupe_runs(runs, manifest=FS.read_manifest(spark, path))
    want = M.dedupe_runs(runs)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert out.count() == 3 * (30 + 4) and out.where("v = 2.0").count() == 3 * 4
    add(run(1, 1.5, hours=3))                                # an earlier run is written again, shorter
    out = M.dedupe_runs(spark.read.parquet(path), manifest=FS.read_manifest(spark, path))
    assert {(r.v, r["count"]) for r in out.groupBy("v").count().collect()} == {(1.5, 9), (2.0, 30)}


def test_deduplicated_runs_are_not_shuffled(spark):
    from wxframe.operators import merge as M
    from wxframe.plans.registry import Views
    runs = Views(spark, "/root/testdata/sf0.001").runs
    plain = runs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    plan = M.dedupe_runs(runs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == plain
