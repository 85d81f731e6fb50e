"""Hand-made edge cases for the exact rules of each operator."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wxframe.functions.columns import flip_angle, round6, wind_angle, wind_speed
from wxframe.operators import anomaly as A
from wxframe.operators import levels as L
from wxframe.operators import reshape as R
from wxframe.operators import select as S
from wxframe.operators import spatial as G
from wxframe.operators import timegrid as TG
from wxframe.operators import units as U


def T(s):
    return dt.datetime.fromisoformat(s)


def test_duplicate_time_keeps_first_in_file_order(spark):
    df = spark.createDataFrame([("S1", T("2024-01-01 00:00"), 1.0, 0), ("S1", T("2024-01-01 00:00"), 2.0, 1)],
                               "station string, time timestamp_ntz, v double, event_id long")
    out = TG.dedupe_time(df, ["station"], "time", "event_id").collect()
    assert [r.v for r in out] == [1.0]


def test_level_tie_takes_first_in_stored_order(spark):
    df = spark.createDataFrame([(1, 800, 1.0), (1, 900, 2.0)], "k int, level int, r double")
    out = L.flatten_levels_nearest(df, ["k"], ["r"], [850]).collect()[0]
    assert out.r850 == 1.0
    out = L.flatten_levels_nearest(df, ["k"], ["r"], [850], descending=True).collect()[0]
    assert out.r850 == 2.0


def test_flatten_without_level_column_is_empty(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, r double")
    assert L.flatten_levels(df, ["k"], ["r"], [500]).count() == 0


def _hourly(spark, values, var="v"):
    rows = [(0.0, 0.0, T(f"2024-01-01 {h:02d}:00"), v) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, f"latitude double, longitude double, time timestamp_ntz, {var} double")


def _at(df, hhmm, var="v"):
    r = df.where(F.col("time") == F.lit(f"2024-01-01 {hhmm}").cast("timestamp_ntz")).collect()
    return r[0][var]


def test_label_fill_keeps_a_null_hour_null(spark):
    out = TG.interpolate_grid(_hourly(spark, [1.0, None, 3.0]), ["latitude", "longitude"], ffill=["v"])
    assert _at(out, "00:45") == 1.0
    assert _at(out, "01:15") is None
    assert _at(out, "02:45") == 3.0
    assert out.count() == 12


def test_precipitation_spread_conserves_the_hour(spark):
    out = TG.interpolate_grid(_hourly(spark, [4.0, 0.0]), ["latitude", "longitude"], spread=["v"])
    assert [_at(out, f"00:{m:02d}") for m in (0, 15, 30, 45)] == [1.0, 1.0, 1.0, 1.0]


def test_linear_is_null_after_the_last_hour(spark):
    out = TG.interpolate_grid(_hourly(spark, [0.0, 4.0]), ["latitude", "longitude"], linear=["v"])
    assert _at(out, "00:30") == 2.0
    assert _at(out, "01:00") == 4.0
    assert _at(out, "01:15") is None and _at(out, "01:45") is None


def test_linear_null_bracket_gives_null(spark):
    out = TG.interpolate_grid(_hourly(spark, [0.0, None, 2.0]), ["latitude", "longitude"], linear=["v"])
    assert _at(out, "00:30") is None and _at(out, "01:30") is None


def test_pchip_flat_peak_has_no_overshoot(spark):
    out = TG.interpolate_grid(_hourly(spark, [0.0, 1.0, 1.0, 0.0]), ["latitude", "longitude"], pchip=["v"])
    vals = [r.v for r in out.collect()]
    assert max(vals) <= 1.0 + 1e-12
    assert _at(out, "01:00") == 1.0 and _at(out, "02:00") == 1.0
    assert _at(out, "01:30") == pytest.approx(1.0)


def test_pchip_monotone_data_stays_within_knots(spark):
    ys = [0.0, 0.5, 3.0, 3.2, 7.0, 7.1]
    out = TG.interpolate_grid(_hourly(spark, ys), ["latitude", "longitude"], pchip=["v"])
    rows = sorted(out.collect(), key=lambda r: r.time)
    vals = [r.v for r in rows][: 4 * (len(ys) - 1) + 1]
    assert all(b >= a - 1e-12 for a, b in zip(vals, vals[1:]))
    assert [vals[4 * i] for i in range(len(ys))] == ys


def test_pchip_two_knots_is_linear(spark):
    out = TG.interpolate_grid(_hourly(spark, [0.0, 4.0]), ["latitude", "longitude"], pchip=["v"])
    assert _at(out, "00:15") == pytest.approx(1.0)
    assert _at(out, "01:30") == pytest.approx(6.0)   # last segment extended


def test_next_period_buffer_extends_the_last_hour(spark):
    rows = [(0.0, 0.0, p, T(f"2024-01-01 {h:02d}:00"), float(h)) for p, h in ((0, 0), (0, 1), (1, 2), (1, 3))]
    df = spark.createDataFrame(rows, "latitude double, longitude double, period long, time timestamp_ntz, v double")
    out = TG.interpolate_grid(df, ["latitude", "longitude"], period_col="period", linear=["v"])
    first = out.where("period = 0")
    assert _at(first, "01:30") == 1.5                # interpolates towards the next period
    nob = TG.interpolate_grid(df, ["latitude", "longitude"], period_col="period", linear=["v"], buffer=False)
    assert _at(nob.where("period = 0"), "01:30") is None


def test_wind_direction_and_speed(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)], "u double, v double")
    out = df.select(round6(wind_angle("u", "v")).alias("a"), wind_speed("u", "v").alias("s")).collect()
    assert [r.a for r in out] == [90.0, 0.0, 270.0]
    assert [r.s for r in out] == [1.0, 1.0, 1.0]


def test_station_wind_nulls_and_flip(spark):
    st = spark.createDataFrame([("A", -20.0, 120.0)], "station string, lat double, lon double")
    wide = spark.createDataFrame([("A", T("2024-01-01 00:00"), None, None), ("A", T("2024-01-01 00:15"), 3.0, 200.0)],
                                 "station string, time timestamp_ntz, sp double, dg double")
    out = sorted(R.wind_frames(wide, st, "sp", "dg").collect(), key=lambda r: r.time)
    assert (out[0].speed, out[0].angle) == (0.0, 0.0)
    assert (out[1].speed, out[1].angle) == (3.0, 20.0)


def test_box_with_empty_lat_axis_applies_no_mask(spark):
    df = spark.createDataFrame([(-5.0, 120.0), (-8.0, 300.0)], "latitude double, longitude double")
    assert S.within_box_or_all(df).count() == 2
    df2 = spark.createDataFrame([(-20.0, 120.0), (-20.0, 300.0)], "latitude double, longitude double")
    assert S.within_box_or_all(df2).count() == 1


def test_time_slice_bare_end_date_covers_the_day(spark):
    df = spark.createDataFrame([(T("2024-01-02 23:59"),), (T("2024-01-03 00:00"),)], "time timestamp_ntz")
    assert S.time_slice(df, "2024-01-01", "2024-01-02").count() == 1


def test_missing_value_sentinel(spark):
    df = spark.createDataFrame([(9999.0,), (9999.2,), (1.0,)], "t2m double")
    out = [r.t2m for r in U.null_missing(df, {"t2m": 9999.0}).collect()]
    assert out == [None, 9999.2, 1.0]   # tolerance 1e-8 + 1e-5 * 9999


def test_forecast_unit_groups_match_level_names(spark):
    df = spark.createDataFrame([(300.0, 300.0, 10.0, 1.0)], "t2m double, t850 double, u10 double, z500 double")
    out, units = U.convert_units(df, {"temp": ["t"], "wind": ["u10", "u"]}, match="levels")
    r = out.collect()[0]
    assert r.t850 == pytest.approx(26.85) and r.t2m == 300.0 and r.u10 == pytest.approx(36.0) and r.z500 == 1.0
    assert units == {"t850": "degC", "u10": "km/h"}


def test_idw_at_a_station_returns_its_value(spark):
    pts = spark.createDataFrame([(1, -30.0, 120.0), (2, -30.5, 120.5)], "point_id long, lat double, lon double")
    st = spark.createDataFrame([("A", -30.0, 120.0, 1), ("B", -31.0, 121.0, 2)],
                               "station string, lat double, lon double, st_order long")
    obs = spark.createDataFrame([("A", T("2024-01-01 00:00"), 5.0), ("B", T("2024-01-01 00:00"), 7.0)],
                                "station string, time timestamp_ntz, value double")
    out = {r.point_id: r.value for r in G.idw(obs, pts, st).collect()}
    assert out[1] == 5.0
    assert 5.0 < out[2] < 7.0


def _series(spark, temps, solar=None, start="2024-01-01 00:00"):
    t0 = T(start)
    solar = solar or [1.0] * len(temps)
    rows = [("S", t0 + dt.timedelta(minutes=15 * i), temps[i], solar[i]) for i in range(len(temps))]
    return spark.createDataFrame(rows, "station string, time timestamp_ntz, airTemperature double, solarExposure double")


def test_rolling_median_edges_never_flag(spark):
    temps = [100.0, 0.0] + [0.0] * 40
    fr = A.anomaly_frame(_series(spark, temps))
    first = fr.where("_pos < 2").collect()
    assert not any(r.median_flag for r in first)


def test_spike_is_flagged_by_median_and_slope(spark):
    temps = [float(i % 3) * 0.01 for i in range(60)]
    temps[30] = 50.0
    fr = A.anomaly_frame(_series(spark, temps, start="2024-01-01 13:00"))
    hit = fr.where("_pos = 30").collect()[0]
    assert hit.median_flag and hit.slope_flag


def test_solar_with_two_valid_neighbours_is_unexplained(spark):
    temps = [0.0] * 20
    temps[10] = 40.0
    solar = [None] * 20
    solar[9], solar[10] = 1.0, 500.0
    fr = A.anomaly_frame(_series(spark, temps, solar))
    r = fr.where("_pos = 10").collect()[0]
    assert r.anomaly and not r.explained


def test_halo_blocks_match_whole_series(spark):
    temps = [math.sin(i / 3.0) * 5 + (20.0 if i % 37 == 0 else 0.0) for i in range(300)]
    solar = [None if i % 7 == 0 else float(i % 11) for i in range(300)]
    df = _series(spark, temps, solar, start="2024-01-01 05:00")
    cols = ["_pos", "dev", "change", "median_flag", "slope_flag", "zone_flag", "explained"]
    big = sorted(tuple(r) for r in A.anomaly_frame(df).select(*cols).collect())
    small = sorted(tuple(r) for r in A.anomaly_frame(df, block=7).select(*cols).collect())
    assert big == small


def test_hull_of_partition_hulls_is_the_hull(spark):
    import random
    rnd = random.Random(3)
    pts = [(f"P{i}", rnd.uniform(-35, -15), rnd.uniform(115, 128)) for i in range(400)]
    df = spark.createDataFrame(pts, "station string, lat double, lon double").repartition(7)
    hull = G.convex_hull(df).orderBy("seq").collect()
    corner = {r.station: (r.lon, r.lat) for r in hull}
    ring = [corner[r.station] for r in hull]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for a, b in zip(ring, ring[1:] + ring[:1]):
        assert all(turn(a, b, (lo, la)) > 0 for s, la, lo in pts if (lo, la) not in (a, b))
    assert ring[0] == min((lo, la) for _, la, lo in pts)
    assert hull[0].hull_type == "polygon"


def test_hull_does_not_depend_on_row_order(spark):
    import random
    rnd = random.Random(8)
    # shared places, places on one line, ties in both coordinates
    pts = [(f"P{i:03d}", -30.0 + (i % 7) * 0.1, 118.0 + (i % 11) * 0.1) for i in range(200)]
    seen = set()
    for k in range(3):
        rnd.shuffle(pts)
        df = spark.createDataFrame(pts, "station string, lat double, lon double").repartition(k + 1)
        seen.add(tuple((r.seq, r.station) for r in G.convex_hull(df).orderBy("seq").collect()))
    assert len(seen) == 1
    assert len(next(iter(seen))) == 4


def test_hull_by_group_and_on_a_line(spark):
    pts = [("a", f"A{i}", -30.0, 118.0 + i) for i in range(5)] + [("b", "B", -30.0, 118.0)]
    df = spark.createDataFrame(pts, "g string, station string, lat double, lon double")
    out = G.convex_hull(df, by=["g"]).orderBy("seq").collect()
    assert [(r.g, r.station, r.hull_type) for r in out] == [("a", "A0", "polyline"), ("a", "A4", "polyline")]


def test_overlay_keeps_equal_observations(spark):
    st = spark.createDataFrame([("A", -30.0, 120.0)], "station string, lat double, lon double")
    obs = spark.createDataFrame([("A", T("2024-01-01 03:20"), "t", 5.0)] * 2, "station string, time timestamp_ntz, variable string, value double")
    fc = spark.createDataFrame([(T("2024-01-01 00:00"), 3.0, -30.0, 120.0, 4.0), (T("2023-12-31 00:00"), 27.0, -30.0, 120.0, 9.0)],
                               "time timestamp_ntz, step double, latitude double, longitude double, x double")
    assert [(r.forecast, r.diff) for r in G.overlay(obs, st, fc, "t", "x").collect()] == [(4.0, 1.0)] * 2


def test_hull_of_two_points_is_a_polyline(spark):
    df = spark.createDataFrame([("A", -30.0, 120.0), ("B", -31.0, 121.0)], "station string, lat double, lon double")
    out = G.convex_hull(df).collect()
    assert len(out) == 2 and out[0].hull_type == "polyline"


def test_albers_known_point(spark):
    df = spark.createDataFrame([(-18.0, 132.0)], "lat double, lon double")
    r = G.project(df).collect()[0]
    assert abs(r.x) < 1e-6
    back = G.unproject(G.project(df).select("x", "y")).collect()[0]
    assert back.lat == pytest.approx(-18.0, abs=1e-9) and back.lon == pytest.approx(132.0, abs=1e-9)


def test_angle_flip(spark):
    df = spark.createDataFrame([(200.0,)], "a double")
    assert df.select(flip_angle("a").alias("b")).collect()[0].b == 20.0


def test_densify_blocks_match_whole_series(spark):
    rows = [("S", "v", T("2024-01-01 00:00") + dt.timedelta(minutes=15 * i), math.cos(i / 4.0) + (i % 5) * 0.1)
            for i in range(120) if i % 9 != 4]
    df = spark.createDataFrame(rows, "station string, variable string, time timestamp_ntz, value double")
    a = sorted(tuple(r) for r in TG.densify_pchip(df, ["station", "variable"]).collect())
    b = sorted(tuple(r) for r in TG.densify_pchip(df, ["station", "variable"], block=10).collect())
    assert a == b
    assert len(a) == (119 * 15) // 5 + 1


def test_station_wind_pair_becomes_one_display_variable(spark):
    from wxframe.operators import catalog as CT
    v = spark.createDataFrame([("airTemperature", 0), ("wind_3m_speed", 1), ("wind_3m_degN", 2), ("rainfall", 3)],
                              "name string, pos int")
    first = [r.display for r in CT.station_display_vars(v).orderBy("ord").collect()]
    last = [r.display for r in CT.station_display_vars(v, wind_first=False).orderBy("ord").collect()]
    assert first == ["wind_3m", "airTemperature", "rainfall"]
    assert last == ["airTemperature", "rainfall", "wind_3m"]


def test_forecast_display_vars_keep_or_drop_unpaired(spark):
    from wxframe.operators import catalog as CT
    v = spark.createDataFrame([("t2m", 0), ("u10", 1), ("v10", 2), ("u500", 3), ("msl", 4)], "name string, pos int")
    keep = [r.display for r in CT.display_vars(v).orderBy("ord").collect()]
    drop = [r.display for r in CT.display_vars(v, unpaired="drop").orderBy("ord").collect()]
    assert keep == ["wind10", "u500", "t2m", "msl"]
    assert drop == ["wind10", "t2m", "msl"]
    assert CT.default_var(CT.display_vars(v)).collect()[0].default_var == "t2m"


def test_align_merge_key_and_axis_modes(spark):
    from wxframe.operators import merge as M
    a = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (2, 10, 3.0)], "t int, x int, a double")
    b = spark.createDataFrame([(1, 10, 5.0, 9.0), (2, 20, 6.0, 9.0)], "t int, x int, b double, a double")
    key = M.align_merge([a, b], ["t", "x"]).collect()
    assert [(r.t, r.x, r.a, r.b) for r in key] == [(1, 10, 1.0, 5.0)]          # first member wins on "a"
    axis = sorted(tuple(r) for r in M.align_merge([a, b], ["t", "x"], align="axis").collect())
    # every axis value is shared, so the full cross of present cells survives with nulls where absent
    assert axis == [(1, 10, 1.0, 5.0), (1, 20, 2.0, None), (2, 10, 3.0, None), (2, 20, None, 6.0)]


def test_union_by_position_relabels_later_pieces(spark):
    from wxframe.operators import merge as M
    a = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    b = spark.createDataFrame([(3.0, 4.0)], "y double, x double")
    pos = sorted(tuple(r) for r in M.union_all([a, b], mode="position").collect())
    name = sorted(tuple(r) for r in M.union_all([a, b], mode="name").collect())
    assert pos == [(1.0, 2.0), (3.0, 4.0)] and name == [(1.0, 2.0), (4.0, 3.0)]


def test_select_variables_errors_when_none_present(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, a double")
    assert S.select_variables(df, ["k"], ["a", "zz"]).columns == ["k", "a"]
    with pytest.raises(S.NoVariablesError):
        S.select_variables(df, ["k"], ["zz"])


def test_series_unknown_station_is_an_error(spark):
    from wxframe.operators import series as SR
    obs = spark.createDataFrame([("S1", T("2024-01-01 00:00"), "airTemperature", 1.0)],
                                "station string, time timestamp_ntz, variable string, value double")
    with pytest.raises(SR.UnknownStationError):
        SR.series(obs, ["airTemperature"], station="S9")
    with pytest.raises(S.NoVariablesError):
        SR.series(obs, ["nope"], present=["airTemperature"])


def test_asof_join_carries_labels_across_days(spark):
    from wxframe.operators import merge as M
    right = spark.createDataFrame([(1, T("2024-01-01 10:00"), 1.0), (1, T("2024-01-03 05:00"), 3.0),
                                   (2, T("2024-01-02 00:00"), 9.0)], "k int, rt timestamp_ntz, v double")
    left = spark.createDataFrame([(1, T("2024-01-01 09:59")), (1, T("2024-01-01 10:00")), (1, T("2024-01-02 12:00")),
                                  (1, T("2024-01-03 05:00")), (2, T("2024-01-05 00:00")), (3, T("2024-01-05 00:00"))],
                                 "k int, t timestamp_ntz")
    out = {(r.k, r.t): r.v for r in M.asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert out == {(1, T("2024-01-01 09:59")): None, (1, T("2024-01-01 10:00")): 1.0,
                   (1, T("2024-01-02 12:00")): 1.0, (1, T("2024-01-03 05:00")): 3.0,
                   (2, T("2024-01-05 00:00")): 9.0, (3, T("2024-01-05 00:00")): None}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_asof_join_splits_a_hot_key_and_a_hot_time(spark, batch):
    """One key and day, and one instant, hold most rows; they are several partitions and each finds its label."""
    import random
    from bisect import bisect_right
    from collections import Counter

    from wxframe.operators import merge as M
    rnd = random.Random(batch)
    t0 = T("2024-01-01 00:00")
    at = lambda s: None if s is None else t0 + dt.timedelta(seconds=s)
    right = [("hot", 20_000 + 7 * k, float(k)) for k in range(200)] + [("b", 5, -1.0), ("d", 10, None), (None, 1, 5.0), ("b", None, 7.0)]
    left = [("hot", rnd.randrange(19_000, 22_000)) for _ in range(1500)] + [("hot", 20_700)] * 1500 + [("hot", 86_400 * 40)] * 300
    left += [(rnd.choice(["a", "b", "c", "d", None]), rnd.choice([None, *range(20)])) for _ in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        l = spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(left)], "k string, t timestamp_ntz, i int").repartition(5)
        r = spark.createDataFrame([(k, at(s), v) for k, s, v in right], "k string, rt timestamp_ntz, v double").repartition(3)
        out = M.asof_join(l, r, ["k"], "t", "rt", ["v"])
        got = Counter((x.i, x.rt_matched, x.v) for x in out.collect())
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = {}
    for k, s, v in sorted((x for x in right if x[0] and x[1] is not None), key=lambda x: x[1]):
        known.setdefault(k, []).append((s, v))
    want = Counter()
    for i, (k, s) in enumerate(left):
        seen = known.get(k, []) if s is not None else []
        n = bisect_right([x[0] for x in seen], s) if seen else 0
        want[(i, at(seen[n - 1][0]), seen[n - 1][1]) if n else (i, None, None)] += 1
    assert got == want
    assert max(sizes) < len(left) / 3


def test_idw_in_small_blocks_equals_the_formula(spark):
    """Crowded and calm times, several values of a station, stations on points, blocks on both sides."""
    import random

    import numpy as np
    rnd = random.Random(6)
    st = [(f"S{k:03d}", -30.0 - rnd.random(), 120.0 + rnd.random()) for k in range(60)]
    pts = [(k, -30.0 - rnd.random(), 120.0 + rnd.random()) for k in range(25)] + [(100, *st[7][1:]), (101, *st[40][1:])]
    st += [("S999", *st[7][1:]), ("A000", *st[40][1:])]                    # two stations in one place: the first by name
    times = [T("2024-01-01 00:00"), T("2024-01-01 01:00"), T("2024-01-01 02:00")]
    obs = [(s, times[0], rnd.uniform(0, 30)) for s, *_ in st for _ in range(3)] + [(s, times[1], rnd.uniform(0, 30)) for s, *_ in st[:4]]
    obs += [(s, times[2], 9.0) for s in ("S007", "S040", "A000", "nowhere")] + [("S001", times[2], None), ("S002", times[2], float("nan"))]
    df = [spark.createDataFrame(rows, schema) for rows, schema in (
        (obs, "station string, time timestamp_ntz, value double"), (pts, "point_id long, lat double, lon double"),
        (st, "station string, lat double, lon double"))]
    xy = {r.station: (r.x, r.y) for r in G.project(df[2]).collect()}
    want = {}
    for r in G.project(df[1]).collect():
        for t in times:
            told = [(s, v) for s, u, v in obs if u == t and s in xy and v is not None and v == v]
            d = np.array([math.hypot(r.x - xy[s][0], r.y - xy[s][1]) for s, _ in told])
            on = sorted((s, v) for (s, v), k in zip(told, d) if k < 1e-6)
            w = 1 / (d + 1e-6) ** 2
            want[t, r.point_id] = on[0][1] if on else float((w * [v for _, v in told]).sum() / w.sum())
    for point_block, station_block in ((2048, 2048), (4, 5), (1, 1), (7, 61)):
        got = G.idw(*df, point_block=point_block, station_block=station_block).collect()
        assert len(got) == len(want)
        assert all(math.isclose(r.value, want[r.time, r.point_id], rel_tol=1e-9) for r in got)


def test_idw_ignores_silent_stations_and_handles_gaps(spark):
    pts = spark.createDataFrame([(1, -30.2, 120.3)], "point_id long, lat double, lon double")
    st = spark.createDataFrame([("A", -30.0, 120.0, 1), ("B", -31.0, 121.0, 2), ("C", -29.0, 119.0, 3)],
                               "station string, lat double, lon double, st_order long")
    obs = spark.createDataFrame([("A", T("2024-01-01 00:00"), 5.0), ("B", T("2024-01-01 00:00"), 7.0),
                                 ("A", T("2024-01-01 01:00"), 6.0), ("B", T("2024-01-01 01:00"), None)],
                                "station string, time timestamp_ntz, value double")
    both = {r.time: r.value for r in G.idw(obs, pts, st).collect()}
    without = {r.time: r.value for r in G.idw(obs, pts, st.where("station <> 'C'")).collect()}
    assert both == without                                # C never reports: same result without it
    assert both[T("2024-01-01 01:00")] == 6.0              # only A is usable at 01:00


def test_hot_station_is_split_into_blocks(spark):
    from wxframe.operators.windows import series_positions, with_halo
    rows = [("HOT", T("2024-01-01 00:00") + dt.timedelta(minutes=15 * i), float(i)) for i in range(1000)]
    rows += [("COLD", T("2024-01-01 00:00"), 0.0)]
    df = spark.createDataFrame(rows, "station string, time timestamp_ntz, v double")
    pos = series_positions(df, ["station"], "time")
    assert sorted(r._pos for r in pos.where("station = 'HOT'").collect()) == list(range(1000))
    blocks = with_halo(pos, halo=4, block=100)
    hot = blocks.where("station = 'HOT'").groupBy("_blk").agg(F.count("*").alias("n"), F.count_if("_core").alias("core"))
    per_block = {r._blk: (r.n, r.core) for r in hot.collect()}
    assert sorted(b for b, (_, core) in per_block.items() if core) == list(range(10))
    assert all(core == 100 for _, core in per_block.values() if core)
    assert max(n for n, _ in per_block.values()) <= 100 + 2 * 4     # block plus halos on both sides
    plan = A.anomaly_frame(df.withColumnRenamed("v", "airTemperature"), solar=None, block=100) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "_blk" in plan                                  # windows are partitioned by (station, block)


@pytest.mark.parametrize("pick", ["slice_field", "frame_range", "thin"])
def test_axis_picks_do_not_shuffle_the_field(spark, pick, tmp_path):
    from wxframe.operators import display as D
    from wxframe.operators import select as S
    rows = [(T("2024-01-01 00:00") + dt.timedelta(hours=h), float(s), -30.0 - i, 115.0 + j, h + s + i + j * 1.0)
            for h in range(4) for s in (0, 3) for i in range(3) for j in range(4)]
    spark.createDataFrame(rows, "time timestamp_ntz, step double, latitude double, longitude double, v double") \
        .write.parquet(str(tmp_path / "grid"))
    df = spark.read.parquet(str(tmp_path / "grid"))
    out = {"slice_field": lambda: S.slice_field(df, 1, 9), "frame_range": lambda: S.frame_range(df, 1, 2),
           "thin": lambda: D.thin(df, 2)}[pick]()
    assert out.count() == {"slice_field": 12, "frame_range": 48, "thin": 32}[pick]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    main = out._jdf.queryExecution().explainString(mode).split("===== Subqueries")[0]
    assert "Exchange" not in main and "Scan parquet" in main


def test_resolution_counts_by_bitmaps(spark):
    """Distinct instants, whatever their grid, and one evaluation of each dataset."""
    from wxframe.operators import stats as ST
    t0 = T("1969-12-30 23:59:00")
    a = [(f"S{k % 3}", t0 + dt.timedelta(minutes=15 * (k // 3))) for k in range(300)] + [("S0", None), (None, t0)]
    b = [(f"S{k % 4}", t0 + dt.timedelta(seconds=7.25 * (k % 1000))) for k in range(5000)]
    da, db = (spark.createDataFrame(r, "station string, time timestamp_ntz") for r in (a, b))
    r = ST.compare_resolution(da, db).collect()[0]
    assert (r.steps_a, r.stations_a, r.points_a) == (100, 3, 302)
    assert (r.steps_b, r.stations_b, r.points_b) == (1000, 4, 5000) and r.growth == round(5000 / 302, 6)
    none = ST.compare_resolution(da, db.limit(0)).collect()[0]
    assert (none.steps_b, none.stations_b, none.points_b) == (0, 0, 0)
    plan = ST.compare_resolution(da, db)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan          # only the stored bitmaps are read


def test_station_without_coordinates_is_an_error(spark):
    obs = spark.createDataFrame([("A", 1.0), ("ghost", 2.0)], "station string, v double")
    st = spark.createDataFrame([("A", -30.0, 120.0, "a")], "station string, lat double, lon double, code string")
    with pytest.raises(Exception, match="no coordinates for station ghost"):
        R.attach_coords(obs, st).collect()
    assert [tuple(r) for r in R.attach_coords(obs, st, unknown="drop").collect()] == [("A", 1.0, -30.0, 120.0, "a")]
    assert [tuple(r) for r in R.attach_coords(obs.where("v < 2"), st).collect()] == [("A", 1.0, -30.0, 120.0, "a")]
    with pytest.raises(Exception, match="no coordinates for station null"):
        R.attach_coords(spark.createDataFrame([(None, 1.0)], obs.schema), st).collect()


def test_shared_limits_skip_what_is_not_there(spark):
    from wxframe.operators import catalog as CT
    obs = spark.createDataFrame([("airTemperature", 5.0), ("airTemperature", float("inf")), ("dewPoint", None)], "variable string, value double")
    grid = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0)], "t2m double, d2m double")
    assert [tuple(r) for r in CT.shared_limits(obs, grid).collect()] == [("t2m", "airTemperature", 1.0, 5.0)]
    assert CT.shared_limits(obs, grid.drop("t2m", "d2m")).collect() == [] == CT.shared_limits(obs.limit(0), grid).collect()
