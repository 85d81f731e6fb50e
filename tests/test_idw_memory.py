"""Inverse-distance fill: what a task holds does not grow with the rows it gets."""

import tracemalloc

import numpy as np
import pyarrow as pa

from wxframe.operators import spatial as G


def blocks(times, stations, points):
    rng = np.random.default_rng(5)
    o = [{"station": f"s{k:05d}", "s": float(v), "n": 1.0, "v": float(v), "sx": float(x), "sy": float(y)}
         for k, (v, x, y) in enumerate(zip(rng.normal(size=stations), *rng.uniform(0, 1e6, (2, stations)), strict=True))]
    p = [{"point_id": k, "px": float(x), "py": float(y)} for k, (x, y) in enumerate(rng.uniform(0, 1e6, (points, 2)))]
    p[7] |= {"px": o[3]["sx"], "py": o[3]["sy"]}
    return o, p, pa.RecordBatch.from_arrays([pa.array(range(times)), pa.array([o] * times), pa.array([p] * times)], names=["_t", "o", "p"])


def test_a_task_holds_few_distances_and_gives_rows_one_by_one():
    o, p, batch = blocks(3, 2048, 2048)
    tracemalloc.start()
    out = list(G._idw_blocks(2.0, 1e-6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.num_rows for b in out] == [1, 1, 1] and [b.column(0)[0].as_py() for b in out] == [0, 1, 2]
    assert peak < 6 * 8 * G.DISTANCES + (4 << 20)
    got = out[2].column(1)[0].as_py()
    assert [r["point_id"] for r in got] == list(range(2048))
    assert [r["station"] for r in got if r["station"]] == ["s00003"] and got[7]["v"] == o[3]["v"]
    for k in (0, 500, 2047):
        w = [1 / (np.hypot(s["sx"] - p[k]["px"], s["sy"] - p[k]["py"]) + 1e-6) ** 2 for s in o]
        assert np.isclose(got[k]["den"], sum(w)) and np.isclose(got[k]["num"], sum(a * s["s"] for a, s in zip(w, o, strict=True)))
