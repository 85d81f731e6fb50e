"""Joins and set operations: align/merge of members, station lists, unions, runs."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir, stored
from . import select as S


def align_merge(members, keys, align: str = "key") -> DataFrame:
    """Inner-align members on all shared key columns; on equal variable names
    the first member wins.

    ``align='key'``: inner equi-join on the keys (dense cubes).
    ``align='axis'``: keep each axis value present in every member, then a
    full outer join so cells absent from one member become null.
    """
    keys = list(keys)
    members = list(members)
    if align == "axis":
        axes = []
        for k in keys:
            common = reduce(lambda a, b: a.join(b, k, "inner"),
                            [m.select(k).distinct() for m in members])
            axes.append((k, common))
        trimmed = []
        for m in members:
            for k, common in axes:
                m = m.join(common, k, "left_semi")
            trimmed.append(m)
        members, how = trimmed, "full"
    else:
        how = "inner"
    seen = set(keys)
    out = None
    for m in members:
        cols = [c for c in m.columns if c not in seen]
        seen.update(cols)
        m = m.select(*keys, *cols)
        out = m if out is None else out.join(m, keys, how)
    return out


def keep_known(obs: DataFrame, stations: DataFrame, station_col: str = "station") -> DataFrame:
    """Rows of stations that appear in the station list (semi-join)."""
    return obs.join(stations.select(station_col), station_col, "left_semi")


def missing_stations(stations: DataFrame, obs: DataFrame, station_col: str = "station") -> DataFrame:
    """Listed stations with no row in the dataset (anti-join)."""
    return stations.join(obs.select(station_col).distinct(), station_col, "left_anti")


def union_all(dfs, mode: str = "name") -> DataFrame:
    """Union pieces.

    ``mode='name'``: match columns by name, missing columns are null.
    ``mode='position'``: later pieces are relabelled with the first piece's
    header by position (the behaviour of concatenating headerless files).
    """
    dfs = list(dfs)
    if mode == "position":
        head = dfs[0].columns
        return reduce(lambda a, b: a.union(b.toDF(*head)), dfs[1:], dfs[0])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs[1:], dfs[0])


def load_date_range(runs: DataFrame, start, end, file_date: str = "file_date",
                    time_col: str = "time", span_days: int = C.RUN_FILE_SPAN_DAYS) -> DataFrame:
    """Runs whose file may cover [start, end] (file_date <= end and
    file_date + span >= start), then the inclusive time slice.

    Both predicates are on the partition column, so a partitioned scan prunes
    whole run folders.
    """
    d0 = _to_date(start)
    d1 = _to_date(end)
    fd = F.col(file_date)
    pruned = runs.where((fd <= F.lit(d1)) & (fd >= F.lit(d0 - _dt.timedelta(days=span_days))))
    return S.time_slice(pruned, start, end, time_col)


def _to_date(v) -> _dt.date:
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])


MANIFEST_ROWS = 4_000_000       # a manifest of up to so many rows (16 bytes each) is broadcast


def run_manifest(runs: DataFrame, file_date: str = "file_date", time_col: str = "time") -> DataFrame:
    """(time, file_date): the earliest file of each time, one row per time.  Reads two columns."""
    return runs.groupBy(time_col).agg(F.min(file_date).alias(file_date))


def dedupe_runs(runs: DataFrame, file_date: str = "file_date", time_col: str = "time",
                manifest: DataFrame | None = None) -> DataFrame:
    """After concatenating runs, each time keeps the whole slab of the earliest file.

    The manifest of the runs decides, as a filter on the scan: it is counted, and broadcast while it has at most
    ``MANIFEST_ROWS`` rows (some centuries of hourly times), so the runs are never shuffled; beyond that it is joined.
    ``manifest``: the one kept beside the runs (``sources.files.read_manifest``); else it is made from them.
    """
    first = stored(run_manifest(runs, file_date, time_col)) if manifest is None else manifest.select(time_col, file_date)
    if first.count() <= MANIFEST_ROWS:
        first = F.broadcast(first)
    return runs.join(first, [time_col, file_date], "left_semi")


def available_dates(runs: DataFrame, file_date: str = "file_date") -> DataFrame:
    """Distinct run dates as ``yyyy-MM-dd`` labels (sort only for presentation)."""
    return runs.select(F.date_format(file_date, "yyyy-MM-dd").alias("run_date")).distinct()


def asof_join(left: DataFrame, right: DataFrame, by, left_time: str, right_time: str, right_cols) -> DataFrame:
    """Attach to each left row the latest right row (same ``by`` keys) at or before its time, a backward as-of join; no
    match, a null time or a null key give nulls.

    Both sides are cut into ranges of (keys, time), so a hot key or day is as many partitions as it needs, even when all
    its rows have one time.  Each partition carries its last right row forward by itself; what it must know from before is
    one row per partition: the last key there and the last right row of that key.  Those rows are as many as partitions,
    and the running last of them is broadcast.
    """
    by = list(by)
    rc = list(right_cols)
    ensure_checkpoint_dir(left.sparkSession)
    known = right.where(F.col(right_time).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    lab = F.struct(F.col(right_time).alias("_rt"), *[F.col(c).alias(c) for c in rc])
    r = known.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.xxhash64(*rc, right_time).alias("_salt"), lab.alias("_lab"))
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_k"), F.xxhash64(*left.columns).alias("_salt"),
                    F.struct(*left.columns).alias("_row"))
    order = [*by, "_t", "_k", "_salt"]
    u = r.unionByName(l, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order) \
        .checkpoint().withColumn("_pid", F.spark_partition_id())
    # one row per partition: first and last key, last right row of the last key
    key = F.struct(*by)
    last_of = u.groupBy("_pid", *by).agg(F.max_by("_lab", F.when(F.col("_k") == 0, F.struct("_t", "_salt"))).alias("_last"))
    ends = last_of.groupBy("_pid").agg(F.min(key).alias("_first_key"), F.max(key).alias("_last_key"),
                                       F.max_by(F.struct("_last"), key).alias("_end"))
    running = F.last("_end._last", ignorenulls=True).over(Window.partitionBy("_last_key").orderBy("_pid"))
    in_turn = Window.orderBy("_pid")
    carry = ends.withColumn("_run", running).select(
        "_pid", "_first_key", F.lag("_last_key").over(in_turn).alias("_key"), F.lag("_run").over(in_turn).alias("_carry")) \
        .where(F.col("_key") == F.col("_first_key")).where(F.col("_carry").isNotNull()).select("_pid", "_key", "_carry")

    kind = u.select(*by, "_pid", "_row", "_lab").schema
    found = u.select(*by, "_pid", "_k", "_row", "_lab").mapInArrow(_carry_forward(by), kind)
    open_rows = found.join(F.broadcast(carry.select("_pid", F.col("_key").alias("_ck"), "_carry")), "_pid", "left")
    m = F.coalesce(F.col("_lab"), F.when(F.struct(*by) == F.col("_ck"), F.col("_carry")))
    return open_rows.select("_row", m.alias("_m")).select(
        "_row.*", F.col("_m._rt").alias(f"{right_time}_matched"), *[F.col(f"_m.{c}").alias(c) for c in rc])


def _carry_forward(by):
    """Left rows of a sorted partition with the last right row of their key above them in the partition, if any."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, held_key = None, None                          # last right row so far and the key it belongs to
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            keys = pa.StructArray.from_arrays([cols[c] for c in by], names=by)
            new = np.zeros(n, bool)
            for c in by:
                a, b = cols[c].slice(1), cols[c].slice(0, n - 1)
                differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                new[1:] |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, 0))
            right = cols["_k"].to_numpy() == 0
            last = np.maximum.accumulate(np.where(right, at, -1))
            last = np.where(last >= begin, last, -1)
            labels = cols["_lab"]
            if held is not None and held_key == keys[0].as_py():
                labels = pa.concat_arrays([labels, held])
                last = np.where((last < 0) & (begin == 0), n, last)
            rows = np.flatnonzero(~right)
            take = pa.array(last[rows], mask=last[rows] < 0)
            yield pa.RecordBatch.from_arrays([*[cols[c].take(pa.array(rows)) for c in [*by, "_pid", "_row"]], labels.take(take)],
                                             names=[*by, "_pid", "_row", "_lab"])
            if last[-1] >= 0:
                held, held_key = labels.slice(int(last[-1]), 1), keys[n - 1].as_py()
            else:
                held = None

    return run
