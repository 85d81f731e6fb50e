"""Incremental station-file ingest with Structured Streaming.

Station CSVs land month by month.  Every micro-batch writes the rows of its new
files to a folder of its own (``batch=<id>``, overwritten when a batch is tried
again), so a restarted job writes nothing twice.  First-in-file de-duplication
needs all batches and is part of :func:`ingested`; the result does not depend on
how files fell into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import keep_known
from ..operators.timegrid import dedupe_time, shift_time
from ..session import ensure_checkpoint_dir
from ..sources.files import parse_station_files, station_glob


def station_stream(spark: SparkSession, root: str) -> DataFrame:
    """Streaming scan of ``root/YYYYMM/*.csv*``, one row per file."""
    return spark.readStream.format("text").option("wholetext", True).load(station_glob(root))


def start_ingest(spark: SparkSession, root: str, out_path: str, stations: DataFrame | None = None,
                 checkpoint: str | None = None, shift_hours: float = 16, trigger_once: bool = True):
    """Start the ingest query (rows of ``stations`` only, if given); returns the StreamingQuery."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/station-ingest"

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = keep_known(df, stations) if stations is not None else df
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    rows = shift_time(parse_station_files(station_stream(spark, root)), "time", hours=shift_hours)
    w = rows.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="5 minutes")).start()


def ingested(spark: SparkSession, out_path: str) -> DataFrame:
    """What has been ingested so far, each (station, time) once: the first in month, file and file order."""
    return dedupe_time(spark.read.parquet(out_path).drop("batch"), ["station"], "time", "_ingest").drop("_ingest")
