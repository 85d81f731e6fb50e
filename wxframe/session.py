"""Spark session settings shared by the library, tests and bench.

Nothing here is tuned for a single laptop: shuffle width comes from AQE's
advisory partition size, broadcast decisions come from runtime statistics
(AQE converts a sort-merge join to a broadcast join only when the shuffled
side is measured to be below the threshold), and skewed join keys are split
by AQE's skew-join handling.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Sizes are per-partition targets, valid at any data scale.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # size-driven coalescing: post-shuffle partitions follow the advisory size
    # instead of staying at the initial partition count for small stages
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Dimension tables whose file size is known to be below 64 MB are broadcast
    # at plan time, so the fact side of the join is not shuffled; AQE decides
    # the rest from measured shuffle sizes.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "wxframe",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library defaults.

    ``master`` is only applied when given (tests / bench use ``local[N]``);
    on a cluster the submitter decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.  Where it is unset, a local
    session (tests) gets a scratch folder; on a cluster that is an error, as
    executors could not read what others wrote."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith(("local[", "local")) \
                or spark.conf.get("spark.master", "local").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="wxframe-ckpt-", dir=os.environ.get("WXFRAME_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there: lineage is cut, a lost executor costs
    nothing, and later steps read only the columns they need."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once per application; a local
    session's workers find it where the driver does (``PYTHONPATH``)."""
    import shutil

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="wxframe-ship-"), "wxframe")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "wxframe"))
    _SHIPPED.add(app)
