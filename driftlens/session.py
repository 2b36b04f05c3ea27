"""Session helpers: settings for large runs and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings worth having on a cluster. AQE picks broadcast joins from measured shuffle sizes, splits skewed join
# partitions and merges small ones, so no operator in this package hints a broadcast by hand.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("driftlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for durable intermediates: the one the cluster names in ``spark.checkpoint.dir``.

    A session without that setting, as in tests, gets a folder of its own; that needs a master on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="driftlens-")
    return folder


_runs: dict[str, list[str]] = {}


def run_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, remembered until ``drop_run``."""
    path = f"{shared_folder(spark).rstrip('/')}/driftlens/{label}-{uuid.uuid4().hex}"
    _runs.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_run(spark: SparkSession) -> int:
    """Delete what the session has staged so far and return its size in bytes. For the end of a job, when its results
    are written."""
    return sum(_delete(spark, path) for path in _runs.pop(spark.sparkContext.applicationId, []))


def staged_paths(spark: SparkSession) -> list[str]:
    """What the session has staged so far and not yet deleted."""
    return list(_runs.get(spark.sparkContext.applicationId, []))


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete some of the session's staged paths; others are passed over."""
    kept = _runs.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in kept:
            kept.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return 0
    size = system.getContentSummary(place).getLength()
    system.delete(place, True)
    return size


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing will read again, before its job ends."""
    spark = staged.sparkSession
    kept = _runs.get(spark.sparkContext.applicationId, [])
    for folder in {file.rpartition("/")[0] for file in staged.inputFiles()}:
        path = next((path for path in kept if folder.endswith(path.rpartition("/")[2])), None)
        if path:
            kept.remove(path)
            _delete(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor never recomputes more than one stage, and gives later joins the real
    size of the table, from which Spark decides whether it may be broadcast.
    """
    spark = df.sparkSession
    path = run_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
