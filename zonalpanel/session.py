"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator counts on. Join strategy is left to Catalyst
# and AQE: no operator hints a broadcast of a table whose size it has not proven.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # population files in big5
    "spark.sql.legacy.javaCharsets": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "zonalpanel",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session for scripts and tests; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Scratch paths of each application that have not been released.
_WRITTEN: dict[str, list[str]] = defaultdict(list)
#: The path of each such table that is still in use.
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables, under the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder, else the context's checkpoint directory. Where
    neither is set a local temporary folder is used if all runs in one process, as in tests;
    on a cluster that would scatter the tables over machines, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="zonalpanel-")
    path = f"{base.rstrip('/')}/zonalpanel/{label}-{uuid.uuid4().hex}"
    _WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the scratch folder, so they are computed once.

    For a result that several branches of a plan read. The table has a short lineage and
    survives lost executors; ``release`` removes it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[result] = path
    return result


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that ``written`` returned and whose last reader is done."""
    for table in tables:
        spark = table.sparkSession
        path = _PATH_OF.pop(table)
        _WRITTEN[spark.sparkContext.applicationId].remove(path)
        _remove(spark, path)


def release(spark: SparkSession) -> int:
    """Remove the scratch tables that this application has written so far; returns how many.

    To be called once the results that read them have been used.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        _remove(spark, name)
    return len(paths)
