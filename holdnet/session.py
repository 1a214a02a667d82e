"""Session helpers.

Library code never creates its own session; tests, bench and the entry module
use :func:`build_session`.  Checkpoints go to the folder the cluster names in
``spark.checkpoint.dir``; only a local-mode session without that setting gets a
scratch folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of iterative operators are removed once the driver drops the DataFrame
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "holdnet",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf and master.startswith("local"):
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="holdnet-ckpt-")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, registered from ``spark.checkpoint.dir`` on first use.

    On a cluster the setting must name a shared folder.  Only a local-mode session
    built elsewhere without it (one machine, one disk) gets a scratch folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        configured = tempfile.mkdtemp(prefix="holdnet-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the session's checkpoint folder (shared by driver and executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Setting by which a query gives up its shuffle files as it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give up their shuffle files as they end; else these stay until the driver collects garbage.

    For queries whose result is written or collected and whose plan is not run again.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def pin(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a new ``df`` that computes it once: kept on disk while the checkpoint is written."""
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.DISK_ONLY)
    try:
        return df.checkpoint()
    finally:
        df.unpersist()


def written(df: DataFrame, label: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` written once to a new folder below the checkpoint folder, as Parquet, and read from there.

    For tables whose partitioning no later step uses: columnar and compressed, a fraction of the checkpoint of :func:`pin`.
    The shuffles that made it are dropped once it is there.
    """
    path = shared_folder(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
