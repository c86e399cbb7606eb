"""Session defaults for batch and streaming jobs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ZONE = "America/New_York"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(name: str, streaming: bool = False, time_zone: str = ZONE, watermark_policy: str = "min", **conf: str) -> SparkSession:
    """A session in the given zone; a master that spark-submit or SPARK_MASTER names is kept.

    Adaptive execution sizes batch shuffles. Streaming keeps state in RocksDB, off the heap; watermark_policy ``max`` lets
    an outer stream join go on when one side stalls, and drops that side's late rows.
    """
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", time_zone)
    if master := os.environ.get("SPARK_MASTER"):
        builder = builder.master(master)
    elif "SPARK_ENV_LOADED" not in os.environ:
        builder = builder.master("local[*]")
    options = {"spark.sql.adaptive.enabled": "true"}
    if streaming:
        options |= {
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.multipleWatermarkPolicy": watermark_policy,
        }
    for key, value in (options | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_path(query: str) -> str:
    """Each query has its checkpoint folder of its own under CHECKPOINT_DIR, or under the shared folder where that is not set."""
    root = os.environ.get("CHECKPOINT_DIR")
    if root is None:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("no CHECKPOINT_DIR and no session that names a shared folder")
        root = f"{shared_folder(spark)}/checkpoints"
    return f"{root.rstrip('/')}/{query}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder of the session. Only a session within one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="zonecast-")
        atexit.register(remove, spark, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is, unless the session is over."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder in the shared one; it goes at the end of the process."""
    path = f"{shared_folder(spark)}/zonecast-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path
