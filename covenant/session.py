"""Session construction and cluster-shared locations.

Library code never builds its own session: every operator takes DataFrames.
``build_session`` is for tests, the bench and command-line use.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings that matter at scale. AQE coalesces small shuffle partitions and
# splits skewed ones at run time; broadcast joins stay behind an explicit
# threshold so a dimension that grows with the data falls back to a
# sort-merge join instead of blowing up executor memory.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "covenant") -> SparkSession:
    """A session with the settings above. A master that the launcher set is kept; without one it is local.
    Shuffle partitions stay as configured unless given: adaptive execution merges small ones, but never adds any."""
    given = SparkConf()
    master = master or given.get("spark.master", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in SCALE_CONF.items():
        b = b.config(k, given.get(k, v))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared file system; it is read, never
    overridden. Only in local mode, where it may be unset, is a scratch folder
    created, set and removed at exit; elsewhere each machine has its own
    folders, so a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        d = tempfile.mkdtemp(prefix="covenant-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions have no local context
        return d
    if sc.getCheckpointDir() is None:   # set once; each call would add a new sub-folder
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for the files of one run; ``remove`` deletes it when its results are used up."""
    return shared_path(spark, f"runs/{name}-{uuid.uuid4().hex[:12]}")


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder that ``run_dir`` named, wherever it is stored."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df):
    """Cut lineage of a DataFrame consumed several times: a reliable checkpoint
    into the shared ``spark.checkpoint.dir`` (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside are deleted when each query ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
