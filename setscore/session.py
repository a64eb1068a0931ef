"""Spark session and lineage helpers.

Cluster settings (master, executor memory, ``spark.checkpoint.dir``) come
from the submitting environment. The builder here only fills in what is
unset, so the same code runs on ``local[N]`` in tests and on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Fixed session defaults for local runs; a cluster submit overrides them.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime size check for broadcasting a join side whose size is only known
    # after its shuffle stage ran (derived small tables)
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove reliable-checkpoint files once their data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "16g",
}


# Sizing for large inputs on a cluster, applied only where the submitter left a
# setting unset: large scan splits, a high initial shuffle width that AQE
# coalesces to ~256 MB partitions, and skew splitting for hot join keys.
CLUSTER_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "setscore") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    submitted = dict(SparkConf().getAll())
    for key, value in LOCAL_DEFAULTS.items():
        # driver memory is the whole of a local run only
        if key not in submitted and (key != "spark.driver.memory" or (master or submitted.get("spark.master", "local")).startswith("local")):
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        submitted = dict(spark.sparkContext.getConf().getAll())
        for key, value in CLUSTER_DEFAULTS.items():
            if key not in submitted and not (key == "spark.sql.shuffle.partitions" and shuffle_partitions):
                spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage (an
    error otherwise). Only a local-mode session without that setting (tests,
    bench) gets a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is not reachable by other executors
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        current = tempfile.mkdtemp(prefix="setscore-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        # spark.checkpoint.dir is a core setting (read-only at run time); the
        # context's checkpoint folder is set directly instead
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/setscore/{kind}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def file_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and modification times of a table's files: what a derived table depends on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))
