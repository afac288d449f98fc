"""Spark session and shared-storage helpers.

The library never creates a session inside an operator: every operator takes
DataFrames.  ``get_session`` is only a convenience for scripts, tests and the
benchmark.  ``checkpoint_dir`` resolves the *shared* folder the cluster names
in ``spark.checkpoint.dir``; a private folder is only created when that
setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "turnstile") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TURNSTILE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach (HDFS/S3/...).  We read it from the session; only when it is missing
    and the master is local (tests) do we fall back to a fresh folder of our
    own.  On a cluster a machine-local folder would lose rows, so there a
    missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="turnstile-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/turnstile-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path in the application's scratch folder for materialised tables."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; frames that read them can't be used afterwards.

    Call it when the results of a job have been written (``scratch`` does so at the end of a block).
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Block that owns the scratch tables made in it."""
    try:
        yield
    finally:
        clear_scratch(spark)


def materialize(df, name: str):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder and read it back.

    One job writes the data (a reliable ``checkpoint()`` would compute the
    plan twice and store Java-serialised rows); later reads prune columns.
    Values computed in the write (ids, partition tags) are stored, so they
    stay fixed however the files are split on read or if executors are lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
