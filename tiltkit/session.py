"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tiltkit",
                  driver_memory: str = "4g", extra: dict | None = None) -> SparkSession:
    """A local session with AQE on and the web UI off (tests and bench only)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call-site capture per Column call (driver-side cost only)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when none is set.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system), and a session that names none is an error. Only a local
    master (tests, bench) gets a fresh temporary folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the setting)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tiltkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def materialize(df):
    """Reliable checkpoint in the session's checkpoint folder (runs a job).

    Later uses re-read the written rows instead of recomputing the lineage,
    and the lineage is cut, so a lost executor does not replay it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

