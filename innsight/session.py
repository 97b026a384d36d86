"""Session helpers: a local session for tests and benches, and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "innsight") -> SparkSession:
    """A local session configured the way the library expects a cluster to be.

    On a cluster the caller passes its own session; only the SQL settings below
    matter there (ANSI on, UTC, adaptive execution with skew handling).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("INNSIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    scratch = tempfile.mkdtemp(prefix="innsight-")  # one machine: its own folder is shared
    builder = builder.config("spark.checkpoint.dir", f"{scratch}/checkpoints").config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# SQL settings for a large cluster (hundreds of executors, ~100 TB of input).
# Scans: 256 MB splits keep a 100 TB read near 400k tasks.  Shuffles: reports
# shuffle little (map-side partial aggregation), so a moderate partition count
# serves them, and adaptive execution coalesces it further.  The keyed email and
# the full-row product de-duplication move whole tables: for a job over those,
# pass a higher spark.sql.shuffle.partitions (about input / 256 MB) in overrides.
SCALE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.shuffle.partitions": "2000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def apply_scale_conf(spark: SparkSession, overrides: dict[str, str] | None = None) -> None:
    """Set :data:`SCALE_CONF` (plus ``overrides``) on a cluster session.

    Only runtime SQL settings; executor sizing stays with the cluster's own
    configuration.  A setting the session already has explicitly is kept.
    """
    for key, value in {**SCALE_CONF, **(overrides or {})}.items():
        if overrides and key in overrides:
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    ``spark.checkpoint.dir`` names a folder all executors share and is used as
    is.  Where it is unset, a folder in the session's warehouse is set, which
    executors share as well.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        conf = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(conf or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's (shared) checkpoint directory.

    Used where one cleaned frame feeds several reports of a batch: the reports
    then read the checkpoint instead of recomputing the scan and cleaning, and
    a lost executor does not send them back to the source tables.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
