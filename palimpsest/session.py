"""Session settings that the operators' semantics rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "palimpsest", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the submitter's settings win.

    Partition counts are left to the cluster: adaptive execution coalesces small shuffle
    partitions and splits skewed ones, so ``spark.sql.shuffle.partitions`` is best set to a
    few times the number of cores.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): v for k, v in more.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """Where checkpoints go: what ``spark.checkpoint.dir`` names, which all executors share.

    Only a session on one machine may do without that setting, and gets a temporary folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palimpsest-"))
    return context._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in the folder of checkpoints."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def keep_table(df: DataFrame) -> DataFrame:
    """As :func:`keep`, for many rows: as Parquet in the folder of checkpoints, where they take a fraction of a checkpoint's disk.

    What was shuffled to make them is no longer needed, but goes only when the driver collects
    its garbage, so it is told to.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
