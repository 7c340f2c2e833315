"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "pathpulse", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators assume; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # feature rows cost far more time than bytes, so small shuffles stay spread out
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        # a segment is one array row of up to 900 frames, so Arrow batches stay small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``checkpoint()``: the shared one named in ``spark.checkpoint.dir``.

    A session inside one process may go without and gets a scratch folder; executors elsewhere could not read one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and context.master.split("[")[0] != "local":
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pathpulse-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it again: small on disk, read by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
