"""Lineage cuts between dependent steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one the cluster names, or a scratch folder when Spark
    runs in a single process and none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quadloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder and read again: survives lost executors, unlike rows kept in
    executor storage. Written by column and compressed, so that the repeated parts of terms take next to
    nothing, and a later step reads only the columns it needs."""
    folder = ensure_checkpoint_dir(df.sparkSession)
    if "void" in df.schema.simpleString():  # has no column format
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_cut(df: DataFrame) -> DataFrame:
    """For short programs whose plan may stay in one piece."""
    return df
