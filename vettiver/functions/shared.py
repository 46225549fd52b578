"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only local sessions without one get a folder of their own.

    A cluster session without the setting raises ``ValueError``: a machine-local folder would lose data
    with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vettiver-checkpoint-")
    context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now and go on from the written rows.

    A lost executor cannot lose them, and what follows does not run the plan above them again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over all shuffle partitions by ``columns``: for work on rows that weighs more than their bytes.

    Adaptive execution joins partitions by their bytes; texts of a few megabytes would be worked on in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
