"""What operators need of the session: the shared folder, tables cut from their lineage, and enough partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; set as the checkpoint folder.

    Only where it is unset and the session is local does a temporary folder take its place.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(folder)
    return folder or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its source is read by fewer tasks than there are cores (a file of one row group is read by one)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
