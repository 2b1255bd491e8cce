"""Cutting lineage in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; where it is unset make one on a single machine (tests), and raise on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-checkpoint-"))


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as a table under the checkpoint folder and read back, so later scans read only their columns.

    The session owns the table: plans made from it may run at any time until it ends, and with it the table is deleted.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from how it was computed, so a lost executor costs a read and loops plan from true sizes.

    A table is written instead of a checkpoint, as a checkpoint keeps the size the planner once guessed; over a loop of joins these guesses
    multiply, and planning alone comes to take seconds.
    """
    return keep(df)
