"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset a local session gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kadastra-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of `df` checkpointed in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """`df` as the side of a join that is never broadcast.

    Sizes are estimated from the files of the input, so made strings, rings and exploded rows count for far less than they are; a join with a side that grows with
    the input says so itself.
    """
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """The rows of `df` written to the shared folder as Parquet and read again: for tables of many rows, which take a fraction of a checkpoint's space."""
    path = f"{shared_root(df.sparkSession)}/written-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
