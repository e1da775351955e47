"""Helpers shared by the operators: table access, checkpoints and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in `spark.checkpoint.dir`.

    Only where that is unset (local tests) is a temporary folder taken and set instead; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kadastra-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of `df` written to the shared folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the executors delete the shuffle files behind what has been checkpointed.

    Spark does so once the driver's JVM has collected the plans that made them, which a driver with little to do may put off for
    long while the disks fill. It only asks for that collection; no result depends on it.
    """
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b: long); component is the least id reachable.

    Rounds of large-star and small-star: every round replaces each edge by edges to the
    least neighbour, so the number of edges never grows and the number of rounds follows
    the logarithm of the longest path. Minima are partial aggregates; the joins spread a
    hub's edges by their other end once adaptive execution splits the hub's partition.
    Null ends and loops are dropped, repeated edges count once. An empty table gives an
    empty result.
    """
    e = checkpoint(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        e = checkpoint(small)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == seen:
            break
        seen = tuple(row)
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
