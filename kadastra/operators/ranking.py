"""Ranks over whole tables without a single task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra.operators.storage import cut_lineage


def counts_before(df: DataFrame, value: str, *, descending: bool = True) -> DataFrame:
    """(value, n, before): for each value how many rows have it, and how many come before it in order; null comes last.

    The counts by value are dealt out by ranges of the value and summed within each; the driver adds up the ranges, one number
    each. No task sees more than its range, however many different values there are.
    """
    col = F.col(value)
    order = col.desc_nulls_last() if descending else col.asc_nulls_last()
    by = df.groupBy(value).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(by.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    sums = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("n").alias("n")).collect())
    offsets, at = [], 0
    for k, n in sums:
        offsets += [F.lit(k), F.lit(at)]
        at += n
    offset = F.create_map(*offsets)[F.col("_range")] if offsets else F.lit(0)
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.select(value, "n", (F.coalesce(F.sum("n").over(w), F.lit(0)) + offset).cast("long").alias("before"))


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Whether two aliased tables agree on all keys, nulls with nulls."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def group_counts_before(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, before): for each group and value how many rows have it, and how many rows of the group have a lesser one; null comes first.

    Counts by group and value are dealt out by ranges of both and summed within each range. A group that several ranges hold gets the sums of
    its earlier ones; there are fewer such groups than ranges, so these sums are broadcast. No task sees more than its range, however large a group is.
    """
    by = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(by.repartitionByRange(parts, *(F.col(c).asc_nulls_first() for c in [*keys, value])).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sums.withColumn("_offset", earlier).where(F.col("_offset").isNotNull()))  # fewer rows than ranges twice over
    within = F.sum("n").over(Window.partitionBy("_range", *keys).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    met = ranged.withColumn("_within", within).alias("l").join(offsets.alias("r"), same_keys("l", "r", [*keys, "_range"]), "left")
    return met.select(*(F.col(f"l.{c}").alias(c) for c in [*keys, value]), "n", (F.coalesce("_within", F.lit(0)) + F.coalesce("_offset", F.lit(0))).cast("long").alias("before"))


def group_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the middle of each group's known values, or the mean of the two middle ones; groups without any are left out."""
    counts = group_counts_before(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), keys, value)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    at = counts.alias("l").join(total.alias("r"), same_keys("l", "r", keys)).select(*(F.col(f"l.{k}").alias(k) for k in keys), F.col(value).cast("double").alias("_v"), "n", "before", "_total")
    holds = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("_v")))
    return at.groupBy(*keys).agg(((holds(F.expr("(_total - 1) div 2")) + holds(F.expr("_total div 2"))) / 2).alias(name))


def competition_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rank_<c>: one more than the number of rows with a greater value; null values rank last.

    Ranks come from the counts by value and return by a join on the value.
    """
    for c in columns:
        ranks = counts_before(df.select(c), c).select(F.col(c).alias("_v"), (F.col("before") + 1).alias(f"rank_{c}"))
        df = df.join(ranks, F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    return df
