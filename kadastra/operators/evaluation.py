"""Scores of retrieval and answers: set metrics, agreement, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.functions.columns import cosine, f1
from kadastra.operators.ranking import group_counts_before, same_keys
from kadastra.operators.storage import cut_lineage


def set_metrics(expected: Column, optional: Column, found: Column, empty_f1: float | None = 0.0) -> dict[str, Column]:
    """recall, precision and f1 of category sets; optional categories neither count as missed nor as wrong."""
    hit = F.size(F.array_intersect(expected, found))
    right = F.size(F.array_intersect(found, F.array_union(expected, optional)))
    recall = F.try_divide(hit.cast("double"), F.size(expected).cast("double"))
    precision = F.try_divide(right.cast("double"), F.size(F.array_distinct(found)).cast("double"))
    return {"recall": recall, "precision": precision, "f1": f1(precision, recall, empty_f1)}


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): each value's rank within its group, ties sharing their average; null comes first."""
    counts = group_counts_before(df, keys, value)
    return counts.select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))


def agreement(df: DataFrame, keys: Sequence[str], a: str, b: str, exact: float = 0.0) -> DataFrame:
    """n, pearson, spearman, mae, bias, exact and within-1 shares of pairs without nulls, by group.

    Ranks come from counts by value, and different pairs meet them once with their number, so no task holds a group. Ranks are taken from their mean, which is
    known, before they are multiplied.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    d = F.col(b) - F.col(a)
    spread = F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))  # null where one side is the same throughout
    pearson = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.covar_pop(a, b) / spread))
    pearson = F.when(spread.isNotNull(), pearson)
    plain = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), pearson.alias("pearson"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        (F.count_if(F.abs(d) <= exact) * 100.0 / F.count("*")).alias("exact_pct"), (F.count_if(F.abs(d) <= 1) * 100.0 / F.count("*")).alias("within1_pct"),
    )
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("_m"))
    for c in (a, b):
        ranks = average_ranks(pairs, keys, c, f"_r_{c}")
        cells = cells.alias("l").join(ranks.alias("r"), same_keys("l", "r", [*keys, c])).select("l.*", f"r._r_{c}")
    cells = cells.alias("l").join(plain.alias("r"), same_keys("l", "r", keys)).select("l.*", F.col("r.n").alias("_n"))
    x, y = (F.col(f"_r_{c}") - (F.col("_n") + 1) / 2.0 for c in (a, b))
    total = lambda v: F.sum(F.col("_m") * v)
    norm = F.nullif(F.sqrt(total(x * x)) * F.sqrt(total(y * y)), F.lit(0.0))
    spearman = F.when(norm.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), total(x * y) / norm)))
    ranked = cells.groupBy(*keys).agg(spearman.alias("spearman"))
    out = plain.alias("l").join(ranked.alias("r"), same_keys("l", "r", keys), "left")
    return out.select(*(F.col(f"l.{k}").alias(k) for k in keys), "n", "pearson", "spearman", "mae", "bias", "exact_pct", "within1_pct")


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f = c = 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-30)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-30)
            c = (1 + num / c) or 1e-30
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


def with_p_values(df: DataFrame, r: str = "pearson", n: str = "n", name: str = "p") -> DataFrame:
    """Two-sided p of a correlation from its t statistic; null under three pairs. Meant for summary rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for c, k in zip(f[r], f[n]):
                if k is None or k < 3 or c is None or np.isnan(c):
                    out.append(None)
                else:
                    out.append(0.0 if abs(c) >= 1 else _beta_tail(1 - c * c, (k - 2) / 2, 0.5))
            yield f.assign(**{name: pd.Series(out, dtype="float64", index=f.index)})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} double")


def board(df: DataFrame, keys: Sequence[str], note: str) -> DataFrame:
    """n, mean, least and greatest note, errors (null notes) by group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(note).alias("avg_note"), F.min(note).alias("min_note"), F.max(note).alias("max_note"), F.count_if(F.col(note).isNull()).alias("errors"))


#: Rows of a block, in whose pairs the farthest answers are looked for, and ranges of the angle that blocks are cut from.
BLOCK, RANGES = 1024, 16
#: Bounds on angles are widened by this, as they come from rounded cosines.
SLACK = 1e-6


def robustness(df: DataFrame, group: str, row_id: str, vector: str) -> DataFrame:
    """(group, n_answers, avg_cos, min_cos): mean and least cosine over the pairs of each group's answers; null under two of them.

    The mean comes from the sum of the unit vectors. For the least, angles to the group's mean direction bound those between answers by their sum: what can't
    be in a pair wider than the widest one known (from the answer farthest from the mean) is left out, the others are compared in blocks whose bounds allow it,
    a matrix product for each pair of blocks. So tight groups compare few answers, however large they are. Null, empty and zero vectors and those without a finite length count as
    answers but are in no pair. A null group is none. Repeated ids are different answers.
    """
    n = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_answers"))
    x = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    units = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(row_id).alias("h"), x.alias("x"), norm.alias("norm")).where(F.col("norm") > 0).where(F.col("norm") < F.lit(float("inf")))
    units = units.select("g", "h", F.transform("x", lambda v: F.try_divide(v, F.col("norm"))).alias("x"))
    sums = units.select("g", F.posexplode("x").alias("at", "v")).groupBy("g", "at").agg(F.sum("v").alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda p: p["s"])
    whole = sums.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("square"), listed.alias("mean"))
    sizes = units.groupBy("g").agg(F.count("*").alias("m"), F.min_by("x", "h").alias("any"))
    pivots = whole.join(sizes, "g").where("m > 1").select("g", "m", "square", F.when(F.sqrt("square") > 1e-6, F.col("mean")).otherwise(F.col("any")).alias("pivot"))
    angle = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))
    turned = cut_lineage(units.join(pivots.select("g", "pivot"), "g").select("g", "h", "x", angle(F.col("x"), F.col("pivot")).alias("a")))
    ends = turned.groupBy("g").agg(F.max("a").alias("most"), F.max_by("x", "a").alias("far"))
    known = turned.join(ends, "g").groupBy("g").agg(F.first("most").alias("most"), F.max(angle(F.col("x"), F.col("far"))).alias("known"))
    low = F.col("known") - F.col("most") - SLACK
    wide = turned.join(known, "g").where(F.col("a") >= low)
    place = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((F.col("most") - F.col("a")) / F.greatest(F.col("most") - F.greatest(low, F.lit(0.0)), F.lit(SLACK)) * RANGES))).cast("int")
    wide = cut_lineage(wide.select("g", "h", "x", "a", "known", place.alias("range")))
    cells = wide.groupBy("g", "range").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    placed = wide.join(cells, ["g", "range"]).withColumn("part", F.pmod("h", "parts"))
    blocks = cut_lineage(placed.groupBy("g", "range", "part").agg(F.max("a").alias("top"), F.first("known").alias("known"), F.count("*").alias("rows"), F.flatten(F.collect_list("x")).alias("xs")).withColumn("block", F.monotonically_increasing_id()))
    ids = blocks.select("g", "block", "top", "known")
    l, r = ids.alias("l"), ids.alias("r")
    met = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.block") <= F.col("r.block")) & (F.col("l.top") + F.col("r.top") + SLACK >= F.col("l.known")))
    met = met.select(F.col("l.block").alias("b1"), F.col("r.block").alias("b2"))
    side = lambda k: blocks.select(F.col("block").alias(f"b{k}"), F.col("xs").alias(f"x{k}"), F.col("rows").alias(f"n{k}"), *(["g"] if k == 1 else []))

    @F.pandas_udf("double")
    def least(x1: pd.Series, n1: pd.Series, x2: pd.Series, n2: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for a, i, b, j, one in zip(x1, n1, x2, n2, same):
            c = np.asarray(a, np.float64).reshape(i, -1) @ np.asarray(b, np.float64).reshape(j, -1).T
            c = c[np.triu_indices(i, 1)] if one else c.ravel()
            out.append(float(c.min()) if len(c) else None)
        return pd.Series(out, dtype="float64")

    found = met.join(side(1), "b1").join(side(2), "b2").select("g", least("x1", "n1", "x2", "n2", F.col("b1") == F.col("b2")).alias("c"))
    lowest = found.groupBy("g").agg(F.min("c").alias("c"))
    mean = F.try_divide(F.col("square") - F.col("m"), (F.col("m") * (F.col("m") - 1)).cast("double"))
    both = pivots.join(lowest, "g", "left").select(F.col("g").alias(group), mean.alias("avg_cos"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))).alias("min_cos"))
    return n.join(both, group, "left").select(group, "n_answers", "avg_cos", "min_cos")


def outliers(df: DataFrame, a: str, b: str, dims: Sequence[tuple[str, str, str]], over: float = 1.0) -> DataFrame:
    """Rows whose two scores differ by more than `over`, with the dimension of the widest gap."""
    gaps = F.array(*(F.struct(F.abs(F.col(x) - F.col(y)).alias("gap"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, (n, x, y) in enumerate(dims)))
    return df.where(F.abs(F.col(a) - F.col(b)) > over).withColumn("widest", F.array_max(gaps)["name"])


def latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a repeated run over those of the earlier one."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))
