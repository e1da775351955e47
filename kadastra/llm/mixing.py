"""Mixing sources to target weights by entropy balancing (op5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, table
from kadastra.operators.ranking import counts_before

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document, and so no source, is taken more often than this.
MOST = 3
#: Newton stops when every source is within this share of its target, or after so many steps.
TOLERANCE, STEPS = 1e-6, 40
#: A cell of equal documents is dealt over so many parts, so that a group of copies is no single task's.
PARTS = 64


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    All sizes together are shared by weight; a target stops at `most` times its source's
    size and the excess is shared again by weight until none is above. Each sharing is one
    sum over the table of sources, of which the driver keeps the level alone, and the sources'
    places in order come from ranges of them, so no task sees all sources. Levels only rise,
    so it ends; in practice after a few sharings.
    """
    by = checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = counts_before(by.select("source"), "source", descending=False).select(F.col("source").alias("_source"), "before")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("double")
    by = checkpoint(
        by.join(place, F.col("source").eqNullSafe(F.col("_source")))
        .select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    )
    level, stopped = 0.0, None
    while True:
        full = F.col("cap") < F.col("w") * level
        total, caps, w_left, n = by.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count(F.when(full, True))
        ).first()
        if n == stopped or not w_left:
            break
        level, stopped = (total - (caps or 0.0)) / w_left, n
    return by.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(key, lam, unit): the dual variable of each source's token constraint.

    The rates nearest to 1 in relative entropy, each at most `most`, that give every source
    its target number of words are min(most, exp(lam * size / unit)). The dual is convex and
    separate by source; each step aggregates its gradient and curvature over the
    cells (key, size, n) on the cluster and takes a Newton step kept inside the bracket
    known so far. Only one row per source is held between steps, as a checkpointed table.
    """
    state = checkpoint(
        cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"), F.max("size").alias("longest"), F.min("size").alias("shortest"))
        .join(targets.select("key", "source_size", "target"), "key")
        .where("source_size > 0")
        .select(
            "key", "unit", "target", F.lit(0.0).alias("lam"),
            F.lit(-700.0).alias("lo"), (F.log(F.lit(float(most))) * F.col("unit") / F.col("shortest")).alias("hi"),
        )
    )
    for _ in range(STEPS):
        x = F.col("size") / F.col("unit")
        free = F.exp(F.col("lam") * x)
        rate = F.least(F.lit(float(most)), free)
        sums = (
            cells.join(state, "key")
            .groupBy("key")
            .agg(F.sum(F.col("n") * x * rate).alias("got"), F.sum(F.when(free < most, F.col("n") * x * x * free).otherwise(0.0)).alias("slope"))
        )
        s = state.join(sums, "key").withColumn("gap", F.col("got") * F.col("unit") - F.col("target"))
        lo = F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(F.col("gap") / F.col("unit"), F.col("slope"))
        s = checkpoint(
            s.withColumn("lo2", lo).withColumn("hi2", hi)
            .withColumn("next", F.when((step > F.col("lo2")) & (step < F.col("hi2")), step).otherwise((F.col("lo2") + F.col("hi2")) / 2))
            .withColumn("off", F.abs("gap") / F.greatest("target", F.lit(1.0)))
            .select("key", "unit", "target", F.when(F.col("off") <= TOLERANCE, F.col("lam")).otherwise(F.col("next")).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "off")
        )
        state = s.drop("off")
        worst = s.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("key", "lam", "unit")


def _round_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the cells of one source, longest documents first, the error carried on."""
    pdf = pdf.sort_values("size", ascending=False)
    carry, extra = 0.0, []
    for size, n, rate, base in zip(pdf["size"], pdf["n"], pdf["rate"], pdf["base"]):
        carry += n * size * (rate - base)
        e = min(n, max(0, int(carry / size + 0.5))) if base < MOST and size else 0
        carry -= e * size
        extra.append(e)
    return pdf.assign(extra=extra)[["key", "size", "base", "extra"]]


def mix(docs: DataFrame, size: Column, *, source: str = "source", row_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken (= copies * size).

    Rates from `balance` are rounded into whole copies: every document of a cell (source,
    size) gets the floor of its rate, and so many of the cell one more that the source's
    sum stays within half a document of its target, going from the longest documents to
    the shortest. Which documents of a cell get one more follows a hash of `row_id`, so
    reruns agree; rows with equal id and size are alike, whichever of them is taken.

    Null texts and empty ones have size 0 and are never taken. A null source is a source
    of its own, last in order. An empty table gives an empty result. Of the input's
    columns only names the result adds are replaced.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    h = F.xxhash64(F.col(row_id), F.lit(20240229))
    rows = docs.drop("size", "source_size", "target", "copies", "taken", "_key", "_part", "_h", "_pick", "_base", "_extra").withColumns(
        {"size": size, "_key": key, "_h": h, "_part": F.pmod(h, F.lit(PARTS)).cast("int")}
    )
    parts = checkpoint(rows.groupBy(F.col(source).alias("source"), F.col("_key").alias("key"), "size", F.col("_part").alias("part")).agg(F.count("*").alias("n")))
    targets = checkpoint(source_targets(parts.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source"))
    cells = checkpoint(parts.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")))
    rate = F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("unit")))
    rated = cells.join(balance(cells, targets, most), "key").withColumn("rate", rate)
    rated = rated.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long"))
    whole = rated.groupBy("key").applyInPandas(_round_cells, "key string, size long, base long, extra long")
    # the cell's extra copies, dealt over its parts in proportion
    w = Window.partitionBy("key", "size").orderBy("part")
    shared = (
        parts.join(whole, ["key", "size"])
        .withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("key", "size")))
        .withColumn("extra", F.expr("(extra * upto) div all - (extra * (upto - n)) div all"))
        .select(F.col("key").alias("_key"), "size", F.col("part").alias("_part"), F.col("base").alias("_base"), F.col("extra").alias("_extra"))
    )
    pick = F.row_number().over(Window.partitionBy("_key", "size", "_part").orderBy("_h", row_id))
    out = (
        rows.withColumn("_pick", pick)
        .join(shared, ["_key", "size", "_part"], "left")
        .withColumn("copies", F.coalesce(F.col("_base") + (F.col("_pick") <= F.col("_extra")).cast("long"), F.lit(0)).cast("long"))
        .join(targets.withColumnRenamed("key", "_key"), "_key", "left")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    return out.drop("_key", "_h", "_part", "_pick", "_base", "_extra")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix(checkpoint(docs), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
