"""What each of several filters removes in every order of application, from a Gray-code walk over their subsets (op12)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, table

SPACE = r"[\x20\x09-\x0D]+"
#: The five filters, by letter and in the order of their bits.
LETTERS = "ABCDE"
COUNTED = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of the words distinct), C (over 2 % capitals), D (holds a sign).

    Words are maximal runs without white space. A null text counts as empty: it fails A alone.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 200,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * 2,
        text.rlike(r"[#$%&*|]"),
    ]


def with_repeats(rows: DataFrame, *, row_id: str, key: str, name: str) -> DataFrame:
    """`rows` with `name`: whether a row of smaller id has the same key.

    Rows of one least id are all first, and so are rows without id, which come before none. The least id of a key is a partial
    aggregate, and it is met by key and id together, so a key that a third of all rows share is no task's burden.
    """
    first = rows.where(F.col(row_id).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(row_id).alias("_id"))
    met = rows.join(first.withColumn("_first", F.lit(True)), (F.col(key) == F.col("_key")) & (F.col(row_id) == F.col("_id")), "left")
    return met.withColumn(name, F.col(row_id).isNotNull() & F.col("_first").isNull()).drop("_key", "_id", "_first")


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """states[part, subset, count] of what passes each subset of filters, from cells[part, mask, count] of what fails exactly `mask`.

    One filter is toggled at a time. Every mask has a counter of the active filters that it fails: a cell leaves the running survivors when its counter
    leaves zero and comes back when it returns, so a step touches half of the cells once and nothing is summed anew.
    """
    masks = np.arange(cells.shape[1])
    failing, alive = np.zeros(len(masks), np.int64), cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = alive
    on = 0
    for step in range(1, len(masks)):
        bit = step & -step
        on ^= bit
        hit = (masks & bit) > 0
        if on & bit:
            alive = alive - cells[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + cells[:, hit & (failing == 0)].sum(axis=1)
        states[:, on] = alive
    return states


def order_steps(cells: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """Columns of one row for each part, order and step: differences between two states of the walk."""
    k, masks = len(letters), np.arange(cells.shape[1])
    states = gray_walk(cells)
    fails = np.stack([cells[:, (masks >> f & 1) > 0, 0].sum(axis=1) for f in range(k)], axis=1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(k)], axis=1)
    shapley = np.zeros_like(fails)
    for f in range(k):
        for s in masks[(masks >> f & 1) == 0]:
            n = int(s).bit_count()
            shapley[:, f] += factorial(n) * factorial(k - 1 - n) * (states[:, s, 0] - states[:, s | 1 << f, 0])
    orders = list(permutations(range(k)))
    which = np.array(orders)
    after = np.cumsum(1 << which, axis=1)
    before = after - (1 << which)
    which, before, after = which.ravel(), before.ravel(), after.ravel()
    lost = states[:, before] - states[:, after]
    per = len(which)
    return {
        "filter_order": np.tile(np.repeat(["".join(letters[f] for f in o) for o in orders], k), len(cells)),
        "step": np.tile(np.arange(per, dtype=np.int32) % k + 1, len(cells)),
        "kept": states[:, after, 0].ravel(),
        "removed": lost[:, :, 0].ravel(),
        "redundant": (fails[:, which] - lost[:, :, 0]).ravel(),
        "unique_fails": alone[:, which].ravel(),
        "good_lost": lost[:, :, 1].ravel(),
        "toxic_lost": lost[:, :, 2].ravel(),
        "shapley": shapley[:, which].ravel(),
    }


def audit_filters(rows: DataFrame, *, part: str, failures: list[str], good: str, toxic: str, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part, order and step.

    `failures` are boolean columns, one for each letter (at most eight; null: passes); `good` and `toxic` are booleans (null: no). All rows are first counted by
    part and mask of failures, which combines before the shuffle: at most 2^k cells a part, however many rows it has. The
    walk then runs over the parts where they lie. A null part is the empty string. Repeated rows count as often as they
    are there. An empty table gives no rows; other columns aren't looked at.
    """
    k = len(failures)
    if k != len(letters) or not 0 < k <= 8:
        raise ValueError("one letter for each filter, and no more than eight")
    mask = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(failures)), F.lit(0))
    yes = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    cells = rows.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), yes(good).alias("good"), yes(toxic).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("cells"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                counts = np.zeros((len(some), 1 << k, 3), np.int64)
                for i, row in enumerate(some["cells"]):
                    for c in row:
                        counts[i, c["mask"]] = [c[x] for x in COUNTED]
                out = order_steps(counts, letters)
                yield pd.DataFrame({"part": np.repeat(some["part"].to_numpy(), len(out["step"]) // len(some)), **out})

    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return parts.mapInPandas(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audit_filters` of the five text filters by source, with the labels' good and toxic documents.

    A text is told apart by its SHA-256; null counts as empty. E fails where a smaller doc_id has the same text, in whatever part and
    removed or not. Of repeated labels any that says 1 counts; documents without labels or id are neither good nor toxic. Each text is read
    once: what is left of it is a digest and four bits.
    """
    text = F.col("text")
    a, b, c, d = text_failures(text)
    seen = checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("part"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"),
            a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"),
        )
    )
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = with_repeats(seen, row_id="doc_id", key="digest", name="e").join(told, "doc_id", "left")
    return audit_filters(rows, part="part", failures=["a", "b", "c", "d", "e"], good="good", toxic="toxic")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: 600 rows for each source."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order and step counted directly on the cells, without any walk.
OP12_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents
), l as (
  select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by 1
), firsts as (
  select t, min(doc_id) as m from d group by 1
), f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > m, false)::int as mask
  from d join firsts using (t) left join l using (doc_id)
), cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2
), letters(c, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select v.c || w.c || x.c || y.c || z.c as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits from letters v, letters w, letters x, letters y, letters z
  where v.bit + w.bit + x.bit + y.bit + z.bit = 31 and (v.bit | w.bit | x.bit | y.bit | z.bit) = 31
), steps as (
  select filter_order, s::int as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as earlier from orders, range(1, 6) r(s)
), told as (
  select part, filter_order, step, bit, sum(n) filter ((mask & (earlier | bit)) = 0) as kept, sum(n) filter ((mask & earlier) = 0 and (mask & bit) > 0) as removed,
    sum(n) filter ((mask & earlier) > 0 and (mask & bit) > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
    sum(good) filter ((mask & earlier) = 0 and (mask & bit) > 0) as good_lost, sum(toxic) filter ((mask & earlier) = 0 and (mask & bit) > 0) as toxic_lost
  from cells, steps group by all
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley from told
"""
