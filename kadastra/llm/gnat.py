"""Vector codes from integer codebooks whose entries are searched by near-neighbour access trees (op13)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Split points of a node; children with so many entries or fewer are leaves.
ARITY, LEAF = 6, 6
#: Rows searched at once.
ROWS = 4096
#: A label with more than a thousandth of all rows is met by a broadcast; there are fewer than a thousand such labels.
HOT = 1000
_TOP = (1 << 63) - 1


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles, exactly: int64 where all fit, else Python's integers."""
    values = np.asarray(values, np.float64)
    if not values.size or np.abs(values).max() < 2.0**53:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 2.0**53 else int(v) * SCALE for v in values.ravel()], object).reshape(values.shape)


def _fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as int64 if squared distances between them can't overflow, else as Python's integers."""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    small = max(a.shape[-1] for a in arrays) * (2 * top) ** 2 < 1 << 62
    return [a.astype(np.int64 if small else object) for a in arrays]


def squared(q: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row of `q` from every entry, in integers."""
    total = np.zeros((len(q), len(entries)), q.dtype)
    for j in range(q.shape[1]):
        gap = q[:, j, None] - entries[None, :, j]
        total += gap * gap
    return total


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    """Integer square roots, rounded down or up, of integers; doubles only guess, integers decide."""
    if d.dtype == object:
        r = np.array([math.isqrt(int(x)) for x in d.ravel()], object).reshape(d.shape)
    else:
        r = np.sqrt(d.astype(np.float64)).astype(np.int64)
        r -= r * r > d
        r += (r + 1) * (r + 1) <= d
    return r + (r * r < d) if up else r


@dataclass
class Node:
    """Split points, and for each child the entries below it and its range of distances (rounded outwards) from each split point."""

    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list


def build(entries: np.ndarray, ids: np.ndarray | None = None) -> Node | np.ndarray:
    """The tree over the entries of one codebook; a leaf is the array of its entries' numbers.

    Split points are chosen far apart, greedily; every other entry goes to its nearest one. Entries that are all equal make a leaf, however many they are.
    """
    if ids is None:
        entries, ids = _fitting(entries)[0], np.arange(len(entries))
    if len(ids) <= LEAF:
        return ids
    d = squared(entries[ids], entries[ids])
    chosen, near = [0], d[0].copy()
    while len(chosen) < ARITY and (far := int(np.argmax(near))) and near[far] > 0:
        chosen.append(far)
        near = np.minimum(near, d[far])
    if len(chosen) < 2:
        return ids
    to = d[chosen]
    child = np.argmin(to, axis=0)
    child[chosen] = np.arange(len(chosen))
    low, high = _root(to, False), _root(to, True)
    rest = np.ones(len(ids), bool)
    rest[chosen] = False
    members = [np.flatnonzero(rest & (child == j)) for j in range(len(chosen))]
    kept = [m for m in members if len(m)]
    return Node(
        ids[chosen],
        np.array([[low[i, m].min() for m in kept] for i in range(len(chosen))]).reshape(len(chosen), len(kept)),
        np.array([[high[i, m].max() for m in kept] for i in range(len(chosen))]).reshape(len(chosen), len(kept)),
        [build(entries, ids[m]) for m in kept],
    )


class Search:
    """Nearest entries of many queries at once. `computed` counts the distances that were needed."""

    def __init__(self, entries: np.ndarray, tree: Node | np.ndarray):
        self.entries, self.tree, self.computed = entries, tree, 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each query's nearest entry; of equally near ones the least number.

        A query passes a child over only if some split point proves that all below lie strictly farther than the
        best so far: the query's distance from the split point, rounded down, less the child's greatest one, or the child's least one less
        the query's, rounded up, exceeds the best rounded up. Whatever is left is compared by integers, ties by number.
        """
        queries, entries = _fitting(queries, self.entries)
        best = np.full(len(queries), -1, queries.dtype)
        which = np.full(len(queries), len(entries), np.int64)
        if len(queries) and len(entries):
            self._visit(self.tree, queries, entries, np.arange(len(queries)), best, which)
        return which, best

    def _take(self, ids: np.ndarray, queries: np.ndarray, entries: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        ids = np.sort(ids)
        d = squared(queries[rows], entries[ids])
        self.computed += d.size
        at = np.argmin(d, axis=1)
        near, number = d[np.arange(len(rows)), at], ids[at]
        better = (best[rows] < 0) | (near < best[rows]) | ((near == best[rows]) & (number < which[rows]))
        best[rows[better]], which[rows[better]] = near[better], number[better]
        return d

    def _visit(self, node: Node | np.ndarray, queries: np.ndarray, entries: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        if not isinstance(node, Node):
            self._take(node, queries, entries, rows, best, which)
            return
        order = np.argsort(node.splits)
        d = self._take(node.splits, queries, entries, rows, best, which)[:, np.argsort(order)]
        down, up = _root(d, False), _root(d, True)
        for j, child in enumerate(node.children):
            # what the triangle proves about every entry below the child
            far = np.maximum(down - node.high[None, :, j], node.low[None, :, j] - up).max(axis=1)
            left = far <= _root(best[rows], True)
            if left.any():
                self._visit(child, queries, entries, rows[left], best, which)


def encode(x: np.ndarray, codebooks: list[np.ndarray], trees: list) -> tuple[np.ndarray, list[np.ndarray], list[Search]]:
    """(codes[row, part], distances of each part, the searches) of integer vectors cut into len(codebooks) parts."""
    width = x.shape[1] // len(codebooks)
    codes, errors, searches = np.zeros((len(x), len(codebooks)), np.int64), [], []
    for p, (book, tree) in enumerate(zip(codebooks, trees)):
        search = Search(book, tree)
        codes[:, p], e = search.nearest(x[:, p * width : (p + 1) * width])
        errors.append(e)
        searches.append(search)
    return codes, errors, searches


def kept_vectors(vectors: DataFrame, *, row_id: str, column: str, label: str) -> DataFrame:
    """(row_id, label, embedding) of vectors that aren't null and hold no null or non-finite component."""
    finite = lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN is above infinity in Spark
    rows = vectors.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))


def _matrix(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Integer vectors, filled with zeros to a multiple of the number of parts."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), width)
    return np.pad(quantise(x), ((0, 0), (0, -width % parts)))


def _update(rows: DataFrame, codebooks: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: all parts assigned, each entry replaced by floor(sum / count) of its parts; unused entries stay.

    A task sums over all of its rows and gives one row for each part and entry, so what is shuffled and what reaches the driver is bounded by
    the codebooks. Sums travel as decimal digits and are added as Python's integers: they can't overflow.
    """
    sc, parts = rows.sparkSession.sparkContext, len(codebooks)
    sent = sc.broadcast((codebooks, [build(b) for b in codebooks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), width, parts)
                codes, _, _ = encode(x, books, trees)
                w = x.shape[1] // parts
                for p in range(parts):
                    some = np.zeros(books[p].shape, x.dtype)
                    np.add.at(some, codes[:, p], x[:, p * w : (p + 1) * w])
                    sums[p] = sums[p] + some
                    counts[p] += np.bincount(codes[:, p], minlength=len(books[p]))
        keys = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([int(counts[p][e]) for p, e in keys], pa.int64()), pa.array([",".join(map(str, sums[p][e])) for p, e in keys], pa.string())],
            names=["part", "entry", "n", "sums"],
        )

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = [sum(map(int, column)) for column in zip(*(s.split(",") for s in f["sums"]))] if f["sums"].iloc[0] else []
        n = int(f["n"].sum())
        return pd.DataFrame({"part": f["part"].iloc[:1], "entry": f["entry"].iloc[:1], "mean": [",".join(str(t // n) for t in total)]})

    found = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, sums string").groupBy("part", "entry").applyInPandas(add, "part int, entry int, mean string").collect()
    sent.unpersist()
    new = [b.astype(object) for b in codebooks]
    for r in found:
        if r["mean"]:
            new[r["part"]][r["entry"]] = [int(c) for c in r["mean"].split(",")]
    return [_fitting(b)[0] for b in new]


def label_sums(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows of equal label, nulls together; sums beyond a long are given as the greatest long.

    Labels with more than a thousandth of all rows, fewer than a thousand by that, are broadcast; the others, none of which is hot, are met by a shuffle.
    """
    sums = checkpoint(rows.groupBy(F.col(label).alias("_label")).agg(F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("long").alias(name), F.count("*").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = (F.col("_n") * HOT > F.lit(total))
    met = rows.join(F.broadcast(sums.where(hot)), F.col(label).eqNullSafe(F.col("_label")), "left")
    done = met.where("_n is not null").select(*rows.columns, name)
    rest = met.where("_n is null").select(*rows.columns).join(sums.where(~hot), F.col(label).eqNullSafe(F.col("_label"))).select(*rows.columns, name)
    return done.unionByName(rest)


def compress(vectors: DataFrame, *, row_id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((row_id, code, error, label_error) of each kept row, the final codebooks).

    Components become floor(256 x); a vector is cut into `parts` equal parts. A part's codebook starts as that part of the `entries` rows of least
    id (nulls last, ties by the vector; fewer rows make a shorter codebook) and takes `rounds` rounds of assignment and integer means. Then all parts
    are assigned for good. Nearest entries are found by a tree over the codebook, exactly. The codebooks are all that the driver and every task hold: `parts` times
    `entries` (at most 256) short integer vectors.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are those whose vector isn't as long as that of the
    least id. Lengths that don't divide are filled with zeros. Repeated rows count as often as they are there. Errors beyond a
    long are given as the greatest long. An empty table gives an empty result and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    kept = kept_vectors(vectors, row_id=row_id, column=column, label=label)
    first = kept.orderBy(F.col("row_id").asc_nulls_last(), "embedding").limit(1).collect()
    width = len(first[0]["embedding"]) if first else 0
    rows = kept.where(F.size("embedding") == width)
    seeds = [r["embedding"] for r in rows.orderBy(F.col("row_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    codebooks = []
    if seeds:
        start = np.pad(quantise(np.array(seeds).reshape(len(seeds), width)), ((0, 0), (0, -width % parts)))
        codebooks = [_fitting(b)[0] for b in np.split(start, parts, axis=1)]
        for _ in range(rounds):
            codebooks = _update(rows, codebooks, width)
    sent = rows.sparkSession.sparkContext.broadcast((codebooks, [build(b) for b in codebooks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                codes, errors, _ = encode(_matrix(some.column(2), width, parts), books, trees)
                total = sum(e.astype(object) for e in errors)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string()), pa.array([min(int(t), _TOP) for t in total], pa.int64())],
                    names=["row_id", "label", "code", "error"],
                )

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = checkpoint(rows.mapInArrow(run, f"row_id {kind['row_id']}, label {kind['label']}, code string, error long"))
    return label_sums(coded, "label", "error", "label_error").select(F.col("row_id").alias(row_id), "code", "error", "label_error"), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and place within the part, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for b in codebooks for c in b.ravel()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all kept embeddings."""
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(digest(codebooks)))


def _sql() -> str:
    """Every part against every entry, round by round."""
    near = """
  select n.rid, n.p, b.e, sum((n.x - b.x) * (n.x - b.x)) as d from n join {book} b using (p, j) group by 1, 2, 3"""
    rounds, book = "", "b0"
    for k in range(1, ROUNDS + 2):
        rounds += f""", d{k} as ({near.format(book=book)}
), a{k} as (
  select rid, p, min(e) as e, any_value(m) as d from (select *, min(d) over (partition by rid, p) as m from d{k}) where d = m group by 1, 2
)"""
        if k <= ROUNDS:
            rounds += f""", b{k} as (
  select b.p, b.e, b.j, coalesce(m.x, b.x) as x from {book} b left join (select p, e, j, floor(sum(x::hugeint)::double / count(*))::bigint as x from a{k} join n using (rid, p) group by 1, 2, 3) m using (p, e, j)
)"""
            book = f"b{k}"
    return f"""
with v as (
  select row_number() over (order by vec_id) as rid, vec_id, label, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), n as materialized (
  select rid, (i // (len(v) // {PARTS}))::int as p, (i % (len(v) // {PARTS}))::int as j, floor({SCALE} * v[i + 1])::bigint as x from (select *, unnest(range(0, len(v))) as i from v)
), b0 as (
  select p, (rid - 1)::int as e, j, x from n where rid <= {ENTRIES}
){rounds}, h as (
  select sha256(string_agg(x, ',' order by p, e, j)) as codebooks_sha256 from {book}
), c as (
  select rid, string_agg(lpad(lower(hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS + 1} group by 1
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from v join c using (rid), h
"""


OP13_SQL = _sql()
