"""A stored inverted-file index over vectors: trained cells, residual product codes, probed cells, exact re-rank."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.operators.retrieval import dense_top_k
from kadastra.operators.storage import cut_lineage, shared_root, written

#: Rows that the cells and codes are trained on, at most; every row is indexed.
SAMPLE = 65_536
#: Cells: the square root of the number of rows, within these bounds.
LEAST_CELLS, MOST_CELLS = 8, 16_384
#: A code has a byte for each so many dimensions.
PART = 4
CODES = 256
ROUNDS = 6
#: Rows of one cell that meet one group of questions, and questions of a group.
ROWS, QUESTIONS = 16_384, 512
#: Questions by which probes and re-ranked rows are set, and their nearest rows that must be found.
TRIALS, TRIED = 64, 10
#: Components are summed as integers of so many parts, so that training doesn't depend on the order of tasks.
GRAIN = 1 << 24


def _units(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, 1)[:, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def train_centres(vectors: DataFrame, start: np.ndarray, rounds: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Lloyd's rounds for all parts of a product quantiser at once: centres[part, centre, place] from the rows of `vectors` (embedding).

    One job a round. A task adds up its rows and gives one row for each part and centre, so what is shuffled and what the driver gets is bounded by the
    centres. Sums are of integers: the same rows give the same centres however they are dealt out. Centres without rows stay.
    """
    spark, (parts, n, width) = vectors.sparkSession, start.shape
    centres = start
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
            for batch in batches:
                x = prepare(_units(batch.column(0)))
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    near = _nearest(own, sent.value[p])
                    np.add.at(sums[p], near, np.rint(own * GRAIN).astype(np.int64))
                    counts[p] += np.bincount(near, minlength=n)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts.ravel()[at], pa.int64()), pa.array(sums.reshape(-1, width)[at].tolist(), pa.list_(pa.int64()))], names=["at", "n", "sums"])

        found = vectors.select("embedding").mapInArrow(run, "at long, n long, sums array<long>").groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(width))).alias("sums"))
        new = centres.reshape(-1, width).copy()
        for r in found.collect():
            new[r["at"]] = np.array(r["sums"], np.float64) / r["n"] / GRAIN
        sent.unpersist()
        centres = new.reshape(start.shape)
    return centres


@dataclass
class Quantiser:
    """Cells, the code books of residuals, and how far a search goes: probed cells and re-ranked rows for each question."""

    cells: np.ndarray
    books: np.ndarray
    probes: int = 1
    rerank: int = 32

    def residuals(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.pad(x - self.cells[cell], ((0, 0), (0, -x.shape[1] % len(self.books))))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes[row, part]) of unit vectors."""
        cell = _nearest(x, self.cells)
        r, w = self.residuals(x, cell), self.books.shape[2]
        return cell, np.stack([_nearest(r[:, p * w : (p + 1) * w], b) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, x: np.ndarray, cell: int) -> np.ndarray:
        """squared distances [question, part, code] between the questions' residuals in one cell and the code books."""
        r = self.residuals(x, np.full(len(x), cell)).reshape(len(x), len(self.books), 1, -1)
        return ((r - self.books[None]) ** 2).sum(axis=3)


def _usable(docs: DataFrame, d: str, vector: str, dims: int | None = None) -> DataFrame:
    """(d, embedding) of rows whose vector holds finite components only, all of one length."""
    finite = lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))
    rows = docs.select(d, F.col(vector).cast("array<double>").alias("embedding")).where(F.forall("embedding", finite) & (F.size("embedding") > 0))
    return rows if dims is None else rows.where(F.size("embedding") == dims)


class VectorIndex:
    """An index that lies in a folder: rows sorted by cell, each with its code and vector, and the quantiser beside them.

    Vectors that are null, empty or hold null or non-finite components aren't indexed, nor are those of another length than that of the least
    id's. Repeated ids are rows of their own. What is broadcast is the quantiser: at most 16,384 cells and 256 codes a part.
    """

    def __init__(self, spark: SparkSession, path: str, quantiser: Quantiser, d: str = "doc_id"):
        self.spark, self.path, self.quantiser, self.d = spark, path, quantiser, d

    @classmethod
    def build(cls, docs: DataFrame, *, d: str = "doc_id", vector: str = "embedding", cells: int | None = None, target: float = 0.94, path: str | None = None) -> VectorIndex | None:
        """Trains on at most 65,536 rows, encodes and stores all, then sets probes and re-ranked rows; None without any usable row.

        Probes and re-ranked rows are the least with which the ten nearest of 64 rows, found by dense search over everything,
        are found in the share `target`. The sample is chosen by a hash of the vector; its rate follows from the number of rows.
        """
        spark = docs.sparkSession
        path = path or f"{shared_root(spark)}/index-{uuid4().hex}"
        first = _usable(docs, d, vector).orderBy(F.col(d).asc_nulls_last(), "embedding").limit(1).collect()
        if not first:
            return None
        dims = len(first[0]["embedding"])
        rows = _usable(docs, d, vector, dims)
        n = rows.count()
        every = max(1, math.ceil(n / SAMPLE))
        mark = F.xxhash64("embedding")
        sample = cut_lineage(rows.where(F.pmod(mark, F.lit(every)) == 0).select("embedding")) if every > 1 else cut_lineage(rows.select("embedding"))
        k = cells or min(MOST_CELLS, max(LEAST_CELLS, round(math.sqrt(n))))
        starts = sample.distinct().orderBy(mark, "embedding").limit(max(k, CODES)).toArrow().column("embedding").combine_chunks()
        x = _units(starts)
        centres = train_centres(sample, x[None, :k], ROUNDS, lambda x: x)[0]
        parts = -(-dims // PART)
        q = Quantiser(centres, np.zeros((parts, 1, -(-dims // parts))))
        r = q.residuals(x[:CODES], _nearest(x[:CODES], centres))
        books = np.stack(np.split(r, parts, axis=1))
        q.books = train_centres(sample, books, ROUNDS, lambda x: q.residuals(x, _nearest(x, q.cells)))
        cls._write(rows, q, f"{path}/rows", d)
        index = cls(spark, path, q, d)
        index._calibrate(rows, n, target)
        spark.createDataFrame([(q.cells.tolist(), q.books.tolist(), q.probes, q.rerank, d)], "cells array<array<double>>, books array<array<array<double>>>, probes int, rerank int, d string").coalesce(1).write.parquet(f"{path}/quantiser")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        r = spark.read.parquet(f"{path}/quantiser").first()
        return cls(spark, path, Quantiser(np.array(r["cells"]), np.array(r["books"]), r["probes"], r["rerank"]), r["d"])

    @staticmethod
    def _write(rows: DataFrame, q: Quantiser, path: str, d: str) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    some = batch.slice(at, 4096)
                    cell, codes = q.encode(_units(some.column(1)))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[d, "embedding", "cell", "code"])

        coded = rows.mapInArrow(run, f"`{d}` {rows.schema[d].dataType.simpleString()}, embedding array<double>, cell int, code binary")
        # ranges by cell and hash: a cell of any size is spread, and a file holds few cells, so a filter by cell skips files and row groups
        coded.repartitionByRange("cell", F.xxhash64("embedding")).sortWithinPartitions("cell").withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _order(self, queries: DataFrame, q: str, probes: int) -> DataFrame:
        """(q, embedding, cell) for the `probes` nearest cells of each question."""
        sent = self.spark.sparkContext.broadcast(self.quantiser.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    x, c = _units(some.column(1)), sent.value
                    order = np.argsort((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1, kind="stable")[:, :probes]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[q, "embedding", "order"])

        kind = queries.schema[q].dataType.simpleString()
        return queries.mapInArrow(run, f"`{q}` {kind}, embedding array<double>, order array<int>").select(q, "embedding", F.posexplode("order").alias("place", "cell"))

    def _candidates(self, queries: DataFrame, q: str, probes: int, rerank: int) -> DataFrame:
        """(q, _row, near): the `rerank` rows of the probed cells whose codes are nearest, and some that are farther.

        The nearest cells, which hold a few times as many rows, are looked at first; the distance of their `rerank`-th row is a bound for all further
        cells, from which only nearer rows come. So what comes out grows with questions and `rerank`, not with what is looked at.
        """
        asked = cut_lineage(self._order(queries, q, probes))
        most = min(probes, 1 + math.ceil(2 * rerank * len(self.quantiser.cells) / max(1, self.rows().count())))
        near = written(self._match(asked.where(F.col("place") < most).withColumn("bound", F.lit(float("inf"))), q, rerank))
        if most >= probes:
            return near
        place = F.row_number().over(Window.partitionBy(q).orderBy("near", "_row"))
        bounds = near.withColumn("_n", place).where(F.col("_n") == rerank).select(q, F.col("near").alias("bound"))
        rest = asked.where(F.col("place") >= most).join(bounds, q, "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        return near.unionByName(self._match(rest, q, rerank))

    def _match(self, asked: DataFrame, q: str, rerank: int) -> DataFrame:
        """(q, _row, near): of each group of an asked cell's rows the `rerank` ones at most whose codes are nearest and within the question's bound.

        Questions meet a cell's rows in groups of bounded size: a large cell is dealt out by hash, and so are the questions of a cell
        that many probe. Only codes and questions are shuffled.
        """
        quantiser = self.quantiser
        kind = asked.schema[q].dataType.simpleString()
        asked = cut_lineage(asked.select(q, "embedding", "cell", "bound"))
        rows = self.rows()
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
        if len(wanted) < len(quantiser.cells):
            rows = rows.where(F.col("cell").isin(wanted))
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("i_all")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("j_all")), "cell")
        sizes = F.broadcast(cut_lineage(sizes))  # a row for each cell, at most MOST_CELLS
        part = lambda key, total, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.col(total)).cast("int")
        each = lambda total: F.explode(F.sequence(F.lit(0), F.col(total) - 1))
        right = rows.select("cell", "_row", "code").join(sizes, "cell").withColumn("i", part("_row", "i_all", 1)).withColumn("j", each("j_all")).select("cell", "i", "j", "_row", "code")
        left = asked.join(sizes, "cell").withColumn("j", part(q, "j_all", 2)).withColumn("i", each("i_all")).select("cell", "i", "j", q, "embedding", "bound")

        def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(b):
                codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
                names = b["_row"].to_numpy()
                x = np.stack(a["embedding"].to_numpy())
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
                for at in range(0, len(a), 64):
                    tables = quantiser.tables(x[at : at + 64], int(a["cell"].iloc[0]))
                    near = np.zeros((len(tables), len(b)))
                    for p in range(codes.shape[1]):
                        near += tables[:, p, codes[:, p]]
                    m = min(rerank, len(b))
                    best = np.argpartition(near, m - 1, axis=1)[:, :m]
                    least = np.take_along_axis(near, best, axis=1)
                    row, column = np.nonzero(least <= a["bound"].to_numpy()[at : at + 64, None])
                    out.append(pd.DataFrame({q: a[q].to_numpy()[at : at + 64][row], "_row": names[best[row, column]], "near": least[row, column]}))
            return pd.concat(out) if out else pd.DataFrame({q: a[q].iloc[:0], "_row": np.zeros(0, np.int64), "near": np.zeros(0)})

        return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(match, f"`{q}` {kind}, _row long, near double")

    def _calibrate(self, rows: DataFrame, n: int, target: float) -> None:
        d, quantiser = self.d, self.quantiser
        trial = cut_lineage(rows.orderBy(F.xxhash64(F.lit(3), "embedding"), d).limit(TRIALS).select(F.monotonically_increasing_id().alias("_trial"), "embedding"))
        stored = self.rows()
        true = cut_lineage(dense_top_k(trial, stored, min(n, TRIED), q="_trial", d="_row").select("_trial", "_row"))
        order = self._order(trial, "_trial", len(quantiser.cells)).select("_trial", "cell").collect()  # TRIALS questions, cells in their order
        place: dict[tuple[int, int], int] = {}
        seen: dict[int, int] = {}
        for r in order:
            place[r["_trial"], r["cell"]] = seen[r["_trial"]] = seen.get(r["_trial"], -1) + 1
        places = sorted(place[r["_trial"], r["cell"]] for r in true.join(stored.select("_row", "cell"), "_row").collect())
        quantiser.probes = min(len(quantiser.cells), 1 + places[min(len(places) - 1, math.ceil((target + 1) / 2 * len(places)) - 1)])
        most = 1024
        while True:
            near = self._candidates(trial, "_trial", quantiser.probes, most)
            ranked = near.withColumn("_place", F.row_number().over(Window.partitionBy("_trial").orderBy("near", "_row"))).where(F.col("_place") <= most)
            found = sorted(r["_place"] for r in ranked.join(true, ["_trial", "_row"], "left_semi").collect())
            need = math.ceil(target * len(places))
            if len(found) >= need or most >= n:
                quantiser.rerank = found[min(need, len(found)) - 1]
                return
            most *= 4

    def search(self, queries: DataFrame, k: int, *, q: str = "query_id", vector: str = "embedding", probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """(q, d, distance, rank, n_coded, n_compared): the k nearest indexed rows of each question among those looked at, by exact cosine distance.

        Of the probed cells' rows only the codes are looked at (n_coded of them), of the `rerank` best the vectors (n_compared). There is no other search behind
        it: a question gets what its cells hold. Questions whose vector isn't usable or of another length get no rows. Ties go by id.
        """
        d, quantiser = self.d, self.quantiser
        probes, rerank = min(probes or quantiser.probes, len(quantiser.cells)), max(k, rerank or quantiser.rerank)
        asked = cut_lineage(_usable(queries, q, vector, quantiser.cells.shape[1]))
        best = self._candidates(asked, q, probes, rerank).withColumn("_place", F.row_number().over(Window.partitionBy(q).orderBy("near", "_row"))).where(F.col("_place") <= rerank).select(q, "_row")
        rows = self.rows()
        own = asked.select(q, F.col("embedding").alias("_q"))
        distance = 1 - _dot("_q", "embedding") / F.nullif(F.sqrt(_dot("_q", "_q")) * F.sqrt(_dot("embedding", "embedding")), F.lit(0.0))
        exact = best.join(own, q).join(rows.select("_row", d, "embedding"), "_row").select(q, d, F.coalesce(distance, F.lit(1.0)).alias("distance"))
        w = Window.partitionBy(q)
        ranked = exact.withColumn("n_compared", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("distance", d))).where(F.col("rank") <= k)
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        coded = self._order(asked, q, probes).select(q, "cell").join(sizes, "cell").groupBy(q).agg(F.sum("n").alias("n_coded"))
        return ranked.join(coded, q).select(q, d, "distance", "rank", "n_coded", "n_compared")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
