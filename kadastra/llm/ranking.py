"""Quality classifier by Bradley-Terry pairwise ranking (op4)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, table
from kadastra.operators.ranking import counts_before

#: Pairs that each document of the smaller class takes part in.
RIVALS = 8
#: Newton steps, ridge and the score at which a document counts as good.
STEPS, RIDGE, CUT = 12, 1e-2, 0.7
_CLASSES = [
    np.frombuffer(x, np.uint8)
    for x in (b"#$%&*", b"!?", b"|", b"0123456789", b".,;:", b"()[]{}<>/\\=+_~^@", b"\"'`-", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"\n\r", b" \t\x0b\x0c")
]
#: Number of features of a text.
WIDTH = 2 * len(_CLASSES) + 12


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, word lengths, repetition and compressibility of the whole text.

    Null counts as empty, which has all features 0.
    """
    raw = (text or "").encode()
    out = np.zeros(WIDTH)
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(_CLASSES)
    share = np.array([counts[c].sum() for c in _CLASSES]) / n
    out[:k] = share
    out[k : 2 * k] = np.sqrt(share)
    lines = raw.split(b"\n")
    distinct = len(set(words))
    odd = sum(counts[0:9]) + sum(counts[14:32]) + counts[127]
    out[2 * k :] = [
        math.log1p(len(words)) / 10,
        (n / len(words)) / 20,
        distinct / len(words),
        len({*lines}) / len(lines),
        min(1.0, len(zlib.compress(raw, 1)) / n),
        counts[128:].sum() / n,
        odd / n,
        sum(a == b for a, b in zip(words, words[1:])) / len(words),
        max(map(len, words)) / n,
        math.log1p(n / len(lines)) / 10,
        1 / (1 + len(words)),
        1.0 if distinct * 4 < len(words) else 0.0,
    ]
    return out


def _featured(columns: list[str], text: str, then):
    """A mapInArrow function that keeps `columns` and adds what `then` makes of the feature matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(batch.schema.get_field_index(text))]).reshape(-1, WIDTH)
            new = then(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *new.values()], names=[*columns, *new])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, *, row_id: str = "doc_id") -> DataFrame:
    """(row_id, label, x): features of all labelled documents.

    Texts become features where they lie, so only features are shuffled to meet the labels; neither side is broadcast.
    """
    given = labels.where("quality in (0, 1)").select(row_id, F.col("quality").cast("int").alias("label")).distinct()
    rows = docs.select(row_id, "text").mapInArrow(
        _featured([row_id], "text", lambda x: {"x": pa.array(list(x), pa.list_(pa.float64()))}),
        f"{row_id} {docs.schema[row_id].dataType.simpleString()}, x array<double>",
    )
    return rows.join(given.hint("merge"), row_id).select(row_id, "label", "x")


def numbered(rows: DataFrame, *, row_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """((label, x, rank), rows of each label): each class numbered from 0 in the order of a hash of the id.

    Rows are dealt out by ranges of that order and numbered within each; the driver adds up the ranges, two numbers each.
    """
    order = [F.xxhash64(row_id, F.lit(7)), F.col(row_id), F.xxhash64("x")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(rows.repartitionByRange(parts, "label", *order).withColumn("_range", F.spark_partition_id()))
    sizes, offsets = {}, []
    for r in sorted(ranged.groupBy("label", "_range").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["label"], r["_range"])):
        offsets += [F.lit(2 * r["_range"] + r["label"]), F.lit(sizes.get(r["label"], 0))]
        sizes[r["label"]] = sizes.get(r["label"], 0) + r["n"]
    offset = F.create_map(*offsets)[2 * F.col("_range") + F.col("label")] if offsets else F.lit(0)
    w = Window.partitionBy("_range", "label").orderBy(*order)
    return ranged.select("label", "x", (F.row_number().over(w) - 1 + offset).cast("long").alias("rank")), sizes


def preference_pairs(rows: DataFrame, *, row_id: str = "doc_id", rivals: int = RIVALS) -> DataFrame:
    """(d): feature differences better - worse; each row meets `rivals` of the other class by rank.

    The join is on a computed rank, so it makes `rivals` rows for each row of the larger class
    and no cross product.
    """
    ranked, sizes = numbered(rows, row_id=row_id)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    few, n_few = (0, n0) if n0 <= n1 else (1, n1)
    many = ranked.where(F.col("label") != few).select(F.col("x").alias("xm"), "rank")
    many = many.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(rivals - 1))))
    many = many.withColumn("rival", F.pmod(F.col("rank") + F.col("k") * 7919, F.lit(max(n_few, 1))))
    one = ranked.where(F.col("label") == few).select(F.col("x").alias("xf"), F.col("rank").alias("rival"))
    sign = 1.0 if few == 0 else -1.0
    return many.join(one, "rival").select(F.zip_with("xm", "xf", lambda a, b: (a - b) * sign).alias("d"))


def fit_bradley_terry(pairs: DataFrame, *, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise log(1 + exp(-w.d)) over the preference pairs, by Newton's method.

    Each step sums gradient and curvature by partition on the cluster; the driver gets one small
    matrix for each partition. Without pairs the weights are all 0.
    """
    pairs = checkpoint(pairs)
    w = np.zeros(WIDTH)
    for _ in range(steps):

        def part(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            g, h, n = np.zeros(WIDTH), np.zeros((WIDTH, WIDTH)), 0
            for batch in batches:
                d = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
                p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
                g -= p @ d
                h += (d * (p * (1 - p))[:, None]).T @ d
                n += len(d)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([g], pa.list_(pa.float64())), pa.array([h.ravel()], pa.list_(pa.float64()))], names=["n", "g", "h"])

        sums = pairs.mapInArrow(part, "n long, g array<double>, h array<double>").collect()
        n = sum(r["n"] for r in sums)
        if not n:
            return w
        g = sum(np.array(r["g"]) for r in sums) / n + ridge * w / 10
        h = sum(np.array(r["h"]) for r in sums).reshape(WIDTH, WIDTH) / n + ridge / 10 * np.eye(WIDTH)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """(weights, cut, scale), all from all labelled rows: the cut is the quantile of the raw scores below which the share of label 0 lies.

    So many of the labelled rows are rejected as the labels reject, as nearly as ties allow; the cut stands in the middle of the gap between two scores.
    The scale is half the median distance from it. Rows without a label of 0 or 1 are passed
    over, and ids that repeat count once for each label. Ties share a side. Without labels, or with labels of one kind only, the model is empty.
    """
    rows = checkpoint(training_rows(docs, labels))
    w = fit_bradley_terry(preference_pairs(rows))
    if not w.any():
        return w, 0.0, 1.0
    scored = rows.select("label", F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("raw"))
    by = checkpoint(counts_before(scored, "raw", descending=False))
    n, least = by.agg(F.sum("n"), F.min("raw")).first()
    off = F.abs(F.col("before") - scored.where("label = 0").count())
    gaps = by.where("before > 0").withColumn("off", off)
    closest = gaps.agg(F.min("off")).first()[0]
    if closest is None:
        cut = float(least)
    else:
        first, last = gaps.where(F.col("off") == closest).agg(F.min("raw"), F.max("raw")).first()
        cut = (by.where(F.col("raw") < first).agg(F.max("raw")).first()[0] + last) / 2
    away = counts_before(scored.select(F.abs(F.col("raw") - cut).alias("away")), "away", descending=False)
    middle = away.where((F.col("before") <= n // 2) & (F.lit(n // 2) < F.col("before") + F.col("n"))).first()["away"]
    return w, cut, float(max(middle / 2, 1e-6))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float, float], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with score and predicted.

    The score is logistic in the raw score and equals 0.7 at the model's quantile; a model
    fitted on nothing gives 0.7 to every text. Empty and null texts are scored like any other, by
    features that are all 0. Equal texts have equal scores, repeated rows stay, an empty table gives an empty result. Existing
    columns of the two names are replaced.
    """
    w, cut, scale = model
    columns = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]

    def then(x: np.ndarray) -> dict[str, pa.Array]:
        z = np.clip((x @ w - cut) / scale + math.log(CUT / (1 - CUT)), -30, 30) if w.any() else np.full(len(x), math.log(CUT / (1 - CUT)) + 1e-9)
        s = 1 / (1 + np.exp(-z))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= CUT).astype(np.int32), pa.int32())}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    source = docs.select(*dict.fromkeys([*columns, text]))
    return source.mapInArrow(_featured(columns, text, then), f"{schema}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: remainder 2 of the crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_quality(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, float, float]:
    """The model from the given labels, without the held-out rows."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return fit(table(spark, sf_dir, "documents"), labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, train_quality(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
