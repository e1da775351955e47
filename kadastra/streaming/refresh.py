"""Views and collections kept current while rows arrive."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class ViewRefresher:
    """A view (keys, n, avg_score) over everything that arrived, refreshed batch by batch.

    Sums and counts are kept for each group: a batch is summed by itself and merged with the sums up to the batch before, so no
    row is read twice. The sums are written to a new folder for each batch, which a reader takes as a whole; a batch
    that is retried finds the sums from before it and counts once. All paths are of a store that the executors share.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], score: str = "score"):
        self.spark, self.root, self.keys, self.score = spark, root.rstrip("/"), list(keys), score

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if self._done(batch_id):
            return
        sums = batch.groupBy(*self.keys).agg(F.count(self.score).alias("n"), F.sum(F.col(self.score).cast("double")).alias("total"))
        old = self._sums(batch_id - 1)
        if old is not None:
            sums = old.unionByName(sums).groupBy(*self.keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        sums.write.mode("overwrite").parquet(f"{self.root}/view/{batch_id:012d}")

    def _done(self, batch_id: int) -> bool:
        return _exists(self.spark, f"{self.root}/view/{batch_id:012d}/_SUCCESS")

    def _sums(self, batch_id: int) -> DataFrame | None:
        while batch_id >= 0:
            if self._done(batch_id):
                return self.spark.read.parquet(f"{self.root}/view/{batch_id:012d}")
            batch_id -= 1
        return None

    def view(self, batch_id: int) -> DataFrame | None:
        """The view as of a batch; None before the first. Groups without any known score are left out."""
        sums = self._sums(batch_id)
        return None if sums is None else sums.where("n > 0").select(*self.keys, "n", (F.col("total") / F.col("n")).alias("avg_score"))

    def start(self, stream: DataFrame, *, available_now: bool = True) -> StreamingQuery:
        w = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint")
        return (w.trigger(availableNow=True) if available_now else w).start()


def refreshed_view(spark: SparkSession, path: str, schema, keys: Sequence[str], root: str, *, prepare=None, files: int = 1) -> DataFrame:
    """Runs a file stream through ViewRefresher to its end and returns the view."""
    run = ViewRefresher(spark, f"{root}/{uuid4().hex}", keys)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    q = run.start(prepare(stream) if prepare else stream)
    q.awaitTermination()
    last = q.lastProgress
    out = run.view(int(last["batchId"]) if last else 0)
    return out if out is not None else spark.createDataFrame([], "n long, avg_score double")


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window under a watermark; works on streams and on tables alike."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"))
