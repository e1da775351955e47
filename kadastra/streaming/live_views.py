"""Views over all grouping sets kept current by keyed tables: corrections, deletions and thresholds crossed both ways."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kadastra.streaming.refresh import _exists

KEY = ("view_name", "dim1_value", "dim2_value")
SUMS = ("n", "n_scored", "units", "n_persons")


class Ledger:
    """For each id the newest version of its row, and what a change takes out (sign -1) and puts in (sign 1).

    Versions that are older or the same change nothing, so replayed and late rows count once. Of different rows with one
    version the greatest counts, in whatever order they arrive; nulls are least.
    """

    def __init__(self, dims: Sequence[str]):
        self.fields = [*dims, "person", "units"]
        self.schema = ", ".join(f"`{c}` string" for c in [*dims, "person"]) + ", units long"

    def merge(self, given: DataFrame, old: DataFrame | None) -> DataFrame:
        """(id, newest, before): the newest row of every id after a batch (id, version, deleted, fields) and the one before it, null for new ids. `old` is what the batch before left."""
        row = F.struct("version", "deleted", *self.fields)
        every = given.select("id", row.alias("newest"), F.when(F.lit(False), row).alias("before"))
        if old is not None:
            every = every.unionByName(old.select("id", "newest", F.col("newest").alias("before")))
        return every.groupBy("id").agg(F.max("newest").alias("newest"), F.max("before").alias("before"))

    def changes(self, merged: DataFrame) -> DataFrame:
        """(sign, fields) of the ids whose row is another than before; rows that only got a later version are left out."""
        row = lambda c: F.when(F.col(c).isNotNull() & ~F.col(f"{c}.deleted"), F.struct(*(F.col(f"{c}.{f}").alias(f) for f in self.fields)))
        both = merged.where(~F.col("newest").eqNullSafe(F.col("before"))).select(row("before").alias("was"), row("newest").alias("now")).where(~F.col("was").eqNullSafe(F.col("now")))
        sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("r")))
        return both.select(F.explode(sides).alias("x")).where("x.r is not null").select("x.sign", "x.r.*")


def members(moves: DataFrame, old: DataFrame | None) -> DataFrame:
    """(key, person, live, n, n_scored, units, n_persons): live rows of each view's group and person after a batch, and what the batch changes.

    Moves (key, person, sign, units) are summed first; `old` is what the batch before left. Rows without a person change sums only.
    """
    scored = F.col("units").isNotNull()
    sums = moves.groupBy(*KEY, "person").agg(F.sum("sign").alias("n"), F.coalesce(F.sum(F.when(scored, F.col("sign"))), F.lit(0)).alias("n_scored"), F.coalesce(F.sum(F.col("sign") * F.col("units")), F.lit(0)).alias("units"))
    every = sums.withColumn("before", F.lit(0).cast("long"))
    if old is not None:
        none = [F.lit(0).cast("long").alias(c) for c in ("n", "n_scored", "units")]
        every = every.unionByName(old.where("live <> 0 and person is not null").select(*KEY, "person", *none, F.col("live").alias("before")))
        every = every.groupBy(*KEY, "person").agg(*(F.sum(c).alias(c) for c in ("n", "n_scored", "units", "before")))
    live = F.col("before") + F.col("n")
    came = F.when(F.col("person").isNotNull(), (live > 0).cast("long") - (F.col("before") > 0).cast("long")).otherwise(F.lit(0).cast("long"))
    return every.select(*KEY, "person", live.alias("live"), "n", "n_scored", "units", came.alias("n_persons")).where("live <> 0 or n <> 0 or n_scored <> 0 or units <> 0 or n_persons <> 0")


class LiveViews:
    """Views (view_name, dim1_value, dim2_value, n, n_persons, avg_score) over the newest version of every row.

    `views` gives each view's dimensions, two at most, as for `materialise`; rows without one of a view's keys are left out of that view. Groups with fewer than `least`
    rows aren't shown: they appear when they reach it and disappear when corrections or deletions take them below.
    Scores are summed as integers of `digits` decimals, so what a correction takes out is exactly what was put in.

    Three keyed tables are kept: the newest row of each id, the live rows of each (group, person) and the groups' sums. A batch is merged with each by one grouping, so no
    key grows with a popular group, and each is written anew for each batch: a batch costs as much as what it brings and what is kept, so batches should be large. A batch that
    is run again finds the tables from before it. Tables older than the last two batches are deleted. All paths are of a store that the executors share.
    """

    def __init__(self, spark: SparkSession, root: str, views: dict[str, Sequence[str]], *, least: int = 1, digits: int = 6):
        self.spark, self.root, self.views, self.least, self.digits = spark, root.rstrip("/"), views, least, digits
        self.dims = list(dict.fromkeys(c for ds in views.values() for c in ds))

    def deltas(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """(key, n, n_scored, units, n_persons) changes of a batch (id, version, deleted, person, score and the dimensions). Rows without id are dropped."""
        clean = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin("", "nan"), F.col(c).cast("string"))
        units = F.round(F.col("score").cast("double") * 10**self.digits).cast("long")
        usable = F.when(F.col("score").cast("double").isNotNull() & ~F.isnan(F.col("score").cast("double")), units)
        given = rows.where(F.col("id").isNotNull()).select(
            F.col("id").cast("string").alias("id"), F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
            *(clean(c).alias(c) for c in self.dims), F.col("person").cast("string").alias("person"), usable.alias("units"),
        )
        ledger = Ledger(self.dims)
        newest = self._kept("newest", ledger.merge(given, self._last("newest", batch_id - 1)), batch_id)
        value = lambda ds, i: F.col(ds[i]) if i < len(ds) else F.lit("")
        present = lambda ds: F.least(F.lit(True), F.lit(True), *(F.col(c).isNotNull() for c in ds))
        sets = F.array(*(F.when(present(ds), F.struct(F.lit(v).alias("view_name"), value(ds, 0).alias("dim1_value"), value(ds, 1).alias("dim2_value"))) for v, ds in self.views.items()))
        spread = ledger.changes(newest).select("sign", "units", "person", F.explode(F.array_compact(sets)).alias("x")).select("sign", "units", "person", "x.*")
        live = self._kept("members", members(spread, self._last("members", batch_id - 1)), batch_id)
        return live.where("n <> 0 or n_scored <> 0 or units <> 0 or n_persons <> 0").select(*KEY, *SUMS)

    def start(self, stream: DataFrame, *, available_now: bool = True) -> StreamingQuery:
        w = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.root}/checkpoint")
        return (w.trigger(availableNow=True) if available_now else w).start()

    def take(self, rows: DataFrame, batch_id: int) -> None:
        """Merges a batch of rows with the tables before it."""
        if not self._done(batch_id):
            self.apply(self.deltas(rows, batch_id), batch_id)

    def _done(self, batch_id: int) -> bool:
        return _exists(self.spark, f"{self.root}/changes/batch={batch_id}/_SUCCESS")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a batch of changes with the totals before it and writes the new totals and what the batch changes in the shown view."""
        if self._done(batch_id):
            return
        old = self.totals(batch_id - 1)
        mine = batch.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS))
        marked = mine.select(*KEY, *SUMS, F.lit(True).alias("_now"), F.lit(0).cast("long").alias("_before"))
        if old is not None:
            marked = marked.unionByName(old.select(*KEY, *SUMS, F.lit(False).alias("_now"), F.col("n").alias("_before")))
        all_ = marked.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS), F.max("_now").alias("_now"), F.sum("_before").alias("_before"))
        now = self._kept("totals", all_.where("n <> 0 or _now"), batch_id).where("_now")
        shown = F.col("n") >= self.least
        action = F.when(shown, F.lit("upsert")).when(F.col("_before") >= self.least, F.lit("delete"))
        now.select(*KEY, action.alias("action"), *self._measures()).where("action is not null").write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        self._forget(batch_id)

    def _measures(self) -> list[Column]:
        return [F.col("n"), F.col("n_persons"), (F.col("units") / F.nullif(F.col("n_scored"), F.lit(0)) / 10**self.digits).alias("avg_score")]

    def totals(self, batch_id: int | None = None) -> DataFrame | None:
        """The groups' sums after a batch, the last one if none is named; None before the first."""
        last = self._last("totals", batch_id)
        return None if last is None else last.where("n <> 0").select(*KEY, *SUMS)

    def _kept(self, table: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows written as the table that the batch leaves, and read again."""
        path = f"{self.root}/{table}/{batch_id:012d}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _last(self, table: str, batch_id: int | None = None) -> DataFrame | None:
        """What a batch left of a table, the last one if none is named; None before the first."""
        done = [b for b in self._batches(table) if (batch_id is None or b <= batch_id) and _exists(self.spark, f"{self.root}/{table}/{b:012d}/_SUCCESS")]
        return self.spark.read.parquet(f"{self.root}/{table}/{max(done):012d}") if done else None

    def _folder(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, table: str = "totals") -> list[int]:
        path, store = self._folder(table)
        return sorted(int(s.getPath().getName()) for s in store.listStatus(path)) if store.exists(path) else []

    def _forget(self, batch_id: int) -> None:
        for table in ("newest", "members", "totals"):
            path, store = self._folder(table)
            for b in self._batches(table):
                if b < batch_id - 1:
                    store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{b:012d}"), True)

    def view(self) -> DataFrame:
        """The view as it stands: the groups that reach the minimum."""
        totals = self.totals()
        if totals is None:
            totals = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in KEY) + ", " + ", ".join(f"{c} long" for c in SUMS))
        return totals.where(F.col("n") >= self.least).select(*KEY, *self._measures())

    def changes(self) -> DataFrame:
        """(batch, key, action, n, n_persons, avg_score): upserts and deletions for a collection that holds a document for each shown group."""
        return self.spark.read.parquet(f"{self.root}/changes")


def collection_after(changes: DataFrame) -> DataFrame:
    """The collection that all changes leave: each key's last one, if it isn't a deletion. Changes may be read more than once."""
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("batch").desc()))
    return changes.withColumn("_n", last).where("_n = 1 and action = 'upsert'").drop("_n", "batch", "action")


def live_views(spark: SparkSession, path: str, schema, views: dict[str, Sequence[str]], root: str, *, prepare=None, files: int = 1, **options) -> LiveViews:
    """Runs a file stream through LiveViews to its end; `prepare` makes (id, version, deleted, person, score, dimensions) of its rows."""
    live = LiveViews(spark, f"{root}/{uuid4().hex}", views, **options)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    live.start(prepare(stream) if prepare else stream).awaitTermination()
    return live
