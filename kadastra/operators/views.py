"""Pre-aggregated views over grouping sets, their lineage and the pick of the most specific one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialise(df: DataFrame, views: dict[str, Sequence[str]], aggs: Sequence[Column], least: int = 1, count: str = "n", exempt: Sequence[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """(view_name, specificity, dim1/dim2 name and value, n, ...): all views in one pass over the rows.

    `views` gives each view's dimensions, two at most, none for the whole. Rows without one of a view's keys
    are left out of that view; groups under the minimum too, but for the views in `exempt`. `rename` gives dimensions other names in the result.
    """
    dims = list(dict.fromkeys(d for ds in views.values() for d in ds))
    sets = [list(ds) for ds in views.values()]
    valid = df.select(*(F.when(F.trim(F.col(c).cast("string")).isin("", "nan"), None).otherwise(F.col(c)).alias(c) if c in dims else F.col(c) for c in df.columns))
    grouped = valid.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in dims)).agg(
        *(F.grouping(c).alias(f"_g_{c}") for c in dims), F.count("*").alias(count), *aggs
    )
    name = F.lit(None).cast("string")
    spec, one, one_v, two, two_v = F.lit(0), *(F.lit(None).cast("string") for _ in range(4))
    keys = F.lit(True)
    for v, ds in views.items():
        here = F.lit(True)
        for c in dims:
            here = here & (F.col(f"_g_{c}") == (0 if c in ds else 1))
        name = F.when(here, F.lit(v)).otherwise(name)
        spec = F.when(here, F.lit(len(ds))).otherwise(spec)
        for i, c in enumerate(ds):
            public = (rename or {}).get(c, c)
            keys = keys & (~here | F.col(c).isNotNull())
            if i == 0:
                one, one_v = F.when(here, F.lit(public)).otherwise(one), F.when(here, F.col(c).cast("string")).otherwise(one_v)
            else:
                two, two_v = F.when(here, F.lit(public)).otherwise(two), F.when(here, F.col(c).cast("string")).otherwise(two_v)
    enough = F.col(count) >= least
    out = grouped.select(name.alias("view_name"), spec.alias("specificity"), one.alias("dim1_name"), one_v.alias("dim1_value"), two.alias("dim2_name"), two_v.alias("dim2_value"), keys.alias("_k"), *(c for c in grouped.columns if c not in dims and not c.startswith("_g_")))
    return out.where(F.col("_k") & (enough | F.col("view_name").isin(list(exempt)) if exempt else enough)).drop("_k")


def lineage(df: DataFrame, views: dict[str, Sequence[str]], row_id: str) -> DataFrame:
    """(view_name, dim1_value, dim2_value, row_id): which rows stand behind which view row.

    A table of its own: id lists inside a view's row would grow without bound with a popular group.
    """
    items = F.array(*(F.struct(F.lit(v).alias("view_name"), *(F.col(ds[i]).cast("string").alias(f"dim{i + 1}_value") if i < len(ds) else F.lit(None).cast("string").alias(f"dim{i + 1}_value") for i in range(2))) for v, ds in views.items()))
    wants = {v: len(ds) for v, ds in views.items()}
    out = df.select(F.col(row_id), F.explode(items).alias("x")).select("x.*", row_id)
    full = F.lit(False)
    for v, k in wants.items():
        full = full | ((F.col("view_name") == v) & (F.lit(k < 1) | F.col("dim1_value").isNotNull()) & (F.lit(k < 2) | F.col("dim2_value").isNotNull()))
    return out.where(full)


def persons(row_id: str, parts: Sequence[str]) -> Column:
    """Distinct persons: the questionnaire id, or else the profile, counted once each."""
    return F.count_distinct(F.coalesce(F.col(row_id).cast("string"), F.concat_ws("|", *parts)))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Rows of both by key, the latest version wins, the new side at equal versions."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_side").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_side")


def only_new(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def prefix_once(rows: DataFrame, prefixes: DataFrame, key: str = "collection", text: str = "text") -> DataFrame:
    """Each text with its collection's prefix, unless it begins with it already."""
    j = rows.join(F.broadcast(prefixes), key, "left")
    return j.withColumn(text, F.when(F.col("prefix").isNotNull() & ~F.startswith(F.col(text), F.col("prefix")), F.concat("prefix", text)).otherwise(F.col(text))).drop("prefix")


def backfill(rows: DataFrame, known: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """`rows` with the value of the last known row of equal keys; null where there is none."""
    last = known.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").select(*keys, value)
    return rows.join(last, list(keys), "left")


def most_specific(questions: DataFrame, views: DataFrame, order: Sequence[str], key: str = "q") -> DataFrame:
    """For each question the first view in `order` whose dimensions it names and which exists.

    `questions` have (q, view_name, dim1_value, dim2_value) candidate rows; null values match null.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("view_name"))
    q = questions.select(key, "view_name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("dim1_value", "dim2_value")))
    v = views.withColumns({c: F.coalesce(c, F.lit("")) for c in ("dim1_value", "dim2_value")})
    j = q.join(v, ["view_name", "dim1_value", "dim2_value"])
    return j.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(place))).where("rn = 1").drop("rn")


def pick_by_tier(candidates: DataFrame, key: str, tier: Column, order: Sequence[Column]) -> DataFrame:
    """The best candidate of the first tier that has any."""
    w = Window.partitionBy(key).orderBy(tier, *order)
    return candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def fallback_view(questions: DataFrame, exact: DataFrame, nearest: DataFrame, whole: DataFrame, reach: float = 0.60, strict: bool = False, key: str = "q") -> DataFrame:
    """(key, doc, tier) for each question: a view of its town, else the nearest within reach, else the whole's view.

    questions (key, town), exact (town, doc), nearest (key, doc, town, distance), whole (doc), a row at most. Of several views of a
    town the least doc is taken. With `strict` there is neither the first tier nor the last, and the nearest view
    is refused if it is of a town that the question doesn't name. Questions without any view have a null doc.
    """
    known = questions.where("town is not null").join(exact.groupBy("town").agg(F.min("doc").alias("doc")), "town").select(key, "doc", F.lit(1).alias("tier"))
    near = nearest.where(F.col("distance") <= reach).select(key, "doc", F.col("town").alias("_of"), "distance").join(questions, key)
    if strict:
        near = near.where(F.col("_of").isNull() | F.coalesce(F.col("_of") == F.col("town"), F.lit(False)))
    near = pick_by_tier(near, key, F.col("distance"), [F.col("doc")]).select(key, "doc", F.lit(2).alias("tier"))
    last = questions.select(key).crossJoin(F.broadcast(whole.select("doc"))).select(key, "doc", F.lit(3).alias("tier"))  # one row
    found = near if strict else known.unionByName(near).unionByName(last)
    return questions.select(key).join(pick_by_tier(found, key, F.col("tier"), [F.col("doc")]), key, "left")
