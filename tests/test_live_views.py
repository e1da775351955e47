"""Views by keyed state against the same views over the newest versions, after any split and with replays."""

import random

import pytest
from pyspark.sql import functions as F

from kadastra.operators.views import materialise
from kadastra.streaming.live_views import KEY, Ledger, LiveViews, collection_after, live_views

VIEWS = {"all": [], "by_a": ["a"], "by_b": ["b"], "a_b": ["a", "b"]}
SCHEMA = "id string, version long, deleted boolean, a string, b string, person string, score double"


def rows_of(seed, n=260):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        i = r.choice([*range(60), None])
        out.append((None if i is None else f"i{i}", r.choice([None, *range(6)]), r.choice([False, False, False, True, None]), r.choice(["x", "y", "z", None, "", "nan"]), r.choice(["u", "v", None]), r.choice(["p", "q", "r", "s", None]), r.choice([None, 0.1, 0.2, 1.5, -3.25, float("nan")])))
    return out


def expected(spark, rows, least):
    """The newest versions, then `materialise`."""
    order = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    clean = lambda r: (r[1], bool(r[2]), *(v if v not in ("", "nan") else None for v in r[3:5]), r[5], None if r[6] is None or r[6] != r[6] else round(r[6] * 10**6))
    newest = {}
    for r in rows:
        if r[0] is not None and (r[0] not in newest or order(clean(r)) > order(newest[r[0]])):
            newest[r[0]] = clean(r)
    live = [(k, *v[2:5], v[5]) for k, v in newest.items() if not v[1]]
    df = spark.createDataFrame(live, "id string, a string, b string, person string, units long")
    v = materialise(df, VIEWS, [F.count_distinct("person").alias("n_persons"), (F.sum("units") / F.count("units") / 10**6).alias("avg_score")], least)
    return shown(v.select("view_name", F.coalesce("dim1_value", F.lit("")).alias("dim1_value"), F.coalesce("dim2_value", F.lit("")).alias("dim2_value"), "n", "n_persons", "avg_score"))


def shown(df):
    return sorted((*(r[c] for c in KEY), r["n"], r["n_persons"], None if r["avg_score"] is None else round(r["avg_score"], 9)) for r in df.collect())


@pytest.mark.parametrize("seed,parts,least", [(1, 5, 1), (2, 3, 4)])
def test_any_split_equals_the_batch_view(spark, tmp_path, seed, parts, least):
    rows = rows_of(seed)
    r = random.Random(seed)
    for k in range(parts):  # rows of all versions in any order, some in two files
        spark.createDataFrame([x for i, x in enumerate(rows) if i % parts == k or r.random() < 0.15], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = live_views(spark, f"{tmp_path}/in", SCHEMA, VIEWS, f"{tmp_path}/out", least=least)
    want = expected(spark, rows, least)
    assert shown(live.view()) == want and len(want) > 8
    assert shown(collection_after(live.changes().unionByName(live.changes()))) == want
    if least > 1:
        assert {x["action"] for x in live.changes().select("action").distinct().collect()} >= {"upsert"}
    assert len(live._batches()) <= 2  # older totals are gone


def test_groups_appear_and_disappear_and_batches_can_be_run_again(spark, tmp_path):
    live = LiveViews(spark, f"{tmp_path}/live", {"by_a": ["a"]}, least=2)
    df = lambda *rows: spark.createDataFrame([("by_a", *r) for r in rows], ", ".join(f"{c} string" for c in KEY) + ", n long, n_scored long, units long, n_persons long")
    for again in range(2):  # a batch that failed after its totals were written is run again
        live.apply(df(("x", "", 1, 1, 10, 1), ("y", "", 2, 0, 0, 1)), 0)
    assert [(r["dim1_value"], r["n"], r["avg_score"]) for r in live.view().collect()] == [("y", 2, None)]
    live.apply(df(("x", "", 1, 1, 20, 0), ("y", "", -1, 0, 0, 0), ("z", "", 0, 0, 0, 0)), 1)
    spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/live/changes/batch=1"), True)
    live.apply(df(("x", "", 1, 1, 20, 0), ("y", "", -1, 0, 0, 0), ("z", "", 0, 0, 0, 0)), 1)
    assert [(r["dim1_value"], r["n"], r["n_persons"], r["avg_score"]) for r in live.view().collect()] == [("x", 2, 1, 15 / 10**6)]
    assert {(r["batch"], r["dim1_value"], r["action"]) for r in live.changes().collect()} == {(0, "y", "upsert"), (1, "x", "upsert"), (1, "y", "delete")}
    live.apply(df(("x", "", -2, -2, -30, -1)), 2)
    assert live.view().count() == 0 and collection_after(live.changes()).count() == 0


def test_no_rows(spark, tmp_path):
    assert LiveViews(spark, f"{tmp_path}/none", VIEWS).view().count() == 0
    assert Ledger(["a"]).schema == "`a` string, `person` string, units long"


def test_batches_are_merged_with_kept_tables_and_run_no_python(spark, tmp_path):
    live = LiveViews(spark, f"{tmp_path}/live", VIEWS)
    rows = lambda *r: spark.createDataFrame(r, SCHEMA)
    first = rows(("1", 1, False, "x", "u", "p", 1.0), ("1", 0, False, "y", "u", "p", 9.0), ("2", 1, False, "x", None, None, 2.0))
    later = rows(("1", 2, False, "x", "u", "p", 1.0), ("2", 1, True, "x", None, None, 2.0), ("1", 0, False, "z", "u", "q", 9.0))
    told = lambda df: sorted((r["view_name"], r["n"], r["n_scored"], r["units"], r["n_persons"]) for r in df.collect())
    for again in range(2):  # a batch that failed after its tables were written finds those before it
        assert told(live.deltas(first, 0)) == [("a_b", 1, 1, 10**6, 1), ("all", 1, 1, 10**6, 1), ("all", 1, 1, 2 * 10**6, 0), ("by_a", 1, 1, 10**6, 1), ("by_a", 1, 1, 2 * 10**6, 0), ("by_b", 1, 1, 10**6, 1)]
    for again in range(2):  # of row 1 only the version is new, row 2 goes
        assert told(live.deltas(later, 1)) == [("all", -1, -1, -2 * 10**6, 0), ("by_a", -1, -1, -2 * 10**6, 0)]
    for plan in (live.deltas(first, 2), live.deltas(later, 3)):
        assert "Python" not in plan._jdf.queryExecution().toString() and "Pandas" not in plan._jdf.queryExecution().toString()
