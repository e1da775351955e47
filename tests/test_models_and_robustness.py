"""The caller's models by worker, summaries of popular groups, the farthest answers of a group against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadastra.operators import evaluation as E
from kadastra.operators import models as M
from kadastra.operators import views as V


def test_model_is_set_up_once_for_each_worker(spark, tmp_path):
    at = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{at}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda values: [len(v) for v in values]

    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.repeat(F.lit("a"), (F.col("id") % 5).cast("int"))).alias("text")).repartition(16)
    got = M.with_model(df, "text", make, "n", "int", batch=10).collect()
    assert all(r.n == (None if r.id % 7 == 0 else r.id % 5) for r in got) and len(got) == 4000
    made = [name.split("-")[0] for name in __import__("os").listdir(at)]
    assert made and len(made) == len(set(made)) < 16


def test_model_gives_vectors_and_a_wrong_count_fails(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    got = M.with_model(df, "text", lambda: lambda vs: [[float(len(v)), 1.0] for v in vs], "v", "array<double>").collect()
    assert {(r.text, tuple(r.v) if r.v else None) for r in got} == {("ab", (2.0, 1.0)), (None, None), ("", (0.0, 1.0))}
    assert M.with_model(df.limit(0), "text", lambda: 1 / 0, "v", "int").collect() == []
    with pytest.raises(Exception, match="results for"):
        M.with_model(df, "text", lambda: lambda vs: [], "v", "int").collect()


def test_summaries_of_hot_null_and_empty_groups(spark, monkeypatch):
    rows = [("hot", i, f"{'x' * (i % 9)}{i % 50}") for i in range(3000)] + [(None, 1, "a"), (None, 2, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, extra long, t string").repartition(9)
    got = {r.g: r.summary for r in M.summaries(df, ["g"], "t").collect()}
    want = {}
    for g in ("hot", None, "none"):
        mine = [t for k, _, t in rows if k == g and t is not None]
        want[g] = f"{len(mine)} réponses : " + " | ".join(sorted(set(mine), key=lambda v: (-len(v), v))[:3])
    assert got == want
    assert M.summaries(df.limit(0), ["g"], "t").collect() == []
    assert [r.summary for r in M.summaries(df, [], "t").collect()] == [M.Longest().finish(M.Longest().add((0, []), [t for _, _, t in rows if t is not None]))]


def test_large_keys_stay_whole_and_states_are_handed_on(spark):
    big = 2**60 + 1
    df = spark.range(25_000, numPartitions=2).select((F.col("id") % 12_000 + big).alias("k"), F.col("id").cast("string").alias("t"))
    got = M.summaries(df, ["k"], "t")
    assert got.count() == 12_000
    assert got.where(F.col("k") == big).first().summary == "3 réponses : 12000 | 24000 | 0"


def test_views_and_their_summaries_have_the_same_rows(spark):
    df = spark.createDataFrame([("A", "x", "t1"), ("A", None, "t22"), ("B", "y", "t3")], "town string, job string, t string")
    views = {"all": [], "by_town": ["town"], "by_both": ["town", "job"]}
    keys = ["view_name", "dim1_value", "dim2_value"]
    got = M.view_summaries(df, views, "t").collect()
    assert {tuple(r[k] for k in keys) for r in got} == {tuple(r[k] for k in keys) for r in V.materialise(df, views, []).collect()}
    assert {r.summary for r in got if r.view_name == "all"} == {"3 réponses : t22 | t1 | t3"}


def _pairs(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = (u @ u.T)[np.triu_indices(len(u), 1)]
    return c.mean(), c.min()


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_farthest_answers_against_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    sizes = {1: 400, 2: 2, 3: 31, 4: 1}
    data = {g: rng.normal(size=8) + spread * rng.normal(size=(n, 8)) for g, n in sizes.items()}
    rows = [(g, i, [float(v) for v in x]) for g, m in data.items() for i, x in enumerate(m)]
    rows += [(3, 98, None), (3, 99, [0.0] * 8), (5, 1, None), (None, 1, [1.0] * 8), (6, 1, [1.0] * 8), (6, 1, [1.0] * 8), (7, 1, [1.0] + [0.0] * 7), (7, 2, [-1.0] + [0.0] * 7)]
    got = {r.g: r for r in E.robustness(spark.createDataFrame(rows, "g long, i long, v array<double>"), "g", "i", "v").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    for g in (1, 2, 3):
        mean, low = _pairs(data[g])
        assert got[g].avg_cos == pytest.approx(mean, abs=1e-9) and got[g].min_cos == pytest.approx(low, abs=1e-9)
    assert got[3].n_answers == 33
    assert got[4].avg_cos is None and got[4].min_cos is None and got[5].n_answers == 1 and got[5].min_cos is None
    assert got[6].min_cos == pytest.approx(1) and got[7].avg_cos == pytest.approx(-1) and got[7].min_cos == pytest.approx(-1)


def test_no_answers(spark):
    assert E.robustness(spark.createDataFrame([], "g long, i long, v array<double>"), "g", "i", "v").collect() == []
