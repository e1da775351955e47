"""Counts before, average ranks, medians and agreement by group against plain Python, with one group that holds most rows."""

import math
import random
from statistics import median

import pytest

from kadastra.operators import evaluation as E
from kadastra.operators import ranking as K


def rows_of(seed, values):
    r = random.Random(seed)
    group = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    return [(group(), r.choice([1, None]), r.choice(values), r.choice(values)) for _ in range(900)] + [("single", 1, 2.0, 3.0), ("none", 1, None, None), ("flat", 1, 1.0, 1.0), ("flat", 1, 1.0, 2.0)]


@pytest.mark.parametrize("seed,values", [(1, [None, 0.5, 1.0, 2.0, 3.5]), (2, [None, *[i / 7 for i in range(500)]]), (3, [1.0])])
def test_counts_ranks_and_medians(spark, seed, values):
    rows = rows_of(seed, values)
    df = spark.createDataFrame(rows, "g string, h int, v double, w double").repartition(6)
    by = {}
    for g, h, v, _ in rows:
        by.setdefault((g, h), []).append(v)
    got = {(r["g"], r["h"], r["v"]): (r["n"], r["before"]) for r in K.group_counts_before(df, ["g", "h"], "v").collect()}
    low = lambda v: -math.inf if v is None else v
    assert got == {(*k, v): (sum(x == v for x in vs), sum(low(x) < low(v) for x in vs)) for k, vs in by.items() for v in set(vs)}
    ranks = {(r["g"], r["h"], r["v"]): r["r"] for r in E.average_ranks(df, ["g", "h"], "v", "r").collect()}
    assert all(ranks[k] == before + (n + 1) / 2 for k, (n, before) in got.items())
    medians = {(r["g"], r["h"]): r["median"] for r in K.group_medians(df, ["g", "h"], "v").collect()}
    assert medians == pytest.approx({k: median(x for x in vs if x is not None) for k, vs in by.items() if any(x is not None for x in vs)})


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    sxy, sxx, syy = (sum(a * b for a, b in z) for z in (list(zip([v - mx for v in x], [v - my for v in y])), [(v - mx, v - mx) for v in x], [(v - my, v - my) for v in y]))
    return None if sxx == 0 or syy == 0 else sxy / math.sqrt(sxx * syy)


@pytest.mark.parametrize("seed,values", [(1, [None, 1.0, 2.0, 3.0, 4.0, 5.0]), (2, [None, *[i / 3 for i in range(400)]])])
def test_agreement(spark, seed, values):
    rows = rows_of(seed, values)
    got = {(r["g"], r["h"]): r for r in E.agreement(spark.createDataFrame(rows, "g string, h int, v double, w double"), ["g", "h"], "v", "w").collect()}
    by = {}
    for g, h, v, w in rows:
        if v is not None and w is not None:
            by.setdefault((g, h), []).append((v, w))
    assert got.keys() == by.keys()
    rank = lambda xs: [sum(x < v for x in xs) + (sum(x == v for x in xs) + 1) / 2 for v in xs]
    for k, pairs in by.items():
        x, y = zip(*pairs)
        want = pearson(rank(x), rank(y))
        assert got[k]["n"] == len(pairs) and (got[k]["spearman"] == pytest.approx(want, abs=1e-9) if want is not None else got[k]["spearman"] is None)
        assert got[k]["bias"] == pytest.approx(sum(b - a for a, b in pairs) / len(pairs)) and got[k]["exact_pct"] == pytest.approx(100 * sum(a == b for a, b in pairs) / len(pairs))
