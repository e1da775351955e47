"""Centroids, covers, areas of points and touching areas against brute force on random polygons."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kadastra.operators import geography as Y

SCHEMA = "area string, rings array<array<struct<x:double,y:double>>>"


def closed(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def star(r, x, y, size, n):
    """A simple polygon around a point."""
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return closed([(x + size * r.uniform(0.3, 1) * math.cos(t), y + size * r.uniform(0.3, 1) * math.sin(t)) for t in turns])


def frame(spark, areas):
    return spark.createDataFrame([(a, rings) for a, rings in areas], SCHEMA)


def holds(rings, x, y):
    odd = 0
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:]):
            odd ^= (py > y) != (qy > y) and x < px + (y - py) * (qx - px) / (qy - py)
    return bool(odd)


def polygons(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = 10 ** r.uniform(-3, 3)
        x, y = r.uniform(-50, 50), r.uniform(-50, 50)
        rings = [star(r, x, y, size, r.randint(3, 40))]
        if r.random() < 0.4:
            rings.append(closed([(x + size * 0.05 * math.cos(t), y + size * 0.05 * math.sin(t)) for t in (0.1, 2, 4)]))
        out.append((f"a{i}", rings))
    return out


def test_points_in_areas_of_all_sizes(spark):
    areas = polygons(1, 120)
    r = random.Random(2)
    near = [r.choice(r.choice(areas)[1][0]) for _ in range(300)]
    points = [(f"p{i}", r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(300)] + [(f"q{i}", x + r.gauss(0, 1) * 10 ** r.uniform(-6, 1), y + r.gauss(0, 1) * 10 ** r.uniform(-6, 1)) for i, (x, y) in enumerate(near)]
    df = spark.createDataFrame([*points, ("n", None, 1.0), ("nan", float("nan"), 1.0), ("inf", float("inf"), 1.0)], "name string, x double, y double")
    got = sorted((x["name"], x["area"]) for x in Y.areas_at(df, frame(spark, areas)).collect())
    assert got == sorted((p, a) for p, x, y in points for a, rings in areas if holds(rings, x, y)) and len(got) > 300
    first = {x["name"]: x["area"] for x in Y.point_in_area(df, frame(spark, areas)).collect()}
    assert first == {p: min((a for a, rings in areas if holds(rings, x, y)), default=None) for p, x, y in points} | {"n": None, "nan": None, "inf": None}


def test_covers_are_bounded_and_right(spark):
    areas = [*polygons(3, 60), ("line", [[(0.0, 0.0), (1000.0, 0.001)]]), ("dot", [[(5.0, 5.0), (5.0, 5.0)]]), ("none", []), ("null", None), ("empty", [[]]), ("odd", [[(0.0, float("nan")), (1.0, 1.0)]])]
    cells = [tuple(r) for r in Y.cover(frame(spark, areas)).collect()]
    by = dict(areas)
    names = {c[0] for c in cells}
    assert not names & {"none", "null", "empty", "odd"} and len(names) == 62
    for name in names:
        mine = [c for c in cells if c[0] == name]
        assert len(mine) <= 256
        for _, level, cx, cy, inner in mine:
            if inner:
                r, side = random.Random(name), 2.0**level
                assert all(holds(by[name], (cx + r.random()) * side, (cy + r.random()) * side) for _ in range(20))


def test_inner_cells_answer_for_most_points(spark):
    square = [("s", [closed([(0, 0), (10, 0), (10, 10), (0, 10)])])]
    cells = Y.cover(frame(spark, square)).collect()
    assert sum(4.0 ** c["level"] for c in cells if c["inner"]) > 60


@pytest.mark.parametrize("rings,want", [
    ([closed([(0, 0), (4, 0), (4, 2), (0, 2)])], (2, 1)), ([closed([(0, 0), (0, 2), (4, 2), (4, 0)])], (2, 1)), ([closed([(0, 0), (3, 0), (0, 3)])], (1, 1)),
    ([closed([(0, 0), (4, 0), (4, 4), (0, 4)]), closed([(2, 0), (4, 0), (4, 4), (2, 4)])], (1, 2)),
    ([closed([(0, 0), (9, 0), (9, 9), (0, 9)]), closed([(3, 3), (6, 3), (6, 6), (3, 6)]), closed([(4, 4), (5, 4), (5, 5), (4, 5)])], (4.5, 4.5)),
    ([closed([(0, 0), (1, 0), (1, 1), (0, 1)]), closed([(10, 0), (13, 0), (13, 1), (10, 1)])], (8.75, 0.5)),
    ([closed([(1e7, 1e7), (1e7 + 1, 1e7), (1e7 + 1, 1e7 + 1), (1e7, 1e7 + 1)])], (1e7 + 0.5, 1e7 + 0.5)), ([[(1.0, 1.0), (3.0, 1.0)]], (2, 1)), ([[(1.0, 1.0)]], (1, 1)), ([], (None, None)), (None, (None, None)),
])
def test_centroids(spark, rings, want):
    c = frame(spark, [("a", rings)]).select(Y.centroid(F.col("rings")).alias("c")).first()["c"]
    got = (None, None) if c is None else (c["x"], c["y"])
    assert got == pytest.approx(want) if want[0] is not None else got == want


def meet(a, b):
    """Closed segments with exact arithmetic."""
    turn = lambda p, q, r: (lambda v: (v > 0) - (v < 0))((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    box = all(min(a[0][k], a[1][k]) <= max(b[0][k], b[1][k]) and min(b[0][k], b[1][k]) <= max(a[0][k], a[1][k]) for k in (0, 1))
    return box and turn(*a, b[0]) * turn(*a, b[1]) <= 0 and turn(*b, a[0]) * turn(*b, a[1]) <= 0


def neighbours(areas):
    exact = {n: [[(Fraction(round(x * 10**6)), Fraction(round(y * 10**6))) for x, y in ring] for ring in rings] for n, rings in areas}
    out = set()
    for a in exact:
        for b in exact:
            if a != b:
                cross = any(meet(s, t) for r in exact[a] for s in zip(r, r[1:]) for q in exact[b] for t in zip(q, q[1:]))
                if cross or any(holds(dict(areas)[b], *ring[0]) for ring in dict(areas)[a]):
                    out.add((a, b))
    return out


def test_every_kind_of_contact(spark):
    sq = lambda x, y, s=1: [closed([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])]
    areas = [
        ("a", sq(0, 0)), ("edge", sq(1, 0)), ("corner", sq(1, 1)), ("part", sq(-3, 0.25, 3)), ("cross", sq(0.5, -0.5)), ("inside", sq(0.2, 0.2, 0.1)), ("far", sq(40, 40)), ("around", sq(-100, -100, 200)),
        ("gap", sq(2.0000004, 5)), ("left of gap", sq(1, 5)), ("gap of more", sq(2.00001, 7)), ("left of more", sq(1, 7)), ("touches inside", [closed([(0.0, 0.4), (0.1, 0.3), (0.1, 0.5)])]), ("holed", [*sq(60, 60, 9), *sq(62, 62, 5)]), ("in hole", sq(63, 63)), ("fills hole", sq(62, 62, 5)),
    ]
    got = {tuple(r) for r in Y.touching(frame(spark, areas)).collect()}
    assert got == neighbours(areas)
    assert {("a", "corner"), ("corner", "a"), ("a", "part"), ("a", "cross"), ("inside", "a"), ("a", "around"), ("a", "touches inside"), ("gap", "left of gap"), ("fills hole", "holed")} <= got
    assert not {("a", "inside"), ("around", "a"), ("gap of more", "left of more"), ("in hole", "holed"), ("a", "far")} & got


@pytest.mark.parametrize("seed", [1, 2])
def test_touching_random_areas_of_all_sizes(spark, seed):
    r = random.Random(seed)
    areas = [(n, [[(round(x, 3), round(y, 3)) for x, y in ring] for ring in rings]) for n, rings in polygons(seed, 45)]
    areas += [(f"g{i}", [closed([(x, y), (x + 1, y), (x + 1, y + 1)])]) for i, (x, y) in enumerate((r.randrange(6), r.randrange(6)) for _ in range(15))]
    got = {tuple(x) for x in Y.touching(frame(spark, areas)).collect()}
    assert got == neighbours(areas) and len(got) > 50


def test_touching_of_nothing(spark):
    assert Y.touching(frame(spark, [])).count() == 0
    assert Y.touching(frame(spark, [("a", None), ("b", []), ("c", [[]]), (None, [closed([(0, 0), (1, 0), (0, 1)])])])).count() == 0


def test_areas_and_cells_are_never_broadcast(spark):
    areas = frame(spark, polygons(5, 30))
    points = spark.createDataFrame([("p", 0.0, 0.0)], "name string, x double, y double")
    for found in (Y.areas_at(points, areas), Y.point_in_area(points, areas)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()  # files don't tell how many cells there are
    cells = Y.cover(areas, edges=True).collect()
    assert all((not c["edges"]) or not c["inner"] for c in cells) and any(c["edges"] for c in cells)


def test_touching_pairs_are_made_once_and_not_shuffled(spark):
    found = Y.touching(frame(spark, polygons(6, 20)).where("size(rings[0]) < 20"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pairs = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in pairs and "Exchange" not in pairs  # the pairs grow with the square of the rows
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) > 0


@pytest.mark.parametrize("most", [2, 7, 4096])
def test_touching_in_cells_of_many_areas(spark, monkeypatch, most):
    monkeypatch.setattr(Y, "CELL_ROWS", most)
    r = random.Random(most)
    shapes = [[closed([(x, y), (x + s, y), (x, y + s)])] for x, y, s in ((r.randrange(12), r.randrange(12), r.choice([1, 2, 9])) for _ in range(25))]
    areas = [(f"t{i}", rings) for i, rings in enumerate([*shapes, *shapes[:12], *shapes[:6]])]  # some are copies
    got = [tuple(x) for x in Y.touching(frame(spark, areas)).collect()]
    assert len(got) == len(set(got)) and set(got) == neighbours(areas)


def test_touching_areas_of_few_and_many_points_and_rows(spark):
    r = random.Random(9)
    rows = [(n, [star(r, r.uniform(-9, 9), r.uniform(-9, 9), 10 ** r.uniform(-1, 1), k)]) for n, k in ((f"n{i % 18}", r.choice([3, 5, 40, 90])) for i in range(24))]
    rows = [(n, [[(round(x, 3), round(y, 3)) for x, y in ring] for ring in rings]) for n, rings in rows]
    single = neighbours([(str(i), rings) for i, (_, rings) in enumerate(rows)])
    want = {(rows[int(a)][0], rows[int(b)][0]) for a, b in single if rows[int(a)][0] != rows[int(b)][0]}
    got = [tuple(x) for x in Y.touching(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_touching_is_exact_for_large_areas(spark):
    base = [closed([(0, 0), (300000, 100000), (0, 100000)])]
    at = lambda x, y: [closed([(x, y), (x + 200000, y - 150000), (x + 250000, y - 100000)])]
    areas = [("base", base), ("on", at(150000, 50000)), ("on too", at(150000.000003, 50000.000001)), ("off", at(150000.000003, 50000)), ("over", at(150000.000002, 50000.000001))]
    got = {tuple(x) for x in Y.touching(frame(spark, areas)).collect()}
    assert got == neighbours(areas) and ("base", "off") not in got and {("base", "on"), ("base", "on too"), ("base", "over")} <= got
