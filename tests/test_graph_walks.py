"""Closures, typed indicators, searches of nodes and walks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kadastra.operators import graph as G
from kadastra.operators import ontology as O


def steps_of(edges, start):
    out = {}
    for origin, node in start:
        frontier, d = {node}, 1
        while frontier:
            for n in frontier:
                out.setdefault((origin, n), d)
            frontier = {b for a, b in edges if a in frontier} - {n for o, n in out if o == origin}
            d += 1
    return out


def least(a, b):
    for k, v in b.items():
        a[k] = min(a.get(k, v), v)
    return a


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("b", "a"), ("b", "c")], [("a", "a")], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], [(f"n{i}", f"n{i + 1}") for i in range(25)],
    [(f"n{random.Random(i).randrange(18)}", f"n{random.Random(i + 99).randrange(18)}") for i in range(40)],
])
def test_reach(spark, edges):
    df = spark.createDataFrame([*edges, edges[0], (None, "x"), ("x", None)], "src string, dst string")
    start = df.select(F.col("src").alias("origin"), F.col("dst").alias("node"))
    counts = []
    got = {(r["origin"], r["node"]): r["steps"] for r in O.reach(df, start, counts).collect()}
    want = {}
    for e in set(edges):
        least(want, steps_of(edges, [e]))
    assert got == want and sum(counts) == len(want)  # no pair is expanded twice
    closed = G.closure(df.select(F.col("src").alias("child"), F.col("dst").alias("parent")))
    assert sorted(map(tuple, closed.collect())) == sorted(want)


def test_nearest_marks(spark):
    edges = [("x", "A"), ("x", "B"), ("y", "x"), ("z", "y"), ("z", "C"), ("C", "A"), ("u", "B"), ("u", "v"), ("v", "u"), ("A", "top"), ("w", "free")]
    df = spark.createDataFrame(edges, "child string, parent string")
    marks = spark.createDataFrame([("A",), ("B",), ("C",), ("top",), ("gone",), (None,)], "mark string")
    got = {r["node"]: (r["mark"], r["steps"]) for r in O.nearest_marked(df, marks).collect()}
    assert got == {"x": ("A", 1), "y": ("A", 2), "z": ("C", 1), "C": ("A", 1), "u": ("B", 1), "v": ("B", 2), "A": ("top", 1)}


def test_indicators_by_type(spark):
    t = [("Obj", "subClassOf", "Ind"), ("Sub", "subClassOf", "Ind"), ("i1", "subClassOf", "Obj"), ("i2", "subClassOf", "Sub"), ("i3", "subClassOf", "i1"), ("i3", "subClassOf", "i2"), ("i4", "subClassOf", "Ind"), ("other", "subClassOf", "Thing"),
         ("i1", "measures", "dim2"), ("i1", "measures", "dim1"), ("i3", "measures", "dim1"), ("i1", "label", "one"), ("i3", "label", "three"), ("i4", "label", "four")]
    df = spark.createDataFrame([(*x, "fr") for x in t], "s string, p string, o string, lang string")
    found = O.indicators(df, indicator="Ind", objective="Obj", subjective="Sub", measures="measures")
    assert {r["uri"]: (r["label"], r["type"], r["dimension"]) for r in found.collect()} == {
        "Obj": (None, "unknown", None), "Sub": (None, "unknown", None), "i1": ("one", "objective", "dim1"), "i2": (None, "subjective", None), "i3": ("three", "objective", "dim1"), "i4": ("four", "unknown", None),
    }
    assert sorted(map(tuple, O.related_labels(found).collect())) == [("dim1", "one"), ("dim1", "three")]
    assert O.indicators(df.where("false")).count() == 0


def walked_by_hand(seeds, edges, hops, restart, frontier, fan):
    ways = {}
    for a in {a for a, _, _ in edges}:
        sums = {}
        for x, b, w in edges:
            if x == a and b is not None and w is not None and w > 0:
                sums[b] = sums.get(b, 0) + w
        kept = sorted(((b, round(w, 12)) for b, w in sums.items()), key=lambda t: (-t[1], t[0]))[:fan]
        ways[a] = {b: w / sum(w for _, w in kept) for b, w in kept}
    out = {}
    for q in {q for q, _, _ in seeds}:
        mine = {}
        for x, n, w in seeds:
            if x == q and w is not None and w > 0:
                mine[n] = mine.get(n, 0) + w
        home = {n: round(w / sum(mine.values()), 12) for n, w in mine.items()}
        at = home
        for _ in range(hops):
            new = {n: restart * w for n, w in home.items()}
            for n, w in at.items():
                for b, s in ways.get(n, {}).items():
                    new[b] = new.get(b, 0) + (1 - restart) * w * s
            at = dict(sorted(((n, round(w, 12)) for n, w in new.items()), key=lambda t: (-t[1], t[0]))[:frontier])
        out |= {(q, n): w for n, w in at.items()}
    return out


@pytest.mark.parametrize("seed,hops,frontier,fan", [(1, 1, 50, 20), (2, 2, 50, 20), (3, 3, 4, 2), (4, 5, 6, 3)])
def test_walks_by_hand(spark, seed, hops, frontier, fan):
    from kadastra.operators import walks as K

    r = random.Random(seed)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}", r.choice([1.0, 2.0, 0.37, 0.0, None])) for _ in range(120)] + [("hub", f"n{i % 25}", 1.0 + i % 7 / 10) for i in range(200)] + [("n1", "hub", 9.0), (None, "n1", 1.0), ("n2", None, 1.0)]
    seeds = [(q, f"n{r.randrange(25)}", r.choice([1.0, 0.31, 0.0, None])) for q in range(12) for _ in range(3)] + [(99, "not there", 1.0), (98, "hub", 2.0)]
    got = {(x["query_id"], x["node"]): x["weight"] for x in K.walk(spark.createDataFrame(seeds, "query_id int, node string, weight double"), spark.createDataFrame(edges, "src string, dst string, weight double"), hops=hops, restart=0.2, frontier=frontier, fan=fan).collect()}
    want = walked_by_hand(seeds, [e for e in edges if e[0] is not None], hops, 0.2, frontier, fan)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 30


def test_expanded_questions_find_more_nodes(spark):
    from kadastra.operators import walks as K

    nodes = spark.createDataFrame([("a", "health care", "doctors nearby"), ("b", "road", None), ("c", "school", "lessons"), ("d", None, None)], "uri string, label string, comment string")
    edges = spark.createDataFrame([("a", "near", "b"), ("a", "near", "b"), ("c", "near", "a"), ("a", "is", "b")], "src string, rel string, dst string")
    questions = spark.createDataFrame([(1, "Which doctors?"), (2, "how about learning"), (3, None), (4, "nothing of it")], "query_id int, text string")
    more = K.expanded(questions, spark.createDataFrame([("learning", "school"), ("learning", "lessons"), ("nothing", None)], "term string, more string"))
    assert {r["query_id"]: r["text"] for r in more.collect()}[2] == "how about learning lessons school"
    found = lambda df: {(r["query_id"], r["uri"]): (r["n_relations"], round(r["score"], 9)) for r in K.search_nodes(df, nodes, edges, 2).collect()}
    assert found(questions) == {(1, "a"): (3, 1.0)} and found(more) == {(1, "a"): (3, 1.0), (2, "c"): (1, 1.0)}
