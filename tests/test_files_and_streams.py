"""Readers on files of their own, and the refreshed view under repeated batches."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadastra.operators import geography as Y
from kadastra.operators import joins as J
from kadastra.operators import text as X
from kadastra.sources import files
from kadastra.streaming.refresh import ViewRefresher


def test_features_and_adjacency(spark, tmp_path):
    square = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]
    features = [{"properties": {"nom": n}, "geometry": {"type": "Polygon", "coordinates": square(x, y)}} for n, x, y in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 9, 9))]
    (tmp_path / "g.geojson").write_text(json.dumps({"features": features}, indent=1))
    areas = files.read_features(spark, str(tmp_path), ["nom"]).withColumnRenamed("nom", "area")
    assert sorted(map(tuple, Y.adjacent(areas).collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    points = spark.createDataFrame([("p", 0.5, 0.5), ("q", 1.2, 0.7), ("r", 5.0, 5.0), ("s", 9.9, 9.1)], "name string, x double, y double")
    assert {r["name"]: r["area"] for r in Y.point_in_area(points, areas).collect()} == {"p": "a", "q": "b", "r": None, "s": "d"}


def test_hole_counts_as_outside(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    area = spark.createDataFrame([("z", [[{"x": float(x), "y": float(y)} for x, y in ring(0, 10)], [{"x": float(x), "y": float(y)} for x, y in ring(4, 6)]])], "area string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([("in", 1.0, 1.0), ("hole", 5.0, 5.0)], "name string, x double, y double")
    assert {r["name"]: r["area"] for r in Y.point_in_area(points, area).collect()} == {"in": "z", "hole": None}


def test_results_and_interviews(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"k10": [{"row": 1, "note": 4.5}, {"row": 2}], "k25": []}, indent=2))
    entry = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("note", T.DoubleType())])
    assert sorted(tuple(r) for r in files.read_results(spark, str(tmp_path), entry).collect()) == [("k10", 1, 4.5), ("k10", 2, None)]
    text = "intro\n### Commune : Porto Vecchio | Entretien 2\nQ: Pourquoi ?\nencore ?\nR: Parce que.\n### Commune : Corte | Entretien 1\nQ: Et ?\n"
    turns = files.interview_turns(files.interviews(spark.createDataFrame([(text,)], "text string")))
    assert [tuple(r) for r in turns.orderBy("commune", "turn").collect()] == [("Corte", 1, 0, "Q", "Et ?"), ("Porto Vecchio", 2, 0, "Q", "Pourquoi ?\nencore ?"), ("Porto Vecchio", 2, 1, "R", "Parce que.")]


def test_triples(spark):
    lines = ['<http://ex.org/a> <http://ex.org/p> <http://other.org/b> .', '<http://ex.org/a> <http://ex.org/label> "un \\"mot\\""@fr .', "# comment", '_:x <http://ex.org/p> "3"^^<http://ex.org/int> .']
    prefixes = spark.createDataFrame([("http://ex.org/", "ex")], "namespace string, prefix string")
    got = sorted((tuple(r) for r in files.triples(spark.createDataFrame([(x,) for x in lines], "value string"), prefixes).collect()), key=str)
    assert got == sorted([("ex:a", "ex:p", "http://other.org/b", None), ("ex:a", "ex:label", 'un \\"mot\\"', "fr"), ("_:x", "ex:p", "3", None)], key=str)


def test_matches(spark):
    rows = spark.createDataFrame([(1, "De Porto-Vecchio à Corte"), (2, "portovecchio"), (3, None)], "id int, t string")
    names = spark.createDataFrame([("porto vecchio",), ("porto",), ("corte",)], "name string")
    text = F.regexp_replace(F.lower("t"), "-", " ")
    assert {r["id"]: r["name"] for r in J.dictionary_matches(rows, names, "id", text).collect()} == {1: "porto vecchio"}
    assert sorted(r["name"] for r in J.dictionary_matches(rows, names, "id", text, longest=False).collect()) == ["corte", "porto", "porto vecchio"]
    a, b = spark.createDataFrame([("sartenne",), ("bastja",), ("cort",)], "w string"), spark.createDataFrame([("sartene",), ("bastia",), ("corte",)], "n string")
    assert sorted(map(tuple, X.within_one_edit(a, b, "w", "n").collect())) == [("bastja", "bastia"), ("sartenne", "sartene")]


def test_refresh_is_idempotent(spark, tmp_path):
    run = ViewRefresher(spark, str(tmp_path / "s"), ["k"])
    one = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "k string, score int")
    two = spark.createDataFrame([("b", 1), ("c", 4)], "k string, score int")
    for batch, n in ((one, 0), (one, 0), (two, 1), (two, 1)):
        run.apply(batch, n)
    assert sorted(tuple(r) for r in run.view(1).collect()) == [("a", 2, 2.0), ("b", 2, 3.0), ("c", 1, 4.0)]
    assert sorted(tuple(r) for r in run.view(0).collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]
    assert ViewRefresher(spark, str(tmp_path / "t"), ["k"]).view(3) is None


def test_one_file_for_each_text_in_one_folder(spark, tmp_path):
    rows = [("entretien_Saint-Florent_x_1", "one\ntwo"), ("entretien_a/b#c é+%41_2", "été"), (None, "lost"), ("entretien_none_3", None), ("blank", " ")]
    files.write_files(spark.createDataFrame(rows, "name string, text string"), f"file://{tmp_path}/in")
    assert len(list((tmp_path / "in").glob("*.txt"))) == 3 and not [p for p in (tmp_path / "in").iterdir() if p.is_dir()]
    back = files.interview_names(files.read_folder(spark, f"file://{tmp_path}/in", "s").withColumn("name", F.url_decode("name")))
    assert sorted((r["commune"], r["num"], r["text"]) for r in back.collect()) == [("Saint-Florent_x", 1, "one\ntwo"), ("a/b#c é+%41", 2, "été")]
