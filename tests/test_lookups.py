"""Questions that share long phrases, view search, enrichment and neighbours, on rows of edge cases."""

import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kadastra.operators import joins as J
from kadastra.operators import retrieval as R
from kadastra.operators import text as X
from kadastra.operators import walks as K


def test_template_questions_meet_by_what_differs(spark):
    ask = "quelle est la note moyenne de la commune de "
    known = spark.range(1500).select(F.concat(F.lit(ask), F.format_string("%04d", "id"), F.lit(" en 2020 ?")).alias("text"), F.col("id").alias("w"))
    parts = spark.range(1000).select(F.concat(F.lit(ask), F.format_string("%04d", F.col("id") * 2)).alias("text"), F.col("id").alias("p"))
    pairs = J.text_candidates(parts, known)
    assert pairs.count() < 4 * 750
    texts = pairs.join(parts, "p").join(known.withColumnRenamed("text", "whole"), "w").where(F.contains("whole", F.col("text")))
    assert texts.count() == 750


def test_candidates_hold_every_part_in_its_whole(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé😀 ") for _ in range(n))
    wholes = [text(rng.randrange(0, 40)) for _ in range(150)] + ["x" * 20_000, "", None]
    parts = [text(rng.randrange(0, 5)) for _ in range(60)] + [w[3:15] for w in wholes if w] + ["x" * 9_000, "", None, "unseen words"]
    df = lambda rows, k: spark.createDataFrame(list(enumerate(rows)), f"{k} long, text string")
    got = {(r.p, r.w) for r in J.text_candidates(df(parts, "p"), df(wholes, "w")).collect()}
    want = {(i, j) for i, p in enumerate(parts) for j, w in enumerate(wholes) if p and w and p in w}
    assert want <= got
    assert J.text_candidates(df([""], "p"), df(wholes, "w")).collect() == []
    assert J.text_candidates(df(parts, "p"), df(["q"], "w").limit(0)).collect() == []


def test_questions_and_known_ones_are_never_broadcast(spark):
    known = spark.range(50).select(F.concat(F.lit("ask "), F.col("id").cast("string")).alias("question"), F.col("id").alias("v"))
    rows = spark.range(80).select("id", F.concat(F.lit("Please ASK "), F.col("id").cast("string")).alias("question"))
    found = J.all_or_text(rows, known, "question", "v", "v")
    assert {r.id: r.v for r in found.collect()} == {i: int(str(i)[0]) for i in range(80)}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()  # the sides' sizes are unknown, files don't tell them


def test_views_that_fit_the_question(spark):
    rng = np.random.default_rng(2)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    views = [(f"{a}|{b}", a, b, vec()) for a in ("young", "old", "baker", None) for b in (None, "baker", "smith") if a or not b] + [("none", "young", None, None)]
    asks = [(i, a, j, vec()) for i, (a, j) in enumerate([("young", None), ("old", "baker"), (None, "baker"), (None, None), ("lost", None), ("old", "lost")])] + [(9, "old", None, None)]
    v = spark.createDataFrame(views, "doc string, dim1_value string, dim2_value string, embedding array<double>")
    q = spark.createDataFrame(asks, "query_id long, age_range string, profession string, embedding array<double>")
    got = {(r.query_id, r.rank): r.doc for r in R.view_search(q, v, 2).collect()}
    want = {}
    for i, age, job, x in asks:
        if x is None:
            continue
        fits = [w for w in views if w[3] and (w[1] == age and (job is None or w[2] == job) if age else w[1] == job if job else True)]
        cos = lambda y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)  # noqa: B023, E731
        for rank, w in enumerate(sorted(fits, key=lambda w: (1 - cos(w[3]), w[0]))[:2], 1):
            want[i, rank] = w[0]
    assert got == want and {i for i, _ in want} == {0, 1, 2, 3}


def test_enrichment_by_parts_and_ontology(spark):
    q = spark.createDataFrame([(1, "Quelle est la SANTÉ selon CHX2 ?", "a"), (2, None, "b"), (3, "rien", "c"), (4, "opp et emploi", "d")], "id long, text string, label string")
    labels = spark.createDataFrame([("d:health", "Soins"), ("d:work", None), ("d:other", "Autre")], "dimension string, label string")
    related = spark.createDataFrame([("d:health", f"z{i}") for i in range(9)] + [("d:health", "z1"), ("d:work", "Poste"), ("d:work", None)], "dimension string, label string")
    keywords = [("santé", "d:health"), ("emploi", "d:work"), ("sante", "d:health"), ("unused", "d:none")]
    run = lambda **more: {r.id: r for r in X.enrich_by_ontology(q, "text", keywords, labels, related, **more).collect()}
    got = run()
    assert got[1].dimensions == ["d:health"] and got[1].indicators == ["Choix"]
    assert got[1].terms == ["Choix emploi", "Soins", "emploi", "travail", "z0"] and got[1].enriched == "Quelle est la SANTÉ selon CHX2 ? Choix emploi Soins emploi travail z0"
    assert got[2].terms == [] and got[2].enriched is None and got[2].label == "b"
    assert got[3].enriched == "rien" and got[3].indicators == []
    assert got[4].indicators == ["Opportunités"] and got[4].dimensions == ["d:work"]
    assert "Poste" in run(most=50)[4].terms and run(most=50)[4].terms == sorted(run(most=50)[4].terms)
    none = X.enrich_by_ontology(q, "text", [], labels.limit(0), related.limit(0), parts=()).collect()
    assert {r.enriched for r in none} == {r.text for r in none}


def test_nodes_with_and_without_neighbours(spark):
    nodes = spark.createDataFrame([("a", "Concept", [1.0, 0.0]), ("b", "Town", [1.0, 0.0]), ("c", "Concept", [0.9, 0.1]), ("c", "Concept", [0.9, 0.1]), ("d", "Concept", None)], "uri string, type string, embedding array<double>").distinct()
    edges = spark.createDataFrame([("a", "r", f"n{i}") for i in range(5)] + [("m", "q", "a")], "src string, rel string, dst string")
    names = spark.createDataFrame([("n0", "Zero"), ("m", "Em")], "uri string, label string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    got = K.similar_nodes(q, nodes, edges, 5, types=["Concept"], names=names).orderBy("rank").collect()
    assert [(r.uri, r.rank) for r in got] == [("a", 1), ("c", 2)]
    assert [(x.rel, x.other, x.direction, x.label) for x in got[0].neighbours] == [("q", "m", "in", "Em"), ("r", "n0", "out", "Zero"), ("r", "n1", "out", None)]
    assert got[1].neighbours == []
    assert K.similar_nodes(q.limit(0), nodes, edges, 5, types=["Concept"]).collect() == []


def test_dense_search_over_many_blocks_of_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3 * R.ROWS + 7, 4)).round(1)
    rows = [(i, v.tolist(), i % 700) for i, v in enumerate(x)] + [(9_000 + i, [float("nan")] * 4, 699) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>, part long").coalesce(1)
    asked = spark.createDataFrame([(i, x[i].tolist(), None if i % 2 else i) for i in range(20)] + [(99, x[5].tolist(), 699)], "query_id long, embedding array<double>, part long")
    got = [tuple(r) for r in R.dense_top_k(asked, docs, 3, same="part").orderBy("query_id", "rank").select("query_id", "doc_id").collect()]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for i, part in [(i, None if i % 2 else i) for i in range(20)] + [(99, 699)]:
        dist = 1 - u @ u[5 if i == 99 else i]
        able = [j for j in range(len(x)) if part is None or j % 700 == part]
        want += [(i, j) for j in sorted(able, key=lambda j: (round(dist[j], 12), j))[:3]]
    assert got == want
    few = spark.createDataFrame([*rows[:2], *((j, [float("nan")] * 4, 0) for j in range(10, 100))], docs.schema).coalesce(1)
    assert {r.doc_id for r in R.dense_top_k(asked.where("query_id = 1"), few, 3).collect()} == {0, 1}  # before, a block without k finite distances gave none
    assert R.ROWS * R.BLOCK * 8 <= 32 << 20


def test_equal_vectors_go_by_id_wherever_they_lie(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=64)
    ids = [*range(R.ROWS, 0, -1), 0]  # the least id is alone in the last product, whose rounding differs
    docs = spark.createDataFrame([(i, v.tolist()) for i in ids], "doc_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 64)))], "query_id long, embedding array<double>")
    got = [tuple(r) for r in R.dense_top_k(asked, docs, 3).orderBy("query_id", "rank").select("query_id", "doc_id").collect()]
    assert got == [(i, j) for i in range(300) for j in range(3)]
    got = [tuple(r) for r in R.dense_top_k(asked.limit(1), docs.where("doc_id < 7"), 9).orderBy("rank").select("doc_id", "rank").collect()]
    assert got == [(j, j + 1) for j in range(7)]


def test_copies_of_a_question_are_at_distance_zero(spark):
    x = [v.astype(np.float32).tolist() for v in np.random.default_rng(6).normal(size=(40, 64))]
    docs = spark.createDataFrame([(100 * j + i, v) for j in range(3) for i, v in enumerate(x)] + [(900, [0.0] * 64)], "doc_id long, embedding array<float>")
    asked = docs.where("doc_id < 40").withColumnRenamed("doc_id", "query_id")
    got = R.normalised(R.dense_top_k(asked, docs, 3)).collect()
    assert len(got) == 120 and all(r.distance == 0 and r.score is None and r.doc_id % 100 == r.query_id for r in got)  # as SQL: before, scores by rounding
    far = R.dense_top_k(spark.createDataFrame([(1, [1e-120, 0.0]), (2, [1e120, 1e120]), (3, [0.0, 0.0])], "query_id long, embedding array<double>"), spark.createDataFrame([(5, [1e-120, 1e-120]), (6, [1e120, 0.0])], "doc_id long, embedding array<double>"), 2)
    half = 1 - 0.5**0.5
    assert [(r.query_id, r.doc_id, round(r.distance, 9)) for r in far.orderBy("query_id", "rank").collect()] == [(1, 6, 0), (1, 5, round(half, 9)), (2, 5, 0), (2, 6, round(half, 9)), (3, 5, 1), (3, 6, 1)]


def test_memory_of_dense_search_does_not_follow_the_tables():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(R.BLOCK, 16))
    frames = [pd.DataFrame({"doc_id": np.arange(2000) + 2000 * i, "embedding": list(rng.normal(size=(2000, 16)))}) for i in range(3)]
    copies = [f.assign(embedding=[frames[0].embedding[0]] * 2000) for f in frames[:1]]
    for some in (frames, copies):
        tracemalloc.start()
        got = pd.concat(R._nearest(list(range(R.BLOCK)), m, [], 5, "query_id", "doc_id", "embedding", None)(iter(some)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 5 * R.BLOCK and peak < 30 << 20, peak  # a matrix over the whole block alone is 32 MB
    assert set(got.doc_id) == set(range(5))


def test_dense_search_by_named_questions_over_empty_partitions(spark):
    docs = spark.createDataFrame([(i, [1.0, i / 10], f"T{i % 3}") for i in range(6)], "doc_id long, embedding array<double>, town string").repartition(3, "doc_id").where("doc_id < 5")
    asked = spark.createDataFrame([("a", [1.0, 0.0], "T1"), ("b", [1.0, 0.5], None), ("c", [1.0, 0.0], "T9"), ("d", [1.0, 0.0], "T2")], "ask string, embedding array<double>, town string")
    want = [("a", 1, 1), ("a", 4, 2), ("b", 4, 1), ("b", 3, 2), ("d", 2, 1)]
    for parts in (docs.coalesce(1), docs, docs.repartition(40, "doc_id")):
        got = [tuple(r) for r in R.dense_top_k(asked, parts, 2, q="ask", same="town").orderBy("ask", "rank").select("ask", "doc_id", "rank").collect()]
        assert got == want
