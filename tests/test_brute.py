"""Queries that SQL can't state against plain Python, and operators on rows of edge cases."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kadastra.functions import scales as N
from kadastra.operators import chunking as K
from kadastra.operators.joins import all_or_text
from kadastra.operators.ranking import competition_ranks
from kadastra.operators.retrieval import group_search
from kadastra.plans import QUERIES, graph_queries
from kadastra.plans.text_queries import interviews, typed


def chunks_of(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], {})[r["chunk_index"]] = r["chunk"]
    assert all(sorted(c) == list(range(len(c))) for c in out.values())
    return {k: [c[i] for i in range(len(c))] for k, c in out.items()}


def packed(pieces, size, budget, sep, ends=0):
    out, total = [], 0
    for p in pieces:
        if p.strip(" ") == "":
            continue
        n = size(p)
        if out and total + n <= budget:
            out[-1].append(p)
            total += n + ends
        else:
            out.append([p])
            total = n + ends
    return [sep.join(c) for c in out]


def test_packed_sentences(spark, data):
    got = chunks_of(QUERIES["win12_packed_sentences"](spark, data).collect(), "doc_id")
    for r in typed(spark, data).collect():
        pieces = re.sub(r"(?<=[.!?])[ \t\n\x0b\f\r]+", "\1", r["text"] or "").split("\1")
        budget = K.BUDGETS.get(r["source_type"], 100)
        assert got.get(r["doc_id"], []) == packed(pieces, lambda s: len(re.split(r"[ \t\n\x0b\f\r]+", s.strip(" "))), budget, " ")


def test_packed_lines(spark, data):
    got = chunks_of(QUERIES["win13_packed_lines"](spark, data).collect(), "doc_id")
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        want, held, lines = [], 0, []
        for line in (r["text"] or "").split("\n"):
            lines.append(line)
            held += len(line)
            if held >= 1000:
                want.append("\n".join(lines))
                held, lines = 0, []
        assert got[r["doc_id"]] == want + ["\n".join(lines)] * bool(lines)


def test_packed_questions_and_pairs(spark, data):
    texts = {r["conv_id"]: r["text"] for r in interviews(spark, data).collect()}
    got = chunks_of(QUERIES["win13_packed_questions"](spark, data).collect(), "conv_id")
    for k, t in texts.items():
        assert got[k] == [c.strip(" ") for c in packed([b.strip(" ") for b in re.split(r"\n(?=Q\s*:)", t)], len, 600, "\n\n", 2)]
    pairs = chunks_of(QUERIES["win14_question_pairs"](spark, data).collect(), "conv_id")
    for k, t in texts.items():
        blocks = [b for b in re.split(r"(?=Q :)", t) if b.startswith("Q :") and "R :" in b]
        if blocks:
            assert len(pairs[k]) == len(blocks)
            for p, b in zip(pairs[k], blocks):
                q, r = b[3:].split("R :", 1)
                assert p == q.strip() + "\n" + ("R :" + r).strip()


def test_recursive_split(spark, data):
    got = chunks_of(QUERIES["win14_recursive_split"](spark, data).collect(), "doc_id")
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        text, chunks = (r["text"] or "").strip(), got.get(r["doc_id"], [])
        if re.search(r"Q\s*[:：]", text):
            continue
        at, reach = 0, 0
        for c in chunks:
            assert 0 < len(c) <= 500
            at = text.index(c, max(0, reach - 100))
            # between chunks only blanks are left out, and what is repeated is at most the overlap
            assert text[reach:at].strip() == ""
            # cut before a separator, but where a word is longer than a chunk
            assert at == 0 or text[at - 1].isspace() or text[at] in ".,\n " or not re.search(r"\s|, |\. ", text[max(0, at - 400) : at])
            reach = max(reach, at + len(c))
        assert text[reach:].strip() == ""
    assert K.split_text(None) == K.split_text("  \n ") == [] and K.split_text("x" * 1201) == ["x" * 500, "x" * 500, "x" * 201]
    assert K.split_text("a" * 300 + "\n\n" + "b" * 300) == ["a" * 300, "b" * 300]
    assert all(len(c) <= 6 for c in K.split_text("aa. bb. cc", 6, 4))


def test_approximate_search_recalls(spark, data):
    got = {}
    for r in QUERIES["ret2_approximate_top_k"](spark, data.replace("0.001", "0.01")).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    rows = spark.read.parquet(data.replace("0.001", "0.01") + "/embeddings.parquet").where("embedding is not null").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    asked = [i for i in ids if i % 50 == 0]
    hits = sum(len(got[q] & set(ids[np.lexsort((ids, -(v @ v[ids == q][0])))[:5]].tolist())) for q in asked)
    assert set(got) == set(asked) and hits >= 0.9 * 5 * len(asked)


def test_negative_pairs(spark, data):
    got = [(r["src"], r["rel"], r["dst"]) for r in QUERIES["gra13_negative_pairs"](spark, data).collect()]
    edges = {(r["src"], r["rel"], r["dst"]) for r in graph_queries.edges(spark, data).collect()}
    assert len(got) == len(set(got)) and not edges & set(got)
    drawn = Counter(rel for _, rel, _ in got)
    for rel, n in Counter(rel for _, rel, _ in edges).items():
        src, dst = ({e[i] for e in edges if e[1] == rel} for i in (0, 2))
        assert drawn[rel] == min(n, len(src) * len(dst) - n)
        assert all(a in src and b in dst for a, r, b in got if r == rel)


def test_agreement_p_values(spark, data):
    """Against the density of Student's t, summed numerically."""
    rows = QUERIES["eva10_p_values"](spark, data).collect()
    assert len(rows) > 5
    for r in rows:
        k, c = r["n"] - 2, r["pearson"]
        t = abs(c) * math.sqrt(k / (1 - c * c))
        x = np.linspace(0, t, 20_001)
        density = np.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi) * (1 + x * x / k) ** (-(k + 1) / 2)
        assert abs(r["p"] - (1 - 2 * np.trapezoid(density, x))) < 1e-6


def test_ranks_without_one_task(spark):
    rng = np.random.default_rng(1)
    values = [None if x > 4.5 else round(float(x), 2) for x in rng.normal(size=3000) * 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(7)
    known = sorted((v for v in values if v is not None), reverse=True)
    for r in competition_ranks(df, ["v"]).collect():
        assert r["rank_v"] == (len(known) + 1 if r["v"] is None else 1 + sum(x > r["v"] for x in known))
    assert competition_ranks(df.where("false"), ["v"]).count() == 0
    assert Counter(r["rank_v"] for r in competition_ranks(spark.range(3).select(F.lit(1.0).alias("v")), ["v"]).collect()) == {1: 3}


def test_fact_lookup(spark):
    """The equal question, else the first by order that holds or is held by the other; empty, null, short, repeated and long ones."""
    known = ["", "what is the mean score of Ajaccio", "score", "WHAT is", "mean score of", None, "score", "the long question about schools and roads", "a"]
    for names in (known, known[1:], []):
        asked = ["score", " score ", "Mean Score of Ajaccio?", "what", "", None, "schools and roads", "nothing", "b", "zz " * 3000 + "score", "score"]
        k = spark.createDataFrame([(n, f"v{i}" if i % 4 else None, i) for i, n in enumerate(names)], "question string, fact string, place int")
        rows = spark.createDataFrame([(i, q, "own") for i, q in enumerate(asked)], "id int, question string, _x string")

        def first(q):
            if q is None:
                return None
            q, rows = q.strip(" "), [(n, f"v{i}" if i % 4 else None) for i, n in enumerate(names) if n is not None]
            equal = [v for n, v in rows if n == q]
            near = [v for n, v in rows if q.lower() in n.lower() or n.lower() in q.lower()]
            return (equal or near or [None])[0]

        got = all_or_text(rows, k, "question", "fact", "place").collect()
        assert {r["id"]: r["fact"] for r in got} == {i: first(q) for i, q in enumerate(asked)} and len(got) == len(asked)


def test_indicator_documents(spark):
    """Fixed documents by question class; the whole only without towns, the method always."""
    rows = [("Quel classement des dimensions ?", 0), ("le score moyen", 0), ("le score moyen", 1), ("Quelle commune est la première", 2), ("", 0)]
    got = [r["f"] for r in spark.createDataFrame(rows, "q string, n int").select(N.indicator_documents(F.col("q"), F.col("n")).alias("f")).collect()]
    c, w, r, m = (N.FIXED_DOCUMENTS[x] for x in ("components", "whole", "ranking", "method"))
    assert got == [[c, r, m], [w, m], [m], [r, m], [m]]


def test_group_search_edges(spark):
    """A group without members or parent, a question that isn't about quality, a cut at `most`, and the towns left out."""
    questions = spark.createDataFrame([(1, "G", True, None), (2, "G", False, None), (3, "none", True, None), (4, "G", True, "old")], "query_id int, epci string, asks_quality boolean, age_range string")
    members = spark.createDataFrame([("G", f"t{i}") for i in (3, 1, 2, 4, 1)], "epci string, commune string")
    parents = spark.createDataFrame([("G", "doc of G")], "epci string, doc string")
    views = spark.createDataFrame([("by_town", f"t{i}", None, f"d{i}") for i in (2, 3, 4)] + [("by_age", "old", None, "old"), ("both", "old", "t3", "old3")], "view_name string, dim1_value string, dim2_value string, doc string")
    order = {"both": ("age_range", "commune"), "by_town": ("commune",), "by_age": ("age_range",)}
    found = spark.createDataFrame([(1, 1, "fixed", "m", 0.0)] + [(1, 2 + i, "town", f"x{i}", 1.0 - i / 10) for i in range(5)], "query_id int, rank int, part string, doc string, distance double")
    got = {}
    for r in group_search(questions, members, parents, [("summary", views, order)], found, most=2).collect():
        got.setdefault((r["query_id"], r["part"]), []).append((r["place"], r["town"], r["doc"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        (1, "parent"): [(0, None, "doc of G")], (2, "parent"): [(0, None, "doc of G")], (4, "parent"): [(0, None, "doc of G")],
        (1, "summary"): [(1, "t2", "d2"), (2, "t3", "d3")], (1, "note"): [(0, None, "2/4")], (1, "without"): [(1, "t1", None), (2, "t4", None)],
        (4, "summary"): [(1, "t1", "old"), (2, "t2", "d2")], (4, "note"): [(0, None, "2/4")], (4, "without"): [(1, "t3", None), (2, "t4", None)],
        (1, "indicator"): [(1, None, "m"), (4, None, "x2"), (5, None, "x3"), (6, None, "x4")],
    }
