"""The lexical index against plain BM25, with bounds that leave documents out; sub-questions and evidence."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kadastra.operators import lexical as L
from kadastra.operators import retrieval as R


def bm25(docs, question):
    """(score by id) of documents that share a word with the question."""
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    lists = {i: cut(t) for i, t in docs}
    n, average = len(docs), sum(map(len, lists.values())) / len(docs)
    df = {}
    for ws in lists.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - v + 0.5) - math.log(v + 0.5) for w, v in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for i, ws in lists.items():
        for w in set(cut(question)) & set(ws):
            tf = ws.count(w)
            out[i] = out.get(i, 0) + (low if raw[w] < 0 else raw[w]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / average))
    return out


def corpus(seed, n=240):
    """Words by rank, some far rarer than others, in texts of all lengths; copies and texts without words too."""
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(r.choice([1, 3, 20, 60])))) for i in range(n)]
    docs += [(1000 + i, docs[i][1]) for i in range(12)] + [(2000, None), (2001, ""), (2002, "?! ."), (2003, "common " * 300)]
    questions = [(q, " ".join(word() for _ in range(r.choice([1, 2, 5, 14])))) for q in range(30)] + [(100, None), (101, ""), (102, "unknownword"), (103, "W1 w2 W1"), (104, docs[5][1])]
    return docs, questions


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 5), (3, 400)])
def test_best_documents(spark, seed, k):
    docs, questions = corpus(seed)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "x") for x in questions], "query_id long, text string, term string")
    index = L.LexicalIndex.build(d)
    got = {}
    for x in index.search(q, k).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["doc_id"], x["score"], x["n_scored"]))
    for i, text in questions:
        want = sorted(((-round(s, 5), j) for j, s in bm25(docs, text).items()))[:k]
        mine = sorted(got.get(i, []))
        assert [x[1] for x in mine] == [j for _, j in want] and [x[2] for x in mine] == pytest.approx([-s for s, _ in want], abs=2e-5)
    if k == 1:  # what can't be the best is left out
        assert sum(v[0][3] for v in got.values()) < 0.5 * sum(len(bm25(docs, t)) for i, t in questions if i in got)


def test_only_asked_terms_are_stored(spark):
    docs, questions = corpus(4, 60)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "query_id long, text string")
    asked = spark.createDataFrame([("w1",), ("w2",), ("nowhere",), (None,)], "term string")
    part, whole = L.LexicalIndex.build(d, terms=asked), L.LexicalIndex.build(d)
    one = q.where("query_id = 103")
    assert sorted(map(tuple, part.search(one, 9).collect())) == sorted(map(tuple, whole.search(one, 9).collect()))
    assert {r["term"] for r in part._table("terms").collect()} <= {"w1", "w2"} and part.search(q.where("query_id = 102"), 3).count() == 0
    pairs = spark.createDataFrame([(103, docs[j][0]) for j in range(20)], "query_id long, doc_id long")
    want = bm25(docs, "w1 w2")
    assert {r["doc_id"]: round(r["score"], 6) for r in whole.score(pairs, q).collect()} == pytest.approx({j: round(want[j], 6) for j in range(20) if j in want}, abs=2e-6)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert L.LexicalIndex.build(none).search(q, 3).count() == 0
    assert L.LexicalIndex.build(spark.createDataFrame([(1, "a"), (None, "a")], "doc_id long, text string")).search(q.where("false"), 3).count() == 0
    assert [tuple(r) for r in L.term_counts(spark.createDataFrame([(7, "b a B é"), (8, None), (9, "")], "doc_id long, text string")).orderBy("term").collect()] == [(7, 4, "a", 1), (7, 4, "b", 2), (7, 4, "é", 1)]


def test_sub_questions_are_pooled(spark):
    subs = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None), (3, 1, "z")], "query_id long, sub long, text string")
    hits = {"x": [10, 11, 12, 13], "y": [11, 14], "z": []}
    table = spark.createDataFrame([(t, d, r) for t, ds in hits.items() for r, d in enumerate(ds, 1)], "text string, doc_id long, rank int")
    scores = spark.createDataFrame([(1, 10, 1.0), (1, 11, 5.0), (1, 12, 4.0), (1, 13, 3.0)], "query_id long, doc_id long, score double")
    sources = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, "b"), (14, None)], "doc_id long, source string")
    found, best = R.sub_question_search(subs, lambda a: a.join(table, "text").select("ask", "doc_id", "rank"), lambda p: p.join(scores, ["query_id", "doc_id"]), sources, 4, per_source=2)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 10, 1), (1, 1, 11, 2), (1, 1, 12, 3), (1, 1, 13, 4), (1, 2, 11, 1), (1, 2, 14, 2)]
    assert [(r["doc_id"], r["score"], r["n_subs"], r["source"]) for r in best.orderBy("rank").collect()] == [(11, 5.0, 2, "b"), (12, 4.0, 1, "b"), (10, 1.0, 1, "a"), (14, 0.0, 1, "")]
    kinds = spark.createDataFrame([(1, 1, "raptor_view"), (1, 1, "other"), (1, 2, "oppchovec"), (1, 2, "verbatims"), (2, 1, None)], "query_id long, sub long, type string")
    assert sorted(map(tuple, R.evidence_balance(kinds, F.col("type")).collect())) == [(1, 1, True, False), (1, 2, True, True), (2, 1, False, False)]


def test_scores_of_stated_pairs_only(spark):
    docs, questions = corpus(5, 80)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "query_id long, text string")
    pairs = [(i, j) for i, _ in questions for j in (docs[i % 80][0], docs[(7 * i) % 80][0], 2000, 2003)] + [(999, 1), (1, 999_999)]
    want = {(i, j): s for i, t in questions for j, s in bm25(docs, t).items()}
    every = {(r["query_id"], r["doc_id"]): r["score"] for r in R.bm25(q, d).collect()}
    assert every == pytest.approx(want, abs=1e-6)
    some = R.bm25(q, d, pairs=spark.createDataFrame([*pairs, *pairs], "query_id long, doc_id long"))  # before, all pairs were made and then joined
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in some.collect()} == pytest.approx({p: want[p] for p in pairs if p in want}, abs=1e-6)
    assert R.bm25(q, d.where("false"), pairs=spark.createDataFrame(pairs, "query_id long, doc_id long")).count() == 0


@pytest.mark.parametrize("seed,k,held", [(1, 1, 4_000_000), (2, 5, 40), (3, 400, 300)])
def test_best_documents_without_an_index(spark, monkeypatch, seed, k, held):
    monkeypatch.setattr(L, "HELD", held)
    built = []
    monkeypatch.setattr(L.LexicalIndex, "build", classmethod(lambda cls, *a, **x: built.append(a)))  # before, every search stored and shuffled all postings
    docs, questions = corpus(seed)
    d, q = spark.createDataFrame([*docs, (None, "w1 w2")], "doc_id long, text string").repartition(3), spark.createDataFrame(questions, "query_id long, text string")
    got = {}
    for x in L.best_documents(q, d, k).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["doc_id"], x["score"]))
    for i, text in questions:
        want = sorted((-round(s, 5), j) for j, s in bm25([*docs, (None, "w1 w2")], text).items() if j is not None)[:k]
        mine = sorted(got.get(i, []))
        assert [x[1] for x in mine] == [j for _, j in want] and [x[2] for x in mine] == pytest.approx([-s for s, _ in want], abs=2e-5)
    assert not built and L.best_documents(q.where("query_id = 102"), d, k).count() == 0 == L.best_documents(q, d.where("false"), k).count()


def test_documents_of_one_id_are_added_up_by_the_index(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a c c"), (3, "b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert sorted(map(tuple, L.best_documents(q, d, 2).collect())) == sorted(map(tuple, L.LexicalIndex.build(d).search(q, 2).drop("n_scored").collect()))
