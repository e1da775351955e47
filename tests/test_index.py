"""The vector index alone: recall against dense search, rows counted, hot cells, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadastra.operators import index as I
from kadastra.operators.retrieval import approximate_top_k, dense_top_k


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "doc_id long, embedding array<double>")


def asked(docs, every=50):
    return docs.where(F.col("doc_id") % every == 0).withColumnRenamed("doc_id", "query_id")


def pairs(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


def recall(index, docs, k=5, every=50):
    rows = index.search(asked(docs, every), k).collect()
    want = pairs(dense_top_k(asked(docs, every), docs, k))
    assert len(rows) == len(want)
    n = docs.count()
    share = lambda c: sum(r[c] for r in rows) / len(rows) / n
    return len({(r["query_id"], r["doc_id"]) for r in rows} & want) / len(want), share("n_coded"), share("n_compared")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, data, sf):
    docs = spark.read.parquet(f"{data.replace('sf0.001', sf)}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    found, coded, compared = recall(I.VectorIndex.build(docs), docs)
    assert found >= 0.9 and compared < 0.15 and coded < 1


def test_clustered_vectors_need_few_cells(spark):
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(60, 24)), 50, axis=0) + 0.3 * r.normal(size=(3000, 24))
    docs = frame(spark, r.permutation(x))
    found, coded, compared = recall(I.VectorIndex.build(docs), docs)
    assert found >= 0.9 and coded < 1 / 3 and compared < 0.05


def test_loaded_index_answers_alike_and_skips_cells(spark, tmp_path):
    r = np.random.default_rng(2)
    docs = frame(spark, np.repeat(r.normal(size=(20, 10)), 40, axis=0) + 0.1 * r.normal(size=(800, 10)))
    built = I.VectorIndex.build(docs, path=f"{tmp_path}/index")
    loaded = I.VectorIndex.load(spark, f"{tmp_path}/index")
    one = asked(docs, 400)
    assert sorted(map(tuple, built.search(one, 4).collect())) == sorted(map(tuple, loaded.search(one, 4).collect()))
    assert loaded.rows().agg(F.count("*"), F.count_distinct("cell")).first()[0] == 800
    assert loaded.search(one, 4, probes=1).agg(F.max("n_coded")).first()[0] < 400


def test_a_cell_with_a_third_of_all_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS", 64)
    monkeypatch.setattr(I, "QUESTIONS", 16)
    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((400, 8)) + 0.01 * r.normal(size=(400, 8)), r.normal(size=(800, 8))])
    docs = frame(spark, x)
    index = I.VectorIndex.build(docs)
    q = asked(docs, 8)
    got = index.search(q, 3, probes=len(index.quantiser.cells), rerank=1200)
    assert pairs(got) == pairs(dense_top_k(q, docs, 3)) and got.agg(F.min("n_coded"), F.min("n_compared")).first() == (1200, 1200)
    found, _, _ = recall(index, docs, 5, 8)
    assert found >= 0.9


def test_rows_that_can_not_be_indexed(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [1.0, float("inf")]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 0.0]), (None, [0.0, 1.0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, embedding array<double>, cell string, code int")
    index = I.VectorIndex.build(docs)
    assert sorted((r["doc_id"] or 0) for r in index.rows().collect()) == [0, 1, 2, 2, 9]
    q = docs.select(F.col("doc_id").alias("query_id"), "embedding").where("query_id in (1, 3, 8, 9)")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in index.search(q, 9, probes=9, rerank=9).collect()}
    assert [got[1, k] for k in range(1, 6)] == [1, 2, 2, None, 9] and not {k for k in got if k[0] in (3, 8)}
    assert approximate_top_k(q, docs.where("false"), 3).count() == 0 and index.search(q.where("false"), 3).count() == 0


def test_training_does_not_depend_on_the_order_of_rows(spark):
    docs = frame(spark, np.random.default_rng(4).normal(size=(500, 12)))
    a, b = (I.VectorIndex.build(df) for df in (docs.repartition(3), docs.orderBy(F.col("doc_id").desc())))
    assert (a.quantiser.cells == b.quantiser.cells).all() and (a.quantiser.books == b.quantiser.books).all() and a.quantiser.probes == b.quantiser.probes
