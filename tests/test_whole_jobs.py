"""Operators that must do the whole job: no query, pair or quote is left out."""

from collections import Counter

import duckdb
from compare import same
from pyspark.sql import functions as F

from kadastra.operators import graph as G
from kadastra.operators import retrieval as R
from kadastra.plans import ORACLE_SQL, QUERIES


def test_approximate_search_finds_nine_of_ten(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    close = q.select((F.col("query_id") * 10 + F.lit(1_000_000)).alias("doc_id"), "embedding")
    close = close.unionByName(close.withColumn("doc_id", F.col("doc_id") + 1)).unionByName(close.withColumn("doc_id", F.col("doc_id") + 2)).where("doc_id % 20 < 10")
    for docs in (e, e.unionByName(close)):
        want = {(r["query_id"], r["doc_id"]) for r in R.dense_top_k(q, docs, 3).collect()}
        got = {(r["query_id"], r["doc_id"]) for r in R.approximate_top_k(q, docs, 3).collect()}
        assert len(got) == len(want) == 3 * q.count() and len(got & want) >= 0.9 * len(want)


def test_approximate_query_gives_k_rows_each(spark, data):
    assert {r["count"] for r in QUERIES["ret2_approximate_top_k"](spark, data).groupBy("query_id").count().collect()} == {5}


def test_as_many_negative_pairs_as_edges(spark):
    star = [(f"s{i}", "star", "hub") for i in range(5)]  # no other pair is left
    tight = [(f"s{i}", "tight", f"t{j}") for i in range(6) for j in range(6) if i != j]  # six are left
    half = [(f"s{i}", "half", f"t{j}") for i in range(8) for j in range(8) if (i + j) % 3]
    hubs = [(f"s{i}", "hubs", "t0") for i in range(60)] + [("s0", "hubs", f"t{j}") for j in range(1, 60)]
    edges = [*star, *tight, *half, *hubs, ("a", "one", "b"), ("s0", "star", "hub"), (None, "star", "hub")]
    got = [(r["src"], r["rel"], r["dst"]) for r in G.negative_pairs(spark.createDataFrame(edges, "src string, rel string, dst string")).collect()]
    assert len(set(got)) == len(got) and not set(got) & set(edges)
    assert Counter(r for _, r, _ in got) == {"tight": 6, "half": 64 - len(half), "hubs": len(hubs)}
    assert all((s, r) in {x[:2] for x in edges} and (r, t) in {x[1:] for x in edges} for s, r, t in got)


def test_negative_pairs_query(spark, data):
    from kadastra.plans.graph_queries import edges

    e = edges(spark, data).distinct()
    ends = {r["rel"]: min(r["n"], r["s"] * r["t"] - r["n"]) for r in e.groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("s"), F.count_distinct("dst").alias("t")).collect()}
    got = {r["rel"]: r["count"] for r in QUERIES["gra13_negative_pairs"](spark, data).groupBy("rel").count().collect()}
    assert got == {k: n for k, n in ends.items() if n}


def test_approximate_query_asks_every_fiftieth(spark, data):
    asked = {r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert {r["query_id"] for r in QUERIES["ret2_approximate_top_k"](spark, data).select("query_id").distinct().collect()} == asked


def test_no_growing_side_of_the_token_metrics_is_broadcast(spark, data):
    from kadastra.plans.truth_queries import metrics

    plan = metrics(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2  # twenty rows of each nation, used twice
    assert plan.count("strategy=merge") >= 7


def test_texts_are_split_in_small_batches(spark, data):
    from kadastra.plans import QUERIES

    plan = QUERIES["win14_recursive_split"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_windows_of_null_empty_and_odd_texts(spark, tmp_path):
    texts = [None, "", " ", "a", "\r\n" * 300, "a\x00b" * 300, "\U0010ffff" * 650, "\U0001f9d1\u200d\U0001f680" * 300, *("é" * n for n in (100, 101, 499, 500, 501, 502, 900, 901))]
    spark.createDataFrame([(i, t, "src0", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["win14_windows"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        same(got, c, ORACLE_SQL["win14_windows"])
    assert [r["h"] for r in got.where("doc_id < 2").orderBy("doc_id").collect()] == [None, "d41d8cd98f00b204e9800998ecf8427e"]
