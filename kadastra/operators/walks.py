"""Nodes of a graph for whole tables of questions: search by words, random walks with restart, a graph channel for fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadastra.functions.columns import words
from kadastra.operators.graph import both_ways, neighbours
from kadastra.operators.lexical import SENT, best_documents
from kadastra.operators.retrieval import dense_top_k
from kadastra.operators.storage import cut_lineage

#: Weights are compared after rounding to so many decimals, so that equal ones tie on every run.
DIGITS = 12


def expanded(questions: DataFrame, terms: DataFrame, *, q: str = "query_id", text: str = "text") -> DataFrame:
    """`questions` with the words that `terms` (term, more) lists for each of theirs put behind the text, in order."""
    asked = questions.select(q, F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    more = asked.join(terms.where("term is not null and more is not null").distinct(), "term").groupBy(q).agg(F.concat_ws(" ", F.array_sort(F.collect_set("more"))).alias("_more"))
    return questions.join(more, q, "left").withColumn(text, F.concat_ws(" ", text, "_more")).drop("_more")


def search_nodes(questions: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, *, q: str = "query_id", text: str = "text", key: str = "uri", fields: tuple[str, ...] = ("label", "comment")) -> DataFrame:
    """(q, key, rank, weight, n_relations, score): the k nodes whose fields share the best words with each question.

    The nodes' fields are scored where they lie, with words that some question has. weight is the BM25 score; a node's relations are the different
    (relation, other end) pairs, both ways, and the score is 1 - 0.1 for each place before it, 0.05 more for each relation, 0.2 at most, and no more than 1.
    """
    held = nodes.select(key, F.concat_ws(" ", *fields).alias("_text"))
    found = best_documents(questions.select(q, F.col(text).alias("_text")), held, k, q=q, d=key, text="_text")
    hits = cut_lineage(found.select(q, key, "rank", F.col("score").alias("weight")))  # k rows a question
    around = both_ways(edges).withColumnRenamed("node", key).join(_few(hits.select(key).distinct()), key, "left_semi").select(key, "rel", "other").distinct()
    n = F.coalesce("n_relations", F.lit(0)).cast("long")
    out = hits.join(around.groupBy(key).agg(F.count("*").alias("n_relations")), key, "left").withColumn("n_relations", n)
    score = F.least(F.lit(1.0), 1 - 0.1 * (F.col("rank") - 1) + F.least(0.05 * F.col("n_relations"), F.lit(0.2)))
    return out.select(q, key, "rank", "weight", "n_relations", F.round(score, DIGITS).alias("score"))


def _few(nodes: DataFrame) -> DataFrame:
    """`nodes` to be sent to every task where they are at most SENT, so that a table of edges stays where it is."""
    return F.broadcast(nodes) if nodes.count() <= SENT else nodes


def transitions(edges: DataFrame, fan: int) -> DataFrame:
    """(src, dst, share): where a walk goes from each node: its `fan` heaviest edges (src, dst, weight), ties by name, by weight.

    However many edges a hub has, it passes on `fan` of them; the cut comes before the shuffle's rows are sorted out, so a hub is no task's burden.
    Weights that are null or not positive are no way to go; repeated edges count together.
    """
    e = edges.where("src is not null and dst is not null and weight > 0").groupBy("src", "dst").agg(F.round(F.sum("weight"), DIGITS).alias("weight"))
    kept = e.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))).where(F.col("_n") <= fan)
    return kept.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share")


def walk(seeds: DataFrame, edges: DataFrame, *, hops: int = 2, restart: float = 0.15, frontier: int = 50, fan: int = 20, q: str = "query_id") -> DataFrame:
    """(q, node, weight): where a random walk with restart from each question's seeds (q, node, weight) is after `hops` steps.

    All questions walk at once. A step moves the weight of each node along its transitions and puts the share `restart` back on the seeds; then each question keeps its
    `frontier` heaviest nodes, ties by name. So a step makes at most questions x frontier x fan rows, and of the edges only those are sorted out that leave some frontier. Seeds are scaled to 1
    for each question, those without positive weight are dropped; what reaches a node without edges ends there.
    """
    good = seeds.where(F.col(q).isNotNull() & F.col("node").isNotNull() & (F.col("weight") > 0)).groupBy(q, "node").agg(F.sum("weight").alias("weight"))
    home = cut_lineage(good.withColumn("weight", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy(q)), DIGITS)))
    at = home
    for _ in range(hops):
        ways = transitions(edges.join(_few(at.select(F.col("node").alias("src")).distinct()), "src", "left_semi"), fan)
        moved = at.join(ways, F.col("node") == F.col("src")).select(q, F.col("dst").alias("node"), (F.col("weight") * F.col("share") * (1 - restart)).alias("weight"))
        both = moved.unionByName(home.withColumn("weight", F.col("weight") * restart)).groupBy(q, "node").agg(F.round(F.sum("weight"), DIGITS).alias("weight"))
        place = F.row_number().over(Window.partitionBy(q).orderBy(F.col("weight").desc(), "node"))
        at = cut_lineage(both.withColumn("_n", place).where(F.col("_n") <= frontier).drop("_n"))
    return at


def graph_hits(walked: DataFrame, documents: DataFrame, k: int, *, q: str = "query_id", d: str = "doc_id") -> DataFrame:
    """(q, d, score, rank): the k documents whose nodes (node, d) a question's walk weighs most, the heaviest being 1."""
    by = walked.join(documents.select("node", d).distinct(), "node").groupBy(q, d).agg(F.sum("weight").alias("weight"))
    most = F.max("weight").over(Window.partitionBy(q))
    scored = by.withColumn("score", F.round(F.col("weight") / most, DIGITS))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy(F.col("score").desc(), d))).where(F.col("rank") <= k).select(q, d, "score", "rank")


def similar_nodes(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, *, types: Sequence[str], names: DataFrame | None = None, most: int = 3, q: str = "query_id", key: str = "uri", vector: str = "embedding",
) -> DataFrame:
    """(q, key, type, rank, score, neighbours): the k nodes of the given types nearest to each question's vector, with at most `most` of their neighbours each.

    nodes (key, type, vector), edges (src, rel, dst) in either direction, names (key, label) of neighbours. A neighbour is (rel, other, direction, label), the first ones
    in that order; nodes without any get an empty list. Only neighbours of what was found are looked at. Nodes and questions without a vector are left out, ties go by key.
    """
    near = cut_lineage(dense_top_k(questions, nodes, k, where=F.col("type").isin(list(types)), q=q, d=key, vector=vector))
    found = near.select(key).distinct()
    kinds = nodes.where(F.col("type").isin(list(types))).join(found, key, "left_semi").groupBy(key).agg(F.min("type").alias("type"))
    around = neighbours(found, edges, most, key)
    label = F.lit(None).cast("string").alias("label")
    if names is not None:
        around = around.join(names.groupBy(F.col(key).alias("other")).agg(F.min("label").alias("label")), "other", "left")
        label = F.col("label")
    listed = around.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rel", "other", "direction", label))).alias("neighbours"))
    none = F.array().cast(listed.schema["neighbours"].dataType)
    return near.join(kinds, key).join(listed, key, "left").select(q, key, "type", "rank", (1 - F.col("distance")).alias("score"), F.coalesce("neighbours", none).alias("neighbours"))
