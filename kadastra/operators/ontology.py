"""What follows from subclass relations: descendants, nearest marked ancestors, typed indicators and their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.operators.graph import labels
from kadastra.operators.storage import cut_lineage

#: Results of so many rounds are put together, so that plans stay short.
TOGETHER = 8


def reach(edges: DataFrame, start: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """(origin, node, steps): all nodes that each origin reaches along `edges` (src, dst), with the least number of steps.

    `start` (origin, node) is what is reached in one step. Only the pairs of the last round are joined with the edges, and what is known already is
    dropped, so each pair is expanded once; cycles end by themselves. `counts` gets the new pairs of each round. Nulls are dropped, repeated rows count once.
    """
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    new = cut_lineage(start.select("origin", "node").where("origin is not null and node is not null").distinct().withColumn("steps", F.lit(1)))
    rounds, steps = [new], 1
    n = new.count()
    while n:
        steps += 1
        if counts is not None:
            counts.append(n)
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        if len(rounds) > TOGETHER:
            known = cut_lineage(known)
            rounds = [known]
        step = new.join(e, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        new = cut_lineage(step.join(known, ["origin", "node"], "left_anti").withColumn("steps", F.lit(steps)))
        rounds.append(new)
        n = new.count()
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def nearest_marked(edges: DataFrame, marks: DataFrame, *, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, mark, steps): for each node below a mark the mark that is the fewest steps above it, of equally near ones the least by name.

    Marks (mark) send their names down, a step a round, to children that have none yet; so every node is expanded once, however many marks and ways
    stand above it. A mark isn't its own; it may have another mark above it. Cycles end by themselves.
    """
    e = cut_lineage(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct())
    last = marks.select(F.col("mark").alias("node"), "mark").where("mark is not null").distinct()
    found, steps = None, 0
    while True:
        steps += 1
        step = last.join(e, F.col("node") == F.col("p")).groupBy(F.col("c").alias("node")).agg(F.min("mark").alias("mark")).withColumn("steps", F.lit(steps))
        new = cut_lineage(step if found is None else step.join(found, "node", "left_anti"))
        found = new if found is None else found.unionByName(new)
        if steps % TOGETHER == 0:
            found = cut_lineage(found)
        if not new.limit(1).count():
            return found
        last = new.select("node", "mark")


def indicators(
    triples: DataFrame, *, indicator: str = "Indicator", objective: str = "ObjectiveIndicator", subjective: str = "SubjectiveIndicator", subclass: str = "subClassOf", measures: str = "measuresDimension", label: str = "label", prefer: str = "fr",
) -> DataFrame:
    """(uri, label, type, dimension): every class below the indicator class; objective if it lies below that class, else subjective below the other, else unknown.

    The dimension is the first one by name that it measures, or null. Walks go down from the three classes, which are given by name, so rows grow with the
    classes below them and not with all pairs of the ontology.
    """
    sub = triples.where(F.col("p") == subclass).select(F.col("o").alias("src"), F.col("s").alias("dst"))
    roots = [indicator, objective, subjective]
    below = reach(sub, sub.where(F.col("src").isin(roots)).select(F.col("src").alias("origin"), F.col("dst").alias("node")))
    under = lambda c: F.max((F.col("origin") == c).cast("int")) == 1
    kinds = below.groupBy(F.col("node").alias("uri")).agg(under(indicator).alias("_is"), F.when(under(objective), "objective").when(under(subjective), "subjective").otherwise("unknown").alias("type")).where("_is").drop("_is")
    measured = triples.where(F.col("p") == measures).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("dimension"))
    return kinds.join(labels(triples, label, prefer).withColumnRenamed("s", "uri"), "uri", "left").join(measured, "uri", "left").select("uri", "label", "type", "dimension")


def related_labels(found: DataFrame) -> DataFrame:
    """(dimension, label): the different labels of the indicators that measure each dimension, a row each, as a dimension may have very many."""
    return found.where("dimension is not null and label is not null").select("dimension", "label").distinct()
