"""Triples, typed nodes and edges: labels, closures, neighbours, search, loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra.functions.columns import snake_case


def labels(triples: DataFrame, predicate: str, prefer: str = "fr") -> DataFrame:
    """(s, label): one object per subject, the preferred language first, then the least text."""
    rows = triples.where(F.col("p") == predicate)
    w = Window.partitionBy("s").orderBy((F.coalesce(F.col("lang"), F.lit("")) != prefer).cast("int"), "o")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("s", F.col("o").alias("label"))


def closure(edges: DataFrame, *, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, parent): all ancestors, found round by round from the pairs of the round before.

    Cycles end when a round adds no pair; a node is its own ancestor only if a cycle says so.
    """
    from kadastra.operators.ontology import reach

    up = edges.select(F.col(child).alias("src"), F.col(parent).alias("dst"))
    return reach(up, up.select(F.col("src").alias("origin"), F.col("dst").alias("node"))).select(F.col("origin").alias(child), F.col("node").alias(parent))


def relation_rows(triples: DataFrame, predicates: Sequence[str], names: DataFrame) -> DataFrame:
    """(s, p, o, s_label, o_label) of the predicates asked for; unlabelled ends keep their ids."""
    r = triples.where(F.col("p").isin(list(predicates)))
    a, b = names.select(F.col("s"), F.col("label").alias("_a")), names.select(F.col("s").alias("o"), F.col("label").alias("_b"))
    return r.join(a, "s", "left").join(b, "o", "left").select("s", "p", "o", F.coalesce("_a", "s").alias("s_label"), F.coalesce("_b", "o").alias("o_label"))


def load_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by uri and the edges between known nodes, relations named in upper snake case."""
    n = nodes.groupBy("uri").agg(*(F.min(c).alias(c) for c in nodes.columns if c != "uri"))
    local = F.regexp_extract("predicate", r"([^/#]+)$", 1)
    e = edges.select("src", snake_case(local).alias("rel"), "dst").distinct()
    return n, e.join(n.select(F.col("uri").alias("src")), "src", "left_semi").join(n.select(F.col("uri").alias("dst")), "dst", "left_semi")


def long_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, indicator, value): wide numbers as rows, nulls skipped, once each."""
    items = F.array(*(F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(key, F.explode(items).alias("x")).select(key, "x.*").where("value is not null").distinct()


def keyword_nodes(nodes: DataFrame, keywords: Sequence[str], columns: Sequence[str], limit: int, key: str = "uri") -> DataFrame:
    has = F.lit(False)
    for k in keywords:
        for c in columns:
            has = has | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(k))
    return nodes.where(has).orderBy(key).limit(limit)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, rel, other, direction): each edge seen from both ends."""
    out = edges.select(F.col("src").alias("node"), "rel", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), "rel", F.col("src").alias("other"), F.lit("in").alias("direction")))


def node_search(nodes: DataFrame, edges: DataFrame, keywords: Sequence[str], limit: int, key: str = "uri") -> DataFrame:
    """Keyword nodes with distinct neighbour relations and a score that falls by place and rises with relations."""
    hit = keyword_nodes(nodes, keywords, ["label"], limit, key)
    rel = both_ways(edges).select(F.col("node").alias(key), F.concat_ws(":", "rel", "other").alias("r"))
    by = hit.join(rel, key, "left").groupBy(key).agg(F.array_sort(F.collect_set("r")).alias("relations"))
    place = F.row_number().over(Window.orderBy(key)) - 1  # of the limited hits only
    n = F.size("relations")
    return by.withColumn("score", F.least(F.lit(1.0), 1 - 0.1 * place + F.least(0.05 * n, F.lit(0.2))))


def node_types(nodes: DataFrame, order: Sequence[str], key: str = "uri", types: str = "labels") -> DataFrame:
    """Each node's first type in order; nodes without any are dropped."""
    kind = F.coalesce(*(F.when(F.array_contains(types, t), F.lit(t)) for t in order))
    return nodes.withColumn("type", kind).where("type is not null")


def edges_of(typed: DataFrame, edges: DataFrame, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Edges between typed nodes, and how many were dropped."""
    kept = edges.join(typed.select(F.col(key).alias("src")), "src", "left_semi").join(typed.select(F.col(key).alias("dst")), "dst", "left_semi")
    total, left = edges.agg(F.count("*").alias("a")), kept.agg(F.count("*").alias("b"))
    return kept, total.crossJoin(left).select((F.col("a") - F.col("b")).alias("dropped"))


def counts(typed: DataFrame, edges: DataFrame, key: str = "uri") -> DataFrame:
    """(kind, name, n): nodes by type, edges by relation and by (source type, relation, target type)."""
    a = typed.select(F.col(key).alias("src"), F.col("type").alias("ts"))
    b = typed.select(F.col(key).alias("dst"), F.col("type").alias("td"))
    triple = edges.join(a, "src").join(b, "dst").select(F.lit("pattern").alias("kind"), F.concat_ws("-", "ts", "rel", "td").alias("name"))
    rows = typed.select(F.lit("node").alias("kind"), F.col("type").alias("name")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("rel").alias("name"))).unionByName(triple)
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def neighbours(nodes: DataFrame, edges: DataFrame, most: int = 3, key: str = "uri") -> DataFrame:
    """(key, rel, other, direction): at most so many neighbours of each node, both ways."""
    rows = both_ways(edges).withColumnRenamed("node", key).join(nodes.select(key), key, "left_semi")
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("rel", "other", "direction"))).where(F.col("_rn") <= most).drop("_rn")


def _numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Column i: 0, 1, ... within each rel, in an order by hash. Rows of a relation are numbered in 64 parts, so none meets in one task."""
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *rows.columns)).withColumn("_part", F.pmod("_h", F.lit(64)))
    sizes = rows.groupBy("rel", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("rel").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("rel", "_part").orderBy("_h", *(c for c in rows.columns if c[0] != "_"))) - 1
    return rows.withColumn("i", place).join(F.broadcast(sizes.withColumn("_before", before)), ["rel", "_part"]).withColumn("i", F.col("i") + F.col("_before")).drop("_h", "_part", "_n", "_before")


def negative_pairs(edges: DataFrame, *, seed: int = 11) -> DataFrame:
    """(src, rel, dst): as many different pairs of each relation as it has different edges, none of them an edge.

    Pairs are drawn from the relation's sources and targets by hashes of the edges; those that are edges or repeat are
    drawn again with new seeds until the count is met. A relation whose ends make at most four pairs for each edge has
    all of them looked at, so fewer come out only where no other pair is left. In the others at least half of the
    draws of a round are new, so rounds grow with the logarithm of the edges.
    """
    from kadastra.operators.storage import cut_lineage

    e = cut_lineage(_numbered(edges.select("src", "rel", "dst").where("src is not null and rel is not null and dst is not null").distinct(), seed))
    ends = {c: cut_lineage(_numbered(e.select("rel", c).distinct(), seed)) for c in ("src", "dst")}
    size = e.groupBy("rel").agg(F.count("*").alias("n"))
    for c, df in ends.items():
        size = size.join(df.groupBy("rel").agg(F.count("*").alias(f"n_{c}")), "rel")
    pairs = F.col("n_src") * F.col("n_dst")
    size = cut_lineage(size.withColumn("pairs", pairs).withColumn("need", F.least("n", pairs - F.col("n"))))  # a row for each relation

    def drawn(numbers: DataFrame, wanted: DataFrame) -> DataFrame:
        at = numbers.select("rel", F.expr("p div n_dst").alias("a"), (F.col("p") % F.col("n_dst")).alias("b"))
        for c, k in (("src", "a"), ("dst", "b")):
            at = at.join(ends[c].withColumnRenamed("i", k), ["rel", k])
        new = at.select("src", "rel", "dst").distinct().join(e, ["src", "rel", "dst"], "left_anti")
        new = new if found is None else new.join(found, ["src", "rel", "dst"], "left_anti")
        return _numbered(new, seed + turn).join(F.broadcast(wanted.select("rel", "need")), "rel").where("i < need").select("src", "rel", "dst")

    found, turn = None, 0
    every = e.join(F.broadcast(size), "rel").where("pairs <= 4 * n").select("rel", "n_dst", "pairs", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("i") + k * F.col("n"))).alias("p"))
    found = cut_lineage(drawn(every.where("p < pairs"), size))
    while True:
        left = size.join(found.groupBy("rel").agg(F.count("*").alias("got")), "rel", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).where("need > 0")
        if not left.limit(1).count():
            return found
        turn += 1
        numbers = e.join(F.broadcast(left), "rel").withColumn("p", F.pmod(F.xxhash64(F.lit(seed + turn), "src", "dst"), F.col("pairs")))
        found = cut_lineage(found.unionByName(drawn(numbers, left)))


def to_triples(df: DataFrame, subject: Column, properties: Sequence[tuple[str, Column]]) -> DataFrame:
    """(s, p, o) rows of a table; null objects are left out."""
    items = F.array(*(F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in properties))
    return df.select(subject.alias("s"), F.explode(items).alias("x")).select("s", "x.*").where("o is not null")


def node_texts(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column text: the known ones of the columns, joined as sentences."""
    return nodes.withColumn("text", F.concat_ws(". ", *(F.when(F.trim(c) != "", F.col(c)) for c in columns)))
