"""Dense and lexical search for whole tables of questions, fusion, boosts and limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra.functions.columns import words
from kadastra.operators.lexical import SENT, term_counts
from kadastra.operators.storage import cut_lineage, written
from kadastra.operators.views import most_specific

#: Question tables up to about this many vectors are sent to every task; larger ones are worked on in such blocks.
BLOCK = 4096
#: So many questions of a block at a time are held against so many documents: a task's matrix is 2 MB at most, whatever the size of either table.
SLICE, ROWS = 256, 1024
#: More than a matrix product's distances and the exact ones may differ.
SLACK = 1e-9


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, 1)[:, None]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed one component after the other as SQL does."""
    return np.cumsum(a * b, axis=1)[:, -1:].sum(axis=1)


def _first(k: int, row: np.ndarray, near: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest entries of each row, ties by name, in this order."""
    order = np.lexsort((names, near, row))
    order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
    return row[order], near[order], names[order]


def _nearest(ids: list, m: np.ndarray, wants: list, k: int, q: str, d: str, vector: str, same: str | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with its documents: k of them for each of the questions `ids` with the vectors `m`.

    A product over a slice of questions and some documents tells which can be among the k; their distances are then summed row by row, since a product rounds
    equal vectors differently at its edges: they would be near 0, not at it, and ties would not go by document id.
    """
    places = pd.Index(pd.unique(pd.Series([w for w in wants if w is not None], dtype=object)))
    wanted = np.array([-1 if w is None else places.get_loc(w) for w in wants], np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, squares = _unit(m), _dots(m, m)
        begins = range(0, len(ids), SLICE)
        best: list = [None] * len(begins)
        limit = np.full(len(ids), np.inf)  # the k-th best distance of each question so far
        for f in frames:
            for at in range(0, len(f), ROWS):
                some = f.iloc[at : at + ROWS].sort_values(d)
                x, found = _vectors(some[vector]), some[d].to_numpy()
                unit, square = _unit(x), _dots(x, x)
                of = places.get_indexer(some[same]) if same else None
                for i, begin in enumerate(begins):
                    asked, last = units[begin : begin + SLICE], limit[begin : begin + SLICE]
                    dist = asked @ unit.T
                    np.subtract(1, dist, out=dist)
                    if same:
                        w = wanted[begin : begin + SLICE, None]
                        dist[(w >= 0) & (w != of)] = np.inf
                    bound = last + SLACK
                    open_ = np.flatnonzero(np.isinf(last))
                    if len(open_) and k < len(x):  # so that a first block brings k rows too, not all
                        bound[open_] = np.nan_to_num(np.partition(dist[open_], k - 1, axis=1)[:, k - 1], nan=np.inf) + 2 * SLACK
                    r, c = np.nonzero((dist <= bound[:, None]) & (dist < np.inf))
                    if not len(r):
                        continue
                    near = np.empty(len(r))
                    for j in range(0, len(r), ROWS):
                        a, b = r[j : j + ROWS], c[j : j + ROWS]
                        size = np.sqrt(squares[begin + a] * square[b])
                        fits = (size > 1e-150) & (size < np.inf)  # beyond, and for zero vectors, by unit vectors
                        cosine = np.where(fits, _dots(m[begin + a], x[b]) / np.where(fits, size, 1), _dots(asked[a], unit[b]))
                        near[j : j + ROWS] = 1 - np.clip(cosine, -1, 1)
                    row, near, c = _first(k, r, near, c)  # documents are in the order of their ids here
                    new = row, near, found[c]
                    if best[i] is None:
                        best[i] = new
                    else:
                        touched = np.isin(best[i][0], row)
                        new = _first(k, *(np.concatenate([a[touched], b]) for a, b in zip(best[i], new)))
                        best[i] = tuple(np.concatenate([a[~touched], b]) for a, b in zip(best[i], new))
                    full = np.flatnonzero(np.bincount(new[0], minlength=len(asked)) == k)
                    last[full] = new[1][np.searchsorted(new[0], full, side="right") - 1]
        for begin, b in zip(begins, best):
            if b is not None:  # a partition without hits gives no frame: Arrow makes no array of no strings
                yield pd.DataFrame({q: np.array(ids[begin : begin + SLICE], object)[b[0]], d: b[2], "distance": b[1]})

    return run


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, *, where: Column | None = None, q: str = "query_id", d: str = "doc_id", vector: str = "embedding", same: str | None = None) -> DataFrame:
    """(q, d, distance, rank): the k nearest documents by cosine distance for each query.

    Queries go block by block to the documents' partitions; each partition keeps k per query, so the shuffle
    carries partitions x queries x k narrow rows. Documents stay where they are. The predicate comes first and
    reaches the scan. Ties go by document id. A query whose column `same` isn't null is held against the
    documents that have its value there. Where there are several blocks, the driver holds one at a time and its result is
    written before the next.
    """
    docs = docs if where is None else docs.where(where)
    more = [same] if same else []
    docs = docs.select(d, vector, *more).where(F.col(vector).isNotNull())
    queries = queries.select(q, vector, *more).where(F.col(vector).isNotNull())
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((q, queries), (d, docs))}

    w = Window.partitionBy(q).orderBy("distance", d)

    def block(rows: list) -> DataFrame:
        m = _vectors(pd.Series([r[vector] for r in rows]))
        hits = docs.mapInPandas(_nearest([r[q] for r in rows], m, [r[same] for r in rows] if same else [], k, q, d, vector, same), f"`{q}` {kinds[q]}, `{d}` {kinds[d]}, distance double")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    n = max(1, -(-queries.count() // BLOCK))
    number = F.pmod(F.xxhash64(q), F.lit(n))
    found = None
    for i in range(n):
        rows = queries.where(number == i).collect() if n > 1 else queries.collect()
        if rows:
            one = block(rows) if n == 1 else cut_lineage(block(rows))
            found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"`{q}` {kinds[q]}, `{d}` {kinds[d]}, distance double, rank int")


def approximate_top_k(queries: DataFrame, docs: DataFrame, k: int, *, q: str = "query_id", d: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """As dense_top_k, from an inverted-file index that is built for this one search; distances are exact, of the nearest rows nine in ten at least are meant to be found."""
    from kadastra.operators.index import VectorIndex

    index = VectorIndex.build(docs, d=d, vector=vector)
    if index is None:
        kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((q, queries), (d, docs))}
        return docs.sparkSession.createDataFrame([], f"`{q}` {kinds[q]}, `{d}` {kinds[d]}, distance double, rank int")
    return index.search(queries, k, q=q, vector=vector).select(q, d, "distance", "rank")


def normalised(hits: DataFrame, q: str = "query_id") -> DataFrame:
    """score = 1 - distance / greatest distance of the query's list; 0 greatest gives null."""
    return hits.withColumn("score", 1 - F.col("distance") / F.nullif(F.max("distance").over(Window.partitionBy(q)), F.lit(0.0)))


def bm25(
    queries: DataFrame, docs: DataFrame, *, pairs: DataFrame | None = None, q: str = "query_id", d: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25,
) -> DataFrame:
    """(q, d, score) of every document that shares a term with a query, or of the stated `pairs` (q, d) that do.

    Idf is ln(n - df + 0.5) - ln(df + 0.5); negative ones become `floor` times the mean idf over all terms of the corpus. Texts are counted where
    they lie and only document frequencies are stored. With pairs only their documents are counted a second time, so nothing
    is made for each question and document.
    """
    n = docs.count()
    every = term_counts(docs, d=d, text=text)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df_ = written(every.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("raw", raw))
    n_terms, mean = df_.agg(F.sum("cf"), F.avg("raw")).first()
    asked = queries.select(q, F.explode(words(F.col(text))).alias("term")).distinct()
    own, keys = every, ["term"]
    if pairs is not None:
        pairs = cut_lineage(pairs.select(q, d).distinct().join(asked.select(q).distinct(), q, "left_semi"))
        ids = pairs.select(d).distinct()
        own = term_counts(docs.join(F.broadcast(ids) if pairs.count() <= SENT else ids, d, "left_semi"), d=d, text=text).join(pairs, d)
        keys = [q, "term"]
    idf = df_.join(asked.select("term").distinct(), "term", "left_semi").select("term", F.when(F.col("raw") < 0, F.lit(floor * (mean or 0.0))).otherwise(F.col("raw")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(n_terms / n if n_terms else 1.0)))
    return own.join(asked, keys).join(idf, "term").groupBy(q, d).agg(F.sum(part).alias("score"))


def rank_scores(hits: DataFrame, k: int = 20, q: str = "query_id", d: str = "doc_id") -> DataFrame:
    """score = 1 / (rank + 1) with the first rank 0, for the best k."""
    w = Window.partitionBy(q).orderBy(F.col("score").desc(), d)
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).withColumn("score", 1.0 / (F.col("rank") + 1))


def fuse_weighted(parts: Sequence[tuple[str, DataFrame, float]], q: str = "query_id", d: str = "doc_id") -> DataFrame:
    """Weighted sum of the channels' scores; the channel is "hybrid" where several found the document."""
    rows = [df.select(q, d, (F.col("score") * w).alias("score"), F.lit(n).alias("channel")) for n, df, w in parts]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy(q, d).agg(F.sum("score").alias("score"), F.when(F.count_distinct("channel") > 1, F.lit("hybrid")).otherwise(F.min("channel")).alias("channel"))


def fuse_ranks(parts: Sequence[DataFrame], constant: int = 60, q: str = "query_id", d: str = "doc_id") -> DataFrame:
    """Sum of 1 / (constant + rank), ranks counted from 0, over channels (q, d, rank)."""
    both = parts[0].select(q, d, "rank")
    for p in parts[1:]:
        both = both.unionByName(p.select(q, d, "rank"))
    return both.groupBy(q, d).agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))


def boost(hits: DataFrame, rules: Sequence[tuple[Column, float]]) -> DataFrame:
    """The score times the factor of every rule that holds."""
    s = F.col("score")
    for test, factor in rules:
        s = s * F.when(test, F.lit(factor)).otherwise(F.lit(1.0))
    return hits.withColumn("score", s)


def top(hits: DataFrame, k: int, keys: Sequence[str] = ("query_id",), d: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), d)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diverse(hits: DataFrame, k: int, per_source: int = 3, q: str = "query_id", source: str = "source", d: str = "doc_id") -> DataFrame:
    """The best k with at most `per_source` of one source first, the rest filling up."""
    inner = F.row_number().over(Window.partitionBy(q, source).orderBy(F.col("score").desc(), d))
    ranked = hits.withColumn("_in", inner)
    w = Window.partitionBy(q).orderBy(F.col("_in") > per_source, F.col("score").desc(), d)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_in")


def relevance_gate(hits: DataFrame, low: float = 0.2, q: str = "query_id") -> DataFrame:
    """Mean cosine of a query's hits clipped to 0..1, and whether it is under the gate."""
    by = hits.groupBy(q).agg(F.avg(1 - F.col("distance")).alias("m")).withColumn("relevance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m")))).drop("m")
    return by.withColumn("is_low", F.col("relevance") < low)


def context(hits: DataFrame, limits: dict[str, int], q: str = "query_id", sep: str = "\n\n") -> DataFrame:
    """(q, context): texts cut by their type's limit, joined by priority and rank."""
    order = F.array_position(F.array(*map(F.lit, limits)), F.col("type"))
    cut = F.lit(None).cast("int")
    for t, n in limits.items():
        cut = F.when(F.col("type") == t, F.lit(n)).otherwise(cut)
    rows = hits.where(F.col("type").isin(list(limits))).select(q, F.struct(order.alias("o"), "rank", F.substring(F.col("text"), F.lit(1), cut).alias("t")).alias("x"))
    return rows.groupBy(q).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), sep).alias("context"))




@dataclass(frozen=True)
class Collection:
    """How one collection is searched: the distance that its hits may have, and what changes that.

    Questions with one of `keywords` get the threshold `raised`. Where `same` names a column, a question that has
    a value there is held against the rows of that value only, with the threshold `forced` if there is one. `k` is the number of hits
    if it differs from the search's.
    """

    name: str
    threshold: float
    keywords: tuple[str, ...] = ()
    raised: float | None = None
    same: str | None = None
    forced: float | None = None
    k: int | None = None


def search_collections(
    queries: DataFrame, docs: DataFrame, collections: Sequence[Collection], lexical: Callable[[DataFrame], DataFrame], k: int, *, expand: int = 3, constant: int = 60, question: str = "question", q: str = "query_id", d: str = "doc_id",
) -> DataFrame:
    """(q, collection, d, distance, rank): up to k hits of every collection for each query.

    Each collection gives `expand` times k nearest rows; these are ranked again by the sum of 1 / (constant + rank)
    over the dense order and that of `lexical`, which makes (q, d, score) of candidates (q, d), and the best k
    within the threshold stay. Collections are a short stated list, each a filter that reaches the scan; only
    candidates are joined or ranked.
    """
    out = None
    for c in collections:
        n = c.k or k
        text = F.lower(question)
        limit = F.lit(c.threshold)
        if c.raised is not None:
            hit = F.lit(False)
            for word in c.keywords:
                hit = hit | F.contains(text, F.lit(word))
            limit = F.when(hit, F.lit(c.raised)).otherwise(limit)
        if c.same and c.forced is not None:
            limit = F.when(F.col(c.same).isNotNull(), F.lit(c.forced)).otherwise(limit)
        hits = cut_lineage(dense_top_k(queries, docs, n * expand, where=F.col("collection") == c.name, q=q, d=d, same=c.same))
        fused = _reranked(hits, lexical, n, constant, q, d)
        kept = fused.join(queries.select(q, limit.alias("_limit")), q).where(F.col("distance") <= F.col("_limit"))
        one = kept.select(q, F.lit(c.name).alias("collection"), d, "distance", F.col("_place").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


def _reranked(hits: DataFrame, lexical: Callable[[DataFrame], DataFrame], n: int, constant: int, q: str, d: str) -> DataFrame:
    """The best n of each query's hits by the sum of 1 / (constant + rank) over the dense order and that of `lexical`, with _place."""
    scored = hits.join(lexical(hits.select(q, d)).select(q, d, F.col("score").alias("_lex")), [q, d], "left")
    by_words = F.row_number().over(Window.partitionBy(q).orderBy(F.coalesce("_lex", F.lit(0.0)).desc(), "rank"))
    fused = scored.withColumn("_words", by_words).withColumn("_rrf", 1.0 / (constant + F.col("rank") - 1) + 1.0 / (constant + F.col("_words") - 1))
    place = F.row_number().over(Window.partitionBy(q).orderBy(F.col("_rrf").desc(), "rank"))
    return fused.withColumn("_place", place).where(F.col("_place") <= n)


def indicator_search(
    questions: DataFrame, towns: DataFrame, docs: DataFrame, fixed: Callable[[Column, Column], Column], lexical: Callable[[DataFrame], DataFrame], k: int = 3, *, expand: int = 3, constant: int = 60, question: str = "question", q: str = "query_id", d: str = "doc_id",
) -> DataFrame:
    """(q, rank, part, doc, distance): fixed documents of each question's class, then what is near it.

    questions (q, question, embedding), towns (q, town) that they name, docs (d, town, embedding). `fixed` makes the ids of fixed
    documents from the question's text and its number of towns; they come first, at distance 0. A question with several
    towns then gets the nearest document of each, by town; one with a single town or none the best k - 1, one at least, of that
    town's or all documents, ranked again by words as in search_collections. Questions without a vector get fixed documents only.
    """
    named = towns.where("town is not null").select(q, "town").distinct()
    base = questions.select(q, question, "embedding").join(named.groupBy(q).agg(F.count("*").alias("_n")), q, "left").fillna(0, ["_n"])
    rows = base.select(q, F.lit("fixed").alias("part"), F.posexplode(fixed(F.coalesce(question, F.lit("")), F.col("_n"))).alias("_at", "doc"), F.lit(0.0).alias("distance"))
    n = max(1, k - 1)
    asked = base.join(named, q, "left").withColumn("_ask", F.concat_ws("|", F.col(q).cast("string"), "town"))
    hits = dense_top_k(asked, docs, n * expand, q="_ask", d=d, same="town").join(asked.select("_ask", q, "town", "_n"), "_ask")
    hits = cut_lineage(hits)  # n * expand rows for each question and town
    several = hits.where("_n > 1 and rank = 1").select(q, F.lit("town").alias("part"), F.row_number().over(Window.partitionBy(q).orderBy("town")).alias("_at"), F.col(d).cast("string").alias("doc"), "distance")
    near = _reranked(hits.where("_n <= 1"), lexical, n, constant, q, d).select(q, F.lit("near").alias("part"), F.col("_place").alias("_at"), F.col(d).cast("string").alias("doc"), "distance")
    every = rows.unionByName(several).unionByName(near)
    w = Window.partitionBy(q).orderBy(F.col("part") != "fixed", "_at")
    return every.select(q, F.row_number().over(w).alias("rank"), "part", "doc", "distance")


def group_search(
    questions: DataFrame, members: DataFrame, parents: DataFrame, families: Sequence[tuple[str, DataFrame, dict[str, Sequence[str]]]], indicators: DataFrame, *, most: int = 5, most_indicators: int = 3, q: str = "query_id",
) -> DataFrame:
    """(q, part, place, town, doc): what a question about a group of towns gets, in five parts.

    questions (q, epci, asks_quality and the dimensions that they name), members (epci, commune), parents (epci, doc), indicators as
    of indicator_search. `families` are (part, views (view_name, dim1_value, dim2_value, doc), each view's dimensions in the order in which views are tried).
    Parts: "parent", the group's own document; for questions about quality of life the most specific view of each family for
    each member, by name, until `most` members have one; "note", how many of all members these are, as n/m, and "without", the
    others, where there are any; "indicator", the fixed documents and the `most_indicators` nearest of others. Groups without members or parent
    lack those parts.
    """
    out = [questions.select(q, "epci").join(parents, "epci").select(q, F.lit("parent").alias("part"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("town"), "doc")]
    dims = list(dict.fromkeys(c for _, _, order in families for ds in order.values() for c in ds if c != "commune"))
    asked = questions.where("asks_quality").select(q, "epci", *dims).join(members.select("epci", "commune").distinct(), "epci").withColumn("_m", F.struct(q, "commune"))
    picked = None
    for part, views, order in families:
        value = lambda ds, i: F.col(ds[i]).cast("string") if i < len(ds) else F.lit("")
        named = lambda ds: [F.col(c).isNotNull() for c in ds] + [F.lit(True)]
        tries = F.array(*(F.when(F.least(*named(ds), F.lit(True)), F.struct(F.lit(v).alias("view_name"), value(ds, 0).alias("dim1_value"), value(ds, 1).alias("dim2_value"))) for v, ds in order.items()))
        wanted = asked.select("_m", F.explode(F.array_compact(tries)).alias("x")).select("_m", "x.*")
        one = most_specific(wanted, views, list(order), key="_m").select(F.col(f"_m.{q}").alias(q), F.col("_m.commune").alias("town"), F.lit(part).alias("part"), "doc")
        picked = one if picked is None else picked.unionByName(one)
    picked = cut_lineage(picked)
    has = picked.select(q, "town").distinct().withColumn("place", F.row_number().over(Window.partitionBy(q).orderBy("town"))).where(F.col("place") <= most)
    out.append(picked.join(has, [q, "town"]).select(q, "part", "place", "town", "doc"))
    cover = asked.select(q, F.col("commune").alias("town")).join(has, [q, "town"], "left")
    note = cover.groupBy(q).agg(F.count("place").alias("n"), F.count("*").alias("m")).where("n < m")
    none = F.lit(None).cast("string")
    out.append(note.select(q, F.lit("note").alias("part"), F.lit(0).alias("place"), none.alias("town"), F.concat_ws("/", F.col("n").cast("string"), F.col("m").cast("string")).alias("doc")))
    lacks = Window.partitionBy(q).orderBy("town")
    out.append(cover.where("place is null").select(q, F.lit("without").alias("part"), F.row_number().over(lacks).alias("place"), "town", none.alias("doc")))
    nearest = F.row_number().over(Window.partitionBy(q, F.col("part") == "fixed").orderBy("distance", "rank"))
    of = indicators.withColumn("_k", nearest).where((F.col("part") == "fixed") | (F.col("_k") <= most_indicators))
    out.append(of.join(questions.select(q), q, "left_semi").select(q, F.lit("indicator").alias("part"), F.col("rank").alias("place"), none.alias("town"), "doc"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def view_search(questions: DataFrame, views: DataFrame, k: int, *, q: str = "query_id", d: str = "doc", vector: str = "embedding", age: str = "age_range", job: str = "profession") -> DataFrame:
    """(q, d, distance, rank): the k nearest of the views that fit each question.

    questions (q, vector, age, job), views (d, dim1_value, dim2_value, vector). Where a question names an age, a view's first dimension must have that value, and its
    second the job's if that is named too; a job alone is the first dimension's value; a question that names neither is held against all views. A question that no view fits
    has no row. Questions are parted by what they name, so each part is one dense search whose equality is looked at inside the product.
    """
    has_age, has_job = F.col(age).isNotNull(), F.col(job).isNotNull()
    pair = lambda a, b: F.to_json(F.array(F.col(a).cast("string"), F.col(b).cast("string")))
    first = F.coalesce(F.col(age).cast("string"), F.col(job).cast("string"))
    one, two = F.col("dim1_value").isNotNull(), F.col("dim2_value").isNotNull()
    parts = [
        dense_top_k(questions.where(~has_age & ~has_job), views, k, q=q, d=d, vector=vector),
        dense_top_k(questions.where(has_age != has_job).withColumn("_fits", first), views.where(one).withColumn("_fits", F.col("dim1_value").cast("string")), k, q=q, d=d, vector=vector, same="_fits"),
        dense_top_k(questions.where(has_age & has_job).withColumn("_fits", pair(age, job)), views.where(one & two).withColumn("_fits", pair("dim1_value", "dim2_value")), k, q=q, d=d, vector=vector, same="_fits"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sub_question_search(
    subs: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rescore: Callable[[DataFrame], DataFrame], sources: DataFrame, k: int, *, per_source: int = 3, q: str = "query_id", d: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """((q, sub, d, sub_rank), (q, d, score, n_subs, source, rank)): what each sub-question finds, and the best k of all for each question.

    `subs` is (q, sub, text). `retrieve` makes (ask, d, rank) of (ask, text), all sub-questions in one go; `rescore` makes (q, d, score) of the pooled candidates
    (q, d) against the whole question, those without a score count as 0. Of the pool the best k stay, at most `per_source` of one source first
    (sources (d, source); null is a source). A document that several sub-questions find is pooled once and keeps their number.
    """
    asked = cut_lineage(subs.where(F.col("text").isNotNull()).select(q, "sub", "text").withColumn("ask", F.monotonically_increasing_id()))
    found = cut_lineage(retrieve(asked.select("ask", "text")).join(asked.select("ask", q, "sub"), "ask").select(q, "sub", d, F.col("rank").alias("sub_rank")))
    pool = cut_lineage(found.groupBy(q, d).agg(F.count_distinct("sub").alias("n_subs")))
    scored = pool.join(rescore(pool.select(q, d)).select(q, d, "score"), [q, d], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    placed = scored.join(sources.select(d, F.coalesce("source", F.lit("")).alias("source")), d, "left")
    return found, diverse(placed, k, per_source, q=q, d=d).select(q, d, "score", "n_subs", "source", "rank")


#: Parts of source types that speak for what people say and for what is measured.
SUBJECTIVE = ("raptor", "enquete", "verbatim")
OBJECTIVE = ("opp", "objectif", "equipement")


def evidence_balance(hits: DataFrame, kind: Column, *, keys: Sequence[str] = ("query_id", "sub"), subjective: Sequence[str] = SUBJECTIVE, objective: Sequence[str] = OBJECTIVE) -> DataFrame:
    """(keys, has_subjective, has_objective): whether a sub-question's hits hold evidence of each sort, by parts of their type's name. A null type is neither."""
    has = lambda parts: F.coalesce(F.bool_or(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(kind, p))), F.lit(False))
    return hits.groupBy(*keys).agg(has(subjective).alias("has_subjective"), has(objective).alias("has_objective"))
