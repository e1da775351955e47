"""Retrieval of the inventory: embeddings and documents against a stated set of queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kadastra.functions import columns as C
from kadastra.functions import scales as N
from kadastra.functions.columns import age_bucket_sql
from kadastra.operators import models as M
from kadastra.operators import retrieval as R
from kadastra.operators import views as V
from kadastra.operators import walks as K
from kadastra.operators.lexical import LexicalIndex
from kadastra.plans.registry import query
from kadastra.plans.stand_ins import SURVEY, geography, survey, table

#: The stated query set: ids divisible by this, against all rows.
EVERY = 50
DENSE = f"""q as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % {EVERY} = 0), e as (select vec_id as doc_id, embedding::double[] as de, label from embeddings),
dist as (select query_id, doc_id, label, 1 - list_cosine_similarity(qe, de) as distance from q, e)"""


def hits(spark, d, k, where=None):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    docs = e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return R.dense_top_k(q, docs, k, where=where)


def _top(k, more="", where="true"):
    return f"with {DENSE}, top as (select query_id, doc_id, distance, row_number() over (partition by query_id order by distance, doc_id) as rank from dist where {where} qualify rank <= {k}){more}"


@query("ret1_dense_top_k", _top(10) + " select query_id, doc_id, rank, round(distance, 6) as distance from top")
def ret1(spark, d):
    return hits(spark, d, 10).withColumn("distance", F.round("distance", 6))


@query("ret1_filtered_top_k", _top(5, where="label % 2 = 0") + " select query_id, doc_id, rank from top")
def ret1_filtered(spark, d):
    return hits(spark, d, 5, F.col("label") % 2 == 0).select("query_id", "doc_id", "rank")


@query("ret2_approximate_top_k")
def ret2(spark, d):
    e = table(spark, d, "embeddings")
    return R.approximate_top_k(e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 5)


@query("ret3_normalised_scores", _top(10) + " select query_id, doc_id, round(1 - distance / nullif(max(distance) over (partition by query_id), 0), 6) as score from top")
def ret3(spark, d):
    return R.normalised(hits(spark, d, 10)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


BM25 = """asked as (select distinct query_id, term from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+')) as term from benchmark)),
every as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+') as ws from documents), tot as (select count(*) as n, avg(len(ws)) as avgdl from every),
tf as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(ws) as dl, unnest(ws) as term from every) group by 1, 2),
df as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw, avgdl from tf, tot group by term, n, avgdl),
idf as (select term, avgdl, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end as idf from df),
bm as (select query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from tf join asked using (term) join idf using (term) group by 1, 2)"""


def lexical(spark, d, k, q=None):
    """The k best documents of each question by words; only postings of words that some question has are stored."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text") if q is None else q
    asked = q.select(F.explode(C.words(F.col("text"))).alias("term"))
    return LexicalIndex.build(table(spark, d, "documents").select("doc_id", "text"), terms=asked).search(q, k)


@query("ret4_bm25", f"with {BM25} select query_id, doc_id, round(score, 5) as score, row_number() over (partition by query_id order by round(score, 5) desc, doc_id) as rank from bm qualify rank <= 10")
def ret4(spark, d):
    return lexical(spark, d, 10).select("query_id", "doc_id", "score", "rank")


@query("ret5_rank_scores", f"with {BM25}, r as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 5) desc, doc_id) - 1 as rank from bm) select query_id, doc_id, rank, 1.0::double / (rank + 1) as score from r where rank < 20")
def ret5(spark, d):
    return R.rank_scores(lexical(spark, d, 20).select("query_id", "doc_id", "score"))


#: The lexical channel of the stated questions: the words of the benchmark's item of each in the documents, by rank.
LEX = f"lex as (select query_id * {EVERY} as query_id, doc_id, 1.0::double / row_number() over (partition by query_id order by round(score, 5) desc, doc_id) as score from bm where query_id * {EVERY} in (select query_id from top) qualify row_number() over (partition by query_id order by round(score, 5) desc, doc_id) <= 20)"


@query("ret6_weighted_fusion", _top(10, f", {BM25}, {LEX}, n as (select query_id, doc_id, round(1 - distance / nullif(max(distance) over (partition by query_id), 0), 6) as score from top), u as (select query_id, doc_id, 0.6 * score as score, 'dense' as c from n union all select query_id, doc_id, 0.4 * score, 'sparse' from lex)") + " select query_id, doc_id, round(sum(score), 6) as score, case when count(distinct c) > 1 then 'hybrid' else min(c) end as channel from u group by 1, 2")
def ret6(spark, d):
    top = hits(spark, d, 10)
    n = R.normalised(top).withColumn("score", F.round("score", 6))
    q = table(spark, d, "embeddings").where(F.col("vec_id") % EVERY == 0).join(table(spark, d, "benchmark"), F.col("item_id") * EVERY == F.col("vec_id")).select(F.col("vec_id").alias("query_id"), "text")
    words = lexical(spark, d, 20, q).select("query_id", "doc_id", "score")
    return R.fuse_weighted([("dense", n, 0.6), ("sparse", R.rank_scores(words), 0.4)]).withColumn("score", F.round("score", 6))


@query("ret7_rank_fusion", _top(30, ", b as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) - 1 as rank from top), u as (select query_id, doc_id, rank - 1 as rank from top union all select * from b)") + " select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from u group by 1, 2")
def ret7(spark, d):
    top = hits(spark, d, 30).withColumn("rank", F.col("rank") - 1)
    other = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) - 1)
    return R.fuse_ranks([top, other]).withColumn("score", F.round("score", 9))


@query("ret8_boosts", _top(10) + " select query_id, doc_id, round((1 - distance) * case when doc_id % 5 = 0 then 10 else 1 end * case when doc_id % 3 = 0 then 0.3 else 1 end, 6) as score from top")
def ret8(spark, d):
    h = hits(spark, d, 10).select("query_id", "doc_id", (1 - F.col("distance")).alias("score"))
    return R.boost(h, [(F.col("doc_id") % 5 == 0, 10.0), (F.col("doc_id") % 3 == 0, 0.3)]).withColumn("score", F.round("score", 6))


@query("ret9_equal_town_boost", _top(10) + " select query_id, doc_id, round((1 - distance) * case when doc_id % 7 = query_id % 7 then 1.5 else 1 end, 6) as score from top")
def ret9(spark, d):
    h = hits(spark, d, 10).select("query_id", "doc_id", (1 - F.col("distance")).alias("score"))
    return R.boost(h, [(F.col("doc_id") % 7 == F.col("query_id") % 7, 1.5)]).withColumn("score", F.round("score", 6))


@query("ret10_rescored", _top(20, ", r as (select query_id, doc_id, doc_id % 97 as score from top)") + " select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from r qualify rank <= 10")
def ret10(spark, d):
    return R.top(hits(spark, d, 20).select("query_id", "doc_id", (F.col("doc_id") % 97).alias("score")), 10)


@query("ret11_collections", f"with {DENSE}, t as (select query_id, label as collection, doc_id, distance, row_number() over (partition by query_id, label order by distance, doc_id) as rank from dist where distance < 0.9 - 0.1 * (label % 2)) select query_id, collection, doc_id, rank from t where rank <= 2")
def ret11(spark, d):
    e = table(spark, d, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("collection"), "embedding")
    # each query once for every collection, which are few, and held against that collection's rows
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding").crossJoin(F.broadcast(docs.select("collection").distinct()))
    asked = q.withColumn("ask", F.concat_ws("|", "query_id", "collection"))
    found = R.dense_top_k(asked, docs, 2, q="ask", same="collection")
    rows = found.join(asked.select("ask", "query_id", "collection"), "ask").where(F.col("distance") < 0.9 - 0.1 * (F.col("collection") % 2))
    return rows.select("query_id", "collection", "doc_id", "rank")


@query("ret12_one_per_town", _top(40) + ", g as (select *, doc_id % 4 as town, row_number() over (partition by query_id, doc_id % 4 order by distance, doc_id) as k from top) select query_id, town, doc_id from g where k = 1")
def ret12(spark, d):
    h = hits(spark, d, 40).withColumn("town", F.col("doc_id") % 4).withColumn("score", -F.col("distance"))
    return R.top(h, 1, ("query_id", "town")).select("query_id", "town", "doc_id")


#: Questions of the stated set: a benchmark item's text and words of some question class; towns that some of them name.
WORDS = (" classement des dimensions", " score moyen", " quelle commune", " les habitants", "")
ASKED = f"""quest as (select vec_id as query_id, coalesce(b.text, '') || ['{"', '".join(WORDS)}'][vec_id // {EVERY} % 5 + 1] as question from embeddings left join benchmark b on b.item_id = vec_id // {EVERY} where vec_id % {EVERY} = 0)"""


def _asked(spark, d):
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").where(v % EVERY == 0).withColumn("item_id", F.floor(v / EVERY))
    words = F.get(F.array(*map(F.lit, WORDS)), (F.col("item_id") % 5).cast("int"))
    return e.join(table(spark, d, "benchmark"), "item_id", "left").select(v.alias("query_id"), "embedding", F.concat(F.coalesce("text", F.lit("")), words).alias("question"), "item_id")


def _by_words(spark, d):
    """Scores of candidates by the words of the benchmark's questions in the documents."""
    asked = table(spark, d, "benchmark").select((F.col("item_id") * EVERY).alias("query_id"), "text")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lambda c: R.bm25(asked, docs, pairs=c).withColumn("score", F.round("score", 5))


def _any_sql(words, folded, c="question"):
    t = f"translate(lower({c}), '{C.ACCENTED}', '{C.FOLDED}')" if folded else f"lower({c})"
    return "(" + " or ".join(f"contains({t}, '{w}')" for w in words) + ")"


FIXED = f"""list_filter([case when {_any_sql(N.DIMENSION_RANKING, True)} or {_any_sql(N.COMPONENTS, False)} then '{N.FIXED_DOCUMENTS["components"]}' end, case when n = 0 and {_any_sql(N.WHOLE, True)} then '{N.FIXED_DOCUMENTS["whole"]}' end,
  case when {_any_sql(N.RANKING, False)} then '{N.FIXED_DOCUMENTS["ranking"]}' end, '{N.FIXED_DOCUMENTS["method"]}'], lambda x: x is not null)"""


@query("ret12_indicator_search", f"""with {BM25}, {DENSE}, {ASKED}, towns as (select query_id, unnest(case query_id // {EVERY} % 3 when 1 then ['T1'] when 2 then ['T0', 'T3'] else [] end) as town from quest),
counted as (select query_id, question, (select count(*) from towns t where t.query_id = a.query_id) as n from quest a),
hits as (select c.query_id, town, n, doc_id, distance, row_number() over (partition by c.query_id, town order by distance, doc_id) as rank from counted c left join towns t on t.query_id = c.query_id join dist on dist.query_id = c.query_id and (town is null or town = 'T' || label % 4)),
words as (select h.*, row_number() over (partition by h.query_id order by coalesce(round(score, 5), 0) desc, rank) as words from hits h left join bm on bm.query_id * {EVERY} = h.query_id and bm.doc_id = h.doc_id where n <= 1 and rank <= 6),
near as (select query_id, doc_id, distance, row_number() over (partition by query_id order by 1.0::double / (59 + rank) + 1.0::double / (59 + words) desc, rank) as nr from words),
f as (select query_id, {FIXED} as ids from counted),
u as (select query_id, 'fixed' as part, generate_subscripts(ids, 1) as nr, unnest(ids) as doc, 0.0::double as distance from f union all select query_id, 'near', nr, doc_id::varchar, distance from near where nr <= 2
  union all select query_id, 'town', row_number() over (partition by query_id order by town), doc_id::varchar, distance from hits where n > 1 and rank = 1)
select query_id, row_number() over (partition by query_id order by part <> 'fixed', nr) as rank, part, doc, round(distance, 6) as distance from u""")
def ret12_search(spark, d):
    q = _asked(spark, d)
    e = table(spark, d, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("T"), (F.col("label") % 4).cast("string")).alias("town"), "embedding")
    names = F.when(F.col("item_id") % 3 == 1, F.array(F.lit("T1"))).when(F.col("item_id") % 3 == 2, F.array(F.lit("T0"), F.lit("T3")))
    towns = q.select("query_id", F.explode(names).alias("town"))
    return R.indicator_search(q, towns, docs, N.indicator_documents, _by_words(spark, d), 3).withColumn("distance", F.round("distance", 6))


#: The views of a group's members, by family: order, dimensions, and least size; towns whose names match the last part have none.
FAMILIES = {
    "summary": (N.VIEWS["verbatims"], lambda v: N.LEAST["verbatims"], "[34]$"),
    "survey": ({v: {**N.VIEWS["survey"], **N.VIEWS["survey_dimensions"]}[v] for v in N.SURVEY_ORDER}, lambda v: N.LEAST["survey_dimensions" if v in N.VIEWS["survey_dimensions"] else "survey"], "3$"),
}


def _members_sql():
    rows = []
    for part, (views, least, end) in FAMILIES.items():
        for i, (v, ds) in enumerate(views.items()):
            cols = ", ".join(ds)
            on = " and ".join(f"m.{c} = v.{c}" for c in ds)
            name = f"'{v}|' || " + " || '|' || ".join(f"v.{c}" for c in ds)
            rows.append(f"select query_id, m.commune as town, '{part}' as part, {i} as nr, {name} as doc from m join (select {cols} from survey where not regexp_matches(commune, '{end}') group by {cols} having count(*) >= {least(v)}) v on {on}")
    return " union all ".join(rows)


@query("ret13_group_search", f"""with {SURVEY}, {DENSE}, {ASKED}, g as (select query_id, question, {_any_sql(N.QUALITY, True)} as quality, r_name as epci, case when query_id // {EVERY} % 7 = 5 then '25-34' end as age_range, case when query_id // {EVERY} % 4 = 3 then 'BUILDING' end as profession, case when query_id // {EVERY} % 10 = 3 then 'D3' end as dimension from quest join region on r_regionkey = query_id // {EVERY} % 5),
m as (select query_id, commune, age_range, profession, dimension from g join geography using (epci) where quality), tries as ({_members_sql()}),
picked as (select * from tries qualify row_number() over (partition by query_id, town, part order by nr) = 1),
has as (select query_id, town, row_number() over (partition by query_id order by town) as place from (select distinct query_id, town from picked) qualify place <= 5),
cover as (select m.query_id, commune as town, place from m left join has h on h.query_id = m.query_id and h.town = m.commune),
best as (select g.query_id, n_name as town, doc_id, distance, row_number() over (partition by g.query_id, n_name order by distance, doc_id) as k from g join geography t on t.epci = g.epci join nation on n_name = t.commune join dist on dist.query_id = g.query_id and doc_id % 25 = nation.n_nationkey),
f as (select query_id, {FIXED} as ids from (select query_id, question, 5 as n from g)),
i as (select query_id, len(ids) + row_number() over (partition by query_id order by town) as place, doc_id, distance from best join f using (query_id) where k = 1)
select query_id, 'parent' as part, 0 as place, null as town, 'epci_' || epci as doc from g union all select query_id, part, place, town, doc from picked join has using (query_id, town)
union all select query_id, 'note', 0, null, count(place) || '/' || count(*) from cover group by 1 having count(place) < count(*) union all select query_id, 'without', row_number() over (partition by query_id order by town), town, null from cover where place is null
union all select query_id, 'indicator', generate_subscripts(ids, 1), null, unnest(ids) from f union all select query_id, 'indicator', place, null, doc_id::varchar from i qualify row_number() over (partition by query_id order by distance, place) <= 3""")
def ret13_search(spark, d):
    region, s, g = table(spark, d, "region"), survey(spark, d), geography(spark, d)
    k = F.col("item_id")
    q = _asked(spark, d).join(F.broadcast(region), F.col("r_regionkey") == k % 5).withColumnRenamed("r_name", "epci").withColumns({
        "asks_quality": N.asks_quality(F.col("question")), "age_range": F.when(k % 7 == 5, "25-34"), "profession": F.when(k % 4 == 3, "BUILDING"), "dimension": F.when(k % 10 == 3, "D3"),
    })
    families = []
    for part, (order, least, end) in FAMILIES.items():
        of = s.where(~F.col("commune").rlike(end))
        views = None
        for n in sorted({least(v) for v in order}):
            some = V.materialise(of, {v: ds for v, ds in order.items() if least(v) == n}, [], n)
            views = some if views is None else views.unionByName(some)
        families.append((part, views.select("view_name", "dim1_value", "dim2_value", F.concat_ws("|", "view_name", "dim1_value", "dim2_value").alias("doc")), order))
    towns = q.join(g, "epci").select("query_id", F.col("commune").alias("town"))
    places = g.select(F.col("commune").alias("town"), "n_nationkey")
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(F.broadcast(places), F.col("doc_id") % 25 == F.col("n_nationkey")).drop("n_nationkey")
    found = R.indicator_search(q, towns, docs, N.indicator_documents, _by_words(spark, d), 3)
    parents = region.select(F.col("r_name").alias("epci"), F.concat(F.lit("epci_"), "r_name").alias("doc"))
    return R.group_search(q, g, parents, families, found)


@query("ret13_group_members", f"with {SURVEY}, n as (select commune, count(*) as n from survey group by 1) select epci, commune, n, row_number() over (partition by epci order by n desc, commune) as rank, count(n) over (partition by epci) as n_with_data from geography left join n using (commune) qualify rank <= 5")
def ret13(spark, d):
    n = survey(spark, d).groupBy("commune").agg(F.count("*").alias("n"))
    g = geography(spark, d).select("epci", "commune").join(n, "commune", "left")
    g = g.withColumn("n_with_data", F.count("n").over(Window.partitionBy("epci")))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("epci").orderBy(F.col("n").desc_nulls_last(), "commune"))).where("rank <= 5").select("epci", "commune", "n", "rank", "n_with_data")


@query("ret14_view_per_town", f"with {SURVEY}, v as (select commune, count(*) as n from survey group by 1) select respondent_id, t as commune, n from (select respondent_id, unnest([commune, 'NATION_1']) as t from survey) join v on v.commune = t")
def ret14(spark, d):
    s = survey(spark, d)
    views = V.materialise(s, {"by_commune": ["commune"]}, []).select(F.col("dim1_value").alias("commune"), "n")
    q = s.select("respondent_id", F.explode(F.array(F.col("commune"), F.lit("NATION_1"))).alias("commune"))
    return q.join(views, "commune").select("respondent_id", "commune", "n")


#: Documents, their sources and languages as a graph; the nodes of a question are the three documents that share the best words with it.
HOPS, RESTART, FRONTIER, FAN = 2, 0.15, 50, 20
GRAPH = """edge as (select 'doc:' || doc_id as a, 'source:' || source as b, 1.0::double as w from documents where source is not null union all select 'doc:' || doc_id, 'lang:' || lang, 0.5 from documents where lang is not null),
edges as (select a as src, b as dst, w from edge union all select b, a, w from edge)"""
SEEDS = f"{BM25}, best as (select query_id, doc_id, round(score, 5) as score, row_number() over (partition by query_id order by round(score, 5) desc, 'doc:' || doc_id) as rank from bm qualify rank <= 3)"


def _walk_sql():
    """The hops written out one by one."""
    sql = f"""{GRAPH}, {SEEDS}, way as (select src, dst, w / sum(w) over (partition by src) as share from (select *, row_number() over (partition by src order by w desc, dst) as n from edges) where n <= {FAN}),
p0 as (select query_id * {EVERY} as query_id, 'doc:' || doc_id as node, round(score / sum(score) over (partition by query_id), 12) as weight from best where score > 0)"""
    for k in range(1, HOPS + 1):
        sql += f""", p{k} as (select query_id, node, round(sum(weight), 12) as weight from (select query_id, dst as node, weight * share * {1 - RESTART} as weight from p{k - 1} join way on src = node union all select query_id, node, weight * {RESTART} from p0) group by 1, 2
qualify row_number() over (partition by query_id order by round(sum(weight), 12) desc, node) <= {FRONTIER})"""
    return sql + f""", graph as (select query_id, split_part(node, ':', 2)::bigint as doc_id, round(weight / max(weight) over (partition by query_id), 12) as score from p{HOPS} where starts_with(node, 'doc:')),
gtop as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from graph qualify rank <= 10)"""


def document_graph(spark, d):
    """(documents (node, doc_id, text), edges (src, rel, dst, weight))."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node"), "doc_id", "text", "source", "lang")
    edge = lambda c, w: docs.where(F.col(c).isNotNull()).select(F.col("node").alias("src"), F.lit(c).alias("rel"), F.concat(F.lit(f"{c}:"), c).alias("dst"), F.lit(w).alias("weight"))
    return docs, edge("source", 1.0).unionByName(edge("lang", 0.5))


def question_nodes(spark, d, k):
    docs, edges = document_graph(spark, d)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return K.search_nodes(questions, docs.select(F.col("node").alias("uri"), "text"), edges, k, fields=("text",))


def graph_channel(spark, d, k=10):
    """The best documents of each question by the walk; question i asks with vector i * EVERY too."""
    docs, edges = document_graph(spark, d)
    e = edges.select("src", "dst", "weight")
    seeds = question_nodes(spark, d, 3).select((F.col("query_id") * EVERY).alias("query_id"), F.col("uri").alias("node"), "weight")
    at = K.walk(seeds, e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), hops=HOPS, restart=RESTART, frontier=FRONTIER, fan=FAN)
    return K.graph_hits(at, docs, k)


@query("gra8_question_nodes", f"with {GRAPH}, {SEEDS}, r as (select src, count(distinct dst) as n from edges group by 1) select query_id, 'doc:' || doc_id as uri, rank, score as weight, coalesce(n, 0)::bigint as n_relations, round(least(1.0, 1 - 0.1 * (rank - 1) + least(0.05 * coalesce(n, 0), 0.2)), 12)::double as score from best left join r on src = 'doc:' || doc_id")
def gra8_questions(spark, d):
    return question_nodes(spark, d, 3)


@query("ret15_graph_walk", f"with {_walk_sql()} select query_id, doc_id, rank, round(score, 6) as score from gtop")
def ret15_walk(spark, d):
    return graph_channel(spark, d).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("ret15_graph_fusion", _top(10, f", {_walk_sql()}, u as (select query_id, doc_id, 0.4 * round(1 - distance, 6) as s from top union all select query_id, doc_id, 0.6 * round(score, 6) from gtop where query_id in (select query_id from top))") + ", f as (select query_id, doc_id, round(sum(s), 6) as score from u group by 1, 2) select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f qualify rank <= 10")
def ret15(spark, d):
    top = hits(spark, d, 10).select("query_id", "doc_id", F.round(1 - F.col("distance"), 6).alias("score"))
    graph = graph_channel(spark, d).join(top.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return R.top(R.fuse_weighted([("vector", top, 0.4), ("graph", graph, 0.6)]).withColumn("score", F.round("score", 6)).drop("channel"), 10)


@query("ret16_concatenated", _top(5, f", {_walk_sql()}, u as (select query_id, doc_id, 'vector' as channel, round(0.4 * (1 - distance), 6) as score from top union all select query_id, doc_id, 'graph', round(0.6 * score, 6) from gtop where query_id in (select query_id from top))") + " select *, row_number() over (partition by query_id order by score desc, doc_id, channel) as rank from u qualify rank <= 4")
def ret16(spark, d):
    top = hits(spark, d, 5).select("query_id", "doc_id", F.lit("vector").alias("channel"), F.round(0.4 * (1 - F.col("distance")), 6).alias("score"))
    graph = graph_channel(spark, d).join(top.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id", F.lit("graph").alias("channel"), F.round(0.6 * F.col("score"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "channel")
    return top.unionByName(graph).withColumn("rank", F.row_number().over(w)).where("rank <= 4")


@query("ret17_sub_questions", f"with {DENSE} select query_id, sub, doc_id from (select query_id, sub, doc_id, row_number() over (partition by query_id, sub order by distance, doc_id) as k from dist, (values (0), (1)) t(sub) where doc_id % 2 = sub) where k <= 3")
def ret17(spark, d):
    parts = [hits(spark, d, 3, F.col("doc_id") % 2 == i).select("query_id", F.lit(i).alias("sub"), "doc_id") for i in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("ret18_evidence_balance", _top(10) + " select query_id, bool_or(doc_id % 3 = 0) as has_subjective, bool_or(doc_id % 3 = 1) as has_objective from top group by 1")
def ret18(spark, d):
    return hits(spark, d, 10).groupBy("query_id").agg(F.bool_or(F.col("doc_id") % 3 == 0).alias("has_subjective"), F.bool_or(F.col("doc_id") % 3 == 1).alias("has_objective"))


#: The sentences of a benchmark item are its sub-questions; each finds five documents by its words.
SUBS = """subs as (select item_id, row_number() over (partition by item_id order by p) as sub, s as text from (select item_id, unnest(ss) as s, unnest(range(0, len(ss))) as p from (select item_id, string_split_regex(text, '[.?!]+\\s*') as ss from benchmark)) where trim(s) <> '')"""
SUB_HITS = f"""{SUBS}, {BM25}, sub_asked as (select distinct item_id, sub, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+')) as term from subs),
sub_bm as (select item_id, sub, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 5) as score from tf join sub_asked using (term) join idf using (term) group by 1, 2, 3),
sub_top as (select item_id as query_id, sub, doc_id, row_number() over (partition by item_id, sub order by score desc, doc_id) as sub_rank from sub_bm qualify sub_rank <= 5)"""


def sub_search(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    pieces = F.filter(F.split("text", r"[.?!]+\s*", -1), lambda s: F.trim(s) != "")
    subs = q.select("query_id", F.posexplode(pieces).alias("at", "text")).select("query_id", (F.col("at") + 1).cast("long").alias("sub"), "text")
    docs = table(spark, d, "documents")
    index = LexicalIndex.build(docs.select("doc_id", "text"), terms=q.select(F.explode(C.words(F.col("text"))).alias("term")))
    rescored = lambda pool: index.score(pool, q).withColumn("score", F.round("score", 5))
    return R.sub_question_search(subs, lambda a: index.search(a, 5, q="ask"), rescored, docs.select("doc_id", "source"), 6)


@query("ret17_sub_question_hits", f"with {SUB_HITS} select * from sub_top")
def ret17_hits(spark, d):
    return sub_search(spark, d)[0]


@query("ret17_pooled", f"with {SUB_HITS}, pool as (select query_id, doc_id, count(distinct sub) as n_subs from sub_top group by 1, 2), sc as (select p.*, coalesce(round(b.score, 5), 0) as score, coalesce(source, '') as source from pool p left join bm b using (query_id, doc_id) join documents using (doc_id)), g as (select *, row_number() over (partition by query_id, source order by score desc, doc_id) as k from sc) select query_id, doc_id, score, n_subs, source, row_number() over (partition by query_id order by k > 3, score desc, doc_id) as rank from g qualify rank <= 6")
def ret17_pooled(spark, d):
    return sub_search(spark, d)[1]


@query("ret18_sub_question_evidence", f"with {SUB_HITS} select query_id, sub, bool_or(contains(source, 'src0') or contains(source, 'src3')) as has_subjective, bool_or(contains(source, 'src1')) as has_objective from sub_top join documents using (doc_id) group by 1, 2")
def ret18_evidence(spark, d):
    found = sub_search(spark, d)[0].join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.evidence_balance(found, F.col("source"), subjective=("src0", "src3"), objective=("src1",))


@query("ret19_relevance_gate", _top(10) + " select query_id, round(greatest(0, least(1, avg(1 - distance))), 6) as relevance, avg(1 - distance) < 0.4 as is_low from top group by 1")
def ret19(spark, d):
    return R.relevance_gate(hits(spark, d, 10), 0.4).withColumn("relevance", F.round("relevance", 6))


@query("ret20_contexts", "select conv_id as query_id, md5(string_agg(left(text, case role when 'user' then 200 else 100 end), chr(10) || chr(10) order by case role when 'user' then 1 else 2 end, turn)) as h from conversations where role in ('user', 'assistant') group by 1")
def ret20(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("type"), F.col("turn").alias("rank"), "text")
    return R.context(c, {"user": 200, "assistant": 100}).select("query_id", F.md5(F.col("context").cast("binary")).alias("h"))


@query("ret21_view_search", f"with {SURVEY} select profession, age_range, count(*) as n from survey where profession = 'BUILDING' group by 1, 2")
def ret21(spark, d):
    v = V.materialise(survey(spark, d), {"job_age": ["profession", "age_range"]}, [])
    return v.where("dim1_value = 'BUILDING'").select(F.col("dim1_value").alias("profession"), F.col("dim2_value").alias("age_range"), "n")


#: Views by age and job; the vector of a view is the mean of its respondents' vectors. Questions name what the customer of the same number has: an age under a balance of 5000, a job over 0.
WIDTH = 64
VIEW_SEARCH = f"""resp as (select age_range, profession, embedding::double[] as v from survey join embeddings on vec_id = person),
cells as (select 'age' as view_name, age_range as dim1_value, null as dim2_value, v from resp where age_range is not null union all select 'job', profession, null, v from resp where profession is not null
union all select 'age_job', age_range, profession, v from resp where age_range is not null and profession is not null),
views as (select concat_ws('|', view_name, dim1_value, dim2_value) as doc, dim1_value, dim2_value, [{", ".join(f"avg(v[{i + 1}])" for i in range(WIDTH))}] as ve from cells group by view_name, dim1_value, dim2_value),
ask as (select vec_id as query_id, embedding::double[] as qe, case when c_acctbal < 5000 then {age_bucket_sql("(c_custkey % 70 + 15)", "survey")} end as age, case when c_acctbal > 0 then c_mktsegment end as job from embeddings left join customer on c_custkey = vec_id where vec_id % {EVERY} = 0)"""


@query("ret21_nearest_views", f"with {SURVEY}, {VIEW_SEARCH} select query_id, doc, row_number() over (partition by query_id order by 1 - list_cosine_similarity(qe, ve), doc) as rank, round(1 - list_cosine_similarity(qe, ve), 6) as distance from ask join views on case when age is not null then dim1_value = age and (job is null or coalesce(dim2_value, '') = job) when job is not null then dim1_value = job else true end qualify rank <= 3")
def ret21_nearest(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    people = survey(spark, d).join(e, F.col("vec_id") == F.col("person"))
    vector = F.array(*(F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(WIDTH))).alias("embedding")
    v = V.materialise(people, {"age": ["age_range"], "job": ["profession"], "age_job": ["age_range", "profession"]}, [vector])
    views = v.select(F.concat_ws("|", "view_name", "dim1_value", "dim2_value").alias("doc"), "dim1_value", "dim2_value", "embedding")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"), F.when(F.col("c_acctbal") < 5000, C.age_bucket(F.col("c_custkey") % 70 + 15, "survey")).alias("age_range"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("profession"))
    asked = e.where(F.col("vec_id") % EVERY == 0).join(c, "vec_id", "left").withColumnRenamed("vec_id", "query_id")
    return R.view_search(asked, views, 3).withColumn("distance", F.round("distance", 6))


@query("win10_source_diversity", _top(20, ", g as (select query_id, doc_id, doc_id % 3 as source, round(1 - distance, 9) as score from top), k as (select *, row_number() over (partition by query_id, source order by score desc, doc_id) as k from g)") + " select query_id, doc_id, row_number() over (partition by query_id order by k > 3, score desc, doc_id) as rank from k qualify rank <= 10")
def win10(spark, d):
    h = hits(spark, d, 20).select("query_id", "doc_id", (F.col("doc_id") % 3).alias("source"), F.round(1 - F.col("distance"), 9).alias("score"))
    return R.diverse(h, 10).select("query_id", "doc_id", "rank")


@query("flt2_post_filter", _top(10) + " select query_id, doc_id from top where doc_id % 2 = 0")
def flt2(spark, d):
    return hits(spark, d, 10).where("doc_id % 2 = 0").select("query_id", "doc_id")


@query("flt8_cutoff", _top(10) + " select query_id, doc_id from top where 1 - distance >= 0.5")
def flt8(spark, d):
    return hits(spark, d, 10).where(1 - F.col("distance") >= 0.5).select("query_id", "doc_id")


@query("udf1_user_rescore", _top(10) + " select query_id, doc_id, (doc_id * 2 + 1)::double as score from top")
def udf1(spark, d):
    @F.pandas_udf("double")
    def user(v: pd.Series) -> pd.Series:
        return v * 2.0 + 1

    return hits(spark, d, 10).select("query_id", "doc_id", user("doc_id").alias("score"))


def _lengths():
    """A stand-in for a model: what it gives for a list of texts."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("udf1_model_vectors", "select doc_id, length(text)::double as n_chars, (length(text) - length(replace(text, ' ', '')))::double as n_blanks from documents")
def udf1_vectors(spark, d):
    v = M.with_model(table(spark, d, "documents").select("doc_id", "text"), "text", _lengths, "v", "array<double>")
    return v.select("doc_id", F.col("v")[0].alias("n_chars"), F.col("v")[1].alias("n_blanks"))


@query("udf1_view_summaries", """with cells as (select 'all' as view_name, null as dim1_value, null as dim2_value, text from documents union all select 'by_lang', lang, null, text from documents where lang is not null
union all select 'by_both', lang, source, text from documents where lang is not null and source is not null),
best as (select view_name, dim1_value, dim2_value, text, count(*) as n, row_number() over (partition by view_name, dim1_value, dim2_value order by length(text) desc, text) as k from cells where text is not null group by 1, 2, 3, 4),
s as (select view_name, dim1_value, dim2_value, sum(n)::bigint as n, coalesce(string_agg(left(text, 80), ' | ' order by k) filter (where k <= 3), '') as t from best group by 1, 2, 3)
select view_name, dim1_value, dim2_value, n || ' textes : ' || t as summary from s""")
def udf1_summaries(spark, d):
    return M.view_summaries(table(spark, d, "documents"), {"all": [], "by_lang": ["lang"], "by_both": ["lang", "source"]}, "text", lambda: M.Longest(unit="textes"))
