"""Documents of towns, rankings of parts, best and worst, fallbacks and searches over several collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kadastra.operators import retrieval as R
from kadastra.operators import survey as S
from kadastra.operators import views as V
from kadastra.plans.registry import query
from kadastra.plans.retrieval_queries import DENSE, EVERY
from kadastra.plans.stand_ins import INDICATORS, SURVEY, indicators, scored, survey, table

W = f"with {SURVEY}"


@query("prj5_verbatim_sentences", f"{W} select respondent_id, 'Verbatim de ' || concat_ws(', ', genre, case when respondent_id % 4 <> 0 then age || ' ans' end, '(' || age_range || ')', profession, 'à ' || commune) || coalesce(' sur le thème ' || case when respondent_id % 3 <> 0 then dimension end, '') || ' : ' || label as sentence from survey")
def prj5(spark, d):
    s = survey(spark, d).withColumns({"age": F.when(F.col("respondent_id") % 4 != 0, F.col("age")), "dimension": F.when(F.col("respondent_id") % 3 != 0, F.col("dimension"))})
    return S.verbatim_sentences(s, "label").select("respondent_id", "sentence")


@query("prj7_town_documents", f"""{W}, base as (select commune, count(*) as n, avg(happiness) as h, avg(life_quality) as l, avg(score) as s from scored group by 1),
dims as (select commune, string_agg(dimension || '=' || printf('%.2f', floor(m * 100 + 0.5) / 100), ', ' order by dimension) as dims from (select commune, dimension, avg(score) as m from scored group by 1, 2) group by 1),
picks as (select commune, unnest(string_split(choices, ';')) as choice from survey), c as (select commune, choice, count(*) as k from picks group by 1, 2),
cited as (select commune, string_agg(choice, ', ' order by r) as cited from (select *, row_number() over (partition by commune order by k desc, choice) as r from c) where r <= 3 group by 1)
select commune, n, 'Scores of ' || commune || ' (' || n || ' respondents). Mean happiness: ' || printf('%.2f', floor(h * 100 + 0.5) / 100) || '/5. Mean life quality: ' || printf('%.2f', floor(l * 100 + 0.5) / 100) || '/5. Mean confidence: ' || printf('%.2f', floor(s * 100 + 0.5) / 100)
  || '/5. By dimension: ' || dims || '. Most cited: ' || cited || '.' as doc from base join dims using (commune) join cited using (commune)""")
def prj7(spark, d):
    s = scored(spark, d)
    return S.town_documents(s, S.dimension_scores(s, ["commune", "dimension"]), "commune", [("happiness", "happiness"), ("life quality", "life_quality"), ("confidence", "score")], "choices")


@query("agg21_top3_by_job", f"{W}, c as (select age_range, profession, dimension, count(*) as n from survey group by 1, 2, 3 having count(*) >= 3) select *, row_number() over (partition by age_range, profession order by n desc, dimension) as rank from c qualify rank <= 3")
def agg21_job(spark, d):
    c = survey(spark, d).groupBy("age_range", "profession", "dimension").agg(F.count("*").alias("n")).where("n >= 3")
    return S.top_per(c, ["age_range", "profession"], [F.col("n").desc(), F.col("dimension")], 3)


@query("agg22_epci_members", f"with {INDICATORS} select epci, zone, total, row_number() over (partition by epci order by zone) as place, round(avg(total) over (partition by epci), 4) as avg_total from indicators where epci is not null")
def agg22_members(spark, d):
    # members are rows: a list inside the group's row would grow with it
    i = indicators(spark, d).where("epci is not null").select("epci", "zone", "total")
    means = i.groupBy("epci").agg(F.round(F.avg("total"), 4).alias("avg_total"))
    return i.withColumn("place", F.row_number().over(Window.partitionBy("epci").orderBy("zone"))).join(means, "epci")


@query("agg23_component_ranking", f"with {INDICATORS}, m as (select unnest(['opp', 'cho', 'vec']) as component, unnest([avg(opp), avg(cho), avg(vec)]) as mean from indicators) select component, mean, row_number() over (order by mean desc, component) as place from m")
def agg23_components(spark, d):
    names = ("opp", "cho", "vec")
    means = indicators(spark, d).agg(*(F.avg(c).alias(c) for c in names))
    rows = means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("mean")) for c in names))).alias("x")).select("x.*")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").desc(), "component")))  # three rows


@query("agg28_uncertain_sample", f"{W} select respondent_id, commune, left(label, 80) as verbatim, choices as available, dimension as matched from survey where respondent_id % 4 = 0 order by respondent_id limit 20")
def agg28_sample(spark, d):
    u = survey(spark, d).where("respondent_id % 4 = 0").orderBy("respondent_id").limit(20)  # the report shows twenty
    return u.select("respondent_id", "commune", F.substring("label", 1, 80).alias("verbatim"), F.col("choices").alias("available"), F.col("dimension").alias("matched"))


@query("col6_best_and_worst", f"with {INDICATORS} select * from (select 'best' as side, zone, total, row_number() over (order by total desc, zone) as place from indicators order by place limit 5) union all select * from (select 'worst', zone, total, row_number() over (order by total, zone) as place from indicators order by place limit 5)")
def col6_ends(spark, d):
    i = indicators(spark, d).select("zone", "total")
    # each side is cut to five by partition before anything is ranked
    ends = [(side, o, i.orderBy(*o).limit(5)) for side, o in (("best", [F.col("total").desc(), F.col("zone")]), ("worst", [F.col("total"), F.col("zone")]))]
    parts = [x.select(F.lit(side).alias("side"), "zone", "total", F.row_number().over(Window.orderBy(*o)).alias("place")) for side, o, x in ends]
    return parts[0].unionByName(parts[1])


NEAR = f"""{DENSE.replace('from q, e)', 'from q, e where doc_id <> query_id)')},
qs as (select vec_id as q, case when vec_id % 300 = 0 then null when vec_id % 200 = 0 then 'T' || (label + 5) else 'T' || label end as town from embeddings where vec_id % {EVERY} = 0),
nearest as (select query_id as q, doc_id as doc, case when label % 2 = 0 then 'T' || label end as town, distance from dist qualify row_number() over (partition by query_id order by distance, doc_id) = 1)"""


def _near(spark, d):
    e = table(spark, d, "embeddings")
    town = lambda c: F.concat(F.lit("T"), c.cast("string"))
    qs = e.where(F.col("vec_id") % EVERY == 0)
    name = F.when(F.col("vec_id") % 300 == 0, None).when(F.col("vec_id") % 200 == 0, town(F.col("label") + 5)).otherwise(town(F.col("label")))
    docs = e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    # two hits, as the nearest may be the query's own row
    own = F.col("doc_id") == F.col("query_id")
    hits = R.dense_top_k(qs.select(F.col("vec_id").alias("query_id"), "embedding"), docs, 2).where(~own)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))).where("rank = 1")
    nearest = hits.join(docs.select("doc_id", "label"), "doc_id").select(F.col("query_id").alias("q"), F.col("doc_id").alias("doc"), F.when(F.col("label") % 2 == 0, town(F.col("label"))).alias("town"), "distance")
    exact = docs.where("label < 4").select(town(F.col("label")).alias("town"), F.col("doc_id").alias("doc"))
    return qs.select(F.col("vec_id").alias("q"), name.alias("town")), exact, nearest, docs.agg(F.min("doc_id").alias("doc"))


@query("win8_view_fallback", f"with {NEAR}, exact as (select 'T' || label as town, min(vec_id) as doc from embeddings where label < 4 group by 1), a as (select q, doc, 1 as tier from qs join exact using (town) union all select q, doc, 2 from nearest where distance <= 0.6 union all select q, (select min(vec_id) from embeddings), 3 from qs) select q, doc, tier from a qualify row_number() over (partition by q order by tier) = 1")
def win8_fallback(spark, d):
    return V.fallback_view(*_near(spark, d))


@query("win8_strict_fallback", f"with {NEAR} select qs.q, n.doc, case when n.doc is not null then 2 end as tier from qs left join (select nearest.* from nearest join qs on qs.q = nearest.q where distance <= 0.55 and (nearest.town is null or nearest.town = qs.town)) n on n.q = qs.q")
def win8_strict(spark, d):
    return V.fallback_view(*_near(spark, d), reach=0.55, strict=True)


#: Three collections of the embeddings: one with a raised threshold, one held to the question's town, one plain.
COLLECTIONS = [R.Collection("c0", 0.55, ("interview",), 0.8), R.Collection("c1", 0.5, same="town", forced=1.5), R.Collection("c2", 0.75, k=1)]


def _searched_sql():
    parts = []
    for c in COLLECTIONS:
        n = c.k or 2
        limit = f"case when query_id % 200 = 0 then {c.raised} else {c.threshold} end" if c.raised else f"case when query_id % 300 = 0 then {c.forced} else {c.threshold} end" if c.same else str(c.threshold)
        town = "and (query_id % 300 <> 0 or doc_id % 4 = query_id // 100 % 4)" if c.same else ""
        parts.append(f"""select query_id, '{c.name}' as collection, doc_id, round(distance, 6) as distance, place as rank from (select *, row_number() over (partition by query_id order by 1.0::double / (59 + rank) + 1.0::double / (59 + words) desc, rank) as place from
  (select *, row_number() over (partition by query_id order by (doc_id * 7 + query_id) % 13 desc, rank) as words from (select *, row_number() over (partition by query_id order by distance, doc_id) as rank from dist where label % 3 = {c.name[1:]} {town}) where rank <= {n * 3})) where place <= {n} and distance <= {limit}""")
    return f"with {DENSE} " + " union all ".join(parts)


@query("ret11_search_collections", _searched_sql())
def ret11_search(spark, d):
    e = table(spark, d, "embeddings")
    v = F.col("vec_id")
    town = lambda c: F.concat(F.lit("T"), (c % 4).cast("string"))
    queries = e.where(v % EVERY == 0).select(v.alias("query_id"), "embedding", F.when(v % 200 == 0, "an Interview here").otherwise("other").alias("question"), F.when(v % 300 == 0, town(F.floor(v / 100))).alias("town"))
    docs = e.select(v.alias("doc_id"), "embedding", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("collection"), town(v).alias("town"))
    words = lambda c: c.withColumn("score", ((F.col("doc_id") * 7 + F.col("query_id")) % 13).cast("double"))
    return R.search_collections(queries, docs, COLLECTIONS, words, 2).withColumn("distance", F.round("distance", 6))
