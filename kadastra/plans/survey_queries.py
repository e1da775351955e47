"""Survey tables: AGG, PRJ, FLT, JOIN and WIN of the inventory on the stand-in survey."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kadastra.functions import columns as C
from kadastra.functions import scales as N
from kadastra.operators import survey as S
from kadastra.operators import views as V
from kadastra.operators.ranking import group_medians
from kadastra.plans.registry import query
from kadastra.plans.stand_ins import INDICATORS, SURVEY, geography, indicators, likert, scored, survey, table

W = f"with {SURVEY}"


@query("agg1_choice_shares", f"""{W}, picks as (select commune, trim(unnest(string_split(choices, ';'))) as choice from survey), total as (select commune, count(*) as n_total from survey group by 1)
select commune, choice, count(*) as n, any_value(n_total) as n_total, count(*) * 100.0::double / any_value(n_total) as pct from picks join total using (commune) where choice <> '' group by commune, choice""")
def agg1(spark, d):
    return S.choice_shares(survey(spark, d), "commune", "choices")


@query("agg2_commune_means", f"{W} select commune, avg(happiness) as avg_happiness, avg(life_quality) as avg_life_quality, avg(age) as avg_age from survey group by 1")
def agg2(spark, d):
    return S.means(survey(spark, d), "commune", ["happiness", "life_quality", "age"])


@query("agg3_ordinal_columns", """select 'label' as column_name, 'five' as scale where (select bool_and(o_orderpriority in ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')) from orders)
union all select 'status', 'three' where (select bool_and(o_orderstatus in ('F','O','P')) from orders)""")
def agg3(spark, d):
    found = S.ordinal_columns(survey(spark, d).select("label", "status", "commune", "profession"), {"five": {r: 6 - int(r[0]) for r in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}, "three": {"F": 1, "O": 2, "P": 3}})
    # the driver holds names of columns only, as many as the schema has
    return spark.createDataFrame(sorted(found.items()), "column_name string, scale string")


@query("agg4_long_verbatims", f"{W}, l as (select respondent_id, commune, unnest([1, 2, 3]) as choice_no, trim(unnest([label, profession, case when respondent_id % 3 = 0 then 'nan' else genre end])) as verbatim from survey) select * from l where verbatim <> '' and lower(verbatim) <> 'nan'")
def agg4(spark, d):
    s = survey(spark, d).withColumn("third", F.when(F.col("respondent_id") % 3 == 0, "nan").otherwise(F.col("genre")))
    return S.long_texts(s, ["respondent_id", "commune"], ["label", "profession", "third"])


@query("agg5_dimension_scores", f"{W} select commune, dimension, count(score) as n, avg(score) as avg_score from scored group by 1, 2 having count(score) >= 1")
def agg5(spark, d):
    return S.dimension_scores(scored(spark, d), ["commune", "dimension"])


@query("agg6_mean_of_means", f"{W}, by_dim as (select commune, dimension, avg(score)::decimal(20,10) as m, count_if(score=1) s1, count_if(score=2) s2, count_if(score=3) s3, count_if(score=4) s4, count_if(score=5) s5 from scored group by 1, 2) select commune, round(sum(m)::double / count(m), 6) as mean_of_means, sum(s1)::bigint as s1, sum(s2)::bigint as s2, sum(s3)::bigint as s3, sum(s4)::bigint as s4, sum(s5)::bigint as s5 from by_dim group by 1")
def agg6(spark, d):
    m = S.mean_of_means(scored(spark, d), "commune", "dimension")
    return m.select("commune", F.round(F.col("total").cast("double") / F.col("parts"), 6).alias("mean_of_means"), *(f"s{k}" for k in range(1, 6)))


@query("agg7_soft_labels", f"{W}, soft as (select respondent_id, case when label = '3-MEDIUM' then 'Moyennement satisfait' else label end as label from survey) select s.label, coalesce(score, case when contains(lower(s.label), 'moyennement') then 3 end) as value, count(*) as n from soft s left join likert using (label) group by 1, 2")
def agg7(spark, d):
    s = survey(spark, d).withColumn("label", F.when(F.col("label") == "3-MEDIUM", "Moyennement satisfait").otherwise(F.col("label")))
    return S.encode_labels(s, likert(spark)).withColumn("value", S.soft_label(F.col("label"), F.col("score"))).groupBy("label", "value").agg(F.count("*").alias("n"))


@query("agg8_commune_global", f"{W}, dims as (select commune, dimension, round(avg(score), 2) as m, count(*) as n from scored group by 1, 2), g as (select commune, avg(m) as global_score from dims group by 1) select commune, round(global_score, 4) as global_score, round((avg(happiness) + avg(life_quality)) / 2, 6) as wellbeing, count(*) as n from survey join g using (commune) group by commune, global_score having count(*) >= 3")
def agg8(spark, d):
    s = scored(spark, d)
    dims = s.groupBy("commune", "dimension").agg(F.round(F.avg("score"), 2).alias("m"))
    g = dims.groupBy("commune").agg(F.round(F.avg("m"), 4).alias("global_score"))
    w = s.groupBy("commune").agg(F.round((F.avg("happiness") + F.avg("life_quality")) / 2, 6).alias("wellbeing"), F.count("*").alias("n")).where("n >= 3")
    return w.join(g, "commune")


VIEWS = {"by_age": ["age_range"], "by_job": ["profession"], "by_commune": ["commune"], "by_dim": ["dimension"], "age_job": ["age_range", "profession"], "age_commune": ["age_range", "commune"], "age_dim": ["age_range", "dimension"], "job_commune": ["profession", "commune"], "job_dim": ["profession", "dimension"], "commune_dim": ["commune", "dimension"]}


def _views_sql(views, least, aggs="count(*) as n, avg(score) as avg_score", exempt=()):
    parts = []
    for v, ds in views.items():
        one, two = (f"'{x}', {x}" if x else "null, null" for x in [*ds, None, None][:2])
        where = " and ".join(f"{x} is not null and trim({x}) not in ('', 'nan')" for x in ds) or "true"
        group = f"group by {', '.join(ds)}" if ds else ""
        having = "" if v in exempt else f"having count(*) >= {least}"
        parts.append(f"select '{v}' as view_name, {len(ds)} as specificity, {one.split(', ')[0]} as dim1_name, {one.split(', ')[1]} as dim1_value, {two.split(', ')[0]} as dim2_name, {two.split(', ')[1]} as dim2_value, {aggs} from scored where {where} {group} {having}")
    return f"{W} " + " union all ".join(parts)


@query("agg9_verbatim_views", _views_sql(VIEWS, 3, "count(*) as n, count(distinct person) as n_persons"))
def agg9(spark, d):
    return V.materialise(survey(spark, d), VIEWS, [F.count_distinct("person").alias("n_persons")], 3)


@query("agg9_view_lineage", f"{W} select 'by_commune' as view_name, commune as dim1_value, null::varchar as dim2_value, respondent_id from survey union all select 'age_job', age_range, profession, respondent_id from survey")
def agg9_lineage(spark, d):
    return V.lineage(survey(spark, d), {"by_commune": ["commune"], "age_job": ["age_range", "profession"]}, "respondent_id")


QUANTI = {k: VIEWS[k] for k in ("by_age", "by_job", "by_commune", "age_job", "age_commune", "job_commune")}


@query("agg10_quantitative_views", _views_sql(QUANTI, 5))
def agg10(spark, d):
    return V.materialise(scored(spark, d), QUANTI, [F.avg("score").alias("avg_score")], 5)


SURVEY_VIEWS = {"all": [], **QUANTI}


@query("agg11_survey_views", _views_sql(SURVEY_VIEWS, 2, exempt=("all",)))
def agg11(spark, d):
    return V.materialise(scored(spark, d), SURVEY_VIEWS, [F.avg("score").alias("avg_score")], 2, exempt=["all"])


#: The survey's own names of two dimensions, and the public ones.
PUBLIC = {"cat_age": "age_range", "csp": "profession"}


@query("agg11_renamed_views", _views_sql({k: v for k, v in N.VIEWS["survey"].items()}, N.LEAST["survey"], "count(*) as n", exempt=("enquete_global",)))
def agg11_renamed(spark, d):
    own = {public: name for name, public in PUBLIC.items()}
    views = {k: [own.get(c, c) for c in v] for k, v in N.VIEWS["survey"].items()}
    s = survey(spark, d).withColumnsRenamed(own)
    return V.materialise(s, views, [], N.LEAST["survey"], exempt=["enquete_global"], rename=PUBLIC)


@query("agg11_interview_views", f"with c as (select case when conv_id % 10 = 9 then ' ' else 'C' || (conv_id % 40) end as commune, length(text) as size from conversations) select 'entretien_commune' as view_name, 1 as specificity, 'commune' as dim1_name, commune as dim1_value, null as dim2_name, null as dim2_value, count(*) as n, sum(size)::bigint as n_chars from c where commune <> ' ' group by commune having count(*) >= {N.LEAST['interviews']}")
def agg11_interviews(spark, d):
    k = F.col("conv_id")
    c = table(spark, d, "conversations").select(F.when(k % 10 == 9, " ").otherwise(F.concat(F.lit("C"), (k % 40).cast("string"))).alias("commune"), F.char_length("text").alias("size"))
    return V.materialise(c, N.VIEWS["interviews"], [F.sum("size").alias("n_chars")], N.LEAST["interviews"])


DIM_VIEWS = {"dim": ["dimension"], "dim_commune": ["dimension", "commune"], "dim_age": ["dimension", "age_range"], "dim_job": ["dimension", "profession"]}


@query("agg12_dimension_views", _views_sql(DIM_VIEWS, 3))
def agg12(spark, d):
    return V.materialise(scored(spark, d), DIM_VIEWS, [F.avg("score").alias("avg_score")], 3)


@query("agg13_group_summary", f"""{W}, base as (select commune, count(*) as n, avg(happiness) as avg_happiness, avg(life_quality) as avg_life_quality from survey group by 1),
picks as (select commune, unnest(string_split(choices, ';')) as choice from survey), c as (select commune, choice, count(*) as k from picks where len(choice) > 2 and not starts_with(choice, 'Option') group by 1, 2),
top8 as (select commune, string_agg(choice, ',' order by k desc, choice) as cited from (select *, row_number() over (partition by commune order by k desc, choice) as r from c) where r <= 8 group by 1),
dims as (select commune, dimension, avg(score) as m from scored group by 1, 2),
bands as (select commune, coalesce(string_agg(dimension, ',' order by m desc, dimension) filter (where m >= 3.1), '') as strong, coalesce(string_agg(dimension, ',' order by m desc, dimension) filter (where m <= 2.9), '') as weak from dims group by 1)
select * from base join top8 using (commune) join bands using (commune)""")
def agg13(spark, d):
    s = scored(spark, d)
    base = s.groupBy("commune").agg(F.count("*").alias("n"), F.avg("happiness").alias("avg_happiness"), F.avg("life_quality").alias("avg_life_quality"))
    picks = S.choice_shares(s, "commune", "choices").where("char_length(choice) > 2 and not startswith(choice, 'Option')")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), ",")
    cited = S.top_per(picks, ["commune"], [F.col("n").desc(), F.col("choice")], 8).groupBy("commune").agg(listed(F.struct("rank", F.col("choice").alias("v"))).alias("cited"))
    dims = S.dimension_scores(s, ["commune", "dimension"])
    pair = F.struct((-F.col("avg_score")).alias("o"), F.col("dimension").alias("v"))
    bands = dims.groupBy("commune").agg(listed(F.when(F.col("avg_score") >= 3.1, pair)).alias("strong"), listed(F.when(F.col("avg_score") <= 2.9, pair)).alias("weak"))
    return base.join(cited, "commune").join(bands, "commune")


@query("agg14_persons", f"{W} select commune, count(distinct coalesce(case when respondent_id % 2 = 0 then respondent_id::varchar end, concat_ws('|', commune, age::varchar, genre, profession))) as n_persons from survey group by 1")
def agg14(spark, d):
    s = survey(spark, d).withColumn("qid", F.when(F.col("respondent_id") % 2 == 0, F.col("respondent_id")))
    return s.groupBy("commune").agg(V.persons("qid", ["commune", "age", "genre", "profession"]).alias("n_persons"))


@query("agg15_facet_counts", f"{W} " + " union all ".join(f"select '{f}' as facet, {f} as value, count(*) as n from survey where {f} is not null and {f} <> '' group by {f}" for f in ("commune", "age_range", "genre", "profession", "dimension")))
def agg15(spark, d):
    return S.facet_counts(survey(spark, d), ["commune", "age_range", "genre", "profession", "dimension"])


@query("agg16_view_sizes", f"{_views_sql(VIEWS, 3, 'count(*) as n').replace('with ', 'with ', 1).replace(f'{W} select', f'{W}, v as (select', 1)}) select view_name, count(*) as n_views, avg(n) as avg_chunks from v group by 1")
def agg16(spark, d):
    return V.materialise(survey(spark, d), VIEWS, [], 3).groupBy("view_name").agg(F.count("*").alias("n_views"), F.avg("n").alias("avg_chunks"))


@query("agg17_indicator_overview", f"with {INDICATORS} select epci, count(*) as n, round(sum(total::decimal(18,4))::double / count(*), 4) as avg_total, max(total) as max_total, min(total) as min_total from indicators group by 1")
def agg17(spark, d):
    i = indicators(spark, d)
    return i.groupBy("epci").agg(F.count("*").alias("n"), F.round(F.sum(F.col("total").cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("avg_total"), F.max("total").alias("max_total"), F.min("total").alias("min_total"))


@query("agg18_profiles", f"{W}, l as (" + " union all ".join(f"select commune, '{f}' as facet, {f} as value, count(*) as n from survey where {f} is not null group by 1, 3" for f in ("genre", "age_range", "profession")) + ") select *, n * 100.0::double / sum(n) over (partition by commune, facet) as share from l")
def agg18(spark, d):
    return S.profile_shares(survey(spark, d), "commune", ["genre", "age_range", "profession"])


@query("agg19_methodology", f"{W} select count(*) as n_communes, sum(n)::bigint as n_respondents, count_if(n >= 3) as n_valid from (select commune, count(*) as n from survey group by 1)")
def agg19(spark, d):
    by = survey(spark, d).groupBy("commune").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("n_communes"), F.sum("n").alias("n_respondents"), F.count_if(F.col("n") >= 3).alias("n_valid"))


AGES = ["15-29", "30-44", "45-59", "60-74", "75+"]


@query("agg20_age_crosstab", f"{W} select dimension, " + ", ".join(f"count_if(age_range = '{a}') as \"a_{a[:2]}\"" for a in AGES) + ", count(*) as n from survey group by 1")
def agg20(spark, d):
    p = survey(spark, d).groupBy("dimension").pivot("age_range", AGES).count().fillna(0)
    return p.select("dimension", *(F.col(f"`{a}`").alias(f"a_{a[:2]}") for a in AGES), sum((F.col(f"`{a}`") for a in AGES), F.lit(0)).alias("n"))


@query("agg20_age_ranks", f"{W}, c as (select age_range, dimension, count(*) as n from survey group by 1, 2) select *, n * 100.0::double / sum(n) over (partition by age_range) as pct, row_number() over (partition by age_range order by n desc, dimension) as rank from c qualify rank <= 5")
def agg20_ranks(spark, d):
    c = survey(spark, d).groupBy("age_range", "dimension").agg(F.count("*").alias("n"))
    c = c.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("age_range")))
    return S.top_per(c, ["age_range"], [F.col("n").desc(), F.col("dimension")], 5)


@query("agg21_top3_by_profile", f"{W}, c as (select age_range, genre, dimension, count(*) as n from survey group by 1, 2, 3 having count(*) >= 3) select *, row_number() over (partition by age_range, genre order by n desc, dimension) as rank from c qualify rank <= 3")
def agg21(spark, d):
    c = survey(spark, d).groupBy("age_range", "genre", "dimension").agg(F.count("*").alias("n")).where("n >= 3")
    return S.top_per(c, ["age_range", "genre"], [F.col("n").desc(), F.col("dimension")], 3)


@query("agg22_epci_aggregates", f"""with {INDICATORS}, r as (select *, row_number() over (partition by epci order by total desc, zone) as up, row_number() over (partition by epci order by total, zone) as down from indicators)
select epci, count(*) as n, avg(opp) as avg_opp, avg(cho) as avg_cho, avg(vec) as avg_vec, string_agg(zone::varchar, ',' order by up) filter (where up <= 3) as top3, string_agg(zone::varchar, ',' order by down) filter (where down <= 3) as bottom3 from r where epci is not null group by 1""")
def agg22(spark, d):
    i = indicators(spark, d).where("epci is not null")

    def ends(order, name):
        """The first three of each group; the limit is put before the shuffle."""
        first = i.withColumn("k", F.row_number().over(Window.partitionBy("epci").orderBy(*order))).where("k <= 3").select("epci", "k", "zone")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "zone"))), lambda x: x["zone"].cast("string"))
        return first.groupBy("epci").agg(F.array_join(ids, ",").alias(name))

    sums = i.groupBy("epci").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"avg_{c}") for c in ("opp", "cho", "vec")))
    return sums.join(ends([F.col("total").desc(), "zone"], "top3"), "epci").join(ends([F.col("total"), "zone"], "bottom3"), "epci")


@query("agg23_region_summary", f"with {INDICATORS} select count(*) as n, min(total) as min_total, max(total) as max_total, list_extract(list(total order by total desc), (count(*) // 2 + 1)::int) as upper_median, avg(opp) as avg_opp, avg(cho) as avg_cho, avg(vec) as avg_vec from indicators")
def agg23(spark, d):
    i = indicators(spark, d)
    # the element n div 2 of the descending order, found by counts of values; no list is gathered
    from kadastra.operators.ranking import counts_before

    n = i.agg(F.count("*").alias("n_rows"), F.min("total").alias("min_total"), F.max("total").alias("max_total"), *(F.avg(c).alias(f"avg_{c}") for c in ("opp", "cho", "vec")))
    at = counts_before(i.select("total"), "total").crossJoin(F.broadcast(n)).where("before <= n_rows div 2 and n_rows div 2 < before + n")
    return at.select(F.col("n_rows").alias("n"), "min_total", "max_total", "avg_opp", "avg_cho", "avg_vec", F.col("total").alias("upper_median"))


@query("agg24_column_stats", " union all ".join(f"select '{c}' as col, avg({c}) as mean, median({c}) as median, min({c})::double as min, max({c})::double as max, round(stddev_samp({c}), 8) as std from ({{}}) i" for c in ("opp", "cho", "vec")).replace("{}", f"with {INDICATORS} select * from indicators"))
def agg24(spark, d):
    i = indicators(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in ("opp", "cho", "vec")))).alias("x")).select("x.*")
    stats = i.groupBy("col").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.stddev_samp("v"), 8).alias("std"))
    return stats.join(group_medians(i, ["col"], "v"), "col", "left").select("col", "mean", "median", "min", "max", "std")


@query("agg25_facet_values", f"{W} select distinct age_range, case age_range " + " ".join(f"when '{a}' then {i}" for i, a in enumerate(AGES)) + " else 9 end as place from survey")
def agg25(spark, d):
    place = F.lit(9)
    for i, a in enumerate(AGES):
        place = F.when(F.col("age_range") == a, F.lit(i)).otherwise(place)
    return survey(spark, d).select("age_range").distinct().withColumn("place", place)


@query("agg26_members", f"with {SURVEY} select epci, count(*) as n_members, string_agg(commune, ',' order by commune) as members from geography group by 1")
def agg26(spark, d):
    return S.member_lists(geography(spark, d), "epci", "commune")


@query("agg27_views_listed", _views_sql(QUANTI, 5, "count(*) as n") + " order by view_name, dim1_value, dim2_value")
def agg27(spark, d):
    return V.materialise(survey(spark, d), QUANTI, [], 5).orderBy("view_name", "dim1_value", "dim2_value")


@query("agg28_match_quality", f"{W} select count(*) as n, count_if(respondent_id % 4 <> 0) as n_certain, count_if(respondent_id % 4 = 0) as n_uncertain from survey")
def agg28(spark, d):
    return S.match_rate(survey(spark, d).withColumn("certain", F.col("respondent_id") % 4 != 0), "certain")


@query("agg29_parsed_stats", f"{W}, t as (select commune, 'happiness=' || happiness || ', quality=' || life_quality as doc from survey), kv as (select commune, unnest(regexp_extract_all(doc, '([a-z]+)=([0-9]+)', 1)) as k, unnest(regexp_extract_all(doc, '([a-z]+)=([0-9]+)', 2))::double as v from t) select commune, k, count(*) as n, avg(v) as m from kv group by 1, 2")
def agg29(spark, d):
    t = survey(spark, d).select("commune", F.concat(F.lit("happiness="), F.col("happiness"), F.lit(", quality="), F.col("life_quality")).alias("doc"))
    kv = t.select("commune", F.explode(F.str_to_map("doc", F.lit(", "), F.lit("="))).alias("k", "v"))
    return kv.groupBy("commune", "k").agg(F.count("*").alias("n"), F.avg(F.col("v").try_cast("double")).alias("m"))


@query("agg30_source_mix", "select conv_id, role, count(*) as n from conversations group by 1, 2")
def agg30(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))


@query("agg31_rebuilt_interviews", "select conv_id, count(*) as n_chunks, string_agg(text, chr(10) order by turn) as body from conversations group by 1")
def agg31(spark, d):
    c = table(spark, d, "conversations")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_chunks"), body.alias("body"))


@query("agg31_chunk_stats", "select role, count(*) as n_chunks, count(distinct (conv_id, turn)) as n_distinct from conversations group by 1")
def agg31_stats(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_chunks"), F.count_distinct("conv_id", "turn").alias("n_distinct"))


@query("win1_indicator_ranks", f"with {INDICATORS} select zone, " + ", ".join(f"rank() over (order by {c} desc) as rank_{c}" for c in ("opp", "cho", "vec")) + " from indicators")
def win1(spark, d):
    from kadastra.operators.ranking import competition_ranks

    return competition_ranks(indicators(spark, d), ["opp", "cho", "vec"]).select("zone", "rank_opp", "rank_cho", "rank_vec")


@query("win2_commune_ranking", f"{W}, c as (select commune, dimension, count(score) as n, avg(score) as avg_score from scored group by 1, 2 having count(score) >= 3) select *, row_number() over (partition by dimension order by avg_score desc, commune) as rank from c")
def win2(spark, d):
    s = S.dimension_scores(scored(spark, d), ["commune", "dimension"], least=3)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("avg_score").desc(), "commune")))


@query("win3_scope_rankings", f"""{W}, c as (select 'global' as scope, 'all' as value, dimension, count(score) as n, avg(score) as m from scored group by dimension
union all select 'commune', commune, dimension, count(score), avg(score) from scored group by 2, 3 union all select 'age', age_range, dimension, count(score), avg(score) from scored group by 2, 3)
select scope, value, arg_max(dimension, (m, dimension)) as best, arg_min(dimension, (m, dimension)) as worst, max(m) - min(m) as spread from c where n >= 3 group by 1, 2""")
def win3(spark, d):
    s = scored(spark, d)
    g = s.groupingSets([[F.col("dimension")], [F.col("commune"), F.col("dimension")], [F.col("age_range"), F.col("dimension")]], "commune", "age_range", "dimension").agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.grouping("commune").alias("gc"), F.grouping("age_range").alias("ga"))
    scope = F.when(F.col("gc") == 0, F.lit("commune")).when(F.col("ga") == 0, F.lit("age")).otherwise(F.lit("global"))
    c = g.where("n >= 3").select(scope.alias("scope"), F.coalesce("commune", "age_range", F.lit("all")).alias("value"), "dimension", "m")
    return c.groupBy("scope", "value").agg(F.max_by("dimension", F.struct("m", "dimension")).alias("best"), F.min_by("dimension", F.struct("m", "dimension")).alias("worst"), (F.max("m") - F.min("m")).alias("spread"))


@query("win4_top3_choices", f"{W}, p as (select commune, unnest(string_split(choices, ';')) as choice from survey), c as (select commune, choice, count(*) as n from p group by 1, 2) select commune, string_agg(choice, ',' order by n desc, choice) as top3 from (select *, row_number() over (partition by commune order by n desc, choice) as r from c) where r <= 3 group by 1")
def win4(spark, d):
    t = S.top_per(S.choice_shares(survey(spark, d), "commune", "choices"), ["commune"], [F.col("n").desc(), F.col("choice")], 3)
    return t.groupBy("commune").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "choice"))), lambda x: x["choice"]), ",").alias("top3"))


@query("win5_top_zones", f"with {INDICATORS} select zone, total from indicators order by total desc, zone limit 10")
def win5(spark, d):
    return indicators(spark, d).select("zone", "total").orderBy(F.col("total").desc(), "zone").limit(10)


@query("win6_best_per_group", f"with {INDICATORS} select epci, arg_max(zone, (total, -zone)) as best_total, arg_max(zone, (opp, -zone)) as best_opp from indicators group by 1")
def win6(spark, d):
    return indicators(spark, d).groupBy("epci").agg(*(F.max_by("zone", F.struct(c, -F.col("zone"))).alias(f"best_{c}") for c in ("total", "opp")))


ORDER = ["age_job", "by_age", "by_job", "all"]


def _candidates(df):
    """Question rows (q, view_name, dim1_value, dim2_value) for every view of ORDER."""
    items = [("age_job", F.col("age_range"), F.col("profession")), ("by_age", F.col("age_range"), None), ("by_job", F.col("profession"), None), ("all", None, None)]
    null = F.lit(None).cast("string")
    return df.select("q", F.explode(F.array(*(F.struct(F.lit(v).alias("view_name"), (a if a is not None else null).alias("dim1_value"), (b if b is not None else null).alias("dim2_value")) for v, a, b in items))).alias("x")).select("q", "x.*")


@query("win7_view_pick", f"""{W}, v as ({_views_sql({"all": [], "by_age": ["age_range"], "by_job": ["profession"], "age_job": ["age_range", "profession"]}, 30, 'count(*) as n', ('all',)).replace(W, '', 1)}),
q as (select c_custkey as q, {C.age_bucket_sql('(c_custkey % 70 + 15)', 'survey')} as age_range, c_mktsegment as profession from customer),
c as (select q, 'age_job' as view_name, age_range as a, profession as b, 1 as place from q union all select q, 'by_age', age_range, null, 2 from q union all select q, 'by_job', profession, null, 3 from q union all select q, 'all', null, null, 4 from q)
select q, view_name, n from c join v using (view_name) where a is not distinct from dim1_value and b is not distinct from dim2_value qualify row_number() over (partition by q order by place) = 1""")
def win7(spark, d):
    views = V.materialise(survey(spark, d), {"all": [], "by_age": ["age_range"], "by_job": ["profession"], "age_job": ["age_range", "profession"]}, [], 30, exempt=["all"])
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q"), C.age_bucket(F.col("c_custkey") % 70 + 15, "survey").alias("age_range"), F.col("c_mktsegment").alias("profession"))
    return V.most_specific(_candidates(q), views.select("view_name", "dim1_value", "dim2_value", "n"), ORDER).select("q", "view_name", "n")


@query("win8_fallback_tiers", "select doc_id as q, lang as pick, case lang when 'fr' then 1 when 'en' then 2 else 3 end as tier from documents qualify row_number() over (partition by source order by case lang when 'fr' then 1 when 'en' then 2 else 3 end, doc_id) = 1")
def win8(spark, d):
    tier = F.when(F.col("lang") == "fr", F.lit(1)).when(F.col("lang") == "en", F.lit(2)).otherwise(F.lit(3))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("q"), F.col("lang").alias("pick"), "source", tier.alias("tier"))
    return V.pick_by_tier(c, "source", F.col("tier"), [F.col("q")]).select("q", "pick", "tier")


@query("win9_ranking_document", f"{W}, docs as (select 'commune' as scope, commune as v, count(*) as n from survey group by 2 union all select 'age', age_range, count(*) from survey group by 2 union all select 'global', 'all', count(*) from survey), q as (select respondent_id as q, case when respondent_id % 2 = 0 then commune end as a, case when respondent_id % 3 = 0 then age_range end as b from survey) select q, scope, n from q join docs on (scope = 'commune' and v = a) or (scope = 'age' and v = b) or (scope = 'global') qualify row_number() over (partition by q order by case scope when 'commune' then 1 when 'age' then 2 else 3 end) = 1")
def win9(spark, d):
    s = survey(spark, d)
    docs = V.materialise(s, {"global": [], "commune": ["commune"], "age": ["age_range"]}, []).select(F.col("view_name").alias("scope"), F.coalesce("dim1_value", F.lit("all")).alias("v"), "n")
    items = F.array(F.struct(F.lit("commune").alias("scope"), F.when(F.col("respondent_id") % 2 == 0, F.col("commune")).alias("v")), F.struct(F.lit("age").alias("scope"), F.when(F.col("respondent_id") % 3 == 0, F.col("age_range")).alias("v")), F.struct(F.lit("global").alias("scope"), F.lit("all").alias("v")))
    c = s.select(F.col("respondent_id").alias("q"), F.explode(items).alias("x")).select("q", "x.*").join(docs, ["scope", "v"])
    tier = F.array_position(F.array(*map(F.lit, ("commune", "age", "global"))), F.col("scope"))
    return V.pick_by_tier(c, "q", tier, [F.col("v")]).select("q", "scope", "n")


@query("win16_multi_key_sort", f"{W} select commune, genre, count(*) as n from survey group by 1, 2 order by n desc, commune, genre")
def win16(spark, d):
    return survey(spark, d).groupBy("commune", "genre").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.coalesce("commune", F.lit("")), "genre")


@query("flt1_predicate_tree", f"{W} select respondent_id from survey where profession = 'BUILDING' and age >= 30 and age <= 50 and commune in ('NATION_1', 'NATION_2', 'NATION_3')")
def flt1(spark, d):
    from kadastra.operators.filters import predicate

    return survey(spark, d).where(predicate({"$and": [{"profession": {"$eq": "BUILDING"}}, {"age": {"$gte": 30}}, {"age": {"$lte": 50}}, {"commune": {"$in": ["NATION_1", "NATION_2", "NATION_3"]}}]})).select("respondent_id")


@query("flt3_facet_listing", f"{W} select respondent_id, commune, age from survey where genre = 'F' and dimension = 'D3' order by commune, age, respondent_id")
def flt3(spark, d):
    from kadastra.operators.filters import facets

    return survey(spark, d).where(facets(genre="F", dimension="D3", commune=None)).select("respondent_id", "commune", "age").orderBy("commune", "age", "respondent_id")


@query("flt4_quantitative_listing", f"{W} select commune, count(*) as n, avg(happiness) as avg_happiness from survey where profession = 'MACHINERY' group by 1")
def flt4(spark, d):
    from kadastra.operators.filters import facets

    return survey(spark, d).where(facets(profession="MACHINERY")).groupBy("commune").agg(F.count("*").alias("n"), F.avg("happiness").alias("avg_happiness"))


@query("flt5_domain", f"{W} select respondent_id, age_range from survey where age_range in ('15-29', '30-44', '45-59') and profession is not null")
def flt5(spark, d):
    return survey(spark, d).where(F.col("age_range").isin(AGES[:3]) & F.col("profession").isNotNull()).select("respondent_id", "age_range")


@query("flt6_valid_keys", f"{W} select count(*) as n from survey where trim(commune) not in ('', 'nan') and trim(profession) not in ('', 'nan')")
def flt6(spark, d):
    s = survey(spark, d)
    return s.where(C.clean(F.col("commune")).isNotNull() & C.clean(F.col("profession")).isNotNull()).agg(F.count("*").alias("n"))


@query("flt9_structured_lookup", f"{W} select respondent_id, happiness from survey where lower(commune) = lower('nation_4')")
def flt9(spark, d):
    from kadastra.operators.filters import lookup

    return lookup(survey(spark, d), "commune", "nation_4", ["respondent_id", "happiness", "absent"])


@query("prj3_clean_cells", f"{W} select respondent_id, case when respondent_id % 5 = 0 then null else label end as label from survey")
def prj3(spark, d):
    s = survey(spark, d).withColumn("label", F.when(F.col("respondent_id") % 5 == 0, F.lit(" nan ")).otherwise(F.col("label")))
    return s.select("respondent_id", C.clean(F.col("label")).alias("label"))


@query("prj1_first_known", f"{W} select respondent_id, coalesce(case when respondent_id % 3 <> 0 then commune end, epci) as place from survey")
def prj1(spark, d):
    return survey(spark, d).select("respondent_id", C.first_known(F.when(F.col("respondent_id") % 3 == 0, F.lit(" ")).otherwise(F.col("commune")), F.col("epci")).alias("place"))


@query("prj2_renamed", f"{W} select respondent_id as id, commune as town, happiness as joy from survey")
def prj2(spark, d):
    return survey(spark, d).select("respondent_id", "commune", "happiness").withColumnsRenamed({"respondent_id": "id", "commune": "town", "happiness": "joy", "absent": "x"})


@query("prj4_row_sentences", f"{W} select respondent_id, 'Respondent of ' || commune || ', ' || age || ' years, ' || profession || ': happiness ' || happiness || '.' as sentence from survey")
def prj4(spark, d):
    return survey(spark, d).select("respondent_id", F.format_string("Respondent of %s, %d years, %s: happiness %d.", "commune", "age", "profession", "happiness").alias("sentence"))


@query("prj6_respondent_documents", f"{W} select respondent_id, commune || ' | ' || concat_ws(', ', 'happiness=' || happiness, case when respondent_id % 2 = 0 then 'quality=' || life_quality end) || ' | ' || choices as doc from survey")
def prj6(spark, d):
    pairs = [("happiness", F.col("happiness")), ("quality", F.when(F.col("respondent_id") % 2 == 0, F.col("life_quality")))]
    return survey(spark, d).select("respondent_id", F.concat_ws(" | ", "commune", C.label_values(pairs), "choices").alias("doc"))


@query("prj8_levels", f"{W}, g as (select commune, avg(score) as m from scored group by 1) select commune, {C.level_sql('m')} as level from g")
def prj8(spark, d):
    return scored(spark, d).groupBy("commune").agg(F.avg("score").alias("m")).select("commune", C.level(F.col("m")).alias("level"))


@query("prj9_min_max", f"with {INDICATORS}, m as (select min(opp) as lo, max(opp) as hi from indicators) select zone, case when hi = lo then 5.0::double else greatest(0.0, least(10.0, (opp - lo) / (hi - lo) * 10.0)) end as opp_10 from indicators, m")
def prj9(spark, d):
    i = indicators(spark, d)
    m = i.agg(F.min("opp").alias("lo"), F.max("opp").alias("hi"))  # one row
    return i.crossJoin(F.broadcast(m)).select("zone", C.min_max(F.col("opp"), F.col("lo"), F.col("hi")).alias("opp_10"))


@query("prj10_age_texts", f"{W}, t as (select respondent_id, case when respondent_id % 7 = 0 then 'plus de 70 ans' when respondent_id % 5 = 0 then 'inconnu' else age::varchar end as txt from survey), n as (select *, try_cast(nullif(regexp_extract(txt, '[0-9]+'), '') as int) + case when contains(txt, 'plus de') then 1 else 0 end as a from t) select respondent_id, a as age, {C.age_bucket_sql('a', 'portrait')} as bucket from n")
def prj10(spark, d):
    txt = F.when(F.col("respondent_id") % 7 == 0, "plus de 70 ans").when(F.col("respondent_id") % 5 == 0, "inconnu").otherwise(F.col("age").cast("string"))
    a = C.age_number(txt)
    return survey(spark, d).select("respondent_id", a.alias("age"), C.age_bucket(a).alias("bucket"))


@query("prj11_doc_ids", f"{W} select distinct 'by_job__' || left(regexp_replace(lower(profession), '[^a-z0-9]+', '_', 'g'), 30) || '__' || left(regexp_replace(lower(commune), '[^a-z0-9]+', '_', 'g'), 30) as id from survey")
def prj11(spark, d):
    return survey(spark, d).select(C.doc_id(F.lit("by_job"), F.col("profession"), F.col("commune")).alias("id")).distinct()


@query("prj12_best_weakest", f"with {INDICATORS} select zone, case greatest(opp, cho, vec) when opp then 'opp' when cho then 'cho' else 'vec' end as best, case least(opp, cho, vec) when opp then 'opp' when cho then 'cho' else 'vec' end as weakest from indicators")
def prj12(spark, d):
    best, weak = C.best_and_weakest([(c, F.col(c)) for c in ("opp", "cho", "vec")])
    return indicators(spark, d).select("zone", best.alias("best"), weak.alias("weakest"))


@query("join2_commune_epci", f"{W} select commune, coalesce(epci, '') as epci, count(*) as n from survey group by 1, 2")
def join2(spark, d):
    s, g = survey(spark, d).drop("epci"), geography(spark, d).select("commune", "epci")
    return s.join(F.broadcast(g), "commune", "left").groupBy("commune", F.coalesce("epci", F.lit("")).alias("epci")).agg(F.count("*").alias("n"))


@query("join3_respondent_ids", f"{W}, k as (select commune, age, genre, profession, max(respondent_id) as rid from survey where respondent_id % 2 = 0 group by all) select respondent_id, rid from survey left join k using (commune, age, genre, profession) where respondent_id % 2 = 1")
def join3(spark, d):
    s = survey(spark, d)
    known = s.where("respondent_id % 2 = 0").withColumn("rid", F.col("respondent_id"))
    return V.backfill(s.where("respondent_id % 2 = 1"), known, ["commune", "age", "genre", "profession"], "rid", [F.col("rid").desc()]).select("respondent_id", "rid")


@query("join4_key_union", "select n_name as k from nation union select r_name from region union select c_mktsegment from customer")
def join4(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("join6_code_variants", "select c_custkey, coalesce(a.n_nationkey, b.n_nationkey) as code from (select c_custkey, case when c_custkey % 2 = 0 then 'NATION_' || (c_custkey % 30) else 'NATION ' || (c_custkey % 30) end as name from customer) c left join nation a on a.n_name = name left join nation b on b.n_name = replace(name, ' ', '_')")
def join6(spark, d):
    from kadastra.operators.joins import code_by_variants

    c = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "NATION_").otherwise("NATION "), (F.col("c_custkey") % 30).cast("string")).alias("name"))
    codes = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    return code_by_variants(c, codes, "name", [lambda x: x, lambda x: F.replace(x, F.lit(" "), F.lit("_")), lambda x: F.replace(x, F.lit("tt"), F.lit("t"))]).select("c_custkey", "code")


@query("join1_counts_with_totals", f"{W}, t as (select commune, count(*) as n_total from survey group by 1), c as (select commune, profession, count(*) as n from survey group by 1, 2) select * from c join t using (commune)")
def join1(spark, d):
    s = survey(spark, d)
    return s.groupBy("commune", "profession").agg(F.count("*").alias("n")).join(s.groupBy("commune").agg(F.count("*").alias("n_total")), "commune")


@query("join13_semi", f"{W} select respondent_id from survey where commune in (select commune from geography where epci = 'ASIA')")
def join13(spark, d):
    g = geography(spark, d).where("epci = 'ASIA'")
    return survey(spark, d).join(F.broadcast(g.select("commune")), "commune", "left_semi").select("respondent_id")


@query("join14_anti", "select item_id from benchmark where item_id not in (select doc_id from labels)")
def join14(spark, d):
    return V.only_new(table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), table(spark, d, "benchmark"), "item_id").select("item_id")


@query("col1_upsert", "with old as (select event_id as id, user_id, 1 as version from events where event_id % 3 <> 0), new as (select event_id as id, user_id + 1 as user_id, 2 as version from events where event_id % 2 = 0) select * from new union all select * from old where id not in (select id from new)")
def col1(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), "user_id", F.lit(1).alias("version"))
    new = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("user_id"), F.lit(2).alias("version"))
    return V.upsert(old, new)


@query("col1_delete", "select event_id from events where event_id not in (select o_orderkey from orders where o_orderkey % 4 = 0)")
def col1_delete(spark, d):
    ids = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("event_id"))
    return V.delete_ids(table(spark, d, "events"), ids, "event_id").select("event_id")


@query("col2_incremental_add", "select event_id from events where ts >= (select min(ts) + (max(ts) - min(ts)) / 2 from events) and event_id % 2 = 1")
def col2(spark, d):
    e = table(spark, d, "events")
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half"))
    late = e.crossJoin(F.broadcast(half)).where("ts >= half")
    return V.only_new(e.where("event_id % 2 = 0"), late, "event_id").select("event_id")


@query("col3_prefix", "select doc_id, case when lang = 'fr' and not starts_with(text, '[2024] ') then '[2024] ' || text else text end as text from documents")
def col3(spark, d):
    p = spark.createDataFrame([("fr", "[2024] ")], "collection string, prefix string")
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("collection"), "text")
    return V.prefix_once(V.prefix_once(rows, p), p).select("doc_id", "text")


@query("col4_backfill_rate", f"{W}, k as (select commune, age, genre, profession, max(respondent_id) as rid from survey where respondent_id % 2 = 0 group by all) select count(*) as n, count(rid) as n_matched from survey left join k using (commune, age, genre, profession) where respondent_id % 2 = 1")
def col4(spark, d):
    return join3(spark, d).agg(F.count("*").alias("n"), F.count("rid").alias("n_matched"))


@query("col5_inventory", "select source, count(*) as n, min(doc_id) as sample_id from documents group by 1")
def col5(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("sample_id"))


@query("col6_stats", f"with {INDICATORS} select epci, count(*) as n, min(total) as lo, max(total) as hi, arg_min(zone, (total, zone)) as lo_zone, arg_max(zone, (total, -zone)) as hi_zone from indicators group by 1")
def col6(spark, d):
    return indicators(spark, d).groupBy("epci").agg(F.count("*").alias("n"), F.min("total").alias("lo"), F.max("total").alias("hi"), F.min_by("zone", F.struct("total", "zone")).alias("lo_zone"), F.max_by("zone", F.struct("total", -F.col("zone"))).alias("hi_zone"))
