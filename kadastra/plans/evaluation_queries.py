"""Evaluation statistics of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from kadastra.functions import columns as C
from kadastra.operators import evaluation as E
from kadastra.operators.ranking import group_medians
from kadastra.plans.registry import query
from kadastra.plans.stand_ins import SURVEY, scored, survey, table

W = f"with {SURVEY}"
CATS = f"""{W}, a as (select respondent_id, list_distinct(string_split(choices, ';')) as found, ['D1', 'D2', 'D3'] as expected, ['D4'] as optional from survey),
m as (select respondent_id, len(list_intersect(expected, found)) / 3.0::double as recall, len(list_intersect(found, list_concat(expected, optional))) / len(found)::double as precision from a)"""


@query("eva1_set_metrics", f"{CATS} select respondent_id, recall, precision, case when recall + precision = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end as f1 from m")
def eva1(spark, d):
    m = E.set_metrics(F.array(*map(F.lit, ("D1", "D2", "D3"))), F.array(F.lit("D4")), F.split("choices", ";"))
    return survey(spark, d).select("respondent_id", *(c.alias(n) for n, c in m.items()))


@query("eva3_null_f1", f"{CATS} select respondent_id, case when recall + precision = 0 then null else 2 * precision * recall / (precision + recall) end as f1 from m")
def eva3(spark, d):
    m = E.set_metrics(F.array(*map(F.lit, ("D1", "D2", "D3"))), F.array(F.lit("D4")), F.split("choices", ";"), None)
    return survey(spark, d).select("respondent_id", m["f1"].alias("f1"))


@query("eva2_alias_precision", f"{CATS} select respondent_id, len(list_intersect(found, list_concat(list_concat(expected, optional), ['D5', 'D6']))) / len(found)::double as precision from a")
def eva2(spark, d):
    m = E.set_metrics(F.array(*map(F.lit, ("D1", "D2", "D3"))), F.array(*map(F.lit, ("D4", "D5", "D6"))), F.split("choices", ";"))
    return survey(spark, d).select("respondent_id", m["precision"].alias("precision"))


@query("eva4_credit_rule", f"{W}, p as (select commune, count(*) as pool, count_if(label = '2-HIGH') as n from survey group by 1) select commune, n >= greatest(1, round_even(0.3 * pool, 0)) as credited from p")
def eva4(spark, d):
    p = survey(spark, d).groupBy("commune").agg(F.count("*").alias("pool"), F.count_if(F.col("label") == "2-HIGH").alias("n"))
    return p.select("commune", (F.col("n") >= F.greatest(F.lit(1.0), F.bround(0.3 * F.col("pool"), 0))).alias("credited"))


@query("eva5_metrics_by_section", f"{CATS} select profession as config, commune as section, count(*) as n, round(avg(recall), 8) as recall, grouping_id(profession, commune)::bigint as g from m join survey using (respondent_id) group by grouping sets ((profession, commune), (profession))")
def eva5(spark, d):
    m = E.set_metrics(F.array(*map(F.lit, ("D1", "D2", "D3"))), F.array(F.lit("D4")), F.split("choices", ";"))
    s = survey(spark, d).select(F.col("profession").alias("config"), F.col("commune").alias("section"), m["recall"].alias("r"))
    return s.groupingSets([[F.col("config"), F.col("section")], [F.col("config")]], "config", "section").agg(F.count("*").alias("n"), F.round(F.avg("r"), 8).alias("recall"), F.grouping_id().cast("long").alias("g"))


@query("eva6_f1_stats", f"{CATS} select commune, round(avg(recall), 8) as mean, median(recall) as median, round(case when count(*) >= 2 then stddev_samp(recall) end, 8) as std from m join survey using (respondent_id) group by 1")
def eva6(spark, d):
    m = E.set_metrics(F.array(*map(F.lit, ("D1", "D2", "D3"))), F.array(F.lit("D4")), F.split("choices", ";"))
    s = survey(spark, d).select("commune", m["recall"].alias("r"))
    stats = s.groupBy("commune").agg(F.round(F.avg("r"), 8).alias("mean"), F.round(F.when(F.count("*") >= 2, F.stddev_samp("r")), 8).alias("std"))
    return stats.join(group_medians(s, ["commune"], "r"), "commune", "left").select("commune", "mean", "median", "std")


@query("eva7_section_table", f"{W} select dimension as section, count(*) as n, avg(score) as judge, avg(case when genre = 'F' then (score >= 3)::int end) as binary_ok, count_if(score = 1) as n_refused from scored group by 1")
def eva7(spark, d):
    return scored(spark, d).groupBy(F.col("dimension").alias("section")).agg(F.count("*").alias("n"), F.avg("score").alias("judge"), F.avg(F.when(F.col("genre") == "F", (F.col("score") >= 3).cast("int"))).alias("binary_ok"), F.count_if(F.col("score") == 1).alias("n_refused"))


@query("eva8_pivot_by_config", f"{W} select commune as section, avg(score) filter (where status = 'F') as f, avg(score) filter (where status = 'O') as o, avg(score) filter (where status = 'P') as p from scored group by 1")
def eva8(spark, d):
    return scored(spark, d).groupBy(F.col("commune").alias("section")).pivot("status", ["F", "O", "P"]).agg(F.avg("score")).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("eva9_config_summary", f"{W} select profession as config, count(*) as n, count(score) as n_ok, avg(score) as note, count_if(score = 1) * 100.0::double / count(*) as flagged_pct from scored group by 1")
def eva9(spark, d):
    return scored(spark, d).groupBy(F.col("profession").alias("config")).agg(F.count("*").alias("n"), F.count("score").alias("n_ok"), F.avg("score").alias("note"), (F.count_if(F.col("score") == 1) * 100.0 / F.count("*")).alias("flagged_pct"))


AGREE = f"""{W}, p as (select dimension, happiness as a, life_quality as b from survey), r as (select *, rank() over (partition by dimension order by a) + (count(*) over (partition by dimension, a) - 1) / 2.0 as ra, rank() over (partition by dimension order by b) + (count(*) over (partition by dimension, b) - 1) / 2.0 as rb from p)"""


@query("eva10_agreement", f"{AGREE} select dimension, count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman, avg(abs(b - a)) as mae, avg(b - a) as bias, count_if(a = b) * 100.0::double / count(*) as exact_pct, count_if(abs(a - b) <= 1) * 100.0::double / count(*) as within1_pct from r group by 1")
def eva10(spark, d):
    a = E.agreement(survey(spark, d).select("dimension", "happiness", "life_quality"), ["dimension"], "happiness", "life_quality")
    return a.withColumns({c: F.round(c, 6) for c in ("pearson", "spearman")})


@query("eva10_p_values")
def eva10_p(spark, d):
    a = E.agreement(survey(spark, d).select("dimension", "happiness", "life_quality"), ["dimension"], "happiness", "life_quality")
    return E.with_p_values(a.select("dimension", "n", "pearson"))


@query("eva11_versions", f"{W} select commune, count(*) as n, avg(happiness) as mean_a, avg(life_quality) as mean_b, avg(abs(happiness - life_quality)) as mae from survey group by 1")
def eva11(spark, d):
    return survey(spark, d).groupBy("commune").agg(F.count("*").alias("n"), F.avg("happiness").alias("mean_a"), F.avg("life_quality").alias("mean_b"), F.avg(F.abs(F.col("happiness") - F.col("life_quality"))).alias("mae"))


@query("eva12_row_scores", f"{W} select respondent_id, (happiness + life_quality + score + 3) / 4.0::double as global_score from scored")
def eva12(spark, d):
    return scored(spark, d).select("respondent_id", ((F.col("happiness") + F.col("life_quality") + F.col("score") + 3) / 4.0).alias("global_score"))


@query("eva13_board", f"{W}, s as (select profession, case when respondent_id % 9 <> 0 then score end as note from scored) select profession, count(*) as n, avg(note) as avg_note, min(note) as min_note, max(note) as max_note, count_if(note is null) as errors from s group by 1")
def eva13(spark, d):
    return E.board(scored(spark, d).withColumn("note", F.when(F.col("respondent_id") % 9 != 0, F.col("score"))), ["profession"], "note")


@query("eva14_rollup", f"{W} select epci, count(*) as n, avg(score) as note from scored group by rollup (epci)")
def eva14(spark, d):
    return scored(spark, d).rollup("epci").agg(F.count("*").alias("n"), F.avg("score").alias("note"))


@query("eva15_factual", "select p_partkey, case when abs(x - gt) <= gt * 0.05 + 0.05 then 1.0 else greatest(0.0, 1 - abs(x - gt) / (gt + 0.01)) end::double as score from (select p_partkey, p_size::double as gt, (p_size + p_partkey % 5)::double as x from part)")
def eva15(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", C.factual_score(F.concat(F.lit("value "), (F.col("p_size") + F.col("p_partkey") % 5).cast("string")), F.col("p_size").cast("double")).alias("score"))


@query("eva16_robustness", "with e as (select vec_id, vec_id // 4 as g, embedding::double[] as v from embeddings), p as (select a.g, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.g = b.g and a.vec_id < b.vec_id) select g, round(avg(c), 6) as avg_cos, round(min(c), 6) as min_cos from p group by 1")
def eva16(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("g"), "embedding")
    return E.robustness(e, "g", "vec_id", "embedding").select("g", F.round("avg_cos", 6).alias("avg_cos"), F.round("min_cos", 6).alias("min_cos"))


@query("eva17_expected_type", f"{W} select respondent_id, case when status = 'F' then 'factuel' when status = 'O' then 'binaire' else 'ouvert' end as kind from survey")
def eva17(spark, d):
    return survey(spark, d).select("respondent_id", F.when(F.col("status") == "F", "factuel").when(F.col("status") == "O", "binaire").otherwise("ouvert").alias("kind"))


@query("eva18_judge_deltas", f"{W} select profession as config, avg(happiness - life_quality) as delta from survey group by 1")
def eva18(spark, d):
    return survey(spark, d).groupBy(F.col("profession").alias("config")).agg(F.avg(F.col("happiness") - F.col("life_quality")).alias("delta"))


@query("eva19_merged_runs", "select event_id, case when event_id % 4 = 0 then 'ok' else event_type end as status from events where event_id % 4 = 0 or event_id % 2 = 1")
def eva19(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_id % 2 = 1 or event_id % 8 = 0").select("event_id", F.col("event_type").alias("status"))
    new = e.where("event_id % 4 = 0").select("event_id", F.lit("ok").alias("status"))
    return E.latest_wins(old, new, ["event_id"])


@query("eva20_run_summary", "select event_type as system, count(*) as n, count_if(user_id % 5 = 0) as errors, avg(case when user_id % 5 <> 0 then event_id % 100 end) as mean_time, sum(case when user_id % 5 <> 0 then event_id % 100 end)::bigint as total_time from events group by 1")
def eva20(spark, d):
    ok = F.when(F.col("user_id") % 5 != 0, F.col("event_id") % 100)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("system")).agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 5 == 0).alias("errors"), F.avg(ok).alias("mean_time"), F.sum(ok).alias("total_time"))


@query("join11_questions_configs", "select item_id, c.config, count(t.doc_id) as n from benchmark cross join (select distinct lang as config from documents) c left join documents t on t.lang = c.config and t.doc_id = item_id group by 1, 2")
def join11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("config"))
    grid = table(spark, d, "benchmark").select("item_id").crossJoin(docs.select("config").distinct())  # a few configs
    return grid.join(docs.withColumnRenamed("doc_id", "item_id").withColumn("hit", F.lit(1)), ["item_id", "config"], "left").groupBy("item_id", "config").agg(F.count("hit").alias("n"))


@query("join12_version_pairs", f"{W} select a.respondent_id, k, case k when 'h' then a.happiness else a.score end as v1, case k when 'h' then b.happiness else b.score end as v2 from scored a join scored b on b.respondent_id = a.respondent_id + 1, (values ('h'), ('s')) t(k)")
def join12(spark, d):
    s = scored(spark, d)
    long = lambda df, v: df.select("respondent_id", F.explode(F.array(F.struct(F.lit("h").alias("k"), F.col("happiness").alias(v)), F.struct(F.lit("s").alias("k"), F.col("score").alias(v)))).alias("x")).select("respondent_id", "x.*")
    return long(s, "v1").join(long(s.withColumn("respondent_id", F.col("respondent_id") - 1), "v2"), ["respondent_id", "k"])


@query("join15_truth_tokens", f"{W}, v as (select profession || ' ' || age_range as dims, respondent_id from survey), t(token) as (values ('BUILDING'), ('45-59')) select token, count(distinct respondent_id) as n from t join v on contains(dims, token) group by 1")
def join15(spark, d):
    # tokens are the distinct parts of the dimension values, met by equality
    v = survey(spark, d).select("respondent_id", F.explode(F.array("profession", "age_range")).alias("token"))
    return v.where(F.col("token").isin("BUILDING", "45-59")).groupBy("token").agg(F.count_distinct("respondent_id").alias("n"))


@query("join5_source_links", "select c_custkey, coalesce('n' || n_nationkey, 'p' || p_partkey) as link from (select *, case when c_custkey % 2 = 0 then 'NATION_' || c_nationkey end as a, case when c_custkey % 2 = 1 then c_custkey end as b from customer) left join nation on n_name = a left join part on p_partkey = b")
def join5(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("a"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey")).alias("b"))
    n, p = table(spark, d, "nation"), table(spark, d, "part").select("p_partkey")
    j = c.join(n, c.a == n.n_name, "left").join(p, F.col("b") == F.col("p_partkey"), "left")
    return j.select("c_custkey", F.coalesce(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("link"))


@query("win15_outliers", f"{W} select respondent_id, case when abs(happiness - score) >= abs(life_quality - score) then 'happiness' else 'life_quality' end as widest from scored where abs(happiness - life_quality) > 1")
def win15(spark, d):
    return E.outliers(scored(spark, d), "happiness", "life_quality", [("happiness", "happiness", "score"), ("life_quality", "life_quality", "score")]).select("respondent_id", "widest")


@query("win17_provider_sheet", f"{W} select respondent_id, case profession when 'BUILDING' then 1 when 'MACHINERY' then 2 else 99 end as place from survey order by place, respondent_id")
def win17(spark, d):
    place = F.array_position(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("profession"))
    return survey(spark, d).select("respondent_id", F.when(place > 0, place).otherwise(F.lit(99)).cast("int").alias("place")).orderBy("place", "respondent_id")


