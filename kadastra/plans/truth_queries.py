"""Token metrics of retrieval: parts ask, customers are the evidence behind views by town and age."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kadastra.functions.columns import age_bucket, age_bucket_sql
from kadastra.operators import truth as T
from kadastra.operators import views as V
from kadastra.plans.registry import query
from kadastra.plans.stand_ins import table

AGE = f"{age_bucket_sql('(c_custkey % 70 + 15)', 'survey')}"
DATA = f"""people as (select c_custkey as chunk_id, 'NATION_' || c_nationkey as commune, c_nationkey, {AGE} as age from customer),
lineage as (select 'raptor_summaries' as collection, 'town_age' as view_name, commune as dim1, age as dim2, chunk_id from people union all select 'raptor_quanti_summaries', 'town', commune, null, chunk_id from people),
tokens as (select p_partkey as question, case p_partkey % 7 when 0 then 'verbatims' when 1 then 'classement' when 2 then 'oppchovec' when 3 then 'wiki' when 4 then 'rien' when 5 then 'stats_enquete' else 'unknown' end as type, null as collection, null as commune, null as age, p_partkey % 7 = 3 as optional from part
  union all select p_partkey, 'raptor', ['raptor_summaries', 'raptor_quanti_summaries', 'both'][p_partkey % 3 + 1], 'Nation_' || (p_partkey % 30), case when p_partkey % 2 = 0 then '30-44' end, false from part),
ordered as (select *, row_number() over (partition by c_nationkey order by chunk_id) as k from people),
configs(config) as (values ('plain'), ('views')),
retrieved as (select p_partkey as question, config, case chunk_id % 4 when 0 then 'verbatims' when 1 then 'entretiens' when 2 then 'unknown' else case when config = 'views' then 'raptor_portrait' else 'stats_enquete' end end as category, chunk_id
  from part join ordered on c_nationkey = p_partkey % 25 and k <= p_partkey % 6 * 4, configs),
runs as (select p_partkey as question, config from part, configs),
asked as (select distinct collection, commune, age from tokens where type = 'raptor'),
pools as (select distinct a.collection, a.commune, a.age, chunk_id from asked a join lineage l on (a.collection = 'both' or a.collection = l.collection) and (contains(lower(dim1), lower(a.commune)) or coalesce(contains(lower(dim2), lower(a.commune)), false))
  and (a.age is null or contains(lower(dim1), a.age) or coalesce(contains(lower(dim2), a.age), false)))"""


def tokens(spark, d):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("verbatims", "classement", "oppchovec", "wiki", "rien", "stats_enquete", "unknown")))
    none = F.lit(None).cast("string")
    collections = F.array(*map(F.lit, ("raptor_summaries", "raptor_quanti_summaries", "both")))
    two = F.array(
        F.struct(F.get(kinds, (k % 7).cast("int")).alias("type"), none.alias("collection"), none.alias("commune"), none.alias("csp"), none.alias("age"), (k % 7 == 3).alias("optional")),
        F.struct(F.lit("raptor").alias("type"), F.get(collections, (k % 3).cast("int")).alias("collection"), F.concat(F.lit("Nation_"), (k % 30).cast("string")).alias("commune"), none.alias("csp"), F.when(k % 2 == 0, "30-44").alias("age"), F.lit(False).alias("optional")),
    )
    return table(spark, d, "part").select(k.alias("question"), F.explode(two).alias("x")).select("question", "x.*")


def people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("commune"), "c_nationkey", age_bucket(F.col("c_custkey") % 70 + 15, "survey").alias("age"))


def lineage(spark, d):
    rows = V.lineage(people(spark, d), {"town_age": ["commune", "age"], "town": ["commune"]}, "chunk_id")
    return rows.withColumn("collection", F.when(F.col("view_name") == "town_age", "raptor_summaries").otherwise("raptor_quanti_summaries"))


def metrics(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part").select("p_partkey")
    configs = F.explode(F.array(F.lit("plain"), F.lit("views"))).alias("config")
    ordered = people(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("chunk_id"))).where("k <= 20")  # twenty rows of each of 25 nations
    found = part.join(F.broadcast(ordered), (F.col("c_nationkey") == k % 25) & (F.col("k") <= k % 6 * 4)).select(k.alias("question"), "chunk_id", configs)
    c = F.col("chunk_id") % 4
    category = F.when(c == 0, "verbatims").when(c == 1, "entretiens").when(c == 2, "unknown").when(F.col("config") == "views", "raptor_portrait").otherwise("stats_enquete")
    asked = tokens(spark, d)
    return T.token_metrics(part.select(k.alias("question"), configs), found.withColumn("category", category), asked, T.token_pools(asked, lineage(spark, d)), with_views=["views"])


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(rules, key, otherwise="[]::varchar[]"):
    return f"case {key} " + " ".join(f"when '{k}' then {_list(v)}" for k, v in rules.items()) + f" else {otherwise} end"


METRICS = f"""{DATA}, sizes as (select collection, commune, age, count(*) as n_pool from pools group by all),
cats as (select r.question, r.config, count(category) as n_found, coalesce(list_distinct(list(category) filter (where category is not null)), []) as cats from runs r left join retrieved f on f.question = r.question and f.config = r.config group by 1, 2),
kinds as (select *, case when type = 'raptor' then 'raptor:' || collection else type end as kind from tokens),
shared as (select f.question, f.config, k.collection, k.commune, k.age, count(distinct f.chunk_id) as n_shared from retrieved f join kinds k on k.question = f.question and k.type = 'raptor'
  join pools p on p.collection = k.collection and p.commune = k.commune and p.age is not distinct from k.age and p.chunk_id = f.chunk_id group by all),
each as (select c.*, k.type, k.kind, k.optional, n_pool, coalesce(n_shared, 0) as n_shared from cats c join kinds k on k.question = c.question
  left join sizes s on s.collection = k.collection and s.commune = k.commune and s.age is not distinct from k.age
  left join shared h on h.question = c.question and h.config = c.config and h.collection = k.collection and h.commune = k.commune and h.age is not distinct from k.age),
judged as (select *, case when type = 'raptor' and config <> 'views' then case when n_pool is not null then n_shared / n_pool::double >= 0.3 else list_has_any(cats, {_case(T.INSTEAD, 'kind')}) end else list_has_any(cats, {_case(T.SATISFY, 'kind')}) end as ok,
  not optional and type <> 'rien' as need, case when type = 'rien' then [] else {_case(T.RIGHT, 'type', _case(T.SATISFY, 'kind'))} end as ri from each),
by_run as (select question, config, any_value(n_found) as n_found, any_value(cats) as cats, bool_or(type = 'rien') as is_refusal, count_if(need) as n_required, count_if(need and ok) as n_hits, flatten(list(ri)) as ri from judged group by 1, 2),
raw as (select *, case when not is_refusal and n_required > 0 then n_hits / n_required::double end as r, case when not is_refusal and n_required > 0 and len(cats) > 0 then len(list_intersect(cats, ri)) / greatest(len(list_filter(cats, lambda x: x <> 'unknown')), 1)::double end as p from by_run),
metrics as (select question, config, round(r, 3) as recall, round(p, 3) as precision, case when r + p > 0 then round(2 * p * r / (r + p), 3) end as f1, is_refusal, case when is_refusal then (n_found = 0)::int end as tnrr,
  case when is_refusal then 0 else n_required end::bigint as n_required, case when is_refusal then 0 else n_hits end::bigint as n_hits from raw)"""


@query("join15_token_pools", f"with {DATA} select collection || '|' || commune || '||' || coalesce(age, '') as token_key, count(*) as n_pool from pools group by 1")
def join15_pools(spark, d):
    return T.token_pools(tokens(spark, d), lineage(spark, d)).groupBy("token_key").agg(F.count("*").alias("n_pool"))


@query("eva3_token_metrics", f"with {METRICS} select * from metrics")
def eva3_tokens(spark, d):
    return metrics(spark, d)


@query("eva5_token_means", f"with {METRICS}, s as (select *, question % 5 as section, question % 10 as subsection from metrics) select config, section, subsection, count(*) as n, count(recall) as n_scored, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(f1), 6) as f1, round(avg(tnrr), 6) as tnrr, grouping_id(config, section, subsection)::bigint as level from s group by grouping sets ((config), (config, section), (config, section, subsection))")
def eva5_tokens(spark, d):
    m = metrics(spark, d).withColumns({"section": F.col("question") % 5, "subsection": F.col("question") % 10})
    return T.metric_means(m, [["config"], ["config", "section"], ["config", "section", "subsection"]])
