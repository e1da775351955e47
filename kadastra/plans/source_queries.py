"""Sources, sinks and streaming of the inventory; files are written from the given tables to the shared folder first."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadastra.plans.registry import query
from kadastra.operators.storage import shared_root
from kadastra.plans.stand_ins import SURVEY, survey, table
from kadastra.sources import files as X
from kadastra.streaming.live_views import live_views
from kadastra.streaming.refresh import refreshed_view, windowed_counts


def shared(spark) -> str:
    """A new folder in the one that the executors share."""
    root = shared_root(spark)
    return f"{root.rstrip('/')}/files-{uuid4().hex}"


@query("src1_csv_survey", "select o_orderkey as id, o_orderpriority as label, o_custkey as person from orders where o_orderkey not in (8, 10)")
def src1(spark, d):
    at = shared(spark)
    X.export(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("person"), F.lit("x").alias("Unnamed: 3")), at)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("person", T.LongType()), T.StructField("Unnamed: 3", T.StringType())])
    return X.read_survey(spark, at, schema, exclude=F.col("id").isin(8, 10))


@query("src2_latin1", "select c_custkey as id, c_name || 'é' as name from customer")
def src2(spark, d):
    at = shared(spark)
    table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat("c_name", F.lit("é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(at)
    return X.read_survey(spark, at, T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]), encoding="ISO-8859-1")


@query("src3_src4_folder", "select s_name as commune, s_suppkey::int as num, 'text of ' || s_name as text from supplier")
def src3(spark, d):
    at = shared(spark)
    s = table(spark, d, "supplier").select(F.concat(F.lit("entretien_"), "s_name", F.lit("_"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("text of "), "s_name").alias("text"))
    X.write_files(s, at)
    texts = X.read_folder(spark, at, "interviews").withColumn("name", F.url_decode("name"))
    return X.interview_names(texts).select("commune", "num", "text")


@query("src5_blocks", "select c_name as name, 'short ' || c_custkey as summary, 'long ' || c_custkey as description from customer")
def src5(spark, d):
    at = shared(spark)
    block = F.concat(F.lit("### "), "c_name", F.lit("\nRésumé : short "), F.col("c_custkey").cast("string"), F.lit("\nDescription : long "), F.col("c_custkey").cast("string"), F.lit("\n---"))
    table(spark, d, "customer").select(block.alias("value")).write.text(at)
    return X.read_blocks(spark, at)


@query("src6_keyed_lines", "select 'Town ' || c_custkey as key, 'La commune de Town ' || c_custkey || ' compte 5 parcs.' as text from customer")
def src6(spark, d):
    at = shared(spark)
    table(spark, d, "customer").select(F.concat(F.lit("La commune de Town "), F.col("c_custkey").cast("string"), F.lit(" compte 5 parcs.")).alias("value")).write.text(at)
    return X.keyed_lines(spark, at)


@query("src7_interview_turns", "select 'C' || conv_id as commune, (conv_id % 9)::int as num, t.turn::int as turn, t.role, t.txt as text from (select distinct conv_id from conversations), (values (0, 'Q', 'why?'), (1, 'R', 'because')) t(turn, role, txt)")
def src7(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    text = F.format_string("intro\n### Commune : C%d | Entretien %d\nQ: why?\nR: because\n", "conv_id", (F.col("conv_id") % 9).cast("int"))
    return X.interview_turns(X.interviews(c.select(text.alias("text"))))


@query("src7_conversations", "select 'C ' || conv_id as commune, (conv_id % 9)::int as num, (row_number() over (partition by conv_id order by turn) - 1)::int as turn, case role when 'user' then 'Q' else 'R' end as role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text from conversations")
def src7_conversations(spark, d):
    """Transcripts made of the conversations' whole texts, a file's text for each, parsed again."""
    c = table(spark, d, "conversations")
    said = F.struct("turn", F.concat(F.when(F.col("role") == "user", F.lit("Q: ")).otherwise(F.lit("R : ")), "text", F.lit("\n")).alias("line"))
    lines = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["line"]), "").alias("body"))
    head = F.format_string("preface\n### Commune : C %d | Entretien %d\n", F.col("conv_id"), (F.col("conv_id") % 9).cast("int"))
    return X.interview_turns(X.interviews(lines.select(F.concat(head, "body").alias("text"))))


@query("src8_features", "select 'sq' || c_custkey as nom, 1::int as n_rings, 5::int as n_points from customer")
def src8(spark, d):
    at = shared(spark)
    feature = F.format_string('{"type":"FeatureCollection","features":[{"properties":{"nom":"sq%d"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}}]}', F.col("c_custkey"))
    table(spark, d, "customer").select(feature.alias("value")).write.text(at)
    f = X.read_features(spark, at, ["nom"], multi_line=False)
    return f.select("nom", F.size("rings").alias("n_rings"), F.size(F.col("rings")[0]).alias("n_points"))


@query("src9_triples", "select 'ex:n' || c_custkey as s, 'rdfs:label' as p, c_name as o, 'fr' as lang from customer")
def src9(spark, d):
    line = F.concat(F.lit("<http://ex.org/n"), F.col("c_custkey").cast("string"), F.lit('> <http://www.w3.org/2000/01/rdf-schema#label> "'), "c_name", F.lit('"@fr .'))
    prefixes = spark.createDataFrame([("http://ex.org/", "ex"), ("http://www.w3.org/2000/01/rdf-schema#", "rdfs")], "namespace string, prefix string")
    return X.triples(table(spark, d, "customer").select(line.alias("value")), prefixes)


@query("src10_question_flags", "select item_id, item_id % 2 = 0 as do_factual, item_id % 3 = 0 as do_judge from benchmark where item_id % 5 <> 0")
def src10(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, " ").otherwise(F.col("text")).alias("question"), F.when(F.col("item_id") % 2 == 0, "x ").alias("do_factual"), F.when(F.col("item_id") % 3 == 0, "X").otherwise("").alias("do_judge"))
    return X.flags(b, ["do_factual", "do_judge"]).select("item_id", "do_factual", "do_judge")


@query("src11_run_results", "select c.config, c_custkey::int as excel_row, c_name as answer from customer, (values ('k10'), ('k25')) c(config)")
def src11(spark, d):
    at = shared(spark)
    one = F.format_string('{"excel_row":%d,"answer":"%s"}', "c_custkey", "c_name")
    table(spark, d, "customer").select(F.concat(F.lit('{"k10":['), one, F.lit('],"k25":['), one, F.lit("]}")).alias("value")).write.text(at)
    entry = T.StructType([T.StructField("excel_row", T.IntegerType()), T.StructField("answer", T.StringType())])
    return X.read_results(spark, at, entry, by_line=True)


@query("src12_scores", "select p_partkey, (p_size / 2.0)::double as h, p_size::double as j from part where p_partkey % 4 <> 0")
def src12(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.regexp_replace((F.col("p_size") / 2).cast("string"), r"\.", ",")).alias("h"), F.col("p_size").alias("j"))
    return X.scores(p, ["h", "j"])


@query("src13_grouped_texts", "select o_orderkey // 50 as block, count(*) as n, string_agg(o_orderpriority, chr(10) order by o_orderkey) as text from orders group by 1")
def src13(spark, d):
    o = X.blocks_of(table(spark, d, "orders"), "o_orderkey", 50)
    return X.group_texts(o, "block", "o_orderpriority", "o_orderkey")


@query("src14_row_texts", "select s_suppkey, 's_name: ' || s_name || chr(10) || 's_nationkey: ' || s_nationkey as text from supplier")
def src14(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", X.row_text(["s_name", "s_nationkey"]).alias("text"))


@query("snk1_texts_by_town", f"with {SURVEY} select commune, count(*) as n from survey group by 1")
def snk1(spark, d):
    at = shared(spark)
    X.write_texts(survey(spark, d).select("commune", F.col("label").alias("text")), at)
    return spark.read.text(at).groupBy("commune").agg(F.count("*").alias("n"))


@query("snk2_exports", "select c_name, c_nationkey, '| ' || c_name || ' | ' || c_nationkey || ' |' as line from customer")
def snk2(spark, d):
    at = shared(spark)
    n = table(spark, d, "customer").select("c_name", "c_nationkey")
    X.export(n, at, "json")
    back = spark.read.schema(n.schema).json(at)
    line = X.markdown_rows(back.select("c_name", "c_nationkey"), ["c_name", "c_nationkey"])
    return line.select(F.trim(F.split_part("line", F.lit("|"), F.lit(2))).alias("c_name"), F.trim(F.split_part("line", F.lit("|"), F.lit(3))).cast("int").alias("c_nationkey"), "line")


@query("str1_refreshed_view", "select event_type, count(*) as n, avg(user_id) as avg_score from events group by 1")
def str1(spark, d):
    at = shared(spark)
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("score"), "event_id")
    e.withColumn("slice", (F.col("event_id") % 3)).repartition("slice").drop("slice").write.parquet(f"{at}/in")
    return refreshed_view(spark, f"{at}/in", e.schema, ["event_type"], f"{at}/state")


@query("str1_windowed_counts", "select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n from events group by 1, 2")
def str1_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"]).select("event_type", F.col("window.start").alias("start"), "n")


#: What a user did last in each hour of the day; an error takes it out.
LIVE = {"all": [], "by_type": ["event_type"], "by_hour": ["hour"], "type_hour": ["event_type", "hour"]}


@query("str1_live_views", """with e as (select user_id, hour(ts) as hour, event_type, value from events qualify row_number() over (partition by user_id, hour(ts) order by event_id desc) = 1), l as (select * from e where event_type <> 'error'),
s as (select case grouping(event_type, hour) when 3 then 'all' when 1 then 'by_type' when 2 then 'by_hour' else 'type_hour' end as view_name, event_type, hour, count(*) as n, count(distinct user_id) as n_persons, round(sum(round(value * 1000000)) / count(value) / 1000000, 9) as avg_score from l group by grouping sets ((), (event_type), (hour), (event_type, hour)))
select view_name, case view_name when 'by_hour' then hour::varchar else coalesce(event_type, '') end as dim1_value, case view_name when 'type_hour' then hour::varchar else '' end as dim2_value, n, n_persons, avg_score from s where n >= 5""")
def str1_live(spark, d):
    at = shared(spark)
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e.repartitionByRange(3, "event_id").write.parquet(f"{at}/in")
    hour = F.hour("ts").cast("string")
    rows = lambda s: s.select(F.concat_ws("|", F.col("user_id").cast("string"), hour).alias("id"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), "event_type", hour.alias("hour"), F.col("user_id").alias("person"), F.col("value").alias("score"))
    third = -(-len(spark.read.parquet(f"{at}/in").inputFiles()) // 3)
    live = live_views(spark, f"{at}/in", e.schema, LIVE, f"{at}/live", prepare=rows, least=5, files=third)
    return live.view().withColumn("avg_score", F.round("avg_score", 9))


@query("prj5_prj7_documents", f"with {SURVEY} select commune, 'Commune ' || commune || ': ' || count(*) || ' respondents, happiness ' || round(sum(happiness) * 1.0::double / count(*), 1) as doc from survey group by 1")
def prj57(spark, d):
    s = survey(spark, d).groupBy("commune").agg(F.count("*").alias("n"), F.round(F.sum("happiness") / F.count("*"), 1).alias("h"))
    return s.select("commune", F.concat(F.lit("Commune "), "commune", F.lit(": "), F.col("n").cast("string"), F.lit(" respondents, happiness "), F.col("h").cast("string")).alias("doc"))
