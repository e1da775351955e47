"""The reference's tables as views of the given ones, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.functions.columns import age_bucket, age_bucket_sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def geography(spark: SparkSession, d: str) -> DataFrame:
    """(commune, epci): towns and the group each belongs to."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("commune"), F.col("r_name").alias("epci"), "n_nationkey")


def survey(spark: SparkSession, d: str) -> DataFrame:
    """One row per respondent; towns are few, so their table is broadcast, customers are joined as Spark sees fit."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    g = geography(spark, d)
    s = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(g), F.col("c_nationkey") == F.col("n_nationkey"))
    dim = lambda e: F.concat(F.lit("D"), (e % 14).cast("string"))
    return s.select(
        F.col("o_orderkey").alias("respondent_id"), "commune", "epci", F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("genre"),
        (F.col("c_custkey") % 70 + 15).cast("int").alias("age"), age_bucket(F.col("c_custkey") % 70 + 15, "survey").alias("age_range"), F.col("c_mktsegment").alias("profession"),
        F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"), F.col("c_custkey").alias("person"),
        dim(F.col("o_orderkey")).alias("dimension"),
        F.concat_ws(";", dim(F.col("o_orderkey")), dim(F.expr("o_orderkey div 3")), dim(F.expr("o_orderkey div 7"))).alias("choices"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("happiness"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("life_quality"),
    )


SURVEY = f"""geography as (select n_name as commune, r_name as epci, n_nationkey from nation join region on n_regionkey = r_regionkey),
survey as (select o_orderkey as respondent_id, commune, epci, case when c_custkey % 2 = 0 then 'F' else 'M' end as genre, (c_custkey % 70 + 15)::int as age,
  {age_bucket_sql('(c_custkey % 70 + 15)', 'survey')} as age_range, c_mktsegment as profession, o_orderpriority as label, o_orderstatus as status, c_custkey as person,
  'D' || (o_orderkey % 14) as dimension, 'D' || (o_orderkey % 14) || ';D' || ((o_orderkey // 3) % 14) || ';D' || ((o_orderkey // 7) % 14) as choices,
  (o_custkey % 5 + 1)::int as happiness, (o_orderkey % 5 + 1)::int as life_quality
  from orders join customer on o_custkey = c_custkey join geography on c_nationkey = n_nationkey),
likert(label, score) as (values ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 2), ('5-LOW', 1)),
scored as (select s.*, score from survey s left join likert using (label))"""


def likert(spark: SparkSession) -> DataFrame:
    """(label, score): the five-step scale of the stand-in's labels."""
    rows = [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 2), ("5-LOW", 1)]
    return spark.createDataFrame(rows, "label string, score int")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return survey(spark, d).join(F.broadcast(likert(spark)), "label", "left")


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """(zone, total, opp, cho, vec): one row per part."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("zone"), F.col("p_brand").alias("epci"), F.col("p_retailprice").alias("total"), (F.col("p_size") % 10).cast("double").alias("opp"),
        (F.col("p_partkey") % 7).cast("double").alias("cho"), (F.col("p_partkey") % 11).cast("double").alias("vec"),
    )


INDICATORS = """indicators as (select p_partkey as zone, p_brand as epci, p_retailprice as total, (p_size % 10)::double as opp, (p_partkey % 7)::double as cho, (p_partkey % 11)::double as vec from part)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, text, source, lang): the documents as a collection."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")
