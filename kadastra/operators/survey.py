"""Respondents' answers: encoding, multi-choice shares, dimension scores, profiles, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode_labels(df: DataFrame, scale: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Each label's score by a small table (label, score); labels outside it are null."""
    return df.join(F.broadcast(scale.select(F.col("label").alias(label), F.col("score").alias(score))), label, "left")


def ordinal_columns(df: DataFrame, scales: dict[str, dict[str, int]]) -> dict[str, str]:
    """Columns all of whose values lie in a label set, with the first such set; one pass, at least one value.

    Only set membership is aggregated, so a column of free text costs one boolean.
    """
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    tests = [F.bool_and(F.col(c).isin(list(s)) | F.col(c).isNull()).alias(f"{c}\0{n}") for c in texts for n, s in scales.items()]
    known = [F.count(c).alias(f"{c}\0") for c in texts]
    row = df.agg(*tests, *known).first().asDict() if texts else {}
    return {c: next(n for n in scales if row[f"{c}\0{n}"]) for c in texts if row[f"{c}\0"] and any(row[f"{c}\0{n}"] for n in scales)}


def choice_shares(df: DataFrame, key: str, choices: str, sep: str = ";") -> DataFrame:
    """(key, choice, n, n_total, pct): picks of a separated list over all respondents of the key, nulls included."""
    total = df.groupBy(key).agg(F.count("*").alias("n_total"))
    picks = df.select(key, F.explode(F.split(choices, sep)).alias("choice")).select(key, F.trim("choice").alias("choice")).where("choice <> ''")
    return picks.groupBy(key, "choice").agg(F.count("*").alias("n")).join(total, key).withColumn("pct", F.col("n") * 100.0 / F.col("n_total"))


def means(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.avg(c).alias(f"avg_{c}") for c in columns))


def long_texts(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide texts as rows (ids, choice_no, verbatim), trimmed, blank ones and the word nan left out."""
    items = F.array(*(F.struct(F.lit(i + 1).alias("choice_no"), F.trim(c).alias("verbatim")) for i, c in enumerate(columns)))
    out = df.select(*ids, F.explode(items).alias("x")).select(*ids, "x.*")
    return out.where((F.col("verbatim") != "") & (F.lower("verbatim") != "nan"))


def dimension_scores(df: DataFrame, keys: Sequence[str], score: str = "score", least: int = 1) -> DataFrame:
    """(keys, n, avg_score): all known scores of a group pooled; groups with fewer are left out."""
    return df.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("avg_score")).where(F.col("n") >= least)


def mean_of_means(df: DataFrame, key: str, inner: str, score: str = "score") -> DataFrame:
    """Mean over the inner groups' means, with the count of each score 1 to 5."""
    by = df.groupBy(key, inner).agg(F.avg(score).alias("m"), *(F.count_if(F.col(score) == k).alias(f"s{k}") for k in range(1, 6)))
    return by.groupBy(key).agg(F.sum(F.col("m").cast("decimal(20,10)")).alias("total"), F.count("m").alias("parts"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(1, 6)))


def soft_label(label: Column, scale: Column, marker: str = "moyennement", middle: int = 3) -> Column:
    """The scale's score, and the middle for labels that hold the marker."""
    return F.coalesce(scale, F.when(F.contains(F.lower(label), F.lit(marker)), F.lit(middle)))


def profile_shares(df: DataFrame, key: str, facets: Sequence[str]) -> DataFrame:
    """(key, facet, value, n, share): distribution of each facet within the key, nulls left out."""
    rows = df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("x")).select(key, "x.*")
    by = rows.where("value is not null").groupBy(key, "facet", "value").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(key, "facet")))


def facet_counts(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n) for all facets in one pass; rows without a value are skipped."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("x")).select("x.*")
    return rows.where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group by `order`; Spark cuts groups to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def member_lists(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n_members, members): sorted names of a group, once each."""
    return df.select(key, member).distinct().groupBy(key).agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))


def match_rate(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(flag).alias("n_certain"), F.count_if(~F.col(flag)).alias("n_uncertain"))


def two_digits(value: Column) -> Column:
    """A number rounded half up to two digits, as text."""
    return F.format_string("%.2f", F.floor(value * 100 + 0.5) / 100)


def verbatim_sentences(df: DataFrame, text: str = "verbatim") -> DataFrame:
    """`df` with sentence: the verbatim after its author's gender, age, job, town and theme; unknown parts are left out."""
    known = F.concat_ws(", ", "genre", F.concat(F.col("age").cast("string"), F.lit(" ans")), F.concat(F.lit("("), "age_range", F.lit(")")), "profession", F.concat(F.lit("à "), "commune"))
    theme = F.concat(F.lit(" sur le thème "), "dimension")
    return df.withColumn("sentence", F.concat(F.lit("Verbatim de "), known, F.coalesce(theme, F.lit("")), F.lit(" : "), F.coalesce(text, F.lit(""))))


def town_documents(df: DataFrame, scores: DataFrame, key: str, means: Sequence[tuple[str, str]], choices: str, most: int = 3) -> DataFrame:
    """(key, n, doc): header, the global means, the mean of each dimension and the most cited dimensions of every town.

    `scores` are (key, dimension, avg_score). Parts without data are left out. Dimensions are a short list of their
    own, so what is gathered for a town doesn't grow with its respondents.
    """
    base = df.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m{i}") for i, (_, c) in enumerate(means)))
    one = F.struct("dimension", two_digits(F.col("avg_score")).alias("t"))
    listed = scores.where("avg_score is not null").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(x["dimension"], F.lit("="), x["t"])), ", ").alias("_dims"))
    cited = top_per(choice_shares(df, key, choices), [key], [F.col("n").desc(), F.col("choice")], most)
    cited = cited.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "choice"))), lambda x: x["choice"]), ", ").alias("_cited"))
    head = F.concat(F.lit("Scores of "), F.col(key), F.lit(" ("), F.col("n").cast("string"), F.lit(" respondents)."))
    lines = [F.concat(F.lit(f"Mean {name}: "), two_digits(F.col(f"_m{i}")), F.lit("/5.")) for i, (name, _) in enumerate(means)]
    parts = [head, *lines, F.concat(F.lit("By dimension: "), "_dims", F.lit(".")), F.concat(F.lit("Most cited: "), "_cited", F.lit("."))]
    return base.join(listed, key, "left").join(cited, key, "left").select(key, "n", F.concat_ws(" ", *parts).alias("doc"))
