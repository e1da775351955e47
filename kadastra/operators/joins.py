"""Lookups with key variants, dictionary matches, fan-outs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra.operators.storage import cut_lineage, merged


def code_by_variants(rows: DataFrame, codes: DataFrame, key: str, variants: Sequence[Callable[[Column], Column]], code: str = "code") -> DataFrame:
    """`rows` with the code of the first key variant that has one."""
    out = rows
    for i, v in enumerate(variants):
        side = codes.select(F.col(key).alias(f"_k{i}"), F.col(code).alias(f"_c{i}")).dropDuplicates([f"_k{i}"])
        out = out.withColumn(f"_v{i}", v(F.col(key))).join(side, F.col(f"_v{i}") == F.col(f"_k{i}"), "left")
    return out.withColumn(code, F.coalesce(*(F.col(f"_c{i}") for i in range(len(variants))))).drop(*(f"_{x}{i}" for x in "kcv" for i in range(len(variants))))


def dictionary_matches(rows: DataFrame, names: DataFrame, key: str, text: Column, *, name: str = "name", longest: bool = True) -> DataFrame:
    """(key, name) for all names whose words stand in a row's text; with `longest`, one per row.

    Texts are cut into word runs as long as the longest name and met with the dictionary by equality, so the
    work grows with the texts and not with texts x names.
    """
    most = names.agg(F.max(F.size(F.split(name, r"[\s'-]+")))).first()[0] or 1
    tokens = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    runs = rows.select(key, tokens.alias("_t")).select(key, "_t", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("_n")).where(F.size("_t") >= F.col("_n"))
    grams = runs.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("_t") - F.col("_n") + 1), lambda i: F.array_join(F.slice("_t", i, F.col("_n")), " "))).alias("_g")).distinct()
    known = names.select(F.col(name), F.array_join(F.split(name, r"[\s'-]+"), " ").alias("_g")).distinct()
    hits = grams.join(known, "_g").select(key, name)
    if not longest:
        return hits
    w = Window.partitionBy(key).orderBy(F.char_length(name).desc(), name)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def evidence(summaries: DataFrame, chunks: DataFrame, ids: str, k: int, *, key: str = "chunk_id") -> DataFrame:
    """Summaries beside the chunks of their first k ids, in list order."""
    first = summaries.select(*(c for c in summaries.columns if c != ids), F.posexplode(F.slice(ids, 1, k)).alias("pos", key))
    return first.join(chunks, key)


def text_candidates(parts: DataFrame, wholes: DataFrame, *, gram: int = 8) -> DataFrame:
    """(p, w): pairs of parts (p, text) and wholes (w, text), among them every one whose part lies in its whole. Empty texts are in none.

    A whole shows all its runs of `gram` characters, and those as long as shorter parts are. A part must show all its own there, so the one that the fewest wholes
    show is enough to meet them by, and a part with a run that no whole shows meets none. Phrases that most texts share so bring no pairs,
    as long as a text has anything else. Runs carry ids only, not texts.
    """
    sizes = sorted(r[0] for r in parts.where(F.char_length("text") > 0).select(F.least(F.char_length("text"), F.lit(gram)).alias("n")).distinct().collect())  # 1 to `gram`
    if not sizes:
        return parts.select("p").limit(0).crossJoin(wholes.select("w").limit(0))

    def runs(n: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("text") - n + 1)), lambda i: F.substring("text", i, n))
        return F.when(F.char_length("text") >= n, every).otherwise(F.array().cast("array<string>"))

    shown = wholes.select("w", F.explode(F.array_distinct(F.flatten(F.array(*(runs(F.lit(n)) for n in sizes))))).alias("g"))
    counts = merged(shown.groupBy("g").agg(F.count("*").alias("n")))
    own = parts.where(F.char_length("text") > 0).select("p", F.explode(F.array_distinct(runs(F.least(F.char_length("text"), F.lit(gram))))).alias("g"))
    rarest = own.join(counts, "g", "left").groupBy("p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x")).where("x.n > 0")
    return rarest.select("p", F.col("x.g").alias("g")).join(merged(shown), "g").select("p", "w")


def all_or_text(rows: DataFrame, known: DataFrame, question: str, value: str, order: str, *, gram: int = 8) -> DataFrame:
    """`rows` with the value of the equal known question, else of the first by `order` that holds or is held by it.

    Equality is of trimmed texts, holding is of lower-cased ones; the empty question is held by every other. Rows with a null
    question get null, as do those that nothing matches; known nulls match nothing. Different questions meet known ones
    by the rarest run of characters of the shorter (text_candidates), and each pair is then tested. The work grows with texts and matches, not with their product.
    """
    asked = cut_lineage(rows.select(F.trim(question).alias("_q")).where("_q is not null").distinct().withColumns({"_low": F.lower("_q"), "_a": F.monotonically_increasing_id()}))
    k = known.where(F.col(question).isNotNull()).select(F.col(question).alias("_k"), F.lower(question).alias("_klow"), F.col(value).alias("_v"), F.col(order).alias("_o"))
    k = cut_lineage(k.withColumn("_b", F.monotonically_increasing_id()))
    side = lambda df, i, text, name: df.select(F.col(i).alias(name), F.col(text).alias("text"))
    held = text_candidates(side(asked, "_a", "_low", "p"), side(k, "_b", "_klow", "w"), gram=gram).select(F.col("p").alias("_a"), F.col("w").alias("_b"))
    holds = text_candidates(side(k, "_b", "_klow", "p"), side(asked, "_a", "_low", "w"), gram=gram).select(F.col("w").alias("_a"), F.col("p").alias("_b"))
    met = held.unionByName(holds).join(merged(asked), "_a").join(merged(k), "_b").where(F.contains("_klow", F.col("_low")) | F.contains("_low", F.col("_klow")))
    first = lambda df: F.broadcast(df.agg(F.min(F.struct("_o", "_k", "_v")).alias("x")).where("x is not null").select("x.*"))  # noqa: E731  one row
    pairs = [
        asked.join(merged(k), F.col("_q") == F.col("_k")).withColumn("_tier", F.lit(0)), met.withColumn("_tier", F.lit(1)),
        asked.where("_low = ''").crossJoin(first(k)).withColumn("_tier", F.lit(1)), asked.crossJoin(first(k.where("_klow = ''"))).withColumn("_tier", F.lit(1)),
    ]
    every = None
    for x in pairs:
        x = x.select("_q", "_tier", "_o", "_k", "_v")
        every = x if every is None else every.unionByName(x)
    best = every.groupBy("_q").agg(F.min(F.struct("_tier", "_o", "_k", "_v"))["_v"].alias(value))
    return rows.join(merged(best), F.trim(question) == F.col("_q"), "left").drop("_q")
