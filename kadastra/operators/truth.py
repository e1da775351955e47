"""Retrieval scored against tokens of a ground truth: categories, pools of evidence behind views, refusals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.functions.columns import f1, fold
from kadastra.operators.storage import merged

#: The categories of which one satisfies a token of the type, view tokens by collection.
SATISFY = {
    "oppchovec": ["oppchovec"],
    "entretiens": ["entretiens", "raptor_portrait"],
    "verbatims": ["verbatims", "entretiens", "raptor_portrait"],
    "stats_enquete": ["stats_enquete", "stats_repondants", "raptor_enquete"],
    "stats_repondants": ["stats_repondants"],
    "methodology": ["methodology", "oppchovec"],
    "classement": ["classement", "oppchovec"],
    "wiki": ["wiki"],
    "equipements": ["equipements", "epci"],
    "epci": ["epci", "equipements"],
    "raptor:raptor_summaries": ["raptor_portrait"],
    "raptor:raptor_quanti_summaries": ["raptor_enquete"],
    "raptor:both": ["raptor_portrait", "raptor_enquete"],
}
#: As above for a view token without any view behind it, where a configuration has no views.
INSTEAD = {
    "raptor:raptor_summaries": ["entretiens", "verbatims", "raptor_portrait"],
    "raptor:raptor_quanti_summaries": ["stats_enquete", "stats_repondants", "raptor_enquete"],
    "raptor:both": ["entretiens", "verbatims", "stats_enquete", "raptor_portrait", "raptor_enquete"],
}
#: The categories that a token of the type makes right to retrieve, where they are not those above.
RIGHT = {
    "entretiens": ["entretiens", "verbatims", "raptor_portrait"],
    "verbatims": ["entretiens", "verbatims", "raptor_portrait"],
    "raptor": ["raptor_portrait", "raptor_enquete", "entretiens", "verbatims", "stats_enquete"],
}
#: Share of a view's evidence that stands for the view where a configuration has none.
SHARE = 0.3
#: Parts into which the questions that ask for one token are dealt.
SPREAD = 64


def _looked_up(table: dict[str, list[str]], key: Column) -> Column:
    """The list of `key`, empty for keys that aren't there."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.array().cast("array<string>"))


def token_key(collection: str = "collection", named: Sequence[str] = ("commune", "csp", "age")) -> Column:
    """What a view token asks for, as one string."""
    return F.concat_ws("|", F.coalesce(collection, F.lit("both")), *(F.coalesce(c, F.lit("")) for c in named))


def token_pools(tokens: DataFrame, lineage: DataFrame, named: Sequence[str] = ("commune", "csp", "age")) -> DataFrame:
    """(token_key, chunk_id): the evidence of all views that a view token means, once each.

    A view (collection, view_name, dim1_value, dim2_value, chunk_id rows) is meant if every value that the token
    names is part of one of its dimensions' values, accents and case aside; a token of "both" means every
    collection. The containment is tested between distinct values only; views and evidence are met by equality.
    """
    asked = tokens.where("type = 'raptor'").select(token_key(named=named).alias("token_key"), F.coalesce("collection", F.lit("both")).alias("asked"), F.array_distinct(F.array_compact(F.array(*(fold(F.trim(c)) for c in named)))).alias("wants")).distinct()
    views = lineage.select("collection", "view_name", "dim1_value", "dim2_value").distinct()
    view = [F.col(c) for c in ("collection", "view_name")] + [F.coalesce(c, F.lit("")).alias(c) for c in ("dim1_value", "dim2_value")]
    views = views.select(*view)
    here = (F.col("asked") == "both") | (F.col("asked") == F.col("collection"))
    values = asked.select(F.explode("wants").alias("want")).distinct()
    dims = views.select(F.explode(F.array("dim1_value", "dim2_value")).alias("dim")).distinct()
    near = dims.join(values, F.contains(fold(F.col("dim")), F.col("want")))
    parts = views.withColumn("dim", F.explode(F.array_distinct(F.array("dim1_value", "dim2_value")))).join(near, "dim")
    names = ["collection", "view_name", "dim1_value", "dim2_value"]
    hits = asked.select("token_key", "asked", F.size("wants").alias("n"), F.explode("wants").alias("want")).join(parts.select(*names, "want").distinct(), "want").where(here)
    meant = hits.groupBy("token_key", "n", *names).agg(F.count("*").alias("k")).where("k = n").select("token_key", *names)
    free = asked.where(F.size("wants") == 0).select("token_key", "asked").join(views, here).select("token_key", *names)
    evidence = lineage.select(*view, "chunk_id")
    return meant.unionByName(free).join(merged(evidence), names).select("token_key", "chunk_id").distinct()


def token_metrics(runs: DataFrame, retrieved: DataFrame, tokens: DataFrame, pools: DataFrame, *, with_views: Sequence[str], share: float = SHARE, digits: int = 3) -> DataFrame:
    """(question, config, recall, precision, f1, is_refusal, tnrr, n_required, n_hits) for each run.

    runs (question, config); retrieved (question, config, category, chunk_id); tokens (question, type, collection,
    commune, csp, age, optional); pools as by `token_pools`. Recall is the share of the required tokens that are
    satisfied. Configurations in `with_views` satisfy a view token by category; the others if they have at least
    `share` of the evidence behind the view, or by another category where no view is meant. Precision is the
    share of the retrieved categories that some token makes right, "unknown" not counting among them. A
    question whose truth is "rien" is a refusal: no scores, tnrr 1 if nothing was retrieved. f1 is null if both are 0.

    Lists of retrieved rows are k for each run, so meeting them with the tokens of their question stays small;
    evidence is met by equality and counted before anything is joined on. Every side grows with its table, so none is broadcast.
    """
    kind = F.when(F.col("type") == "raptor", F.concat(F.lit("raptor:"), F.coalesce("collection", F.lit("both")))).otherwise(F.col("type"))
    toks = tokens.select("question", "type", kind.alias("kind"), token_key().alias("token_key"), F.coalesce("optional", F.lit(False)).alias("optional"))
    run = ["question", "config"]
    cats = runs.join(merged(retrieved.groupBy(*run).agg(F.count("*").alias("n_found"), F.collect_set("category").alias("cats"))), run, "left").withColumns({"n_found": F.coalesce("n_found", F.lit(0)), "cats": F.coalesce("cats", F.array().cast("array<string>"))})
    asked = toks.where("type = 'raptor'").select("question", "token_key").distinct()
    shared = retrieved.where("chunk_id is not null").select(*run, "chunk_id").distinct().join(merged(asked), "question").join(merged(pools), ["token_key", "chunk_id"]).groupBy(*run, "token_key").agg(F.count("*").alias("n_shared"))
    sizes = pools.groupBy("token_key").agg(F.count("*").alias("n_pool"))
    # popular tokens are dealt out in SPREAD parts, narrow rows of view tokens only; all other tokens would be one key
    part = F.pmod(F.xxhash64("question"), F.lit(SPREAD)).alias("_part")
    sized = asked.select("*", part).join(merged(sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("_part"))), ["token_key", "_part"]).drop("_part")
    each = cats.join(merged(toks), "question").join(merged(sized), ["question", "token_key"], "left").join(merged(shared), [*run, "token_key"], "left")
    has = lambda table: F.arrays_overlap("cats", _looked_up(table, F.col("kind")))
    by_evidence = F.when(F.col("n_pool").isNotNull(), F.coalesce("n_shared", F.lit(0)) / F.col("n_pool") >= share).otherwise(has(INSTEAD))
    ok = F.when((F.col("type") == "raptor") & ~F.col("config").isin(list(with_views)), by_evidence).otherwise(has(SATISFY))
    need = ~F.col("optional") & (F.col("type") != "rien")
    right = F.when(F.col("type").isin(list(RIGHT)), _looked_up(RIGHT, F.col("type"))).otherwise(_looked_up(SATISFY, F.col("kind")))
    by = each.groupBy(*run, "n_found", "cats").agg(
        F.bool_or(F.col("type") == "rien").alias("is_refusal"), F.count_if(need).alias("n_required"), F.count_if(need & ok).alias("n_hits"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("type") != "rien", right)))).alias("right"),
    )
    scored = ~F.col("is_refusal") & (F.col("n_required") > 0)
    recall = F.when(scored, F.col("n_hits") / F.col("n_required"))
    useful = F.size(F.array_intersect("cats", "right")) / F.greatest(F.size(F.array_except("cats", F.array(F.lit("unknown")))), F.lit(1))
    precision = F.when(scored & (F.size("cats") > 0), useful)
    return by.select(
        *run, F.round(recall, digits).alias("recall"), F.round(precision, digits).alias("precision"), F.round(f1(precision, recall, None), digits).alias("f1"), "is_refusal",
        F.when(F.col("is_refusal"), (F.col("n_found") == 0).cast("int")).alias("tnrr"),
        F.when(F.col("is_refusal"), F.lit(0)).otherwise(F.col("n_required")).cast("long").alias("n_required"), F.when(F.col("is_refusal"), F.lit(0)).otherwise(F.col("n_hits")).cast("long").alias("n_hits"),
    )


def metric_means(metrics: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Means of recall, precision, f1 and tnrr with the number of scored rows, for every level of columns in one pass."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    return metrics.groupingSets([[F.col(c) for c in level] for level in levels], *map(F.col, names)).agg(
        F.count("*").alias("n"), F.count("recall").alias("n_scored"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "f1", "tnrr")), F.grouping_id().cast("long").alias("level")
    )
