"""Text operators over tables: typos, keyword classes, judge output, source cells, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra.functions import columns as C
from kadastra.functions import scales as N
from kadastra.functions.columns import fold


def within_one_edit(a: DataFrame, b: DataFrame, left: str, right: str, least: int = 5) -> DataFrame:
    """Pairs of words at one edit or none.

    Words at one edit are equal once a character is left out of either or of both, so both sides are keyed by
    all such forms and met by equality; the distance is verified.
    """

    def forms(df: DataFrame, c: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.char_length(c))))
        return df.select(c).where(F.char_length(c) >= (least if c == left else 1)).distinct().select(c, F.explode(F.array_distinct(F.concat(F.array(F.col(c)), cut))).alias("_f"))

    near = forms(a, left).join(forms(b, right), "_f").select(left, right).distinct()
    return near.where(F.levenshtein(left, right) <= 1)


def keyword_dimension(df: DataFrame, key: str, text: Column, classes: Sequence[tuple[str, Sequence[str]]], head: int = 30) -> DataFrame:
    """(key, dimension, hits, certain): 3 for a keyword among the first characters, else 1; the first class wins ties."""
    low, first = F.lower(text), F.lower(F.substring(text, 1, head))
    hits = []
    for i, (name, kws) in enumerate(classes):
        n = sum((F.when(F.contains(first, F.lit(k)), 3).when(F.contains(low, F.lit(k)), 1).otherwise(0) for k in kws), F.lit(0))
        hits.append(F.struct(n.cast("long").alias("hits"), F.lit(-i).alias("o"), F.lit(name).alias("dimension")))
    best = F.array_max(F.array(*hits))
    total = sum((h["hits"] for h in hits), F.lit(0))
    rows = df.select(key, best.alias("b"), total.alias("t"))
    return rows.select(key, F.col("b.dimension").alias("dimension"), F.col("b.hits").alias("hits"), ((F.col("t") > 0) & (F.col("b.hits") >= 0.5 * F.col("t"))).alias("certain"))


def judge_notes(df: DataFrame, js: str, dims: Sequence[str]) -> DataFrame:
    """note_<d> and justification_<d> of a judge's JSON, and the mean of the notes that are numbers."""
    schema = "struct<" + ",".join(f"{d}:struct<note:double,justification:string>" for d in dims) + ">"
    out = df.withColumn("_j", F.from_json(js, schema))
    for d in dims:
        out = out.withColumns({f"note_{d}": F.col(f"_j.{d}.note"), f"justification_{d}": F.col(f"_j.{d}.justification")})
    known = F.filter(F.array(*(F.col(f"note_{d}") for d in dims)), lambda x: x.isNotNull())
    return out.withColumn("global_note", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))).drop("_j")


def mislabelled(values: Column) -> tuple[Column, Column]:
    """The two rules on a map of remarks: any value that isn't a plain no; any value that begins with oui."""
    vs = F.transform(F.map_values(values), lambda v: F.trim(F.lower(v)))
    return F.exists(vs, lambda v: ~v.isin("non", "false", "no", "", "none")), F.exists(vs, lambda v: F.startswith(v, F.lit("oui")))


def parse_sources(cell: Column) -> Column:
    """Array of (content, meta) of a cell of lines `[n] content {key: value; ...}`."""
    line = r"\[\d+\]\s*(.*?)\s*\{([^}]*)\}"
    a, b = F.regexp_extract_all(cell, F.lit(line), F.lit(1)), F.regexp_extract_all(cell, F.lit(line), F.lit(2))
    return F.zip_with(a, b, lambda c, m: F.struct(c.alias("content"), F.str_to_map(m, F.lit("; "), F.lit(": ")).alias("meta")))


def format_sources(sources: Column, fields: int = 4, most: int = 2000) -> Column:
    """The inverse: the first fields of each map, the whole cut to `most` characters."""
    meta = lambda m: F.array_join(F.slice(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"])), 1, fields), "; ")
    rows = F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["content"], F.lit(" {"), meta(s["meta"]), F.lit("}")))
    return F.substring(F.array_join(rows, "\n"), 1, most)


def enrich(df: DataFrame, text: Column, terms: Sequence[tuple[str, Sequence[str]]], most: int = 5) -> DataFrame:
    """Column terms: sorted, at most `most` of the terms whose trigger the folded text has."""
    t = fold(text)
    found = F.concat(*(F.when(F.contains(t, F.lit(k)), F.array(*map(F.lit, vs))).otherwise(F.array().cast("array<string>")) for k, vs in terms))
    return df.withColumn("terms", F.slice(F.array_sort(F.array_distinct(found)), 1, most))


def enrich_by_ontology(
    df: DataFrame, text: str, keywords: Sequence[tuple[str, str]], labels: DataFrame, related: DataFrame, *, most: int = 5, words_each: int = 2, parts: Sequence[tuple[str, str, Sequence[tuple[str, str, Sequence[str]]]]] = N.INDICATOR_PARTS,
) -> DataFrame:
    """`df` with dimensions, indicators, terms and enriched: the text with at most `most` terms of what it names behind it.

    A text names the dimensions (uris) of the `keywords` (keyword, dimension) that its folded form holds, in their order, and the indicators of `parts` by their sign or a
    part's. Terms are the dimensions' labels (dimension, label), the first `most` labels of `related` (dimension, label) for each, the named parts' labels, and
    `words_each` of their words; they are sorted, as the least ones stay. A null text names nothing and stays null.

    What the dimensions bring is at most keywords x (most + 1) labels, whatever the ontology's size: one small row, sent to all tasks; the texts stay where they are.
    """
    wanted = sorted({d for _, d in keywords})
    of = lambda t: t.where(F.col("dimension").isin(wanted) & F.col("label").isNotNull()).select("dimension", "label")
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("label"))
    own = of(labels).groupBy("dimension").agg(F.min("label").alias("label"))
    more = of(related).distinct().withColumn("_at", place).where(F.col("_at") <= most).drop("_at")
    lists = own.unionByName(more).groupBy("dimension").agg(F.array_sort(F.collect_set("label")).alias("brings"))
    known = lists.agg(F.map_from_entries(F.collect_list(F.struct("dimension", "brings"))).alias("_known"))  # one row, of no dimension an empty map

    t = fold(F.col(text))
    names = F.array(*(F.struct(F.lit(d).alias("d"), fold(F.lit(k)).alias("k")) for k, d in keywords)) if keywords else F.array().cast("array<struct<d:string,k:string>>")
    dims = F.array_distinct(F.transform(F.filter(names, lambda x: F.contains(t, x["k"])), lambda x: x["d"]))
    nothing = F.array().cast("array<string>")
    holds = lambda sign: F.coalesce(F.contains(t, F.lit(sign)), F.lit(False))
    found, brought = [nothing], [nothing]
    for sign, label, inner in parts:
        named = holds(sign)
        for part, part_label, part_words in inner:
            here = holds(sign) | holds(part)
            named = named | here
            brought.append(F.when(here, F.array(*map(F.lit, (part_label, *part_words[:words_each])))).otherwise(nothing))
        found.append(F.when(named, F.array(F.lit(label))).otherwise(nothing))
    out = df.crossJoin(F.broadcast(known)).withColumns({"dimensions": F.coalesce(dims, nothing), "indicators": F.concat(*found)})
    by_dims = F.flatten(F.transform("dimensions", lambda d: F.coalesce(F.try_element_at("_known", d), nothing)))
    out = out.withColumn("terms", F.slice(F.array_sort(F.array_distinct(F.concat(by_dims, *brought))), 1, most))
    return out.withColumn("enriched", F.when(F.size("terms") > 0, F.concat(F.col(text), F.lit(" "), F.array_join("terms", " "))).otherwise(F.col(text))).drop("_known")


def tagged_union(parts: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def accept_pages(pages: DataFrame, text: str, rejected: Sequence[str], wanted: Sequence[str], group: str, order: Sequence[Column]) -> DataFrame:
    """Pages without a rejected phrase in the first 200 characters and with a wanted word; the first of each group."""
    head = F.substring(text, 1, 200)
    ok = F.lit(True)
    for r in rejected:
        ok = ok & ~F.contains(head, F.lit(r))
    has = F.lit(False)
    for w in wanted:
        has = has | F.contains(F.col(text), F.lit(w))
    rows = pages.where(ok & has).withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return rows.where("_rn = 1").drop("_rn")


def by_rules(rules: Sequence[tuple[Column, str]], other: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(other)
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def truth_tokens(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, Sequence[str]]], place: str, sep: str = ",") -> DataFrame:
    """(key, token, category, commune, optional): the comma tokens of a ground-truth cell; brackets mark optional ones."""
    from kadastra.functions.columns import first_keyword

    t = df.select(key, F.explode(F.split(text, sep)).alias("token")).select(key, F.trim("token").alias("token")).where("token <> ''")
    return t.select(key, "token", first_keyword(F.col("token"), rules).alias("category"), F.nullif(F.regexp_extract("token", place, 1), F.lit("")).alias("commune"), F.startswith("token", F.lit("(")).alias("optional"))


#: What a sub-query for scores begins with, and the themes behind each indicator.
SCORES = "scores indicateurs oppchovec"
INDICATOR_THEMES = (("vec", ("vécu", "logement", "santé", "insécurité")), ("opp", ("opportunités", "éducation", "mobilité", "connectivité")), ("chx", ("choix", "emploi", "transport")))
#: A town after "à"; names go on over further capitalised words.
TOWN = r"à\s+([A-ZÀ-Ža-zà-ž][a-zà-žA-ZÀ-Ž\-]+(?:\s+[A-ZÀ-Ža-zà-ž][a-zà-žA-ZÀ-Ž\-]+)*)"
#: What a verbatim without a choice is about.
UNNAMED = "Non spécifié"


def sub_queries(question: Column) -> Column:
    """Array of (sub, sub_query): the question for scores and the one for what people say.

    The first asks for the town's scores, or for scores at all. The second has the first two themes of the indicators that
    the question names by name or theme, and the town; without themes or town it is the question itself.
    """
    low, town = F.lower(question), F.regexp_extract(question, TOWN, 1)
    none = F.array().cast("array<string>")
    named = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    themes = F.concat(*(F.when(named((name, *words)), F.array(*map(F.lit, words))).otherwise(none) for name, words in INDICATOR_THEMES))
    people = F.when((F.size(themes) > 0) & (town != ""), F.concat_ws(" ", F.slice(themes, 1, 2), town)).otherwise(question)
    scores = F.when(town != "", F.concat_ws(" ", F.lit(SCORES), town)).otherwise(F.lit(SCORES))
    return F.array(F.struct(F.lit("quantitative").alias("sub"), scores.alias("sub_query")), F.struct(F.lit("qualitative").alias("sub"), people.alias("sub_query")))


def own_dimension(text: Column, choices: Column, place: Column, classes: Sequence[tuple[str, Sequence[str]]], head: int = 30) -> Column:
    """(dimension, hits, certain): which of a respondent's own choices a verbatim is about.

    Keywords count 3 among the first characters of the folded text, else 1. A choice is looked up among the classes by its folded name; one that is no
    class is its own keyword. The first of the best choices wins. Without any hit the choice at the verbatim's
    own `place` (from 1) is taken, uncertain; certain is at least half of all hits.
    """
    t = fold(text)
    first = F.substring(t, 1, head)
    points = lambda k: F.when(F.contains(first, k), 3).when(F.contains(t, k), 1).otherwise(0)
    words = F.create_map(*(x for name, ks in classes for x in (fold(F.lit(name)), F.transform(F.array(*map(F.lit, ks)), fold))))
    known = lambda c: F.coalesce(F.try_element_at(words, fold(c)), F.array(fold(c)))
    score = lambda c: F.aggregate(known(c), F.lit(0), lambda a, k: a + points(k))
    own = F.coalesce(F.array_distinct(choices), F.array().cast("array<string>"))
    scored = F.transform(own, lambda c, i: F.struct(score(c).alias("hits"), (-i).alias("o"), c.alias("dimension")))
    best, total = F.array_max(scored), F.aggregate(scored, F.lit(0), lambda a, x: a + x["hits"])
    by_place = F.coalesce(F.get(choices, place - 1), F.lit(UNNAMED))
    hit = F.coalesce(total > 0, F.lit(False))
    return F.struct(
        F.when(hit, best["dimension"]).otherwise(by_place).alias("dimension"), F.when(hit, best["hits"]).otherwise(0).cast("long").alias("hits"),
        F.when(hit, best["hits"] * 2 >= total).otherwise(False).alias("certain"),
    )


#: Phrases of a token of the second grammar and the type that each names, in the order in which they are tried.
TOKEN_TYPES = (
    ("raptor", ("raptor",)), ("entretiens", ("entretien",)), ("verbatims", ("verbatim",)), ("oppchovec", ("oppchovec", "opp chovec")), ("classement", ("classement",)), ("wiki", ("wiki",)), ("equipements", ("equipement",)),
    ("epci", ("epci",)), ("stats_repondants", ("stats repondant", "profil repondant")), ("stats_enquete", ("stats", "resultats enquete")), ("methodology", ("explication", "methodo")), ("stats_enquete", ("resume enquete", "donnees enquete")),
)
#: Phrases that make a token a refusal, and those that leave it open.
NOTHING, OPTIONAL = ("pas de donnee", "pas de data"), ("facultatif", "ou rien")
#: Phrases for views of interviews and of the survey.
VIEWS_OF_WORDS, VIEWS_OF_NUMBERS = ("quali", "portrait", "entretien"), ("quanti", "dimension", "global")
#: Words for a group of people and the value that the views have for it.
GROUPS = (
    ("entrepreneur", "entrepreneurs"), ("artisan", "artisans"), ("retraite", "retraités"), ("senior", "retraités"), ("etudiant", "étudiants"), ("jeune", "18-25"), ("25-", "25-34"), ("18-25", "18-25"), ("15-24", "15-24"),
)


def structured_tokens(df: DataFrame, key: str, text: str, towns: Sequence[str]) -> DataFrame:
    """(key, token, type, collection, commune, csp, age, optional): the comma tokens of a truth cell by the second grammar.

    A token's type is that of the first phrase it has, accents and case aside; a score of the survey is `stats_enquete`, an explanation of
    the index `methodology`. Views are of interviews, of numbers or of both. Towns are a short stated list, the longest that the token has is
    taken. Wiki tokens are always optional. Null and blank cells and tokens give no row.
    """
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("_t", w))
    cells = df.where(F.col(text).isNotNull() & ~F.lower(F.trim(text)).isin("", "nan", "none"))
    t = cells.select(key, F.explode(F.split(text, ",")).alias("token")).select(key, F.trim("token").alias("token"), fold(F.trim("token")).alias("_t")).where(~F.col("_t").isin("", "nan", "none"))
    by_phrase = F.coalesce(*(F.when(has(words), F.lit(name)) for name, words in TOKEN_TYPES[:9]), F.when(has(TOKEN_TYPES[9][1]) | (F.contains("_t", F.lit("score")) & F.contains("_t", F.lit("enquete"))), F.lit("stats_enquete")), *(F.when(has(words), F.lit(name)) for name, words in TOKEN_TYPES[10:]), F.lit("unknown"))
    kind = F.when(F.startswith("_t", F.lit("rien")) | has(NOTHING), "rien").otherwise(by_phrase)
    t = t.withColumn("type", kind).withColumn("type", F.when((F.col("type") == "oppchovec") & has(TOKEN_TYPES[10][1]), "methodology").otherwise(F.col("type")))
    words, numbers = has(VIEWS_OF_WORDS), has(VIEWS_OF_NUMBERS)
    told = F.col("type") != "rien"
    known = sorted(towns, key=lambda n: (-len(n), n))
    town = F.coalesce(*(F.when(F.contains("_t", fold(F.lit(n))), F.lit(n)) for n in known)) if known else F.lit(None).cast("string")
    return t.select(
        key, "token", "type",
        F.when(F.col("type") == "raptor", F.when(words & ~numbers, "raptor_summaries").when(numbers & ~words, "raptor_quanti_summaries").otherwise("both")).alias("collection"),
        F.when(told, town).alias("commune"), F.when(told, F.coalesce(*(F.when(F.contains("_t", F.lit(w)), F.lit(v)) for w, v in GROUPS))).alias("csp"),
        F.when(told, F.nullif(F.regexp_extract("token", r"([0-9]{2}[-–][0-9]{2,3})", 1), F.lit(""))).alias("age"),
        (told & (has(OPTIONAL) | (F.col("type") == "wiki") | F.col("_t").rlike(r"^wiki(\s|$)"))).alias("optional"),
    )


def question_filters(text: Column, dimensions: Sequence[tuple[str, Sequence[str]]], professions: Sequence[tuple[str, Sequence[str]]] = N.PROFESSIONS, genders: Sequence[tuple[str, Sequence[str]]] = N.GENDERS) -> dict[str, Column]:
    """age, genre, profession and dimension that a question asks for, and has_filter: whether it asks for any. Words are compared without accents; the longest counts."""
    found = {"age": C.age_filter(text), "genre": C.longest_keyword(text, genders), "profession": C.longest_keyword(text, professions), "dimension": C.longest_keyword(text, dimensions)}
    return found | {"has_filter": F.coalesce(*found.values()).isNotNull()}
