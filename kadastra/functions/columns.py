"""Column builders: cleaning, ages, levels, names, ids, tokens and dictionary matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and what they fold to.
ACCENTED = "àâäáãéèêëíìîïóòôöõúùûüçñÿ"
FOLDED = "aaaaaeeeeiiiiooooouuuucny"
#: Age schemes as (label, first age); the last has no end.
AGE_SCHEMES = {
    "survey": (("15-29", 15), ("30-44", 30), ("45-59", 45), ("60-74", 60), ("75+", 75)),
    "portrait": (("18-24", 0), ("25-34", 25), ("35-49", 35), ("50-64", 50), ("65+", 65)),
    "report": (("15-24", 0), ("25-34", 25), ("35-49", 35), ("50-64", 50), ("65+", 65)),
}
UNKNOWN_AGE = "Non spécifié"
#: Band tables as (least score, label), best first.
LEVELS = {
    "score": ((4.5, "très élevé"), (3.5, "moyen-fort"), (2.5, "moyen"), (1.5, "faible"), (float("-inf"), "très faible")),
    "indicator": ((7.5, "très élevé"), (5.0, "élevé"), (3.0, "moyen"), (1.5, "faible"), (float("-inf"), "très faible")),
    "stars": ((4.2, "✦✦ (fort)"), (3.3, "✦ (moyen-fort)"), (2.5, "→ (moyen)"), (float("-inf"), "↓ (faible)")),
}
#: Fixed value: the namespace of names in UUID version 5 (RFC 9562, URLs).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def clean(c: Column) -> Column:
    """Blank texts and the word nan become null."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def first_known(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*map(clean, columns))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, FOLDED)


def slug(c: Column, most: int = 30) -> Column:
    """Folded, other characters as underscores, cut to `most`."""
    return F.substring(F.regexp_replace(F.trim(fold(c)), "[^a-z0-9]+", "_"), 1, most)


def doc_id(view: Column, *values: Column) -> Column:
    """Id of a view's row: the view's name and the slugs of its dimension values that aren't null."""
    return F.concat_ws("__", view, *(slug(v) for v in values))


def camel_case(c: Column) -> Column:
    """Words put together, each with a capital."""
    return F.regexp_replace(F.initcap(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), " ", "")


def snake_case(c: Column) -> Column:
    """CamelCase names as upper-case words joined by underscores."""
    return F.upper(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID, version 5, of a name."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def age_number(c: Column) -> Column:
    """Age of a text: a number as it stands, one more after "plus de"; null for anything else."""
    more = F.regexp_extract(F.lower(c), r"plus de (\d+)", 1).try_cast("int") + 1
    return F.coalesce(more, F.trim(c).try_cast("double").cast("int"))


def age_bucket(age: Column, scheme: str = "portrait") -> Column:
    """The bucket of an age in one of the schemes; younger or unknown gives the label for unknown."""
    out = F.lit(UNKNOWN_AGE)
    for label, least in AGE_SCHEMES[scheme]:
        out = F.when(age >= least, F.lit(label)).otherwise(out)
    return out


def age_bucket_sql(age: str, scheme: str = "portrait") -> str:
    """The same as SQL text."""
    steps = " ".join(f"when {age} >= {least} then '{label}'" for label, least in reversed(AGE_SCHEMES[scheme]))
    return f"case {steps} else '{UNKNOWN_AGE}' end"


def level(score: Column, table: str = "score") -> Column:
    """The label of the first band that a score reaches."""
    out = F.lit(None).cast("string")
    for least, label in reversed(LEVELS[table]):
        out = F.when(score >= least, F.lit(label)).otherwise(out)
    return out


def level_sql(score: str, table: str = "score") -> str:
    steps = " ".join(f"when {score} >= {least} then '{label}'" for least, label in LEVELS[table][:-1])
    return f"case {steps} when {score} is not null then '{LEVELS[table][-1][1]}' end"


def min_max(c: Column, low: Column, high: Column, top: float = 10.0) -> Column:
    """`c` scaled from [low, high] to 0..top and clamped; the middle where low = high."""
    return F.when(high == low, F.lit(top / 2)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(top), (c - low) / (high - low) * top)))


def label_values(pairs: Sequence[tuple[str, Column]], sep: str = ", ", eq: str = "=") -> Column:
    """`label=value` of all values that aren't null, joined."""
    return F.concat_ws(sep, *(F.when(c.isNotNull(), F.concat(F.lit(f"{n}{eq}"), c.cast("string"))) for n, c in pairs))


def best_and_weakest(pairs: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """Names of the greatest and of the least value; the first in order wins ties, nulls don't count."""
    high, low = F.greatest(*(c for _, c in pairs)), F.least(*(c for _, c in pairs))
    pick = lambda v: F.coalesce(*(F.when(c == v, F.lit(n)) for n, c in pairs))
    return pick(high), pick(low)


def words(c: Column, stop: Sequence[str] = (), least: int = 1) -> Column:
    """Lower-case word tokens, stop words and shorter ones left out."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(found, lambda w: (F.char_length(w) >= least) & ~w.isin(list(stop)) if stop else F.char_length(w) >= least)


def contains_any(text: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """Whether a folded text has one of the keywords, anywhere or as whole words."""
    t = fold(text)
    if whole_words:
        return t.rlike("|".join(rf"\b{k}\b" for k in keywords))
    return reduce(lambda a, b: a | b, (F.contains(t, F.lit(k)) for k in keywords))


def first_keyword(text: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first class in order one of whose keywords the folded text has."""
    return F.coalesce(*(F.when(contains_any(text, ks), F.lit(n)) for n, ks in classes))


def longest_keyword(text: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The class of the longest keyword that the folded text has; the first in order among equals."""
    pairs = sorted(((k, n) for n, ks in classes for k in ks), key=lambda p: -len(p[0]))
    t = fold(text)
    return F.coalesce(*(F.when(F.contains(t, F.lit(k)), F.lit(n)) for k, n in pairs))


def age_filter(text: Column, scheme: str = "portrait") -> Column:
    """The age bucket that a question names: a span by its midpoint, "moins de", "plus de"."""
    t = fold(text)
    span = F.regexp_extract(t, r"(\d+)\s*(?:-|a)\s*(\d+)\s*ans", 1).try_cast("int"), F.regexp_extract(t, r"(\d+)\s*(?:-|a)\s*(\d+)\s*ans", 2).try_cast("int")
    under = F.regexp_extract(t, r"moins de\s*(\d+)", 1).try_cast("int")
    over = F.regexp_extract(t, r"plus de\s*(\d+)", 1).try_cast("int")
    first = AGE_SCHEMES[scheme][0][1]
    age = F.coalesce(F.floor((span[0] + span[1]) / 2).cast("int"), F.when(under.isNotNull(), F.greatest(under - 1, F.lit(first))), over + 1)
    return F.when(age.isNotNull(), age_bucket(age, scheme))


def repair_quotes(c: Column) -> Column:
    """Typographic quotes and dashes as plain ones."""
    return F.translate(c, "‘’“”–— ", "''\"\"-- ")


def numbers(c: Column) -> Column:
    """All decimal numbers of a text, a comma counting as the point."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"-?\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.translate(x, ",", ".").cast("double"))


def nearest_number(c: Column, to: Column) -> Column:
    """The number of a text that is nearest to `to`; the smaller of two as near."""
    near = F.transform(numbers(c), lambda x: F.struct(F.abs(x - to).alias("d"), x.alias("x")))
    return F.array_min(near)["x"]


def factual_score(answer: Column, truth: Column) -> Column:
    """1 within 5 % and 0.05 of the truth, else falling with the relative error to 0; null without a truth."""
    off = F.abs(nearest_number(answer, truth) - truth)
    size = F.abs(truth)
    return F.when(truth.isNull(), None).otherwise(
        F.when(off.isNull(), F.lit(0.0)).when(off <= size * 0.05 + 0.05, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - off / (size + 0.01)))
    )


def refuses(answer: Column, markers: Sequence[str]) -> Column:
    return contains_any(answer, markers)


def stars_of_p(p: Column) -> Column:
    """Significance stars of a p-value."""
    return F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*")).otherwise(F.lit(""))


def p_text(p: Column) -> Column:
    """A p-value in words."""
    return F.when(p < 0.001, F.lit("p<0.001")).when(p < 0.01, F.lit("p<0.01")).when(p < 0.05, F.lit("p<0.05")).otherwise(F.format_string("p=%.3f", p))


def bias_phrase(b: Column) -> Column:
    """A bias (human minus judge) in words."""
    side = F.when(b > 0, F.lit("l'humain note plus haut")).otherwise(F.lit("le juge note plus haut"))
    return F.when(F.abs(b) < 0.05, F.lit("pas de biais notable")).otherwise(F.format_string("biais de %+.2f (%s)", b, side))


def correlation_word(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.7, F.lit("forte")).when(a >= 0.4, F.lit("modérée")).when(a >= 0.2, F.lit("faible")).when(a.isNotNull(), F.lit("négligeable"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double precision; null for null or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def f1(precision: Column, recall: Column, empty: float | None = 0.0) -> Column:
    """Harmonic mean; null inputs give null, two zeros give `empty`."""
    s = precision + recall
    return F.when(s.isNull(), None).when(s == 0, F.lit(empty).cast("double")).otherwise(2 * precision * recall / s)
