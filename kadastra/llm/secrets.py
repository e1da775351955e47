"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only (op10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import bound, checkpoint, table

#: Base kinds in order: their patterns, and the length of the value from which a match counts.
NAMES = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")
#: The method's own candidates: long runs of token characters with letters and digits mixed.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A value is live-looking if it belongs to one owner and few of its repositories, and looks random: so many different characters.
MOST_OWNERS, MOST_REPOSITORIES, LEAST_CHARACTERS = 1, 3, 12
#: Occurrences of one value are spread over so many keys when they meet its counts.
SALTS = 16
#: Matches of a text are gathered in blocks of so many, as an array that grows by one match at a time is copied each time.
BLOCK = 256
_IN, _OUT, _OTHER = "\u0001", "\u0002", "\u0003"


def _marked(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, match) of all matches, code points, leftmost non-overlapping.

    Each match is put between two marks and the text split at the first of them; running lengths
    give the places. Marks that stand in the text itself are replaced beforehand by a
    third character, which no pattern contains either.
    """
    split = F.split(F.regexp_replace(F.translate(text, _IN + _OUT, _OTHER * 2), pattern, _IN + "$0" + _OUT), _IN, -1)
    spans = "array<struct<start:int,kind:int,end:int,value:string>>"

    def placed(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, _OUT, 1)
        one = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), (acc["at"] + F.char_length(match)).alias("end"), match.alias("value"))
        return F.struct((acc["at"] + F.char_length(piece) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def blocks(pieces: Column) -> Column:
        def one(acc: Column, b: Column) -> Column:
            part = F.aggregate(F.slice(pieces, b * BLOCK + 2, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("out")), placed)
            return bound(part, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        start = F.struct(F.char_length(pieces[0]).alias("at"), F.array().cast(f"array<{spans}>").alias("outs"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        return F.when(F.size(pieces) > 1, F.flatten(F.aggregate(numbers, start, one, lambda acc: acc["outs"]))).otherwise(F.array().cast(spans))

    return F.coalesce(bound(split, blocks), F.array().cast(spans))


def find_candidates(text: Column) -> Column:
    """Array of (start, kind, end, value) of base matches and, as kind 3, the method's candidates.

    The value of an assignment is what is assigned. Searches are skipped where a cheap
    containment test shows that nothing can match. Null texts have no candidates.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    value = F.regexp_extract
    assign = F.transform(
        F.filter(_marked(text, ASSIGN, 0), lambda x: F.char_length(value(x["value"], ASSIGN, 2)) >= 6),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), value(x["value"], ASSIGN, 2).alias("value")),
    )
    access = F.filter(_marked(text, ACCESS, 1), lambda x: F.char_length(x["value"]) >= 20)
    mixed = F.filter(_marked(text, TOKEN, 3), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    digit = text.rlike("[0-9]")
    return F.concat(
        F.when(named, assign).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), access).otherwise(none),
        F.when(F.coalesce(text.rlike("[0-9a-f]{24}"), F.lit(False)), _marked(text, HEX, 2)).otherwise(none),
        F.when(F.coalesce(digit, F.lit(False)) & F.coalesce(text.rlike("[A-Za-z0-9+/_=-]{20}"), F.lit(False)), mixed).otherwise(none),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "token")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """row_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared for each row of `docs`.

    All candidates of the corpus are hashed and counted by distinct owners and repositories. A value
    found with more than one owner, or in more than three repositories of one, is a widely copied example (n_shared
    counts a document's); another that looks random is live-looking (n_live). The spans are the
    base ones and those live-looking candidates that touch no base span, as kind token.

    Rows are told apart even when ids repeat. Null texts have no spans; null owners and repositories
    count as one of each. Values travel as hashes; those of one owner and repository are one row before
    the shuffle that counts them, and a value's occurrences meet its counts under several keys, so a value that a third of
    all documents hold is no task's burden.
    """
    held = checkpoint(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(row_id).alias("_id"), F.coalesce(F.col(owner), F.lit("")).alias("_owner"),
            F.concat_ws("\u0000", *(F.coalesce(F.col(c), F.lit("")) for c in repository)).alias("_repo"),
            F.transform(
                find_candidates(F.col(text)),
                lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"), F.size(F.array_distinct(F.split(x["value"], ""))).alias("chars")),
            ).alias("_found"),
        )
    )
    flat = held.where(F.size("_found") > 0).select("_row", "_owner", "_repo", F.explode("_found").alias("x")).select("_row", "_owner", "_repo", "x.*")
    owners = flat.select("hash", "_owner", "_repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"), F.count_distinct("_owner").alias("n_owners"))
    shared = (F.col("n_owners") > MOST_OWNERS) | (F.col("n_repos") > MOST_REPOSITORIES)
    owners = owners.select("hash", shared.alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = flat.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    known = salted.join(owners, ["hash", "_salt"]).withColumn("live", ~F.col("shared") & (F.col("chars") >= LEAST_CHARACTERS))
    # the furthest end of the base spans that start no later, and the nearest start of those that start no earlier
    is_base = F.col("kind") < 3
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("_row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumns({"_upto": F.max(F.when(is_base, F.col("end"))).over(before), "_next": F.min(F.when(is_base, F.col("start"))).over(after)})
    touches = F.coalesce(F.col("_upto") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    known = known.withColumn("more", is_base | (F.col("live") & ~touches))
    by = known.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "shared", "more"))).alias("all"),
    )
    base = F.filter("all", lambda x: x["kind"] < 3)
    more = F.filter("all", lambda x: x["more"])
    n = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    told = by.select(
        "_row", *(n(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), _joined(base).alias("base"), _joined(more).alias("spans"),
        F.size(F.filter(more, lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("all", lambda x: x["shared"])).cast("long").alias("n_shared"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return held.select("_row", F.col("_id").alias(row_id)).join(told, "_row", "left").select(
        row_id, *(zero(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_shared")
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared of all documents."""
    return find_secrets(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(source, '') as o, coalesce(source, '') || '|' || coalesce(lang, '') as rp, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t from documents
), kinds(kind, pattern) as (values
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9+/_=-]+')
), p as (
  select rid, o, rp, kind, pattern, string_split(regexp_replace(t, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) as ps from d, kinds
), m as (
  select rid, o, rp, kind, pattern, split_part(unnest(ps[2:]), chr(2), 1) as v, unnest(list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))::bigint - (i - 1))) as s
  from p where len(ps) > 1 and (kind <> 3 or regexp_matches(array_to_string(ps, ''), '[A-Za-z0-9+/_=-]{20}')) and (kind <> 2 or regexp_matches(array_to_string(list_transform(ps, lambda x: replace(x, chr(2), '')), ''), '[0-9a-f]{24}'))
), c as (
  select rid, o, rp, kind, s, s + length(v) as e, case when kind = 0 then regexp_extract(v, pattern, 2) else v end as val from m
), f as (
  select *, len(list_distinct(string_split(val, ''))) as chars from c
  where case kind when 0 then length(val) >= 6 when 1 then length(val) >= 20 when 2 then length(val) >= 24 else length(val) >= 20 and regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Za-z]') end
), own as (
  select val, count(distinct o) > 1 or count(distinct rp) > 3 as shared from f group by 1
), k as (
  select f.*, shared, not shared and chars >= 12 as live from f join own using (val)
), g as (
  select k.*, kind < 3 or (live and not exists (select 1 from k b where b.rid = k.rid and b.kind < 3 and b.s < k.e and k.s < b.e)) as more,
    (['assign', 'access', 'hex', 'token'])[kind + 1] || ':' || s || ':' || e as label from k
), told as (
  select rid, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex,
    coalesce(string_agg(label, ',' order by s, kind) filter (where kind < 3), '') as base, coalesce(string_agg(label, ',' order by s, kind) filter (where more), '') as spans,
    count_if(more and live) as n_live, count_if(shared) as n_shared from g group by 1
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0)::bigint as n_live, coalesce(n_shared, 0)::bigint as n_shared from d left join told using (rid)
"""
