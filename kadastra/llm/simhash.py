"""SimHash fingerprints and permuted block tables, in DataFrame functions only (op2)."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import bound, checkpoint, table

#: Terms are runs of so many words; a term weighs 1 to 3 by its length in characters.
SHINGLE = 3
#: Radius of the search and the number of blocks that the 64 bits are cut into for it.
RADIUS, BLOCKS = 3, 5
#: The search's stated query set: ids divisible by this.
EVERY = 50
#: Ranges of ids per shuffle partition when neighbours are looked up.
RANGES = 2


def terms(text: Column, shingle: int = SHINGLE) -> Column:
    """Array of (hash, weight) of all word shingles; fewer words are one term, none give none."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(words: Column) -> Column:
        few = F.size(words) < shingle

        def term(w: Column, i: Column) -> Column:
            run = [w, *(F.get(words, i + k) for k in range(1, shingle))]
            length = sum((F.coalesce(F.char_length(x), F.lit(0)) for x in run[1:]), F.char_length(w))
            return F.struct(F.xxhash64(*run).alias("h"), F.least(F.lit(3), F.lit(1) + F.floor(length / 12)).cast("long").alias("w"))

        return F.transform(F.slice(words, 1, F.when(few, F.least(F.size(words), F.lit(1))).otherwise(F.size(words) - (shingle - 1))), term)

    return bound(split, of)


def vote(exploded: DataFrame, keys: list[str]) -> DataFrame:
    """One row per `keys` with fp: each term's hash votes with its weight for or against each bit.

    Two bits are counted in one sum, in its lower and its upper 32 bits. A bit is 1 if more than half of the weight has it set. `exploded` has a column t
    (h, w), null where a text has no term; such texts have fingerprint 0.
    """
    sums = [F.expr(f"sum((shiftrightunsigned(t.h, {i}) & 4294967297L) * t.w)").alias(f"v{i}") for i in range(32)]
    by = exploded.groupBy(*keys).agg(*sums, F.sum("t.w").alias("total"))
    bits = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"v{i}"), 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (i + 32)) - ((1 << 64) if i == 31 else 0)
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("total"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return by.withColumn("fp", F.coalesce(bits, F.lit(0))).drop(*(f"v{i}" for i in range(32)), "total")


def likeness(a: Column, b: Column) -> Column:
    """Share of the 64 bits that agree."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / 64.0


def to_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the tables: every choice of blocks - radius of the blocks, as signed longs.

    Fingerprints within the radius differ in at most `radius` blocks, so some table has
    them under one key. More blocks make longer keys and so shorter buckets, at more tables.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(masks, max(1, blocks - radius))]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def find_near(queries: DataFrame, fps: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, bits) for all distinct `fp` of `fps` within `radius` bits of a distinct `query`.

    Both sides are keyed by every block table; equal keys meet in a join and are verified by their
    Hamming distance. A pair that several tables find is kept once, by the first of the tables that
    has it, so nothing need be made distinct after the join.
    """
    masks = block_tables(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(k).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
        return df.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(keys).alias("k")).select(name, "k.*")

    apart = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(len(masks))
    for k in reversed(range(len(masks))):
        first = F.when(apart.bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(first)
    return (
        keyed(queries, "query").join(keyed(fps, "fp"), ["table", "key"]).where((F.bit_count(apart) <= radius) & (first == F.col("table")))
        .select("query", "fp", F.bit_count(apart).alias("bits"))
    )


def _range(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending `cuts` are at least `value`; one more than all for null. Found in two steps of about the root of their number."""
    size = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    if not groups:
        return F.when(value.isNull(), F.lit(1)).otherwise(F.lit(0))

    def count(k: Column) -> Column:
        return F.least(k * size, F.lit(len(cuts))) + below(F.coalesce(F.get(F.array(*map(longs, groups)), k), longs([])))

    return F.when(value.isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - bound(below(longs([g[-1] for g in groups])), count))


def with_next(docs: DataFrame, *, row_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(rows, before): rows are (row_id, text, next_text, range, seq), each text beside that of the next row.

    Rows go by descending id, ties by text, null ids last; after the last comes the first. They are cut
    into ranges of ids by approximate quantiles and each range is sorted alone, so no task sees the
    whole order; `before` gives for each range the one whose last row it follows. The first text of
    a range is looked up for that row. Texts are shuffled once.
    """
    docs = docs.select(F.col(row_id).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES)
    cuts = sorted(set(docs.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100_000)).first()[0] or []))
    ranged = docs.withColumn("range", _range(F.col("id"), cuts))
    heads = {r["range"]: r["id"] for r in ranged.groupBy("range").agg(F.max("id").alias("id")).collect()}
    order = sorted(heads)
    before = {b: a for a, b in zip([*order[-1:], *order[:-1]], order)}
    first = ranged.where(F.col("id").isin([v for v in heads.values() if v is not None]) | F.col("id").isNull())
    first = first.groupBy("range").agg(F.min("text").alias("value"))
    w = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), "text")
    rows = ranged.withColumn("seq", F.row_number().over(w)).withColumn("inner", F.lead("text").over(w))
    # rows lie by range in order already, so a merge moves only the first texts; whole texts are never broadcast
    rows = rows.join(_moved(first, before).hint("merge"), "range", "left")
    return rows.select(F.col("id").alias(row_id), "text", F.coalesce("inner", "value").alias("next_text"), "range", "seq"), before


def _moved(first: DataFrame, before: dict[int, int]) -> DataFrame:
    """(range, value) of `first` moved to the range before each."""
    pairs = [F.lit(x) for pair in before.items() for x in pair]
    steps = F.create_map(*pairs) if pairs else F.lit(None).cast("map<int,int>")
    return first.select(steps[F.col("range")].alias("range"), "value")


def fingerprint_documents(docs: DataFrame, *, row_id: str = "doc_id") -> DataFrame:
    """row_id, n_chars, edited_sha256, fp, edited_fp, next_fp, one row for each row of `docs`.

    The edited text has its last third replaced by as many of the first code points of the next text.
    Null texts count as empty: no terms, fingerprint 0. A single row is its own next. Texts are voted on
    where they lie after the one shuffle of `with_next`; only fingerprints go on.
    """
    rows, before = with_next(docs, row_id=row_id)
    edited = F.expr(
        "concat(substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int)), substring(next_text, 1, cast(floor(char_length(text) / 3) as int)))"
    )
    kept = ["range", "seq", row_id, "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited", edited).select("range", "seq", row_id, F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    versions = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    flat = rows.select(*kept, F.explode(versions).alias("x")).select(*kept, "x.which", F.explode_outer(terms(F.col("x.t"))).alias("t"))
    # what is carried is part of the key: sums alone keep the aggregation in hash maps, and the ranges keep it in place
    votes = vote(flat, [*kept, "which"])
    both = votes.groupBy(*kept).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    both = checkpoint(both)
    first = _moved(both.where("seq = 1").select("range", F.col("fp").alias("value")), before)
    w = Window.partitionBy("range").orderBy("seq")
    return both.withColumn("inner", F.lead("fp").over(w)).join(first, "range", "left").select(row_id, "n_chars", "edited_sha256", "fp", "edited_fp", F.coalesce("inner", "value").alias("next_fp"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near is, for ids divisible by 50, the number of other distinct fingerprints within the radius.
    """
    rows = checkpoint(fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
    near = find_near(rows.where(F.col("doc_id") % EVERY == 0).select(F.col("fp").alias("query")), rows.select("fp"))
    counts = near.where("bits > 0").groupBy(F.col("query").alias("fp")).agg(F.count("*").alias("n"))
    return rows.join(counts, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % EVERY == 0, F.coalesce("n", F.lit(0))).cast("long").alias("n_near"),
    )
