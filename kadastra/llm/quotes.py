"""Quotation linking of conversations, in DataFrame functions only (op1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import bound, checkpoint, table

#: The marks that open a quoted line; each > is one level.
QUOTED = r"^[ \t]*>[> \t]*"
#: A normalised line that names the writer of the quote below it.
NAMED = r"(?s)^on .+ wrote:\z"


def quote_level(line: Column) -> Column:
    """Number of quote marks that a line opens with."""
    return F.regexp_count(F.regexp_extract(line, QUOTED, 0), F.lit(">"))


def normalised(line: Column) -> Column:
    """A line without its marks, lower case, white space runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, QUOTED, "")), r"\s+", " "))


def _lines(text: Column, then) -> Column:
    """`then` of the lines of a text: an array of (line, level, norm), computed once.

    A line that only names who wrote what the next, deeper line quotes counts as blank: its norm is empty, and `named` is true.
    """
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x: F.struct(x.alias("line"), quote_level(x).alias("level"), normalised(x).alias("norm")))

    def marked(xs: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            named = F.coalesce(x["norm"].rlike(NAMED) & (F.get(xs, i + 1)["level"] > x["level"]), F.lit(False))
            return F.struct(x["line"].alias("line"), x["level"].alias("level"), F.when(named, F.lit("")).otherwise(x["norm"]).alias("norm"), named.alias("named"))

        return bound(F.transform(xs, mark), then)

    return bound(raw, marked)


def without_quotes(text: Column) -> Column:
    """The lines of a text that are not quoted nor name who wrote a quote, blank ones at both ends removed."""
    kept = _lines(text, lambda xs: F.transform(F.filter(xs, lambda x: (x["level"] == 0) & ~x["named"]), lambda x: x["line"]))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _runs(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, norms, text) of every passage of the messages (row, conv, turn, text); norms are its lines.

    Passages are cut inside the row, from where each begins and ends among the lines, so nothing is shuffled.
    """

    def cut(xs: Column) -> Column:
        def edges(step: int) -> Column:
            def at_edge(i: Column) -> Column:
                here, beside = F.get(xs, i), F.get(xs, i + step)
                return (here["norm"] != "") & ~F.coalesce((beside["norm"] != "") & (beside["level"] == here["level"]), F.lit(False))

            return F.filter(F.sequence(F.lit(0), F.size(xs) - 1), at_edge)

        def passage(start: Column, end: Column) -> Column:
            norms = F.transform(F.slice(xs, start + 1, end - start + 1), lambda x: x["norm"])
            return F.struct(F.get(xs, start)["level"].alias("level"), norms.alias("norms"))

        return F.zip_with(edges(-1), edges(1), passage)

    rows = messages.select("conv", "turn", F.explode(_lines(F.col("text"), cut)).alias("p"))
    return rows.select("conv", "turn", "p.level", "p.norms", F.array_join("p.norms", " ").alias("text"))


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, chars) of every passage of the messages (row, conv, turn, text).

    A passage is a run of lines of one level between blank ones, its normalised lines joined by a
    blank; so a rewrapped quote equals its original. The hash is the md5 of that text.
    """
    return _runs(messages).select("conv", "turn", "level", _md5(F.col("text")).alias("hash"), F.char_length("text").cast("long").alias("chars"))


def pieces(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, kind, piece, chars): the lines (kind 0) and sentences (kind 1) of every passage, each once."""
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("norms").alias("xs")), F.struct(F.lit(1).alias("kind"), F.split("text", r"(?<=[.!?]) ").alias("xs")))
    rows = _runs(messages).select("conv", "turn", "level", _md5(F.col("text")).alias("hash"), F.explode(both).alias("b"))
    rows = rows.select("conv", "turn", "level", "hash", "b.kind", F.explode("b.xs").alias("x")).where("x <> ''")
    return rows.select("conv", "turn", "level", "hash", "kind", _md5(F.col("x")).alias("piece"), F.char_length("x").cast("long").alias("chars")).distinct()


def link_quotes(found: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, chars, original): quoted passages beside the message they come from.

    The original is the earliest message of the conversation that has the passage unquoted, if it
    comes before the quoting one. Originals are one row for each conversation and hash before the join,
    so common passages don't multiply.
    """
    firsts = found.where("level = 0 and conv is not null and turn is not null").groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    quoted = found.where("level > 0").distinct()
    return quoted.join(firsts, ["conv", "hash"]).where("original < turn")


def link_pieces(messages: DataFrame, unlinked: DataFrame) -> DataFrame:
    """As link_quotes, for quoted passages (conv, turn, level, hash) that equal no whole passage: trimmed or split quotes.

    Their lines and sentences are held against those of unquoted passages. Originals are again one row,
    the earliest message, for each conversation and piece. A passage comes from the message that most of its
    characters link with, counted by lines or by sentences, whichever are more; then from the later one.
    """
    asked = checkpoint(pieces(messages.join(unlinked.select("conv").distinct(), "conv", "left_semi")))
    firsts = asked.where("level = 0 and turn is not null").groupBy("conv", "piece").agg(F.min("turn").alias("original"))
    quoted = asked.where("level > 0").join(unlinked, ["conv", "turn", "level", "hash"], "left_semi")
    by = quoted.join(firsts, ["conv", "piece"]).where("original < turn").groupBy("conv", "turn", "level", "hash", "kind", "original").agg(F.sum("chars").alias("chars"))
    best = by.groupBy("conv", "turn", "level", "hash").agg(F.max(F.struct("chars", "original")).alias("best"))
    return best.select("conv", "turn", "level", "hash", "best.chars", "best.original")


def reply_order(nodes: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of nodes (conv, turn, parent): each step doubles the way to the root.

    Parents come before their replies, so the links have no cycle and the number of steps is the
    logarithm of the longest chain.
    """
    state = checkpoint(nodes.select("conv", "turn", "parent", F.coalesce("parent", "turn").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while state.where("root <> turn").join(
        state.where("root <> turn").select("conv", F.col("turn").alias("root")), ["conv", "root"], "left_semi"
    ).limit(1).count():
        up = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        state = checkpoint(
            state.join(up, ["conv", "root"]).select("conv", "turn", "parent", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
        )
    return state


def thread_conversations(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, body, n_passages, n_linked, parent_turn, root_turn, depth, in reply order.

    Quoted lines are taken out of the bodies, and so are lines "On ... wrote:" right above a deeper quote. A message replies to the one whose passages, or else their lines and
    sentences, it quotes:
    the outermost level that links decides, then the number of linked characters, then the later
    message. Without a link a message is a root. Reply order is by conversation, root, depth and
    turn; the whole result is sorted by ranges, and no conversation is gathered in one task.

    Null texts are empty bodies without passages. Messages with a null conversation or turn link
    with nothing and have root_turn = turn, depth 0. Messages that share a turn are one node with
    the passages of all; each row is returned. An empty table gives an empty result.
    """
    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    found = checkpoint(passages(rows))
    links = checkpoint(link_quotes(found))
    unlinked = checkpoint(found.where("level > 0 and conv is not null and turn is not null").select("conv", "turn", "level", "hash").distinct().join(links, ["conv", "turn", "level", "hash"], "left_anti"))
    if unlinked.limit(1).count():
        links = checkpoint(links.unionByName(link_pieces(rows, unlinked)))
    by = links.groupBy("conv", "turn", "level", "original").agg(F.sum("chars").alias("chars"))
    parents = by.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "chars", "original")).alias("best")).select("conv", "turn", F.col("best.original").alias("parent"))
    nodes = rows.where("conv is not null and turn is not null").select("conv", "turn").distinct().join(parents, ["conv", "turn"], "left")
    order = reply_order(nodes)
    quoted = found.where("level > 0").select("conv", "turn", "level", "hash").distinct().groupBy("conv", "turn").agg(F.count("*").alias("n_passages"))
    linked = links.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"))
    out = rows.select("conv", "turn", "role", without_quotes(F.col("text")).alias("body"))
    for more in (order, quoted, linked):
        out = out.join(more, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "body",
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    ).orderBy(conv, "root_turn", "depth", turn, role)


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, body, n_passages, n_linked, parent_turn, root_turn, depth of all messages."""
    return thread_conversations(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
with recursive rows0 as (
  select row_number() over () as rid, conv_id, turn, role, coalesce(text, '') as text from conversations
), lines as (
  select rid, conv_id, turn, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as pos, unnest(string_split_regex(text, '\r?\n')) as line from rows0
), parsed as (
  select rid, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*', 0), '[^>]', '', 'g')) as level,
    trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>[> \t]*', '')), '\s+', ' ', 'g')) as plain, line from lines
), named as (
  select *, coalesce(regexp_matches(plain, '(?s)^on .+ wrote:\z') and lead(level) over (partition by rid order by pos) > level, false) as named from parsed
), normed as (
  select *, case when named then '' else plain end as norm from named
), bodies as (
  select rid, string_agg(line, chr(10) order by pos) as body from named where level = 0 and not named group by 1
), marked as (
  select *, case when norm = '' or coalesce(lag(norm) over w = '', true) or lag(level) over w <> level then 1 else 0 end as opens
  from normed window w as (partition by rid order by pos)
), runs as (
  select *, sum(opens) over (partition by rid order by pos rows unbounded preceding) as run from marked
), found as (
  select conv_id, turn, level, md5(p) as hash, length(p) as chars from (
    select rid, run, any_value(conv_id) as conv_id, any_value(turn) as turn, any_value(level) as level, string_agg(norm, ' ' order by pos) as p
    from runs where norm <> '' group by rid, run)
), firsts as (
  select conv_id, hash, min(turn) as original from found where level = 0 group by 1, 2
), links as (
  select q.*, f.original from (select distinct * from found where level > 0) q join firsts f on q.conv_id = f.conv_id and q.hash = f.hash and f.original < q.turn
), parents as (
  select conv_id, turn, original as parent from (
    select conv_id, turn, original, row_number() over (partition by conv_id, turn order by level, chars desc, original desc) as k
    from (select conv_id, turn, level, original, sum(chars) as chars from links group by all)) where k = 1
), nodes as (
  select conv_id, turn, parent from (select distinct conv_id, turn from rows0 where conv_id is not null and turn is not null) left join parents using (conv_id, turn)
), tree as (
  select conv_id, turn, parent, turn as root, 0 as depth from nodes where parent is null
  union all
  select n.conv_id, n.turn, n.parent, t.root, t.depth + 1 from nodes n join tree t on n.conv_id = t.conv_id and n.parent = t.turn
), counted as (
  select conv_id, turn, count(*) as n from (select distinct conv_id, turn, level, hash from found where level > 0) group by 1, 2
), linked as (
  select conv_id, turn, count(*) as n from links group by 1, 2
)
select r.conv_id, r.turn, r.role,
  regexp_replace(coalesce(b.body, ''), '^\s+|\s+$', '', 'g') as body,
  coalesce(c.n, 0)::bigint as n_passages, coalesce(l.n, 0)::bigint as n_linked, t.parent as parent_turn, coalesce(t.root, r.turn) as root_turn, coalesce(t.depth, 0)::bigint as depth
from rows0 r left join bodies b using (rid) left join tree t using (conv_id, turn) left join counted c using (conv_id, turn) left join linked l using (conv_id, turn)
"""
