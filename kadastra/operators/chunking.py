"""Texts cut into chunks: sentence packing, question/answer blocks, overlapping windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words that a chunk may have, by the type of the source.
BUDGETS = {"entretien": 80, "wiki": 150, "quanti": 50, "be_verbatims": 60, "csv_text": 100, "default": 100}
#: Where a text is cut, from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")


def pack(pieces: Column, size_of, budget: int | Column, sep: str, *, ends: int = 0) -> Column:
    """Pieces joined in order into chunks of at most `budget`; a longer piece is a chunk alone, none is empty.

    Every piece that a chunk has counts `ends` more than its size.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        n = size_of(p)
        fits = (acc["size"] == 0) | (acc["size"] + n <= budget)
        joined = F.when(acc["size"] == 0, p).otherwise(F.concat(acc["open"], F.lit(sep), p))
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"), (acc["size"] + n + ends).alias("size"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open"), (n + ends).alias("size"))
        )

    return F.aggregate(F.filter(pieces, lambda p: F.trim(p) != ""), start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: x != ""))


def word_budget(source_type: Column) -> Column:
    """The budget of a source's type; unknown types have the default."""
    pairs = [F.lit(x) for pair in BUDGETS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source_type), F.lit(BUDGETS["default"]))


def pack_questions(text: Column, characters: int = 600) -> Column:
    """Blocks that begin with `Q :` at a line's start, packed to a character budget; each block counts two more for the blank line after it."""
    blocks = F.transform(F.split(text, r"\n(?=Q\s*:)"), F.trim)
    return F.transform(pack(blocks, F.char_length, characters, "\n\n", ends=2), F.trim)


def pack_lines(text: Column, least: int = 1000) -> Column:
    """Lines gathered until they have `least` characters together; the rest is the last chunk."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        lines, size = F.concat(acc["open"], F.array(line)), acc["size"] + F.char_length(line)
        full = F.struct(F.concat(acc["done"], F.array(lines)).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
        return F.when(size >= least, full).otherwise(F.struct(acc["done"].alias("done"), lines.alias("open"), size.alias("size")))

    chunks = F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.transform(chunks, lambda lines: F.array_join(lines, "\n"))


def _pieces(text: str, size: int, separators: Sequence[str]) -> list[str]:
    """`text` in pieces of at most `size`, cut before the coarsest separators that do; only what is still too long is cut finer."""
    sep, finer = separators[0], separators[1:]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(sep)
    parts = [parts[0], *(sep + p for p in parts[1:])]
    return [x for p in parts if p for x in ([p] if len(p) <= size else _pieces(p, size, finer))]


def split_text(text: str | None, size: int = 500, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at paragraphs, else lines, sentences, commas, blanks, and only then within words.

    Pieces are joined while they fit. The next chunk begins with the last pieces of the one before, so many as have at most `overlap` characters and
    leave room for the next piece. Blanks around a chunk go; null and blank texts have none.
    """
    out, held, total = [], [], 0
    for p in _pieces((text or "").strip(), size, separators):
        if total + len(p) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return [c for c in map(str.strip, out) if c]


def recursive_split(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """`split_text` of a column, a hundred rows at a time (an Arrow batch has ten thousand texts and all their chunks); interviews with Q/R pairs give their pairs instead."""
    split = F.udf(lambda t: split_text(t, size, overlap), "array<string>", useArrow=False)
    pairs = question_answer_pairs(text)
    return F.when(F.size(pairs) > 0, pairs).otherwise(split(text))


def question_answer_pairs(text: Column) -> Column:
    """Each question and its answer as one text of two parts, the question's mark left out; empty where there are none."""
    pair = r"(?is)Q\s*[:：]\s*(.*?)(?=R\s*[:：])(R\s*[:：]\s*.*?)(?=Q\s*[:：]|\z)"
    q, r = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pair), F.lit(i)) for i in (1, 2))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.zip_with(q, r, lambda a, b: F.concat(strip(a), F.lit("\n"), strip(b)))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"(?<=[.!?])\s+", "\u0001"), "\u0001")


def pack_sentences(text: Column, words: int | Column) -> Column:
    """Sentences packed to a word budget, one for all rows or one for each."""
    return pack(sentences(text), lambda s: F.size(F.split(F.trim(s), r"\s+")), words, " ")


def pack_blocks(text: Column, characters: int, sep: str = "\n") -> Column:
    """Lines packed to a character budget."""
    return pack(F.split(text, "\r?\n"), F.char_length, characters, sep)


def windows(text: Column, size: int = 500, overlap: int = 100, *, blank: bool = False) -> Column:
    """Windows of `size` code points that overlap, over the whole text; the last may be shorter.

    Null and empty texts have none; with `blank` they have one, the text itself.
    """
    n = F.char_length(text)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(size - overlap))
    found = F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))
    return found if blank else F.filter(found, lambda x: x != "")


def question_answers(text: Column) -> Column:
    """Q:/R: pairs kept whole, as an array of texts."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(Q\s*:.*?)(?=\n\s*Q\s*:|\z)"), F.lit(1)), F.trim)


def numbered(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    """(key, chunk_index, n_chunks, chunk)."""
    return df.select(key, chunks.alias("_c")).select(key, F.size("_c").alias("n_chunks"), F.posexplode("_c").alias("chunk_index", "chunk"))
