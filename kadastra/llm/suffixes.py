"""Repeated passages removed with two-stage suffix sorting (op3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, release, table

#: Bytes of a repeated string; bytes of the anchors that part the texts.
LENGTH, ANCHOR = 200, 50
#: Texts are worked on in buffers of so many bytes, segments sorted in batches of so many.
BUFFER, BATCH = 1 << 21, 1 << 21
#: An anchor with more different segments than this is split by exact windows.
HOT = 2000
#: Segments of one anchor are spread over so many keys when they meet what is known of it.
SALTS = 16
_P = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    inverse = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inverse):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def segments(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text number, start, size, anchor hash, both halves of the segment's 128-bit digest) of the segments of concatenated texts.

    Every string of `length` bytes belongs to the anchor of least hash that it holds, the leftmost of
    equals; so equal strings belong to equal anchors. A segment is the stretch of a text whose
    strings belong to one anchor; all its strings together are `size` bytes from `start` in the text.
    """
    n, w = len(raw), length - anchor + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int64, np.int64))
    if n < length:
        return none
    power, back = _powers(1 << max(BUFFER.bit_length(), int(n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = _mixed((sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1])
    bits = np.uint64(int(n).bit_length())
    at = np.arange(len(h), dtype=np.uint64)
    key = ((h >> bits) << bits) | at
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & ((np.uint64(1) << bits) - np.uint64(1))
    starts = np.r_[0, ends[:-1]]
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[:count]
    valid = np.arange(count) + length <= ends[text]
    good = np.flatnonzero(valid)
    if not len(good):
        return none
    a, t = least[good].astype(np.int64), text[good]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    begin, last = good[first], good[np.r_[first[1:] - 1, len(good) - 1]]
    size = last - begin + length
    held = memoryview(np.ascontiguousarray(raw))
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(held[x:y]) for x, y in zip(begin.tolist(), (begin + size).tolist())), np.int64).reshape(-1, 2)
    return t[first], begin - starts[t[first]], size.astype(np.int32), h[a[first]].view(np.int64), digest[:, 0], digest[:, 1]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, bytes, ends): rows (k1, k2, text) put together up to the buffer's size."""
    keys, held, size = [], [], 0

    def out():
        return keys, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])

    for batch in batches:
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = (text.as_py() or "").encode()
            if size and size + len(raw) > BUFFER:
                yield out()
                keys, held, size = [], [], 0
            keys.append((k1, k2))
            held.append(raw)
            size += len(raw)
    if held:
        yield out()


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, raw, ends in _buffers(batches):
        text, start, size, h, w1, w2 = segments(raw, ends)
        k = np.array(keys, np.int64).reshape(-1, 2)
        # of equal segments in one buffer the first stands for all; the others are repeats for certain
        order = np.lexsort((w2, w1, h))
        same = np.all([x[order][1:] == x[order][:-1] for x in (h, w1, w2)], axis=0)
        local, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
        local[order[1:][same]] = True
        twice[order[:-1][same]] = True
        columns = (h, w1, w2, k[text, 0], k[text, 1], start, size, twice, local)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "w1", "w2", "k1", "k2", "start", "size", "twice", "local"])


def _keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and digest, those whose anchor occurs again, and those that are repeats for certain.

    A row needs only its neighbours, so one batch and one row are held. `alike`: an equal segment
    exists; `first`: the first of its equals; `number`: how many different segments the anchor has had.
    """
    held: list[np.ndarray] | None = None
    prev, number = None, 0
    names = ["h", "k1", "k2", "start", "size", "alike", "first", "number"]

    def out(rows: list[np.ndarray], n: int) -> pa.RecordBatch:
        """The first n of `rows`; what comes after them is only looked at."""
        nonlocal prev, number
        h, w1, w2, twice = *rows[:3], rows[7]
        same_h = np.r_[prev is not None and h[0] == prev[0], h[1:] == h[:-1]]
        same = same_h & np.r_[prev is not None and (w1[0], w2[0]) == prev[1:], (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]
        next_h, next_same = np.r_[same_h[1:], False], np.r_[same[1:], False]
        at = np.arange(len(h))
        new = (~same).astype(np.int64)
        total = np.cumsum(new)
        opening = np.maximum.accumulate(np.where(~same_h, at, -1))
        since = np.where(opening >= 0, total - np.where(opening >= 0, total[opening], 0) + 1, total + number)
        keep = np.flatnonzero((same_h | next_h | twice)[:n])
        prev, number = (h[n - 1], w1[n - 1], w2[n - 1]), int(since[n - 1])
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, *rows[3:7], same | next_same | twice, ~same, since)], names=names)

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
        local = rows[8]
        if local.any():
            n = int(local.sum())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(rows[i][local] for i in (0, 3, 4, 5, 6)), np.ones(n, bool), np.zeros(n, bool), np.zeros(n, np.int64))], names=names)
        rows = [x[~local] for x in rows[:8]]
        if not len(rows[0]):
            continue
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        n = len(rows[0]) - 1
        if n:
            yield out(rows, n)
        held = [r[n:] for r in rows]
    if held is not None:
        yield out(held, len(held[0]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted; of hot anchors' segments the hash of every string instead."""
    names = ["h", "k1", "k2", "start", "weight", "part", "window"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for k1, k2, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            raw = (text.as_py() or "").encode()
            for x in wanted:
                s, e = x["start"], x["start"] + x["size"]
                if x["hot"]:
                    for p in range(s, e - LENGTH + 1):
                        for c, v in zip(out, (None, k1, k2, p, 2 if x["alike"] else 1, None, xxhash.xxh3_128_digest(raw[p : p + LENGTH]))):
                            c.append(v)
                else:
                    for c, v in zip(out, (x["h"], k1, k2, s, 2 if x["alike"] else 1, raw[s:e], None)):
                        c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def two_stage(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffix array of bytes that end in 0, in the order of the first `depth` bytes at least.

    Only suffixes smaller than their successors are sorted directly, by eight bytes at a time
    among those still tied. The others are induced: a scan over the buckets of first bytes, in order,
    puts each suffix's larger predecessor at the next free place of that one's bucket.
    """
    n = len(text)
    nxt = np.r_[text[1:], np.uint8(0)]
    change = np.flatnonzero(text != nxt)
    if not len(change):
        return np.arange(n)[::-1].copy()
    small = np.zeros(n, bool)
    at = np.searchsorted(change, np.arange(n))
    inside = at < len(change)
    small[inside] = (text < nxt)[change[at[inside]]]
    padded = np.r_[text, np.zeros(depth + 16, np.uint8)].astype(np.uint64)
    word = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        word |= padded[j : j + len(word)] << np.uint64(56 - 8 * j)
    order = np.flatnonzero(small)
    order = order[np.argsort(word[order], kind="stable")]
    if len(order):
        tied = np.arange(len(order))
        group = np.zeros(len(order), np.int64)
        done = 0
        while done < depth and len(tied):
            w = word[order[tied] + done]
            fresh = np.r_[True, (w[1:] != w[:-1]) | (group[1:] != group[:-1])]
            number = np.cumsum(fresh)
            alone = fresh & np.r_[fresh[1:], True]
            tied, group = tied[~alone], number[~alone]
            done += 8
            if done < depth and len(tied):
                o = order[tied]
                by = np.lexsort((word[o + done], group))
                order[tied] = o[by]
                group = group[by]
    total = np.bincount(text, minlength=256)
    start = np.r_[0, np.cumsum(total)[:-1]]
    n_small = np.bincount(text[order], minlength=256)
    sa = np.full(n, -1, np.int64)
    small_from = start + total - n_small
    taken = 0
    for c in np.flatnonzero(n_small):
        sa[small_from[c] : small_from[c] + n_small[c]] = order[taken : taken + n_small[c]]
        taken += n_small[c]
    head = start.copy()
    large = ~small

    def place(of: np.ndarray) -> None:
        before = of - 1
        before = before[before >= 0]
        before = before[large[before]]
        if len(before):
            c = text[before]
            before = before[np.argsort(c, kind="stable")]
            counts = np.bincount(c, minlength=256)
            used = np.flatnonzero(counts)
            done = 0
            for b in used:
                k = counts[b]
                sa[head[b] : head[b] + k] = before[done : done + k]
                head[b] += k
                done += k

    place(np.array([n]))
    for c in np.flatnonzero(total):
        i = start[c]
        while i < head[c]:
            upto = head[c]
            place(sa[i:upto])
            i = upto
        if n_small[c]:
            place(sa[small_from[c] : small_from[c] + n_small[c]])
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length, up to `most`, of the prefix that each suffix shares with the one before it."""
    padded = np.r_[text, np.zeros(most + 16, np.uint8)]
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = np.ascontiguousarray(word[: len(text) + most]).view(np.uint64).ravel()
    out = np.zeros(len(sa), np.int64)
    left = np.arange(1, len(sa))
    done = 0
    while done < most and len(left):
        a, b = word[sa[left] + done], word[sa[left - 1] + done]
        apart = a != b
        off = a[apart] ^ b[apart]
        low = (off & (~off + np.uint64(1))).astype(np.float64)
        out[left[apart]] = done + (np.log2(low).astype(np.int64) >> 3)
        left = left[~apart]
        done += 8
    out[left] = most
    return np.minimum(out, most)


def repeated_runs(parts: list[bytes]) -> list[tuple[int, int, int]]:
    """(part, start, end): maximal runs of starts whose string occurs at another place of `parts`."""
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    sa = two_stage(text)
    # strings that reach over a part's end are none, even where a part itself holds the byte between parts
    sa = sa[sa + LENGTH < ends[part[sa]]]
    same = common_prefixes(text, sa) >= LENGTH
    hit = np.zeros(len(text), bool)
    hit[sa[same]] = True
    hit[sa[np.flatnonzero(same) - 1]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.r_[True, (np.diff(at) > 1) | (part[at][1:] != part[at][:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(at) - 1]
    p = part[at[first]]
    return list(zip(p.tolist(), (at[first] - begin[p]).tolist(), (at[last] - begin[p] + LENGTH).tolist()))


def _sort_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of segments that come sorted by anchor, in batches of whole anchors."""
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        found = repeated_runs([r[4] for r in rows])
        columns = [[rows[p][1] for p, _, _ in found], [rows[p][2] for p, _, _ in found], [rows[p][3] + s for p, s, _ in found], [rows[p][3] + e for p, _, e in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "end"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if size >= BATCH and row[0] != rows[-1][0]:
                yield out()
                rows, size = [], 0
            rows.append(row)
            size += len(row[4]) + 1
    if rows:
        yield out()


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _finish(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, runs in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("runs")).to_pylist()):
                raw = (text.as_py() or "").encode()
                spans = merged([(r["start"], r["end"]) for r in runs or ()])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                for c, v in zip(rows, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans])):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns), *(pa.array(c, t) for c, t in zip(rows, types))],
                names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return run


def remove_repeats(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_bytes, n_removed, n_spans, kept_sha256, removed (runs) for each row of `docs`.

    Texts are UTF-8 bytes; every byte covered by a string of 200 bytes that also starts at another place
    of any text, its own included, is removed. Overlaps count, strings never cross texts.

    Texts are parted into segments by content-chosen anchors, so that equal strings always fall under equal
    anchors. Anchors that occur once can't hold a repeat and go. Segments that are equal as a whole, by 128 bits of digest, are
    repeats throughout and stay as numbers; within a buffer all but the first are known as such and dealt out by text,
    so that a passage of a third of the texts reaches its anchor's task as a few rows. Only the different segments of one anchor are brought
    together and suffix-sorted in batches of bounded size. An anchor with very many different segments
    is split by the exact 200-byte strings instead, whose counts are summed before the shuffle.

    Null texts count as empty. Rows with equal id and text are places of their own. Texts under 200 bytes
    are kept whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.xxhash64(F.lit(1), row_id, value).alias("k1"), F.xxhash64(F.lit(2), value, row_id).alias("k2"), F.col(row_id).alias("_id"), value.alias("text"))
    found = keyed.select("k1", "k2", "text").mapInArrow(_find_segments, "h long, w1 long, w2 long, k1 long, k2 long, start long, size int, twice boolean, local boolean")
    # both kinds come from one pass: which of equal segments stands for the others depends on the order of rows
    again = checkpoint(
        found.repartition(n, F.when(F.col("local"), F.col("k1")).otherwise(F.col("h"))).sortWithinPartitions("h", "w1", "w2")
        .mapInArrow(_keep_repeated, "h long, k1 long, k2 long, start long, size int, alike boolean, first boolean, number long")
    )
    release(spark)
    # segments of an anchor that has one kind only need no sorting; an anchor's segments meet its flag under several keys
    flags = again.where(F.col("first") & F.col("number").isin(2, HOT)).groupBy("h").agg((F.max("number") == HOT).alias("hot"))
    flags = flags.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = again.where("first").withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)).cast("int"))
    wanted = salted.join(flags, ["h", "salt"]).select("h", "k1", "k2", "start", "size", "alike", "hot")
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size", "h", "alike", "hot")).alias("wanted"))
    by_text = keyed.repartition(n, "k1", "k2")
    cut = checkpoint(
        by_text.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
        .mapInArrow(_cut, "h long, k1 long, k2 long, start long, weight int, part binary, window binary")
    )
    release(spark)
    sorted_runs = (
        cut.where("part is not null").select("h", "k1", "k2", "start", "part").repartition(n, "h").sortWithinPartitions("h")
        .mapInArrow(_sort_segments, "k1 long, k2 long, start long, end long")
    )
    windows = cut.where("window is not null")
    twice = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    exact_runs = windows.join(twice, "window").select("k1", "k2", "start", (F.col("start") + LENGTH).alias("end"))
    whole_runs = again.where("alike").select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("end"))
    runs = whole_runs.unionByName(sorted_runs).unionByName(exact_runs).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    kind = docs.schema[row_id].dataType.simpleString()
    return by_text.join(runs, ["k1", "k2"], "left").select(F.col("_id").alias(row_id), "text", "runs").mapInArrow(
        _finish([row_id]), f"`{row_id}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    )


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")
