"""SimHash near-duplicates searched with vantage-point trees (op7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, connected_components, table
from kadastra.llm.unions import Labels

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that a shard and its tree have on average, and those from which a shard is split by a vantage point of its own.
SHARD, LARGE = 4096, 1 << 16
#: Nodes of a tree with so many fingerprints or fewer are compared as a whole.
LEAF = 32
#: Row ids lie below this; classes of rows without ids are numbered downwards from the largest long.
LIMIT = 1 << 62


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' hashes, repeats counted.

    Words are runs of anything but ASCII white space after lower-casing A-Z. Fewer words
    than a shingle count as one shingle; none give 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops[k - 1 :])), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(h)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, fp): signed 64-bit fingerprints of whole texts; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(v.as_py()) for v in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[row_id, "fp"])

    return docs.select(row_id, text).mapInArrow(run, f"`{row_id}` {docs.schema[row_id].dataType.simpleString()}, fp long")


class VantageTree:
    """Links of all pairs of `x` within `radius`, kept as labels of components.

    A node splits its fingerprints at the median distance to a vantage point. A query goes to the
    inner side unless its distance exceeds the median by more than the radius, and to the outer
    side unless it falls short by as much (triangle inequality). Where a node's members are
    already one component, queries of that component are dropped: no new link can come of them.
    `nodes` counts the nodes that split, `compared` the distances computed at nodes and leaves.
    """

    def __init__(self, x: np.ndarray, radius: int):
        self.x, self.r, self.labels = x, radius, Labels(len(x))
        self.nodes = self.compared = 0
        if len(x):
            # everything near the first point is one component at once, which thins out dense groups
            near = np.flatnonzero(np.bitwise_count(x ^ x[0]) <= radius)
            self.labels.unite(near, np.zeros_like(near))
            self._search(np.arange(len(x)), np.arange(len(x)))

    def _search(self, members: np.ndarray, queries: np.ndarray) -> None:
        stack = [(members, queries)]
        x, r = self.x, self.r
        while stack:
            members, queries = stack.pop()
            own = self.labels.of(members)
            if (own == own[0]).all():
                queries = queries[self.labels.of(queries) != own[0]]
            if not len(queries):
                continue
            self.compared += len(members) * len(queries) if len(members) <= LEAF else len(members) + len(queries)
            if len(members) <= LEAF:
                for at in range(0, len(queries), 8192):
                    q = queries[at : at + 8192]
                    a, b = np.nonzero(np.bitwise_count(x[q][:, None] ^ x[members][None, :]) <= r)
                    self.labels.unite(q[a], members[b])
                continue
            self.nodes += 1
            vantage, rest = members[len(members) // 2], np.delete(members, len(members) // 2)
            d = np.bitwise_count(x[rest] ^ x[vantage]).astype(np.int64)
            dq = np.bitwise_count(x[queries] ^ x[vantage]).astype(np.int64)
            hit = queries[dq <= r]
            self.labels.unite(hit, np.full_like(hit, vantage))
            mu = int(np.median(d))
            if d.min() == d.max():  # all at one distance: halve the list instead
                half = len(rest) // 2
                keep = queries[np.abs(dq - mu) <= r]
                stack += [(rest[:half], keep), (rest[half:], keep)]
                continue
            if mu == d.max():
                mu -= 1
            stack += [(rest[d <= mu], queries[dq <= mu + r]), (rest[d > mu], queries[dq > mu - r])]


def _tree_links(radius: int):
    """Streams rows (key, fp, node) sorted by key; a tree for each shard, its spanning forest as links of nodes."""

    def links(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        fp, node = (np.concatenate(z) for z in zip(*parts))
        label = VantageTree(fp, radius).labels.all() if len(fp) > 1 else np.zeros(1, np.int64)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return node[at], node[label[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, node = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            bounds = [*np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist(), len(key)]
            out = []
            for s, e in zip(bounds, bounds[1:]):
                if held and key[s] != last:
                    out.append(links(held))
                    held = []
                last = key[s]
                held.append((fp[s:e], node[s:e]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), pa.int64()) for z in zip(*out)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in links(held)], names=["a", "b"])

    return run


def shard_keys(n: int, radius: int = RADIUS, size: int = SHARD) -> tuple[list[int], int]:
    """(masks, buckets): a fingerprint's shards are its bits under each mask, hashed to so many buckets.

    The 64 bits are parted into blocks, and a mask takes `blocks - radius` of them: fingerprints within the radius agree under one mask
    at least, for any number of blocks over the radius. With n fingerprints as few blocks are taken as make shards of
    `size` on average, and no more buckets than that needs.
    """
    blocks, buckets = radius + 1, max(1, -(-n // size))
    while 64 * (blocks - radius) // blocks < (buckets - 1).bit_length():
        blocks += 1
    if buckets == 1:
        return [0], 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)], buckets


def split_large(shards: DataFrame, radius: int = RADIUS, large: int = LARGE, rounds: int = 12) -> DataFrame:
    """`shards` (key, fp, node) with those of over `large` rows parted by distance to a vantage point of their own.

    The inner side has all up to the median distance, and beyond it the overlap that a ball of the radius reaches; the outer side
    has the rest. A pair within the radius lies on one side at least. A shard that its overlap keeps nearly whole, as a crowd within
    a few bits does, stays as it is: its tree is short, for its members are soon one component.
    """
    done, own = None, Window.partitionBy("key").orderBy("d")
    for _ in range(rounds):
        sizes = checkpoint(shards.groupBy("key").agg(F.count("*").alias("n"), F.max_by("fp", F.xxhash64("fp")).alias("vantage")).where(F.col("n") > large))
        if sizes.isEmpty():
            break
        far = shards.join(sizes, "key").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
        steps = far.groupBy("key", "n", "d").agg(F.count("*").alias("m"))
        upto, reach = F.sum("m").over(own), F.sum("m").over(own.rangeBetween(Window.unboundedPreceding, radius))
        steps = steps.withColumns({"upto": upto, "most": F.greatest(reach, F.col("n") - upto)}).where((F.col("upto") < F.col("n")) & (F.col("most") < F.col("n") * 0.9))
        cut = checkpoint(steps.groupBy("key").agg(F.min_by("d", F.abs(F.col("upto") * 2 - F.col("n"))).alias("mu")))
        whole = shards.join(cut, "key", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        sides = F.filter(F.array(F.when(F.col("d") <= F.col("mu") + radius, F.lit(0)), F.when(F.col("d") > F.col("mu"), F.lit(1))), lambda x: x.isNotNull())
        shards = checkpoint(far.join(cut, "key").select("key", "fp", "node", F.explode(sides).alias("side")).select(F.xxhash64("key", "side").alias("key"), "fp", "node"))
    return shards if done is None else done.unionByName(shards)


def near_links(classes: DataFrame, radius: int = RADIUS, *, size: int = SHARD, large: int = LARGE) -> DataFrame:
    """(a, b): links of nodes that join all distinct fingerprints within `radius` bits into their components.

    `classes` has a row (fp, node) for each distinct fingerprint. Each goes to the shards of `shard_keys`, whose number for a
    fingerprint is bounded (5 up to 33 million fingerprints), so no pair is missed and rows never grow with the square of a group.
    Shards that are very large all the same are split at vantage points, both sides overlapping at the boundary. A
    vantage-point tree then finds the links of each shard. An empty table gives none.
    """
    spark = classes.sparkSession
    masks, buckets = shard_keys(classes.count(), radius, size)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*(F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed(m))), F.lit(k)), F.lit(buckets)) * len(masks) + k for k, m in enumerate(masks)))
    shards = split_large(classes.select(F.explode(keys).alias("key"), "fp", "node"), radius, large)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_tree_links(radius), "a long, b long").distinct()


def near_components(rows: DataFrame, *, row_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """`rows` (row_id, fp, ...) with component_id: the least row_id reachable over links within the radius.

    Equal fingerprints are one class before any search, so copies are never paired. A class's node is its least id, so that the
    component is the answer itself. Classes whose ids are all null link like any other; a component of these alone is null. Ids are below 2^62.
    Ties and repeated rows have the same component. An empty table gives an empty result.
    """
    least = rows.groupBy("fp").agg(F.min(row_id).alias("least"))
    classes = checkpoint(least.select("fp", F.coalesce(F.col("least").cast("long"), F.lit((1 << 63) - 1) - F.monotonically_increasing_id()).alias("node")))
    parts = connected_components(near_links(classes, radius))
    labelled = classes.join(parts.withColumnRenamed("id", "node"), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    found = labelled.select("fp", F.when(F.col("component") < LIMIT, F.col("component")).alias("component_id"))
    return rows.join(found, "fp")


def keep_one(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each component: that of the least row_id.

    Which rows stay is decided on narrow rows told apart by id and 128 bits of hash over id and text, and one semi-join
    brings the texts; of rows alike in id and text one stays. Components of null ids only keep each different text once.
    An empty table gives an empty result.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    signed = {"_sign": F.xxhash64(row_id, text), "_sign2": F.xxhash64(F.lit(7), text, row_id)}
    narrow = docs.select(row_id, text).withColumns(signed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(v.as_py()) for v in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fp, pa.int64())], names=[row_id, "_sign", "_sign2", "fp"])

    rows = checkpoint(narrow.mapInArrow(run, f"`{row_id}` {kind}, _sign long, _sign2 long, fp long"))
    parts = near_components(rows, row_id=row_id).where(F.col(row_id).eqNullSafe(F.col("component_id")))
    # rows of one id with different texts: one text stays
    kept = parts.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.min(F.struct(*signed)).alias("s")).select("s.*")
    kept = checkpoint(kept.unionByName(parts.where(F.col(row_id).isNull()).select(*signed).distinct()))
    # the semi-join deals rows by their signs already, so making them distinct moves nothing more
    return docs.withColumns(signed).join(kept, [*signed], "left_semi").dropDuplicates([*signed]).drop(*signed)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    rows = checkpoint(fingerprints(table(spark, sf_dir, "documents")))
    out = near_components(rows)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
