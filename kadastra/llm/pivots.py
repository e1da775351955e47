"""Embedding near-duplicates by a pivot-permutation index (op9)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, connected_components, table
from kadastra.llm.unions import Labels

COSINE = 0.95
#: A vector is described by so many nearest pivots; a candidate shares at least SHARED of them.
NEAREST, SHARED = 10, 2
#: Pivots: four times the square root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
#: Lists are kept for sets of so many pivots, and a vector is in those of all sets of its so many nearest. One pivot is the default at any size. A caller
#: may ask for more: lists keep their length if sets grow by one pivot for every DEEPER times as many vectors as the pivots suffice for (`prefix_length`).
SETS, DEEPER = {1: NEAREST, 2: 6, 3: 6}, 32
#: Pivots have at most this cosine with each other.
APART = 0.7
#: Vectors on either side of one block of an inverted list.
BLOCK = 1024


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows in double precision, whether each is usable); shorter vectors are filled with zeros."""
    x = np.zeros((len(column), width))
    for i, v in enumerate(column):
        if v is not None and len(v):
            row = np.array([np.nan if c is None else c for c in v], np.float64)
            x[i, : len(row)] = row
    good = np.isfinite(x).all(axis=1)
    x[~good] = 0
    top = np.abs(x).max(axis=1, initial=0)
    x /= np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], good & (norm > 0)


def choose_pivots(vectors: DataFrame, n: int, *, column: str = "embedding") -> np.ndarray:
    """Reference points from a bounded sample: the usable vectors with the least hash of their components.

    A vector near one already chosen is passed over. A crowd of near copies would otherwise fill the
    sample, and its members would each have other nearest pivots among many alike. The sample, at most twice
    MOST_PIVOTS vectors, comes as Arrow columns.
    """
    k = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 4 * math.sqrt(n))))
    rows = vectors.select(column).orderBy(F.xxhash64(column)).limit(2 * k).toArrow().column(0)
    width = pc.max(pc.list_value_length(rows)).as_py() or 1
    chosen, m = np.zeros((k, width)), 0
    for at in range(0, len(rows), 1024):
        x, good = _matrix(rows.slice(at, 1024).to_pylist(), width)
        for v in x[good]:
            if m < k and not (m and (chosen[:m] @ v).max() > APART):
                chosen[m] = v
                m += 1
    return chosen[:m]


def prefix_length(n: int) -> int:
    """How many pivots a list's set may have for n vectors so that lists keep their length; a choice for callers, `near_vectors` never makes it."""
    enough, length = (MOST_PIVOTS / 4) ** 2, 1
    while n > enough and length < max(SETS):
        enough, length = enough * DEEPER, length + 1
    return length


def describe(vectors: DataFrame, pivots: np.ndarray, width: int, *, column: str = "embedding", nearest: int = NEAREST, prefix: int = 1) -> DataFrame:
    """(uid, node, weight, vec, dims, pivots, keys): unit vectors with the numbers of their nearest pivots, nearest first.

    `keys` are the lists that hold the vector: all sets of `prefix` among its nearest pivots, that of the very nearest first.
    Vectors that are null, zero or hold null or non-finite components are left out.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        k = min(nearest, len(p))
        size = min(prefix, k)
        sets = np.array(list(combinations(range(min(SETS[prefix] if prefix > 1 else k, k)), size)))
        p = np.pad(p, ((0, 0), (0, width - p.shape[1])))
        for batch in batches:
            values = batch.column(3).to_pylist()
            x, good = _matrix(values, width)
            at = np.flatnonzero(good)
            c = x[at] @ p.T
            near = np.argsort(-c, axis=1, kind="stable")[:, :k]
            keys = np.zeros((len(at), len(sets)), np.int64)
            for column in np.sort(near[:, sets], axis=2).transpose(2, 0, 1):
                keys = keys * MOST_PIVOTS + column
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(at)) for i in range(3)), pa.array([x[i].tobytes() for i in at], pa.binary()), pa.array([len(values[i]) for i in at], pa.int32()),
                 pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                names=["uid", "node", "weight", "vec", "dims", "pivots", "keys"],
            )

    return vectors.select("uid", "node", "weight", column).mapInArrow(run, "uid long, node long, weight long, vec binary, dims int, pivots array<int>, keys array<long>")


def _verify(cosine: float, least_shared: int):
    """Links between the home rows and the members of one block of an inverted list."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        home, member = f[f["home"]], f[~f["home"]]
        credit: dict[int, int] = {}
        forest = []
        if len(home) and len(member):
            hx, mx = (np.frombuffer(b"".join(g["vec"]), np.float64).reshape(len(g), -1) for g in (home, member))
            hp, mp = (np.stack(g["pivots"].to_numpy()) for g in (home, member))
            hk, mk = np.stack(home["keys"].to_numpy()), np.array([k[0] for k in member["keys"]])
            known, flat = np.unique(np.concatenate([hp.ravel(), mp.ravel()]), return_inverse=True)
            hi, mi = flat[: hp.size].reshape(hp.shape), flat[hp.size :].reshape(mp.shape)
            hot = np.zeros((len(member), len(known)), np.float32)
            np.put_along_axis(hot, mi, 1, axis=1)
            hu, mu, hd, md = home["uid"].to_numpy(), member["uid"].to_numpy(), home["dims"].to_numpy(), member["dims"].to_numpy()
            hw, mw = home["weight"].to_numpy(), member["weight"].to_numpy()
            uids, place = np.unique(np.concatenate([hu, mu]), return_inverse=True)
            ph, pm = place[: len(hu)], place[len(hu) :]
            labels, counts = Labels(len(uids)), np.zeros(len(uids), np.int64)
            for at in range(0, len(home), 512):
                to = slice(at, at + 512)
                own = np.zeros((len(hi[to]), len(known)), np.float32)
                np.put_along_axis(own, hi[to], 1, axis=1)
                ok = (own @ hot.T >= min(least_shared, hp.shape[1])) & (hd[to][:, None] == md[None, :]) & (hu[to][:, None] != mu[None, :])
                a, b = np.nonzero(ok & (hx[to] @ mx.T >= cosine))
                np.add.at(counts, ph[to][a], mw[b])
                # the other end is counted here unless its own list finds the pair too
                missed = ~(hk[to][a] == mk[b][:, None]).any(axis=1)
                np.add.at(counts, pm[b[missed]], hw[to][a[missed]])
                labels.unite(ph[to][a], pm[b])
            credit = {int(u): int(n) for u, n in zip(uids, counts) if n}
            label, nodes = labels.all(), np.zeros(len(uids), np.int64)
            nodes[ph], nodes[pm] = home["node"].to_numpy(), member["node"].to_numpy()
            forest = [(int(nodes[i]), int(nodes[label[i]])) for i in np.flatnonzero(label != np.arange(len(uids)))]
        return pd.DataFrame(
            [*((u, None, n) for u, n in credit.items()), *((a, b, None) for a, b in forest)], columns=["a", "b", "n"]
        ).astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    return run


def near_vectors(vectors: DataFrame, *, row_id: str = "vec_id", column: str = "embedding", cosine: float = COSINE, nearest: int = NEAREST, least_shared: int = SHARED, block: int = BLOCK, prefix: int = 1) -> DataFrame:
    """row_id, n_links, component_id, kept for each row of `vectors`.

    Every vector is described by its nearest pivots in order. The inverted list of a pivot holds all
    vectors that have it among theirs; each vector meets the list of its nearest pivot, those that
    share too few pivots are passed over and the rest verified in double precision. A pair is
    found if either end's nearest pivot is among the other's, and is counted once for
    each end. Where the caller asks for it (`prefix`) a list is kept for each set of two or three pivots instead; nothing chooses that by
    the table's size. A list is dealt out in blocks of a fixed size, home rows by members, so that a
    pivot with a large share of all vectors is spread over tasks; blocks return counts and a
    spanning forest, never pairs.

    Equal vectors are one class before any search, told apart by 128 bits of hash; a class counts for as
    many as it has, so copies are never compared with each other.

    Rows are told apart even when ids repeat. Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths with each other.
    A component's id is the least row_id in it; ids are below 2^62, classes without any id have a null component unless they link.
    Columns other than the two named are not used. An empty table gives an empty result.
    """
    value = F.col("embedding")
    usable = F.coalesce(F.forall(value, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))) & F.exists(value, lambda v: v != 0), F.lit(False))
    rows = checkpoint(
        vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(row_id).alias("row_id"), F.col(column).alias("embedding"))
        .withColumns({"k1": F.when(usable, F.xxhash64(value)), "k2": F.when(usable, F.xxhash64(F.lit(9), value))})
    )
    classes = checkpoint(rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.count("*").alias("weight"), F.min("row_id").cast("long").alias("least")))
    # a class's node is its least id, so the component is the answer itself
    classes = classes.withColumn("node", F.coalesce("least", F.lit((1 << 63) - 1) - F.col("uid"))).drop("least")
    kinds = rows.join(classes.select("uid", "node", "weight"), "uid")
    n, width = rows.agg(F.lit(classes.count()), F.max(F.size("embedding"))).first()
    pivots = choose_pivots(kinds, n)
    width = max(width or 1, pivots.shape[1] if len(pivots) else 1, 1)
    if len(pivots):
        seen = checkpoint(describe(kinds, pivots, width, nearest=nearest, prefix=prefix))
        homes = seen.groupBy(F.col("keys")[0].alias("pivot")).agg(F.count("*").alias("n_home"))
        lists = seen.select(F.explode("keys").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n_member"))
        dealt = homes.join(lists, "pivot").select("pivot", F.ceil(F.col("n_home") / block).cast("int").alias("i_all"), F.ceil(F.col("n_member") / block).cast("int").alias("j_all"))
        if prefix == 1:  # one row per pivot, and the pivots are bounded
            dealt = F.broadcast(dealt)
        part = lambda total, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(total)).cast("int")
        every = lambda total: F.explode(F.sequence(F.lit(0), F.col(total) - 1))
        home = seen.withColumn("pivot", F.col("keys")[0]).join(dealt, "pivot").withColumn("i", part("i_all", 1)).withColumn("j", every("j_all")).withColumn("home", F.lit(True))
        member = seen.withColumn("pivot", F.explode("keys")).join(dealt, "pivot").withColumn("j", part("j_all", 2)).withColumn("i", every("i_all")).withColumn("home", F.lit(False))
        columns = ["pivot", "i", "j", "home", "uid", "node", "weight", "vec", "dims", "pivots", "keys"]
        found = checkpoint(
            home.select(columns).unionByName(member.select(columns)).groupBy("pivot", "i", "j").applyInPandas(_verify(cosine, least_shared), "a long, b long, n long")
        )
        counts = found.where("n is not null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
        parts = connected_components(found.where("b is not null").select("a", "b"))
    else:
        counts = classes.where("false").select("uid", F.lit(0).cast("long").alias("n"))
        parts = classes.where("false").select(F.col("node").alias("id"), F.col("node").alias("component"))
    told = classes.join(counts, "uid", "left").join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = told.select("k1", "k2", F.when(F.col("component") < (1 << 62), F.col("component")).alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("row_id", "k1", "k2").join(told, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("row_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("row_id").alias(row_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("row_id") == component, F.lit(False)).alias("kept")
    )


def op9_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, by brute force; the index finds all links of the given tables.
OP9_SQL = """
with recursive e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
links as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as m from reach group by 1), n as (select a, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join least on least.a = vec_id
"""
