"""Polygons: centres, covers by cells, a point's area and areas that touch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.operators.storage import cut_lineage, merged, written


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses the closed ring an odd number of times."""

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, i + 1)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    edges = F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p, i: F.coalesce(crosses(p, i), F.lit(False)))
    return F.size(F.filter(edges, lambda e: e)) % 2 == 1


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings: holes count as outside."""
    return F.size(F.filter(rings, lambda r: inside(x, y, r))) % 2 == 1


def centroid(rings: Column) -> Column:
    """(x, y) of the centre of gravity of an area. Rings within an odd number of others are holes; without any extent it is the mean of all points."""

    def moments(ring: Column, i: Column) -> Column:
        o = ring[0]  # sums are taken from the ring's own first point, so that far away rings lose nothing
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(acc: Column, k: Column) -> Column:
            px, py, qx, qy = (F.get(ring, k + j)[c] - o[c] for j in (0, 1) for c in ("x", "y"))
            w = px * qy - qx * py
            return F.struct((acc["a"] + w).alias("a"), (acc["x"] + w * (px + qx)).alias("x"), (acc["y"] + w * (py + qy)).alias("y"))

        sums = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), start, lambda acc, k: F.when(F.size(ring) > 1, add(acc, k)).otherwise(acc))
        around = F.size(F.filter(rings, lambda r, j: (j != i) & inside(o["x"], o["y"], r)))
        sign = F.when(around % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))

        def placed(m: Column) -> Column:
            weight = sign * F.abs(m["a"])
            middle = lambda c: o[c] + F.coalesce(m[c] / F.nullif(3 * m["a"], F.lit(0.0)), F.lit(0.0))
            return F.struct(weight.alias("a"), (weight * middle("x")).alias("x"), (weight * middle("y")).alias("y"))

        return F.transform(F.array(sums), placed)[0]

    parts = F.transform(F.filter(rings, lambda r: F.size(r) > 0), moments)
    total = lambda c: F.aggregate(parts, F.lit(0.0), lambda acc, m: acc + m[c])
    mean = lambda c: F.aggregate(F.flatten(rings), F.lit(0.0), lambda acc, p: acc + p[c]) / F.nullif(F.size(F.flatten(rings)), F.lit(0))
    flat = total("a") == 0
    one = lambda c: F.when(flat, mean(c)).otherwise(total(c) / F.nullif(total("a"), F.lit(0.0)))
    return F.struct(one("x").alias("x"), one("y").alias("y"))


def _edges(rings: list) -> np.ndarray:
    found = [(p["x"], p["y"], q["x"], q["y"]) for r in rings or [] for p, q in zip(r, r[1:])]
    return np.array(found, np.float64).reshape(-1, 4)


def _covers(edges: np.ndarray, sizes: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """((area, level, cx, cy, inner), n_asked, asked): cells of side 2^level that cover each area, inner ones lie in it as a whole; all areas' cells of one depth are looked at together.

    `edges` are those of all areas in turn, `sizes` their numbers, each one at least. Each border cell has n_asked of the edges `asked`: a ray to the right from a point in it may
    cross these; edges below, above or left of the cell are never crossed.
    """
    begins = np.cumsum(sizes) - sizes
    x, y = np.sort(edges[:, [0, 2]], axis=1), np.sort(edges[:, [1, 3]], axis=1)
    low = {c: np.minimum.reduceat(v[:, 0], begins) for c, v in (("x", x), ("y", y))}
    high = {c: np.maximum.reduceat(v[:, 1], begins) for c, v in (("x", x), ("y", y))}
    reach = np.maximum(np.maximum(high["x"] - low["x"], high["y"] - low["y"]), 2.0**-60)
    level = np.ceil(np.log2(reach)).astype(np.int64)
    first, last = ({c: np.floor(v[c] / np.exp2(level)).astype(np.int64) for c in "xy"} for v in (low, high))
    area, cx, cy = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for u in (0, 1, 2):
        for v in (0, 1, 2):
            k = np.flatnonzero((first["x"] + u <= last["x"]) & (first["y"] + v <= last["y"]))
            area, cx, cy = np.append(area, k), np.append(cx, first["x"][k] + u), np.append(cy, first["y"][k] + v)
    inner = np.zeros(len(sizes), np.int64)
    out, asked = [], []
    while len(area):
        many = sizes[area]
        starts = np.cumsum(many) - many
        cell = np.repeat(np.arange(len(area)), many)
        edge = np.arange(len(cell)) - starts[cell] + begins[area][cell]
        e, ex, ey = edges[edge], x[edge], y[edge]
        side = np.exp2(level[area].astype(np.float64))
        s, x0, y0 = side[cell], (cx * side)[cell], (cy * side)[cell]
        # an edge whose line has all four corners on one side doesn't meet the cell; what rounding leaves open counts as meeting
        dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
        turns = np.stack([dx * (y0 + v * s - e[:, 1]) - dy * (x0 + u * s - e[:, 0]) for u in (0, 1) for v in (0, 1)])
        doubt = 1e-9 * (np.abs(dx) + np.abs(dy)) * (np.abs(x0) + np.abs(y0) + s + np.abs(e[:, 0]) + np.abs(e[:, 1]))
        meets = (ex[:, 0] <= x0 + s) & (ex[:, 1] >= x0) & (ey[:, 0] <= y0 + s) & (ey[:, 1] >= y0)
        meets &= (turns.min(axis=0) <= doubt) & (turns.max(axis=0) >= -doubt)
        border = np.logical_or.reduceat(meets, starts)
        mx, my = x0 + s / 2, y0 + s / 2
        crossed = ((e[:, 1] > my) != (e[:, 3] > my)) & (mx < e[:, 0] + (my - e[:, 1]) * dx / np.where(dy == 0, 1, dy))
        full = ~border & (np.add.reduceat(crossed.astype(np.int64), starts) % 2 == 1)
        inner += np.bincount(area[full], minlength=len(sizes))
        n = np.bincount(area[border], minlength=len(sizes))
        far = np.bincount(area, (np.abs(cx) > 1 << 50) | (np.abs(cy) > 1 << 50), len(sizes)) > 0
        stop = (inner + 4 * n > most) | (np.exp2(level.astype(np.float64)) < reach / 4096) | far
        done = border & stop[area]
        near = done[cell] & (ey[:, 0] <= y0 + s) & (ey[:, 1] >= y0) & (ey[:, 0] < ey[:, 1])
        near &= ex[:, 1] + 1e-9 * (np.abs(e[:, 0]) + np.abs(e[:, 2]) + s) >= x0
        for some in (full, done):
            out.append((area[some], level[area[some]], cx[some], cy[some], np.full(some.sum(), some is full)))
            asked.append((np.bincount(cell[near], minlength=len(area))[some] * (some is done), e[near] if some is done else e[:0]))
        go = border & ~stop[area]
        area, cx, cy = (np.concatenate(v) for v in zip(*((area[go], cx[go] * 2 + u, cy[go] * 2 + v) for u in (0, 1) for v in (0, 1))))
        level = level - 1
    columns = [np.concatenate(c) for c in zip(*out)]
    return columns, np.concatenate([n for n, _ in asked]), np.concatenate([v for _, v in asked])


def cover(areas: DataFrame, *, most: int = 256, edges: bool = False) -> DataFrame:
    """(area, level, cx, cy, inner): a quadtree cover of each area by at most `most` cells, as deep as that allows.

    Cells have a side of 2^level and start at multiples of it, so an area is covered in its own scale however large or small it is. Only cells that the border
    meets are split. Areas without edges have no cells, nor have those with coordinates that aren't finite. With `edges` cells on the border bring
    the edges that decide about their points, as (px, py, qx, qy); inner ones bring none.
    """
    names = ("px", "py", "qx", "qy")

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def cells(batch: pa.RecordBatch, at: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        (area, *columns), n, asked = _covers(np.concatenate(found), np.array([len(f) for f in found]), most)
        arrays = [batch.column(0).take(pa.array(np.array(at)[area])), *(pa.array(c).cast(k) for c, k in zip(columns, kinds))]
        if edges:
            offsets = np.concatenate([[0], n.cumsum()]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(asked[:, j]) for j in range(4)], names=list(names))))
        return pa.RecordBatch.from_arrays(arrays, names=["area", "level", "cx", "cy", "inner", *(["edges"] if edges else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, n = [], [], 0
            for i, rings in enumerate(batch.column(1)):
                mine = _edges([r for r in rings.as_py() or [] if r])
                if len(mine) and np.isfinite(mine).all():
                    if found and (n + len(mine)) * most > 500_000:  # what is looked at together
                        yield cells(batch, at, found)
                        at, found, n = [], [], 0
                    at.append(i)
                    found.append(mine)
                    n += len(mine)
            if found:
                yield cells(batch, at, found)

    tasks = 4 * areas.sparkSession.sparkContext.defaultParallelism  # small files are few tasks, and covers take time
    more = f", edges array<struct<{', '.join(f'{n}:double' for n in names)}>>" if edges else ""
    return areas.select("area", "rings").repartition(tasks, "area").mapInArrow(run, f"area {areas.schema['area'].dataType.simpleString()}, level int, cx long, cy long, inner boolean{more}")


def areas_at(points: DataFrame, areas: DataFrame, *, key: str = "name", most: int = 32) -> DataFrame:
    """(key, area): all areas that hold each point (key, x, y).

    Points meet the cells of the areas' covers by equality, once for each level that occurs; inner cells are answers by themselves, those on the border ask the few
    edges that they bring, so pairs are neither shuffled nor joined again. A cell is no larger than its area and their number for each area is bounded, so neither tiny
    nor huge areas are listed in many cells. How deep covers go changes the work and not the answer.
    """
    cells = written(cover(areas, most=most, edges=True))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # exponents of two: some dozens
    usable = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select(key, "x", "y")
    at = usable.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    side = F.pow(F.lit(2.0), F.col("level"))
    met = at.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)).join(merged(cells), ["level", "cx", "cy"])

    def crosses(e: Column) -> Column:
        across = e["px"] + (F.col("y") - e["py"]) * (e["qx"] - e["px"]) / (e["qy"] - e["py"])
        return ((e["py"] > F.col("y")) != (e["qy"] > F.col("y"))) & (F.col("x") < across)

    return met.where(F.col("inner") | (F.size(F.filter("edges", crosses)) % 2 == 1)).select(key, "area")


def point_in_area(points: DataFrame, areas: DataFrame, *, key: str = "name", most: int = 32) -> DataFrame:
    """`points` (name, x, y) with the first area (area, rings) that holds each, or null."""
    first = areas_at(points, areas, key=key, most=most).groupBy(key).agg(F.min("area").alias("area"))
    return points.join(merged(first), key, "left")


#: Areas of so many points at most are compared as a whole; what few edges they have need no cells of their own.
FEW_POINTS = 32
#: Rows of a cell that are compared together; cells of more are dealt out in parts, each with each.
CELL_ROWS = 4096


def _ranges(first: np.ndarray, last: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j from first[i] to last[i] - 1, about `most` at a time."""
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        i = np.repeat(np.arange(at, to), n[at:to])
        begins = ends[at:to] - n[at:to] - (ends[at - 1] if at else 0)
        yield i, np.arange(len(i)) - np.repeat(begins - first[at:to], n[at:to])
        at = to


def _apart(p: tuple, d: tuple, q: tuple, e: tuple, short: bool) -> np.ndarray:
    """Whether one of the edges from p by d and from q by e lies wholly on one side of the other's line, exactly; the gaps of `short` ones are below 2^31."""
    (px, py), (dx, dy), (qx, qy), (ex, ey) = p, d, q, e
    wx, wy = qx - px, qy - py
    if short:
        turn = dx * ey - dy * ex
        sides = [dx * wy - dy * wx, ey * wx - ex * wy]
        sides = [sides[0], sides[0] + turn, sides[1], sides[1] - turn]
    else:
        sides = [_side(dx, dy, wx, wy), _side(dx, dy, wx + ex, wy + ey), _side(ex, ey, -wx, -wy), _side(ex, ey, dx - wx, dy - wy)]
    above, below = [v > 0 for v in sides], [v < 0 for v in sides]
    return above[0] & above[1] | below[0] & below[1] | above[2] & above[3] | below[2] & below[3]


def _side(dx: np.ndarray, dy: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sign of dx * y - dy * x: doubles decide unless the products lie as near as their rounding; then integers of any length do."""
    left, right = dx.astype(np.float64) * y, dy.astype(np.float64) * x
    out = np.sign(left - right).astype(np.int64)
    for k in np.flatnonzero((left != 0) & (np.abs(left - right) <= 1e-15 * (np.abs(left) + np.abs(right)))):
        exact = int(dx[k]) * int(y[k]) - int(dy[k]) * int(x[k])
        out[k] = (exact > 0) - (exact < 0)
    return out


class _Cells:
    """Rows (level, cx, cy, own, x, y, n) of whole cells, sorted by cell, as arrays: points of each area, ring after ring, edges, and boxes of whole numbers."""

    def __init__(self, rows: pa.Table, group: np.ndarray, digits: int) -> None:
        get = lambda c: rows.column(c).combine_chunks()
        self.x, self.y = (get(c).flatten().to_numpy() for c in "xy")
        size = get("n").flatten().to_numpy().astype(np.int64)
        rings = get("n").value_lengths().to_numpy().astype(np.int64)
        ring_row = np.repeat(np.arange(len(rings)), rings)
        begins = np.cumsum(size) - size
        points = np.bincount(ring_row, size, len(rings)).astype(np.int64)
        whole = lambda c: (lambda v: (np.trunc(v) + np.where(np.abs(v - np.trunc(v)) >= 0.5, np.sign(v), 0)).astype(np.int64))(c * 10.0**digits)
        self.wx, self.wy = whole(self.x), whole(self.y)
        # edges go from a point to the next but from the last of a ring
        inner = np.ones(len(self.x), bool)
        inner[begins + size - 1] = False
        self.edge = np.flatnonzero(inner)
        self.edges = points - rings
        self.edge_at = np.cumsum(self.edges) - self.edges
        self.corner, self.corners = begins, rings
        self.corner_at = np.cumsum(rings) - rings
        at = np.cumsum(points) - points
        self.x0, self.xx = np.minimum.reduceat(self.wx, at), np.maximum.reduceat(self.wx, at)
        self.y0, self.yy = np.minimum.reduceat(self.wy, at), np.maximum.reduceat(self.wy, at)
        e = self.edge
        self.ex, self.ey, self.dx, self.dy = self.wx[e], self.wy[e], self.wx[e + 1] - self.wx[e], self.wy[e + 1] - self.wy[e]
        self.ex0, self.exx = self.ex + np.minimum(self.dx, 0), self.ex + np.maximum(self.dx, 0)
        self.ey0, self.eyy = self.ey + np.minimum(self.dy, 0), self.ey + np.maximum(self.dy, 0)
        self.short = max(int(np.abs(d).max(initial=0)) for d in (self.dx, self.dy)) < 1 << 30
        self.group, self.own, self.part = group, get("own").to_numpy(zero_copy_only=False), get("part").to_numpy()
        self.mixed = get("p").to_numpy() != get("q").to_numpy()
        level = get("level").to_numpy().astype(np.int64)
        self.starts_x, self.starts_y = (self.x0 >> level) == get("cx").to_numpy(), (self.y0 >> level) == get("cy").to_numpy()

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Two rows of a cell whose boxes meet, one of them of the cell's size at least; only in the cell where what their boxes share begins."""
        order = np.lexsort((self.x0, self.group))
        group, own = self.group[order], self.own[order]
        values = np.unique(self.x0)
        key = lambda v: group * (len(values) + 1) + np.searchsorted(values, v, "right")
        begin, end = key(self.x0[order]), key(self.xx[order])
        # rows are met by those after them that begin before they end and in the cell: the rows of a cell that begin left of it come first
        cells = int(group[-1]) + 1
        inside = np.searchsorted(group, np.arange(cells)) + np.bincount(group, ~self.starts_x[order], cells).astype(np.int64)
        first = np.maximum(np.arange(len(order)) + 1, inside[group])
        large = np.flatnonzero(own)
        for rows, after, low, high in (
            (large, np.arange(len(order)), first[large], np.searchsorted(begin, end[large], "right")),
            (small := np.flatnonzero(~own), large, np.searchsorted(large, first[small]), np.searchsorted(begin[large], end[small], "right")),
        ):
            for i, j in _ranges(low, high, most):
                i, j = order[rows[i]], order[after[j]]
                keep = (self.y0[i] <= self.yy[j]) & (self.y0[j] <= self.yy[i]) & np.where(self.y0[i] >= self.y0[j], self.starts_y[i], self.starts_y[j])
                keep &= ~self.mixed[i] | (self.part[i] != self.part[j])
                yield i[keep], j[keep]

    def meet(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Whether the borders of the areas i and j share a point: an edge of i after the other against all of j, until one meets."""
        out = np.zeros(len(i), bool)
        todo, turn = np.flatnonzero(self.edges[i] > 0), 0
        while len(todo):
            a, b = self.edge_at[i[todo]] + turn, j[todo]
            near = (self.ex0[a] <= self.xx[b]) & (self.x0[b] <= self.exx[a]) & (self.ey0[a] <= self.yy[b]) & (self.y0[b] <= self.eyy[a])
            pair, edge, b = todo[near], a[near], b[near]
            for k, f in _ranges(self.edge_at[b], self.edge_at[b] + self.edges[b], most):
                e = edge[k]
                near = (self.ex0[e] <= self.exx[f]) & (self.ex0[f] <= self.exx[e]) & (self.ey0[e] <= self.eyy[f]) & (self.ey0[f] <= self.eyy[e])
                k, e, f = k[near], e[near], f[near]
                # with overlapping boxes, edges meet unless one lies wholly on one side of the other's line
                apart = _apart((self.ex[e], self.ey[e]), (self.dx[e], self.dy[e]), (self.ex[f], self.ey[f]), (self.dx[f], self.dy[f]), self.short)
                out[pair[k[~apart]]] = True
            turn += 1
            todo = todo[~out[todo] & (self.edges[i[todo]] > turn)]
        return out

    def holds(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Whether the areas j hold the first point of a ring of the areas i."""
        out = np.zeros(len(i), bool)
        for pair, k in _ranges(np.zeros(len(i), np.int64), self.corners[i], most):
            at, b = self.corner[self.corner_at[i[pair]] + k], j[pair]
            near = (self.x0[b] <= self.wx[at]) & (self.wx[at] <= self.xx[b]) & (self.y0[b] <= self.wy[at]) & (self.wy[at] <= self.yy[b])
            pair, x, y, b = pair[near], self.x[at[near]], self.y[at[near]], b[near]
            for c, edge in _ranges(self.edge_at[b], self.edge_at[b] + self.edges[b], most):
                e = self.edge[edge]
                px, py, qx, qy = self.x[e], self.y[e], self.x[e + 1], self.y[e + 1]
                across = (py > y[c]) != (qy > y[c])
                c, px, py, qx, qy = (v[across] for v in (c, px, py, qx, qy))
                hit = np.bincount(c[x[c] < px + (y[c] - py) * (qx - px) / (qy - py)], minlength=len(b)) % 2 == 1
                out[pair[hit]] = True
        return out


def _touching_few(rows: DataFrame, digits: int, tasks: int) -> DataFrame:
    """`touching` for areas (area, x, y, n, x0, xx, y0, yy, size) of few points, each named once: every pair is decided in one place, so found pairs are not shuffled."""
    levels = F.array(*(F.lit(r["size"]) for r in rows.select("size").distinct().orderBy("size").collect())).cast("array<int>")  # 32 at most
    spread = rows.withColumn("level", F.explode(levels)).where("level >= size")
    for c in "xy":
        spread = spread.withColumn(f"c{c}", F.explode(F.expr(f"sequence(shiftright({c}0, level), shiftright({c}{c}, level))")))
    spread = spread.select("level", "cx", "cy", (F.col("size") == F.col("level")).alias("own"), "area", "x", "y", "n")
    # a cell of many rows has parts, and a row goes to each pair of parts that has its own; such cells are few for each row
    full = spread.groupBy("level", "cx", "cy").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")).where("parts > 1")
    dealt = spread.join(F.broadcast(full), ["level", "cx", "cy"], "left").withColumn("part", F.coalesce(F.expr("cast(pmod(xxhash64(area), parts) as int)"), F.lit(0)))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).withColumn("p", F.least("part", "with")).withColumn("q", F.greatest("part", "with"))
    keys = ["level", "cx", "cy", "p", "q"]

    def compared(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, area = _Cells(rows, group, digits), rows.column("area").combine_chunks()
        for i, j in c.pairs(16_000):
            met = c.meet(i, j, 64_000)
            k, m = i[~met], j[~met]
            within, around = c.holds(k, m, 64_000), c.holds(m, k, 64_000)
            a = np.concatenate([i[met], j[met], k[within], m[around]])
            b = np.concatenate([j[met], i[met], m[within], k[around]])
            if len(a):
                yield pa.RecordBatch.from_arrays([area.take(pa.array(a)), area.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            at = np.stack([rows.column(k).to_numpy() for k in keys])
            group = np.concatenate([[0], np.cumsum((at[:, 1:] != at[:, :-1]).any(axis=0))]) if rows.num_rows else np.zeros(0, np.int64)
            done = int(np.searchsorted(group, group[-1])) if rows.num_rows else 0  # the last cell may go on
            if done:
                yield from compared(rows.slice(0, done), group[:done])
            held = rows.slice(done).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from compared(rows, np.zeros(rows.num_rows, np.int64))

    kind = rows.schema["area"].dataType.simpleString()
    sorted_cells = dealt.select(*keys, "part", "own", "area", "x", "y", "n").repartition(tasks, *keys).sortWithinPartitions(*keys)
    return sorted_cells.mapInArrow(run, f"a {kind}, b {kind}")


def touching(areas: DataFrame, digits: int = 6) -> DataFrame:
    """(a, b): areas whose polygon b meets the border of a: in a point, along part of an edge, by crossing it, or by holding all of it.

    Areas of few points are put into cells of about their own size and into the larger cells around these for each size that occurs; two of them are compared
    in the one cell where what their boxes share begins, and found pairs are neither shuffled nor sorted. Of areas with more points, or of more than one row, the edges are put into
    cells in the same way. Coordinates are rounded to `digits` and compared as integers, so contact is exact. An area that lies within another without
    touching its border is found by a point of each ring. Areas don't meet themselves.
    """
    tasks = 4 * areas.sparkSession.sparkContext.defaultParallelism  # small files are few tasks, and pairs are many
    whole = lambda c: F.round(c * 10**digits).cast("long")
    points, most = F.flatten("rings"), 2.0**52 / 10**digits
    usable = F.forall(points, lambda p: F.coalesce((F.abs(p["x"]) < most) & (F.abs(p["y"]) < most), F.lit(False)))
    rows = areas.where("area is not null and rings is not null").select("area", "rings").repartition(tasks, "area")
    rows = rows.withColumn("few", F.coalesce((F.size(points) <= FEW_POINTS) & usable, F.lit(False))).withColumn("n", F.when(F.col("few"), F.transform(F.filter("rings", lambda r: F.size(r) > 0), F.size)))
    for c in "xy":
        rows = rows.withColumn(c, F.when(F.col("few"), F.transform(points, lambda p: p["x"] if c == "x" else p["y"])))  # noqa: B023
        rows = rows.withColumn(f"{c}0", whole(F.array_min(c))).withColumn(f"{c}{c}", whole(F.array_max(c)))
    reach = F.greatest(F.col("xx") - F.col("x0"), F.col("yy") - F.col("y0"), F.lit(1)).cast("double")
    rows = written(rows.withColumn("size", (F.ceil(F.log2(reach) / 2) * 2).cast("int")))
    again = rows.groupBy("area").count().where("count > 1").select("area", F.lit(True).alias("again"))
    if not again.isEmpty():
        rows = written(rows.join(merged(again), "area", "left").withColumn("few", F.col("few") & F.col("again").isNull()))
    few = _touching_few(rows.where("few and x0 is not null"), digits, tasks)
    return few if rows.where("not few").isEmpty() else few.unionByName(_touching_edges(rows.select("area", "rings", "few"), digits))


def _touching_edges(areas: DataFrame, digits: int) -> DataFrame:
    """`touching` for those pairs of areas (area, rings, few) of which one at least isn't `few`.

    Edges are put into cells of about their own size, four at most, and into the larger cells around these for each size that occurs; two edges that meet
    share a point, and so the cell around it that has the larger one's size. Only edges in one cell with overlapping boxes are compared.
    """
    whole = lambda c: F.round(c * 10**digits).cast("long")
    ring = areas.select("area", "few", F.explode("rings").alias("r"))
    pairs = F.transform(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))), lambda p, i: F.struct(whole(p["x"]).alias("x1"), whole(p["y"]).alias("y1"), whole(F.get("r", i + 1)["x"]).alias("x2"), whole(F.get("r", i + 1)["y"]).alias("y2")))
    e = ring.select("area", "few", F.explode(pairs).alias("e")).select("area", "few", "e.*").where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").distinct()
    e = e.select("*", F.least("x1", "x2").alias("x0"), F.greatest("x1", "x2").alias("xx"), F.least("y1", "y2").alias("y0"), F.greatest("y1", "y2").alias("yy"))
    level = F.ceil(F.log2(F.greatest(F.col("xx") - F.col("x0"), F.col("yy") - F.col("y0"), F.lit(1)).cast("double"))).cast("int")
    e = cut_lineage(e.withColumn("own", level))
    levels = F.array(*(F.lit(r["own"]) for r in e.select("own").distinct().orderBy("own").collect())).cast("array<int>")  # 64 at most
    cells = F.expr("flatten(transform(sequence(shiftright(x0, level), shiftright(xx, level)), cx -> transform(sequence(shiftright(y0, level), shiftright(yy, level)), cy -> struct(cx, cy))))")
    spread = e.withColumn("level", F.explode(F.filter(levels, lambda v: v >= F.col("own")))).withColumn("c", F.explode(cells))
    names = ["area", "few", "own", "x1", "y1", "x2", "y2", "x0", "xx", "y0", "yy"]
    side = lambda df, n: df.select("level", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"), *(F.col(c).alias(f"{n}_{c}") for c in names))
    p, q = side(spread, "p"), side(spread.where("level = own"), "q")
    boxes = "p_area <> q_area and p_x0 <= q_xx and q_x0 <= p_xx and p_y0 <= q_yy and q_y0 <= p_yy"
    # two edges are compared in one cell only, where their boxes begin to overlap; those of one size once, not from either side
    once = "(p_own < level or p_area < q_area) and shiftright(greatest(p_x0, q_x0), level) = cx and shiftright(greatest(p_y0, q_y0), level) = cy"

    def turn(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> Column:
        """On which side of the line from a to b the point c lies."""
        gap = lambda u, v, kind: (F.col(v) - F.col(u)).cast(kind)
        product = lambda kind: (gap(a[0], b[0], kind) * gap(a[1], c[1], kind), gap(a[1], b[1], kind) * gap(a[0], c[0], kind))
        left, right = product("decimal(19,0)")
        exact = F.when(left > right, 1).when(left < right, -1).otherwise(0)
        # doubles decide unless the products lie as near as their rounding; then integers do
        left, right = product("double")
        doubt = 1e-15 * (F.abs(left) + F.abs(right))
        return F.when(left - right > doubt, 1).when(right - left > doubt, -1).when((left == 0) & (right == 0), 0).otherwise(exact)

    ends = {n: ((f"{n}_x1", f"{n}_y1"), (f"{n}_x2", f"{n}_y2")) for n in "pq"}
    # with overlapping boxes, edges meet unless one lies wholly on one side of the other's line
    apart = (turn(*ends["p"], ends["q"][0]) * turn(*ends["p"], ends["q"][1]) > 0) | (turn(*ends["q"], ends["p"][0]) * turn(*ends["q"], ends["p"][1]) > 0)

    def met(p: DataFrame, q: DataFrame) -> DataFrame:
        return p.join(merged(q), ["level", "cx", "cy"]).where(boxes).where(once).where(~apart).select(F.col("p_area").alias("a"), F.col("q_area").alias("b"))

    found = met(p.where("not p_few"), q).unionByName(met(p.where("p_few"), q.where("not q_few"))).distinct()
    corners = cut_lineage(ring.where(F.size("r") > 0).select(F.struct("area", "few", F.monotonically_increasing_id().alias("_n")).alias("name"), F.col("r")[0]["x"].alias("x"), F.col("r")[0]["y"].alias("y")))
    held = areas_at(corners, areas.where("not few")).unionByName(areas_at(corners.where("not name.few"), areas.where("few")))
    held = held.select(F.col("name.area").alias("a"), F.col("area").alias("b")).where("a <> b")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(held).distinct()


def adjacent(areas: DataFrame, digits: int = 6) -> DataFrame:
    """(a, b): areas with a common border edge, both ways, without themselves. Edges are met by equality."""
    points = areas.select("area", F.explode("rings").alias("r"))
    pair = lambda p, q: F.array_sort(F.array(p, q))
    at = lambda p: F.concat_ws(" ", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    edges = points.select("area", F.explode(F.transform(F.slice("r", 1, F.size("r") - 1), lambda p, i: F.array_join(pair(at(p), at(F.get("r", i + 1))), "|"))).alias("edge")).distinct()
    e = edges.alias("l").join(edges.withColumnRenamed("area", "other").alias("m"), "edge")
    return e.where("area <> other").select(F.col("area").alias("a"), F.col("other").alias("b")).distinct()
