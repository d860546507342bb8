"""Areas of any shape as runs of cells: rows key, iy, a, b hold the cells a to b (both included) of a row of cells.

A cell belongs to a shape by its centre. Rings are cut into rows of cells by their edges' crossings, distances by the rows' sections of each
edge's surroundings, so a large area is many short rows and no cell is a row of its own. Union, intersection, difference and erosion are one
sweep over the runs' ends, partitioned by key and row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .overlay import BOUNDARY_OFFSET, PREFERRED_SHRINK, RESTRICTED, ROOT_EXTRA, TREE_CANOPY, UTILITY_WIDTH

#: Centres so near an edge or a distance count as on it.
EPS = 1e-9
#: How many rows of cells a band has, and how many runs' ends a task sorts at a time, about.
BAND, AT_ONCE = 1024, 2_000_000
#: Fixed value: the width of a site's surroundings where none, or 0, is given.
SITE_WIDTH = 30.0


def swept(sides: dict[str, DataFrame], keys: list[str], keep: Callable[..., Column]) -> DataFrame:
    """keys, iy, a, b where keep holds of the numbers of runs of each side that lie there; runs are as long as can be."""
    names = list(sides)

    def ends(name: str) -> DataFrame:
        two = F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("n")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("n")))
        return sides[name].select(*keys, "iy", F.inline(two)).select(*keys, "iy", "x", *((F.col("n") if k == name else F.lit(0)).alias(f"n_{k}") for k in names))

    every = reduce(lambda a, b: a.unionByName(b), map(ends, names)).groupBy(*keys, "iy", "x").agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in names))
    order = Window.partitionBy(*keys, "iy").orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = every.select(*keys, "iy", "x", keep(*(F.sum(f"n_{k}").over(upto) for k in names)).alias("in_"))
    turns = told.withColumn("was_", F.coalesce(F.lag("in_").over(order), F.lit(False))).where("in_ <> was_")
    return turns.withColumn("b", F.lead("x").over(order) - 1).where("in_").select(*keys, "iy", F.col("x").alias("a"), "b")


def united(sides: list[DataFrame], keys: list[str]) -> DataFrame:
    return swept({"s": reduce(lambda a, b: a.unionByName(b), (x.select(*keys, "iy", "a", "b") for x in sides))}, keys, lambda n: n > 0)


def row_span(low: Column, high: Column, res: float) -> Column:
    """The rows, or columns, whose centres lie from low to high."""
    first, last = F.ceil((low - EPS) / res - 0.5), F.floor((high + EPS) / res - 0.5)
    return F.when(first <= last, F.sequence(first, last))


def cell_run(low: Column, high: Column, res: float) -> list[Column]:
    return [F.ceil((low - EPS) / res - 0.5).alias("a"), F.floor((high + EPS) / res - 0.5).alias("b")]


def filled(shapes: DataFrame, keys: list[str], ring: str, res: float = 1.0) -> DataFrame:
    """Runs of the cells inside a ring (even-odd), a row of cells at a time."""
    box = G.bounds(F.col(ring))
    y = (F.col("iy") + 0.5) * res
    rows = shapes.select(*keys, ring, F.explode(row_span(box["y0"], box["y1"], res)).alias("iy"))
    crossing = lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)
    at = lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
    xs = F.array_sort(F.transform(F.filter(G.edges(F.col(ring)), crossing), at))
    cut = rows.select(*keys, "iy", xs.alias("xs")).where("size(xs) > 1")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")), lambda i: F.struct(F.get("xs", (2 * i).cast("int")).alias("x0"), F.get("xs", (2 * i + 1).cast("int")).alias("x1")))
    return cut.select(*keys, "iy", F.inline(pairs)).select(*keys, "iy", *cell_run(F.col("x0"), F.col("x1"), res)).where("a <= b")


def buffered_areas(plots: DataFrame, ring: str, width: Column, res: float = 1.0) -> DataFrame:
    """plot_id, area of the cells on a plot or within the width (SITE_WIDTH where null or 0) of it, with round corners."""
    distance = F.coalesce(F.nullif(width.cast("double"), F.lit(0.0)), F.lit(SITE_WIDTH))

    def measured(t: Pieces) -> list:
        return [t.united(t.filled("ring"), t.near("ring"))]

    return banded(plots.select("plot_id", F.col(ring).alias("ring"), distance.alias("d")), None, ["area"], measured, res).where("area > 0")


def zone_widths(features: DataFrame) -> DataFrame:
    """plot_id, kind, d and box of the features that have a protection width."""
    width = F.coalesce(F.create_map(*(F.lit(x) for k, w in UTILITY_WIDTH.items() for x in (k, w)))[F.col("layer_key")], F.when(F.col("layer_key") == "tree", TREE_CANOPY + ROOT_EXTRA).when(F.col("layer_key").isin(*RESTRICTED), 0.0))
    kind = F.when(F.col("layer_key") == "tree", "root_protection_zone").when(F.col("layer_key").isin(*UTILITY_WIDTH), "utility_protection_zone").otherwise(F.col("layer_key"))
    return features.select("plot_id", kind.alias("kind"), width.alias("d"), "fx0", "fy0", "fx1", "fy1").where("d IS NOT NULL")


def zone_sections(features: DataFrame, res: float = 1.0) -> DataFrame:
    """plot_id, kind, iy, a, b of the cells within each feature's protection width of its box; some overlap."""
    rows = zone_widths(features).withColumn("iy", F.explode(row_span(F.col("fy0") - F.col("d"), F.col("fy1") + F.col("d"), res)))
    y = (F.col("iy") + 0.5) * res
    off = F.greatest(F.col("fy0") - y, F.lit(0.0), y - F.col("fy1"))
    side = F.sqrt(F.greatest(F.lit(0.0), F.col("d") * F.col("d") - off * off))
    return rows.select("plot_id", "kind", "iy", *cell_run(F.col("fx0") - side, F.col("fx1") + side, res)).where("a <= b")


def zone_runs(features: DataFrame, res: float = 1.0) -> DataFrame:
    """zone_sections without overlaps, a kind at a time."""
    return united([zone_sections(features, res)], ["plot_id", "kind"])


def box_span(low: Column, high: Column, res: float) -> tuple[Column, Column]:
    """The first and the last cell whose centres lie from low to high."""
    return F.ceil((low - res / 2) / res), F.floor((high - res / 2) / res)


def boxed_areas(runs: DataFrame, boxes: DataFrame, keys: list[str], name: str, res: float = 1.0) -> DataFrame:
    """keys and the area of the runs' parts in their plot's box (boxes: plot_id, x0, y0, x1, y1): rows and ends are clipped, so a plot stays one row."""
    (a0, b0), (i0, i1) = box_span(F.col("x0"), F.col("x1"), res), box_span(F.col("y0"), F.col("y1"), res)
    spans = boxes.select("plot_id", a0.alias("a0"), b0.alias("b0"), i0.alias("i0"), i1.alias("i1"))
    met = runs.join(spans.hint("merge"), "plot_id").where("iy BETWEEN i0 AND i1 AND a <= b0 AND b >= a0 AND a0 <= b0")
    return met.groupBy(*keys).agg((F.sum(F.least("b", "b0") - F.greatest("a", "a0") + 1) * res * res).alias(name))




def zone_areas_on(plots: DataFrame, ring: str, features: DataFrame, res: float = 1.0) -> DataFrame:
    """plot_id, kind, area of each protection zone's part on its plot, whose ring may have any shape."""
    zones = zone_runs(features, res)
    own = united([filled(plots, ["plot_id"], ring, res)], ["plot_id"]).select("plot_id", "iy", F.col("a").alias("pa"), F.col("b").alias("pb"))
    met = zones.join(own.hint("merge"), ["plot_id", "iy"]).where("a <= pb AND b >= pa")
    return met.groupBy("plot_id", "kind").agg((F.sum(F.least("b", "pb") - F.greatest("a", "pa") + 1) * res * res).alias("area"))


def set_areas(plots: DataFrame, ring: str, other: str, res: float = 1.0) -> DataFrame:
    """U4: plot_id, both, common, rest: the areas of a ring's and another's union, intersection and difference, null where there is nothing."""

    def measured(t: Pieces) -> list:
        sides = [t.filled("ring"), t.filled("other")]
        return [t.united(*sides), t.swept(sides, lambda p, q: (p > 0) & (q > 0)), t.swept(sides, lambda p, q: (p > 0) & (q == 0))]

    names = ["both", "common", "rest"]
    told = banded(plots.select("plot_id", F.col(ring).alias("ring"), F.col(other).alias("other")), None, names, measured, res)
    return plots.select("plot_id").join(told.hint("merge"), "plot_id", "left").select("plot_id", *(F.when(F.col(c) > 0, F.col(c)).alias(c) for c in names))


def buildable_zones(plots: DataFrame, ring: str, features: DataFrame, res: float = 1.0) -> DataFrame:
    """plot_id, plot_area, buildable_area, envelope_area, preferred_area of plots of any shape, by cells.

    Buildable is the plot without the strip along its boundary and the zones. The envelope is what is buildable, or the plot where nothing
    is; the preferred zone what is farther than PREFERRED_SHRINK from anything not buildable, or the envelope where there is none.
    """
    names = ["plot_area", "buildable_area", "inner_area"]

    def measured(t: Pieces) -> list:
        own = t.united(t.filled("ring"))
        free = t.swept([own, t.both(t.near("ring", strict=True), t.zones())], lambda p, q: (p > 0) & (q == 0))
        return [own, free, t.eroded(free, PREFERRED_SHRINK)]

    wide = zone_widths(features).select("plot_id", "d", "fx0", "fy0", "fx1", "fy1")
    told = banded(plots.select("plot_id", F.col(ring).alias("ring"), F.lit(BOUNDARY_OFFSET).alias("d")), wide, names, measured, res, reach=reach_of(PREFERRED_SHRINK, res))
    out = plots.select("plot_id").join(told.hint("merge"), "plot_id", "left").select("plot_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    envelope = F.when(F.col("buildable_area") > 0, F.col("buildable_area")).otherwise(F.col("plot_area"))
    return out.select("plot_id", "plot_area", "buildable_area", envelope.alias("envelope_area"), F.when(F.col("inner_area") > 0, F.col("inner_area")).otherwise(envelope).alias("preferred_area"))


def reach_of(distance: float, res: float) -> int:
    return int(distance / res + EPS)


class Pieces:
    """Bands of plots with what lies on them, as arrays: rows of cells are numbered through, runs are arrays row, a and b, as in the DataFrames above.

    low, high: each piece's rows, with reach more on both sides for what is eroded. Edges and boxes belong to pieces.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, edges: dict[str, np.ndarray], boxes: np.ndarray, res: float, reach: int):
        self.low, self.high, self.edges, self.boxes, self.res, self.reach = low - reach, high + reach, edges, boxes, res, reach
        self.inner = (low, high)
        self.first = np.concatenate([[0], np.cumsum(self.high - self.low + 1)])

    def rows(self, piece: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each item the rows of its piece whose centres lie from y0 to y1: the item's and the row's numbers, and the row's middle."""
        low = np.maximum(np.ceil((y0 - EPS) / self.res - 0.5), self.low[piece])
        high = np.minimum(np.floor((y1 + EPS) / self.res - 0.5), self.high[piece])
        n = np.nan_to_num(np.maximum(high - low + 1, 0)).astype(np.int64)
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + np.nan_to_num(low).astype(np.int64)[item]
        return item, self.first[piece[item]] + at - self.low[piece[item]], (at + 0.5) * self.res

    def cells(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = np.ceil((low - EPS) / self.res - 0.5), np.floor((high + EPS) / self.res - 0.5)
        kept = a <= b
        return row[kept], a[kept].astype(np.int64), b[kept].astype(np.int64)

    def filled(self, ring: str) -> tuple[np.ndarray, ...]:
        """As filled: crossings of a ring's edges, sorted, two by two."""
        piece, shape, _, px, py, qx, qy = self.edges[ring]
        item, row, y = self.rows(piece, np.minimum(py, qy), np.maximum(py, qy))
        crossing = (py[item] > y) != (qy[item] > y)
        item, row, y = item[crossing], row[crossing], y[crossing]
        x = px[item] + (y - py[item]) * (qx[item] - px[item]) / (qy[item] - py[item])
        order = np.lexsort((x, shape[item], row))
        row, x = row[order], x[order]
        return self.cells(row[::2], x[::2], x[1::2])

    def near(self, ring: str, strict: bool = False) -> tuple[np.ndarray, ...]:
        """Runs, some of them overlapping, of the cells within d of a ring's edges (strict: nearer than it).

        What lies around an edge is convex, so a row's section of it is one interval: the hull of its sections of the discs around both ends and
        of the rectangle between them.
        """
        piece, _, d, px, py, qx, qy = self.edges[ring]
        d = d - (100 * EPS if strict else 0.0)
        item, row, y = self.rows(piece, np.minimum(py, qy) - d, np.maximum(py, qy) + d)
        length = np.hypot(qx - px, qy - py)
        safe = np.where(length > 0, length, 1.0)
        nx, ny = np.where(length > 0, -(qy - py) / safe * d, 0.0), np.where(length > 0, (qx - px) / safe * d, 0.0)
        low, high = np.full(len(item), np.inf), np.full(len(item), -np.inf)
        for x, h in ((px, y - py[item]), (qx, y - qy[item])):
            half = np.sqrt(np.maximum(0.0, d[item] * d[item] - h * h))
            there = np.abs(h) <= d[item] + EPS
            low, high = np.where(there, np.minimum(low, x[item] - half), low), np.where(there, np.maximum(high, x[item] + half), high)
        corners = [(px + nx, py + ny), (qx + nx, qy + ny), (qx - nx, qy - ny), (px - nx, py - ny)]
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            ax, ay, bx, by = ax[item], ay[item], bx[item], by[item]
            there = (ay <= y) != (by <= y)
            x = ax + (y - ay) * (bx - ax) / np.where(there, by - ay, 1.0)
            low, high = np.where(there, np.minimum(low, x), low), np.where(there, np.maximum(high, x), high)
        return self.cells(row, low, high)

    def zones(self) -> tuple[np.ndarray, ...]:
        """As zone_sections, of the boxes."""
        piece, d, x0, y0, x1, y1 = self.boxes
        piece = piece.astype(np.int64)
        item, row, y = self.rows(piece, y0 - d, y1 + d)
        off = np.maximum(np.maximum(y0[item] - y, 0.0), y - y1[item])
        side = np.sqrt(np.maximum(0.0, d[item] * d[item] - off * off))
        return self.cells(row, x0[item] - side, x1[item] + side)

    @staticmethod
    def both(*sides: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*sides))

    def united(self, *sides: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return self.swept([self.both(*sides)], lambda n: n > 0)

    def swept(self, sides: list[tuple[np.ndarray, ...]], keep: Callable[..., np.ndarray]) -> tuple[np.ndarray, ...]:
        """As swept: the runs' ends in order, each side's number of runs that lie there, and the runs where keep holds."""
        row = np.concatenate([np.tile(s[0], 2) for s in sides])
        x = np.concatenate([part for s in sides for part in (s[1], s[2] + 1)])
        step = np.concatenate([np.repeat([1, -1], len(s[0])) for s in sides])
        side = np.repeat(np.arange(len(sides)), [2 * len(s[0]) for s in sides])
        order = np.lexsort((x, row))
        row, x, step, side = row[order], x[order], step[order], side[order]
        last = np.append((row[1:] != row[:-1]) | (x[1:] != x[:-1]), True)[: len(row)]
        # All runs of a row end in it, so the sums need no new begin.
        inside = keep(*(np.cumsum(np.where(side == k, step, 0))[last] for k in range(len(sides))))
        row, x = row[last], x[last]
        turn = inside != np.append([False], inside[:-1])[: len(inside)]
        row, x, inside = row[turn], x[turn], inside[turn]
        return row[inside], x[inside], x[~inside] - 1

    def eroded(self, runs: tuple[np.ndarray, ...], distance: float) -> tuple[np.ndarray, ...]:
        """The cells from which no cell outside is as near as the distance; runs: as long as can be."""
        row, a, b = runs
        piece = np.searchsorted(self.first, row, "right") - 1
        moved, rows = [], range(-reach_of(distance, self.res), reach_of(distance, self.res) + 1)
        for dy in rows:
            # A cell stays if in every row that the distance reaches the cells beside it, as far as it reaches there, belong too.
            w = int((max(0.0, distance**2 - (dy * self.res) ** 2) ** 0.5) / self.res + EPS)
            to = row + dy
            kept = (to >= self.first[piece]) & (to < self.first[piece + 1]) & (a + w <= b - w)
            moved.append((to[kept], a[kept] + w, b[kept] - w))
        return self.swept([self.both(*moved)], lambda n: n == len(rows))

    def areas(self, runs: tuple[np.ndarray, ...]) -> np.ndarray:
        """The runs' cells in each piece's own rows, as an area."""
        row, a, b = runs
        piece = np.searchsorted(self.first, row, "right") - 1
        y = row - self.first[piece] + self.low[piece]
        own = (y >= self.inner[0][piece]) & (y <= self.inner[1][piece])
        return np.bincount(piece[own], weights=(b - a + 1)[own], minlength=len(self.low)) * self.res * self.res


def banded(plots: DataFrame, boxes: DataFrame | None, names: list[str], measured: Callable[[Pieces], list], res: float, reach: int = 0) -> DataFrame:
    """plot_id and the area of each set of runs that measured gives, summed over a plot's bands.

    plots: plot_id, rings, and d, the distance from the ring that counts; boxes: plot_id, d, fx0, fy0, fx1, fy1. Plots and boxes are cut into
    bands of BAND rows of cells, which meet by plot and band; a task reads its bands in order, many at a time, so that a large plot is
    many pieces and a small one is no shuffle of rows.
    """
    rings = [c for c in ("ring", "other") if c in plots.columns]
    more = F.col("d") if "d" in plots.columns and boxes is None else F.lit(0.0)
    span = [G.bounds(F.col(r)) for r in rings]
    rows_of = lambda low, high: ((F.ceil((low - EPS) / res - 0.5)).cast("long"), (F.floor((high + EPS) / res - 0.5)).cast("long"))
    y0, y1 = (F.least(*(x["y0"] for x in span)) if len(span) > 1 else span[0]["y0"]) - more, (F.greatest(*(x["y1"] for x in span)) if len(span) > 1 else span[0]["y1"]) + more
    low, high = rows_of(y0, y1)
    bands = lambda a, b: F.explode(F.when(a <= b, F.sequence(F.floor(a / BAND), F.floor(b / BAND))))
    kind = "array<struct<x: double, y: double>>"
    flat = lambda r: F.flatten(F.transform(F.col(r).cast(kind), lambda p: F.array(p["x"], p["y"])))
    nothing = F.lit(None).cast("array<double>")
    every = plots.select("plot_id", bands(low, high).alias("band"), low.alias("low"), high.alias("high"), *(flat(r).alias(r) for r in rings), (F.col("d") if "d" in plots.columns else F.lit(0.0)).cast("double").alias("d"), nothing.alias("box"))
    if boxes is not None:
        f0, f1 = rows_of(F.col("fy0") - F.col("d"), F.col("fy1") + F.col("d"))
        box = F.array(*(F.col(c).cast("double") for c in ("d", "fx0", "fy0", "fx1", "fy1")))
        cut = boxes.select("plot_id", bands(f0 - reach, f1 + reach).alias("band"), box.alias("box"))
        every = every.unionByName(cut, allowMissingColumns=True)
    every = every.repartition("plot_id", "band").sortWithinPartitions("plot_id", "band")
    schema = ", ".join(f"{c} double" for c in names)

    def begins(table: pa.Table) -> np.ndarray:
        """Where each plot's bands begin."""
        ids, band = table["plot_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), table["band"].to_numpy()
        return np.flatnonzero(np.append([True], (ids[1:] != ids[:-1]) | (band[1:] != band[:-1])))

    def pieces(table: pa.Table) -> pa.RecordBatch:
        band, begin = table["band"].to_numpy(), begins(table)
        piece = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, table.num_rows)))
        is_ring = table["box"].is_null().to_numpy()
        low, high = np.full(len(begin), 0), np.full(len(begin), -1)
        at = np.flatnonzero(is_ring)
        if len(at):
            own, starts = np.unique(piece[at], return_index=True)
            low[own] = np.maximum(np.minimum.reduceat(table["low"].take(at).to_numpy(), starts), band[at][starts] * BAND)
            high[own] = np.minimum(np.maximum.reduceat(table["high"].take(at).to_numpy(), starts), band[at][starts] * BAND + BAND - 1)
        d = np.nan_to_num(table["d"].take(at).to_numpy())
        edges = {}
        for r in rings:
            points = table[r].take(at).combine_chunks()
            size = points.value_lengths().fill_null(0).to_numpy().astype(np.int64) // 2
            xy = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            shape = np.repeat(np.arange(len(size)), size)
            to = np.arange(len(xy)) + 1
            ends = np.cumsum(size)[size > 0]
            to[ends - 1] = ends - size[size > 0]
            # A ring with a point that has no place has no cells.
            placed = np.bincount(shape[~np.isfinite(xy).all(axis=1)], minlength=len(size))[shape] == 0
            edges[r] = tuple(x[placed] for x in (piece[at][shape], shape, d[shape], xy[:, 0], xy[:, 1], xy[to, 0], xy[to, 1]))
        some = np.flatnonzero(~is_ring & (high >= low)[piece])
        box = table["box"].take(some).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 5)
        t = Pieces(low, high, edges, np.vstack([piece[some], box.T]), res, reach)
        got = [t.areas(runs) for runs in measured(t)]
        return pa.RecordBatch.from_arrays([table["plot_id"].take(begin).combine_chunks(), *map(pa.array, got)], ["plot_id", *names])

    def ends(table: pa.Table) -> np.ndarray:
        """About how many runs' ends each row of the table makes."""
        size = sum(table[r].combine_chunks().value_lengths().fill_null(0).to_numpy() for r in rings) // 2
        height = np.minimum(table["high"].fill_null(0).to_numpy() - table["low"].fill_null(0).to_numpy() + 1, BAND)
        return np.where(table["box"].is_null().to_numpy(), 8 * height + 40 * size, 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            total = np.cumsum(ends(held))
            if total[-1] < AT_ONCE:
                continue
            # The last band may go on in the next batch.
            begin, cuts = begins(held), [0]
            for at in begin[1:]:
                if total[at - 1] - (total[cuts[-1] - 1] if cuts[-1] else 0) >= AT_ONCE:
                    cuts.append(at)
            cuts.append(begin[-1]) if begin[-1] > cuts[-1] else None
            for i, j in zip(cuts, cuts[1:]):
                yield pieces(held.slice(i, j - i))
            held = held.slice(cuts[-1])
        if held is not None:
            yield pieces(held.combine_chunks())

    kind_of_id = plots.schema["plot_id"].dataType.simpleString()
    told = every.mapInArrow(run, f"plot_id {kind_of_id}, {schema}")
    return told.groupBy("plot_id").agg(*(F.sum(c).alias(c) for c in names))
