"""Hausdorff distances between groups of points, by cells: bounds of boxes first, points only where the maximum can be."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .distance import TILE, Block, grid, nearest, packed, unpacked

#: Cells along each of the first two axes: at most CELLS^2 occupied cells a group. Points of a block at most, about.
CELLS, POINTS = 32, 4096


def in_cells(rows: DataFrame, key: str, group: str, vector: str, cells: int = CELLS) -> DataFrame:
    """key, group, vec, cell, stored: the square of the first two components, the longer side of all points being `cells` squares.

    Rows whose group or vector is null, empty, or holds null or non-finite components are left out.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(group).cast("long").alias("group"), F.col(vector).cast("array<double>").alias("vec"))
    own = stored(own.where(F.col("group").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite)), "finite")  # read twice
    x, y = F.col("vec")[0], F.coalesce(F.get("vec", F.lit(1)), F.lit(0.0))
    lo_x, hi_x, lo_y, hi_y = own.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    width = max((hi_x or 0) - (lo_x or 0), (hi_y or 0) - (lo_y or 0)) / cells or 1.0
    place = lambda v, lo: F.least(F.floor((v - F.lit(lo or 0.0)) / F.lit(width)), F.lit(cells - 1).cast("long"))
    return stored(own.withColumn("cell", place(x, lo_x) * cells + place(y, lo_y)), "points")


def boxes(points: DataFrame) -> DataFrame:
    """group, cell, lo, hi, count, same: the least box around the points of each cell, from partial minima and maxima.

    same: a hash of the cell and its points, made of their number and two exact sums of hashes; cells that agree in it hold equal points.
    """
    sides = points.select("group", "cell", F.posexplode("vec").alias("pos", "x")).groupBy("group", "cell", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    packed_up = sides.groupBy("group", "cell").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("s"), F.max("n").alias("count"))  # as many as components
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)"))
    marks = points.groupBy("group", "cell").agg(F.count("*").alias("n"), total("vec").alias("one"), total(F.lit(1), "vec").alias("two"))
    marks = marks.select("group", "cell", F.xxhash64("cell", "n", "one", "two").alias("same"))
    return packed_up.join(marks, ["group", "cell"]).select("group", "cell", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "count", "same")


def _bounds(a: Block, b: Block) -> pd.DataFrame:
    """For each cell of a and each other group of b: the least and largest that a point's nearest distance can be, and the cells that can hold it.

    A cell with the same points in the other group has nearest distances of 0 and is left out, as no distance is less.
    """
    least, most = np.zeros((len(a["cell"]), len(b["cell"]))), np.zeros((len(a["cell"]), len(b["cell"])))
    for al, ah, bl, bh in zip(a["lo"].T, a["hi"].T, b["lo"].T, b["hi"].T, strict=True):
        gap = np.maximum(np.maximum(bl[None] - ah[:, None], al[:, None] - bh[None]), 0)
        least += gap * gap
        span = np.maximum(bh[None] - al[:, None], ah[:, None] - bl[None])
        most += span * span
    most[a["same"][:, None] == b["same"][None]] = 0
    order = np.argsort(b["group"], kind="stable")
    names, first = np.unique(b["group"][order], return_index=True)
    least, most, cells = np.sqrt(least[:, order]), np.sqrt(most[:, order]), b["cell"][order]
    low, high = np.minimum.reduceat(least, first, axis=1), np.minimum.reduceat(most, first, axis=1)
    own, at = np.unique(a["group"], return_inverse=True)
    floor = np.full((len(own), len(names)), -np.inf)
    np.maximum.at(floor, at, low)
    keep = (names[None] != a["group"][:, None]) & (high > 0) & (high * (1 + 1e-9) >= floor[at])
    ends, out = [*first[1:], len(order)], []
    for i, k in zip(*np.nonzero(keep), strict=True):
        s = slice(first[k], ends[k])
        out.append((a["group"][i], a["cell"][i], names[k], low[i, k], high[i, k], cells[s][least[i, s] <= high[i, k] * (1 + 1e-9)]))
    return pd.DataFrame(out, columns=["group", "cell", "other", "low", "high", "cells"])


def _by_group(b: Block) -> Block:
    """A block with a group's cells one after another, so that a stretch holds most of them and its floor is high."""
    order = np.argsort(b["group"], kind="stable")
    return {k: v[order] for k, v in b.items()}


def visits(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """group, cell, other, cells, stored: the cells of a group that may hold its farthest point from another group, with those of the other that may hold the nearest ones.

    A cell's points are nearer than `high` and farther than `low`; a cell whose `high` is below another's `low`, or whose
    points the other group has too, isn't visited. Groups that leave no cell to visit in either direction are 0 apart.
    A group's cells are one tile at most, so bounds are whole; those of stretches are joined by their maximum here.
    """
    kinds = "group long, cell long, other long, low double, high double, cells array<long>"
    found = stored(grid(cells, "cell", _bounds, kinds, directed=True, group="group", ready=_by_group, tile=tile), "bounds")
    floor = found.groupBy("group", "other").agg(F.max("low").alias("floor"))
    return stored(found.join(floor, ["group", "other"]).where(F.col("high") * (1 + 1e-9) >= F.col("floor")).select("group", "cell", "other", "cells"), "visits")


def hausdorff(rows: DataFrame, key: str, group: str, vector: str, cells: int = CELLS) -> DataFrame:
    """i, j, distance of each pair of groups: the larger of the two directed largest nearest Euclidean distances.

    Points are compared only where boxes of cells leave it open which is the farthest, and only with the cells that can
    hold its nearest point, and no others are packed or sent; so work follows the cells at the edge of a group, not pairs of points. A full cell is several
    blocks. Rows that in_cells() leaves out count as absent; a group without points is in no pair. Vectors of a table
    have one length.
    """
    points = in_cells(rows, key, group, vector, cells)
    own = stored(boxes(points), "boxes")
    seen = visits(own, max(TILE, 2 * cells * cells))
    needed = seen.select("group", "cell").union(seen.select("other", F.explode("cells"))).distinct()
    parts = points.join(stored(needed, "needed"), ["group", "cell"], "left_semi").join(own.select("group", "cell", F.ceil(F.col("count") / POINTS).alias("parts")), ["group", "cell"])
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).select("group", "cell", "part", "key", "vec")

    def block(at: tuple, table: pa.Table) -> pa.Table:
        g, c, p = (x.as_py() for x in at)
        return pa.table({"group": pa.array([g], pa.int64()), "cell": pa.array([c], pa.int64()), "part": pa.array([p], pa.int64()), "block": pa.array([packed(table.select(["key", "vec"]))], pa.binary())})

    blocks = stored(dealt.groupBy("group", "cell", "part").applyInArrow(block, "group long, cell long, part long, block binary"), "blocks")
    left = blocks.select("group", "cell", F.col("block").alias("a"))
    right = blocks.select(F.col("group").alias("other"), F.col("cell").alias("at"), F.col("block").alias("b"))
    pairs = seen.withColumn("at", F.explode("cells")).drop("cells").join(left, ["group", "cell"]).join(right, ["other", "at"]).select("group", "other", "a", "b")

    def compare(batches):
        for batch in batches:
            for g, o, a, b in zip(batch["group"], batch["other"], batch["a"], batch["b"], strict=True):
                mine, theirs = unpacked(a.as_buffer()), unpacked(b.as_buffer())["vec"]
                near = nearest(mine["vec"], theirs[np.argsort(theirs[:, 0], kind="stable")])
                n = len(near)
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * n, pa.int64()), pa.array([o.as_py()] * n, pa.int64()), pa.array(mine["key"]), pa.array(near)], names=["group", "other", "key", "nearest"])

    each = pairs.mapInArrow(compare, "group long, other long, key long, nearest double").groupBy("group", "other", "key").agg(F.min("nearest").alias("nearest"))
    directed = each.groupBy("group", "other").agg(F.max("nearest").alias("d"))
    names = stored(own.select("group").distinct(), "groups")
    none = names.select(F.col("group").alias("i")).join(names.select(F.col("group").alias("j")), F.col("i") < F.col("j"))  # a row of the result each
    directed = directed.unionByName(none.select(F.col("i").alias("group"), F.col("j").alias("other"), F.lit(0.0).alias("d")))
    return directed.groupBy(F.least("group", "other").alias("i"), F.greatest("group", "other").alias("j")).agg(F.max("d").alias("distance"))
