"""Flow over a grid of elevations (r, c, z)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.operators.graph import connected
from tarnwatch.operators.grid import EIGHT, with_neighbours
from tarnwatch.scratch import Scratch


def d8_direction(cells: DataFrame) -> DataFrame:
    """HY-01: the cell that each cell drains to, by the steepest drop; ties in the order N, NE, E, SE, S, SW, W, NW.

    Returns r, c, z, code (1 to 8, 0 for a pit), to_r, to_c (null for a pit).
    """
    n = with_neighbours(cells.select("r", "c", "z"))
    drops = [F.struct(((F.col("z") - F.col(name)) / (2**0.5 if dr and dc else 1.0)).alias("drop"), F.lit(-k).alias("order"), F.lit(k + 1).alias("code"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (name, dr, dc) in enumerate(EIGHT)]
    best = F.array_max(F.filter(F.array(*drops), lambda d: d["drop"] > 0))
    out = n.withColumn("_b", best)
    return out.select("r", "c", "z", F.coalesce("_b.code", F.lit(0)).alias("code"), (F.col("r") + F.col("_b.dr")).alias("to_r"), (F.col("c") + F.col("_b.dc")).alias("to_c"))


def _numbered(flow: DataFrame, width: int) -> DataFrame:
    return flow.select((F.col("r") * width + F.col("c")).alias("id"), (F.col("to_r") * width + F.col("to_c")).alias("to"), "z")


#: Cells on a side of the tiles in which depressions are filled; one task holds one tile.
TILE = 256
#: Stands for all that lies beyond the grid. Cell numbers are rows times 2^31 plus columns.
_BEYOND = -1
_ROUND = tuple((dr, dc) for _, dr, dc in EIGHT)


def _tiled(cells: DataFrame, tile: int) -> DataFrame:
    """Each cell in its own tile and in those it touches: adds _tr, _tc."""
    at = lambda v, k=0: F.floor((F.col(v) + k) / tile)
    near = lambda v: F.explode(F.when(F.pmod(F.col(v), F.lit(tile)).isin(0, tile - 1), F.array_distinct(F.array(at(v, -1), at(v), at(v, 1)))).otherwise(F.array(at(v))))
    return cells.withColumn("_tr", near("r")).withColumn("_tc", near("c"))


def _block(rows: pd.DataFrame, value: str, at: tuple[int, int], tile: int) -> np.ndarray:
    """Values of a tile and of the cells around it; NaN where there is none."""
    block = np.full((tile + 2, tile + 2), np.nan)
    block[rows["r"].to_numpy() - at[0] * tile + 1, rows["c"].to_numpy() - at[1] * tile + 1] = rows[value].to_numpy(dtype=float)
    return block


def _drains(block: np.ndarray) -> np.ndarray:
    """Cells beside which one of the eight neighbours is missing."""
    wide = np.pad(np.isnan(block), 1, constant_values=True)
    open_ = np.zeros(block.shape, dtype=bool)
    for dr, dc in _ROUND:
        open_ |= wide[1 + dr : 1 + dr + block.shape[0], 1 + dc : 1 + dc + block.shape[1]]
    return open_ & ~np.isnan(block)


def _spills(tile: int, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One tile flooded from its rim and its drains: (kind 0, cell, label, level), and spill heights as (kind 1, label, label, height).

    Every cell of the rim is a label of its own; a cell belongs to the label
    whose water reaches it first. Of the heights between labels a spanning
    forest is kept, as no way around uses another one.
    """
    z = _block(rows, "z", key, tile)
    side, top, left = tile + 2, key[0] * tile - 1, key[1] * tile - 1
    number = lambda i, j: ((i + top) << 31) + j + left
    drains, inner, rim = _drains(z), np.zeros(z.shape, dtype=bool), np.ones(z.shape, dtype=bool)
    inner[1:-1, 1:-1], rim[2:-2, 2:-2] = True, False
    cell = inner & ~np.isnan(z)
    rim &= cell
    i, j = np.indices(z.shape)
    label = np.where(rim, number(i, j), np.where(cell & drains, _BEYOND, _BEYOND - 1)).ravel().tolist()
    started, drains = cell & (rim | drains), drains.ravel().tolist()
    # places past the end are never within; a dry cell has no label yet
    within, dry = (bytearray(x.tobytes()) + bytes(side + 2) for x in (cell, cell & ~started))
    level, z = np.where(started, z, np.inf).ravel().tolist(), z.ravel().tolist()
    steps = [dr * side + dc for dr, dc in _ROUND]
    kept: list[tuple[float, int, int]] = []
    for k in np.flatnonzero(rim).tolist():
        if drains[k]:
            kept.append((z[k], _BEYOND, label[k]))
        for step in steps:  # ways into the next tile, given by one of both
            n = k + step
            other = number(*divmod(n, side))
            if not within[n] and z[n] == z[n] and label[k] < other:
                kept.append((max(z[k], z[n]), label[k], other))
    heap = [(level[k], k) for k in np.flatnonzero(started).tolist()]
    heapq.heapify(heap)
    between: dict[tuple[int, int], float] = {}
    while heap:
        w, k = heapq.heappop(heap)
        own = label[k]
        for step in steps:
            n = k + step
            if dry[n]:
                dry[n] = 0
                level[n] = h = z[n] if z[n] > w else w
                label[n] = own
                heapq.heappush(heap, (h, n))
            elif within[n] and label[n] != own:
                pair = (own, label[n]) if own < label[n] else (label[n], own)
                h = level[n] if level[n] > w else w
                if pair not in between or h < between[pair]:
                    between[pair] = h
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for height, x, y in sorted((h, *pair) for pair, h in between.items()):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append((height, x, y))
    at = np.flatnonzero(cell)
    cells = pd.DataFrame({"kind": 0, "a": number(*np.divmod(at, side)), "b": np.array(label)[at], "w": np.array(level)[at]})
    return pd.concat([cells, pd.DataFrame({"kind": 1, "a": [k[1] for k in kept], "b": [k[2] for k in kept], "w": [float(k[0]) for k in kept]})]).astype({"kind": "int32", "a": "int64", "b": "int64", "w": "float64"})


def _spill_levels(heights: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, level): the lowest height over which each label's water leaves the grid, by Boruvka's rounds.

    Each group without the way out takes its lowest height to another one, and
    its labels rise to it. What a label has risen to when its group meets the
    way out is the largest height on its way along the minimum spanning tree.
    Groups at least halve in a round.
    """
    edges = scratch.cut(heights, "heights")
    state = edges.select(F.explode(F.array("a", "b")).alias("label")).where(F.col("label") != _BEYOND).distinct()
    state = scratch.cut(state.select("label", F.col("label").alias("group"), F.lit(float("-inf")).alias("level")), "state")
    while not edges.isEmpty():
        both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != _BEYOND)
        # one order of all edges, so that lowest ones never close a ring
        lowest = both.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "b")).alias("e"))
        lowest = scratch.cut(lowest.select("a", "e.b", "e.w"), "lowest")
        met = scratch.cut(connected(lowest.select("a", "b"), scratch).select(F.col("node").alias("group"), F.col("root")), "met")
        risen = state.join(lowest.select(F.col("a").alias("group"), "w"), "group", "left").join(met, "group", "left")
        state, _ = scratch.replace(risen.select("label", F.coalesce("root", "group").alias("group"), F.greatest("level", F.coalesce("w", "level")).alias("level")), "state")
        for side in ("a", "b"):
            edges = edges.join(met.withColumnRenamed("group", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        edges = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
        edges, _ = scratch.replace(edges, "heights")
    return state.select("label", "level")


def _packed(tile: int, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One tile as one row: places and heights of its cells (NaN for a null), and places of the cells around it."""
    at, z = rows["at"].to_numpy(), rows["z"].to_numpy(dtype=float)
    i, j = np.divmod(at, tile + 2)
    own = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
    return pd.DataFrame({"_tr": key[0], "_tc": key[1], "at": [at[own]], "z": [z[own]], "around": [at[~own & ~np.isnan(z)]]}).head(int(own.any()))


def _flooded(tile: int, gradient: float, cells: pd.DataFrame, around: pd.DataFrame) -> np.ndarray:
    """Levels of one packed tile, given the present levels around it; water rises by the gradient with each step inward. NaN where there is no cell, infinite where no water has come yet.

    All cells take the lowest way over a neighbour at once, as long as many
    sink by that; what still sinks then (along few, long ways) goes through a heap.
    """
    side = tile + 2
    z, there, level = np.full((side, side), np.nan), np.full((side, side), np.nan), np.full((side, side), np.inf)
    z.ravel()[cells["at"].iloc[0]] = cells["z"].iloc[0]
    there.ravel()[cells["around"].iloc[0]] = 0.0
    level.ravel()[around["at"].to_numpy()] = around["level"].to_numpy()
    cell = ~np.isnan(z)
    level = np.where(_drains(np.where(cell, z, there)) & cell, z, level)
    rows, cols = cell.any(axis=1).nonzero()[0], cell.any(axis=0).nonzero()[0]
    if not len(rows):
        return z
    box = np.s_[rows[0] - 1 : rows[-1] + 2, cols[0] - 1 : cols[-1] + 2]
    now, floor = level[box], np.where(cell, z, np.inf)[box]  # water stops at infinite floors: where no cell is, and around the tile
    inner, sinks = now[1:-1, 1:-1], np.zeros(now.shape, dtype=bool)
    for _ in range(2 * tile):
        low = np.minimum(np.minimum(now[:-2], now[1:-1]), now[2:])
        low = np.maximum(np.minimum(np.minimum(low[:, :-2], low[:, 1:-1]), low[:, 2:]) + gradient, floor[1:-1, 1:-1])
        np.less(low, inner, out=sinks[1:-1, 1:-1])
        np.minimum(low, inner, out=inner)
        if np.count_nonzero(sinks) * 256 < sinks.size:
            break
    if sinks.any():
        now[...] = _sunk(now, floor, sinks, gradient)
    return np.where(cell, level, np.nan)


def _sunk(level: np.ndarray, floor: np.ndarray, sinks: np.ndarray, gradient: float) -> np.ndarray:
    """Levels after all that follows from the cells that have just sunk."""
    width, at = level.shape[1], np.flatnonzero(sinks)
    steps = [dr * width + dc for dr, dc in _ROUND]
    heap = list(zip(level.ravel()[at].tolist(), at.tolist(), strict=True))
    heapq.heapify(heap)
    levels, floors = level.ravel().tolist(), floor.ravel().tolist()
    while heap:
        w, k = heapq.heappop(heap)
        if w > levels[k]:
            continue
        w += gradient
        for step in steps:
            n = k + step
            h = floors[n]
            if h < w:
                h = w
            if h < levels[n]:
                levels[n] = h
                heapq.heappush(heap, (h, n))
    return np.array(levels).reshape(level.shape)


def _handed_on(tile: int, gradient: float, key: tuple, cells: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    """Levels that a flooded tile shows to the tiles beside it: their keys, places there and levels."""
    parts = [pd.DataFrame({"_tr": [], "_tc": [], "at": [], "level": []})]
    if len(cells):
        level = _flooded(tile, gradient, cells, around)
        i, j = np.nonzero(level < np.inf)
        p, q = np.divmod(cells["around"].iloc[0], tile + 2)
        beside = set(zip(((p > tile) * 1 - (p == 0)).tolist(), ((q > tile) * 1 - (q == 0)).tolist(), strict=True))
        for dr, dc in beside:
            a, b = i - dr * tile, j - dc * tile
            seen = (a >= 0) & (a <= tile + 1) & (b >= 0) & (b <= tile + 1)
            parts.append(pd.DataFrame({"_tr": key[0] + dr, "_tc": key[1] + dc, "at": (a * (tile + 2) + b)[seen], "level": level[i[seen], j[seen]]}))
    return pd.concat(parts).astype({"_tr": "int64", "_tc": "int64", "at": "int32", "level": "float64"})


def _raised(tile: int, gradient: float, key: tuple, cells: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    """All cells of a tile at their last levels."""
    if not len(cells):
        return pd.DataFrame({"r": [], "c": [], "z": []})
    at = cells["at"].iloc[0]
    i, j = np.divmod(at.astype("int64"), tile + 2)
    return pd.DataFrame({"r": key[0] * tile - 1 + i, "c": key[1] * tile - 1 + j, "z": _flooded(tile, gradient, cells, around)[i, j]})


def fill_depressions(cells: DataFrame, mode: str = "fill", gradient: float = 1e-4, tile: int = TILE) -> DataFrame:
    """HY-02: raises pits until every cell drains to the edge; mode ``none`` returns the cells as they are.

    The level of a cell is the least over all ways from the edge of
    max(z, level before + gradient); cells beside a missing one (or beside a
    null) are edges. Tiles are flooded with a heap, each in one task.

    With gradient 0, tiles are flooded once from their rims. Spill heights
    between rim cells make a graph over the whole grid, whose minimum spanning
    tree gives the level of each rim cell; a cell has the larger one of its
    level in the tile and of the rim cell it drains to. Written tables grow
    with the logarithm of the number of tiles, whatever the width of a pit.

    With a gradient, so that filled plains drain, tiles are packed once, one row
    for each. Only levels beside another tile are handed on and written, and
    only tiles beside which a level has sunk are flooded again. A round passes
    one tile, so rounds grow with the width of a pit in tiles.
    """
    if mode == "none":
        return cells
    scratch = Scratch(cells.sparkSession, "fill")
    own = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z"))
    if gradient == 0:
        spills = _tiled(own, tile).groupBy("_tr", "_tc").applyInPandas(lambda key, rows: _spills(tile, key, rows), "kind int, a long, b long, w double")
        spills = scratch.cut(spills, "spills")
        levels = _spill_levels(spills.where("kind = 1").select("a", "b", "w"), scratch).withColumnRenamed("label", "b")
        found = spills.where("kind = 0").join(levels, "b", "left")
        found = found.select(F.shiftright("a", 31).alias("r"), F.col("a").bitwiseAND(F.lit((1 << 31) - 1)).alias("c"), F.greatest("w", F.coalesce("level", "w")).alias("level"))
        return own.join(found, ["r", "c"], "left").select("r", "c", F.col("level").alias("z"))
    side = tile + 2
    place = (F.col("r") - F.col("_tr") * tile + 1) * side + F.col("c") - F.col("_tc") * tile + 1
    tiles = _tiled(own, tile).select("_tr", "_tc", place.cast("int").alias("at"), "z").groupBy("_tr", "_tc")
    tiles = scratch.cut(tiles.applyInPandas(lambda key, rows: _packed(tile, key, rows), "_tr long, _tc long, at array<int>, z array<double>, around array<int>"), "tiles")
    known = cells.sparkSession.createDataFrame([], "_tr long, _tc long, at int, level double, sunk boolean")
    beside, active = lambda df: df.groupBy("_tr", "_tc").cogroup(known.groupBy("_tr", "_tc")), tiles
    while True:
        new = beside(active).applyInPandas(lambda key, rows, around: _handed_on(tile, gradient, key, rows, around), "_tr long, _tc long, at int, level double")
        none = F.lit(None).cast("double")
        both = known.select("_tr", "_tc", "at", F.col("level").alias("old"), none.alias("new")).unionByName(new.select("_tr", "_tc", "at", none.alias("old"), F.col("level").alias("new")))
        both = both.groupBy("_tr", "_tc", "at").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        both = both.select("_tr", "_tc", "at", F.least("old", "new").alias("level"), F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull()).alias("sunk"))
        known, (sunk,) = scratch.replace(both, "known", F.count_if("sunk"))
        if not sunk:
            break
        active = tiles.join(known.where("sunk").select("_tr", "_tc").distinct(), ["_tr", "_tc"], "left_semi")
    return beside(tiles).applyInPandas(lambda key, rows, around: _raised(tile, gradient, key, rows, around), "r long, c long, z double")


def flow_accumulation(flow: DataFrame, width: int) -> DataFrame:
    """HY-03: cells that drain through each cell, itself included, by pointer doubling.

    After k rounds a cell knows the count of what reaches it within 2^k steps
    and the cell 2^k steps below it, so rounds grow with the logarithm of the
    longest path.
    """
    scratch = Scratch(flow.sparkSession, "flow")
    state = scratch.cut(_numbered(flow, width).select("id", "to", F.lit(1).cast("long").alias("acc")), "state")
    while not state.where("to IS NOT NULL").isEmpty():
        gained = state.where("to IS NOT NULL").groupBy("to").agg(F.sum("acc").alias("more")).select(F.col("to").alias("id"), "more")
        jump = state.select(F.col("id").alias("to"), F.col("to").alias("next"))
        state = state.join(gained, "id", "left").join(jump, "to", "left").select("id", F.col("next").alias("to"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"))
        state = scratch.cut(state, "state")
    return state.select((F.col("id") / width).cast("long").alias("r"), (F.col("id") % width).alias("c"), "acc")


def hand(flow: DataFrame, accumulation: DataFrame, width: int, channel: int) -> DataFrame:
    """HY-06: height above the first channel cell downstream, at least 0; 0 where none is reached.

    Pointers double in each round. Only cells that have not met a channel or a
    pit go on, so a main outlet is a join key of the cells beside it alone.
    """
    scratch = Scratch(flow.sparkSession, "hand")
    acc = accumulation.select((F.col("r") * width + F.col("c")).alias("id"), (F.col("acc") >= channel).alias("channel"))
    base = scratch.cut(_numbered(flow, width).join(acc, "id"), "base")
    ends, rest = base.where(F.col("channel") | F.col("to").isNull()), base.where(~F.col("channel") & F.col("to").isNotNull())
    first = rest.select("id", "to").join(ends.select(F.col("id").alias("to"), F.lit(True).alias("met")), "to", "left").select("id", "to", F.coalesce("met", F.lit(False)).alias("met"))
    first = scratch.cut(first, "first")
    finished, going = ends.select("id", F.col("id").alias("to"), F.lit(True).alias("met")).unionByName(first.where("met")), first.where("NOT met")
    while not going.isEmpty():
        ahead = finished.unionByName(going).select(F.col("id").alias("to"), F.col("to").alias("next"), "met")
        moved = scratch.cut(going.drop("met").join(ahead, "to").select("id", F.col("next").alias("to"), "met"), "moved")
        finished, going = finished.unionByName(moved.where("met")), moved.where("NOT met")
    end = ends.select(F.col("id").alias("to"), F.col("z").alias("zc"), F.col("channel").alias("end_channel"))
    out = base.select("id", "z").join(finished.select("id", "to"), "id").join(end, "to")
    height = F.when(F.col("end_channel"), F.greatest(F.lit(0.0), F.col("z") - F.col("zc"))).otherwise(0.0)
    return out.select((F.col("id") / width).cast("long").alias("r"), (F.col("id") % width).alias("c"), height.alias("hand"))


def hand_exposure(points: DataFrame, heights: DataFrame, stage: float) -> DataFrame:
    """HY-07: whether each (id, r, c) lies within the stage; false beyond the grid."""
    return points.join(heights, ["r", "c"], "left").select("id", F.coalesce(F.col("hand") <= stage, F.lit(False)).alias("exposed"))


def hand_filter(probabilities: DataFrame, heights: DataFrame, stage: float = 15.0) -> DataFrame:
    """HY-08"""
    return probabilities.join(heights, ["r", "c"]).withColumn("p", F.when(F.col("hand") > stage, 0.0).otherwise(F.col("p"))).drop("hand")


def trace_downstream(flow: DataFrame, width: int, starts: DataFrame, most_steps: int = 5000) -> DataFrame:
    """HY-04: (start, step, r, c) of the way down from each start (r, c) to a pit or the edge.

    A table of the cells 2^k steps below each cell lets every start take all its
    steps in a logarithmic number of joins.
    """
    scratch = Scratch(flow.sparkSession, "trace")
    jump = scratch.cut(_numbered(flow, width).where("to IS NOT NULL").select("id", "to"), "jump")
    path = starts.select((F.col("r") * width + F.col("c")).alias("start")).select("start", F.lit(0).alias("step"), F.col("start").alias("id"))
    reach = 1
    while reach <= most_steps and not jump.isEmpty():
        more = path.join(jump, "id").select("start", (F.col("step") + reach).alias("step"), F.col("to").alias("id"))
        path = scratch.cut(path.unionByName(more).where(F.col("step") <= most_steps), "path")
        jump = scratch.cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "jump")
        reach *= 2
    return path.select("start", "step", (F.col("id") / width).cast("long").alias("r"), (F.col("id") % width).alias("c"))


def snap_to_channel(accumulation: DataFrame, r: int, c: int, threshold: int, most: int = 100) -> DataFrame:
    """HY-05: the strongest cell of the first square around (r, c) that holds a channel cell; no row if there is none."""
    radius = F.greatest(F.abs(F.col("r") - r), F.abs(F.col("c") - c))
    near = accumulation.withColumn("radius", radius).where((F.col("radius") < most) & (F.col("acc") > threshold))
    return near.orderBy("radius", F.desc("acc"), "r", "c").limit(1).select("r", "c", "acc", "radius")


def snap_polygons(accumulation: DataFrame, vertices: DataFrame, *, x0: float, y0: float, step: float, threshold: int, most: int = 100) -> DataFrame:
    """HY-05: for each polygon (poly and its vertices x, y) the cell at the mean of its vertices, and the strongest cell of the first square around it that holds a channel cell.

    Means beyond the grid have no row; without a channel cell near enough
    to_r, to_c and radius are null. Channel cells meet polygons on squares of
    ``most`` cells.
    """
    mean = vertices.groupBy("poly").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    source = mean.select("poly", F.rint((y0 - F.col("y")) / step).cast("long").alias("r"), F.rint((F.col("x") - x0) / step).cast("long").alias("c"))
    source = source.join(accumulation.select("r", "c", "acc"), ["r", "c"])
    square = lambda v: F.floor(F.col(v) / most)
    around = lambda v: F.explode(F.sequence(square(v) - 1, square(v) + 1))
    near = source.select("poly", "r", "c").withColumn("_sr", around("r")).withColumn("_sc", around("c"))
    channel = accumulation.where(F.col("acc") > threshold).select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("acc").alias("strength"), square("r").alias("_sr"), square("c").alias("_sc"))
    radius = F.greatest(F.abs(F.col("to_r") - F.col("r")), F.abs(F.col("to_c") - F.col("c")))
    met = near.join(channel, ["_sr", "_sc"]).withColumn("radius", radius).where(F.col("radius") < most)
    best = met.groupBy("poly").agg(F.min(F.struct("radius", (-F.col("strength")).alias("weakness"), "to_r", "to_c")).alias("best"))
    return source.join(best, "poly", "left").select("poly", "r", "c", "acc", "best.to_r", "best.to_c", "best.radius")
