"""Maps, masks and neighbourhoods on cell tables (r, c, value...), one row for each cell.

Neighbours come from windows along columns and then along rows: two shuffles,
whatever the number of neighbours, and a group is a stretch of a line of the
grid, however long the line. Grids are full rectangles; ``keys`` (scene, tile)
partition them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.graph import connected
from tarnwatch.operators.quantiles import grouped_quantiles, with_quantiles
from tarnwatch.scratch import Scratch

#: Neighbours in the order in which ties are resolved, as (name, row step, column step).
EIGHT = (("n", -1, 0), ("ne", -1, 1), ("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1))


#: Cells of a line that one group of a window holds.
STRETCH = 4096


def _stretches(cells: DataFrame, axis: str, halo: int) -> tuple[DataFrame, Column]:
    """Cells with the stretch ``_b`` of the line along an axis, copied to the next one within ``halo`` of its ends; and which rows are no copies."""
    own, at = F.floor(F.col(axis) / STRETCH), F.pmod(F.col(axis), F.lit(STRETCH))
    copies = F.array_compact(F.array(own, F.when(at < halo, own - 1), F.when(at >= STRETCH - halo, own + 1)))
    return cells.withColumn("_b", F.explode(copies)), F.col("_b") == own


def with_neighbours(cells: DataFrame, value: str = "z", keys: Sequence[str] = ()) -> DataFrame:
    """Adds the value of the eight neighbours; null beyond the edge."""
    near = lambda f, axis, step, w, v: F.when(f(axis).over(w) == F.col(axis) + step, f(v).over(w))
    out, own = _stretches(cells, "r", 1)
    down = Window.partitionBy(*keys, "c", "_b").orderBy("r")
    out = out.withColumns({"n": near(F.lag, "r", -1, down, value), "s": near(F.lead, "r", 1, down, value)}).where(own).drop("_b")
    out, own = _stretches(out, "c", 1)
    along = Window.partitionBy(*keys, "r", "_b").orderBy("c")
    return out.withColumns(
        {a + x: near(f, "c", step, along, col) for f, step, x in ((F.lag, -1, "w"), (F.lead, 1, "e")) for a, col in (("n", "n"), ("", value), ("s", "s"))}
    ).where(own).drop("_b")


def ndwi(green: Column, nir: Column, zero_safe: bool = False) -> Column:
    """GR-01: normalised difference; the safe variant is 0 where the sum is."""
    return F.when(green + nir == 0, 0.0).otherwise((green - nir) / (green + nir)) if zero_safe else (green - nir) / (green + nir + 1e-10)


def cloud_fraction(bands: Sequence[Column], threshold: float, nodata: float) -> Column:
    """GR-03: share of valid cells that are bright in every band, 0 without valid cells."""
    valid, bright = F.lit(True), F.lit(True)
    for b in bands:
        valid, bright = valid & (b != nodata), bright & (b > threshold)
    return F.coalesce(F.count_if(valid & bright) / F.nullif(F.count_if(valid), F.lit(0)), F.lit(0.0))


def class_histogram(cells: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """GR-04: cells and share of each class."""
    by = cells.groupBy(*keys, kind).agg(F.count("*").alias("cells"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return by.withColumn("share", F.col("cells") / F.sum("cells").over(whole))


def multilook(cells: DataFrame, *values: str, size: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """GR-05: mean of size x size cells of each value with reflected edges, in two separable passes.

    Cells near an edge are copied once beyond it, so both passes are plain
    windows of a line.
    """
    h = size // 2
    out = cells.select(*keys, "r", "c", *values)
    for axis, other in (("c", "r"), ("r", "c")):
        last = out.groupBy(*keys).agg(F.max(axis).alias("_last"))
        wide = out.join(last, list(keys)) if keys else out.join(F.broadcast(last), F.lit(True))
        x = F.col(axis)
        copies = F.array_compact(F.array(F.struct(x.alias("at"), F.lit(True).alias("own")), F.when(x < h, F.struct((-1 - x).alias("at"), F.lit(False).alias("own"))), F.when(x > F.col("_last") - h, F.struct((2 * F.col("_last") + 1 - x).alias("at"), F.lit(False).alias("own")))))
        wide = wide.select(*keys, other, F.inline(copies), *values)
        line = Window.partitionBy(*keys, other).orderBy("at").rangeBetween(-h, h)
        out = wide.withColumns({v: F.sum(v).over(line) / size for v in values}).where("own").select(*keys, F.col("at").alias(axis), other, *values)
    return out.select(*keys, "r", "c", *values)


def log_ratio(before: Column, after: Column, eps: float = 1e-6) -> Column:
    """GR-06"""
    return F.log10((after * after + eps) / (before * before + eps))


def detect_expansion(cells: DataFrame, before: str, after: str, threshold: float = -0.8) -> DataFrame:
    """GR-07: cells whose smoothed ratio between the dates falls below the threshold."""
    ratio = log_ratio(F.col(before), F.col(after))
    return multilook(cells, before, after).select("r", "c", ratio.alias("ratio"), (ratio < threshold).alias("expanded"))


def sigma0_db(dn: Column, lut: Column) -> Column:
    """GR-08: a lookup value of 0 or less counts as 1."""
    k = F.when(lut > 0, lut).otherwise(1.0)
    return 10 * F.log10(F.greatest(dn * dn / (k * k), F.lit(1e-10)))


def _gradient(low: str, high: str, cell: Column) -> Column:
    """Central difference, one-sided at the edges."""
    lo, hi, z = F.col(low), F.col(high), F.col("z")
    return F.when(lo.isNotNull() & hi.isNotNull(), (hi - lo) / (2 * cell)).when(hi.isNotNull(), (hi - z) / cell).when(lo.isNotNull(), (z - lo) / cell).otherwise(0.0)


def slope_degrees(cells: DataFrame, cell_m: float | tuple[Column, Column], keys: Sequence[str] = (), nodata: float | None = None) -> DataFrame:
    """GR-10, GR-12: slope of (r, c, z), and the unit normal of the surface (east, north, up).

    Rows go south, so a surface that rises with the rows leans to the north.

    ``cell_m`` is the width of a cell, or its width and height as columns of r
    and c. Where ``nodata`` is given, cells whose gradient needs such a value,
    or a null, have null results.
    """
    across, along = (F.lit(float(cell_m)),) * 2 if isinstance(cell_m, (int, float)) else cell_m
    rows = cells.select(*keys, "r", "c", "z")
    if nodata is not None:  # NaN goes through the differences, while null means beyond the edge
        rows = rows.withColumn("z", F.when(F.col("z").isNull() | (F.col("z") == nodata), F.lit(float("nan"))).otherwise(F.col("z")))
    n = with_neighbours(rows, "z", keys)
    dx, dy = _gradient("w", "e", across), _gradient("n", "s", along)
    out = n.select(*keys, "r", "c", F.nanvl("z", F.lit(None).cast("double")).alias("z"), F.nanvl(dx, F.lit(None).cast("double")).alias("dx"), F.nanvl(dy, F.lit(None).cast("double")).alias("dy"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    return out.withColumns(
        {"slope": F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))), "nx": -F.col("dx") / length, "ny": F.col("dy") / length, "nz": 1 / length}
    )


#: Metres of a degree of longitude at the equator, and of latitude.
DEGREE_M = (111320.0, 110540.0)


def geographic_slope(cells: DataFrame, *, top: float, step: float, keys: Sequence[str] = (), nodata: float = -32768.0) -> DataFrame:
    """GR-10: slope on a grid of degrees whose first row ends at latitude ``top``; cells grow narrower toward the poles."""
    lat = top - (F.col("r") + 0.5) * step
    return slope_degrees(cells, (DEGREE_M[0] * F.cos(F.radians(lat)) * step, F.lit(DEGREE_M[1] * step)), keys, nodata)


def sobel_slope(cells: DataFrame, cell_m: float, keys: Sequence[str] = ()) -> DataFrame:
    """GR-11: slope from Sobel gradients; beyond the edge the nearest cell counts.

    Missing elevations take the median of their key's first and have no slope
    themselves.
    """
    rows = cells.select(*keys, "r", "c", F.nanvl(F.col("z").cast("double"), F.lit(None).cast("double")).alias("z"))
    middle = grouped_quantiles(rows, keys, {"_m": "z"}, [0.5]).withColumn("_m", F.col("_m")[0])
    rows = (rows.join(middle, list(keys)) if keys else rows.join(F.broadcast(middle), F.lit(True))).select(*keys, "r", "c", F.coalesce("z", "_m").alias("z"), F.col("z").isNull().alias("_gap"))
    n = with_neighbours(rows, "z", keys)
    v = lambda *x: F.coalesce(*x, "z")
    nw, ne, sw, se = (v(a + b, b, a) for a, b in (("n", "w"), ("n", "e"), ("s", "w"), ("s", "e")))
    gx = (ne + 2 * v("e") + se - nw - 2 * v("w") - sw) / (8 * cell_m)
    gy = (sw + 2 * v("s") + se - nw - 2 * v("n") - ne) / (8 * cell_m)
    return n.select(*keys, "r", "c", F.when(~F.col("_gap"), F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))).alias("slope"))


def gamma0(sigma_db: Column, cosine: Column) -> Column:
    """GR-13: terrain-corrected backscatter; cells in shadow stay as they are."""
    return F.when(cosine > 0, sigma_db - 10 * F.log10(F.greatest(cosine, F.lit(1e-3)))).otherwise(sigma_db)


def local_incidence_cos(nx: Column, ny: Column, nz: Column, incidence_deg: float, azimuth_deg: float) -> Column:
    i, a = F.radians(F.lit(float(incidence_deg))), F.radians(F.lit(float(azimuth_deg)))
    return nx * F.sin(i) * F.sin(a) + ny * F.sin(i) * F.cos(a) + nz * F.cos(i)


def nearest_sample(points: DataFrame, cells: DataFrame, value: str, *, x0: float, y0: float, step: float, fill: float) -> DataFrame:
    """GR-14: value of the cell nearest to each (id, x, y), half to even; ``fill`` beyond the grid."""
    at = points.withColumns({"c": F.rint((F.col("x") - x0) / step).cast("long"), "r": F.rint((y0 - F.col("y")) / step).cast("long")})
    return at.join(cells.select("r", "c", value), ["r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(float(fill))))


def clipped_sample(points: DataFrame, cells: DataFrame, value: str, *, x0: float, y0: float, step: float, shape: tuple[int, int]) -> DataFrame:
    """GR-14: value of the cell that each (id, x, y) lies in, from the grid's upper left corner; the nearest edge cell for places beyond the grid."""
    inside = lambda v, n: F.least(F.greatest(v.cast("long"), F.lit(0)), F.lit(n - 1))
    at = points.withColumns({"c": inside((F.col("x") - x0) / step, shape[1]), "r": inside((y0 - F.col("y")) / step, shape[0])})
    return at.join(cells.select("r", "c", value), ["r", "c"], "left")


def resize_nearest(cells: DataFrame, value: str, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """GR-20: each cell of the new grid takes floor(i * source / target)."""
    spark = cells.sparkSession
    n = spark.range(to[0] * to[1]).select((F.col("id") / to[1]).cast("long").alias("i"), (F.col("id") % to[1]).alias("j"))
    n = n.withColumns({"r": F.floor(F.col("i") * shape[0] / to[0]), "c": F.floor(F.col("j") * shape[1] / to[1])})
    return n.join(cells.select("r", "c", value), ["r", "c"]).select(F.col("i").alias("r"), F.col("j").alias("c"), value)


def resize_bilinear(cells: DataFrame, value: str, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """GR-20: each cell of the new grid from the four around its centre, clamped at the edges."""
    n = cells.sparkSession.range(to[0] * to[1]).select(F.floor(F.col("id") / to[1]).alias("i"), (F.col("id") % to[1]).alias("j"))
    place = lambda k, a: F.greatest(F.lit(0.0), F.least(F.lit(shape[a] - 1.0), (F.col(k) + 0.5) * (shape[a] / to[a]) - 0.5))
    n = n.withColumns({"y": place("i", 0), "x": place("j", 1)}).withColumns({"r0": F.floor("y"), "c0": F.floor("x")})
    fy, fx = F.col("y") - F.col("r0"), F.col("x") - F.col("c0")
    corner = lambda dr, dc, w: F.struct(F.least(F.col("r0") + dr, F.lit(shape[0] - 1)).alias("r"), F.least(F.col("c0") + dc, F.lit(shape[1] - 1)).alias("c"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    found = n.select("i", "j", F.inline(corners)).join(cells.select("r", "c", value), ["r", "c"]).groupBy("i", "j").agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return found.select(F.col("i").alias("r"), F.col("j").alias("c"), value)


def median_fill_scale(cells: DataFrame, value: str, keys: Sequence[str], default: float = -30.0) -> DataFrame:
    """GR-21: missing values take the median of their scene, then all are scaled from [-30, 0] to [0, 1]."""
    middle = grouped_quantiles(cells, keys, {"_m": value}, [0.5]).withColumn("_m", F.coalesce(F.col("_m")[0], F.lit(default)))
    v = F.coalesce(value, "_m")
    return cells.join(middle, list(keys)).withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + 30) / 30))).drop("_m")


def dilate(mask: DataFrame, n: int = 1, box: bool = False) -> DataFrame:
    """GR-23: cells within n steps of a true cell: (r, c) rows are the true ones."""
    steps = range(-n, n + 1)
    near = [F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in steps for j in steps if box or abs(i) + abs(j) <= n]
    return mask.select("r", "c", F.explode(F.array(*near)).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()


def erode(mask: DataFrame, n: int = 1, box: bool = False) -> DataFrame:
    """GR-23: true cells all of whose neighbours within n steps are true."""
    steps = range(-n, n + 1)
    near = [F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in steps for j in steps if box or abs(i) + abs(j) <= n]
    votes = mask.select("r", "c", F.explode(F.array(*near)).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return votes.groupBy("r", "c").count().where(F.col("count") == len(near)).select("r", "c")


def _line_totals(cells: DataFrame, other: str, axis: str, h: int, total, values: Sequence[str]) -> DataFrame:
    """Totals of each value over the cells within ``h`` along an axis."""
    rows, own = _stretches(cells, axis, h)
    line = Window.partitionBy(other, "_b").orderBy(axis).rangeBetween(-h, h)
    return rows.select("r", "c", "_b", *[total(v).over(line).alias(v) for v in values]).where(own).drop("_b")


def open_mask(mask: DataFrame, n: int = 1) -> DataFrame:
    """GR-23: erosion and then dilation by the box of n steps.

    What is left are true cells, and so are all cells between one and the
    centre of its box: lines and then columns of true cells tell both.
    """
    out = mask.select("r", "c", F.lit(1).alias("k"))
    for other, axis in (("c", "r"), ("r", "c")):
        out = _line_totals(out, other, axis, n, F.sum, ["k"])
        out = out.withColumn("k", (F.col("k") == 2 * n + 1).cast("int"))
    for other, axis in (("r", "c"), ("c", "r")):
        out = _line_totals(out, other, axis, n, F.max, ["k"])
    return out.where("k = 1").select("r", "c")


def close_mask(mask: DataFrame) -> DataFrame:
    """GR-24: dilation and then erosion by the 3 x 3 box."""
    return erode(dilate(mask, 1, box=True), 1, box=True)


def fill_holes(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """GR-24: the true cells, and the false ones that no path of false cells joins to the edge of the grid."""
    every = mask.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    empty = label_components(every.join(mask.select("r", "c"), ["r", "c"], "left_anti"), cols)
    edge = F.col("r").isin(0, rows - 1) | F.col("c").isin(0, cols - 1)
    holes = empty.join(empty.where(edge).select("label").distinct(), "label", "left_anti")
    return mask.select("r", "c").unionByName(holes.select("r", "c"))


def label_components(mask: DataFrame, width: int) -> DataFrame:
    """GR-25: (r, c, label) of four-connected true cells; the label is the smallest cell number of the region."""
    cells = mask.select((F.col("r") * width + F.col("c")).alias("id"), "r", "c")
    steps = cells.select(F.col("id").alias("a"), F.explode(F.array(F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c")), F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c")))).alias("o"))
    edges = steps.select("a", (F.col("o.r") * width + F.col("o.c")).alias("b"), F.col("o.c").alias("oc")).where(F.col("oc") < width).join(cells.select(F.col("id").alias("b")), "b", "left_semi")
    roots = connected(edges.select("a", "b"), Scratch(mask.sparkSession, "labels"))
    return cells.join(roots, F.col("id") == F.col("node"), "left").select("r", "c", F.coalesce("root", "id").alias("label"))


def largest_region(labels: DataFrame) -> DataFrame:
    """GR-25: size and extent of the largest region; ties go to the smaller label."""
    by = labels.groupBy("label").agg(F.count("*").alias("cells"), *[f(x).alias(f"{x}_{n}") for x in ("r", "c") for n, f in (("min", F.min), ("max", F.max))])
    return by.orderBy(F.desc("cells"), "label").limit(1)


def local_std(cells: DataFrame, value: str, size: int = 3) -> DataFrame:
    """GR-26: population deviation in a window clipped to the grid, from running sums of the value and its square."""
    h = size // 2
    out = cells.select("r", "c", F.col(value).alias("x"), (F.col(value) * F.col(value)).alias("xx"), F.lit(1).alias("k"))
    for other, axis in (("r", "c"), ("c", "r")):
        out = _line_totals(out, other, axis, h, F.sum, ("x", "xx", "k"))
    mean = F.col("x") / F.col("k")
    return out.select("r", "c", F.sqrt(F.greatest(F.lit(0.0), F.col("xx") / F.col("k") - mean * mean)).alias("std"))


def windowed_fraction(cells: DataFrame, water: Column, valid: Column, half: int) -> DataFrame:
    """GR-27: water and valid share of a window clipped to the grid; separable sums."""
    out = cells.select("r", "c", (water & valid).cast("int").alias("w"), valid.cast("int").alias("v"), F.lit(1).alias("k"))
    for other, axis in (("r", "c"), ("c", "r")):
        line = Window.partitionBy(other).orderBy(axis).rangeBetween(-half, half)
        out = out.select("r", "c", *[F.sum(x).over(line).alias(x) for x in ("w", "v", "k")])
    return out.select("r", "c", F.coalesce(F.col("w") / F.nullif(F.col("v"), F.lit(0)), F.lit(0.0)).alias("water"), (F.col("v") / F.col("k")).alias("valid"))


def cell_area_km2(width: float, height: float, south: float | None = None, north: float | None = None) -> float:
    """FN-12: area of a cell in metres, or in degrees where the grid's southern and northern bounds are given: that at the middle latitude."""
    if south is None or north is None:
        return abs(width * height) / 1e6
    return abs(width) * DEGREE_M[0] * math.cos(math.radians((south + north) / 2)) * abs(height) * DEGREE_M[1] / 1e6


def change_stats(mask: DataFrame, keys: Sequence[str], true: Column, cell_km2: float) -> DataFrame:
    """GR-29: true cells and their area; see ``cell_area_km2`` for grids in degrees."""
    return mask.groupBy(*keys).agg(F.count_if(true).alias("cells")).withColumn("km2", F.col("cells") * cell_km2)


def state_and_change(p0: Column, p1: Column, tau: float = 0.5) -> dict[str, Column]:
    """GR-30: water at both dates, growth, growth by probability, drainage."""
    w0, w1 = p0 >= tau, p1 >= tau
    return {"water_0": w0, "water_1": w1, "expansion": w1 & ~w0, "delta_expansion": (p1 >= 0.5) & (p1 - p0 >= 0.2), "drainage": w0 & ~w1, "change": F.greatest(F.lit(0.0), F.least(F.lit(1.0), p1 - p0))}


def terrain_gate(raw: Column, inside: Column, slope: Column, glacier: Column, vicinity: Column, steepest: float = 15.0) -> list[Column]:
    """GR-31: counts of what a change mask loses to each gate."""
    steep, ice = slope > steepest, glacier & ~vicinity
    kept = raw & inside & ~steep & ~ice
    return [F.count_if(raw).alias("raw"), F.count_if(raw & ~inside).alias("outside"), F.count_if(raw & inside & steep).alias("steep"), F.count_if(raw & inside & ~steep & ice).alias("glacier"), F.count_if(kept).alias("gated"), F.count_if(kept & vicinity).alias("near_lake")]


def consensus(model: Column, rule: Column, slope: Column, steepest: float = 35.0) -> dict[str, Column]:
    """GR-32: the rule always counts, the model where the slope allows it; confidence by who agrees."""
    m = model & (slope <= steepest)
    return {"consensus": rule | m, "confidence": F.when(m & rule, 0.95).when(m, 0.60).when(rule, 0.70).otherwise(0.0)}


def union_counts(a: Column, b: Column) -> list[Column]:
    """GR-34"""
    return [F.count_if(a | b).alias("both_or_either"), F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second")]


def interval_counts(p0: Column, p1: Column, q: float, vicinity: Column) -> list[Column]:
    """GR-35: change counts with probabilities moved against and toward the change near lakes."""
    shift = F.when(vicinity, q).otherwise(0.0)
    grown = lambda s: (p1 + s >= 0.5) & (p0 - s < 0.5)
    return [F.count_if(grown(-shift)).alias("conservative"), F.count_if(grown(F.lit(0.0))).alias("expected"), F.count_if(grown(shift)).alias("generous")]


def sample_summary(layers: DataFrame, keys: Sequence[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """GR-36: mean, variance and quantiles of each cell over repeated layers; variance 0 for a single one."""
    return layers.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.var_samp(value)), F.lit(0.0)).alias("variance"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high")
    )


def tta_average(layers: dict[str, DataFrame], rows: int, cols: int) -> DataFrame:
    """GR-37: average of layers (r, c, p) made under flips and turns of a grid of so many rows and columns, with the cells mapped back first."""
    up, left = f"{rows - 1} - ", f"{cols - 1} - "
    back = {"id": ("r", "c"), "ud": (up + "r", "c"), "lr": ("r", left + "c"), "rot90": ("c", left + "r"), "rot180": (up + "r", left + "c"), "rot270": (up + "c", "r")}
    every = None
    for name, df in layers.items():
        r, c = back[name]
        one = df.select(F.expr(r).alias("r"), F.expr(c).alias("c"), "p")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("r", "c").agg(F.avg("p").alias("p"))


def first_valid_label(classes: DataFrame, fill: int = 255) -> DataFrame:
    """GR-38: (r, c, priority, kind): label of the first scene in which the cell is land (0) or water (1)."""
    clear = F.col("kind").isin(0, 1)
    return classes.groupBy("r", "c").agg(F.coalesce(F.min_by(F.when(clear, F.col("kind")), F.when(clear, F.col("priority"))), F.lit(fill)).alias("label"))


def candidate_label(kind: Column, index: Column, threshold: float, *, clear: Sequence[int] = (0, 1), snow: Column | None = None, most_snow: float | None = None) -> Column:
    """GR-40: 255 where the class is not a clear one, 1 where the water index is above the threshold and the snow index (if given) below its limit, else 0."""
    water = index > threshold
    if snow is not None and most_snow is not None:
        water = water & F.coalesce(snow < most_snow, F.lit(False))
    return F.when(~F.coalesce(kind.isin(*clear), F.lit(False)), 255).when(F.coalesce(water, F.lit(False)), 1).otherwise(0)


def weak_label(rules: Sequence[tuple[Column, int]], default: int = 0) -> Column:
    """GR-41: the last rule that holds wins."""
    out = F.lit(default)
    for when, value in rules:
        out = F.when(when, value).otherwise(out)
    return out


def chips(cells: DataFrame, size: int, label: Column, least: float = 0.1) -> DataFrame:
    """GR-42, GR-43: tiles of the grid with their counts; those with too few labelled cells go."""
    key = [F.floor(F.col(x) / size).alias(f"chip_{x}") for x in ("r", "c")]
    by = cells.groupBy(*key).agg(F.count("*").alias("cells"), F.count_if(label.isin(0, 1)).alias("labelled"), F.count_if(label == 1).alias("positive"))
    return by.where(F.col("labelled") >= least * size * size)


def background_chips(cells: DataFrame, size: int, stride: int, positive: Column, most: int, seed: int) -> DataFrame:
    """GR-42: up to so many windows on a stride that lie within the grid and hold no positive cell, in seeded order."""
    shape = cells.agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    starts = lambda x: F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col(x) - size + 1) / stride)), F.floor(F.col(x) / stride))
    # starts beyond a cell's own stride come only with windows that overlap, so a cell has (size / stride) ** 2 copies at most
    held = cells.select("r", "c", positive.alias("_p")).withColumn("i", F.explode(starts("r"))).withColumn("j", F.explode(starts("c")))
    by = held.groupBy((F.col("i") * stride).alias("row"), (F.col("j") * stride).alias("col")).agg(F.count("*").alias("cells"), F.count_if("_p").alias("_n")).join(F.broadcast(shape), F.lit(True))
    free = by.where((F.col("_n") == 0) & (F.col("row") + size <= F.col("_h")) & (F.col("col") + size <= F.col("_w")))
    return free.select("row", "col", "cells").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row").cast("string"), F.col("col").cast("string"))), "row", "col").limit(most)


def rule_channel(chip_cells: DataFrame, rule: DataFrame) -> DataFrame:
    """GR-56: cells of chips (pair, chip, r, c, label) with the rule mask (pair, r, c: its true cells) as one more channel."""
    return chip_cells.join(rule.select("pair", "r", "c").distinct().withColumn("rule", F.lit(1)), ["pair", "r", "c"], "left").withColumn("rule", F.coalesce("rule", F.lit(0)))


def rule_report(chip_cells: DataFrame) -> DataFrame:
    """GR-56: chips, rule and label cells, and the overlap of both, of each pair and of all."""
    rule, label = F.col("rule") == 1, F.col("label") == 1
    by = chip_cells.rollup("pair").agg(F.countDistinct("pair", "chip").alias("chips"), F.count_if(rule).alias("rule_cells"), F.count_if(label).alias("label_cells"), F.count_if(rule & label).alias("_i"), F.count_if(rule | label).alias("_u"))
    return by.select("pair", "chips", "rule_cells", "label_cells", (F.col("_i") / F.nullif(F.col("_u"), F.lit(0))).alias("iou"))


def dem_difference(cells: DataFrame, before: str, after: str, loss: float, gain: float, cell_m2: float) -> DataFrame:
    """GR-44: volumes lost and gained between two elevations where both are valid."""
    d = F.col(after) - F.col(before)
    return cells.agg(
        F.sum(F.when(d < -loss, -d).otherwise(0.0) * cell_m2).alias("lost_m3"), F.sum(F.when(d > gain, d).otherwise(0.0) * cell_m2).alias("gained_m3"), F.count_if(d < -loss).alias("lost_cells"), F.count_if(d > gain).alias("gained_cells"), F.count(d).alias("valid")
    )


def lake_rim_level(cells: DataFrame, water: Column) -> DataFrame:
    """GR-47, GR-48: lowest elevation of the dry cells beside water, and the volume below it; (r, c, z)."""
    n = with_neighbours(cells.withColumn("_w", water.cast("int")), "_w")
    beside = F.greatest(*[F.coalesce(x, F.lit(0)) for x in ("n", "s", "w", "e")]) == 1
    rim = n.agg(F.min(F.when((F.col("_w") == 0) & beside, F.col("z"))).alias("level"))
    wet = n.where("_w = 1").join(F.broadcast(rim), F.lit(True))
    return wet.groupBy("level").agg(F.sum(F.greatest(F.lit(0.0), F.col("level") - F.col("z"))).alias("depth_sum"), F.count("*").alias("cells"))


#: Backscatter below which a cell is dark, and the shares of dark cells and median that class a lake.
DARK_DB, CLEAR_SHARE, HIDDEN_SHARE, HIDDEN_DB = -15.0, 0.5, 0.2, -12.0


def visibility_audit(cells: DataFrame, lake: str, vv: str, vh: str, least_cells: int = 3) -> DataFrame:
    """GR-50: median backscatter, dark share and class of each lake's cells; lakes of too few cells are left out."""
    by = cells.groupBy(lake).agg(F.count("*").alias("cells"), F.avg((F.col(vv) < DARK_DB).cast("double")).alias("dark"))
    by = with_quantiles(by, cells, [lake], {"median_vv": vv, "median_vh": vh}, [0.5]).withColumns({c: F.col(c)[0] for c in ("median_vv", "median_vh")})
    by = by.select(lake, "cells", "median_vv", "median_vh", "dark")
    hidden = (F.col("dark") < HIDDEN_SHARE) & (F.col("median_vv") > HIDDEN_DB)
    return by.where(F.col("cells") >= least_cells).withColumn("class", F.when(F.col("dark") > CLEAR_SHARE, "monitorable").when(hidden, "invisible").otherwise("marginal"))


def swath_edge(points: DataFrame) -> DataFrame:
    """GR-51: easternmost longitude of each tenth of a degree."""
    return points.groupBy(F.round("lat", 1).alias("lat")).agg(F.max("lon").alias("lon"))
