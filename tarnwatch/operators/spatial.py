"""Joins of points within a radius, by an equi-join on grid squares."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import EARTH_RADIUS_KM, great_circle_km
from tarnwatch.operators.graph import connected
from tarnwatch.scratch import Scratch


def _squares(df: DataFrame, radius_km: float, spread: bool) -> DataFrame:
    """Adds the row and column of a square at least as wide as the radius; with ``spread`` those around it too.

    Columns of a row of squares are as wide as its poleward edge needs.
    """
    step = math.degrees(radius_km / EARTH_RADIUS_KM) * 1.001
    row = F.floor(F.col("lat") / step)
    rows = F.explode(F.sequence(row - 1, row + 1)) if spread else row
    out = df.withColumn("_row", rows)
    widest = F.radians(F.least(F.lit(89.0), F.greatest(F.abs(F.col("_row") * step), F.abs((F.col("_row") + 1) * step))))
    col = F.floor(F.col("lon") / (F.lit(step) / F.cos(widest)))
    return out.withColumn("_col", F.explode(F.sequence(col - 1, col + 1)) if spread else col)


def pairs_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """JN-05: (id, lat, lon) rows of both sides not farther apart than the radius, with their distance."""
    a = _squares(left.select("id", "lat", "lon"), radius_km, spread=True)
    b = _squares(right.select("id", "lat", "lon"), radius_km, spread=False)
    b = b.select(F.col("id").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), "_row", "_col")
    km = great_circle_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))
    return a.join(b.hint("merge"), ["_row", "_col"]).withColumn("km", km).where(F.col("km") <= radius_km).select("id", "other", "km")


def _places(points: DataFrame) -> DataFrame:
    """The different places of (lat, lon) rows, each its own id: rows at one place need one search."""
    return points.select(F.struct("lat", "lon").alias("id"), "lat", "lon").distinct()


def nearest_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """JN-02: the nearest of the other side within the radius, if any; ties go to the smaller id."""
    places = right.groupBy("lat", "lon").agg(F.min("id").alias("id"))
    best = pairs_within(_places(left), places, radius_km).groupBy("id").agg(F.min(F.struct("km", "other")).alias("b")).select("id.lat", "id.lon", "b.other", "b.km")
    return left.join(best.hint("merge"), ["lat", "lon"], "left").select("id", "other", "km")


def none_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """JN-03: rows that have nothing of the other side within the radius."""
    near = pairs_within(_places(left), _places(right), radius_km).select("id.lat", "id.lon").distinct()
    return left.join(near.hint("merge"), ["lat", "lon"], "left_anti").select(left.columns)


def any_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """JN-07: whether something of the other side is within the radius."""
    hit = pairs_within(_places(left), _places(right), radius_km).select("id.lat", "id.lon").distinct().withColumn("known", F.lit(True))
    return left.join(hit.hint("merge"), ["lat", "lon"], "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


#: Rounds in which all points are decided at once; what is left after them goes component by component.
ROUNDS = 12


def _in_order(batches):
    """Rows come sorted by component and id; a point is a centre if none of its open earlier neighbours became one."""
    at, centres = None, set()
    for batch in batches:
        out = []
        for component, i, earlier in zip(*(batch.column(c).to_pylist() for c in ("component", "id", "earlier")), strict=True):
            if component != at:
                at, centres = component, set()
            out.append(not any(e in centres for e in earlier or ()))
            if out[-1]:
                centres.add(i)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.bool_())], names=["id", "centre"])


def greedy_radius_clusters(points: DataFrame, radius_km: float) -> DataFrame:
    """JN-01: (id, lat, lon) in id order: a point joins the first earlier centre within the radius, else becomes one.

    Rounds decide points all of whose earlier neighbours are decided: one that
    has an earlier centre is a member, one with none is a centre. Where ids
    follow no path through space a few rounds do; long chains that are left
    after twelve are decided in id order, each component as one sorted stream
    that keeps its centres only. The result is that of the sequential rule.
    Of points at one place the first decides: whatever centre it finds or
    becomes is the first one of the others too, and they become none.
    Returns id and the id of its centre.
    """
    scratch = Scratch(points.sparkSession, "clusters")
    nowhere = F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.col("id"))
    every = points.select("id", "lat", "lon", nowhere.alias("_own"))
    points = scratch.cut(every.groupBy("lat", "lon", "_own").agg(F.min("id").alias("id")), "places")
    earlier = scratch.cut(pairs_within(points, points, radius_km).where("other < id").select("id", "other"), "pairs")
    state = scratch.cut(points.select("id", F.lit(None).cast("boolean").alias("centre")), "state")
    for _ in range(ROUNDS):
        known = earlier.join(state.select(F.col("id").alias("other"), F.col("centre").alias("c")), "other")
        votes = known.groupBy("id").agg(F.bool_or(F.coalesce("c", F.lit(False))).alias("member"), F.count_if(F.col("c").isNull()).alias("open"))
        decided = F.when(F.coalesce("member", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = scratch.cut(state.join(votes, "id", "left").select("id", F.coalesce("centre", decided).alias("centre")), "state")
        if state.where("centre IS NULL").isEmpty():
            break
    else:
        left = state.where("centre IS NULL").select("id")
        links = scratch.cut(earlier.join(left, "id", "left_semi").join(left.withColumnRenamed("id", "other"), "other", "left_semi").select("id", "other"), "open")
        component = connected(links.toDF("a", "b"), scratch).select(F.col("node").alias("id"), F.col("root").alias("component"))
        rows = left.join(component, "id", "left").join(links.groupBy("id").agg(F.collect_list("other").alias("earlier")), "id", "left")
        rows = rows.select(F.coalesce("component", "id").alias("component"), "id", "earlier").repartition("component").sortWithinPartitions("component", "id")
        last = rows.mapInArrow(_in_order, "id long, centre boolean")
        state = scratch.cut(state.where("centre IS NOT NULL").union(last), "state")
    centres = state.where("centre").select(F.col("id").alias("other"))
    first = earlier.join(centres, "other").groupBy("id").agg(F.min("other").alias("first"))
    found = state.join(first, "id", "left").select("id", F.when(F.col("centre"), F.col("id")).otherwise(F.col("first")).alias("centre"))
    placed = points.join(found, "id").select(*[F.col(c).alias(f"{c}_") for c in ("lat", "lon", "_own")], "centre")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("lat", "lon", "_own")]
    return every.join(placed.hint("merge"), same).select("id", "centre")


def arrival_horizons(assets: DataFrame, sectors: DataFrame) -> DataFrame:
    """HY-10: minutes of the first sector (id, name) whose name holds the asset's or is held by it.

    The sectors are a small fixed list, so they are broadcast.
    """
    match = F.col("name").contains(F.col("sector")) | F.col("sector").contains(F.col("name"))
    s = sectors.select(F.col("id").alias("order"), F.lower("name").alias("sector"), "minutes")
    found = assets.withColumn("name", F.lower("name")).join(F.broadcast(s), match, "left").groupBy("id").agg(F.min_by("minutes", "order").alias("minutes"))
    return found.withColumn("available", F.col("minutes").isNotNull())


#: Fine squares on a side of a coarse one, and where the squares begin, as parts of their side: off round numbers, so that
#: corners of squares and of polygons hardly ever coincide.
COARSE = 16
_ORIGIN = (0.381966, 0.236068)


def _place(v: Column, side: float, axis: int) -> Column:
    return F.floor(v / side - _ORIGIN[axis]).cast("long")


def _corner(k: Column, side: float, axis: int) -> Column:
    return (k + _ORIGIN[axis]) * side


def _edge_squares(edges: DataFrame, side: float) -> DataFrame:
    """Edges once for each square (_r, _c) that they pass: cut into rows of squares, and then into squares by where they run in the row."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("_r", F.explode(F.sequence(_place(low, side, 1), _place(high, side, 1))))
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    bottom, top = F.greatest(low, _corner(F.col("_r"), side, 1)), F.least(high, _corner(F.col("_r") + 1, side, 1))
    a, b = F.coalesce(at(bottom), "x1"), F.coalesce(at(top), "x2")
    slack = side * 1e-9  # a square too many does no harm
    return rows.withColumn("_c", F.explode(F.sequence(_place(F.least(a, b) - slack, side, 0), _place(F.greatest(a, b) + slack, side, 0))))


def _cover_of(edges: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """Border squares (poly, _r, _c, odd, edges of the square) and runs of squares without edges inside (poly, _r, _from, _to).

    ``odd`` tells whether the square's lower left corner is inside. It and the
    state of each run come from one pass over a polygon's crossings with the
    lower line of a row of squares, from right to left.
    """
    passed = _edge_squares(edges, side)
    y0 = _corner(F.col("_r"), side, 1)
    crosses = (F.col("y1") > y0) != (F.col("y2") > y0)
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * (y0 - F.col("y1")) / (F.col("y2") - F.col("y1"))
    none = F.lit(None).cast("long")
    rows = edges.withColumn("_r", F.explode(F.sequence(_place(F.least("y1", "y2"), side, 1), _place(F.greatest("y1", "y2"), side, 1))))
    crossings = rows.where(crosses).select("poly", "_r", x.alias("x"), F.lit(1).alias("one"), none.alias("_c"), none.alias("_to"))
    border = passed.select("poly", "_r", "_c").distinct()
    row = Window.partitionBy("poly", "_r").orderBy("_c")
    ends = border.withColumn("_next", F.lead("_c").over(row))
    asked = F.explode(F.array(F.struct("_c", none.alias("_to")), F.struct((F.col("_c") + 1).alias("_c"), (F.col("_next") - 1).alias("_to"))))
    asked = ends.select("poly", "_r", asked.alias("q")).select("poly", "_r", "q._c", "q._to", F.col("q._to").isNull().alias("is_border"))
    asked = asked.where("is_border OR _to >= _c").dropDuplicates(["poly", "_r", "_c", "is_border"])
    asked = asked.select("poly", "_r", _corner(F.col("_c"), side, 0).alias("x"), F.lit(0).alias("one"), "_c", "_to")
    leftward = Window.partitionBy("poly", "_r").orderBy(F.desc("x"), "one").rowsBetween(Window.unboundedPreceding, 0)
    told = crossings.unionByName(asked).withColumn("odd", F.sum("one").over(leftward) % 2).where("one = 0")
    inner = told.where("_to IS NOT NULL AND odd = 1").select("poly", "_r", F.col("_c").alias("_from"), "_to")
    corners = told.where("_to IS NULL").select("poly", "_r", "_c", "odd")
    return passed.join(corners.hint("merge"), ["poly", "_r", "_c"]), inner


def polygon_cover(edges: DataFrame, side: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cover of polygons (poly and its edges) by squares of two sizes, as three tables.

    Coarse squares that lie inside (poly, _r, _c); fine squares that lie inside
    within coarse ones that have edges (the same columns); and fine squares
    with edges: one row for each edge, with the state of the lower left corner.
    Rows grow with a polygon's area in coarse squares and its length in fine ones.
    """
    scratch = Scratch(edges.sparkSession, "cover")
    edges = scratch.cut(edges.select("poly", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), "edges")
    wide = side * COARSE
    coarse_border, coarse_runs = _cover_of(edges, wide)
    coarse = coarse_runs.select("poly", "_r", F.explode(F.sequence("_from", "_to")).alias("_c"))
    border, runs = _cover_of(edges, side)
    # fine squares need not lie within one coarse square: one that touches a coarse square with edges is kept
    middle = lambda k, axis, shift: _place(_corner(F.col(k) + shift, side, axis), wide, axis)
    cut = runs.withColumn("_wr", F.explode(F.array_distinct(F.array(middle("_r", 1, 0), middle("_r", 1, 1)))))
    cut = cut.withColumn("_wc", F.explode(F.sequence(middle("_from", 0, 0), middle("_to", 0, 1))))
    near = coarse_border.select("poly", F.col("_r").alias("_wr"), F.col("_c").alias("_wc")).distinct()
    cut = cut.join(near.hint("merge"), ["poly", "_wr", "_wc"], "left_semi")
    first, last = _place(_corner(F.col("_wc"), wide, 0), side, 0), _place(_corner(F.col("_wc") + 1, wide, 0), side, 0)
    cut = cut.withColumns({"_a": F.greatest("_from", first), "_b": F.least("_to", last)}).where("_a <= _b")
    fine = cut.select("poly", "_r", F.explode(F.sequence("_a", "_b")).alias("_c")).distinct()
    return scratch.cut(coarse, "coarse"), scratch.cut(fine, "fine"), scratch.cut(border, "border")


def places_inside(places: DataFrame, edges: DataFrame, cell: float = 0.25) -> DataFrame:
    """(x, y, poly) of different places (x, y) and the polygons around them, given as edges (poly, x1, y1, x2, y2), by crossing parity.

    Places meet a cover of the polygons by squares of side ``cell`` and sixteen
    times that. Those in a square inside a polygon need no test. Those in a
    square with edges go from the square's lower left corner, whose state is
    known, up to their height and then right, and meet the square's edges only.
    So every join has a square as its key, whatever lies on a place's latitude.
    """
    coarse, fine, border = (t.hint("merge") for t in polygon_cover(edges, cell))
    at = lambda side: places.select("x", "y", _place(F.col("y"), side, 1).alias("_r"), _place(F.col("x"), side, 0).alias("_c"))
    inside = at(cell * COARSE).join(coarse, ["_r", "_c"]).select("x", "y", "poly").unionByName(at(cell).join(fine, ["_r", "_c"]).select("x", "y", "poly"))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    x0, y0 = _corner(F.col("_c"), cell, 0), _corner(F.col("_r"), cell, 1)
    up = y1 + (y2 - y1) * (x0 - x1) / F.nullif(x2 - x1, F.lit(0.0))
    upward = ((x1 > x0) != (x2 > x0)) & (up > y0) & (up <= y)
    right = x1 + (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0))
    rightward = ((y1 > y) != (y2 > y)) & (right > x0) & (right <= x)
    met = at(cell).join(border, ["_r", "_c"]).withColumn("crossed", upward.cast("int") + rightward.cast("int"))
    tested = met.groupBy("x", "y", "poly").agg(((F.max("odd") + F.sum("crossed")) % 2).alias("odd")).where("odd = 1").select("x", "y", "poly")
    return inside.unionByName(tested).distinct()


def polygon_parity(points: DataFrame, edges: DataFrame, cell: float = 0.25) -> DataFrame:
    """GR-17, GR-18: points (id, x, y) inside polygons given as edges; see ``places_inside``. Ids are unique.

    Points at one place are tested once and meet its polygons at the end.
    """
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return p.join(places_inside(p.select("x", "y").distinct(), edges, cell).hint("merge"), ["x", "y"]).select("id", "poly")


def clip_cells(cells: DataFrame, edges: DataFrame, value: str, band: float) -> DataFrame:
    """GR-18: cells (r, c, x, y, value) within the extent of the polygons; the value is null outside of them."""
    box = edges.agg(F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"), F.min(F.least("y1", "y2")).alias("_s"), F.max(F.greatest("y1", "y2")).alias("_n"))
    within = F.col("x").between(F.col("_w"), F.col("_e")) & F.col("y").between(F.col("_s"), F.col("_n"))
    cropped = cells.select(F.struct("r", "c").alias("id"), "x", "y", value).join(F.broadcast(box), within).drop("_w", "_e", "_s", "_n")
    inside = polygon_parity(cropped.select("id", "x", "y"), edges, band).select("id").distinct().withColumn("_in", F.lit(True))
    return cropped.join(inside, "id", "left").select("id.r", "id.c", "x", "y", F.when(F.col("_in"), F.col(value)).alias(value))


def scene_date_candidates(wanted: DataFrame, scenes: DataFrame, days: int = 7, keep: int = 6) -> DataFrame:
    """JN-09: scenes within some days of each wanted date, best first by cloud and then by days.

    Scenes of one day are equally far from a date, so only the first ``keep`` of
    each day can be among a date's first: they are ranked for each different
    date, and those ranks reach the rows that want the date. Work grows with the
    rows of both sides and not with their pairs.
    """
    daily = Window.partitionBy("taken").orderBy("cloud", "scene_id")
    s = scenes.where("taken IS NOT NULL").withColumn("_k", F.row_number().over(daily)).where(F.col("_k") <= keep).drop("_k")
    dates = wanted.select("day").distinct().withColumn("taken", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))))
    order = lambda key: Window.partitionBy(key).orderBy("cloud", "off", "scene_id")
    found = dates.join(s, "taken").withColumn("off", F.abs(F.datediff("taken", "day")))
    found = found.withColumn("_k", F.row_number().over(order("day"))).where(F.col("_k") <= keep).select("day", "scene_id", "cloud", "off")
    out = wanted.join(found, "day").withColumn("rank", F.row_number().over(order("want_id"))).where(F.col("rank") <= keep)
    return out.select("want_id", "scene_id", "cloud", "off", "rank")


def scene_date_status(wanted: DataFrame, candidates: DataFrame, most_cloud: float = 30.0) -> DataFrame:
    """JN-09: one row for each wanted date with its best scene, from ``scene_date_candidates``.

    ``status`` is found or no_scenes, ``clear`` whether the best scene's cloud
    is within the limit (null without a scene), ``fallbacks`` how many follow it.
    """
    best = candidates.groupBy("want_id").agg(F.min(F.struct("rank", "scene_id", "cloud", "off")).alias("b"), (F.count("*") - 1).alias("fallbacks"))
    found = wanted.select("want_id").join(best.select("want_id", "b.scene_id", "b.cloud", "b.off", "fallbacks"), "want_id", "left")
    return found.select("want_id", F.when(F.col("scene_id").isNull(), "no_scenes").otherwise("found").alias("status"), "scene_id", "cloud", "off", (F.col("cloud") <= most_cloud).alias("clear"), F.coalesce("fallbacks", F.lit(0)).alias("fallbacks"))


def scene_pair_pick(scenes: DataFrame, key: str, target_days: int, most_days: int) -> DataFrame:
    """JN-14: the pair of a key's scenes whose gap is nearest to the target; the earliest pair wins ties.

    Of scenes of one day the first stands for all, so pairs are those of a key's days.
    """
    span = lambda d: F.floor(F.unix_date(d) / most_days)
    scenes = scenes.groupBy(key, "taken").agg(F.min(F.struct("scene_id")).alias("b")).select(key, "taken", "b.scene_id")
    a = scenes.select(key, F.col("scene_id").alias("first"), F.col("taken").alias("t1")).withColumn("_s", F.explode(F.sequence(span("t1"), span("t1") + 1)))
    b = scenes.select(key, F.col("scene_id").alias("second"), F.col("taken").alias("t2")).withColumn("_s", span("t2"))
    gap = F.datediff("t2", "t1")
    pairs = a.join(b, [key, "_s"]).where((gap > 0) & (gap <= most_days))
    best = pairs.groupBy(key).agg(F.min(F.struct(F.abs(gap - target_days).alias("off"), "t1", "t2", "first", "second")).alias("b"))
    return best.select(key, "b.first", "b.second", "b.off")
