"""Distances and areas between points and shapes in metric coordinates, and what a flow path exposes.

Shapes are tables of edges (x1, y1, x2, y2). Points meet edges by equality of
grid squares whose side is the radius at hand. Files of regular shapes are far
smaller than their rows, so joins that grow with the input are kept from being
broadcast by a hint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.spatial import places_inside, polygon_parity
from tarnwatch.scratch import Scratch


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to a segment, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))).otherwise(0.0)
    px, py = x1 + t * dx - x, y1 + t * dy - y
    return F.sqrt(px * px + py * py)


def _in_squares(edges: DataFrame, side: float, margin: int = 0) -> DataFrame:
    """Edges once for each square of their bounding box, and of so many squares around it."""
    upto = lambda a, b: F.sequence(F.floor(F.least(a, b) / side) - margin, F.floor(F.greatest(a, b) / side) + margin)
    return edges.withColumn("_sx", F.explode(upto("x1", "x2"))).withColumn("_sy", F.explode(upto("y1", "y2")))


def edges_near(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y, ...) with each edge that is within the radius, and its distance; a pair may come up more than once."""
    around = lambda v: F.sequence(F.floor(F.col(v) / radius) - 1, F.floor(F.col(v) / radius) + 1)
    p = points.withColumn("_sx", F.explode(around("x"))).withColumn("_sy", F.explode(around("y")))
    d = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    return p.join(_in_squares(edges, radius).hint("merge"), ["_sx", "_sy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_sx", "_sy")


def nearest_edge(points: DataFrame, edges: DataFrame, first_radius: float) -> DataFrame:
    """(id, distance) to the nearest edge. The radius doubles until every point has met one, so rounds grow with the logarithm of the longest distance."""
    scratch = Scratch(points.sparkSession, "nearest")
    edges = scratch.cut(edges.select("x1", "y1", "x2", "y2").distinct(), "edges")
    left, radius, found = scratch.cut(points.select("id", "x", "y"), "points"), first_radius, None
    if edges.isEmpty():
        return left.select("id", F.lit(None).cast("double").alias("distance"))
    while True:
        met = scratch.cut(edges_near(left, edges, radius).groupBy("id").agg(F.min("distance").alias("distance")), "met")
        found = met if found is None else found.unionByName(met)
        left = scratch.cut(left.join(met.hint("merge"), "id", "left_anti"), "points")
        if left.isEmpty():
            return found
        radius *= 2


def nearest_polygon_distance(points: DataFrame, edges: DataFrame, first_radius: float) -> DataFrame:
    """JN-04: distance of each (id, x, y) to the nearest polygon (poly and its edges), 0 inside one, null where there is none; points at one place are searched for once."""
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = Scratch(points.sparkSession, "places").cut(p.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct(), "places")
    inside = places_inside(places, edges, first_radius).select("x", "y").distinct().withColumn("_in", F.lit(True))
    found = nearest_edge(places.select(F.struct("x", "y").alias("id"), "x", "y"), edges, first_radius).select("id.x", "id.y", "distance")
    found = found.join(inside.hint("merge"), ["x", "y"], "left").select("x", "y", F.when(F.col("_in"), 0.0).otherwise(F.col("distance")).alias("distance"))
    return p.join(found.hint("merge"), ["x", "y"], "left").select("id", "distance")


def disc_parts(pairs: DataFrame, radius: float) -> DataFrame:
    """Adds ``part`` to (x, y, x1, y1, x2, y2, ...): the signed area that an edge of a polygon adds to the polygon's part of the disc around (x, y): a triangle where the edge is inside, sectors elsewhere.

    Values that are used more than once are columns of their own, so that each is worked out once.
    """
    c = F.col
    sector = lambda ux, uy, vx, vy: F.lit(radius * radius / 2) * F.atan2(c(ux) * c(vy) - c(uy) * c(vx), c(ux) * c(vx) + c(uy) * c(vy))
    cut = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(t)))
    df = pairs.withColumns({"_ax": c("x1") - c("x"), "_ay": c("y1") - c("y"), "_bx": c("x2") - c("x"), "_by": c("y2") - c("y")})
    df = df.withColumns({"_dx": c("_bx") - c("_ax"), "_dy": c("_by") - c("_ay")})
    df = df.withColumns({"_a": c("_dx") * c("_dx") + c("_dy") * c("_dy"), "_b": c("_ax") * c("_dx") + c("_ay") * c("_dy"), "_c": c("_ax") * c("_ax") + c("_ay") * c("_ay") - radius * radius})
    df = df.withColumn("_root", c("_b") * c("_b") - c("_a") * c("_c"))
    meets = (c("_root") > 0) & (c("_a") > 0)
    df = df.withColumns({"_t1": F.when(meets, (-c("_b") - F.sqrt("_root")) / c("_a")), "_t2": F.when(meets, (-c("_b") + F.sqrt("_root")) / c("_a"))})
    df = df.withColumns({"_u1": cut("_t1"), "_u2": cut("_t2")})
    df = df.withColumns({"_px": c("_ax") + c("_dx") * c("_u1"), "_py": c("_ay") + c("_dy") * c("_u1"), "_qx": c("_ax") + c("_dx") * c("_u2"), "_qy": c("_ay") + c("_dy") * c("_u2")})
    apart = c("_t1").isNull() | (c("_t1") >= 1) | (c("_t2") <= 0)
    through = sector("_ax", "_ay", "_px", "_py") + (c("_px") * c("_qy") - c("_py") * c("_qx")) / 2 + sector("_qx", "_qy", "_bx", "_by")
    part = F.when(c("_a") == 0, 0.0).when(apart, sector("_ax", "_ay", "_bx", "_by")).otherwise(through)
    return df.select(*pairs.columns, part.alias("part"))


def area_within_radius(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """JN-06: area of all polygons within a disc around each (id, x, y), exactly; 0 where there is none.

    A polygon's bounding box puts it beside a place, once for all points there;
    then all its edges count.
    """
    boxes = edges.groupBy("poly").agg(F.min(F.least("x1", "x2")).alias("x1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("y1", "y2")).alias("y2"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = p.select("x", "y", *[F.col(a).alias(f"p{b}") for a, b in (("x", "x1"), ("y", "y1"), ("x", "x2"), ("y", "y2"))]).distinct()
    off = lambda v: F.greatest(F.col(f"{v}1") - F.col(v), F.col(v) - F.col(f"{v}2"), F.lit(0.0))
    near = _meeting(places, boxes, radius).where(off("x") * off("x") + off("y") * off("y") <= radius * radius).select("x", "y", "poly").join(edges.hint("merge"), "poly")
    by = disc_parts(near, radius).groupBy("x", "y", "poly").agg(F.abs(F.sum("part")).alias("area")).groupBy("x", "y").agg(F.sum("area").alias("area"))
    return p.join(by.hint("merge"), ["x", "y"], "left").select("id", F.coalesce("area", F.lit(0.0)).alias("area"))


def _cross(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_distance(a: list[Column], b: list[Column]) -> Column:
    """Between two segments (x1, y1, x2, y2): 0 where they cross, else the least distance of an end to the other one."""
    crossing = (_cross(*a, b[0], b[1]) * _cross(*a, b[2], b[3]) < 0) & (_cross(*b, a[0], a[1]) * _cross(*b, a[2], a[3]) < 0)
    ends = F.least(segment_distance(a[0], a[1], *b), segment_distance(a[2], a[3], *b), segment_distance(b[0], b[1], *a), segment_distance(b[2], b[3], *a))
    return F.when(crossing, 0.0).otherwise(ends)


def _meeting(pieces: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """Pieces (px1, py1, px2, py2, ...) beside the edges whose squares touch theirs, each pair once: in the first square that they share."""
    first = lambda a, b: F.floor(F.least(a, b) / side)
    upto = lambda a, b: F.sequence(first(a, b) - 1, F.floor(F.greatest(a, b) / side) + 1)
    p = pieces.withColumn("_sx", F.explode(upto("px1", "px2"))).withColumn("_sy", F.explode(upto("py1", "py2")))
    both = p.join(_in_squares(edges, side).hint("merge"), ["_sx", "_sy"])
    own = lambda s, a, b: F.col(s) == F.greatest(first("p" + a, "p" + b) - 1, first(a, b))
    return both.where(own("_sx", "x1", "x2") & own("_sy", "y1", "y2")).drop("_sx", "_sy")


def _covered_line(x: Column, y: Column, ux: Column, uy: Column, edge: list[Column], radius: float) -> Column:
    """Where a line from (x, y) along (ux, uy) is within the radius of an edge: one stretch, as what surrounds a segment is convex."""
    x1, y1, x2, y2 = edge
    length = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    ex, ey = F.when(length > 0, (x2 - x1) / length).otherwise(1.0), F.when(length > 0, (y2 - y1) / length).otherwise(0.0)

    def disc(cx, cy):
        along, off = (cx - x) * ux + (cy - y) * uy, (cx - x) * uy - (cy - y) * ux
        half = F.when(F.abs(off) < radius, F.sqrt(F.greatest(F.lit(0.0), radius * radius - off * off)))
        return along - half, along + half

    def slab(at, slope, low, high):
        level, by = F.abs(slope) < 1e-12, F.nullif(slope, F.lit(0.0))
        everywhere = F.when((at >= low) & (at <= high), F.lit(1e300))
        return F.when(level, -everywhere).otherwise(F.least((low - at) / by, (high - at) / by)), F.when(level, everywhere).otherwise(F.greatest((low - at) / by, (high - at) / by))

    a = slab((x - x1) * ex + (y - y1) * ey, ux * ex + uy * ey, F.lit(0.0), length)
    b = slab((x - x1) * ey - (y - y1) * ex, ux * ey - uy * ex, F.lit(-radius), F.lit(radius))
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    beside = a[0].isNotNull() & b[0].isNotNull() & (low < high)
    one, two = disc(x1, y1), disc(x2, y2)
    return F.struct(F.least(one[0], two[0], F.when(beside, low)).alias("s"), F.greatest(one[1], two[1], F.when(beside, high)).alias("e"))


def _covered_circle(met: DataFrame, radius: float) -> DataFrame:
    """(piece, s, e): angles of the circle around (cx, cy) that are nearer than the radius to the edge beside it, one arc.

    A point q of the edge covers the arc that looks toward q; the outermost
    angles are those of q beneath the places where the circle leaves the band
    along the edge, or of the edge's ends.
    """
    c, turn = F.col, 2 * math.pi
    dx, dy, w = c("x2") - c("x1"), c("y2") - c("y1"), c("_w")
    m = met.withColumn("_w", F.sqrt(dx * dx + dy * dy)).withColumns({"_ex": F.when(w > 0, dx / w).otherwise(1.0), "_ey": F.when(w > 0, dy / w).otherwise(0.0)})
    m = m.withColumns({"_off": (c("y1") - c("cy")) * c("_ex") - (c("x1") - c("cx")) * c("_ey"), "_a": (c("x1") - c("cx")) * c("_ex") + (c("y1") - c("cy")) * c("_ey")})
    m = m.withColumn("_h", F.greatest(F.abs("_off"), F.lit(1e-12 * radius))).where(c("_h") < 2 * radius)
    wide = F.sqrt(4 * radius * radius - c("_h") * c("_h"))
    m = m.withColumns({"_s0": F.greatest(c("_a"), -wide), "_s1": F.least(c("_a") + w, wide), "_turn": F.sqrt(c("_h") * (2 * radius - c("_h")))})
    # on the edge's own line its points near the centre tell no direction
    least, on_line = 1e-6 * radius, c("_h") < 1e-7 * radius
    m = m.withColumns({"_s0": F.when(on_line & (F.abs("_s0") <= least), least).otherwise(c("_s0")), "_s1": F.when(on_line & (F.abs("_s1") <= least), -least).otherwise(c("_s1"))}).where("_s0 <= _s1")
    m = m.withColumns({"_low": F.greatest(c("_s0"), F.least(c("_s1"), -c("_turn"))), "_high": F.greatest(c("_s0"), F.least(c("_s1"), c("_turn")))})
    half = lambda v: F.acos(F.least(F.lit(1.0), F.sqrt(c("_h") * c("_h") + c(v) * c(v)) / (2 * radius)))
    m = m.withColumns({"_low": F.atan2(c("_low"), c("_h")) - half("_low"), "_high": F.atan2(c("_high"), c("_h")) + half("_high")})
    # an edge to the left of its own direction turns angles from the normal backward
    left = c("_off") >= 0
    normal = F.when(left, F.atan2(c("_ex"), -c("_ey"))).otherwise(F.atan2(-c("_ex"), c("_ey")))
    m = m.withColumn("s", F.pmod(F.when(left, normal - c("_high")).otherwise(normal + c("_low")), F.lit(turn)))
    return m.select("piece", "s", (c("s") + F.least(c("_high") - c("_low"), F.lit(turn))).alias("e")).where("e > s")


def _uncovered(pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """Stretches (s, e) between 0 and piece.whole of each piece that no span (piece, s, e) covers."""
    whole = F.col("piece.whole")
    rows = spans.select("piece", F.greatest("s", F.lit(0.0)).alias("s"), "e").where("e > s").unionByName(pieces.select("piece", whole.alias("s"), whole.alias("e")))
    before = Window.partitionBy("piece").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.select("piece", F.coalesce(F.max("e").over(before), F.lit(0.0)).alias("s"), F.least("s", whole).alias("e"))
    return gaps.where("e > s")


def corridor_outline(edges: DataFrame, radius: float) -> DataFrame:
    """Outline of all that is within the radius of any edge (x1, y1, x2, y2), holes included, as unordered pieces.

    A piece is straight (x1, y1, x2, y2; cx null), or an arc around (cx, cy)
    from angle t0 to t1 with those ends. Sides of edges and circles around
    their ends are the candidates; what other edges cover of each is a set of
    stretches, and the gaps between them are the outline. Work grows with the
    pairs of edges within two radii.
    """
    scratch = Scratch(edges.sparkSession, "outline")
    e = scratch.cut(edges.select("x1", "y1", "x2", "y2").where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").distinct(), "edges")
    cols = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    ends = e.select("x1", "y1").union(e.select("x2", "y2")).distinct().toDF("cx", "cy")
    circles = ends.select(F.struct("cx", "cy", F.lit(2 * math.pi).alias("whole")).alias("piece"), "cx", "cy", *[F.col(c).alias(p) for c, p in (("cx", "px1"), ("cy", "py1"), ("cx", "px2"), ("cy", "py2"))])
    arcs = _covered_circle(_meeting(circles, e, 2 * radius), radius)
    arcs = arcs.unionByName(arcs.select("piece", F.lit(0.0).alias("s"), (F.col("e") - 2 * math.pi).alias("e")))  # what runs over the zero angle
    point = lambda t: (F.col("piece.cx") + radius * F.cos(t), F.col("piece.cy") + radius * F.sin(t))
    a, b = point("s"), point("e")
    round_ = _uncovered(circles, arcs).select(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"), F.col("piece.cx").alias("cx"), F.col("piece.cy").alias("cy"), F.col("s").alias("t0"), F.col("e").alias("t1"))

    length = F.sqrt((cols[2] - cols[0]) * (cols[2] - cols[0]) + (cols[3] - cols[1]) * (cols[3] - cols[1]))
    sides = e.withColumn("whole", length).where("whole > 0").withColumn("ux", (cols[2] - cols[0]) / F.col("whole")).withColumn("uy", (cols[3] - cols[1]) / F.col("whole"))
    sides = sides.withColumn("to", F.explode(F.array(F.lit(radius), F.lit(-radius)))).select(
        F.struct((cols[0] - F.col("uy") * F.col("to")).alias("x"), (cols[1] + F.col("ux") * F.col("to")).alias("y"), "ux", "uy", "whole").alias("piece"), *[c.alias("p" + n) for c, n in zip(cols, ("x1", "y1", "x2", "y2"), strict=True)]
    )
    at = [F.col(f"piece.{c}") for c in ("x", "y", "ux", "uy")]
    lines = _meeting(sides, e, 2 * radius).select("piece", _covered_line(*at, cols, radius * (1 - 1e-9)).alias("span")).where("span.s IS NOT NULL").select("piece", "span.s", "span.e")
    end = lambda t: (at[0] + F.col(t) * at[2], at[1] + F.col(t) * at[3])
    a, b = end("s"), end("e")
    none = F.lit(None).cast("double")
    straight = _uncovered(sides, lines).select(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"), none.alias("cx"), none.alias("cy"), none.alias("t0"), none.alias("t1"))
    return scratch.cut(straight.unionByName(round_), "outline")


def _arc_distance(a: list[Column], radius: float) -> Column:
    """From a segment to an arc (cx, cy, t0, t1 and its ends): 0 where they meet."""
    x1, y1, x2, y2 = a
    cx, cy, t0, t1 = [F.col(c) for c in ("cx", "cy", "t0", "t1")]
    faces = lambda x, y: F.pmod(F.atan2(y - cy, x - cx) - t0, F.lit(2 * math.pi)) <= t1 - t0
    off = lambda x, y: F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - radius
    dx, dy = x2 - x1, y2 - y1
    q, b, c = F.nullif(dx * dx + dy * dy, F.lit(0.0)), (x1 - cx) * dx + (y1 - cy) * dy, (x1 - cx) * (x1 - cx) + (y1 - cy) * (y1 - cy) - radius * radius
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - q * c))
    meets = lambda t: (t >= 0) & (t <= 1) & faces(x1 + t * dx, y1 + t * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -b / q))  # nearest to the centre
    nearest = F.when(q.isNotNull(), F.struct((x1 + t * dx).alias("x"), (y1 + t * dy).alias("y"))).otherwise(F.struct(x1.alias("x"), y1.alias("y")))
    own = [F.when(faces(x, y), F.abs(off(x, y))) for x, y in ((x1, y1), (x2, y2), (nearest["x"], nearest["y"]))]
    ends = [segment_distance(F.col(x), F.col(y), *a) for x, y in (("x1", "y1"), ("x2", "y2"))]
    return F.when((b * b - q * c >= 0) & (meets((-b - root) / q) | meets((-b + root) / q)), 0.0).otherwise(F.least(*own, *ends))


def nearest_outline(shapes: DataFrame, outline: DataFrame, radius: float) -> DataFrame:
    """(id, distance) of each shape (id and its edges, a point is an edge of no length) to the nearest piece of an outline of the radius.

    The search doubles its reach until every shape has met a piece.
    """
    scratch = Scratch(shapes.sparkSession, "bank")
    names = ("x1", "y1", "x2", "y2")
    left = scratch.cut(shapes.select("id", *[F.col(c).alias("p" + c) for c in names]), "left")
    own, reach, found = [F.col("p" + c) for c in names], radius, None
    # the box of a piece: an arc is looked for in all of its circle's
    box = [F.when(F.col("cx").isNull(), F.col(n)).otherwise(F.col("c" + n[0]) + (radius if n[1] == "2" else -radius)) for n in names]
    boxed = outline.select(F.struct(*outline.columns).alias("o"), *[b.alias(n) for b, n in zip(box, names, strict=True)])
    if outline.isEmpty():
        return left.select("id", F.lit(None).cast("double").alias("distance")).distinct()
    while True:
        near = _meeting(left, boxed, reach).select("id", *["p" + c for c in names], "o.*")
        d = F.when(F.col("cx").isNull(), segments_distance(own, [F.col(c) for c in names])).otherwise(_arc_distance(own, radius))
        met = scratch.cut(near.withColumn("d", d).where(F.col("d") <= reach).groupBy("id").agg(F.min("d").alias("distance")), "met")
        found = met if found is None else found.unionByName(met)
        left = scratch.cut(left.join(met, "id", "left_anti"), "left")
        if left.isEmpty():
            return found
        reach *= 2


def exposure_corridor(path: DataFrame, rivers: DataFrame, assets: DataFrame, *, buffer_m: float = 125.0, reach_m: float = 500.0, widest_m: float = 200.0, own_bank: bool = False) -> DataFrame:
    """HY-09: assets whose tolerance meets the corridor, with the distance to its edge, nearest first.

    Rivers (river and its edges) within ``reach_m`` of the flow path are the
    corridor with ``buffer_m`` on either side, or the path itself where there
    is no such river. Assets are points (id, x, y, tolerance_m), or shapes
    with a row for each edge (id, x1, y1, x2, y2, filled, tolerance_m); what
    lies inside a filled one belongs to it. The distance is that to the
    outline of the whole corridor, 0 where an asset crosses it. ``inside``
    says that some part is in the corridor. ``widest_m`` bounds the tolerances.
    Edges at one place, of rivers, of the path and of assets, are searched for
    once, so pairs grow with the different ones.
    With ``own_bank`` the assets are points and the distance is that to the bank
    of the nearest edge, also where another river's corridor lies over it; then
    no outline is built.
    """
    if own_bank and "x" not in assets.columns:
        raise ValueError("own_bank takes points")
    names = ("x1", "y1", "x2", "y2")
    own, way = [F.col(c) for c in names], [F.col(f"p{c}") for c in names]
    as_pieces = lambda df, *keep: df.select(*keep, *[F.col(c).alias("p" + c) for c in names])
    scratch = Scratch(path.sparkSession, "corridor")
    beside = _meeting(as_pieces(path.select(*names).distinct()), rivers.select(*names).distinct(), reach_m).where(segments_distance(own, way) <= reach_m).select(*names).distinct()
    reached = scratch.cut(rivers.join(beside.hint("merge"), list(names), "left_semi").select("river").distinct(), "reached")
    edges = scratch.cut((path if reached.isEmpty() else rivers.join(reached.hint("merge"), "river", "left_semi")).select(*names).distinct(), "edges")
    if "x" in assets.columns:
        assets = assets.selectExpr("id", "tolerance_m", "x AS x1", "y AS y1", "x AS x2", "y AS y2", "false AS filled")
    filled = assets.where("filled").select(F.col("id").alias("poly"), *names)
    holds = lambda points: polygon_parity(points, filled, buffer_m + widest_m).select(F.col("poly").alias("id")).distinct()
    number = F.struct(*names).alias("id")

    near = _meeting(as_pieces(assets.select(*names).distinct()), edges, buffer_m + widest_m).groupBy(*way).agg(F.min(segments_distance(own, way)).alias("d"))
    near = assets.join(near.select(*[w.alias(c) for w, c in zip(way, names, strict=True)], "d").hint("merge"), list(names)).select("id", "tolerance_m", "d")
    if not own_bank:
        around = holds(edges.select(number, F.col("x1").alias("x"), F.col("y1").alias("y"))).join(assets.select("id", "tolerance_m").distinct(), "id").withColumn("d", F.lit(0.0))
        near = near.unionByName(around)
    met = near.groupBy("id", "tolerance_m").agg(F.min("d").alias("d")).where(F.col("d") <= buffer_m + F.col("tolerance_m"))
    if own_bank:
        return met.select("id", "tolerance_m", F.round(F.abs(F.col("d") - buffer_m), 1).alias("distance_m"), (F.col("d") <= buffer_m).alias("inside")).orderBy("distance_m", "id")
    met = scratch.cut(met, "met")
    outline = corridor_outline(edges, buffer_m)
    far = nearest_outline(assets.join(met, "id", "left_semi"), outline, buffer_m)
    crossed = holds(outline.select(number, F.col("x1").alias("x"), F.col("y1").alias("y"))).withColumn("_crossed", F.lit(True))
    distance = F.when(F.col("_crossed"), 0.0).otherwise(F.col("distance"))
    out = met.join(far, "id").join(crossed, "id", "left")
    return out.select("id", "tolerance_m", F.round(distance, 1).alias("distance_m"), (F.col("d") <= buffer_m).alias("inside")).orderBy("distance_m", "id")
