"""Outlines of the regions of a mask as ordered rings, and their simplification.

A cell (r, c) covers the square from (c, r) to (c + 1, r + 1), x to the right
and y down. Rings run with their region on the right, so outer ones have a
positive area and holes a negative one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.grid import label_components, largest_region
from tarnwatch.scratch import Scratch

#: Sides of a cell in the order in which a ring turns right around it: the cell beyond the side, its neighbour ahead
#: and the one diagonally ahead (as row and column steps), and the corner where the side begins (as x and y steps).
_SIDES = ((("n", -1, 0), ("e", 0, 1), ("ne", -1, 1), (0, 0)), (("e", 0, 1), ("s", 1, 0), ("se", 1, 1), (1, 0)), (("s", 1, 0), ("w", 0, -1), ("sw", 1, -1), (1, 1)), (("w", 0, -1), ("n", -1, 0), ("nw", -1, -1), (0, 1)))


def _around(mask: DataFrame) -> DataFrame:
    """Adds which neighbours are true, each by way of a true neighbour: ne and sw by the row, se and nw by the column."""
    down, along = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")
    seen = lambda f, axis, step, w, v: F.when(f(axis).over(w) == F.col(axis) + step, f(v).over(w))
    out = mask.select("r", "c", F.lit(True).alias("on"))
    out = out.withColumns({"n": seen(F.lag, "r", -1, down, "on"), "s": seen(F.lead, "r", 1, down, "on")})
    out = out.withColumns({"e": seen(F.lead, "c", 1, along, "on"), "w": seen(F.lag, "c", -1, along, "on"), "ne": seen(F.lead, "c", 1, along, "n"), "sw": seen(F.lag, "c", -1, along, "s")})
    return out.withColumns({"se": seen(F.lead, "r", 1, down, "e"), "nw": seen(F.lag, "r", -1, down, "w")})


def _sides(mask: DataFrame, width: int) -> DataFrame:
    """(side, next, x, y, turns) of all sides of cells with nothing beyond them.

    Which side comes next is known from the eight neighbours: that of the same
    cell where the neighbour ahead is missing, that of the cell ahead, or that
    of the cell diagonally ahead. So regions that touch at a corner stay apart.
    """
    n = _around(mask)
    found = []
    for k, ((beyond, _, _), (ahead, ar, ac), (diagonal, dr, dc), (bx, by)) in enumerate(_SIDES):
        number = lambda r, c, s: (r * width + c) * 4 + s
        r, c = F.col("r").cast("long"), F.col("c").cast("long")
        following = F.when(F.col(ahead).isNull(), number(r, c, (k + 1) % 4)).when(F.col(diagonal).isNull(), number(r + ar, c + ac, k)).otherwise(number(r + dr, c + dc, (k + 3) % 4))
        found.append(F.when(F.col(beyond).isNull(), F.struct(number(r, c, k).alias("side"), following.alias("next"), (c + bx).alias("x"), (r + by).alias("y"))))
    sides = n.select(F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s")).select("s.*")
    # straight on means the same kind of side
    return sides.withColumn("turns", F.col("side") % 4 != F.col("next") % 4)


def _corners(sides: DataFrame, scratch: Scratch) -> DataFrame:
    """(corner, next, x, y, sides): only sides that follow a turn, each with the number of sides up to the next turn.

    Sides of one kind on one line that follow each other are a run, found by a
    window over the line, so chaining works on corners and not on all sides.
    """
    kind = F.col("side") % 4
    # along its way: x rises on north sides and falls on south sides, y rises on east sides and falls on west sides
    line = F.when(kind % 2 == 0, F.col("y")).otherwise(F.col("x"))
    place = F.when(kind == 0, F.col("x")).when(kind == 1, F.col("y")).when(kind == 2, -F.col("x")).otherwise(-F.col("y"))
    along = Window.partitionBy("_kind", "_line").orderBy("_place")
    before = sides.withColumns({"_kind": kind, "_line": line, "_place": place})
    goes_on = (F.lag("next").over(along) == F.col("side")) & ~F.lag("turns").over(along)
    runs = before.withColumn("_head", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("side")))
    runs = runs.withColumn("_head", F.last("_head", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct("x", "y"), "_place")
    corners = runs.groupBy("_kind", "_line", F.col("_head").alias("corner")).agg(first.alias("at"), F.max_by("next", "_place").alias("next"), F.count(F.lit(1)).alias("sides"))
    return scratch.cut(corners.select("corner", "next", "at.x", "at.y", "sides"), "corners")


def ring_corners(mask: DataFrame, width: int) -> DataFrame:
    """All rings of a mask of true cells (r, c): (ring, seq, x, y), the corners of each in order.

    A ring's number is the smallest of its corners' and its first corner is
    that one. Corners are chained by pointer doubling: after k rounds a corner
    knows the smallest number among its 2^k successors, and once the smallest
    is known, the way to it; rounds grow with the logarithm of the longest
    ring. Each round is written, so a lost executor costs a part of one.
    """
    scratch = Scratch(mask.sparkSession, "outline")
    corners = _corners(_sides(mask, width), scratch)
    state = scratch.cut(corners.select("corner", "next", F.least("corner", "next").alias("least")), "state")
    before = None
    while True:
        ahead = state.select(F.col("corner").alias("next"), F.col("next").alias("jump"), F.col("least").alias("l"))
        moved = state.join(ahead, "next").select("corner", F.col("jump").alias("next"), F.least("least", "l").alias("least"))
        state, now = scratch.replace(moved, "state", F.sum(F.col("least").cast("decimal(38,0)")), F.count(F.lit(1)))
        if now == before:
            break
        before = now
    rings = scratch.cut(state.select("corner", F.col("least").alias("ring")), "rings")
    # ways to the ring's first corner, which is an end now
    way = corners.join(rings, "corner").select("corner", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("way"))
    way = scratch.cut(way, "way")
    while not way.where("next IS NOT NULL").isEmpty():
        ahead = way.select(F.col("corner").alias("next"), F.col("next").alias("jump"), F.col("way").alias("more"))
        moved = way.join(ahead, "next", "left").select("corner", "ring", F.col("jump").alias("next"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way"))
        way, _ = scratch.replace(moved, "way")
    # the first corner's own way is the whole ring
    length = way.where("corner = ring").select("ring", F.col("way").alias("whole"))
    placed = way.join(length, "ring").select("corner", "ring", (F.col("whole") - F.col("way")).alias("seq"))
    return corners.join(placed, "corner").select("ring", "seq", "x", "y")


def ring_measures(rings: DataFrame) -> DataFrame:
    """(ring, corners, area, length): signed area in cells, positive for outer rings, and length in sides.

    The corner after a ring's last is its first: the one with the ring's smallest place.
    """
    following = rings.select("ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    last = rings.groupBy("ring").agg(F.max("seq").alias("seq"), F.min_by(F.struct("x", "y"), "seq").alias("o"))
    following = following.where("seq >= 0").unionByName(last.select("ring", "seq", F.col("o.x").alias("nx"), F.col("o.y").alias("ny")))
    e = rings.join(following, ["ring", "seq"])
    area, length = F.col("x") * F.col("ny") - F.col("nx") * F.col("y"), F.abs(F.col("x") - F.col("nx")) + F.abs(F.col("y") - F.col("ny"))
    return e.groupBy("ring").agg(F.count(F.lit(1)).alias("corners"), (F.sum(area) / 2).alias("area"), F.sum(length).alias("length"))


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """(ring, seq, x, y) of the corners that stay: no dropped corner is farther than the tolerance from the line between its kept neighbours.

    The first corner of a ring and the one farthest from it stay; then each
    stretch between kept corners keeps its farthest one while that is beyond
    the tolerance, all stretches of all rings at once (ties: the first). Rounds
    follow the depth of the halving, not the length of a ring.
    """
    scratch = Scratch(rings.sparkSession, "simplify")
    squared = lambda dx, dy: dx * dx + dy * dy
    start = rings.groupBy("ring").agg(F.min(F.struct("seq", "x", "y")).alias("a"), F.max("seq").alias("last"))
    state = rings.join(start, "ring").withColumn("d", squared(F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")))
    far = state.groupBy("ring").agg(F.max(F.struct("d", (-F.col("seq")).alias("s"), F.struct("seq", "x", "y").alias("p"))).alias("f"))
    end = F.struct((F.col("last") + 1).alias("seq"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    state = state.join(far.select("ring", F.col("f.p").alias("m")), "ring")
    first_half = F.col("seq") <= F.col("m.seq")
    state = state.select("ring", "seq", "x", "y", F.when(first_half, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(first_half, F.col("m")).otherwise(end).alias("b"), ((F.col("seq") == F.col("a.seq")) | (F.col("seq") == F.col("m.seq"))).alias("kept"))
    state = scratch.cut(state, "state")
    while True:
        ax, ay, bx, by = (F.col(c).cast("double") for c in ("a.x", "a.y", "b.x", "b.y"))
        dx, dy = bx - ax, by - ay
        length = squared(dx, dy)
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - ax) * dx + (F.col("y") - ay) * dy) / length))).otherwise(0.0)
        off = F.sqrt(squared(ax + t * dx - F.col("x"), ay + t * dy - F.col("y")))
        stretches = state.where("NOT kept").groupBy("ring", F.col("a.seq").alias("from")).agg(F.max(F.struct(off.alias("d"), (-F.col("seq")).alias("s"), F.struct("seq", "x", "y").alias("p"))).alias("f"))
        cuts = scratch.cut(stretches.where(F.col("f.d") > tolerance).select("ring", "from", F.col("f.p").alias("m")), "cuts")
        if cuts.isEmpty():
            return state.where("kept").select("ring", "seq", "x", "y")
        met = state.withColumn("from", F.col("a.seq")).join(cuts, ["ring", "from"], "left")
        cut, before = F.col("m").isNotNull(), F.col("seq") < F.col("m.seq")
        state, _ = scratch.replace(
            met.select("ring", "seq", "x", "y", F.when(cut & ~before, F.col("m")).otherwise(F.col("a")).alias("a"), F.when(cut & before, F.col("m")).otherwise(F.col("b")).alias("b"), (F.col("kept") | F.coalesce(F.col("seq") == F.col("m.seq"), F.lit(False))).alias("kept")),
            "state",
        )


def change_polygon(mask: DataFrame, width: int, *, x0: float = 0.0, y0: float = 0.0, step: float = 1.0, tolerance: float | None = None) -> DataFrame:
    """GR-25: the outline of the largest four-connected region, holes left out: (seq, x, y), open, from its upper left corner.

    ``x0, y0`` are the upper left corner of the grid and ``step`` the width of
    a cell; rows go down. Of equally large regions that with the smaller label
    counts. A tolerance, in the units of ``step``, simplifies the outline. No
    row where no cell is true.
    """
    labels = Scratch(mask.sparkSession, "outline").cut(label_components(mask, width), "labels")
    region = labels.join(F.broadcast(largest_region(labels).select("label")), "label", "left_semi")  # one row
    rings = ring_corners(region.select("r", "c"), width)
    outer = ring_measures(rings).where("area > 0").select("ring")  # a region has one outer ring
    kept = rings.join(outer, "ring", "left_semi")
    if tolerance is not None:
        kept = simplified(kept, tolerance / step)
    order = Window.partitionBy("ring").orderBy("seq")
    return kept.select((F.row_number().over(order) - 1).alias("seq"), (x0 + F.col("x") * step).alias("x"), (y0 - F.col("y") * step).alias("y"))
