"""Routes, crossings, overlaps and range queries over points, boxes and segments.

Theta joins become equi-joins on grid cells; a pair that shares several cells is kept only in the
cell of its owner, the lowest corner of the common part, so nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8
SAMPLES = 24


def bezier(p: list[Column], t: Column) -> Column:
    u = 1 - t
    return u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3]


def route_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The length of the curve from one box to another, as 24 straight pieces.

    The curve leaves and enters vertically, its handles half the drop long.
    """
    mid = (y1 + y2) / 2
    xs, ys = [x1, x1, x2, x2], [y1, mid, mid, y2]
    step = lambda k: k.cast("double") / SAMPLES
    piece = lambda k: F.hypot(bezier(xs, step(k)) - bezier(xs, step(k - 1)), bezier(ys, step(k)) - bezier(ys, step(k - 1)))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(SAMPLES)), piece), F.lit(0.0), lambda a, b: a + b)


def cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    """The grid cells that a box touches, as an array of (cx, cy)."""
    at = lambda c: F.floor(c / size).cast("int")
    return F.flatten(F.transform(F.sequence(at(low_x), at(high_x)), lambda i: F.transform(F.sequence(at(low_y), at(high_y)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def _cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_crossings(segments: DataFrame, size: float = 512.0) -> DataFrame:
    """(a, b), a < b: segments (id, group, x1, y1, x2, y2) of different groups that cross in their insides."""
    s = segments.select("id", "group", "x1", "y1", "x2", "y2", *[f(*[F.col(c) for c in cs]).alias(n) for n, f, cs in (("lx", F.least, ("x1", "x2")), ("hx", F.greatest, ("x1", "x2")), ("ly", F.least, ("y1", "y2")), ("hy", F.greatest, ("y1", "y2")))])
    g = s.select("*", F.explode(cells(F.col("lx"), F.col("ly"), F.col("hx"), F.col("hy"), size)).alias("cell")).select("*", "cell.cx", "cell.cy").drop("cell")
    a, b = g.alias("a"), g.alias("b")
    c = lambda t, n: F.col(f"{t}.{n}")
    boxes = (c("a", "lx") <= c("b", "hx")) & (c("b", "lx") <= c("a", "hx")) & (c("a", "ly") <= c("b", "hy")) & (c("b", "ly") <= c("a", "hy"))
    owner = (F.floor(F.greatest(c("a", "lx"), c("b", "lx")) / size) == c("a", "cx")) & (F.floor(F.greatest(c("a", "ly"), c("b", "ly")) / size) == c("a", "cy"))
    ends = lambda t: (c(t, "x1"), c(t, "y1"), c(t, "x2"), c(t, "y2"))
    ax1, ay1, ax2, ay2 = ends("a")
    bx1, by1, bx2, by2 = ends("b")
    d1, d2 = _cross(ax1, ay1, ax2, ay2, bx1, by1), _cross(ax1, ay1, ax2, ay2, bx2, by2)
    d3, d4 = _cross(bx1, by1, bx2, by2, ax1, ay1), _cross(bx1, by1, bx2, by2, ax2, ay2)
    inside = (d1 * d2 < -EPSILON) & (d3 * d4 < -EPSILON)
    on = (c("a", "cx") == c("b", "cx")) & (c("a", "cy") == c("b", "cy")) & (c("a", "id") < c("b", "id")) & (c("a", "group") != c("b", "group"))
    return a.join(b, on).where(boxes & owner & inside).select(c("a", "id").alias("a"), c("b", "id").alias("b"))


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, lx: Column, ly: Column, hx: Column, hy: Column) -> Column:
    """Whether a segment meets a closed box, by its parameters of entry and leave."""
    enter, leave, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for start, d, low, high in ((x1, x2 - x1, lx, hx), (y1, y2 - y1, ly, hy)):
        flat = F.abs(d) < EPSILON
        t1, t2 = (low - start) / F.nullif(d, F.lit(0.0)), (high - start) / F.nullif(d, F.lit(0.0))
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(t1, t2)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t1, t2)))
        ok = ok & F.when(flat, (start >= low) & (start <= high)).otherwise(F.lit(True))
    return ok & (enter <= leave)


def edge_box_hits(segments: DataFrame, boxes: DataFrame, width: float, height: float, size: float = 512.0) -> DataFrame:
    """(segment, box): segments (id, from, to, x1, y1, x2, y2) that run through a box (id, x, y, centred) of another node."""
    s = segments.select("*", F.least("x1", "x2").alias("lx"), F.greatest("x1", "x2").alias("hx"), F.least("y1", "y2").alias("ly"), F.greatest("y1", "y2").alias("hy"))
    s = s.select("*", F.explode(cells(F.col("lx"), F.col("ly"), F.col("hx"), F.col("hy"), size)).alias("cell"))
    b = boxes.select(F.col("id").alias("box"), (F.col("x") - width / 2).alias("bl"), (F.col("x") + width / 2).alias("bh"), (F.col("y") - height / 2).alias("bb"), (F.col("y") + height / 2).alias("bt"))
    b = b.select("*", F.explode(cells(F.col("bl"), F.col("bb"), F.col("bh"), F.col("bt"), size)).alias("cell"))
    j = s.join(b, "cell").where((F.col("box") != F.col("from")) & (F.col("box") != F.col("to")))
    owner = (F.floor(F.greatest("lx", "bl") / size) == F.col("cell.cx")) & (F.floor(F.greatest("ly", "bb") / size) == F.col("cell.cy"))
    meets = (F.col("lx") <= F.col("bh")) & (F.col("bl") <= F.col("hx")) & (F.col("ly") <= F.col("bt")) & (F.col("bb") <= F.col("hy"))
    hit = clipped(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "bl", "bb", "bh", "bt")])
    return j.where(meets & owner & hit).select(F.col("id").alias("segment"), "box")


def overlaps(nodes: DataFrame, width: float = 176.0, height: float = 74.0) -> DataFrame:
    """(a, b), a < b: nodes (id, row, x, y) of one row that lie closer than a box in both directions.

    x is cut into cells of one width; a pair is at most one cell apart.
    """
    a = nodes.select(F.col("id").alias("a"), "row", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*[F.floor(F.col("x") / width) + k for k in (-1, 0, 1)])).alias("cell"))
    b = nodes.select(F.col("id").alias("b"), "row", F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / width).alias("cell"))
    return a.join(b, ["row", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) < width) & (F.abs(F.col("ay") - F.col("by")) < height)).select("a", "b")


def viewport(points: DataFrame, low_x: float, low_y: float, high_x: float, high_y: float) -> DataFrame:
    """Points within a closed rectangle, by plain range predicates that reach the scan."""
    return points.where(F.col("x").between(low_x, high_x) & F.col("y").between(low_y, high_y))


def nearest(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The one point within radius that is nearest to (x, y), the smaller id at a tie; no row if there is none."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    box = points.where(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius))
    return box.withColumn("distance", d).where(F.col("distance") < radius).agg(F.min_by(F.struct("id", "distance"), F.struct("distance", "id")).alias("p")).where("p is not null").select("p.*")


def nearest_k(points: DataFrame, x: float, y: float, k: int = 180) -> DataFrame:
    """The k points nearest to (x, y)."""
    return points.withColumn("distance", F.hypot(F.col("x") - x, F.col("y") - y)).orderBy("distance", "id").limit(k)
