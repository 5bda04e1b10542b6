"""Geometry over arrays of points (struct x, y) and over point rows: clips, areas, distances, rings,
resampling by arc length, smoothing and hulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.scalars import clamp

from . import polylines


def _next(ring: Column) -> Column:
    """The ring's points moved on by one, the first at the end."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Signed area, counter-clockwise positive; the closing edge is implied."""
    cross = F.zip_with(ring, _next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2


def trapezoid_area(ring: Column) -> Column:
    """Twice the area without a sign, as a sum of trapezoids."""
    return F.abs(F.aggregate(F.zip_with(ring, _next(ring), lambda a, b: (b["x"] - a["x"]) * (b["y"] + a["y"])), F.lit(0.0), lambda s, c: s + c))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule by a ray to the right."""
    crossed = F.zip_with(ring, _next(ring), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1e-12)).otherwise(b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, clamp(((px - ax) * dx + (py - ay) * dy) / size, 0.0, 1.0)).otherwise(0.0)
    ex, ey = px - (ax + dx * t), py - (ay + dy * t)
    return ex * ex + ey * ey


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    return F.sqrt(F.array_min(F.zip_with(ring, _next(ring), lambda a, b: segment_distance2(px, py, a["x"], a["y"], b["x"], b["y"]))))


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """struct(t0, t1): the part of a segment inside a box by its two parameters, null if none is."""
    dx, dy = bx - ax, by - ay

    def bound(p: Column, q: Column) -> tuple[Column, Column]:
        """Lower and upper limit of t from p * t <= q."""
        r = q / F.when(p == 0, F.lit(None)).otherwise(p)
        low = F.when(p < 0, r).when((p == 0) & (q < 0), F.lit(2.0)).otherwise(F.lit(0.0))
        return low, F.when(p > 0, r).otherwise(F.lit(1.0))

    pairs = [bound(-dx, ax - x0), bound(dx, x1 - ax), bound(-dy, ay - y0), bound(dy, y1 - ay)]
    t0 = F.greatest(F.lit(0.0), *[lo for lo, _ in pairs])
    t1 = F.least(F.lit(1.0), *[hi for _, hi in pairs])
    return F.when(t0 <= t1, F.struct(t0.alias("t0"), t1.alias("t1")))


def clip_lines(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Pieces of lines (line, idx, x, y) inside a box: line, piece, seg, ax, ay, bx, by by segment."""
    w = Window.partitionBy("line").orderBy("idx")
    s = points.select("line", F.col("idx").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    s = s.withColumn("c", clip_segment(*[F.col(c) for c in ("ax", "ay", "bx", "by")], x0, y0, x1, y1)).where("c is not null")
    before = Window.partitionBy("line").orderBy("seg")
    # a piece goes on where the segment before it ends whole and this one starts whole
    joined = (F.lag("seg").over(before) == F.col("seg") - 1) & (F.lag("c.t1").over(before) == 1.0) & (F.col("c.t0") == 0.0)
    s = s.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    at = lambda p, q, t: F.col(p) + (F.col(q) - F.col(p)) * F.col(f"c.{t}")
    return s.select("line", (F.sum("new").over(before) - 1).cast("int").alias("piece"), "seg", at("ax", "bx", "t0").alias("ax"), at("ay", "by", "t0").alias("ay"), at("ax", "bx", "t1").alias("bx"), at("ay", "by", "t1").alias("by"))


def clip_ring(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A ring cut to a box, one side after another (Sutherland-Hodgman)."""
    for axis, limit, above in (("y", y1, False), ("y", y0, True), ("x", x1, False), ("x", x0, True)):
        ring = _clip_side(ring, axis, limit, above)
    return ring


def _clip_side(ring: Column, axis: str, limit: float, above: bool) -> Column:
    inside = lambda p: p[axis] >= limit if above else p[axis] <= limit

    def cut(a: Column, b: Column) -> Column:
        t = (F.lit(limit) - a[axis]) / (b[axis] - a[axis])
        return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))

    def edge(a: Column, b: Column) -> Column:
        crossing = F.when(inside(a) != inside(b), F.array(cut(a, b))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        own = F.when(inside(b), F.array(F.struct(b["x"].alias("x"), b["y"].alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.concat(crossing, own)

    return F.flatten(F.zip_with(ring, _next(ring), edge))


def with_arc(points: DataFrame) -> DataFrame:
    """points (line, idx, x, y) with `arc`, the length from the line's start."""
    w = Window.partitionBy("line").orderBy("idx")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("step").over(w)).drop("step")


def resample(points: DataFrame, spacing: float) -> DataFrame:
    """line, n, x, y: lines at equal steps, at least two, of about `spacing`; an as-of join on arc length
    done as windows over segments."""
    w = Window.partitionBy("line").orderBy("idx")
    a = with_arc(points)
    total = F.max("arc").over(Window.partitionBy("line"))
    s = a.select("line", "idx", "x", "y", "arc", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"), F.lead("arc").over(w).alias("b"), total.alias("total")).where("b is not null and b > arc")
    s = s.withColumn("k", F.greatest(F.lit(2), F.floor(F.col("total") / spacing + 0.5)).cast("int")).withColumn("d", F.col("total") / F.col("k"))
    # steps n with arc <= n * d < b belong to the segment; the last segment also takes the end
    first, end = F.ceil(F.col("arc") / F.col("d") - 1e-9), F.ceil(F.col("b") / F.col("d") - 1e-9) - 1
    s = s.withColumn("n0", first.cast("int")).withColumn("n1", F.when(F.col("b") >= F.col("total"), F.col("k")).otherwise(end).cast("int")).where("n1 >= n0")
    s = s.withColumn("n", F.explode(F.sequence("n0", "n1")))
    t = clamp((F.col("n") * F.col("d") - F.col("arc")) / (F.col("b") - F.col("arc")), 0.0, 1.0)
    return s.select("line", "n", (F.col("x") + (F.col("bx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("by") - F.col("y")) * t).alias("y"))


def chaikin(points: DataFrame) -> DataFrame:
    """One round of corner cutting at a quarter and three quarters; ends stay."""
    w = Window.partitionBy("line").orderBy("idx")
    s = points.select("line", "idx", "x", "y", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"), F.lag("x").over(w).isNull().alias("head"), F.lead("x", 2).over(w).isNull().alias("tail"))
    s = s.where("bx is not null")
    at = lambda t: F.struct((F.col("x") + (F.col("bx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("by") - F.col("y")) * t).alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    made = F.concat(F.when(F.col("head"), F.array(at(0.0))).otherwise(none), F.array(at(0.25), at(0.75)), F.when(F.col("tail"), F.array(at(1.0))).otherwise(none))
    s = s.select("line", "idx", F.posexplode(made).alias("p", "q"))
    return s.select("line", (F.row_number().over(Window.partitionBy("line").orderBy("idx", "p")) - 1).alias("idx"), "q.x", "q.y")


def offset_lines(points: DataFrame, distance: float) -> DataFrame:
    """Lines moved to the left by a distance, along the normal of each point's neighbours."""
    w = Window.partitionBy("line").orderBy("idx")
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    s = points.withColumn("dx", dx).withColumn("dy", dy).withColumn("n", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    move = lambda c, d: (F.col(c) + F.when(F.col("n") > 0, d / F.col("n") * distance).otherwise(0.0)).alias(c)
    return s.select("line", "idx", move("x", -F.col("dy")), move("y", F.col("dx")))


def moving_average(points: DataFrame, col: str) -> DataFrame:
    """Mean of three points; a line's ends stay."""
    w = Window.partitionBy("line").orderBy("idx")
    end = F.lag(col).over(w).isNull() | F.lead(col).over(w).isNull()
    return points.withColumn(col, F.when(end, F.col(col)).otherwise((F.lag(col).over(w) + F.col(col) + F.lead(col).over(w)) / 3))


def chunked(points: DataFrame, most: int) -> DataFrame:
    """Lines in pieces of at most `most` points that share an end: line, piece, idx, x, y."""
    step = most - 1
    last = F.max("idx").over(Window.partitionBy("line"))
    own = F.floor(F.col("idx") / step).cast("int")
    shared = (F.col("idx") % step == 0) & (F.col("idx") > 0)
    pieces = F.when(shared & (F.col("idx") == last), F.array(own - 1)).when(shared, F.array(own - 1, own)).otherwise(F.array(own))
    return points.withColumn("_pieces", pieces).withColumn("piece", F.explode("_pieces")).select("line", "piece", "idx", "x", "y")


def decimated(points: DataFrame, least: float) -> DataFrame:
    """Points kept in turn if `least` away from the last kept one; both ends always.  A fold over each
    line's array of points."""
    p = points.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    far = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) >= least * least
    kept = F.aggregate("p", F.slice("p", 1, 1), lambda k, q: F.when((q["idx"] > F.element_at(k, 1)["idx"]) & (far(q, F.element_at(k, -1)) | (q["idx"] == F.element_at("p", -1)["idx"])), F.concat(k, F.array(q))).otherwise(k))
    return p.select("line", F.explode(kept).alias("q")).select("line", "q.idx", "q.x", "q.y")


def _per_line(points: DataFrame, f: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """line, idx, x, y of the points that f keeps of each line, in its order: f(x, y, n) takes the points of many lines, n of each in turn, and gives
    positions of points and how many each line has.  Lines travel to Python many at a time, as arrays; one line has to fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p")
            flat = p.flatten()
            x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
            at, n = f(x, y, p.value_lengths().to_numpy())
            line = batch.column("line").take(pa.array(np.repeat(np.arange(len(n)), n)))
            idx = np.arange(len(at)) - np.repeat(polylines.starts_of(n), n)
            yield pa.RecordBatch.from_arrays([line, pa.array(idx, pa.int32()), pa.array(x[at]), pa.array(y[at])], names=["line", "idx", "x", "y"])

    whole = points.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    return whole.mapInArrow(run, f"line {dict(points.dtypes)['line']}, idx int, x double, y double")


def simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker: ends and the points farthest from chords, until none is beyond the tolerance."""
    return _per_line(points, lambda x, y, n: polylines.simplified(x, y, n, tolerance))


def hull(points: DataFrame) -> DataFrame:
    """Convex hull of each line's points, counter-clockwise from the leftmost (Andrew's chains)."""
    return _per_line(points, lambda x, y, n: polylines.hulls(x, y, n))


def rasterized_segments(segs: DataFrame, size: int) -> DataFrame:
    """px, py, mat of pixels within `half` of segments (ord, mat, half, ax, ay, bx, by); the one with
    the greatest ord wins a pixel.  Segments are walked row by row: in each only the pixels beside the part of the
    segment that is within `half` rows are looked at."""
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), v)).cast("int")
    y0, y1 = F.floor(F.least("ay", "by") - F.col("half")), F.ceil(F.greatest("ay", "by") + F.col("half"))
    rows = segs.where((y1 >= 0) & (y0 <= size - 1)).withColumn("py", F.explode(F.sequence(clip(y0), clip(y1))))
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    t0, t1 = (F.col("py") - F.col("half") - F.col("ay")) / F.nullif(dy, F.lit(0)), (F.col("py") + F.col("half") - F.col("ay")) / F.nullif(dy, F.lit(0))
    rows = rows.withColumn("t0", F.greatest(F.lit(0.0), F.coalesce(F.least(t0, t1), F.lit(0.0)))).withColumn("t1", F.least(F.lit(1.0), F.coalesce(F.greatest(t0, t1), F.lit(1.0)))).where("t0 <= t1")
    a, b = F.col("ax") + F.col("t0") * dx, F.col("ax") + F.col("t1") * dx
    x0, x1 = F.floor(F.least(a, b) - F.col("half") - 1e-6), F.ceil(F.greatest(a, b) + F.col("half") + 1e-6)
    px = rows.where((x1 >= 0) & (x0 <= size - 1)).withColumn("px", F.explode(F.sequence(clip(x0), clip(x1))))
    d2 = segment_distance2(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])
    return px.where(d2 <= F.col("half") * F.col("half")).groupBy("px", "py").agg(F.max_by("mat", "ord").alias("mat"))


def rasterized_rings(rings: DataFrame, size: int) -> DataFrame:
    """px, py, mat of pixels whose rows' centre lines lie inside rings (ord, mat, ring of points)."""
    edges = rings.select("ord", "mat", F.explode(F.arrays_zip(F.col("ring").alias("a"), _next(F.col("ring")).alias("b"))).alias("e")).select("ord", "mat", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    low, top = F.least("ay", "by"), F.greatest("ay", "by")
    e = edges.where("ay != by").withColumn("r0", F.greatest(F.lit(0), F.ceil(low - 0.5)).cast("int")).withColumn("r1", F.least(F.lit(size - 1), F.ceil(top - 0.5) - 1).cast("int")).where("r0 <= r1")
    e = e.withColumn("py", F.explode(F.sequence("r0", "r1")))
    x = F.col("ax") + (F.col("py") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    rows = e.groupBy("ord", "mat", "py").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")), lambda i: F.struct(F.element_at("xs", i * 2 - 1).alias("a"), F.element_at("xs", i * 2).alias("b")))
    s = rows.where(F.size("xs") > 1).select("ord", "mat", "py", F.explode(spans).alias("s"))
    a, b = F.greatest(F.lit(0), F.ceil("s.a")).cast("int"), F.least(F.lit(size - 1), F.floor("s.b")).cast("int")
    s = s.withColumn("p0", a).withColumn("p1", b).where("p0 <= p1").withColumn("px", F.explode(F.sequence("p0", "p1")))
    return s.groupBy("px", "py").agg(F.max_by("mat", "ord").alias("mat"))


def layer_map(layers: list[DataFrame]) -> DataFrame:
    """px, py, mat of painted rasters (px, py, mat); a later one covers an earlier one."""
    parts = [df.select("px", "py", "mat", F.lit(n).alias("layer")) for n, df in enumerate(layers)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("px", "py").agg(F.max_by("mat", "layer").alias("mat"))


def trimmed(points: DataFrame, start: float, end: float) -> DataFrame:
    """Lines (line, idx, x, y) less so much length at both ends, new ends interpolated; a line that is shorter than
    both goes.  Rows line, arc, x, y."""
    w = Window.partitionBy("line").orderBy("idx")
    a = with_arc(points).withColumn("total", F.max("arc").over(Window.partitionBy("line"))).where(F.col("total") > start + end)
    a = a.select("line", "idx", "x", "y", "arc", "total", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"), F.lead("arc").over(w).alias("b"))
    lo, hi = F.lit(start), F.col("total") - end
    at = lambda s: F.struct(s.alias("arc"), (F.col("x") + (F.col("bx") - F.col("x")) * (s - F.col("arc")) / (F.col("b") - F.col("arc"))).alias("x"), (F.col("y") + (F.col("by") - F.col("y")) * (s - F.col("arc")) / (F.col("b") - F.col("arc"))).alias("y"))
    none = F.array().cast("array<struct<arc:double,x:double,y:double>>")
    own = F.when((F.col("arc") > lo) & (F.col("arc") < hi), F.array(F.struct("arc", "x", "y"))).otherwise(none)
    inside = lambda s: (F.col("b") > F.col("arc")) & (s >= F.col("arc")) & (s < F.col("b"))
    ends = F.concat(own, F.when(inside(lo), F.array(at(lo))).otherwise(none), F.when(inside(hi), F.array(at(hi))).otherwise(none))
    last = F.when((F.col("b").isNull()) & (F.lit(end) == 0), F.array(F.struct("arc", "x", "y"))).otherwise(none)
    return a.select("line", F.explode(F.concat(ends, last)).alias("p")).select("line", "p.*")


# fixed values: turns in degrees beyond which a point is cut off, on long and on short edges; what a short edge is, how far off the
# new points lie, at most in shares of the edge; least end edge; least way of an end's direction
KINK, TIGHT_KINK, SHORT_EDGE, KINK_OFFSET, OFFSET_SHARE, LEAST_END, TANGENT_WAY = 75.0, 30.0, 4.0, 2.0, 0.4, 2.0, 3.0


def smoothed_kinks(points: DataFrame) -> DataFrame:
    """line, idx, x, y of lines (line, idx, x, y) without sharp turns: a point that turns by more than KINK gives way to two
    on its edges; beside a short edge one that turns by more than TIGHT_KINK goes.  Ends stay."""
    from geoloom.functions.frames import turn_degrees

    w = Window.partitionBy("line").orderBy("idx")
    p = points.select("line", "idx", "x", "y", F.struct("x", "y").alias("c"), F.lag(F.struct("x", "y")).over(w).alias("a"), F.lead(F.struct("x", "y")).over(w).alias("b"))
    gap = lambda s: F.hypot(F.col(f"{s}.x") - F.col("x"), F.col(f"{s}.y") - F.col("y"))
    p = p.withColumn("before", gap("a")).withColumn("after", gap("b")).withColumn("turn", turn_degrees(F.col("a"), F.col("c"), F.col("b")))
    short, off = F.least("before", "after") < SHORT_EDGE, F.least(F.lit(KINK_OFFSET), F.least("before", "after") * OFFSET_SHARE)
    toward = lambda s, n: F.struct((F.col("x") + (F.col(f"{s}.x") - F.col("x")) * off / F.col(n)).alias("x"), (F.col("y") + (F.col(f"{s}.y") - F.col("y")) * off / F.col(n)).alias("y"))
    stays = F.col("a").isNull() | F.col("b").isNull() | (F.col("turn") <= F.when(short, TIGHT_KINK).otherwise(KINK))
    made = F.when(stays, F.array("c")).when(short, F.slice(F.array("c"), 1, 0)).otherwise(F.array(toward("a", "before"), toward("b", "after")))
    q = p.select("line", "idx", F.posexplode(made).alias("n", "q"))
    return q.select("line", (F.row_number().over(Window.partitionBy("line").orderBy("idx", "n")) - 1).alias("idx"), "q.x", "q.y")


def pruned_ends(points: DataFrame, least: float = LEAST_END) -> DataFrame:
    """Lines (line, idx, x, y) without the inner points next to an end that are nearer to it than `least`."""
    for order in (F.col("idx"), F.desc("idx")):
        w = Window.partitionBy("line").orderBy(order)
        gap = F.hypot(F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w))
        p = points.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("line"))).withColumn("_far", gap >= least)
        inner = (F.col("_i") > 1) & (F.col("_i") < F.col("_n"))
        far = F.max(F.when(inner & F.col("_far"), 1).otherwise(0)).over(w)
        points = p.withColumn("_kept", ~inner | (far == 1)).where("_kept").drop("_i", "_n", "_far", "_kept")
    return points


def end_tangents(points: DataFrame, way: float = TANGENT_WAY) -> DataFrame:
    """line, end, dx, dy: the unit vector into each end of a line (line, idx, x, y) from its first point that is at least `way` along
    the line away, else from the other end; 0 for lines of one place."""
    from geoloom.functions.frames import unit_vector

    a = with_arc(points).withColumn("total", F.max("arc").over(Window.partitionBy("line")))
    ends = []
    for name, along, node, other in (("start", F.col("arc"), F.min_by, F.max_by), ("end", F.col("total") - F.col("arc"), F.max_by, F.min_by)):
        at = F.struct("x", "y")
        g = a.groupBy("line").agg(node(at, "idx").alias("p"), other(at, "idx").alias("o"), F.min_by(F.when(along >= way, at), F.when(along >= way, F.struct(along, F.when(F.lit(name == "start"), F.col("idx")).otherwise(-F.col("idx"))))).alias("q"))
        q = F.coalesce("q", "o")
        ends.append(g.select("line", F.lit(name).alias("end"), unit_vector(F.col("p.x") - q["x"], F.col("p.y") - q["y"], 1e-9).alias("d")))
    return ends[0].union(ends[1]).select("line", "end", F.col("d.x").alias("dx"), F.col("d.y").alias("dy"))


def height_along(points: DataFrame, distance: float) -> DataFrame:
    """line, z: the height of lines (line, idx, x, y, z) at a distance from their start, at most at their end."""
    w = Window.partitionBy("line").orderBy("idx")
    a = with_arc(points).withColumn("total", F.max("arc").over(Window.partitionBy("line"))).withColumn("_b", F.lead("arc").over(w)).withColumn("_z", F.lead("z").over(w))
    at = F.least(F.lit(float(distance)), F.col("total"))
    inside = (F.col("_b") > F.col("arc")) & (at > F.col("arc")) & (at <= F.col("_b"))
    z = F.when(inside, F.col("z") + (F.col("_z") - F.col("z")) * (at - F.col("arc")) / (F.col("_b") - F.col("arc")))
    return a.groupBy("line").agg(F.coalesce(F.max(z), F.min_by("z", "idx")).alias("z"))
