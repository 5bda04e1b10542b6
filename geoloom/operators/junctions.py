"""Junctions of roads: trims where road bodies would overlap, polygons and their checks, water rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import ring_area

# fixed values: least approaches, miter limit in half widths, most of a segment's length that is cut, limits of polygons
APPROACHES, MITER, MOST_CUT = 3, 4.0, 0.4
LEAST_AREA, LEAST_EDGE, MOST_DIAGONAL, MOST_Z = 0.5, 0.05, 200.0, 1.5


def wedge(ax: Column, ay: Column, wa: Column, bx: Column, by: Column, wb: Column) -> Column:
    """struct(a, b): how far along two unit directions from a node the left edge of the first meets the right edge of
    the second, each between 0 and MITER times the greater half width; 0 for parallel ones."""
    det = bx * ay - ax * by
    dx, dy = by * wb + ay * wa, -bx * wb - ax * wa
    limit = F.greatest(wa, wb) * MITER
    hold = lambda v: F.greatest(F.lit(0.0), F.least(limit, v))
    flat = F.abs(det) < 1e-6
    safe = F.when(flat, F.lit(None)).otherwise(det)
    return F.struct(F.when(flat, 0.0).otherwise(hold((bx * dy - dx * by) / safe)).alias("a"), F.when(flat, 0.0).otherwise(hold((ax * dy - dx * ay) / safe)).alias("b"))


def trims(arms: DataFrame) -> DataFrame:
    """seg, end, cut of arms (node, seg, end, dx, dy, half, length): neighbours by angle around each node of at least
    three arms, the greater trim of both sides, at most MOST_CUT of the segment."""
    size = F.count("*").over(Window.partitionBy("node"))
    a = arms.withColumn("n", size).where(F.col("n") >= APPROACHES)
    order = Window.partitionBy("node").orderBy(F.atan2("dy", "dx"), "seg", "end")
    a = a.withColumn("i", F.row_number().over(order))
    names = ("seg", "end", "dx", "dy", "half", "length")
    left = a.select("node", F.when(F.col("i") == F.col("n"), 1).otherwise(F.col("i") + 1).alias("i"), *[F.col(c).alias(f"p_{c}") for c in names])
    pair = a.join(left, ["node", "i"])
    w = wedge(*[F.col(c) for c in ("p_dx", "p_dy", "p_half", "dx", "dy", "half")])
    pair = pair.withColumn("w", w)
    both = pair.select(F.col("p_seg").alias("seg"), F.col("p_end").alias("end"), F.col("p_length").alias("length"), F.col("w.a").alias("cut")).union(pair.select("seg", "end", "length", F.col("w.b").alias("cut")))
    return both.where("length > 0").groupBy("seg", "end").agg(F.max(F.least(F.col("cut"), F.col("length") * MOST_CUT)).alias("cut"))


def polygon_fault(ring: Column) -> Column:
    """The first rule that a polygon (array of struct x, y, z) breaks, or null."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    span = lambda k: F.array_max(F.transform(ring, lambda p: p[k])) - F.array_min(F.transform(ring, lambda p: p[k]))
    edge = F.array_min(F.zip_with(ring, nxt, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))))
    odd = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull() | p["z"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | F.isnan(p["z"]))
    return (
        F.when(F.coalesce(F.size(ring), F.lit(0)) < 3, "too_few_vertices")
        .when(odd, "non_finite")
        .when(F.sqrt(span("x") * span("x") + span("y") * span("y")) > MOST_DIAGONAL, "bbox_too_large")
        .when(span("z") > MOST_Z, "z_range_too_large")
        .when(edge < LEAST_EDGE, "edge_too_short")
        .when(F.abs(ring_area(ring)) < LEAST_AREA, "area_too_small")
    )


def clamped_z(ring: Column, most: float = MOST_Z) -> Column:
    """Heights held to half a range around the upper median."""
    zs = F.array_sort(F.transform(ring, lambda p: p["z"]))
    mid = F.element_at(zs, (F.floor(F.size(zs) / 2) + 1).cast("int"))
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.greatest(mid - most / 2, F.least(mid + most / 2, p["z"])).alias("z")))


def best_rectangle(rings: DataFrame) -> DataFrame:
    """id, cx, cy, yaw, width, length: the least rectangle along one of a ring's (id, ring) edges, around the mean of
    its points; of equal ones the first edge's."""
    nxt = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    mean = lambda k: F.aggregate(F.transform("ring", lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size("ring")
    r = rings.select("id", "ring", mean("x").alias("cx"), mean("y").alias("cy"), F.posexplode(F.zip_with("ring", nxt, lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))).alias("i", "e"))
    size = F.sqrt(F.col("e.dx") * F.col("e.dx") + F.col("e.dy") * F.col("e.dy"))
    r = r.where(size >= 1e-6).withColumn("c", F.col("e.dx") / size).withColumn("s", F.col("e.dy") / size)
    u = F.transform("ring", lambda p: (p["x"] - F.col("cx")) * F.col("c") + (p["y"] - F.col("cy")) * F.col("s"))
    v = F.transform("ring", lambda p: (p["y"] - F.col("cy")) * F.col("c") - (p["x"] - F.col("cx")) * F.col("s"))
    r = r.withColumn("width", F.array_max(u) - F.array_min(u)).withColumn("length", F.array_max(v) - F.array_min(v)).withColumn("yaw", F.atan2("s", "c"))
    best = F.min_by(F.struct("cx", "cy", "yaw", "width", "length"), F.struct(F.round(F.col("width") * F.col("length"), 9).alias("a"), F.col("i")))
    return r.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def water_blocks(rings: DataFrame) -> DataFrame:
    """id, cx, cy, surface, yaw, width, length, height of closed water (id, ring of x, y, z): padded rectangles at the 80th
    percentile of the shore's heights."""
    fit = best_rectangle(rings)
    zs = F.array_sort(F.transform("ring", lambda p: p["z"]))
    level = rings.select("id", F.element_at(zs, (F.floor((F.size(zs) - 1) * 0.8) + 1).cast("int")).alias("z"))
    w, n = F.greatest(F.lit(4.0), F.col("width")), F.greatest(F.lit(4.0), F.col("length"))
    pad = F.greatest(F.lit(1.5), F.least(F.lit(6.9), F.least(w, n) * 0.092)) * 2
    out = fit.join(level, "id").select("id", "cx", "cy", (F.col("z") + 0.14).alias("surface"), "yaw", (w + pad).alias("width"), (n + pad).alias("length"))
    return out.withColumn("height", F.greatest(F.lit(1.5), F.least("width", "length") * 0.08))


def ground_mask(roads: DataFrame, size: int, feather: float) -> DataFrame:
    """cx, cz, w: coverage of cells by road segments (half, ax, az, bx, bz in cells): 1 inside the half width, falling
    smoothly to 0 over the feather, the greatest counts.  Each row of cells is looked at only beside the part of the segment that is
    near it, so a long slanting segment meets its own cells, not those of its box."""
    from geoloom.functions.scalars import smoothstep

    from .geometry import segment_distance2

    reach, mid, dz, dx = F.col("half") + feather, F.col("cz") + 0.5, F.col("bz") - F.col("az"), F.col("bx") - F.col("ax")
    hold = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), v)).cast("int")
    z0, z1 = F.floor(F.least("az", "bz") - reach), F.ceil(F.greatest("az", "bz") + reach)
    # a few bytes of a segment stand for many cells, so the table's own splits would be too few
    dealt = roads.where((z1 >= 0) & (z0 <= size - 1)).select("half", "ax", "az", "bx", "bz").repartition(4 * roads.sparkSession.sparkContext.defaultParallelism)
    r = dealt.withColumn("cz", F.explode(F.sequence(hold(z0), hold(z1))))
    t0, t1 = ((mid + s * reach - F.col("az")) / F.nullif(dz, F.lit(0.0)) for s in (-1, 1))
    low, top = F.greatest(F.lit(0.0), F.coalesce(F.least(t0, t1), F.lit(0.0))), F.least(F.lit(1.0), F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
    r = r.withColumn("t0", low).withColumn("t1", top).where("t0 <= t1")
    a, b = F.col("ax") + F.col("t0") * dx, F.col("ax") + F.col("t1") * dx
    x0, x1 = F.floor(F.least(a, b) - reach - 0.5), F.ceil(F.greatest(a, b) + reach - 0.5)
    c = r.where((x1 >= 0) & (x0 <= size - 1)).withColumn("cx", F.explode(F.sequence(hold(x0), hold(x1))))
    edge = F.sqrt(segment_distance2(F.col("cx") + 0.5, mid, *[F.col(k) for k in ("ax", "az", "bx", "bz")])) - F.col("half")
    # an array of one or no edge: a filter would be moved below the distance, with a copy of it for each of its terms
    c = c.select("cx", "cz", F.explode(F.filter(F.array(edge), lambda e: e < feather)).alias("edge"))
    return c.groupBy("cx", "cz").agg(F.max(F.when(F.col("edge") <= 0, 1.0).otherwise(smoothstep((feather - F.col("edge")) / feather))).alias("w"))


def ground_cover(features: DataFrame, size: int, cell: float, feather: float) -> DataFrame:
    """cx, cz, w: coverage of cells by what lies flat on the ground of features (type, tags, geometry: array of x, y in cells, holes): flat areas of three points
    or more are filled, other roads of two points or more are as wide as their class; bridges, tunnels and other layers are left out.  cell, feather:
    metres."""
    from geoloom.functions import tags as rules

    from .fields import area_mask

    on = features.where(rules.on_ground(F.col("tags")) & F.col("geometry").isNotNull())
    area = rules.flat_ground(F.col("tags")) & (F.size("geometry") >= 3)
    areas = area_mask(on.where(area).select(F.col("geometry").alias("ring"), F.coalesce("holes", F.slice(F.array("geometry"), 1, 0)).alias("holes")), size, feather / cell)
    lines = on.where(~area & (F.col("type") == "road") & (F.size("geometry") >= 2)).select((rules.ground_half(F.col("tags")) / cell).alias("half"), "geometry").where("half is not null")
    ends = F.explode(F.arrays_zip(F.slice("geometry", 1, F.size("geometry") - 1).alias("a"), F.slice("geometry", 2, F.size("geometry") - 1).alias("b"))).alias("s")
    segs = lines.select("half", ends).select("half", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("az"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("bz"))
    return ground_mask(segs, size, feather / cell).union(areas.select("cx", "cz", "w")).groupBy("cx", "cz").agg(F.max("w").alias("w"))


def capped(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """rows (category, priority, ord) within the cap of their category, high priorities first, then in order.  Only
    categories with a cap are ranked."""
    has_cap = F.coalesce(F.col("category").isin(*caps), F.lit(False)) if caps else F.lit(False)
    limit = F.lit(0)
    for name, n in caps.items():
        limit = F.when(F.col("category") == name, n).otherwise(limit)
    w = Window.partitionBy("category").orderBy(F.desc("priority"), "ord")
    first = rows.where(has_cap).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(caps.values(), default=0))
    return rows.where(~has_cap).unionByName(first.where(F.col("_n") <= limit).drop("_n"))


def stable_widths(roads: DataFrame) -> DataFrame:
    """corridor, width of roads (corridor, width, lane): the greatest width where widths differ by at most two lanes
    and 0.75 metres."""
    g = roads.where("width > 0").groupBy("corridor").agg(F.min("width").alias("lo"), F.max("width").alias("hi"), F.min("lane").alias("lane"))
    return g.where(F.col("hi") - F.col("lo") <= F.col("lane") * 2 + 0.75).select("corridor", F.col("hi").alias("width"))


def paint_order(features: DataFrame) -> DataFrame:
    """features (id, bucket, area, layer, class) with their place `n` in painting: areas by bucket and falling area,
    then roads by layer and class.  Places are within a map tile (tile), which bounds the sort."""
    w = Window.partitionBy("tile").orderBy(F.col("class").isNotNull(), "bucket", F.desc("area"), "layer", "class", "id")
    return features.withColumn("n", F.row_number().over(w) - 1)
