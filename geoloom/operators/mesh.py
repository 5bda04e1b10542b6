"""Triangle meshes as rows: vertices (mesh, lod, vi, x, y, z) with y up in metres, triangles (mesh, ti,
i0, i1, i2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sent_if_small, table

GROUND_NORMAL, BAND_M, COHERE_M, RISER_M, GROUND_M = 0.85, 1.5, 1.5, 2.5, 2.5


def corners(triangles: DataFrame, vertices: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Triangles with their three points a, b, c as structs of x, y, z and `more` columns of vertices."""
    out = triangles
    for k, name in enumerate("abc"):
        v = vertices.select("mesh", F.col("vi").alias(f"i{k}"), F.struct("x", "y", "z", *more).alias(name))
        out = out.join(v, ["mesh", f"i{k}"], how)
    return out


def normal_up(a: Column, b: Column, c: Column) -> Column:
    """Absolute upward part of a triangle's unit normal, 0 for one without area."""
    ux, uy, uz, vx, vy, vz = (p[k] - a[k] for p in (b, c) for k in "xyz")
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    n = F.sqrt(nx * nx + ny * ny + nz * nz)
    return F.when(n > 1e-12, F.abs(ny) / n).otherwise(0.0)


def ground_triangles(triangles: DataFrame, vertices: DataFrame, normal: float = GROUND_NORMAL) -> DataFrame:
    t = corners(triangles, vertices)
    return t.where(normal_up(F.col("a"), F.col("b"), F.col("c")) > normal)


def strip_ground(triangles: DataFrame, vertices: DataFrame, terrain: DataFrame, cell: float, normal: float = GROUND_NORMAL, distance: float = GROUND_M, whole: bool = False) -> DataFrame:
    """Triangles less those that lie flat and on average under `distance` above the terrain (cx, cz, h); if `whole`, those that lack a vertex
    go as well.  A vertex takes its height above the terrain along, so triangles meet their vertices once."""
    terrain = sent_if_small(table(terrain, "terrain"))
    at = lambda v: F.floor(F.col(v) / cell)
    above = vertices.join(terrain, (at("x") == F.col("cx")) & (at("z") == F.col("cz")), "left").withColumn("above", F.col("y") - F.coalesce("h", F.lit(0.0)))
    t = corners(triangles, above, "above", how="inner" if whole else "left")
    known = [F.col(f"{k}.above") for k in "abc"]
    mean = sum((F.coalesce(v, F.lit(0.0)) for v in known), F.lit(0.0)) / F.nullif(sum((v.isNotNull().cast("int") for v in known), F.lit(0)), F.lit(0))
    low = (normal_up(F.col("a"), F.col("b"), F.col("c")) > normal) & (mean < distance)
    return t.where(~F.coalesce(low, F.lit(False))).select(triangles.columns)


def welded(vertices: DataFrame, triangles: DataFrame, cell: float = 1.0) -> DataFrame:
    """Vertices moved onto the ground that tiles share.

    A cell's ground is the mean of the ground triangles' corners of its finest level (smallest lod).
    A vertex takes it if that level is finer than its own, or its own and shared with another mesh; if
    the cell's ground is no step, and the vertex is near it and not high above the lowest ground."""
    key = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xz"]
    used = ground_triangles(triangles, vertices).select("mesh", F.explode(F.array("i0", "i1", "i2")).alias("vi"))
    ground = used.join(vertices, ["mesh", "vi"]).select("mesh", "lod", "y", *key)
    floor = ground.groupBy("cx", "cz").agg(F.min("y").alias("lowest"), F.min("lod").alias("g_lod"))
    by_lod = ground.groupBy("cx", "cz", "lod").agg(F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("mesh").alias("m0"), F.max("mesh").alias("m1")).withColumnRenamed("lod", "g_lod")
    cells = by_lod.join(floor, ["cx", "cz", "g_lod"])
    v = vertices.select("*", *key).join(cells, ["cx", "cz"], "left")
    own = (F.col("g_lod") == F.col("lod")) & (F.col("m0") == F.col("m1")) & (F.col("m0") == F.col("mesh"))
    moves = (F.col("g_lod") <= F.col("lod")) & (F.col("hi") - F.col("lo") <= COHERE_M) & ~own & (F.col("y") - F.col("lowest") <= RISER_M) & (F.abs(F.col("mean") - F.col("y")) <= BAND_M)
    return v.select("mesh", "lod", "vi", "x", F.when(F.coalesce(moves, F.lit(False)), F.col("mean")).otherwise(F.col("y")).alias("y"), "z")


def in_corridor(triangles: DataFrame, vertices: DataFrame, route: DataFrame, half_width: float) -> DataFrame:
    """Triangles whose centroid lies within half_width of a route (seg, ax, az, bx, bz).  A segment is looked for only from the squares that are
    near it, row by row, and a triangle goes on with the first that it meets."""
    from .geometry import segment_distance2

    t = corners(triangles, vertices)
    mid = lambda k: (F.col(f"a.{k}") + F.col(f"b.{k}") + F.col(f"c.{k}")) / 3
    t = t.select(*triangles.columns, mid("x").alias("_px"), mid("z").alias("_pz"))
    square = lambda c: F.floor(F.col(c) / half_width).cast("long")
    t = t.withColumn("_gx", square("_px")).withColumn("_gz", square("_pz"))
    ends = [F.col(c).cast("double") for c in ("ax", "az", "bx", "bz")]
    r = table(near_squares(route.select(*[c.alias(f"_{n}") for c, n in zip(ends, ("ax", "az", "bx", "bz"))]), half_width), "route")
    d2 = segment_distance2(*[F.col(f"_{c}") for c in ("px", "pz", "ax", "az", "bx", "bz")])
    met = (t["_gx"] == r["_rx"]) & (t["_gz"] == r["_rz"]) & (d2 <= half_width * half_width)
    return t.join(sent_if_small(r), met, "left_semi").select(*triangles.columns)


def near_squares(route: DataFrame, side: float) -> DataFrame:
    """Segments (_ax, _az, _bx, _bz) with _rx, _rz of the squares of `side` that hold any place within `side` of them: in each row of squares those beside
    the part of the segment that is within `side` of the row."""
    dx, dz = F.col("_bx") - F.col("_ax"), F.col("_bz") - F.col("_az")
    span = lambda lo, hi: F.explode(F.sequence(F.floor((lo - side) / side - 1e-6).cast("long"), F.floor((hi + side) / side + 1e-6).cast("long")))
    rows = route.withColumn("_rz", span(F.least("_az", "_bz"), F.greatest("_az", "_bz")))
    t0, t1 = (((F.col("_rz") + k) * side - F.col("_az")) / F.nullif(dz, F.lit(0.0)) for k in (-1 - 1e-6, 2 + 1e-6))
    low, top = F.greatest(F.lit(0.0), F.coalesce(F.least(t0, t1), F.lit(0.0))), F.least(F.lit(1.0), F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
    rows = rows.withColumn("_t0", low).withColumn("_t1", top).where("_t0 <= _t1")
    a, b = F.col("_ax") + F.col("_t0") * dx, F.col("_ax") + F.col("_t1") * dx
    return rows.withColumn("_rx", span(F.least(a, b), F.greatest(a, b))).drop("_t0", "_t1")


def compacted(triangles: DataFrame) -> DataFrame:
    """mesh, vi, new_vi: the used vertices numbered afresh in order of their old number."""
    from pyspark.sql import Window

    used = triangles.select("mesh", F.explode(F.array("i0", "i1", "i2")).alias("vi")).distinct()
    return used.withColumn("new_vi", F.row_number().over(Window.partitionBy("mesh").orderBy("vi")) - 1)


def stamped(template: DataFrame, instances: DataFrame) -> DataFrame:
    """Vertices of a template (kind, vi, x, y, z) set at instances (id, kind, px, py, pz, yaw, scale)."""
    c, s = F.cos("yaw"), F.sin("yaw")
    j = instances.join(F.broadcast(template), "kind")
    return j.select("id", "vi", (F.col("px") + F.col("scale") * (F.col("x") * c + F.col("z") * s)).alias("x"), (F.col("py") + F.col("scale") * F.col("y")).alias("y"), (F.col("pz") + F.col("scale") * (F.col("z") * c - F.col("x") * s)).alias("z"))


def conformed(vertices: DataFrame, triangles: DataFrame, terrain: DataFrame, cell: float, reach: float = GROUND_M, most: float = 15.0) -> DataFrame:
    """Vertices lowered by their cell's median residual over the terrain (cx, cz, h).

    Residuals are those of the ground triangles' corners within `reach` of the terrain; a shift is held to `most`, and
    cells without a residual don't move."""
    key = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xz"]
    v = vertices.select("*", *key)
    over = v.join(terrain, ["cx", "cz"], "left").withColumn("r", F.col("y") - F.coalesce("h", F.lit(0.0)))
    ground = ground_triangles(triangles, vertices).select("mesh", F.explode(F.array("i0", "i1", "i2")).alias("vi"))
    shift = ground.join(over.select("mesh", "vi", "cx", "cz", "r"), ["mesh", "vi"]).where(F.abs("r") < reach).groupBy("cx", "cz").agg(F.median("r").alias("d"))
    moved = v.join(shift, ["cx", "cz"], "left")
    return moved.select("mesh", "lod", "vi", "x", (F.col("y") - F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce("d", F.lit(0.0))))).alias("y"), "z")
