"""Gaps of road bodies: cells that roads with round ends cover and the bodies with flat ends don't, their connected patches, and the
junction polygons that fill them.  Cells are whole numbers of a plane without bounds; nothing holds a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.frames import grown_polygon

from .clusters import hull_rings, with_centre
from .network import nearest_of_all, spread_labels
from .shared import by_shuffle, table

# fixed values: least area of a gap in square metres, metres that a patch reaches under the roads, heights that its roads may span,
# its reach for road ends in half diagonals, roads that have to end there
LEAST_AREA, OUTSET, MOST_Z, NEAR, LEAST_ROADS = 1.5, 0.25, 1.5, 1.4, 2
#: Cells of a row that a window holds; metres of a square of road ends.
BLOCK, SQUARE = 256, 16.0


def covered_cells(segs: DataFrame) -> DataFrame:
    """px, py of the cells whose middle lies within `half` of segments (half, ax, ay, bx, by in cells; round_a, round_b: whether that
    end is round or cut flat).  Each row of cells is looked at only beside the part of the segment that is near it."""
    y0, y1 = F.floor(F.least("ay", "by") - F.col("half") - 0.5), F.ceil(F.greatest("ay", "by") + F.col("half") - 0.5)
    rows = segs.where("half > 0").withColumn("py", F.explode(F.sequence(y0.cast("long"), y1.cast("long"))))
    dx, dy, mid = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("py") + 0.5
    t0, t1 = ((mid + s * F.col("half") - F.col("ay")) / F.nullif(dy, F.lit(0.0)) for s in (-1, 1))
    low, top = F.greatest(F.lit(0.0), F.coalesce(F.least(t0, t1), F.lit(0.0))), F.least(F.lit(1.0), F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
    rows = rows.withColumn("t0", low).withColumn("t1", top).where("t0 <= t1")
    a, b = F.col("ax") + F.col("t0") * dx, F.col("ax") + F.col("t1") * dx
    x0, x1 = F.floor(F.least(a, b) - F.col("half") - 0.5 - 1e-6), F.ceil(F.greatest(a, b) + F.col("half") - 0.5 + 1e-6)
    cells = rows.withColumn("px", F.explode(F.sequence(x0.cast("long"), x1.cast("long"))))
    x, size = F.col("px") + 0.5, dx * dx + dy * dy
    along = (x - F.col("ax")) * dx + (mid - F.col("ay")) * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / size))).otherwise(0.0)
    ex, ey = x - (F.col("ax") + dx * t), mid - (F.col("ay") + dy * t)
    beside = (F.col("round_a") | (along >= 0)) & (F.col("round_b") | (along <= size)) & (F.col("round_a") | F.col("round_b") | (size > 0))
    return cells.where(beside & (ex * ex + ey * ey <= F.col("half") * F.col("half"))).select("px", "py").distinct()


def patches(cells: DataFrame) -> DataFrame:
    """py, x0, x1, patch: runs of cells (px, py) with the patch they are in; a patch is a set of cells that are joined by their sides, named by
    its first cell, of the lowest row (py * 2**32 + px + 2**31).

    Cells of a row that follow one another are a run, cut at every BLOCK cells.  A run meets runs of the next row in the same block and
    the one that goes on in the next block; components of these links are the patches, so no task holds more than two rows of a block
    whatever the size of a patch."""
    cells = cells.select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.floor(F.col("px") / BLOCK).alias("block")).distinct()
    place = F.col("px") - F.row_number().over(Window.partitionBy("py", "block").orderBy("px"))
    runs = cells.withColumn("place", place).groupBy("py", "block", "place").agg(F.min("px").alias("x0"), F.max("px").alias("x1"))
    runs = table(runs.select("py", "block", "x0", "x1", (F.col("py") * F.lit(2**32) + F.col("x0") + F.lit(2**31)).alias("run")), "runs")
    size = runs.count()
    below = runs.select((F.col("py") - 1).alias("py"), "block", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("run").alias("other"))
    down = runs.join(by_shuffle(below, size), ["py", "block"]).where("u0 <= x1 and x0 <= u1").select(F.col("run").alias("a"), F.col("other").alias("b"))
    ahead = runs.select("py", (F.col("block") - 1).alias("block"), (F.col("x0") - 1).alias("x1"), F.col("run").alias("other"))
    on = runs.join(by_shuffle(ahead, size), ["py", "block", "x1"]).select(F.col("run").alias("a"), F.col("other").alias("b"))
    labels = spread_labels(runs.select(F.col("run").alias("node")), table(down.union(on), "links"))
    return runs.join(by_shuffle(labels.withColumnRenamed("node", "run"), size), "run").select("py", "x0", "x1", F.col("label").alias("patch"))


def gap_junctions(reference: DataFrame, coverage: DataFrame, ends: DataFrame, nodes: DataFrame, cell: float, widest: float) -> DataFrame:
    """patch, cells, ring, cx, cy, cz: a polygon for each gap.  reference, coverage: cells (px, py) of `cell` metres; ends: road ends (seg, x, y, z);
    nodes: points of road bodies (target, x, y, z); widest: the greatest half width.

    A gap is a patch of reference cells that coverage leaves, of LEAST_AREA at least, with the ends of LEAST_ROADS roads near its middle
    - within half its box's diagonal or `widest`, times NEAR - which span no more than MOST_Z in height.  Its polygon is the hull of
    its cells' middles, OUTSET metres wider, each point at the height of the nearest node (ties: least target).

    Cells, ends and nodes, which may be many more than the files they come from let expect, are joined by shuffle."""
    holes = reference.select("px", "py").distinct().join(coverage.select("px", "py").distinct().hint("merge"), ["px", "py"], "left_anti")
    runs = table(patches(holes), "patches")
    n = F.col("x1") - F.col("x0") + 1
    least = max(1, int(LEAST_AREA / cell / cell + 0.5))
    of = runs.groupBy("patch").agg(F.sum(n).alias("cells"), F.sum((F.col("x0") + F.col("x1")) * n).alias("sx"), F.sum(F.col("py") * n).alias("sy"), F.min("x0").alias("u0"), F.max("x1").alias("u1"), F.min("py").alias("v0"), F.max("py").alias("v1")).where(F.col("cells") >= least)
    wide, high = (F.col("u1") + 1 - F.col("u0")) * cell, (F.col("v1") + 1 - F.col("v0")) * cell
    reach = F.greatest(F.sqrt(wide * wide + high * high) * 0.5, F.lit(float(widest))) * NEAR
    of = table(of.select("patch", "cells", ((F.col("sx") / 2 / F.col("cells") + 0.5) * cell).alias("mx"), ((F.col("sy") / F.col("cells") + 0.5) * cell).alias("my"), reach.alias("reach")), "gaps")
    at = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / SQUARE).cast("long"), F.floor((F.col(c) + F.col("reach")) / SQUARE).cast("long")))
    asked = of.withColumn("qx", at("mx")).withColumn("qy", at("my"))
    here = ends.select("seg", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"), F.floor(F.col("x") / SQUARE).cast("long").alias("qx"), F.floor(F.col("y") / SQUARE).cast("long").alias("qy"))
    dx, dy = F.col("ex") - F.col("mx"), F.col("ey") - F.col("my")
    near = asked.join(here.hint("merge"), ["qx", "qy"]).where(dx * dx + dy * dy <= F.col("reach") * F.col("reach"))
    flat = near.groupBy("patch").agg(F.count_distinct("seg").alias("roads"), (F.max("ez") - F.min("ez")).alias("span")).where((F.col("roads") >= LEAST_ROADS) & (F.col("span") <= MOST_Z))
    kept = table(of.join(by_shuffle(flat.select("patch"), of.count()), "patch", "left_semi").select("patch", "cells"), "kept")
    size = kept.count()
    middle = lambda c: ((F.col(c) + 0.5) * cell).alias("x")
    edge = runs.join(by_shuffle(kept.select("patch"), size), "patch", "left_semi")
    points = edge.select("patch", middle("x0"), ((F.col("py") + 0.5) * cell).alias("y"), F.lit(0.0).alias("z")).union(edge.select("patch", middle("x1"), ((F.col("py") + 0.5) * cell).alias("y"), F.lit(0.0).alias("z")))
    hulls = hull_rings(points, "patch").where(F.size("ring") > 2)
    corners = table(hulls.select("patch", F.posexplode(grown_polygon(F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), OUTSET)).alias("i", "p")).select("patch", "i", "p.x", "p.y", F.monotonically_increasing_id().alias("id")), "corners")
    heights = nodes.select("target", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("z"))
    found = nearest_of_all(corners.select("id", "x", "y"), heights.select("target", "tx", "ty"), 8.0).join(heights.select("target", "z").hint("merge"), "target")
    rings = corners.join(by_shuffle(found.select("id", "z"), corners.count()), "id").groupBy("patch").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("r"))
    out = with_centre(rings.select("patch", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("ring")))
    return out.join(by_shuffle(kept, size), "patch").select("patch", "cells", "ring", "cx", "cy", "cz")
