"""Fields over a plane: rasters brought to another grid of metres or degrees, and smooth fields from scattered samples.

Rasters are rows (y, x, h) with all cells listed; a target cell or a point meets its four source cells in one join, as each
source cell carries its right and lower neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import frames
from geoloom.functions.scalars import clamp

from .grid import around, rank_values

# fixed values: side of the scene that a scalar field covers
SCENE = frames.SCENE


def quads(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, y, x, and the values h00, h01 (right), h10 (below), h11 of each cell; null beyond the raster's end."""
    at = lambda c: (lambda w: F.max(c).over(w.rangeBetween(1, 1)))
    rows = around(cells.select(*by, "y", "x", F.col("h").alias("h00")), "x", 1, {"h01": at("h00")}, by)
    return around(rows, "y", 1, {"h10": at("h00"), "h11": at("h01")}, by)


def sampled(points: DataFrame, cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """points (by, px, py in cells) with h between the four cells around, null where one is missing that has weight (1e-9 or more) or
    the point lies beyond the outermost cells."""
    return between(points, quads(cells, by), by)


def between(points: DataFrame, corners: DataFrame, by: list[str] = ()) -> DataFrame:
    """points with h as in `sampled`, of cells that carry their neighbours (see quads)."""
    p = points.withColumn("_x", F.floor("px")).withColumn("_y", F.floor("py"))
    q = corners.select(*by, F.col("y").alias("_y"), F.col("x").alias("_x"), "h00", "h01", "h10", "h11")
    fx, fy = F.col("px") - F.col("_x"), F.col("py") - F.col("_y")
    part = lambda h, w: F.when(w < 1e-9, 0.0).otherwise(F.col(h) * w)
    h = part("h00", (1 - fx) * (1 - fy)) + part("h01", fx * (1 - fy)) + part("h10", (1 - fx) * fy) + part("h11", fx * fy)
    return p.join(q, [*by, "_y", "_x"], "left").withColumn("h", h).drop("_x", "_y", "h00", "h01", "h10", "h11")


def target_cells(targets: DataFrame) -> DataFrame:
    """id, y, x, lat, lng of all cells of rasters (id, width, height, b: bounds of their outermost cells)."""
    cells = targets.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    p = frames.pixel_point(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("b"))
    return cells.select("id", "y", "x", p.alias("p")).select("id", "y", "x", "p.lat", "p.lng")


def resampled(targets: DataFrame, layers: list[tuple[DataFrame, dict]]) -> DataFrame:
    """id, y, x, h of targets (see target_cells) from the first of the layers that knows a cell.

    A layer is its cells (y, x, h) and its frame: width, height, north, south, east, west of its outermost cells."""
    cells = target_cells(targets)
    found = []
    for n, (source, f) in enumerate(layers):
        px = (F.col("lng") - f["west"]) / (f["east"] - f["west"]) * (f["width"] - 1)
        py = (f["north"] - F.col("lat")) / (f["north"] - f["south"]) * (f["height"] - 1)
        near = cells.withColumn("px", px).withColumn("py", py).where((F.col("px").between(0, f["width"] - 1)) & F.col("py").between(0, f["height"] - 1))
        found.append(sampled(near, source).where("h is not null").select("id", "y", "x", "h", F.lit(n).alias("layer")))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    best = whole.groupBy("id", "y", "x").agg(F.min_by("h", "layer").alias("h")) if len(found) > 1 else whole.drop("layer")
    return cells.select("id", "y", "x").join(best, ["id", "y", "x"], "left")


def scene_cell(v: Column, n: int) -> Column:
    """The cell of a scene coordinate among n, held to the ends."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v + SCENE / 2) / SCENE * n))).cast("int")


def scalar_field(samples: DataFrame, n: int, write, rounds: int = 2, fallback: float = 0.0) -> DataFrame:
    """y, x, h, measured of the n x n cells over the scene: the median of a cell's samples (x, z, value); cells without any
    take the mean of the neighbours that were filled a round before; then 3 x 3 means whose edges repeat.  Without samples
    all cells are `fallback`.  `write` stores a round's table in a shared folder and returns it read back."""
    spark = samples.sparkSession
    cell = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).select(scene_cell(F.col("z"), n).alias("y"), scene_cell(F.col("x"), n).alias("x"), "value")
    known = write(rank_values(cell, ["y", "x"], "value", {"h": (0.5, "linear")}).withColumn("measured", F.lit(True)))
    every = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    done, last = known, known
    if not known.limit(1).count():
        return every.select("y", "x", F.lit(float(fallback)).alias("h"), F.lit(False).alias("measured"))
    left = write(every.join(known, ["y", "x"], "left_anti"))
    side = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("d")
    while left.limit(1).count():
        sent = last.select((F.col("y")).alias("_y"), F.col("x").alias("_x"), "h", side).select((F.col("_y") + F.col("d.a")).alias("y"), (F.col("_x") + F.col("d.b")).alias("x"), "h")
        last = write(left.join(sent, ["y", "x"]).groupBy("y", "x").agg(F.avg("h").alias("h")).withColumn("measured", F.lit(False)))
        left = write(left.join(last, ["y", "x"], "left_anti"))
        done = done.unionByName(last)
    field = write(done)
    for _ in range(rounds):
        field = edge_mean(edge_mean(field, "x"), "y")
    return field.select("y", "x", "h", "measured")


def edge_mean(field: DataFrame, axis: str) -> DataFrame:
    """h as the mean of a cell and its neighbours along an axis, where the end cell stands for the one beyond."""
    side = lambda d: (lambda w: F.max("h").over(w.rangeBetween(d, d)))
    near = around(field, axis, 1, {"_a": side(-1), "_b": side(1)})
    return near.withColumn("h", (F.coalesce("_a", "h") + F.col("h") + F.coalesce("_b", "h")) / 3).drop("_a", "_b")


def field_values(points: DataFrame, field: DataFrame, n: int) -> DataFrame:
    """points (x, z in scene units) with value: between the middles of the field's cells, held to the outermost."""
    at = lambda c: clamp((F.col(c) + SCENE / 2) / SCENE * n - 0.5, 0.0, n - 1.0)
    p = points.select("*", at("x").alias("px"), at("z").alias("py"))
    return sampled(p, field).drop("px", "py").withColumnRenamed("h", "value")


# fixed values: rows of cells that one step of an area covers, pairs of a cell and an edge that are held at a time, cells that a task
# gathers before it hands them on
BAND, PAIRS, GATHERED = 64, 1 << 20, 1 << 20


def _ring_cells(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, measure: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether places (rows y, columns x) lie in a ring, and their squared distance from it if it is asked for; edges with a missing
    coordinate don't count.  The arithmetic is that of `point_in_ring` and `ring_distance`."""
    inside, near = np.zeros((len(y), len(x)), bool), np.full((len(y), len(x)), np.inf)
    bx, by = np.roll(rx, -1), np.roll(ry, -1)
    known = ~(np.isnan(rx) | np.isnan(ry) | np.isnan(bx) | np.isnan(by))
    edges = [v[known] for v in (rx, ry, bx, by)]
    step = max(1, PAIRS // max(1, inside.size))
    for n in range(0, len(edges[0]), step):
        ax, ay, ex, ey = (v[n : n + step] for v in edges)
        dx, dy = ex - ax, ey - ay
        with np.errstate(all="ignore"):
            cut = dx * (y[:, None] - ay) / np.where(dy == 0, 1e-12, dy) + ax
            cut = np.where((ay > y[:, None]) != (ey > y[:, None]), cut, -np.inf)
            inside ^= (x[None, :, None] < cut[:, None, :]).sum(2) % 2 == 1
            if measure:
                size, px, py = dx * dx + dy * dy, x[None, :, None] - ax, y[:, None, None] - ay
                t = np.where(size > 0, np.clip((px * dx + py * dy) / size, 0.0, 1.0), 0.0)
                qx, qy = x[None, :, None] - (ax + dx * t), y[:, None, None] - (ay + dy * t)
                near = np.minimum(near, (qx * qx + qy * qy).min(2))
    return inside, near


def area_mask(areas: DataFrame, size: int, feather: float) -> DataFrame:
    """cx, cz, w: coverage of cells by areas (ring and holes of points x, y in cells): 1 inside, falling smoothly to 0 over the
    feather outside; holes are left out; the greatest counts.

    An area goes by bands of BAND rows, which are dealt over all tasks; a band's cells meet the ring's edges as arrays, some edges at a
    time, and a task hands on a cell's greatest coverage."""
    ends = lambda k, f: f(F.transform("ring", lambda p: p[k]))
    hold = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), v)).cast("int")
    lo, hi = lambda k: F.floor(ends(k, F.array_min) - feather), lambda k: F.ceil(ends(k, F.array_max) + feather)
    a = areas.where((F.size("ring") >= 3) & (hi("x") >= 0) & (hi("y") >= 0) & (lo("x") <= size - 1) & (lo("y") <= size - 1))
    of = lambda k: F.transform("ring", lambda p: p[k].cast("double")).alias(f"r{k}")
    in_holes = lambda k: F.transform("holes", lambda h: F.transform(h, lambda p: p[k].cast("double"))).alias(f"h{k}")
    a = a.select(of("x"), of("y"), in_holes("x"), in_holes("y"), *[f(v).alias(name) for v, f, name in ((lo("x"), hold, "x0"), (hi("x"), hold, "x1"), (lo("y"), hold, "z0"), (hi("y"), hold, "z1"))])
    band = F.explode(F.sequence(F.floor(F.col("z0") / BAND), F.floor(F.col("z1") / BAND))).alias("band")
    # a few bytes of an area stand for many cells, so the tables' own splits would be too few
    bands = a.select("*", band).repartition(4 * areas.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def greatest() -> tuple[np.ndarray, np.ndarray]:
            cell, w = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.lexsort((w, cell))
            cell, w = cell[order], w[order]
            last = np.append(cell[1:] != cell[:-1], True)[: len(cell)]
            return cell[last], w[last]

        def handed(cell, w):
            return pa.RecordBatch.from_arrays([pa.array((cell % size).astype("int32")), pa.array((cell // size).astype("int32")), pa.array(w)], names=["cx", "cz", "w"])

        count = 0
        for batch in batches:
            col = {k: batch.column(k) for k in batch.schema.names}
            numbers = lambda v: v.values.to_numpy(zero_copy_only=False).astype(float)
            for i in range(batch.num_rows):
                x0, x1, z0, z1, n = (col[k][i].as_py() for k in ("x0", "x1", "z0", "z1", "band"))
                cx, cz = np.arange(x0, x1 + 1), np.arange(max(z0, n * BAND), min(z1, n * BAND + BAND - 1) + 1)
                x, y = cx + 0.5, cz + 0.5
                inside, near = _ring_cells(x, y, numbers(col["rx"][i]), numbers(col["ry"][i]), True)
                gap = np.sqrt(near)
                with np.errstate(all="ignore"):
                    t = np.clip((feather - gap) / feather, 0.0, 1.0)
                w = np.where(inside, 1.0, np.where(gap < feather, t * t * (3.0 - t * 2.0), np.nan))
                if col["hx"][i].is_valid:
                    for hx, hy in zip(col["hx"][i].values, col["hy"][i].values):
                        if hx.is_valid and len(hx.values) >= 3:
                            w[inside & _ring_cells(x, y, numbers(hx), numbers(hy), False)[0]] = np.nan
                some = ~np.isnan(w)
                held.append(((cz[:, None] * size + cx)[some], w[some]))
                count += len(held[-1][0])
                if count > GATHERED:
                    held = [greatest()]
                    count = len(held[0][0])
                    if count > GATHERED // 2:
                        yield handed(*held.pop())
                        count = 0
        if held:
            yield handed(*greatest())

    return bands.mapInArrow(run, "cx int, cz int, w double").groupBy("cx", "cz").agg(F.max("w").alias("w"))


def uncovered(reference: DataFrame, coverage: DataFrame) -> DataFrame:
    """Cells (cx, cz) of a reference mask that a coverage mask doesn't hold."""
    return reference.select("cx", "cz").distinct().join(coverage.select("cx", "cz"), ["cx", "cz"], "left_anti")


def roughness(vertices: DataFrame, by: list[str]) -> DataFrame:
    """by, n, rms_before, rms_after, most_before: how far vertices (w, ground, before, after) on the mask's inner half (w over 0.5) lie from the
    ground; and extent: the range of all vertices' heights before."""
    on = F.col("w") > 0.5
    rms = lambda c: F.sqrt(F.avg(F.when(on, F.pow(F.col(c) - F.col("ground"), 2))))
    most = F.max(F.when(on, F.abs(F.col("before") - F.col("ground"))))
    return vertices.groupBy(*by).agg(F.count_if(on).alias("n"), rms("before").alias("rms_before"), rms("after").alias("rms_after"), most.alias("most_before"), (F.max("before") - F.min("before")).alias("extent"))


def feature_counts(features: DataFrame, by: list[str]) -> DataFrame:
    """by, total, a count of each kind, and points, lines, polygons of features (kind, n_points, closed)."""
    kinds = [F.count_if(F.col("kind") == k).alias(name) for k, name in (("road", "roads"), ("building", "buildings"), ("water", "water"), ("vegetation", "vegetation"), ("landuse", "landuse"))]
    point, ring = F.coalesce("n_points", F.lit(0)) <= 1, F.coalesce("closed", F.lit(False))
    return features.groupBy(*by).agg(F.count("*").alias("total"), *kinds, F.count_if(point).alias("points"), F.count_if(~point & ring).alias("polygons"), F.count_if(~point & ~ring).alias("lines"))


# fixed values: least and, in median deviations, relative height by which a sample stands out of its neighbours; heights beyond
# which one always does
SPIKE, SPIKE_TIMES, ABSURD = 8.0, 6, 12000


def guarded(points: DataFrame, rasters: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """points (keys, tile, u, v: shares of a tile's width and height) with h of rasters (tile, y, x, h), held to the tile's edges: the sample
    between four cells, or, if it stands out of its eight neighbours a cell around it, their upper median.  keys tell points apart."""
    side = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)])).alias("o")
    p = points.select(*keys, "tile", "u", "v", side)
    px = clamp(clamp(F.col("u") + F.col("o.i") / max(8, width - 1), 0.0, 1.0) * (width - 1), 0.0, width - 1.0)
    py = clamp(clamp(F.col("v") + F.col("o.j") / max(8, height - 1), 0.0, 1.0) * (height - 1), 0.0, height - 1.0)
    own = F.when((F.col("o.i") == 0) & (F.col("o.j") == 0), F.lit(True)).otherwise(F.lit(False))
    # the middle sample isn't one of its neighbours: it is taken at u, v themselves, within the raster
    mid = lambda c, n: clamp(F.col(c) * (n - 1), 0.0, n - 1.0)
    p = p.withColumn("own", own).withColumn("px", F.when(own, mid("u", width)).otherwise(px)).withColumn("py", F.when(own, mid("v", height)).otherwise(py))
    got = sampled(p.select(*keys, "tile", "own", "px", "py"), rasters, ["tile"]).groupBy(*keys).agg(F.max(F.when(F.col("own"), F.col("h"))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("own"), F.col("h")))).alias("near"))
    upper = lambda a: F.try_element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))
    got = got.withColumn("m", upper(F.col("near")))
    far = F.array_sort(F.transform("near", lambda x: F.abs(x - F.col("m"))))
    odd = (F.abs("c") > ABSURD) | (F.abs(F.col("c") - F.col("m")) > F.greatest(F.lit(SPIKE), upper(far) * SPIKE_TIMES))
    return got.select(*keys, F.when((F.size("near") >= 5) & odd, F.col("m")).otherwise(F.col("c")).alias("h"))


def seam_heights(places: DataFrame, rasters: DataFrame, width: int, height: int, flat: float = 0.0) -> DataFrame:
    """places (id, scene, tile, ox, oz, x, z, missing) with seam and blended.  x, z: a place beside the scene, in scene units; tile: the raster it
    lies in, ox and oz scenes off; scene: the raster of the scene itself; missing: the tile's share of missing cells; rasters (tile, y, x, h) of
    width by height cells, a hole at its raster's least height.

    seam is the mean of the scene's heights at eleven taps along its edge, at the edge's point nearest to the place.  The place's own
    height (see `guarded`) is moved by the seam's error - seam less the tile's own height at that point - in full at the seam and less
    with the distance, not at all beyond SEAM_WIDTH of the scene.  A tile that misses more than FLAT_SHARE is flat ground that meets the seam."""
    from geoloom.functions.scalars import smoothstep

    whole = rasters.join(rasters.groupBy("tile").agg(F.min("h").alias("_least")), "tile").select("tile", "y", "x", F.coalesce("h", "_least").alias("h"))
    p = places.withColumn("s", frames.seam_point(F.col("x"), F.col("z")))
    tap = F.explode(F.sequence(F.lit(0), F.lit(frames.SEAM_TAPS - 1))).alias("k")
    step = (F.col("k") / (frames.SEAM_TAPS - 1) - 0.5) * (2 * SCENE / frames.SEAM_STEPS)
    at = lambda v, n: clamp((v + SCENE / 2) / SCENE * (n - 1), 0.0, n - 1.0)
    taps = p.select("id", F.col("scene").alias("tile"), "s", tap)
    taps = taps.withColumn("px", at(F.col("s.x") + F.when(F.col("s.along_x"), step).otherwise(0.0), width)).withColumn("py", at(F.col("s.z") + F.when(~F.col("s.along_x"), step).otherwise(0.0), height))
    seam = sampled(taps.select("id", "tile", "px", "py"), whole, ["tile"]).groupBy("id").agg(F.avg("h").alias("seam"))
    share = lambda v, o: (v - F.col(o) * SCENE + SCENE / 2) / SCENE
    asked = p.select("id", "tile", F.explode(F.array(F.struct(F.lit("edge").alias("at"), share(F.col("s.x"), "ox").alias("u"), share(F.col("s.z"), "oz").alias("v")), F.struct(F.lit("own").alias("at"), share(F.col("x"), "ox").alias("u"), share(F.col("z"), "oz").alias("v")))).alias("q")).select("id", "tile", "q.*")
    own = guarded(asked, whole, ["id", "at"], width, height).groupBy("id").agg(F.max(F.when(F.col("at") == "edge", F.col("h"))).alias("edge"), F.max(F.when(F.col("at") == "own", F.col("h"))).alias("h"))
    p = p.join(seam, "id").join(own, "id", "left").withColumn("distance", F.col("s.distance"))
    fade = smoothstep(F.col("distance") / SCENE)
    near = smoothstep((F.col("distance") - 0.5) / (SCENE * frames.SEAM_WIDTH - 0.5))
    level = F.col("seam") * (1 - fade) + F.lit(flat) * fade
    return p.withColumn("blended", F.when((F.col("missing") > frames.FLAT_SHARE) | F.col("h").isNull(), level).otherwise(F.col("h") + (F.col("seam") - F.col("edge")) * (1 - near))).drop("s")


def sampled_pixels(points: DataFrame, image: DataFrame, zoom: int, tile_x: int, tile_y: int, width: int, height: int) -> DataFrame:
    """points (lat, lng) with r, g, b, a of the pixel of a Web Mercator image (y, x, r, g, b, a; its first tile at a zoom) that they lie
    in; opaque black beyond the image."""
    from geoloom.functions.crs import mercator_sql

    px, py = mercator_sql("lat", "lng", zoom)
    p = points.withColumn("_x", (F.floor(F.expr(px)) - tile_x * 256).cast("long")).withColumn("_y", (F.floor(F.expr(py)) - tile_y * 256).cast("long"))
    own = image.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), *[F.col(c).alias(f"_{c}") for c in "rgba"])
    joined = p.join(own, ["_y", "_x"], "left")
    return joined.select(*points.columns, *[F.coalesce(f"_{c}", F.lit(255 if c == "a" else 0)).alias(c) for c in "rgba"])


def resampled_image(targets: DataFrame, image: DataFrame, zoom: int, tile_x: int, tile_y: int, width: int, height: int) -> DataFrame:
    """id, y, x, r, g, b, a of all cells of targets (see target_cells) from a Web Mercator image."""
    return sampled_pixels(target_cells(targets), image, zoom, tile_x, tile_y, width, height).drop("lat", "lng")
