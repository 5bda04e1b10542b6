"""Frames of a terrain as column expressions: bounds in degrees, raster pixels, scene units, plane pixels.

Bounds are structs of north, south, east and west in degrees; points are structs of lat and lng."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .crs import DEGREE_M, normalize_lng, square_bounds
from .scalars import clamp, js_round, round_to

# fixed values: side of the scene, metres of a degree of latitude in estimates, sizes of uploads, steps to the eight neighbours
SCENE, DEGREE_LAT_M = 100.0, 110574.0
SIZES = (512, 1024, 2048, 4096, 8192, 16384)
NEIGHBOURS = {"NW": (1, -1), "N": (1, 0), "NE": (1, 1), "W": (0, -1), "E": (0, 1), "SW": (-1, -1), "S": (-1, 0), "SE": (-1, 1)}
_SIDES = ("north", "south", "east", "west")


def bounds(north, south, east, west) -> Column:
    return F.struct(*[v.alias(k) for k, v in zip(_SIDES, (north, south, east, west))])


def centre(b: Column) -> Column:
    return F.struct(((b["north"] + b["south"]) / 2).alias("lat"), ((b["east"] + b["west"]) / 2).alias("lng"))


def width_m(b: Column) -> Column:
    """Metres from west to east at the middle latitude."""
    return (b["east"] - b["west"]) * DEGREE_M * F.cos(F.radians((b["north"] + b["south"]) / 2))


def units_per_metre(b: Column) -> Column:
    return SCENE / width_m(b)


def square_size(b: Column, width: Column, given: Column | None = None) -> Column:
    """Metres of a raster's cell to two places: as given if positive, else by the width of its bounds."""
    derived = round_to(width_m(b) / width, 2)
    return derived if given is None else F.when(given > 0, round_to(given, 2)).otherwise(derived)


def metres_per_pixel(b: Column, width: Column, given: Column | None = None) -> Column:
    """Mean of both extents over the width, at least a centimetre; 1 without bounds."""
    tall = F.abs(b["north"] - b["south"]) * DEGREE_LAT_M
    derived = F.coalesce(F.greatest(F.lit(0.01), (F.abs(width_m(b)) + tall) / 2 / F.nullif(width, F.lit(0))), F.lit(1.0))
    return derived if given is None else F.when(given > 0, given).otherwise(derived)


def coverage_summary(b: Column) -> Column:
    """struct(width, height, resolution, metres): native pixels of a metre, the largest upload size that fits the smaller
    extent's power of two, and the greater metres a pixel."""
    wide, tall = F.abs(width_m(b)), F.abs(b["north"] - b["south"]) * DEGREE_M
    w, h = F.greatest(F.lit(1), js_round(wide)), F.greatest(F.lit(1), js_round(tall))
    least = F.greatest(F.lit(1.0), F.least(wide, tall))
    size = F.lit(SIZES[0])
    for s in SIZES[1:]:
        size = F.when(least >= s, s).otherwise(size)
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"), size.alias("resolution"), F.greatest(wide / w, tall / h).alias("metres"))


def neighbour_bounds(b: Column, place: Column) -> Column:
    """Bounds moved by their own span towards a compass place; null for any other place."""
    step = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in NEIGHBOURS.items() for x in (k, float(v[i]))]), place)
    up, right = step(0) * (b["north"] - b["south"]), step(1) * (b["east"] - b["west"])
    return F.when(place.isin(*NEIGHBOURS), bounds(b["north"] + up, b["south"] + up, b["east"] + right, b["west"] + right))


def slid_into(chosen: Column, cover: Column) -> Column:
    """Bounds moved so that they lie in a cover; one that is as wide or tall becomes the cover; without one they stay."""
    tall, wide = chosen["north"] - chosen["south"], chosen["east"] - chosen["west"]
    south = F.least(F.greatest(chosen["south"], cover["south"]), cover["north"] - tall)
    west = F.least(F.greatest(chosen["west"], cover["west"]), cover["east"] - wide)
    large = (tall >= cover["north"] - cover["south"]) | (wide >= cover["east"] - cover["west"])
    moved = bounds(F.least(south + tall, cover["north"]), F.greatest(south, cover["south"]), F.least(west + wide, cover["east"]), F.greatest(west, cover["west"]))
    return F.when(cover.isNull(), chosen).when(large, bounds(*[cover[k] for k in _SIDES])).otherwise(moved)


def crop_bounds(lat: Column, lng: Column, size_m: Column, cover: Column) -> Column:
    """A square around a point, moved into a cover."""
    return slid_into(square_bounds(lat, lng, size_m), cover)


def cropped_bounds(b: Column, width: Column, height: Column, x: Column, y: Column, size: Column) -> Column:
    """Bounds of a square of pixels, x from the west and y from the north."""
    dx, dy = (b["east"] - b["west"]) / width, (b["north"] - b["south"]) / height
    return bounds(b["north"] - y * dy, b["north"] - (y + size) * dy, b["west"] + (x + size) * dx, b["west"] + x * dx)


def held_point(lat: Column, lng: Column, b: Column) -> Column:
    """A point moved to the nearest place in bounds."""
    return F.struct(F.greatest(b["south"], F.least(b["north"], lat)).alias("lat"), F.greatest(b["west"], F.least(b["east"], lng)).alias("lng"))


def pixel_point(x: Column, y: Column, width: Column, height: Column, b: Column) -> Column:
    """The point of a raster's pixel: corners are the first and last pixels; bounds may cross the date line."""
    share = lambda i, n: F.when(n > 1, i / (n - 1)).otherwise(0.5)
    span = b["east"] - b["west"]
    span = F.when(span > 180, span - 360).when(span < -180, span + 360).otherwise(span)
    return F.struct((b["north"] - share(y, height) * (b["north"] - b["south"])).alias("lat"), normalize_lng(b["west"] + share(x, width) * span).alias("lng"))


def south_west_pixel(lat: Column, lng: Column, b: Column, size: Column) -> Column:
    """struct(px, py): the rounded pixel of a point counted from the south-west, held to the raster."""
    at = lambda v, lo, hi: F.greatest(F.lit(0), F.least(size - 1, js_round((v - lo) / (hi - lo) * (size - 1)))).cast("int")
    return F.struct(at(lng, b["west"], b["east"]).alias("px"), at(lat, b["south"], b["north"]).alias("py"))


def scene_position(px: Column, py: Column, width: Column, height: Column) -> Column:
    """struct(x, z): scene units from the middle of a raster of pixels px, py."""
    return F.struct((px / (width - 1) * SCENE - SCENE / 2).alias("x"), (py / (height - 1) * SCENE - SCENE / 2).alias("z"))


def world_position(lat: Column, lng: Column, b: Column, side: Column) -> Column:
    """struct(x, y, u, v): metres east and north of the middle to one place, and the shares from the west and north."""
    u = clamp((lng - b["west"]) / (b["east"] - b["west"]), 0.0, 1.0)
    v = clamp((b["north"] - lat) / (b["north"] - b["south"]), 0.0, 1.0)
    return F.struct(round_to((u - 0.5) * side, 1).alias("x"), round_to((0.5 - v) * side, 1).alias("y"), u.alias("u"), v.alias("v"))


def yaw_matrix(yaw: Column) -> Column:
    """Nine entries, row by row, of a turn around the vertical, to six places."""
    c, s = round_to(F.cos(yaw), 6), round_to(F.sin(yaw), 6)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, s, zero, -s, c, zero, zero, zero, one)


def plane_frame(b: Column, per_metre: float, padding: float) -> Column:
    """struct(width, height): pixels of a plane's rectangle (min_x, max_x, min_y, max_y) with padding on all sides."""
    size = lambda lo, hi: F.ceil((b[hi] - b[lo]) * per_metre) + 2 * padding
    return F.struct(size("min_x", "max_x").alias("width"), size("min_y", "max_y").alias("height"))


def plane_pixel(x: Column, y: Column, b: Column, per_metre: float, padding: float) -> Column:
    return F.struct(((x - b["min_x"]) * per_metre + padding).alias("u"), ((b["max_y"] - y) * per_metre + padding).alias("v"))


def plane_point(u: Column, v: Column, b: Column, per_metre: float, padding: float) -> Column:
    return F.struct(((u - padding) / per_metre + b["min_x"]).alias("x"), (b["max_y"] - (v - padding) / per_metre).alias("y"))


def unit_vector(dx: Column, dy: Column, least: float = 1e-6, still: tuple[float, float] = (0.0, 0.0)) -> Column:
    """struct(x, y) of length 1; `still` for a shorter one than `least`."""
    n = F.hypot(dx, dy)
    part = lambda d, s: F.when(n < least, F.lit(s)).otherwise(d / n)
    return F.struct(part(dx, still[0]).alias("x"), part(dy, still[1]).alias("y"))


def turn_degrees(a: Column, b: Column, c: Column) -> Column:
    """The change of direction at b on the way from a to c (structs x, y); a right angle where an edge has no length."""
    v, w = unit_vector(b["x"] - a["x"], b["y"] - a["y"]), unit_vector(c["x"] - b["x"], c["y"] - b["y"])
    return F.degrees(F.acos(clamp(v["x"] * w["x"] + v["y"] * w["y"], -1.0, 1.0)))


def seeded_share(seed: Column) -> Column:
    """A number from 0 to below 1 that follows from a seed; the last bits depend on the sine at hand."""
    v = F.sin(seed * 12.9898) * 43758.5453123
    return v - F.floor(v)


def jittered(lat: Column, lng: Column, metres: Column, seed: Column) -> Column:
    """A point moved by at most so many metres in a direction, both of them by the seed."""
    angle, far = seeded_share(seed + 0.17) * (2 * math.pi), seeded_share(seed + 0.31) * F.greatest(F.coalesce(metres, F.lit(0.0)), F.lit(0.0))
    wide = DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return F.struct((lat + F.sin(angle) * far / DEGREE_M).alias("lat"), (lng + F.cos(angle) * far / wide).alias("lng"))


def grown_polygon(ring: Column, by: float) -> Column:
    """A polygon's points (structs x, y) moved away from their mean; fewer than three stay as they are."""
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    cx, cy = mean("x"), mean("y")

    def moved(p: Column) -> Column:
        d = unit_vector(p["x"] - cx, p["y"] - cy)
        return F.struct((p["x"] + d["x"] * by).alias("x"), (p["y"] + d["y"] * by).alias("y"))

    return F.when(F.size(ring) < 3, ring).otherwise(F.transform(ring, moved))


def closed_ring(ring: Column, least: float = 1e-6) -> Column:
    """A ring (structs x, y) that ends where it starts; fewer than three points give none."""
    a, z = ring[0], F.element_at(ring, -1)
    open_ = (F.abs(a["x"] - z["x"]) > least) | (F.abs(a["y"] - z["y"]) > least)
    return F.when(F.size(ring) < 3, F.slice(ring, 1, 0)).when(open_, F.concat(ring, F.array(a))).otherwise(ring)


# fixed values: WGS84's axis and squared eccentricity; samples along a seam and the steps of its profile; shares of the scene over
# which a neighbour fades into the seam; share of missing cells beyond which it is taken for flat
AXIS, ECC2 = 6378137.0, 6.69437999014e-3
SEAM_TAPS, SEAM_STEPS, SEAM_WIDTH, FLAT_SHARE = 11, 768, 0.42, 0.25


def aoi_frame(b: Column) -> Column:
    """struct(metres_per_degree, width, height, extent, centre, up, east, north): sizes in metres and, earth-centred, the middle on the
    ellipsoid and the directions there; up is away from the earth's middle."""
    lat, lng = F.radians((b["north"] + b["south"]) / 2), F.radians((b["east"] + b["west"]) / 2)
    per = DEGREE_M * F.cos(lat)
    wide, tall = (b["east"] - b["west"]) * per, (b["north"] - b["south"]) * DEGREE_M
    n = AXIS / F.sqrt(1 - ECC2 * F.sin(lat) * F.sin(lat))
    x, y, z = n * F.cos(lat) * F.cos(lng), n * F.cos(lat) * F.sin(lng), n * (1 - ECC2) * F.sin(lat)
    size = F.sqrt(x * x + y * y + z * z)
    ux, uy, uz = x / size, y / size, z / size
    ex, ey = -F.sin(lng), F.cos(lng)
    return F.struct(per.alias("metres_per_degree"), wide.alias("width"), tall.alias("height"), F.greatest(wide, tall).alias("extent"), F.array(x, y, z).alias("centre"), F.array(ux, uy, uz).alias("up"), F.array(ex, ey, F.lit(0.0)).alias("east"), F.array(-uz * ey, uz * ex, ux * ey - uy * ex).alias("north"))


def height_map_place(lat: Column, lng: Column, b: Column, size: Column) -> Column:
    """struct(col, row): where a point lies on a square height map, row 0 in the north, between cells and held to it."""
    hold = lambda v: F.greatest(F.lit(0.0), F.least(size - 1.0, v))
    return F.struct(hold((lng - b["west"]) / (b["east"] - b["west"]) * (size - 1)).alias("col"), hold((size - 1) - (lat - b["south"]) / (b["north"] - b["south"]) * (size - 1)).alias("row"))


def seam_point(x: Column, z: Column) -> Column:
    """struct(x, z, distance, along_x): the scene's edge point nearest to a place around it, how far off that is, and whether
    the edge there runs along x."""
    sx, sz = clamp(x, -SCENE / 2, SCENE / 2), clamp(z, -SCENE / 2, SCENE / 2)
    return F.struct(sx.alias("x"), sz.alias("z"), F.hypot(x - sx, z - sz).alias("distance"), (F.abs(z - sz) > F.abs(x - sx)).alias("along_x"))


def sea_level(lowest: Column) -> Column:
    """The height of the sea in a level whose heights count from its lowest point, to three places."""
    return F.coalesce(F.when(~F.isnan(lowest), round_to(-lowest, 3)), F.lit(0.0))


def bake_key(version: int, b: Column, width: Column, height: Column, options: list[tuple[str, Column]], corridor: Column | None = None) -> Column:
    """The text that a bake's result is kept under: bounds to seven places, size and options in turn, and its corridor's key if it has one."""
    seven = F.concat_ws(",", *[F.format_string("%.7f", b[k]) for k in _SIDES])
    tail = [F.format_string(f"|{k}=%s", v.cast("string")) for k, v in options]
    own = F.coalesce(F.concat(F.lit("|corr="), corridor), F.lit("")) if corridor is not None else F.lit("")
    return F.concat(F.lit(f"v{version}|"), seven, F.lit("|"), width.cast("string"), F.lit("x"), height.cast("string"), *tail, own)
