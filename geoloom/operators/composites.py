"""One raster of a whole route: tiles of unlike places and resolutions laid over one another in a square frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.scalars import clamp

from .fields import sampled

# fixed values: metres of a degree of latitude, metres of a cell, greatest and least side of the frame in cells, colour of what no tile covers
DEGREE_M, CELL_M, MOST_SIDE, LEAST_SIDE, EARTH = 111320.0, 2.0, 4096, 256, (74, 74, 66)
_FRAME = ("north", "south", "east", "west", "width", "height")


def _tiles(tiles: DataFrame) -> DataFrame:
    """One row a tile (route, ord) with its frame and least height."""
    return tiles.groupBy("route", "ord").agg(*[F.first(c, ignorenulls=True).alias(c) for c in _FRAME], F.coalesce(F.min("h"), F.lit(0.0)).alias("least"))


def route_frames(tiles: DataFrame, cell_m: float = CELL_M, most: int = MOST_SIDE, least: int = LEAST_SIDE) -> DataFrame:
    """route, north, south, east, west, size, metres_per_cell, floor: the square around the union of a route's tiles (route, ord, north, south, east,
    west and heights h), at least a metre wide; size: the power of two nearest to its side in cells of cell_m, held to least and most before; floor: the
    least height of any tile."""
    u = tiles.groupBy("route").agg(F.max("north").alias("n"), F.min("south").alias("s"), F.max("east").alias("e"), F.min("west").alias("w"), F.min("h").alias("floor"))
    u = u.withColumn("lat", (F.col("n") + F.col("s")) / 2).withColumn("lng", (F.col("e") + F.col("w")) / 2)
    u = u.withColumn("m", F.cos(F.radians("lat")) * DEGREE_M)
    u = u.withColumn("side", F.greatest((F.col("e") - F.col("w")) * F.col("m"), (F.col("n") - F.col("s")) * DEGREE_M, F.lit(1.0)))
    cells = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.floor(F.col("side") / cell_m + 0.5)))
    size = F.pow(F.lit(2.0), F.floor(F.log2(cells) + 0.5)).cast("int")
    lat, lng = F.col("side") / 2 / DEGREE_M, F.col("side") / 2 / F.col("m")
    u = u.withColumn("size", size)
    return u.select("route", (F.col("lat") + lat).alias("north"), (F.col("lat") - lat).alias("south"), (F.col("lng") + lng).alias("east"), (F.col("lng") - lng).alias("west"), "size", (F.col("side") / F.col("size")).alias("metres_per_cell"), F.coalesce("floor", F.lit(0.0)).alias("floor"))


def _met(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """route, ord, gy, gx, px, py: the frame's cells whose point a tile holds, edges included, each tile looked at only where it lies, with the place in
    the tile's cells."""
    names = ("north", "south", "east", "west")
    t = tiles.join(frames.select("route", "size", *[F.col(c).alias(f"f_{c}") for c in names]), "route")
    wide, high, last = F.col("f_east") - F.col("f_west"), F.col("f_north") - F.col("f_south"), F.col("size") - 1
    cells = lambda a, b: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(a * last)).cast("int"), F.least(last, F.ceil(b * last)).cast("int")))
    t = t.withColumn("gy", cells((F.col("f_north") - F.col("north")) / high, (F.col("f_north") - F.col("south")) / high))
    t = t.withColumn("gx", cells((F.col("west") - F.col("f_west")) / wide, (F.col("east") - F.col("f_west")) / wide))
    t = t.withColumn("lat", F.col("f_north") - F.col("gy") / last * high).withColumn("lng", F.col("f_west") + F.col("gx") / last * wide)
    t = t.where("lat between south and north and lng between west and east")
    px = clamp((F.col("lng") - F.col("west")) / (F.col("east") - F.col("west")) * (F.col("width") - 1), 0.0, F.col("width") - 1.0)
    py = clamp((F.col("north") - F.col("lat")) / (F.col("north") - F.col("south")) * (F.col("height") - 1), 0.0, F.col("height") - 1.0)
    return t.select("route", "ord", "gy", "gx", px.alias("px"), py.alias("py"))


def _grid(frames: DataFrame) -> DataFrame:
    """route, y, x of all cells of the frames."""
    line = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    return frames.select("route", "size", line.alias("y")).select("route", "y", line.alias("x"))


def route_composite(tiles: DataFrame, cell_m: float = CELL_M, most: int = MOST_SIDE, least: int = LEAST_SIDE) -> tuple[DataFrame, DataFrame]:
    """(route, y, x, h) of all cells of the routes' frames, and the frames with lowest and highest.  tiles: cells (route, ord, y, x, h) with the tile's
    north, south, east, west, width and height on each.  A cell takes the height of the last tile, by ord, that holds its point, sampled between the
    tile's four cells (a hole counts as the tile's least height); one that none holds lies at the frame's floor.  lowest and highest are over the
    floor and every sample, also one that a later tile covers."""
    each, frames = _tiles(tiles), route_frames(tiles, cell_m, most, least)
    whole = tiles.join(each.select("route", "ord", "least"), ["route", "ord"]).select("route", "ord", "y", "x", F.coalesce("h", "least").alias("h"))
    got = sampled(_met(each, frames), whole, ["route", "ord"]).where("h is not null")
    top = got.groupBy("route", F.col("gy").alias("y"), F.col("gx").alias("x")).agg(F.max_by("h", "ord").alias("h"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    cells = _grid(frames).join(top.select("route", "y", "x", "h"), ["route", "y", "x"], "left").join(frames.select("route", "floor"), "route")
    ends = top.groupBy("route").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    about = frames.join(ends, "route", "left").withColumn("lowest", F.least("floor", F.coalesce("lo", "floor"))).withColumn("highest", F.greatest("floor", F.coalesce("hi", "floor"))).drop("lo", "hi")
    return cells.select("route", "y", "x", F.coalesce("h", "floor").alias("h")), about


def route_texture(tiles: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """route, y, x, r, g, b of `size` by `size` pixels over the frames (route, north, south, east, west) from tiles of pixels (route, ord, y, x, r, g, b and
    the tile's frame): the pixel of the last tile, by ord, that the middle of the target pixel falls into; earth where there is none."""
    each = tiles.groupBy("route", "ord").agg(*[F.first(c, ignorenulls=True).alias(c) for c in _FRAME])
    names = ("north", "south", "east", "west")
    t = each.join(frames.select("route", *[F.col(c).alias(f"f_{c}") for c in names]), "route")
    wide, high = F.col("f_east") - F.col("f_west"), F.col("f_north") - F.col("f_south")
    x0, x1 = ((F.col(c) - F.col("f_west")) / wide * size for c in ("west", "east"))
    y0, y1 = ((F.col("f_north") - F.col(c)) / high * size for c in ("north", "south"))
    t = t.withColumn("x0", x0).withColumn("x1", x1).withColumn("y0", y0).withColumn("y1", y1)
    pixels = lambda a, b: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col(a) - 0.5)).cast("int"), F.least(F.lit(size - 1), F.ceil(F.col(b) - 0.5) - 1).cast("int")))
    first, last = lambda a: F.greatest(F.lit(0), F.ceil(F.col(a) - 0.5)), lambda b: F.least(F.lit(size - 1), F.ceil(F.col(b) - 0.5) - 1)
    t = t.where((first("x0") <= last("x1")) & (first("y0") <= last("y1"))).withColumn("gy", pixels("y0", "y1")).withColumn("gx", pixels("x0", "x1"))
    of = lambda g, a, b, n: F.least(F.col(n) - 1, F.floor((F.col(g) + 0.5 - F.col(a)) / (F.col(b) - F.col(a)) * F.col(n))).cast("long")
    want = t.select("route", "ord", "gy", "gx", of("gy", "y0", "y1", "height").alias("y"), of("gx", "x0", "x1", "width").alias("x"))
    own = tiles.select("route", "ord", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.struct("r", "g", "b").alias("rgb"))
    top = want.join(own, ["route", "ord", "y", "x"]).groupBy("route", F.col("gy").alias("y"), F.col("gx").alias("x")).agg(F.max_by("rgb", "ord").alias("rgb"))
    grid = _grid(frames.select("route", F.lit(size).alias("size")))
    return grid.join(top, ["route", "y", "x"], "left").select("route", "y", "x", *[F.coalesce(F.col(f"rgb.{c}"), F.lit(v)).alias(c) for c, v in zip("rgb", EARTH)])
