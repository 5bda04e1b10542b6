"""Rasters of several coordinate systems: affine grids with a code each, sampled at places given in degrees.

A tile is met by places through squares of degrees that its bounds touch, a place is projected into a tile's system only where it may lie in it,
and of the tiles that know it the first counts: systems in the order of their first tile, tiles of one system in their own order."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import crs

from .fields import between, quads
from .shared import sent_if_small, table

# fixed values: transverse Mercator systems with a code of their own (latitude and longitude of origin, scale, easting, northing); radius
# of the sphere of Web Mercator
SYSTEMS = {2180: (0.0, 19.0, 0.9993, 500000.0, -5300000.0)}
RADIUS = 6378137.0
#: Degrees of a square; share of a tile's extent by which its bounds in degrees are widened, as its edges are curves there.
SQUARE, MARGIN = 0.05, 0.02
#: Tiles of a square that the first round asks.
TILES = 16


def known_system(code: Column, systems: dict[int, tuple] = SYSTEMS) -> Column:
    """Whether places can be projected into the system of a code; null stands for degrees."""
    c = F.coalesce(code, F.lit(4326))
    return c.isin(4326, 3857, *systems) | c.between(32601, 32660) | c.between(32701, 32760)


def _parameters(code: str, systems: dict[int, tuple]) -> Column:
    """struct(mid, k, x0, y0) of a transverse Mercator code: central meridian, scale, and what is added to metres from the equator."""
    of = lambda mid, k, x0, y0: F.struct(mid.cast("double").alias("mid"), k.cast("double").alias("k"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"))
    c = F.col(code)
    utm = c.between(32601, 32660) | c.between(32701, 32760)
    out = F.when(utm, of(c % 100 * 6 - 183, F.lit(0.9996), F.lit(500000.0), F.when(c > 32700, 10000000.0).otherwise(0.0)))
    for number, (lat0, mid, k, x0, y0) in systems.items():
        out = out.when(c == number, of(F.lit(mid), F.lit(k), F.lit(x0), F.lit(y0 - k * crs._northing(lat0))))
    return out


def _series(start: str, rows, of_xi, of_eta, sign: int = 1) -> Column:
    """A Krueger series over the columns _xi and _eta, by its coefficients of both."""
    out = F.col(start)
    for j, a in enumerate(crs._terms(rows), 1):
        out = out + sign * a * of_xi(2 * j * F.col("_xi")) * of_eta(2 * j * F.col("_eta"))
    return out


def projected(places: DataFrame, systems: dict[int, tuple] = SYSTEMS) -> DataFrame:
    """places (lat, lng, code) with x and y in the system of their code; null for an unknown one.  A null code stands for degrees."""
    p = places.withColumn("_m", _parameters("code", systems))
    p = p.withColumn("_k", F.coalesce("_m.k", F.lit(1.0))).withColumn("_l0", F.coalesce("_m.mid", "lng"))
    # one step a column, so that none is worked out for each of its uses
    s, dl = F.sin(F.radians("lat")), F.radians(F.col("lng") - F.col("_l0"))
    p = p.withColumn("_t", F.sinh(F.atanh(s) - crs._E * F.atanh(crs._E * s))).withColumn("_d", dl)
    p = p.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_d"))).withColumn("_eta", F.atanh(F.sin("_d") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
    p = p.withColumn("_n", _series("_xi", crs._ALPHA, F.sin, F.cosh) * crs._RECT).withColumn("_e", _series("_eta", crs._ALPHA, F.cos, F.sinh) * crs._RECT)
    degrees, sphere = F.col("code").isNull() | (F.col("code") == 4326), F.col("code") == 3857
    x = F.when(degrees, F.col("lng")).when(sphere, F.radians("lng") * RADIUS).otherwise(F.col("_m.x0") + F.col("_k") * F.col("_e"))
    y = F.when(degrees, F.col("lat")).when(sphere, F.log(F.tan(F.lit(math.pi / 4) + F.radians("lat") / 2)) * RADIUS).otherwise(F.col("_m.y0") + F.col("_k") * F.col("_n"))
    return p.withColumn("x", x).withColumn("y", y).drop("_m", "_k", "_l0", "_t", "_d", "_xi", "_eta", "_e", "_n")


def unprojected(places: DataFrame, systems: dict[int, tuple] = SYSTEMS) -> DataFrame:
    """places (x, y, code) with lat and lng; null for an unknown code."""
    p = places.withColumn("_m", _parameters("code", systems))
    p = p.withColumn("_e", (F.col("x") - F.col("_m.x0")) / F.col("_m.k")).withColumn("_n", (F.col("y") - F.col("_m.y0")) / F.col("_m.k")).withColumn("_l0", F.col("_m.mid"))
    p = p.withColumn("_xi", F.col("_n") / crs._RECT).withColumn("_eta", F.col("_e") / crs._RECT)
    p = p.withColumn("_xi1", _series("_xi", crs._BETA, F.sin, F.cosh, -1)).withColumn("_eta1", _series("_eta", crs._BETA, F.cos, F.sinh, -1))
    p = p.withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    lat = F.col("_chi")
    for j, d in enumerate(crs._terms(crs._DELTA), 1):
        lat = lat + d * F.sin(2 * j * F.col("_chi"))
    p = p.withColumn("_lat", F.degrees(lat)).withColumn("_lng", F.col("_l0") + F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))))
    degrees, sphere = F.col("code").isNull() | (F.col("code") == 4326), F.col("code") == 3857
    lat = F.when(degrees, F.col("y")).when(sphere, F.degrees(2 * F.atan(F.exp(F.col("y") / RADIUS)) - math.pi / 2)).otherwise(F.col("_lat"))
    lng = F.when(degrees, F.col("x")).when(sphere, F.degrees(F.col("x") / RADIUS)).otherwise(F.col("_lng"))
    return p.withColumn("lat", lat).withColumn("lng", lng).drop("_m", "_e", "_n", "_l0", "_xi", "_eta", "_xi1", "_eta1", "_chi", "_lat", "_lng")


def degree_bounds(tiles: DataFrame, systems: dict[int, tuple] = SYSTEMS) -> DataFrame:
    """tiles (tile, origin_x, origin_y, step_x, step_y, width, height, code) with bounds (north, south, east, west in degrees) of their corners and
    centre (lat, lng); null where the code is unknown."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5))])).alias("at")
    p = tiles.select("tile", "code", "origin_x", "origin_y", "step_x", "step_y", "width", "height", at)
    p = p.select("tile", "code", "at", (F.col("origin_x") + F.col("step_x") * F.col("width") * F.col("at.i")).alias("x"), (F.col("origin_y") + F.col("step_y") * F.col("height") * F.col("at.j")).alias("y"))
    middle = F.col("at.i") == 0.5
    side = lambda pick, c: pick(F.when(~middle, F.col(c)))
    found = unprojected(p, systems).groupBy("tile").agg(side(F.max, "lat").alias("n"), side(F.min, "lat").alias("s"), side(F.max, "lng").alias("e"), side(F.min, "lng").alias("w"), F.max(F.when(middle, F.col("lat"))).alias("lat"), F.max(F.when(middle, F.col("lng"))).alias("lng"))
    bounds = F.when(F.col("n").isNotNull(), F.struct(F.col("n").alias("north"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("w").alias("west")))
    return tiles.join(found.select("tile", bounds.alias("bounds"), "lat", "lng"), "tile")


def sampled_across(places: DataFrame, tiles: DataFrame, cells: DataFrame, systems: dict[int, tuple] = SYSTEMS) -> DataFrame:
    """places (id, lat, lng) with h and tile: the height of the first tile that knows it, between its four cells, and that tile; null where none does.

    tiles (tile, ord, code, origin_x, origin_y, step_x, step_y, width, height): the corner of the first cell, steps of a column and a row in
    the code's units; a null code stands for degrees, tiles of unknown codes are left out.  cells (tile, y, x, h).  A place lies in a tile if
    its column is from 0 to less than width - 1 and its row likewise; a hole with weight around it makes the tile not know it.

    The tiles of a square are numbered in their order.  A round asks the next of them, TILES at first and four times as many each time, and only
    places that no tile has known yet go on, so a place isn't sampled in all tiles that lie over one another."""
    first = tiles.groupBy(F.coalesce("code", F.lit(4326)).alias("_code")).agg(F.min("ord").alias("_first"))  # one row a system
    t = tiles.where(known_system(F.col("code"), systems)).join(F.broadcast(first), F.coalesce("code", F.lit(4326)) == F.col("_code"))
    t = degree_bounds(t, systems)
    pad = lambda a, b: (F.col(f"bounds.{a}") - F.col(f"bounds.{b}")) * MARGIN + 1e-6
    square = lambda lo, hi, p: F.explode(F.sequence(F.floor((F.col(f"bounds.{lo}") - p) / SQUARE).cast("long"), F.floor((F.col(f"bounds.{hi}") + p) / SQUARE).cast("long")))
    in_square = Window.partitionBy("_qy", "_qx").orderBy("_first", "ord", "tile")
    t = t.drop("lat", "lng").withColumn("_qy", square("south", "north", pad("north", "south"))).withColumn("_qx", square("west", "east", pad("east", "west"))).withColumn("_n", F.row_number().over(in_square) - 1)
    t = table(t.select("_qy", "_qx", "_code", "_n", "tile", "_first", "ord", "origin_x", "origin_y", "step_x", "step_y", "width", "height"), "tiles")
    # the systems of a square, each with its last tile's number there: a place is projected once a system, not once a tile
    here = table(t.groupBy("_qy", "_qx", "_code").agg(F.max("_n").alias("_last")), "systems")
    p = places.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.floor(F.col("lat") / SQUARE).cast("long").alias("_qy"), F.floor(F.col("lng") / SQUARE).cast("long").alias("_qx"))
    p = projected(p.join(sent_if_small(here), ["_qy", "_qx"]).withColumnRenamed("_code", "code"), systems)
    left = table(p.select("id", "_qy", "_qx", F.col("code").alias("_code"), "_last", "x", "y"), "asking")
    corners = table(quads(cells.select("tile", "y", "x", "h"), ["tile"]), "corners")
    found, at, many = [], 0, TILES
    while left.limit(1).count():
        some = table(t.where(F.col("_n").between(at, at + many - 1)), "some")
        met = left.join(sent_if_small(some), ["_qy", "_qx", "_code"])
        # an array of one or no place: a filter would be moved below the projection, with a copy of it for each of its terms
        px, py = (F.col("x") - F.col("origin_x")) / F.col("step_x"), (F.col("y") - F.col("origin_y")) / F.col("step_y")
        place = F.filter(F.array(F.struct(px.alias("px"), py.alias("py"))), lambda q: (q["px"] >= 0) & (q["px"] < F.col("width") - 1) & (q["py"] >= 0) & (q["py"] < F.col("height") - 1))
        met = met.select("id", "tile", "_first", "ord", F.explode(place).alias("q")).select("id", "tile", "q.px", "q.py", F.struct("_first", "ord", "tile").alias("_rank"))
        got = between(met, corners, ["tile"]).where("h is not null")
        found.append(table(got.groupBy("id").agg(F.min_by(F.struct("h", "tile"), "_rank").alias("b")), "found"))
        at, many = at + many, many * 4
        left = table(left.where(F.col("_last") >= at).join(found[-1].select("id"), "id", "left_anti"), "asking")
    best = reduce(DataFrame.unionByName, found) if found else None
    if best is None:
        return places.select("*", F.lit(None).cast(cells.schema["h"].dataType).alias("h"), F.lit(None).cast(tiles.schema["tile"].dataType).alias("tile"))
    return places.join(best, "id", "left").select(*places.columns, F.col("b.h").alias("h"), F.col("b.tile").alias("tile"))
