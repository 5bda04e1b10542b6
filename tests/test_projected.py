"""Rasters of several coordinate systems against plain computations."""

import math

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import projected as pr
from geoloom.sources import text_grids

TILE = "tile int, ord int, code int, origin_x double, origin_y double, step_x double, step_y double, width int, height int"


def test_there_and_back(spark):
    rows = [(i, float(lat), float(lng), code) for i, (lat, lng, code) in enumerate([(52.1, 15.3, 32633), (-33.2, 151.0, 32756), (51.0, 19.0, 2180), (54.4, 14.2, 2180), (10.0, -170.5, 3857), (1.5, 2.5, 4326), (3.5, 4.5, None), (5.0, 6.0, 27700)])]
    there = pr.projected(spark.createDataFrame(rows, "id int, lat double, lng double, code int"))
    got = {r["id"]: r for r in pr.unprojected(there.select("id", "code", "x", "y")).collect()}
    for i, lat, lng, code in rows:
        if code == 27700:
            assert got[i]["lat"] is None and got[i]["lng"] is None
        else:
            assert math.isclose(got[i]["lat"], lat, abs_tol=1e-9) and math.isclose(got[i]["lng"], lng, abs_tol=1e-9)
    at = {r["id"]: r for r in there.collect()}
    # the central meridian is half a million metres east; metres from the equator are the meridian's arc times the scale
    steps, e2 = np.linspace(0, math.radians(51.0), 20_001), 6.69437999014e-3
    arc = np.trapezoid(6378137 * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5, steps)
    assert math.isclose(at[2]["x"], 500000.0, abs_tol=1e-6) and math.isclose(at[2]["y"], 0.9993 * arc - 5300000, abs_tol=1e-3)
    assert at[1]["y"] > 6_000_000 and math.isclose(at[4]["x"], math.radians(-170.5) * 6378137)


def test_a_header_with_a_chosen_system_lies_where_it_should(spark):
    """Three columns, two rows of a metre around 323543, 318612 in the country's metres: between 49 and 55 north, 14 and 24 east."""
    meta = spark.createDataFrame([(3, 2, 323542.5, 318613.5, 1.0)], "cols int, rows int, west double, north double, cell double")
    placed = text_grids.placed_in(meta, F.lit(2180)).select(F.lit(1).alias("tile"), F.col("epsg").alias("code"), F.col("west").alias("origin_x"), F.col("north").alias("origin_y"), "step_x", "step_y", F.col("cols").alias("width"), F.col("rows").alias("height"))
    r = pr.degree_bounds(placed).first()
    assert 49 < r["lat"] < 55 and 14 < r["lng"] < 24 and r["bounds"]["south"] < r["lat"] < r["bounds"]["north"] and r["bounds"]["north"] - r["bounds"]["south"] < 1e-4
    assert pr.degree_bounds(placed.withColumn("code", F.lit(99))).first()["bounds"] is None


def test_the_first_tile_that_knows_a_place_counts(spark):
    rng = np.random.default_rng(1)
    tiles = [(1, 3, None, 10.0, 50.0, 0.01, -0.01, 20, 20), (2, 1, 3857, math.radians(9.95) * pr.RADIUS, math.log(math.tan(math.pi / 4 + math.radians(50.05) / 2)) * pr.RADIUS, 1500.0, -1500.0, 15, 15), (3, 4, 3857, math.radians(10.0) * pr.RADIUS, math.log(math.tan(math.pi / 4 + math.radians(50.0) / 2)) * pr.RADIUS, 1000.0, -1000.0, 30, 30), (4, 0, 27700, 10.0, 50.0, 0.01, -0.01, 20, 20)]
    rasters = {t[0]: np.where(rng.random((t[8], t[7])) < 0.1, np.nan, rng.normal(size=(t[8], t[7]))) for t in tiles}
    cells = [(t, y, x, None if np.isnan(v) else float(v)) for t, a in rasters.items() for (y, x), v in np.ndenumerate(a)]
    places = [(i, float(rng.uniform(49.7, 50.1)), float(rng.uniform(9.9, 10.3))) for i in range(400)] + [(900, None, 1.0)]
    got = {r["id"]: (r["h"], r["tile"]) for r in pr.sampled_across(spark.createDataFrame(places, "id int, lat double, lng double"), spark.createDataFrame(tiles, TILE), spark.createDataFrame(cells, "tile int, y int, x int, h double")).collect()}
    hits = 0
    for i, lat, lng in places:
        want = (None, None)
        for t, _, code, ox, oy, sx, sy, w, h in (tiles[1], tiles[2], tiles[0]) if lat is not None else ():
            x, y = (lng, lat) if code is None else (math.radians(lng) * pr.RADIUS, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * pr.RADIUS)
            px, py = (x - ox) / sx, (y - oy) / sy
            if 0 <= px < w - 1 and 0 <= py < h - 1:
                a, x0, y0 = rasters[t], int(px), int(py)
                fx, fy = px - x0, py - y0
                v = a[y0, x0] * (1 - fx) * (1 - fy) + a[y0, x0 + 1] * fx * (1 - fy) + a[y0 + 1, x0] * (1 - fx) * fy + a[y0 + 1, x0 + 1] * fx * fy
                if not np.isnan(v):
                    want = (v, t)
                    break
        assert got[i][1] == want[1] and (want[0] is None or math.isclose(got[i][0], want[0], abs_tol=1e-9))
        hits += want[1] is not None
    assert hits > 100 and {t for _, t in got.values()} == {1, 2, 3, None}
