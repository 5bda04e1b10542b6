"""Route composites and seams against plain computations."""

import numpy as np

from geoloom.operators import composites, fields

SCHEMA = "route int, ord int, y int, x int, h double, north double, south double, east double, west double, width int, height int"


def chunk(route, order, lat, lng, raster, half=0.0045, wide=0.0067):
    h, w = raster.shape
    return [(route, order, y, x, None if np.isnan(v) else float(v), lat + half, lat - half, lng + wide, lng - wide, w, h) for (y, x), v in np.ndenumerate(raster)]


def composite(chunks, cell_m, most, least):
    """Chunks one after the other into one array."""
    n, s, e, w = (f(c[0][k] for c in chunks) for f, k in ((max, 5), (min, 6), (max, 7), (min, 8)))
    lat, lng = (n + s) / 2, (e + w) / 2
    m = 111320 * np.cos(np.radians(lat))
    side = max((e - w) * m, (n - s) * 111320, 1)
    size = int(2 ** np.floor(np.log2(min(most, max(least, np.floor(side / cell_m + 0.5)))) + 0.5))
    north, west, high, wide = lat + side / 2 / 111320, lng - side / 2 / m, side / 111320, side / m
    lows = [min((r[4] for r in c if r[4] is not None), default=0.0) for c in chunks]
    out, seen = np.full((size, size), min(lows)), [min(lows)]
    for c, low in zip(chunks, lows):
        cn, cs, ce, cw, cols, rows = c[0][5:]
        a = np.array([low if r[4] is None else r[4] for r in c]).reshape(rows, cols)
        for gy in range(size):
            for gx in range(size):
                la, ln = north - gy / (size - 1) * high, west + gx / (size - 1) * wide
                if cs <= la <= cn and cw <= ln <= ce:
                    px, py = (ln - cw) / (ce - cw) * (cols - 1), (cn - la) / (cn - cs) * (rows - 1)
                    x0, y0 = int(px), int(py)
                    x1, y1 = min(x0 + 1, cols - 1), min(y0 + 1, rows - 1)
                    fx, fy = px - x0, py - y0
                    out[gy, gx] = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
                    seen.append(out[gy, gx])
    return out, min(seen), max(seen)


def test_the_last_tile_wins_and_the_rest_is_floor(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(500, 20, (9, 12)), rng.normal(560, 5, (20, 20)), np.full((5, 5), 700.0)
    a[2:4, 3:6] = np.nan
    chunks = [chunk(1, 0, 48.1, 11.6, a), chunk(1, 1, 48.104, 11.605, b), chunk(1, 2, 48.12, 11.64, c)]
    rows = sum(chunks, []) + chunk(2, 5, 10.0, 20.0, np.full((3, 3), np.nan))
    got, about = composites.route_composite(spark.createDataFrame(rows, SCHEMA), 40.0, 64, 16)
    want, low, high = composite(chunks, 40.0, 64, 16)
    cells = {(r["route"], r["y"], r["x"]): r["h"] for r in got.collect()}
    frame = {r["route"]: r for r in about.collect()}
    size = frame[1]["size"]
    assert size == want.shape[0] and size & (size - 1) == 0 and len([k for k in cells if k[0] == 1]) == size * size
    # the frame's outermost cells lie on the edges of the outermost tiles, where rounding decides
    assert all(np.isclose(cells[1, y, x], v) for (y, x), v in np.ndenumerate(want) if 0 < x < size - 1 and 0 < y < size - 1)
    assert np.isclose(frame[1]["lowest"], low) and np.isclose(frame[1]["highest"], high) and frame[1]["north"] >= 48.1245
    # a route of holes alone is flat at 0
    assert {h for (r, _, _), h in cells.items() if r == 2} == {0.0} and frame[2]["highest"] == 0.0
    none, _ = composites.route_composite(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0


def test_textures_lie_over_one_another(spark):
    tiles = [chunk(1, 0, 48.1, 11.6, np.zeros((4, 4))), chunk(1, 1, 48.1, 11.607, np.zeros((2, 3)))]
    rows = [(*r, 10 * r[1] + r[2], r[3], 7) for t in tiles for r in t]
    df = spark.createDataFrame(rows, SCHEMA + ", r int, g int, b int")
    frames = composites.route_frames(df)
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in composites.route_texture(df, frames, 32).collect()}
    f = frames.first()
    for (gy, gx), rgb in got.items():
        lat, lng = f["north"] - (gy + 0.5) / 32 * (f["north"] - f["south"]), f["west"] + (gx + 0.5) / 32 * (f["east"] - f["west"])
        want = composites.EARTH
        for t in tiles:
            n, s, e, w, cols, height = t[0][5:]
            if s < lat < n and w < lng < e:
                want = (10 * t[0][1] + int((n - lat) / (n - s) * height), int((lng - w) / (e - w) * cols), 7)
        assert rgb == want
    assert len(got) == 1024 and sum(v != composites.EARTH for v in got.values()) > 200


def test_a_hill_beside_the_seam_stays(spark):
    """A neighbour that meets the scene at 10 m and rises to 30 m ten units out stays 30 m high there; one that meets it 4 m too low is lifted in
    full at the seam and by a part further out; beyond the fade nothing moves."""
    size = 101
    scene = [(0, y, x, 10.0) for y in range(size) for x in range(size)]
    hill = [(1, y, x, 10.0 if x == 0 else 30.0) for y in range(size) for x in range(size)]
    low = [(2, y, x, 6.0) for y in range(size) for x in range(size)]
    rasters = spark.createDataFrame(scene + hill + low, "tile int, y int, x int, h double")
    places = [(1, 0, 1, 1, 0, 60.0, 0.0, 0.0), (2, 0, 2, 1, 0, 50.0, 0.0, 0.0), (3, 0, 2, 1, 0, 60.0, 0.0, 0.0), (4, 0, 2, 1, 0, 95.0, 0.0, 0.0), (5, 0, 2, 1, 0, 50.0, 3.0, 0.3), (6, 0, 2, 1, 0, 150.0, 3.0, 0.3), (7, 0, 9, 1, 0, 50.0, 0.0, 0.0)]
    got = {r["id"]: r["blended"] for r in fields.seam_heights(spark.createDataFrame(places, "id int, scene int, tile int, ox int, oz int, x double, z double, missing double"), rasters, size, size).collect()}
    assert np.isclose(got[1], 30.0) and np.isclose(got[2], 10.0) and np.isclose(got[4], 6.0) and 6.5 < got[3] < 9.9
    assert np.isclose(got[5], 10.0) and np.isclose(got[6], 0.0) and np.isclose(got[7], 10.0)


def test_a_lone_spike_gives_way_to_its_neighbours(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (20, 20))
    a[10, 10] = 500.0
    rasters = spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "tile int, y int, x int, h double")
    points = spark.createDataFrame([(1, 0, 10 / 19, 10 / 19), (2, 0, 3 / 19, 4 / 19), (3, 0, 0.0, 1.0)], "id int, tile int, u double, v double")
    got = {r["id"]: r["h"] for r in fields.guarded(points, rasters, ["id"], 20, 20).collect()}
    near = np.sort(np.delete(a[9:12, 9:12].ravel(), 4))
    assert np.isclose(got[1], near[4], atol=1e-6) and np.isclose(got[2], a[4, 3], atol=1e-6) and np.isclose(got[3], a[19, 0])
