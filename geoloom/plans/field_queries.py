"""Queries of resampled rasters, combined terrains, scalar fields and area masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import frames
from geoloom.operators import composites, fields, projected

from .network_queries import shared_folder
from .registry import query
from .scalar_queries import _BACK_E, _BACK_N, _RECTIFYING, _forward_sql, _newton
from .views import GRID, read
from .views import grid as cells

_FRAME = {"north": 60.0, "south": 40.0, "east": 20.0, "west": 5.0, "width": 64}
_TARGETS = """t AS (SELECT n_nationkey AS id, 12 + n_nationkey % 5 AS width, 10 + n_nationkey % 7 AS height, 46.0::DOUBLE + n_nationkey * 0.7::DOUBLE AS north, 42.5::DOUBLE + n_nationkey * 0.6::DOUBLE AS south, 9.0::DOUBLE + n_nationkey * 0.5::DOUBLE AS east, 4.5::DOUBLE + n_nationkey * 0.45::DOUBLE AS west FROM nation),
c AS (SELECT *, north - y / (height - 1) * (north - south) AS lat, west + x / (width - 1) * (east - west) AS lng FROM (SELECT *, unnest(range(0, width)) AS x FROM (SELECT *, unnest(range(0, height)) AS y FROM t)))"""


def _targets(spark, sf):
    n = F.col("n_nationkey")
    b = frames.bounds(46.0 + n * 0.7, 42.5 + n * 0.6, 9.0 + n * 0.5, 4.5 + n * 0.45)
    return read(spark, sf, "nation").select(n.alias("id"), (12 + n % 5).cast("int").alias("width"), (10 + n % 7).cast("int").alias("height"), b.alias("b"))


@query("metre_grid", f"""
WITH {_TARGETS}, m AS (SELECT max(vec_id) AS last FROM embeddings), g AS {GRID},
p AS (SELECT id, y, x, (lng - 5) / 15.0::DOUBLE * 63 AS px, (60 - lat) / 20.0::DOUBLE * last AS py, last FROM c, m),
q AS (SELECT *, floor(px) AS x0, floor(py) AS y0, px - floor(px) AS fx, py - floor(py) AS fy FROM p WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND last),
w AS (SELECT id, y, x, y0 + a AS sy, x0 + b AS sx, (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS wt FROM q, (VALUES (0), (1)) AS v(a), (VALUES (0), (1)) AS u(b)),
fine AS (SELECT w.id, w.y, w.x, CASE WHEN count(*) FILTER (g.h IS NULL AND wt >= 1e-9) = 0 THEN sum(CASE WHEN wt >= 1e-9 THEN g.h * wt END) END AS h FROM w LEFT JOIN g ON g.y = sy AND g.x = sx GROUP BY 1, 2, 3)
SELECT c.id, CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x, round(coalesce(fine.h, c.lat / 100 + c.lng / 1000), 7) AS h FROM c LEFT JOIN fine ON fine.id = c.id AND fine.y = c.y AND fine.x = c.x""")
def metre_grid(spark, sf):
    """Grids of nations from the embeddings' raster, where it has no value from a plane of two by two cells."""
    last = read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    plane = spark.range(4).select(F.floor(F.col("id") / 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("x"))
    plane = plane.withColumn("h", (90 - F.col("y") * 180.0) / 100 + (F.col("x") * 360.0 - 180) / 1000)
    world = {"north": 90.0, "south": -90.0, "east": 180.0, "west": -180.0, "width": 2, "height": 2}
    got = fields.resampled(_targets(spark, sf), [(cells(spark, sf), {**_FRAME, "height": last + 1}), (plane, world)])
    return got.select("id", "y", "x", F.round("h", 7).alias("h"))


# blocks of 16 rows as tiles, four of them a route
_ROUTE_TILES = f"""k AS (SELECT y // 64 AS route, y // 16 AS ord, y % 16 AS y, x, h * 100 AS h, 44.0137::DOUBLE + (y // 16) * 7 % 23 * 0.0009::DOUBLE AS north, 4.0071::DOUBLE + (y // 16) * 5 % 11 * 0.0012::DOUBLE AS west FROM {GRID}),
t AS (SELECT route, ord, any_value(north) AS north, any_value(north) - 0.004::DOUBLE AS south, any_value(west) + 0.006::DOUBLE AS east, any_value(west) AS west, coalesce(min(h), 0) AS least, max(y) AS last FROM k GROUP BY route, ord),
u AS (SELECT route, max(north) AS n, min(south) AS s, max(east) AS e, min(west) AS w, min(least) AS floor FROM t GROUP BY route),
v AS (SELECT *, (n + s) / 2 AS lat, (e + w) / 2 AS lng, cos(radians((n + s) / 2)) * 111320 AS m FROM u),
d AS (SELECT *, greatest((e - w) * m, (n - s) * 111320.0::DOUBLE, 1.0::DOUBLE) AS side FROM v),
f AS (SELECT route, floor, lat + side / 2 / 111320.0::DOUBLE AS north, lat - side / 2 / 111320.0::DOUBLE AS south, lng + side / 2 / m AS east, lng - side / 2 / m AS west, CAST(pow(2, floor(log2(least(64, greatest(16, floor(side / 8 + 0.5)))) + 0.5)) AS INT) AS size FROM d)"""


def route_tiles(spark, sf):
    n, w = 44.0137 + F.col("ord") * 7 % 23 * 0.0009, 4.0071 + F.col("ord") * 5 % 11 * 0.0012
    rows = cells(spark, sf).select(F.floor(F.col("y") / 64).alias("route"), F.floor(F.col("y") / 16).alias("ord"), (F.col("y") % 16).alias("y"), "x", (F.col("h") * 100).alias("h"))
    rows = rows.join(rows.groupBy("ord").agg((F.max("y") + 1).alias("height")), "ord")
    return rows.select("*", n.alias("north"), (n - 0.004).alias("south"), (w + 0.006).alias("east"), w.alias("west"), F.lit(64).alias("width"))


@query("route_terrain", f"""
WITH {_ROUTE_TILES}, c AS (SELECT route, size, unnest(range(size)) AS gy FROM f), g AS (SELECT route, gy, unnest(range(size)) AS gx FROM c),
q AS (SELECT g.route, gy, gx, f.north - gy / (size - 1)::DOUBLE * (f.north - f.south) AS lat, f.west + gx / (size - 1)::DOUBLE * (f.east - f.west) AS lng FROM g JOIN f USING (route)),
p AS (SELECT q.*, ord, least, last, greatest(0, least(63, (lng - west) / (east - west) * 63)) AS px, greatest(0, least(last, (north - lat) / (north - south) * last)) AS py FROM q JOIN t USING (route) WHERE lat BETWEEN south AND north AND lng BETWEEN west AND east),
x AS (SELECT route, ord, gy, gx, least, least(last, floor(py) + a) AS y, least(63, floor(px) + b) AS x, (CASE WHEN a = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN b = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS wt FROM p, (VALUES (0), (1)) AS i(a), (VALUES (0), (1)) AS j(b)),
s AS (SELECT x.route, x.ord, gy, gx, sum(coalesce(k.h, least) * wt) AS h FROM x JOIN k ON k.route = x.route AND k.ord = x.ord AND k.y = x.y AND k.x = x.x GROUP BY 1, 2, 3, 4),
o AS (SELECT route, gy, gx, arg_max(h, ord) AS h FROM s GROUP BY 1, 2, 3), z AS (SELECT route, min(h) AS lo, max(h) AS hi FROM s GROUP BY 1)
SELECT g.route, CAST(g.gy AS INT) AS y, CAST(g.gx AS INT) AS x, round(coalesce(o.h, floor), 6) AS h, size, round(least(floor, coalesce(lo, floor)), 6) AS lowest, round(greatest(floor, coalesce(hi, floor)), 6) AS highest
FROM g JOIN f ON f.route = g.route LEFT JOIN o ON o.route = g.route AND o.gy = g.gy AND o.gx = g.gx LEFT JOIN z ON z.route = g.route""")
def route_terrain(spark, sf):
    """One square raster for each four blocks of the embeddings' raster, at up to 64 cells a side."""
    got, about = composites.route_composite(route_tiles(spark, sf), 8.0, 64, 16)
    return got.join(about.select("route", "size", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest")), "route").select("route", "y", "x", F.round("h", 6).alias("h"), "size", "lowest", "highest")


@query("route_texture", f"""
WITH {_ROUTE_TILES}, c AS (SELECT route, unnest(range(48)) AS gy FROM f), g AS (SELECT route, gy, unnest(range(48)) AS gx FROM c),
r AS (SELECT t.route, ord, (t.west - f.west) / (f.east - f.west) * 48 AS x0, (t.east - f.west) / (f.east - f.west) * 48 AS x1, (f.north - t.north) / (f.north - f.south) * 48 AS y0, (f.north - t.south) / (f.north - f.south) * 48 AS y1, last + 1 AS rows FROM t JOIN f ON f.route = t.route),
w AS (SELECT g.route, gy, gx, max(ord) AS ord FROM g JOIN r ON r.route = g.route AND gx + 0.5 >= x0 AND gx + 0.5 < x1 AND gy + 0.5 >= y0 AND gy + 0.5 < y1 GROUP BY 1, 2, 3),
p AS (SELECT w.*, CAST(least(rows - 1, floor((gy + 0.5 - y0) / (y1 - y0) * rows)) AS BIGINT) AS y, CAST(least(63, floor((gx + 0.5 - x0) / (x1 - x0) * 64)) AS BIGINT) AS x FROM w JOIN r ON r.route = w.route AND r.ord = w.ord)
SELECT g.route, CAST(g.gy AS INT) AS y, CAST(g.gx AS INT) AS x, CAST(CASE WHEN k.y IS NULL THEN 74 ELSE (k.y * 16 + k.x) % 256 END AS INT) AS r, CAST(CASE WHEN k.y IS NULL THEN 74 ELSE k.x * 3 END AS INT) AS g, CAST(CASE WHEN k.y IS NULL THEN 66 ELSE k.ord % 256 END AS INT) AS b
FROM g LEFT JOIN p ON p.route = g.route AND p.gy = g.gy AND p.gx = g.gx LEFT JOIN k ON k.route = p.route AND k.ord = p.ord AND k.y = p.y AND k.x = p.x""")
def route_texture(spark, sf):
    """The routes' colours at 48 pixels a side."""
    tiles = route_tiles(spark, sf)
    pixels = tiles.withColumns({"r": ((F.col("y") * 16 + F.col("x")) % 256).cast("int"), "g": (F.col("x") * 3).cast("int"), "b": (F.col("ord") % 256).cast("int")})
    return composites.route_texture(pixels, composites.route_frames(tiles, 8.0, 64, 16), 48)


@query("scalar_field", """
WITH RECURSIVE s AS (SELECT l_partkey % 61 - 55.0 AS x, l_suppkey * 7 % 83 - 45.0 AS z, l_quantity AS value FROM lineitem),
m AS (SELECT CAST(greatest(0, least(15, floor((z + 50) / 100 * 16))) AS INT) AS y, CAST(greatest(0, least(15, floor((x + 50) / 100 * 16))) AS INT) AS x, median(value) AS h FROM s GROUP BY 1, 2),
c AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range(16)) AS y), LATERAL (SELECT unnest(range(16)) AS x)),
d AS (SELECT c.y, c.x, min(abs(c.y - m.y) + abs(c.x - m.x)) AS layer FROM c, m GROUP BY 1, 2),
r(n, y, x, h) AS (SELECT 0, y, x, CAST(h AS DOUBLE) FROM m UNION ALL SELECT n + 1, d.y, d.x, avg(h) FROM r JOIN d ON d.layer = r.n + 1 AND abs(d.y - r.y) + abs(d.x - r.x) = 1 GROUP BY 1, 2, 3),
o AS (SELECT unnest([-1, 0, 1]) AS o),
a AS (SELECT c.y, c.x, sum(r.h) / 9 AS h FROM c, o p, o q, r WHERE r.y = greatest(0, least(15, c.y + p.o)) AND r.x = greatest(0, least(15, c.x + q.o)) GROUP BY 1, 2),
b AS (SELECT c.y, c.x, sum(a.h) / 9 AS h FROM c, o p, o q, a WHERE a.y = greatest(0, least(15, c.y + p.o)) AND a.x = greatest(0, least(15, c.x + q.o)) GROUP BY 1, 2),
k AS (SELECT c_custkey AS id, greatest(0, least(15, (c_custkey % 107 - 3.0) / 100 * 16 - 0.5)) AS px, greatest(0, least(15, (c_custkey * 3 % 109 - 4.0) / 100 * 16 - 0.5)) AS py FROM customer),
w AS (SELECT id, least(15, floor(py) + i) AS y, least(15, floor(px) + j) AS x, (CASE WHEN i = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN j = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS wt FROM k, (VALUES (0), (1)) AS v(i), (VALUES (0), (1)) AS u(j))
SELECT id, round(sum(b.h * wt), 6) AS value FROM w JOIN b ON b.y = w.y AND b.x = w.x GROUP BY id""")
def scalar_field(spark, sf):
    """A field of order lines that leaves the scene's east without samples, read at customers' places."""
    s = read(spark, sf, "lineitem").select((F.col("l_partkey") % 61 - 55.0).alias("x"), (F.col("l_suppkey") * 7 % 83 - 45.0).alias("z"), F.col("l_quantity").cast("double").alias("value"))
    k = F.col("c_custkey")
    p = read(spark, sf, "customer").select(k.alias("id"), (k % 107 - 53.0).alias("x"), (k * 3 % 109 - 54.0).alias("z"))
    return fields.field_values(p, fields.scalar_field(s, 16, shared_folder(spark)), 16).select("id", F.round("value", 6).alias("value"))


@query("area_mask", """
WITH a AS (SELECT s_suppkey AS id, s_suppkey * 13 % 120 - 8.0 AS x, s_suppkey * 29 % 110 - 5.0 AS y, 4.0 + s_suppkey % 7 AS r, s_suppkey % 3 = 0 AS holed FROM supplier),
c AS (SELECT *, cx + 0.5 AS px, cz + 0.5 AS py FROM (SELECT unnest(range(100)) AS cx), LATERAL (SELECT unnest(range(100)) AS cz)),
m AS (SELECT c.cx, c.cz, px BETWEEN x AND x + r AND py BETWEEN y AND y + 2 * r AS inside, holed AND px BETWEEN x + 1 AND x + r - 1 AND py BETWEEN y + 1 AND y + r AS hole,
  sqrt(pow(greatest(x - px, 0, px - x - r), 2) + pow(greatest(y - py, 0, py - y - 2 * r), 2)) AS gap FROM a JOIN c ON px BETWEEN x - 4 AND x + r + 4 AND py BETWEEN y - 4 AND y + 2 * r + 4)
SELECT CAST(cx AS INT) AS cx, CAST(cz AS INT) AS cz, round(max(CASE WHEN inside THEN 1.0 ELSE pow((3 - gap) / 3, 2) * (3 - 2 * (3 - gap) / 3) END), 6) AS w FROM m WHERE CASE WHEN inside THEN NOT hole ELSE gap < 3 END GROUP BY 1, 2""")
def area_mask(spark, sf):
    """Rectangles of suppliers, a third with a hole, on a mask of 100 by 100 cells."""
    k = F.col("s_suppkey")
    x, y, r = k * 13 % 120 - 8.0, k * 29 % 110 - 5.0, 4.0 + k % 7
    box = lambda x0, y0, x1, y1: F.array(*[F.struct(p.alias("x"), q.alias("y")) for p, q in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    ring, hole = box(x, y, x + r, y + 2 * r), box(x + 1, y + 1, x + r - 1, y + r)
    areas = read(spark, sf, "supplier").select(ring.alias("ring"), F.when(k % 3 == 0, F.array(hole)).otherwise(F.slice(F.array(hole), 1, 0)).alias("holes"))
    return fields.area_mask(areas, 100, 3.0).select("cx", "cz", F.round("w", 6).alias("w"))


_SEAM_SIDES = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


@query("seam_heights", f"""
WITH h AS (SELECT y // 20 AS tile, y % 20 AS y, x, h * 100 AS h FROM {GRID}), g AS (SELECT tile, y, x, coalesce(h, min(h) OVER (PARTITION BY tile)) AS h FROM h),
n AS (SELECT max(tile) + 1 AS tiles FROM g),
b AS (SELECT c_custkey AS id, c_custkey % tiles AS scene, (c_custkey + 1) % tiles AS tile, {[a for a, _ in _SEAM_SIDES]}[c_custkey % 8 + 1] AS ox, {[b for _, b in _SEAM_SIDES]}[c_custkey % 8 + 1] AS oz, (c_custkey * 7 % 101) / 100.0::DOUBLE AS u, (c_custkey * 13 % 97) / 96.0::DOUBLE AS v, (c_custkey % 4 * 0.1)::DOUBLE AS missing FROM customer, n),
p AS (SELECT *, ox * 100 + (u - 0.5) * 100 AS x, oz * 100 + (v - 0.5) * 100 AS z FROM b), e AS (SELECT *, greatest(-50, least(50, x)) AS sx, greatest(-50, least(50, z)) AS sz FROM p),
d AS (SELECT *, sqrt(pow(x - sx, 2) + pow(z - sz, 2)) AS dist, abs(z - sz) > abs(x - sx) AS flat FROM e),
o AS (SELECT k, (k - 1) % 3 - 1 AS i, (k - 1) // 3 - 1 AS j FROM (SELECT unnest(range(1, 10)) AS k)),
a AS (SELECT id, 0 AS kind, k, scene AS tile, (sx + CASE WHEN flat THEN (k / 10 - 0.5) * 200 / 768 ELSE 0 END + 50) / 100 * 63 AS px, (sz + CASE WHEN flat THEN 0 ELSE (k / 10 - 0.5) * 200 / 768 END + 50) / 100 * 19 AS py FROM d, (SELECT unnest(range(11))::DOUBLE AS k)
 UNION ALL SELECT id, 1, k, tile, greatest(0, least(1, (sx - ox * 100 + 50) / 100 + i / 63.0::DOUBLE)) * 63, greatest(0, least(1, (sz - oz * 100 + 50) / 100 + j / 19.0::DOUBLE)) * 19 FROM d, o
 UNION ALL SELECT id, 2, k, tile, greatest(0, least(1, (x - ox * 100 + 50) / 100 + i / 63.0::DOUBLE)) * 63, greatest(0, least(1, (z - oz * 100 + 50) / 100 + j / 19.0::DOUBLE)) * 19 FROM d, o),
q AS (SELECT id, kind, k, tile, greatest(0, least(63, px)) AS px, greatest(0, least(19, py)) AS py FROM a),
w AS (SELECT id, kind, k, tile, least(19, floor(py) + r) AS y, least(63, floor(px) + c) AS x, (CASE WHEN r = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN c = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS wt FROM q, (VALUES (0), (1)) AS v(r), (VALUES (0), (1)) AS u(c)),
s AS (SELECT id, kind, k, sum(g.h * wt) AS h FROM w JOIN g ON g.tile = w.tile AND g.y = w.y AND g.x = w.x GROUP BY 1, 2, 3),
t AS (SELECT id, avg(h) AS seam FROM s WHERE kind = 0 GROUP BY id),
m AS (SELECT id, kind, max(h) FILTER (k = 5) AS c, list_sort(list(h) FILTER (k <> 5)) AS near FROM s WHERE kind > 0 GROUP BY 1, 2),
r AS (SELECT id, kind, CASE WHEN abs(c) > 12000 OR abs(c - near[5]) > greatest(8, 6 * list_sort(list_transform(near, lambda x: abs(x - near[5])))[5]) THEN near[5] ELSE c END AS h FROM m),
f AS (SELECT d.id, missing, seam, a.h AS edge, b.h AS h, greatest(0, least(1, dist / 100)) AS u, greatest(0, least(1, (dist - 0.5) / 41.5)) AS v FROM d JOIN t USING (id) JOIN r a ON a.id = d.id AND a.kind = 1 JOIN r b ON b.id = d.id AND b.kind = 2)
SELECT id, round(seam, 6) AS seam, round(CASE WHEN missing > 0.25 THEN seam * (1 - u * u * (3 - 2 * u)) ELSE h + (seam - edge) * (1 - v * v * (3 - 2 * v)) END, 6) AS blended FROM f""")
def seam_heights(spark, sf):
    """Places of customers in the eight neighbours of scenes of 20 rows of the embeddings' raster; a quarter of the tiles misses too much."""
    k = F.col("c_custkey")
    rasters = cells(spark, sf).select(F.floor(F.col("y") / 20).alias("tile"), (F.col("y") % 20).alias("y"), "x", (F.col("h") * 100).alias("h"))
    n = (rasters.agg(F.max("tile")).first()[0] or 0) + 1
    of = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in _SEAM_SIDES]), (k % 8 + 1).cast("int"))
    p = read(spark, sf, "customer").select(k.alias("id"), (k % n).alias("scene"), ((k + 1) % n).alias("tile"), of(0).alias("ox"), of(1).alias("oz"), (k * 7 % 101 / 100.0).alias("u"), (k * 13 % 97 / 96.0).alias("v"), (k % 4 * 0.1).alias("missing"))
    p = p.withColumn("x", F.col("ox") * 100 + (F.col("u") - 0.5) * 100).withColumn("z", F.col("oz") * 100 + (F.col("v") - 0.5) * 100)
    return fields.seam_heights(p, rasters, 64, 20).select("id", F.round("seam", 6).alias("seam"), F.round("blended", 6).alias("blended"))


@query("image_grid", f"""
WITH {_TARGETS.replace("46.0::DOUBLE + n_nationkey * 0.7::DOUBLE", "49.2::DOUBLE - n_nationkey * 0.05::DOUBLE").replace("42.5::DOUBLE + n_nationkey * 0.6::DOUBLE", "47.9::DOUBLE - n_nationkey * 0.04::DOUBLE").replace("9.0::DOUBLE + n_nationkey * 0.5::DOUBLE", "8.7::DOUBLE + n_nationkey * 0.01::DOUBLE").replace("4.5::DOUBLE + n_nationkey * 0.45::DOUBLE", "8.41::DOUBLE + n_nationkey * 0.002::DOUBLE")},
m AS (SELECT max(vec_id) AS last FROM embeddings),
p AS (SELECT id, y, x, CAST(floor((lng + 180) / 360 * 65536) AS BIGINT) - 34304 AS ix, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) - 22528 AS iy FROM c)
SELECT p.id, CAST(p.y AS INT) AS y, CAST(p.x AS INT) AS x, coalesce(CASE WHEN g.y IS NULL THEN 0 ELSE (g.y * 7 + g.x) % 256 END, 0)::INT AS r, coalesce(g.x * 3, 0)::INT AS g, CASE WHEN g.h IS NULL AND g.y IS NOT NULL THEN 9 ELSE 0 END::INT AS b, CASE WHEN g.y IS NULL THEN 255 ELSE 200 END::INT AS a FROM p LEFT JOIN {GRID} g ON g.y = iy AND g.x = ix""")
def image_grid(spark, sf):
    """Grids of nations from an image of 64 pixels a row, partly beyond it."""
    n = F.col("n_nationkey")
    b = frames.bounds(49.2 - n * 0.05, 47.9 - n * 0.04, 8.7 + n * 0.01, 8.41 + n * 0.002)
    targets = read(spark, sf, "nation").select(n.alias("id"), (12 + n % 5).cast("int").alias("width"), (10 + n % 7).cast("int").alias("height"), b.alias("b"))
    whole = lambda c: c.cast("int")
    image = cells(spark, sf).select("y", "x", whole((F.col("y") * 7 + F.col("x")) % 256).alias("r"), whole(F.col("x") * 3).alias("g"), F.when(F.col("h").isNull(), 9).otherwise(0).alias("b"), F.lit(200).alias("a"))
    last = read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    return fields.resampled_image(targets, image, 8, 134, 88, 64, last + 1)


# blocks of 16 rows as tiles in degrees, in a zone's metres, in a country's metres and in Web Mercator, in turn, all around one place
_BLOCKS = f"""g AS (SELECT y // 16 AS tile, y % 16 AS y, x, h FROM {GRID}),
blocks AS (SELECT tile, max(y) + 1 AS rows, tile % 4 AS kind, [14.90037 + tile * 7 % 11 * 0.03, 490000 + tile * 7 % 11 * 2500, 215000 + tile * 7 % 11 * 2500, 1660000 + tile * 7 % 11 * 3500][tile % 4 + 1]::DOUBLE AS ox,
 [52.20041 - tile * 5 % 7 * 0.05, 5790000 - tile * 5 % 7 * 6000, 490000 - tile * 5 % 7 * 6000, 6840000 - tile * 5 % 7 * 9000][tile % 4 + 1]::DOUBLE AS oy, [0.004, 280, 280, 440][tile % 4 + 1]::DOUBLE AS sx, [-0.01, -1100, -1100, -1800][tile % 4 + 1]::DOUBLE AS sy FROM g GROUP BY tile)"""


def coded_tiles(spark, sf):
    b, kind = F.col("tile"), (F.col("tile") % 4 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[(x if hasattr(x, "cast") else F.lit(x)).cast("double") for x in v]), kind)
    a, c = b * 7 % 11, b * 5 % 7
    own = cells(spark, sf).select(F.floor(F.col("y") / 16).alias("tile"), (F.col("y") % 16).alias("y"), "x", "h")
    code = F.element_at(F.array(F.lit(None), F.lit(32633), F.lit(2180), F.lit(3857)), kind)
    t = own.groupBy("tile").agg((F.max("y") + 1).alias("height"))
    t = t.select("tile", b.alias("ord"), code.alias("code"), pick(14.90037 + a * 0.03, 490000 + a * 2500, 215000 + a * 2500, 1660000 + a * 3500).alias("origin_x"), pick(52.20041 - c * 0.05, 5790000 - c * 6000, 490000 - c * 6000, 6840000 - c * 9000).alias("origin_y"), pick(0.004, 280, 280, 440).alias("step_x"), pick(-0.01, -1100, -1100, -1800).alias("step_y"), F.lit(64).alias("width"), "height")
    return t, own


@query("projected_rasters", f"""
WITH {_BLOCKS}, c AS (SELECT c_custkey AS id, 51.9::DOUBLE + c_custkey * 7 % 401 * 0.001::DOUBLE AS lat, 14.85::DOUBLE + c_custkey * 13 % 503 * 0.001::DOUBLE AS lng FROM customer),
{_forward_sql("SELECT id, lat, lng, mid FROM c, (VALUES (15), (19)) AS z(mid)", "id, mid")},
q AS (SELECT id, 0 AS kind, lng AS x, lat AS y FROM c UNION ALL SELECT id, 1, 500000 + 0.9996 * east, 0.9996 * north FROM m WHERE mid = 15 UNION ALL SELECT id, 2, 500000 + 0.9993 * east, 0.9993 * north - 5300000 FROM m WHERE mid = 19
 UNION ALL SELECT id, 3, radians(lng) * 6378137, asinh(tan(radians(lat))) * 6378137 FROM c),
p AS (SELECT id, tile, q.kind, (q.x - ox) / sx AS px, (q.y - oy) / sy AS py FROM q JOIN blocks t ON t.kind = q.kind WHERE (q.x - ox) / sx >= 0 AND (q.x - ox) / sx < 63 AND (q.y - oy) / sy >= 0 AND (q.y - oy) / sy < rows - 1),
w AS (SELECT id, tile, kind, floor(py) + a AS y, floor(px) + b AS x, (CASE WHEN a = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN b = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS wt FROM p, (VALUES (0), (1)) AS v(a), (VALUES (0), (1)) AS u(b)),
s AS (SELECT id, w.tile, kind, sum(h * wt) AS h FROM w JOIN g ON g.tile = w.tile AND g.y = w.y AND g.x = w.x GROUP BY id, w.tile, kind HAVING count(h) FILTER (wt >= 1e-9) = count(*) FILTER (wt >= 1e-9))
SELECT c.id, round(arg_min(s.h, (kind, tile)), 3) AS h, arg_min(tile, (kind, tile)) AS tile FROM c LEFT JOIN s USING (id) GROUP BY c.id""")
def projected_rasters(spark, sf):
    """Customers' places in tiles of four coordinate systems."""
    k = F.col("c_custkey")
    places = read(spark, sf, "customer").select(k.alias("id"), (51.9 + k * 7 % 401 * 0.001).alias("lat"), (14.85 + k * 13 % 503 * 0.001).alias("lng"))
    return projected.sampled_across(places, *coded_tiles(spark, sf)).select("id", F.round("h", 3).alias("h"), "tile")


@query("degree_bounds", f"""
WITH {_BLOCKS}, k AS (SELECT tile, kind, ox + i * 32 * sx AS x, oy + j * rows / 2 * sy AS y, i, j FROM blocks, (VALUES (0, 0), (2, 0), (0, 2), (2, 2), (1, 1)) AS v(i, j)),
l AS (SELECT *, CASE kind WHEN 1 THEN y / 0.9996 ELSE (y + 5300000) / 0.9993 END / {_RECTIFYING} AS a, (x - 500000) / CASE kind WHEN 1 THEN 0.9996 ELSE 0.9993 END / {_RECTIFYING} AS b FROM k WHERE kind IN (1, 2)),
o AS (SELECT *, a{_BACK_N} AS xi, b{_BACK_E} AS eta FROM l),
n0 AS (SELECT tile * 10 + i * 3 + j AS id, tile, i, j, CASE kind WHEN 1 THEN 15 ELSE 19 END + degrees(atan2(sinh(eta), cos(xi))) AS lng, sin(xi) / sqrt(pow(sinh(eta), 2) + pow(cos(xi), 2)) AS tc, sin(xi) / sqrt(pow(sinh(eta), 2) + pow(cos(xi), 2)) AS tn FROM o),
{_newton(1).replace("SELECT id,", "SELECT id, tile, i, j,")}, {_newton(2).replace("SELECT id,", "SELECT id, tile, i, j,")}, {_newton(3).replace("SELECT id,", "SELECT id, tile, i, j,")},
d AS (SELECT tile, i, j, degrees(atan(tn)) AS lat, lng FROM n3 UNION ALL SELECT tile, i, j, y, x FROM k WHERE kind = 0 UNION ALL SELECT tile, i, j, degrees(atan(sinh(y / 6378137))), degrees(x / 6378137) FROM k WHERE kind = 3)
SELECT tile, round(max(lat) FILTER (i <> 1), 6) AS north, round(min(lat) FILTER (i <> 1), 6) AS south, round(max(lng) FILTER (i <> 1), 6) AS east, round(min(lng) FILTER (i <> 1), 6) AS west, round(max(lat) FILTER (i = 1), 6) AS lat, round(max(lng) FILTER (i = 1), 6) AS lng FROM d GROUP BY tile""")
def degree_bounds(spark, sf):
    """Bounds in degrees of tiles of four coordinate systems."""
    b = projected.degree_bounds(coded_tiles(spark, sf)[0])
    return b.select("tile", *[F.round(f"bounds.{c}", 6).alias(c) for c in ("north", "south", "east", "west")], F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
