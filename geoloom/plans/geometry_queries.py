"""Queries of geometry, rasterization, routes and meshes over lines of order lines and event tracks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from geoloom.functions.scalars import rounded
from geoloom.operators import geometry, mesh
from geoloom.operators.shared import parts_of

from . import registry
from .views import WAYS, nodes, read, ways



def query(name: str, sql: str | None = None):
    """Registers a query; columns called by are quoted in its SQL."""
    return registry.query(name, re.sub(r"\bby\b", '"by"', sql) if sql else None)


#: Lines with whole-number points; a line's points are its order's (part, supplier) places.
LINES = f"(SELECT way AS line, idx, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y FROM {WAYS})"


def lines(spark, sf):
    return ways(spark, sf).select(F.col("way").alias("line"), "idx", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))


#: Rings of 3 to 7 points around a centre, one a supplier.
RINGS = """(SELECT s_suppkey AS id, list_transform(range(0, 3 + s_suppkey % 5), lambda k: {'x': CAST((s_suppkey * 37 + k * k * 11) % 64 AS DOUBLE), 'y': CAST((s_suppkey * 53 + k * 29) % 64 AS DOUBLE)}) AS ring FROM supplier)"""


def rings(spark, sf):
    k = F.col("s_suppkey")
    point = lambda i: F.struct(((k * 37 + i * i * 11) % 64).cast("double").alias("x"), ((k * 53 + i * 29) % 64).cast("double").alias("y"))
    return read(spark, sf, "supplier").select(k.alias("id"), F.transform(F.sequence(F.lit(0).cast("bigint"), 2 + k % 5), point).alias("ring"))


_NEXT = "list_concat(ring[2:], ring[1:1])"


@query("ring_areas", f"""
SELECT id, list_sum(list_transform(list_zip(ring, {_NEXT}), lambda e: e[1].x * e[2].y - e[2].x * e[1].y)) / 2 AS area,
  abs(list_sum(list_transform(list_zip(ring, {_NEXT}), lambda e: (e[2].x - e[1].x) * (e[2].y + e[1].y)))) AS twice FROM {RINGS}""")
def ring_areas(spark, sf):
    return rings(spark, sf).select("id", geometry.ring_area(F.col("ring")).alias("area"), geometry.trapezoid_area(F.col("ring")).alias("twice"))


@query("points_in_rings", f"""
WITH e AS (SELECT id, unnest(list_zip(ring, {_NEXT})) AS e FROM {RINGS}), q AS (SELECT id, id * 7 % 64 + 0.5::DOUBLE AS px, id * 3 % 64 + 0.25::DOUBLE AS py, e[1].x AS ax, e[1].y AS ay, e[2].x AS bx, e[2].y AS by FROM e),
d AS (SELECT *, CASE WHEN ax = bx AND ay = by THEN 0 ELSE greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)))) END AS t FROM q)
SELECT id, count(*) FILTER ((ay > py) <> (by > py) AND px < (bx - ax) * (py - ay) / (by - ay) + ax) % 2 = 1 AS inside,
  round(sqrt(min((px - ax - (bx - ax) * t) * (px - ax - (bx - ax) * t) + (py - ay - (by - ay) * t) * (py - ay - (by - ay) * t))), 6) AS distance FROM d GROUP BY id""")
def points_in_rings(spark, sf):
    x, y = (F.col("id") * 7 % 64 + 0.5).cast("double"), (F.col("id") * 3 % 64 + 0.25).cast("double")
    return rings(spark, sf).select("id", geometry.point_in_ring(x, y, F.col("ring")).alias("inside"), F.round(geometry.ring_distance(x, y, F.col("ring")), 6).alias("distance"))


@query("clip_lines", f"""
WITH s AS (SELECT line, idx AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
p AS (SELECT *, bx - ax AS dx, by - ay AS dy FROM s WHERE bx IS NOT NULL),
t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (200 - ax) / dx WHEN dx < 0 THEN (800 - ax) / dx WHEN ax < 200 OR ax > 800 THEN 2 ELSE 0 END, CASE WHEN dy > 0 THEN (200 - ay) / dy WHEN dy < 0 THEN (800 - ay) / dy WHEN ay < 200 OR ay > 800 THEN 2 ELSE 0 END) AS t0,
  least(1, CASE WHEN dx > 0 THEN (800 - ax) / dx WHEN dx < 0 THEN (200 - ax) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (800 - ay) / dy WHEN dy < 0 THEN (200 - ay) / dy ELSE 1 END) AS t1 FROM p),
c AS (SELECT *, CASE WHEN lag(seg) OVER w = seg - 1 AND lag(t1) OVER w = 1 AND t0 = 0 THEN 0 ELSE 1 END AS new FROM t WHERE t0 <= t1 WINDOW w AS (PARTITION BY line ORDER BY seg))
SELECT line, CAST(sum(new) OVER (PARTITION BY line ORDER BY seg) - 1 AS INT) AS piece, seg, round(ax + dx * t0, 6) AS ax, round(ay + dy * t0, 6) AS ay, round(ax + dx * t1, 6) AS bx, round(ay + dy * t1, 6) AS by FROM c""")
def clip_lines(spark, sf):
    c = geometry.clip_lines(lines(spark, sf), 200.0, 200.0, 800.0, 800.0)
    return c.select("line", "piece", "seg", *[F.round(x, 6).alias(x) for x in ("ax", "ay", "bx", "by")])


def _side(name: str, source: str, axis: str, test: str, limit: int) -> str:
    return f"""{name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, k) AS n, x, y FROM (
  SELECT id, n, 0 AS k, ax + (bx - ax) * ({limit} - a{axis}) / (b{axis} - a{axis}) AS x, ay + (by - ay) * ({limit} - a{axis}) / (b{axis} - a{axis}) AS y FROM {source} WHERE (a{axis} {test} {limit}) <> (b{axis} {test} {limit})
  UNION ALL SELECT id, n, 1, bx, by FROM {source} WHERE b{axis} {test} {limit})),
{name}e AS (SELECT id, n, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by FROM {name} WINDOW w AS (PARTITION BY id ORDER BY n))"""


@query("clip_rings", f"""
WITH r AS (SELECT id, unnest(range(1, len(ring) + 1)) AS n, ring FROM {RINGS}),
e0 AS (SELECT id, n, ring[n].x AS ax, ring[n].y AS ay, ring[n % len(ring) + 1].x AS bx, ring[n % len(ring) + 1].y AS by FROM r),
{_side('a', 'e0', 'y', '<=', 48)}, {_side('b', 'ae', 'y', '>=', 16)}, {_side('c', 'be', 'x', '<=', 48)}, {_side('d', 'ce', 'x', '>=', 16)}
SELECT s_suppkey AS id, count(ax) AS points, round(coalesce(sum(ax * by - bx * ay), 0) / 2, 6) AS area FROM supplier LEFT JOIN de ON id = s_suppkey GROUP BY s_suppkey""")
def clip_rings(spark, sf):
    c = rings(spark, sf).select("id", geometry.clip_ring(F.col("ring"), 16.0, 16.0, 48.0, 48.0).alias("ring"))
    return c.select("id", F.size("ring").cast("bigint").alias("points"), F.round(geometry.ring_area(F.col("ring")), 6).alias("area"))


@query("line_lengths", f"""
SELECT line, round(sum(d), 6) AS length FROM (SELECT line, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)) GROUP BY line HAVING count(d) > 0""")
def line_lengths(spark, sf):
    a = geometry.with_arc(lines(spark, sf))
    return a.groupBy("line").agg(F.round(F.max("arc"), 6).alias("length"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("resample", f"""
WITH s AS (SELECT line, idx, x, y, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
a AS (SELECT *, sum(d) OVER (PARTITION BY line ORDER BY idx) AS arc FROM s),
t AS (SELECT line, max(arc) AS total, greatest(2, CAST(floor(max(arc) / 40 + 0.5) AS INT)) AS k FROM a GROUP BY line HAVING max(arc) > 0),
n AS (SELECT line, total, k, unnest(range(0, k + 1)) AS n FROM t),
p AS (SELECT n.line, n.n, least(n.n * total / k, total) AS pos FROM n),
g AS (SELECT a.line, a.idx, x, y, arc, lead(x) OVER w AS bx, lead(y) OVER w AS by, lead(arc) OVER w AS b FROM a WINDOW w AS (PARTITION BY line ORDER BY idx)),
j AS (SELECT p.line, p.n, arg_min(x + (bx - x) * greatest(0, least(1, (pos - arc) / (b - arc))), idx) AS x, arg_min(y + (by - y) * greatest(0, least(1, (pos - arc) / (b - arc))), idx) AS y
  FROM p JOIN g ON g.line = p.line AND b > arc AND pos >= arc - 1e-7 AND pos <= b + 1e-7 GROUP BY p.line, p.n)
SELECT line, CAST(n AS INT) AS n, round(x, 4) AS x, round(y, 4) AS y FROM j""")
def resample(spark, sf):
    return geometry.resample(lines(spark, sf), 40.0).select("line", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("corner_cutting", f"""
WITH s AS (SELECT line, idx, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by, lag(x) OVER w IS NULL AS head, lead(x, 2) OVER w IS NULL AS tail FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
p AS (SELECT line, idx, unnest(list_concat(CASE WHEN head THEN [0.0::DOUBLE] ELSE [] END, [0.25, 0.75], CASE WHEN tail THEN [1.0::DOUBLE] ELSE [] END)) AS t, x, y, bx, by FROM s WHERE bx IS NOT NULL)
SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY idx, t) - 1 AS INT) AS idx, x + (bx - x) * t AS x, y + (by - y) * t AS y FROM p""")
def corner_cutting(spark, sf):
    return geometry.chaikin(lines(spark, sf))


@query("offset_lines", f"""
WITH s AS (SELECT line, idx, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx))
SELECT line, idx, round(x + CASE WHEN dx <> 0 OR dy <> 0 THEN -dy / sqrt(dx * dx + dy * dy) * 3.5 ELSE 0 END, 6) AS x, round(y + CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) * 3.5 ELSE 0 END, 6) AS y FROM s""")
def offset_lines(spark, sf):
    return geometry.offset_lines(lines(spark, sf), 3.5).select("line", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("moving_average", f"SELECT line, idx, x, round(CASE WHEN lag(y) OVER w IS NULL OR lead(y) OVER w IS NULL THEN y ELSE (lag(y) OVER w + y + lead(y) OVER w) / 3 END, 6) AS y FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)")
def moving_average(spark, sf):
    return geometry.moving_average(lines(spark, sf), "y").select("line", "idx", "x", F.round("y", 6).alias("y"))


@query("line_chunks", f"""
WITH l AS (SELECT *, max(idx) OVER (PARTITION BY line) AS last FROM {LINES})
SELECT line, CAST(idx // 2 AS INT) AS piece, idx, x, y FROM l WHERE NOT (idx % 2 = 0 AND idx > 0 AND idx = last) UNION ALL SELECT line, CAST(idx // 2 - 1 AS INT), idx, x, y FROM l WHERE idx % 2 = 0 AND idx > 0""")
def line_chunks(spark, sf):
    return geometry.chunked(lines(spark, sf), 3)


_DIRECT = "list_reduce(list_prepend([p[1]], list_transform(p[2:], lambda q: [q])), lambda k, q: CASE WHEN pow(q[1].x - k[-1].x, 2) + pow(q[1].y - k[-1].y, 2) >= 90000 OR q[1].idx = p[-1].idx THEN list_concat(k, q) ELSE k END)"


@query("decimation", f"""
WITH a AS (SELECT line, list({{'idx': idx, 'x': x, 'y': y}} ORDER BY idx) AS p FROM {LINES} GROUP BY line), k AS (SELECT line, unnest({_DIRECT}) AS q FROM a)
SELECT line, q.idx AS idx, q.x AS x, q.y AS y FROM k""")
def decimation(spark, sf):
    return geometry.decimated(lines(spark, sf), 300.0)


@query("simplification")
def simplification(spark, sf):
    return geometry.simplify(lines(spark, sf), 120.0)


@query("hulls")
def hulls(spark, sf):
    return geometry.hull(lines(spark, sf))


_SEGS = f"(SELECT line * 64 + idx AS ord, line % 7 AS mat, 1.3::DOUBLE + line % 2 AS half, x % 128 AS ax, y % 128 AS ay, x % 128 + y % 5 AS bx, y % 128 + x % 4 AS by FROM {LINES})"


@query("segment_raster", f"""
WITH s AS {_SEGS}, p AS (SELECT *, unnest(range(greatest(0, CAST(floor(least(ax, bx) - half) AS BIGINT)), least(127, CAST(ceil(greatest(ax, bx) + half) AS BIGINT)) + 1)) AS px FROM s),
q AS (SELECT *, unnest(range(greatest(0, CAST(floor(least(ay, by) - half) AS BIGINT)), least(127, CAST(ceil(greatest(ay, by) + half) AS BIGINT)) + 1)) AS py FROM p),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0))) AS t FROM q)
SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, arg_max(mat, ord) AS mat FROM t WHERE pow(px - ax - (bx - ax) * coalesce(t, 0), 2) + pow(py - ay - (by - ay) * coalesce(t, 0), 2) <= half * half GROUP BY px, py""")
def segment_raster(spark, sf):
    x, y = F.col("x"), F.col("y")
    s = lines(spark, sf).select((F.col("line") * 64 + F.col("idx")).alias("ord"), (F.col("line") % 7).alias("mat"), (1.3 + F.col("line") % 2).alias("half"), (x % 128).alias("ax"), (y % 128).alias("ay"), (x % 128 + y % 5).alias("bx"), (y % 128 + x % 4).alias("by"))
    return geometry.rasterized_segments(s, 128)


@query("ring_raster", f"""
WITH e AS (SELECT id, unnest(list_zip(ring, {_NEXT})) AS e FROM {RINGS}), f AS (SELECT id, e[1].x AS ax, e[1].y AS ay, e[2].x AS bx, e[2].y AS by FROM e),
g AS (SELECT *, unnest(range(0, 64)) AS py FROM f WHERE ay <> by), x AS (SELECT id, py, ax + (py + 0.5 - ay) / (by - ay) * (bx - ax) AS x FROM g WHERE py + 0.5 >= least(ay, by) AND py + 0.5 < greatest(ay, by)),
r AS (SELECT id, py, list_sort(list(x)) AS xs FROM x GROUP BY id, py), s AS (SELECT id, py, xs, unnest(range(1, len(xs) // 2 + 1)) AS i FROM r),
p AS (SELECT id, py, unnest(range(greatest(0, CAST(ceil(xs[2 * i - 1]) AS BIGINT)), least(63, CAST(floor(xs[2 * i]) AS BIGINT)) + 1)) AS px FROM s)
SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, arg_max(id % 8, id) AS mat FROM p GROUP BY px, py""")
def ring_raster(spark, sf):
    return geometry.rasterized_rings(rings(spark, sf).select(F.col("id").alias("ord"), (F.col("id") % 8).alias("mat"), "ring"), 64)


def _xyz():
    return [(F.col("px") % 40 * 0.5).alias("x"), (F.col("py") % 8 * 0.125).alias("y"), (F.col("py") % 50 * 0.5).alias("z")]


def _soup(spark, sf):
    """Vertices and triangles: order lines as vertices of meshes by order; each three make a triangle."""
    li = ways(spark, sf)
    mesh_id = F.col("way") % 40
    v = li.select(mesh_id.alias("mesh"), (F.col("way") % 2).alias("lod"), (F.col("way") * 64 + F.col("idx")).alias("vi"), *_xyz())
    t = li.where("idx % 3 = 0").select(mesh_id.alias("mesh"), (F.col("way") * 64 + F.col("idx")).alias("ti"), *[(F.col("way") * 64 + F.col("idx") + k).alias(f"i{k}") for k in range(3)])
    return v, t


_V = f"v AS (SELECT way % 40 AS mesh, way % 2 AS lod, way * 64 + idx AS vi, px % 40 * 0.5::DOUBLE AS x, py % 8 * 0.125::DOUBLE AS y, py % 50 * 0.5::DOUBLE AS z FROM {WAYS})"
_TRI = f"""t AS (SELECT a.mesh, a.vi AS ti, a.x AS ax, a.y AS ay, a.z AS az, b.vi AS i1, b.x AS bx, b.y AS by, b.z AS bz, c.vi AS i2, c.x AS cx, c.y AS cy, c.z AS cz FROM v a JOIN v b ON b.vi = a.vi + 1 JOIN v c ON c.vi = a.vi + 2 WHERE a.vi % 64 % 3 = 0),
n AS (SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS nz FROM t),
g AS (SELECT *, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-12 THEN abs(ny) / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0 END AS up FROM n)"""


@query("ground_triangles", f"WITH {_V}, {_TRI} SELECT mesh, ti, round(up, 6) AS up FROM g WHERE up > 0.85")
def ground_triangles(spark, sf):
    v, t = _soup(spark, sf)
    g = mesh.ground_triangles(t, v)
    return g.select("mesh", "ti", F.round(mesh.normal_up(F.col("a"), F.col("b"), F.col("c")), 6).alias("up"))


@query("welded_vertices", f"""
WITH {_V}, {_TRI}, u AS (SELECT ti AS vi FROM g WHERE up > 0.85 UNION ALL SELECT i1 FROM g WHERE up > 0.85 UNION ALL SELECT i2 FROM g WHERE up > 0.85),
s AS (SELECT v.*, floor(x) AS cx, floor(z) AS cz FROM u JOIN v USING (vi)), f AS (SELECT cx, cz, min(y) AS lowest, min(lod) AS gl FROM s GROUP BY cx, cz),
c AS (SELECT s.cx, s.cz, gl, lowest, avg(y) AS mean, min(y) AS lo, max(y) AS hi, min(mesh) AS m0, max(mesh) AS m1 FROM s JOIN f ON f.cx = s.cx AND f.cz = s.cz AND s.lod = gl GROUP BY ALL)
SELECT v.mesh, v.vi, round(CASE WHEN gl <= lod AND hi - lo <= 1.5 AND NOT (gl = lod AND m0 = m1 AND m0 = mesh) AND y - lowest <= 2.5 AND abs(mean - y) <= 1.5 THEN mean ELSE y END, 6) AS y
FROM v LEFT JOIN c ON c.cx = floor(v.x) AND c.cz = floor(v.z)""")
def welded_vertices(spark, sf):
    v, t = _soup(spark, sf)
    return mesh.welded(v, t).select("mesh", "vi", F.round("y", 6).alias("y"))


@query("stripped_triangles", f"""
WITH {_V}, {_TRI}, h AS (SELECT CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(z / 5) AS BIGINT) AS cz, min(y) - 0.25 AS h FROM v GROUP BY 1, 2),
a AS (SELECT vi, y - coalesce(h, 0) AS above FROM v LEFT JOIN h ON cx = CAST(floor(x / 5) AS BIGINT) AND cz = CAST(floor(z / 5) AS BIGINT))
SELECT g.mesh, g.ti FROM g JOIN a p ON p.vi = ti JOIN a q ON q.vi = i1 JOIN a r ON r.vi = i2 WHERE NOT (up > 0.85 AND (p.above + q.above + r.above) / 3 < 0.75)""")
def stripped_triangles(spark, sf):
    v, t = _soup(spark, sf)
    h = nodes(spark, sf).select(*_xyz()).groupBy(F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("z") / 5).alias("cz")).agg((F.min("y") - 0.25).alias("h"))
    return mesh.strip_ground(t, v, h, 5.0, distance=0.75, whole=True).select("mesh", "ti")


@query("corridor_triangles", f"""
WITH {_V}, {_TRI}, r AS (SELECT n_nationkey % 20 AS ax, n_nationkey % 25 AS az, n_nationkey * 3 % 20 AS bx, n_nationkey * 7 % 25 AS bz FROM nation),
d AS (SELECT mesh, ti, (ax + bx + cx) / 3 AS px, (az + bz + cz) / 3 AS pz FROM g),
e AS (SELECT d.*, r.*, greatest(0, least(1, ((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / nullif((bx - ax) * (bx - ax) + (bz - az) * (bz - az), 0))) AS t FROM d, r)
SELECT DISTINCT mesh, ti FROM e WHERE pow(px - ax - (bx - ax) * coalesce(t, 0), 2) + pow(pz - az - (bz - az) * coalesce(t, 0), 2) <= 0.2025""")
def corridor_triangles(spark, sf):
    v, t = _soup(spark, sf)
    k = F.col("n_nationkey")
    r = read(spark, sf, "nation").select((k % 20).alias("ax"), (k % 25).alias("az"), (k * 3 % 20).alias("bx"), (k * 7 % 25).alias("bz"))
    return mesh.in_corridor(t, v, r, 0.45).select("mesh", "ti")


@query("ribbons", f"""
WITH s AS (SELECT line, idx, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
n AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN -dy / sqrt(dx * dx + dy * dy) ELSE 0 END AS nx, CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0 END AS ny FROM s)
SELECT line, idx * 2 + k AS vi, round(x + nx * d, 6) AS x, round(y + ny * d, 6) AS y FROM n, (VALUES (0, 2.5::DOUBLE), (1, -2.5::DOUBLE)) AS q(k, d)""")
def ribbons(spark, sf):
    from geoloom.operators import shapes

    return shapes.ribbon(lines(spark, sf), 2.5).select("line", "vi", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("tree_rows", f"""
WITH s AS (SELECT line, idx, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
n AS (SELECT *, greatest(1, CAST(floor(sqrt(pow(bx - x, 2) + pow(by - y, 2)) / 8) AS INT)) AS n FROM s WHERE bx IS NOT NULL), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n)
SELECT line, idx, CAST(k AS INT) AS k, round(x + (bx - x) * k / n, 6) AS x, round(y + (by - y) * k / n, 6) AS y FROM k""")
def tree_rows(spark, sf):
    from geoloom.operators import shapes

    parts = parts_of(read(spark, sf, "lineitem"), shapes.STRETCHES)
    return shapes.along(lines(spark, sf), 8.0, parts).select("line", "idx", "k", rounded(F.col("x"), 6).alias("x"), rounded(F.col("y"), 6).alias("y"))


@query("walls", f"""
WITH e AS (SELECT id, ring, unnest(range(1, len(ring) + 1)) AS i FROM {RINGS}), w AS (SELECT id, i - 1 AS wall, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM e)
SELECT id, CAST(wall AS INT) AS wall, CAST(c AS INT) AS corner, CASE WHEN c IN (0, 3) THEN a.x ELSE b.x END AS x, CASE WHEN c IN (0, 3) THEN a.y ELSE b.y END AS y, CASE WHEN c < 2 THEN 0.0 ELSE 3.0 + id % 5 END::DOUBLE AS z FROM w, (SELECT unnest(range(0, 4)) AS c)""")
def walls(spark, sf):
    from geoloom.operators import shapes

    return shapes.extruded(rings(spark, sf).withColumn("low", F.lit(0.0)).withColumn("high", 3.0 + F.col("id") % 5))


@query("scattered_trees")
def scattered_trees(spark, sf):
    from geoloom.operators import shapes

    return shapes.scattered(rings(spark, sf), 4.0, 2000)


@query("relation_rings")
def relation_rings(spark, sf):
    """Chains of order lines, two nodes a member, by order."""
    from geoloom.operators import shapes

    w = ways(spark, sf)
    m = w.select(F.col("way").alias("rel"), F.col("idx").alias("ord"), F.array((F.col("px") % 4).cast("string"), (F.col("py") % 4).cast("string")).alias("nodes"))
    return shapes.rings_of_relations(m)


@query("conformed_vertices", f"""
WITH {_V}, {_TRI}, h AS (SELECT CAST(floor(x / 6) AS BIGINT) AS cx, CAST(floor(z / 6) AS BIGINT) AS cz, min(y) + 0.125 AS h FROM v GROUP BY 1, 2),
r AS (SELECT v.*, CAST(floor(x / 6) AS BIGINT) AS cx, CAST(floor(z / 6) AS BIGINT) AS cz FROM v), o AS (SELECT r.*, y - coalesce(h, 0) AS r FROM r LEFT JOIN h USING (cx, cz)),
u AS (SELECT ti AS vi FROM g WHERE up > 0.85 UNION ALL SELECT i1 FROM g WHERE up > 0.85 UNION ALL SELECT i2 FROM g WHERE up > 0.85),
d AS (SELECT cx, cz, median(r) AS d FROM u JOIN o USING (vi) WHERE abs(r) < 2.5 GROUP BY cx, cz)
SELECT mesh, vi, round(y - greatest(-15, least(15, coalesce(d, 0))), 6) AS y FROM r LEFT JOIN d USING (cx, cz)""")
def conformed_vertices(spark, sf):
    v, t = _soup(spark, sf)
    h = v.groupBy(F.floor(F.col("x") / 6).alias("cx"), F.floor(F.col("z") / 6).alias("cz")).agg((F.min("y") + 0.125).alias("h"))
    return mesh.conformed(v, t, h, 6.0).select("mesh", "vi", F.round("y", 6).alias("y"))


@query("layer_map", f"""
WITH s AS (SELECT id AS ord, id % 4 AS mat, 1.3::DOUBLE AS half, ring[1].x AS ax, ring[1].y AS ay, ring[2].x AS bx, ring[2].y AS by FROM {RINGS}),
q AS (SELECT s.*, x.i AS px, y.i AS py FROM s, (SELECT unnest(range(0, 64)) AS i) x, (SELECT unnest(range(0, 64)) AS i) y),
t AS (SELECT *, coalesce(greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0))), 0) AS t FROM q),
roads AS (SELECT px, py, arg_max(mat, ord) AS mat FROM t WHERE pow(px - ax - (bx - ax) * t, 2) + pow(py - ay - (by - ay) * t, 2) <= half * half GROUP BY px, py),
e AS (SELECT id, unnest(list_zip(ring, {_NEXT})) AS e FROM {RINGS}), f AS (SELECT id, e[1].x AS ax, e[1].y AS ay, e[2].x AS bx, e[2].y AS by FROM e),
g AS (SELECT *, unnest(range(0, 64)) AS py FROM f WHERE ay <> by), x AS (SELECT id, py, ax + (py + 0.5 - ay) / (by - ay) * (bx - ax) AS x FROM g WHERE py + 0.5 >= least(ay, by) AND py + 0.5 < greatest(ay, by)),
r AS (SELECT id, py, list_sort(list(x)) AS xs FROM x GROUP BY id, py), u AS (SELECT id, py, xs, unnest(range(1, len(xs) // 2 + 1)) AS i FROM r),
p AS (SELECT id, py, unnest(range(greatest(0, CAST(ceil(xs[2 * i - 1]) AS BIGINT)), least(63, CAST(floor(xs[2 * i]) AS BIGINT)) + 1)) AS px FROM u),
areas AS (SELECT px, py, arg_max(id % 8, id) AS mat FROM p GROUP BY px, py)
SELECT CAST(coalesce(r.px, a.px) AS INT) AS px, CAST(coalesce(r.py, a.py) AS INT) AS py, coalesce(r.mat, a.mat) AS mat FROM roads r FULL JOIN areas a ON a.px = r.px AND a.py = r.py""")
def layer_map(spark, sf):
    """Areas, then the first side of each ring as a road over them."""
    r, k = rings(spark, sf), F.col("id")
    areas = geometry.rasterized_rings(r.select(k.alias("ord"), (k % 8).alias("mat"), "ring"), 64)
    side = lambda i, c: F.col("ring")[i][c]
    roads = geometry.rasterized_segments(r.select(k.alias("ord"), (k % 4).alias("mat"), F.lit(1.3).alias("half"), side(0, "x").alias("ax"), side(0, "y").alias("ay"), side(1, "x").alias("bx"), side(1, "y").alias("by")), 64)
    return geometry.layer_map([areas, roads])


@query("trimmed_lines", f"""
WITH s AS (SELECT line, idx, x, y, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM {LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
a AS (SELECT *, sum(d) OVER (PARTITION BY line ORDER BY idx) AS arc FROM s), t AS (SELECT *, max(arc) OVER (PARTITION BY line) AS total FROM a),
g AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by, lead(arc) OVER w AS b FROM t WHERE total > 100 WINDOW w AS (PARTITION BY line ORDER BY idx)),
c AS (SELECT line, arc, x, y FROM g WHERE arc > 40 AND arc < total - 60 UNION ALL
 SELECT line, 40, x + (bx - x) * (40 - arc) / (b - arc), y + (by - y) * (40 - arc) / (b - arc) FROM g WHERE b > arc AND 40 >= arc AND 40 < b UNION ALL
 SELECT line, total - 60, x + (bx - x) * (total - 60 - arc) / (b - arc), y + (by - y) * (total - 60 - arc) / (b - arc) FROM g WHERE b > arc AND total - 60 >= arc AND total - 60 < b)
SELECT line, round(arc, 4) AS arc, round(x, 4) AS x, round(y, 4) AS y FROM c""")
def trimmed_lines(spark, sf):
    return geometry.trimmed(lines(spark, sf), 40.0, 60.0).select("line", *[F.round(c, 4).alias(c) for c in ("arc", "x", "y")])
