"""Queries of junction polygons, their clusters and the gaps between road bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import clusters, gaps

from .registry import query
from .views import read

# roads of customers end at the nodes of a nation: arms in twelve whole directions, of lengths whose squares are whole
_DIRECTIONS = ((5, 0), (4, 3), (3, 4), (0, 5), (-3, 4), (-4, 3), (-5, 0), (-4, -3), (-3, -4), (0, -5), (3, -4), (4, -3))
_X, _Y = ([d[i] for d in _DIRECTIONS] for i in (0, 1))
_ARMS = f"""(SELECT c_nationkey * 40 + c_custkey % 40 AS node, c_custkey AS seg, 'start' AS e, {_X}[k + 1] / 5.0::DOUBLE AS dx, {_Y}[k + 1] / 5.0::DOUBLE AS dy, (1 + c_custkey % 3 + k % 2 * 0.5)::DOUBLE AS half,
 (c_nationkey * 50 + {_X}[k + 1] * (1 + c_custkey % 2))::DOUBLE AS x, (c_custkey % 40 * 50 + {_Y}[k + 1] * (1 + c_custkey % 2))::DOUBLE AS y, (c_custkey % 7 * 0.25)::DOUBLE AS z FROM (SELECT *, c_custkey // 40 * 5 % 12 AS k FROM customer))"""


def arms(spark, sf):
    c = F.col("c_custkey")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") + 1).cast("int"))
    rows = read(spark, sf, "customer").withColumn("k", F.floor(c / 40) * 5 % 12)
    dx, dy = of(_X) / 5.0, of(_Y) / 5.0
    x, y = F.col("c_nationkey") * 50 + of(_X) * (1 + c % 2), c % 40 * 50 + of(_Y) * (1 + c % 2)
    return rows.select((F.col("c_nationkey") * 40 + c % 40).alias("node"), c.alias("seg"), F.lit("start").alias("end"), dx.alias("dx"), dy.alias("dy"), (1 + c % 3 + F.col("k") % 2 * 0.5).cast("double").alias("half"), x.cast("double").alias("x"), y.cast("double").alias("y"), (c % 7 * 0.25).cast("double").alias("z"))


_NEAR = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 0.01"


@query("junction_rings", f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY atan2(dy, dx), seg, e) AS i, count(*) OVER (PARTITION BY node) AS n FROM {_ARMS}),
c AS (SELECT node, i * 2 + s AS j, {{'x': x + side * dy * half, 'y': y - side * dx * half, 'z': z}} AS p FROM a, (VALUES (0, 1.0::DOUBLE), (1, -1.0::DOUBLE)) AS v(s, side) WHERE n >= 3),
r(node, j, ring) AS (SELECT node, j, [p] FROM c WHERE j = 2
 UNION ALL SELECT node, c.j, CASE WHEN sqrt((ring[-1].x - p.x) * (ring[-1].x - p.x) + (ring[-1].y - p.y) * (ring[-1].y - p.y)) < 0.01 THEN list_append(ring[:-2], {{'x': ring[-1].x, 'y': ring[-1].y, 'z': (ring[-1].z + p.z) * 0.5}}) ELSE list_append(ring, p) END
 FROM r JOIN c USING (node) WHERE c.j = r.j + 1),
w AS (SELECT node, arg_max(ring, j) AS ring FROM r GROUP BY node),
s AS (SELECT node, CASE WHEN len(ring) > 1 AND sqrt(pow(ring[1].x - ring[-1].x, 2) + pow(ring[1].y - ring[-1].y, 2)) < 0.01 THEN list_concat([{{'x': ring[1].x, 'y': ring[1].y, 'z': (ring[1].z + ring[-1].z) * 0.5}}], ring[2:-2]) ELSE ring END AS ring FROM w),
k AS (SELECT node, len(ring) AS n, unnest(range(1, len(ring) + 1)) AS i, unnest(ring) AS p FROM s WHERE len(ring) > 2)
SELECT node, CAST(i - 1 AS INT) AS i, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.z, 6) AS z, round(avg(p.z) OVER (PARTITION BY node), 6) AS cz FROM k""")
def junction_rings(spark, sf):
    """Corners of the rings around the nodes where three customers' roads or more end."""
    rings = clusters.rings_of_arms(arms(spark, sf))
    return rings.select("node", F.posexplode("ring").alias("i", "p"), F.round("cz", 6).alias("cz")).select("node", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("p.z", 6).alias("z"), "cz")


# squares of parts on a grid of 20 m with jitter, some high above the others
_BOXES = "(SELECT p_partkey AS id, p_partkey % 150 * 20 + (p_partkey * p_partkey * 7 + p_partkey) % 13 AS bx, p_partkey // 150 * 20 + (p_partkey * p_partkey * 5 + p_partkey * 3) % 11 AS b_y, 1 + p_partkey % 4 AS r, CASE WHEN p_partkey % 29 = 0 THEN 3.0 ELSE p_partkey % 3 * 0.5 END::DOUBLE AS z FROM part)"


def squares(spark, sf):
    k = F.col("p_partkey")
    x, y, r = k % 150 * 20 + (k * k * 7 + k) % 13, F.floor(k / 150) * 20 + (k * k * 5 + k * 3) % 11, 1 + k % 4
    z = F.when(k % 29 == 0, 3.0).otherwise(k % 3 * 0.5)
    point = lambda i, j, up: F.struct((x + i * r).cast("double").alias("x"), (y + j * r).cast("double").alias("y"), (z + up).cast("double").alias("z"))
    return read(spark, sf, "part").select(k.alias("id"), F.array(point(-1, -1, 0.0), point(1, -1, 0.25), point(1, 1, 0.0), point(-1, 1, 0.0), point(0, 0, 0.0)).alias("ring"))


@query("junction_clusters", f"""
WITH RECURSIVE b AS (SELECT * FROM {_BOXES}),
c AS (SELECT id, bx + i * r AS x, b_y + j * r AS y, z + up AS z FROM b, (VALUES (-1, -1, 0.0::DOUBLE), (1, -1, 0.25::DOUBLE), (1, 1, 0.0::DOUBLE), (-1, 1, 0.0::DOUBLE), (0, 0, 0.0::DOUBLE)) AS v(i, j, up)),
l AS (SELECT a.id AS a, o.id AS b FROM b a JOIN b o ON o.bx BETWEEN a.bx - 15 AND a.bx + 15 AND abs(a.b_y - o.b_y) <= 15 AND a.id <> o.id
      WHERE (abs(a.bx - o.bx) <= a.r + o.r + 1 AND abs(a.b_y - o.b_y) <= a.r + o.r + 1) OR pow(a.bx - o.bx, 2) + pow(a.b_y - o.b_y, 2) <= 225),
w AS (SELECT id, id AS seen FROM b UNION SELECT w.id, l.b FROM w JOIN l ON l.a = w.seen),
g AS (SELECT id, min(seen) AS label, count(*) AS n FROM w GROUP BY id),
h AS (SELECT label, max(z) - min(z) AS span FROM g JOIN c USING (id) GROUP BY label),
m AS (SELECT id, CASE WHEN span <= 1.5 THEN g.label ELSE id END AS cluster, CASE WHEN span <= 1.5 THEN n ELSE 1 END AS members FROM g JOIN h ON g.label = h.label),
p AS (SELECT cluster, x, y, max(z) AS z, any_value(members) AS members FROM m JOIN c USING (id) GROUP BY cluster, x, y),
e AS (SELECT p.*, q.x AS qx, q.y AS qy FROM p JOIN p q ON p.cluster = q.cluster AND (p.x <> q.x OR p.y <> q.y)
      WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.cluster = p.cluster AND ((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0
        OR ((q.x - p.x) * (o.y - p.y) = (q.y - p.y) * (o.x - p.x) AND ((o.x - p.x) * (q.x - p.x) + (o.y - p.y) * (q.y - p.y) < 0 OR (o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y) > (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))))))
SELECT cluster, any_value(members) AS members, CAST(count(*) AS INT) AS corners, round(sum(x * qy - qx * y) / 2, 6) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM e GROUP BY cluster""")
def junction_clusters(spark, sf):
    """Squares of parts joined to hulls where they lie close and level."""
    area = F.aggregate(F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v) / 2
    out = clusters.clustered(squares(spark, sf))
    return out.select("cluster", F.col("members").cast("long").alias("members"), F.size("ring").alias("corners"), F.round(area, 6).alias("area"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])


# three roads from each supplier's place; their bodies begin some metres out
_ROADS = """(SELECT s_suppkey * 3 + k AS seg, s_suppkey % 40 * 40 AS ox, s_suppkey // 40 * 40 AS oy, ex, ey, (2 + s_suppkey % 3)::DOUBLE AS half, (3 + s_suppkey % 4) / 16.0::DOUBLE AS t, (s_suppkey % 5 * 0.25 + k * CASE WHEN s_suppkey % 7 = 0 THEN 1.0 ELSE 0.25 END)::DOUBLE AS z
 FROM supplier, (VALUES (0, 12, 0), (1, -6, 10), (2, -6, -10)) AS v(k, ex, ey) WHERE s_suppkey % 11 > 0 OR k = 0)"""
_WITHIN = "pow(px + 0.5 - (ax + (bx - ax) * t), 2) + pow(py + 0.5 - (ay + (b_y - ay) * t), 2) <= half * half"


def roads(spark, sf):
    s = F.col("s_suppkey")
    arm = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("ex"), F.lit(y).alias("ey")) for k, x, y in ((0, 12, 0), (1, -6, 10), (2, -6, -10))])).alias("a")
    r = read(spark, sf, "supplier").select("s_suppkey", arm).select("s_suppkey", "a.*").where((s % 11 > 0) | (F.col("k") == 0))
    step = F.when(s % 7 == 0, 1.0).otherwise(0.25)
    return r.select((s * 3 + F.col("k")).alias("seg"), (s % 40 * 40).alias("ox"), (F.floor(s / 40) * 40).alias("oy"), "ex", "ey", (2 + s % 3).cast("double").alias("half"), ((3 + s % 4) / 16.0).alias("t"), (s % 5 * 0.25 + F.col("k") * step).alias("z"))


@query("gap_junctions", f"""
WITH RECURSIVE r AS (SELECT * FROM {_ROADS}), o AS (SELECT CAST(unnest(range(-18, 18)) AS BIGINT) AS d),
px AS (SELECT r.*, ox + u.d AS px, oy + v.d AS py FROM r, o u, o v),
s AS (SELECT *, ox::DOUBLE AS ax, oy::DOUBLE AS ay, (ox + ex)::DOUBLE AS bx, (oy + ey)::DOUBLE AS b_y FROM px),
ref AS (SELECT DISTINCT px, py FROM (SELECT * EXCLUDE (t), greatest(0.0, least(1.0, ((px + 0.5 - ax) * (bx - ax) + (py + 0.5 - ay) * (b_y - ay)) / (ex * ex + ey * ey))) AS t FROM s) WHERE {_WITHIN}),
s2 AS (SELECT * EXCLUDE (ax, ay, t), ox + ex * t AS ax, oy + ey * t AS ay FROM s),
l AS (SELECT *, (px + 0.5 - ax) * (bx - ax) + (py + 0.5 - ay) * (b_y - ay) AS along, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) AS size FROM s2),
cov AS (SELECT DISTINCT px, py FROM (SELECT *, along / size AS t FROM l WHERE along >= 0 AND along <= size) WHERE {_WITHIN}),
h AS (SELECT px, py, py * 4294967296 + px + 2147483648 AS id FROM ref WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.px = ref.px AND cov.py = ref.py)),
l2 AS (SELECT a.id AS a, b.id AS b FROM h a JOIN (SELECT id, px + i AS px, py + j AS py FROM h, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS v(i, j)) b ON a.px = b.px AND a.py = b.py),
w AS (SELECT id, id AS seen FROM h UNION SELECT w.id, l2.b FROM w JOIN l2 ON l2.a = w.seen),
p AS (SELECT px, py, h.id, min(seen) AS patch FROM h JOIN w ON h.id = w.id GROUP BY px, py, h.id),
g AS (SELECT patch, count(*) AS cells, avg(px) + 0.5 AS mx, avg(py) + 0.5 AS my, 1.4 * greatest(0.5 * sqrt(pow(max(px) + 1 - min(px), 2) + pow(max(py) + 1 - min(py), 2)), (SELECT max(half) FROM r)) AS reach FROM p GROUP BY patch HAVING count(*) >= 2),
ends AS (SELECT seg, ox::DOUBLE AS x, oy::DOUBLE AS y, z FROM r UNION ALL SELECT seg, (ox + ex)::DOUBLE, (oy + ey)::DOUBLE, z FROM r),
f AS (SELECT patch, cells FROM g JOIN ends ON pow(x - mx, 2) + pow(y - my, 2) <= reach * reach GROUP BY patch, cells HAVING count(DISTINCT seg) >= 2 AND max(z) - min(z) <= 1.5),
q AS (SELECT patch, cells, px + 0.5::DOUBLE AS x, py + 0.5::DOUBLE AS y FROM p JOIN f USING (patch)),
c AS (SELECT DISTINCT a.* FROM q a JOIN q b ON a.patch = b.patch AND (a.x <> b.x OR a.y <> b.y)
      WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.patch = a.patch AND ((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) < 0
        OR ((b.x - a.x) * (o.y - a.y) = (b.y - a.y) * (o.x - a.x) AND ((o.x - a.x) * (b.x - a.x) + (o.y - a.y) * (b.y - a.y) < 0 OR (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) > (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))))),
m AS (SELECT *, avg(x) OVER (PARTITION BY patch) AS mx, avg(y) OVER (PARTITION BY patch) AS my, count(*) OVER (PARTITION BY patch) AS n FROM c),
k AS (SELECT patch, cells, n, row_number() OVER () AS id, x + (x - mx) / sqrt(pow(x - mx, 2) + pow(y - my, 2)) * 0.25 AS x, y + (y - my) / sqrt(pow(x - mx, 2) + pow(y - my, 2)) * 0.25 AS y FROM m WHERE n > 2),
t AS (SELECT seg * 2 AS target, ox + ex * t AS tx, oy + ey * t AS ty, z FROM r UNION ALL SELECT seg * 2 + 1, (ox + ex)::DOUBLE, (oy + ey)::DOUBLE, z FROM r),
v AS (SELECT k.id, any_value(k.patch) AS patch, any_value(cells) AS cells, any_value(x) AS x, any_value(y) AS y, arg_min(z, (round(pow(x - tx, 2) + pow(y - ty, 2), 9), target)) AS z FROM k JOIN t ON abs(x - tx) < 60 AND abs(y - ty) < 60 GROUP BY k.id)
SELECT patch, CAST(any_value(cells) AS BIGINT) AS cells, CAST(count(*) AS INT) AS corners, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM v GROUP BY patch""")
def gap_junctions(spark, sf):
    """Polygons for what three roads from each place leave open, at one metre a cell."""
    r = roads(spark, sf)
    start = [(F.col(o) + F.col(e) * F.col("t")) for o, e in (("ox", "ex"), ("oy", "ey"))]
    far = [(F.col(o) + F.col(e)).cast("double") for o, e in (("ox", "ex"), ("oy", "ey"))]
    segs = lambda a, ends: r.select("half", a[0].cast("double").alias("ax"), a[1].cast("double").alias("ay"), far[0].alias("bx"), far[1].alias("by"), F.lit(ends).alias("round_a"), F.lit(ends).alias("round_b"))
    reference, coverage = gaps.covered_cells(segs([F.col("ox"), F.col("oy")], True)), gaps.covered_cells(segs(start, False))
    place = lambda p, key: r.select(key, p[0].cast("double").alias("x"), p[1].cast("double").alias("y"), "z")
    ends = place([F.col("ox"), F.col("oy")], "seg").union(place(far, "seg"))
    nodes = place(start, (F.col("seg") * 2).alias("target")).union(place(far, (F.col("seg") * 2 + 1).alias("target")))
    widest = r.agg(F.max("half")).first()[0] or 0.0
    out = gaps.gap_junctions(reference, coverage, ends, nodes, 1.0, widest)
    return out.select("patch", "cells", F.size("ring").alias("corners"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])
