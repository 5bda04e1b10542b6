"""Queries of lines' ends and turns, stations and frames of routes, counts and keys of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import tags
from geoloom.functions.scalars import rounded
from geoloom.operators import batch, fields, geometry, routes

from .registry import query
from .views import WAYS, read, tagged, tagged_sql, ways

#: Orders as lines in steps of a few metres.
_LINES = f"(SELECT way AS line, idx, (px % 13)::DOUBLE AS x, (py % 11)::DOUBLE AS y, (px % 7)::DOUBLE AS z FROM {WAYS})"


def _lines(spark, sf):
    return ways(spark, sf).select(F.col("way").alias("line"), "idx", (F.col("px") % 13).cast("double").alias("x"), (F.col("py") % 11).cast("double").alias("y"), (F.col("px") % 7).cast("double").alias("z"))


@query("smoothed_kinks", f"""
WITH p AS (SELECT line, idx, x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM {_LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)),
g AS (SELECT *, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS f, sqrt(pow(bx - x, 2) + pow(b_y - y, 2)) AS l FROM p),
t AS (SELECT *, CASE WHEN f = 0 OR l = 0 THEN 90 ELSE degrees(acos(greatest(-1, least(1, ((x - ax) * (bx - x) + (y - ay) * (b_y - y)) / f / l)))) END AS turn, least(2, least(f, l) * 0.4) AS off FROM g),
k AS (SELECT *, CASE WHEN ax IS NULL OR bx IS NULL OR turn <= CASE WHEN f < 4 OR l < 4 THEN 30 ELSE 75 END THEN 1 WHEN f < 4 OR l < 4 THEN 0 ELSE 2 END AS m FROM t),
q AS (SELECT line, idx, 0 AS n, CASE WHEN m = 1 THEN x ELSE x + (ax - x) * off / f END AS x, CASE WHEN m = 1 THEN y ELSE y + (ay - y) * off / f END AS y FROM k WHERE m > 0 UNION ALL SELECT line, idx, 1, x + (bx - x) * off / l, y + (b_y - y) * off / l FROM k WHERE m = 2)
SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY idx, n) - 1 AS INT) AS idx, round(x, 6) AS x, round(y, 6) AS y FROM q""")
def smoothed_kinks(spark, sf):
    return geometry.smoothed_kinks(_lines(spark, sf)).select("line", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_PRUNED = """(SELECT * FROM (SELECT *, max(CASE WHEN i > 1 AND i < n AND far THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY i) AS seen FROM (SELECT *, sqrt(pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2)) >= 2 AS far,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY line) AS n FROM {} WINDOW w AS (PARTITION BY line ORDER BY idx {}))) WHERE i = 1 OR i = n OR seen = 1)"""


@query("pruned_ends", f"SELECT line, idx, x, y FROM {_PRUNED.format(f'(SELECT line, idx, x, y FROM {_PRUNED.format(_LINES, chr(32))})', 'DESC')}")
def pruned_ends(spark, sf):
    return geometry.pruned_ends(_lines(spark, sf)).select("line", "idx", "x", "y")


_ARCS = f"(SELECT *, sum(step) OVER (PARTITION BY line ORDER BY idx) AS arc FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM {_LINES} WINDOW w AS (PARTITION BY line ORDER BY idx)))"


@query("end_tangents", f"""
WITH a AS (SELECT *, max(arc) OVER (PARTITION BY line) AS total, max(idx) OVER (PARTITION BY line) AS last FROM {_ARCS}),
s AS (SELECT line, 'start' AS "end", coalesce(min(idx) FILTER (arc >= 3), max(idx)) AS q, 0 AS p FROM a GROUP BY line UNION ALL SELECT line, 'end', coalesce(max(idx) FILTER (total - arc >= 3), 0), max(idx) FROM a GROUP BY line),
d AS (SELECT s.line, s."end", u.x - v.x AS dx, u.y - v.y AS dy FROM s JOIN a u ON u.line = s.line AND u.idx = s.p JOIN a v ON v.line = s.line AND v.idx = s.q)
SELECT line, "end", round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx / sqrt(dx * dx + dy * dy) END, 6) AS dx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy / sqrt(dx * dx + dy * dy) END, 6) AS dy FROM d""")
def end_tangents(spark, sf):
    return geometry.end_tangents(_lines(spark, sf)).select("line", "end", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("heights_along", f"""
WITH a AS (SELECT *, lead(arc) OVER w AS b, lead(z) OVER w AS z2, max(arc) OVER (PARTITION BY line) AS total FROM {_ARCS} WINDOW w AS (PARTITION BY line ORDER BY idx))
SELECT line, round(coalesce(max(CASE WHEN b > arc AND least(5, total) > arc AND least(5, total) <= b THEN z + (z2 - z) * (least(5, total) - arc) / (b - arc) END), arg_min(z, idx)), 6) AS z FROM a GROUP BY line""")
def heights_along(spark, sf):
    return geometry.height_along(_lines(spark, sf), 5.0).select("line", F.round("z", 6).alias("z"))


@query("corridor_stations", f"""
WITH p AS (SELECT way AS route, idx, px * 1.0::DOUBLE - 498 AS e, py * 1.0::DOUBLE - 495 AS n FROM {WAYS}),
s AS (SELECT *, lead(e) OVER w AS e2, lead(n) OVER w AS n2 FROM p WINDOW w AS (PARTITION BY route ORDER BY idx)),
l AS (SELECT *, coalesce(sqrt(pow(e2 - e, 2) + pow(n2 - n, 2)), 0) AS len FROM s),
a AS (SELECT *, sum(len) OVER (PARTITION BY route ORDER BY idx) - len AS arc FROM l),
k AS (SELECT *, unnest(range(greatest(0, CAST(ceil((arc - 55) / 110) AS BIGINT)), CAST(ceil((arc + len - 55) / 110) AS BIGINT))) AS sample FROM a WHERE len > 1e-6),
m AS (SELECT route, sample, e + (e2 - e) * (sample * 110 + 55 - arc) / len AS e, n + (n2 - n) * (sample * 110 + 55 - arc) / len AS n, (e2 - e) / len AS de, (n2 - n) / len AS dn FROM k),
o AS (SELECT route, sample, i, side, e - dn * side * 127.5 AS e, n + de * side * 127.5 AS n, de, dn FROM m, (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)) AS v(i, side)),
b AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY sample, i) - 1 AS r, count(*) OVER (PARTITION BY route) AS total FROM o WHERE abs(e) <= 480 AND abs(n) <= 480),
c AS (SELECT *, greatest(1.0::DOUBLE, total / 60) AS stride FROM b)
SELECT route, CAST(sample AS BIGINT) AS sample, side, round(e, 5) AS e, round(n, 5) AS north FROM c WHERE floor(ceil(r / stride - 1e-9) * stride + 1e-9) = r AND ceil(r / stride - 1e-9) < 60""")
def corridor_stations(spark, sf):
    """Orders as routes in a box of 960 metres, with two rings of 127.5 metres each and at most 60 stations."""
    p = ways(spark, sf).select(F.col("way").alias("route"), "idx", (F.col("px") - 498.0).alias("e"), (F.col("py") - 495.0).alias("north"))
    s = routes.corridor_stations(p, 300.0, 110.0, 960.0, 60)
    return s.select("route", "sample", "side", rounded(F.col("e"), 5).alias("e"), rounded(F.col("north"), 5).alias("north"))


@query("route_frames", """
WITH c AS (SELECT o_custkey AS route, o_orderkey AS chunk, 40 + o_orderkey % 200 * 0.01::DOUBLE AS lat, 8 + o_orderkey % 130 * 0.02::DOUBLE AS lng, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 90)::DOUBLE END AS low, (o_orderkey % 4 * 0.05)::DOUBLE AS units FROM orders),
f AS (SELECT route, min(chunk) AS chunk FROM c GROUP BY route), a AS (SELECT c.* FROM c JOIN f USING (route, chunk)),
p AS (SELECT c.route, c.chunk, (c.lng - a.lng) * 111320 * cos(radians(a.lat)) AS e, (c.lat - a.lat) * 111320 AS n, coalesce(c.low, 0) - coalesce(a.low, 0) AS up, CASE WHEN c.units > 0 THEN 1 / c.units ELSE 1 END AS scale FROM c JOIN a ON a.route = c.route)
SELECT route, chunk, round(e, 4) AS east, round(n, 4) AS north, up, round(scale, 6) AS scale, round(min(e) OVER (PARTITION BY route) - 512, 4) AS min_x, round(max(-n) OVER (PARTITION BY route) + 512, 4) AS max_z FROM p""")
def route_frames(spark, sf):
    k = F.col("o_orderkey")
    c = read(spark, sf, "orders").select(F.col("o_custkey").alias("route"), k.alias("chunk"), (40 + k % 200 * 0.01).alias("lat"), (8 + k % 130 * 0.02).alias("lng"), F.when(k % 5 > 0, (k % 90).cast("double")).alias("low"), (k % 4 * 0.05).alias("units"))
    f = routes.route_frames(c, 1024.0)
    return f.select("route", "chunk", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), "up", F.round("scale", 6).alias("scale"), F.round("min_x", 4).alias("min_x"), F.round("max_z", 4).alias("max_z"))


@query("spawn_places", f"""
WITH r AS (SELECT way % 40 AS area, way AS road, idx, px / 10.0::DOUBLE AS lat, py / 10.0::DOUBLE AS lng, CASE WHEN way % 3 = 0 THEN 'steps' WHEN way % 3 = 1 THEN 'primary' END AS highway FROM {WAYS}),
m AS (SELECT r.* FROM r JOIN (SELECT area, road, count(*) AS n FROM r GROUP BY 1, 2) s USING (area, road) WHERE idx = n // 2 AND coalesce(highway, '') <> 'steps'),
c AS (SELECT n_nationkey * 2 AS area, n_nationkey * 4.0::DOUBLE AS lat, n_nationkey * 3.0::DOUBLE AS lng FROM nation)
SELECT area, coalesce(arg_min(m.lat, (sqrt(pow(m.lat - c.lat, 2) + pow(m.lng - c.lng, 2)), road)), any_value(c.lat)) AS lat, coalesce(arg_min(m.lng, (sqrt(pow(m.lat - c.lat, 2) + pow(m.lng - c.lng, 2)), road)), any_value(c.lng)) AS lng FROM c LEFT JOIN m USING (area) GROUP BY area""")
def spawn_places(spark, sf):
    w = F.col("way")
    r = ways(spark, sf).select((w % 40).alias("area"), w.alias("road"), "idx", (F.col("px") / 10.0).alias("lat"), (F.col("py") / 10.0).alias("lng"), F.when(w % 3 == 0, "steps").when(w % 3 == 1, "primary").alias("highway"))
    n = F.col("n_nationkey")
    return routes.spawn_places(r, read(spark, sf, "nation").select((n * 2).cast("long").alias("area"), (n * 4.0).alias("lat"), (n * 3.0).alias("lng")))


@query("feature_counts", """
SELECT p_size % 10 AS area, count(*) AS total, count(*) FILTER (k = 0) AS roads, count(*) FILTER (k = 1) AS buildings, count(*) FILTER (k = 2) AS water, count(*) FILTER (k = 3) AS vegetation, count(*) FILTER (k = 4) AS landuse,
  count(*) FILTER (coalesce(n, 0) <= 1) AS points, count(*) FILTER (n > 1 AND ring) AS polygons, count(*) FILTER (n > 1 AND NOT ring) AS lines
FROM (SELECT *, p_partkey % 6 AS k, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 7 - 1 END AS n, p_partkey % 11 > 5 AS ring FROM part) GROUP BY 1""")
def feature_counts(spark, sf):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("road", "building", "water", "vegetation", "landuse", "other")))
    f = read(spark, sf, "part").select((F.col("p_size") % 10).alias("area"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("kind"), F.when(k % 7 > 0, k % 7 - 1).alias("n_points"), F.when(k % 11 > 5, True).when(k % 11 > 2, False).alias("closed"))
    return fields.feature_counts(f, ["area"])


@query("style_keys", f"""
WITH q AS (SELECT *, CASE WHEN id % 4 > 0 THEN CAST(id % 3 AS VARCHAR) END AS layer FROM {tagged_sql()}),
l AS (SELECT id, CAST(CAST(coalesce(TRY_CAST(regexp_extract(trim(layer_), '^([-+]?\\d+)', 1) AS DOUBLE), CAST(coalesce(bridge_ IN ('yes', 'viaduct'), false) OR coalesce(man_made_ = 'bridge', false) AS INT) - CAST(coalesce(tunnel_ = 'yes', false) AS INT))
  + CASE WHEN barrier_ = 'retaining_wall' AND NOT coalesce(bridge_ IN ('yes', 'viaduct'), false) AND NOT coalesce(man_made_ = 'bridge', false) AND NOT coalesce(tunnel_ = 'yes', false) THEN 0.5 ELSE 0 END + CASE WHEN embankment_ = 'yes' THEN 0.5 ELSE 0 END AS DOUBLE) AS VARCHAR) AS own FROM q)
SELECT id, concat('["', coalesce(highway_, ''), '","', coalesce(layer, ''), '","","","', coalesce(width_, ''), '","', coalesce(lanes_, ''), '","', coalesce(lanes_forward_, ''), '","', coalesce(lanes_backward_, ''), '","', coalesce(oneway_, ''), '","', coalesce(surface_, ''), '"]') AS segment,
  concat('["', coalesce(highway_, ''), '","', coalesce(layer, ''), '","","","', coalesce(surface_, ''), '","', coalesce(oneway_, ''), '"]') AS texture,
  concat('["', coalesce(highway_, ''), '","', coalesce(layer, regexp_replace(own, '\\.0$', '')), '","","","', coalesce(oneway_, ''), '"]') AS corridor FROM q JOIN l USING (id)""")
def style_keys(spark, sf):
    t, layer = F.col("tags"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string"))
    return tagged(spark, sf).select("id", tags.segment_style_key(t["highway"], layer, t).alias("segment"), tags.corridor_style_key(t["highway"], layer, t).alias("texture"), tags.width_corridor_key(t["highway"], layer, t).alias("corridor"))


@query("reset_tiles", """
SELECT o_orderkey AS id, CASE WHEN s IN ('F', 'failed') THEN 'queued' WHEN s = 'O' THEN 'done' END AS status, CASE WHEN s = 'O' THEN o_orderpriority WHEN s IS NULL THEN o_orderpriority END AS error, CASE WHEN s = 'F' THEN 0 ELSE CAST(o_orderkey % 4 AS INT) END AS attempts
FROM (SELECT *, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS s FROM orders)""")
def reset_tiles(spark, sf):
    o = read(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").alias("status"), F.col("o_orderpriority").alias("error"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))
    return batch.reset_failed(t)


@query("own_tile_names", """
SELECT p_partkey AS index, n AS name FROM (SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN printf('R%dC%d', p_partkey // 7 + 1, p_partkey % 7 + 1) WHEN p_partkey % 3 = 1 THEN '  ' ELSE concat(' ', p_name, ' ') END) AS n FROM part)
WHERE n <> '' AND n <> printf('R%dC%d', p_partkey // 7 + 1, p_partkey % 7 + 1)""")
def own_tile_names(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.format_string("R%dC%d", F.floor(k / 7) + 1, k % 7 + 1)).when(k % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    tiles = (read(spark, sf, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1  # of the grid
    return batch.tile_names(read(spark, sf, "part").select(k.alias("index"), name.alias("name")), 7, tiles)


@query("mask_residuals", """
SELECT l_suppkey AS tile, count(*) FILTER (w > 0.5) AS n, round(sqrt(avg(pow(b - g, 2)) FILTER (w > 0.5)), 6) AS rms_before, round(sqrt(avg(pow(a - g, 2)) FILTER (w > 0.5)), 6) AS rms_after, round(max(abs(b - g)) FILTER (w > 0.5), 6) AS most_before, round(max(b) - min(b), 6) AS extent
FROM (SELECT *, l_discount * 10 AS w, l_quantity * 0.1 AS g, l_extendedprice * 0.001 AS b, l_quantity * 0.1 + l_tax AS a FROM lineitem) GROUP BY 1""")
def mask_residuals(spark, sf):
    v = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), (F.col("l_discount") * 10).alias("w"), (F.col("l_quantity") * 0.1).alias("ground"), (F.col("l_extendedprice") * 0.001).alias("before"), (F.col("l_quantity") * 0.1 + F.col("l_tax")).alias("after"))
    r = fields.roughness(v, ["tile"])
    return r.select("tile", "n", *[F.round(c, 6).alias(c) for c in ("rms_before", "rms_after", "most_before", "extent")])


@query("uncovered_cells", "SELECT DISTINCT l_partkey AS cx, l_suppkey AS cz FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)")
def uncovered_cells(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("cx"), F.col("l_suppkey").alias("cz"), "l_returnflag")
    return fields.uncovered(li, li.where("l_returnflag = 'R'"))
