"""Queries of feature rules with sizes, junctions, water, masks and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import tags
from geoloom.operators import junctions

from .registry import query
from .views import read, tagged, tagged_sql

_T = tagged_sql()


@query("barriers", f"""
SELECT id, CASE WHEN coalesce(lower(trim(barrier_)), '') IN ('', 'hedge') THEN NULL WHEN barrier_ IN ('wall', 'retaining_wall') THEN 'fence' ELSE 'guardrail' END AS asset,
  CASE WHEN barrier_ IN ('wall', 'retaining_wall') THEN 2.0 ELSE 1.5 END::DOUBLE AS height, CASE WHEN barrier_ IN ('wall', 'retaining_wall') THEN 0.5 ELSE 0.2 END::DOUBLE AS width,
  coalesce(natural_ IN ('bay'), false) OR coalesce(leisure_ = 'marina', false) AS sea, coalesce(surface_, landuse_, natural_, waterway_) IS NOT NULL AS cover FROM {_T}""")
def barriers(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select("id", tags.barrier_asset(t).alias("asset"), tags.barrier_size(t)["height_m"].alias("height"), tags.barrier_size(t)["width_m"].alias("width"), tags.excluded_water(t).alias("sea"), tags.ground_cover(t).alias("cover"))


@query("buildings", """
WITH b AS (SELECT p_partkey AS id, ['', 'house', 'office', 'garage', 'roof', 'yes'][p_partkey % 6 + 1] AS kind, CASE WHEN p_size % 4 = 0 THEN p_size / 2.0 END AS lv, CASE WHEN p_size % 5 = 0 THEN p_size + 0.5 END AS h, CASE WHEN p_size % 7 = 0 THEN 2.0 END AS rl, CASE WHEN p_size % 3 = 0 THEN 'gabled' ELSE 'flat' END AS shape, p_retailprice * 2 AS area FROM part),
l AS (SELECT *, CASE WHEN coalesce(lv, 0) <> 0 THEN lv WHEN h IS NOT NULL THEN greatest(1, floor(h / 3 + 0.5)) WHEN area > 2000 THEN 5 WHEN kind = 'house' THEN 2 WHEN kind = 'office' THEN 4 ELSE 1 END AS levels FROM b)
SELECT id, levels::DOUBLE AS levels, round(coalesce(h, CASE WHEN kind = 'garage' THEN 3.5 WHEN kind = 'roof' THEN 4 END, (levels + coalesce(rl, 0)) * 3)::DOUBLE, 6) AS height, shape AS roof,
  CASE WHEN shape <> 'flat' THEN CASE WHEN rl > 0 THEN rl * 3 ELSE 3 END ELSE 0 END::DOUBLE AS roof_height FROM l""")
def buildings(spark, sf):
    p, k, s = read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    text = lambda cond, v: F.when(cond, v.cast("string")).otherwise("")
    kinds = F.array(*map(F.lit, ("", "house", "office", "garage", "roof", "yes")))
    t = F.create_map(F.lit("building"), F.element_at(kinds, (k % 6 + 1).cast("int")), F.lit("building:levels"), text(s % 4 == 0, s / 2.0), F.lit("height"), text(s % 5 == 0, s + 0.5), F.lit("roof:levels"), text(s % 7 == 0, F.lit(2)), F.lit("roof:shape"), F.when(s % 3 == 0, "gabled").otherwise("flat"))
    b = p.select(k.alias("id"), tags.building_size(t, F.col("p_retailprice") * 2, k).alias("b"))
    return b.select("id", "b.levels", F.round("b.height", 6).alias("height"), "b.roof", "b.roof_height")


@query("waterways", """
SELECT p_partkey AS id, greatest(3.0, coalesce(w, d)) AS width, greatest(1.5, coalesce(deep, greatest(2.0, greatest(3.0, coalesce(w, d)) * 0.25))) AS depth FROM (
 SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size / 4.0 END::DOUBLE AS w, ([26, 14, 8, 4, 3, 10][p_partkey % 6 + 1])::DOUBLE AS d, ([8, 5, 3, 2, 1.5, NULL][p_partkey % 6 + 1])::DOUBLE AS deep FROM part)""")
def waterways(spark, sf):
    p, k, s = read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ("river", "canal", "stream", "drain", "ditch", "weir")))
    t = F.create_map(F.lit("waterway"), F.element_at(kinds, (k % 6 + 1).cast("int")), F.lit("width"), F.when(s % 3 == 0, F.concat((s / 4.0).cast("string"), F.lit(" m"))))
    return p.select(k.alias("id"), tags.waterway_size(t).alias("w")).select("id", "w.*")


@query("error_kinds", """
SELECT event_id AS id, CASE WHEN s = 429 THEN 'rate_limit' WHEN s IN (408, 425, 500, 502, 503, 504) THEN 'http_server' WHEN s BETWEEN 400 AND 499 THEN 'http_client' WHEN event_type = 'click' THEN 'aborted' WHEN event_type = 'view' THEN 'network' ELSE 'unknown' END AS kind,
 NOT (s BETWEEN 400 AND 499 AND s NOT IN (408, 425, 429) OR s NOT BETWEEN 400 AND 499 AND s NOT IN (500, 502, 503, 504) AND event_type = 'click') AS retryable FROM (SELECT *, 400 + event_id % 110 AS s FROM events)""")
def error_kinds(spark, sf):
    e = read(spark, sf, "events")
    kind = tags.error_kind(400 + F.col("event_id") % 110, F.when(F.col("event_type") == "click", "AbortError").otherwise("Error"), F.when(F.col("event_type") == "view", "request Timeout").otherwise("odd"))
    return e.select(F.col("event_id").alias("id"), kind.alias("k")).select("id", "k.*")


_ARMS = """(SELECT c_nationkey * 60 + c_custkey % 60 AS node, c_custkey AS seg, CASE WHEN c_custkey % 2 = 0 THEN 'start' ELSE 'end' END AS "end", cos(c_custkey * 0.7) AS dx, sin(c_custkey * 0.7) AS dy, 2.0::DOUBLE + c_custkey % 3 AS half, 10.0::DOUBLE + c_custkey % 30 AS length FROM customer)"""


@query("junction_trims", f"""
WITH a AS (SELECT *, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY atan2(dy, dx), seg, "end") AS i FROM {_ARMS}),
p AS (SELECT l.seg AS s1, l."end" AS e1, l.length AS l1, l.dx AS ax, l.dy AS ay, l.half AS wa, r.seg AS s2, r."end" AS e2, r.length AS l2, r.dx AS bx, r.dy AS b_y, r.half AS wb FROM a r JOIN a l ON l.node = r.node AND l.i % r.n + 1 = r.i WHERE r.n >= 3),
d AS (SELECT *, bx * ay - ax * b_y AS det, b_y * wb + ay * wa AS dx, -bx * wb - ax * wa AS dy, greatest(wa, wb) * 4 AS lim FROM p),
c AS (SELECT s1 AS seg, e1 AS "end", l1 AS length, CASE WHEN abs(det) < 1e-6 THEN 0 ELSE greatest(0, least(lim, (bx * dy - dx * b_y) / det)) END AS cut FROM d UNION ALL
 SELECT s2, e2, l2, CASE WHEN abs(det) < 1e-6 THEN 0 ELSE greatest(0, least(lim, (ax * dy - dx * ay) / det)) END FROM d)
SELECT seg, "end", round(max(least(cut, length * 0.4)), 6) AS cut FROM c GROUP BY seg, "end\"""")
def junction_trims(spark, sf):
    k = F.col("c_custkey")
    a = read(spark, sf, "customer").select((F.col("c_nationkey") * 60 + k % 60).alias("node"), k.alias("seg"), F.when(k % 2 == 0, "start").otherwise("end").alias("end"), F.cos(k * 0.7).alias("dx"), F.sin(k * 0.7).alias("dy"), (2.0 + k % 3).alias("half"), (10.0 + k % 30).alias("length"))
    return junctions.trims(a).select("seg", "end", F.round("cut", 6).alias("cut"))


_RINGS = "(SELECT s_suppkey AS id, list_transform(range(0, s_suppkey % 6), lambda k: {'x': ((s_suppkey * 37 + k * k * 11) % 64)::DOUBLE, 'y': ((s_suppkey * 53 + k * 29) % 64)::DOUBLE, 'z': (k % 3 * (s_suppkey % 4) * 0.5)::DOUBLE}) AS ring FROM supplier)"


def _rings(spark, sf, least=0):
    k = F.col("s_suppkey")
    point = lambda i: F.struct(((k * 37 + i * i * 11) % 64).cast("double").alias("x"), ((k * 53 + i * 29) % 64).cast("double").alias("y"), (i % 3 * (k % 4) * 0.5).cast("double").alias("z"))
    made = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")), lambda i: F.struct(i.alias("i"), point(i).alias("p"))), lambda q: q["i"] < k % 6)
    return read(spark, sf, "supplier").select(k.alias("id"), F.transform(made, lambda q: q["p"]).alias("ring")).where(F.size("ring") >= least)


@query("polygon_faults", f"""
WITH e AS (SELECT id, ring, len(ring) AS n, list_zip(ring, list_concat(ring[2:], ring[1:1])) AS z FROM {_RINGS}),
m AS (SELECT *, list_max(list_transform(ring, lambda p: p.x)) - list_min(list_transform(ring, lambda p: p.x)) AS sx, list_max(list_transform(ring, lambda p: p.y)) - list_min(list_transform(ring, lambda p: p.y)) AS sy, list_max(list_transform(ring, lambda p: p.z)) - list_min(list_transform(ring, lambda p: p.z)) AS sz,
 list_min(list_transform(z, lambda q: sqrt(pow(q[2].x - q[1].x, 2) + pow(q[2].y - q[1].y, 2)))) AS edge, abs(list_sum(list_transform(z, lambda q: q[1].x * q[2].y - q[2].x * q[1].y))) / 2 AS area FROM e)
SELECT id, CASE WHEN n < 3 THEN 'too_few_vertices' WHEN sqrt(sx * sx + sy * sy) > 200 THEN 'bbox_too_large' WHEN sz > 1.5 THEN 'z_range_too_large' WHEN edge < 0.05 THEN 'edge_too_short' WHEN area < 0.5 THEN 'area_too_small' END AS fault FROM m""")
def polygon_faults(spark, sf):
    return _rings(spark, sf).select("id", junctions.polygon_fault(F.col("ring")).alias("fault"))


@query("clamped_polygons", f"""
WITH u AS (SELECT id, ring, list_sort(list_transform(ring, lambda p: p.z))[len(ring) // 2 + 1] AS m FROM {_RINGS} WHERE len(ring) >= 3)
SELECT id, list_sum(list_transform(ring, lambda p: greatest(m - 0.25, least(m + 0.25, p.z)))) AS z FROM u""")
def clamped_polygons(spark, sf):
    r = _rings(spark, sf, 3).select("id", junctions.clamped_z(F.col("ring"), 0.5).alias("r"))
    return r.select("id", F.aggregate(F.transform("r", lambda p: p["z"]), F.lit(0.0), lambda s, v: s + v).alias("z"))


@query("water_blocks", f"""
WITH r AS (SELECT id, ring, list_avg(list_transform(ring, lambda p: p.x)) AS cx, list_avg(list_transform(ring, lambda p: p.y)) AS cy, list_sort(list_transform(ring, lambda p: p.z)) AS zs FROM {_RINGS} WHERE len(ring) >= 3),
e AS (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM r), d AS (SELECT *, ring[i % len(ring) + 1].x - ring[i].x AS dx, ring[i % len(ring) + 1].y - ring[i].y AS dy FROM e),
u AS (SELECT *, list_transform(ring, lambda p: ((p.x - cx) * dx + (p.y - cy) * dy) / sqrt(dx * dx + dy * dy)) AS u, list_transform(ring, lambda p: ((p.y - cy) * dx - (p.x - cx) * dy) / sqrt(dx * dx + dy * dy)) AS v FROM d WHERE dx * dx + dy * dy > 1e-12),
w AS (SELECT *, list_max(u) - list_min(u) AS w, list_max(v) - list_min(v) AS l FROM u),
b AS (SELECT id, any_value(cx) AS cx, any_value(cy) AS cy, any_value(zs) AS zs, arg_min({{'w': w, 'l': l}}, (round(w * l, 9), i)) AS b FROM w GROUP BY id),
p AS (SELECT *, greatest(4, b.w) AS w, greatest(4, b.l) AS l FROM b), q AS (SELECT *, w + 2 * greatest(1.5, least(6.9, least(w, l) * 0.092)) AS width, l + 2 * greatest(1.5, least(6.9, least(w, l) * 0.092)) AS length FROM p)
SELECT id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(zs[CAST(floor((len(zs) - 1) * 0.8) AS BIGINT) + 1] + 0.14, 6) AS surface, round(width, 6) AS width, round(length, 6) AS length, round(greatest(1.5, least(width, length) * 0.08), 6) AS height FROM q""")
def water_blocks(spark, sf):
    return junctions.water_blocks(_rings(spark, sf, 3)).select("id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "surface", "width", "length", "height")])


@query("ground_mask", """
WITH s AS (SELECT 1.5 + s_suppkey % 3 AS half, (s_suppkey * 7 % 64)::DOUBLE AS ax, (s_suppkey * 13 % 64)::DOUBLE AS az, (s_suppkey * 11 % 64)::DOUBLE AS bx, (s_suppkey * 5 % 64)::DOUBLE AS bz FROM supplier),
c AS (SELECT s.*, x.i AS cx, z.i AS cz FROM s, (SELECT unnest(range(0, 64)) AS i) x, (SELECT unnest(range(0, 64)) AS i) z),
t AS (SELECT *, coalesce(greatest(0, least(1, ((cx + 0.5 - ax) * (bx - ax) + (cz + 0.5 - az) * (bz - az)) / nullif((bx - ax) * (bx - ax) + (bz - az) * (bz - az), 0))), 0) AS t FROM c),
e AS (SELECT cx, cz, sqrt(pow(cx + 0.5 - ax - (bx - ax) * t, 2) + pow(cz + 0.5 - az - (bz - az) * t, 2)) - half AS edge FROM t)
SELECT CAST(cx AS INT) AS cx, CAST(cz AS INT) AS cz, round(max(CASE WHEN edge <= 0 THEN 1 ELSE pow((3 - edge) / 3, 2) * (3 - 2 * (3 - edge) / 3) END), 6) AS w FROM e WHERE edge < 3 GROUP BY cx, cz""")
def ground_mask(spark, sf):
    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier").select((1.5 + k % 3).alias("half"), (k * 7 % 64).cast("double").alias("ax"), (k * 13 % 64).cast("double").alias("az"), (k * 11 % 64).cast("double").alias("bx"), (k * 5 % 64).cast("double").alias("bz"))
    return junctions.ground_mask(s, 64, 3.0).select("cx", "cz", F.round("w", 6).alias("w"))


_COVER = f"""WITH f AS (SELECT *, id * 7 % 64 AS x0, id * 13 % 64 AS y0, id % 9 + 2 AS r FROM {tagged_sql()}),
g AS (SELECT *, amenity_ IS NOT DISTINCT FROM 'parking' OR (area_ IS NOT DISTINCT FROM 'yes' AND coalesce(highway_ IN ('pedestrian', 'footway', 'service', 'living_street'), false)) AS flat FROM f
      WHERE coalesce(bridge_, 'no') = 'no' AND coalesce(tunnel_, 'no') = 'no' AND (layer_ IS NULL OR coalesce(TRY_CAST(layer_ AS DOUBLE) = 0, false))),
h AS (SELECT * EXCLUDE (flat), flat AND building_ IS NULL AS flat FROM g),
c AS (SELECT h.*, x.i + 0.5::DOUBLE AS px, z.i + 0.5::DOUBLE AS py FROM h, (SELECT unnest(range(64)) AS i) x, (SELECT unnest(range(64)) AS i) z WHERE x.i BETWEEN x0 - 13 AND x0 + 22 AND z.i BETWEEN y0 - 13 AND y0 + 32),
a AS (SELECT px, py, CASE WHEN px BETWEEN x0 AND x0 + r AND py BETWEEN y0 AND y0 + 2 * r THEN 0 ELSE sqrt(pow(greatest(x0 - px, 0, px - x0 - r), 2) + pow(greatest(y0 - py, 0, py - y0 - 2 * r), 2)) END AS edge FROM c WHERE flat),
s AS (SELECT px, py, x0::DOUBLE AS ax, y0::DOUBLE AS ay, (x0 + r)::DOUBLE AS bx, y0::DOUBLE AS b_y, highway_ FROM c WHERE NOT flat AND id % 3 > 0 UNION ALL SELECT px, py, (x0 + r)::DOUBLE, y0::DOUBLE, (x0 + r)::DOUBLE, (y0 + 2 * r)::DOUBLE, highway_ FROM c WHERE NOT flat AND id % 3 > 0
 UNION ALL SELECT px, py, (x0 + r)::DOUBLE, (y0 + 2 * r)::DOUBLE, x0::DOUBLE, (y0 + 2 * r)::DOUBLE, highway_ FROM c WHERE NOT flat AND id % 3 > 0),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t, CASE highway_ WHEN 'motorway' THEN 12 WHEN 'trunk' THEN 10 WHEN 'primary' THEN 8 WHEN 'secondary' THEN 6 WHEN 'tertiary' THEN 5 WHEN 'service' THEN 3 ELSE 4 END / 2.0 AS half FROM s WHERE highway_ IS NULL OR highway_ <> 'footway'),
e AS (SELECT px, py, sqrt(pow(px - ax - (bx - ax) * t, 2) + pow(py - ay - (b_y - ay) * t, 2)) - half AS edge FROM t UNION ALL SELECT px, py, edge FROM a),
w AS (SELECT px, py, min(edge) AS edge FROM e WHERE edge < 1.5 GROUP BY px, py)"""


@query("ground_cover", _COVER + " SELECT CAST(px - 0.5 AS INT) AS cx, CAST(py - 0.5 AS INT) AS cz, round(CASE WHEN edge <= 0 THEN 1 ELSE pow((1.5 - edge) / 1.5, 2) * (3 - 2 * (1.5 - edge) / 1.5) END, 6) AS w FROM w")
def ground_cover(spark, sf):
    """Tagged features of parts as rectangles or three sides of them, at two metres a cell, whatever of them lies on the ground."""
    f = tagged(spark, sf)
    x, y, r = F.col("id") * 7 % 64, F.col("id") * 13 % 64, F.col("id") % 9 + 2
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(point(x, y), point(x + r, y), point(x + r, y + 2 * r), point(x, y + 2 * r))
    f = f.select("id", F.when(F.col("id") % 3 > 0, "road").otherwise("landuse").alias("type"), "tags", ring.alias("geometry"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    return junctions.ground_cover(f, 64, 2.0, 3.0).select("cx", "cz", F.round("w", 6).alias("w"))


@query("capped_categories", """
SELECT l_orderkey AS ord, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, ord) AS n FROM (SELECT l_orderkey, l_returnflag AS category, l_linenumber % 3 AS priority, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS ord FROM lineitem)) WHERE n <= CASE category WHEN 'A' THEN 50 WHEN 'R' THEN 120 ELSE 1000000000 END""")
def capped_categories(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey"), F.col("l_returnflag").alias("category"), (F.col("l_linenumber") % 3).alias("priority"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return junctions.capped(li, {"A": 50, "R": 120}).select(F.col("l_orderkey").alias("ord"), "category")


@query("stable_widths", "SELECT l_partkey * 100000 + l_suppkey AS corridor, max(l_quantity) AS width FROM lineitem GROUP BY 1 HAVING max(l_quantity) - min(l_quantity) <= 3.5 * 2 + 0.75")
def stable_widths(spark, sf):
    li = read(spark, sf, "lineitem").select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("corridor"), F.col("l_quantity").alias("width"), F.lit(3.5).alias("lane"))
    return junctions.stable_widths(li)


@query("paint_order", """
SELECT p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY class IS NOT NULL, bucket NULLS FIRST, p_retailprice DESC, layer, class NULLS FIRST, p_partkey) - 1 AS INT) AS n
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_size % 5 END AS class, CASE WHEN p_size % 3 <> 0 THEN p_size % 4 END AS bucket, p_size % 2 AS layer FROM part)""")
def paint_order(spark, sf):
    s = F.col("p_size")
    f = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("tile"), F.when(s % 3 == 0, s % 5).alias("class"), F.when(s % 3 != 0, s % 4).alias("bucket"), F.col("p_retailprice").alias("area"), (s % 2).alias("layer"))
    return junctions.paint_order(f).select("id", "n")


_TEXT = "concat(' ', p_name, '/', p_brand, CASE WHEN p_partkey % 5 = 0 THEN '  ##' ELSE '_x.' END, p_partkey)"
_UNITS = ("US survey foot", "ftUS", "International Foot", "feet", "metre", "Meter", "degree", "left")


@query("text_forms", f"""
WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN ' # ' ELSE {_TEXT} END AS s, {list(_UNITS)}[p_partkey % 8 + 1] AS u, p_partkey * 370 % 5000 AS ms, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 = 1 END AS flag FROM part),
w AS (SELECT *, CASE WHEN regexp_matches(lower(u), 'us survey|survey foot|us-ft|ftus') THEN 'us_survey_foot' WHEN regexp_matches(lower(u), 'foot|feet|ft') THEN 'foot' WHEN regexp_matches(lower(u), 'metre|meter') THEN 'meter' END AS unit FROM t)
SELECT id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(s, '[^A-Za-z0-9 _.-]', ' ', 'g'), ' +', ' ', 'g')), 1, 96), ''), 'roads') AS folder,
 coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(s), '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'tile') AS part,
 unit, CASE unit WHEN 'foot' THEN 0.3048 WHEN 'us_survey_foot' THEN 1200.0 / 3937 ELSE 1.0 END::DOUBLE AS scale, CASE WHEN ms >= 1000 THEN printf('%.2fs', ms / 1000) ELSE printf('%dms', ms) END AS took, flag IS TRUE AS sure FROM w""")
def text_forms(spark, sf):
    """Names as folders and parts of file names, units in texts with their scale, durations, strict truth."""
    from geoloom.functions import scalars

    k = F.col("p_partkey")
    s = F.when(k % 11 == 0, " # ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.when(k % 5 == 0, "  ##").otherwise("_x."), k.cast("string")))
    unit = scalars.unit_of_text(F.element_at(F.array(*map(F.lit, _UNITS)), (k % 8 + 1).cast("int")))
    flag = F.when(k % 3 > 0, k % 3 == 1)
    return read(spark, sf, "part").select(k.alias("id"), scalars.sanitize_folder(s, "roads").alias("folder"), scalars.sanitize_file_part(s).alias("part"), unit.alias("unit"), scalars.unit_scale(unit).alias("scale"), scalars.duration_ms_text(k * 370 % 5000).alias("took"), scalars.strictly_true(flag).alias("sure"))


_SOME_KEYS = ("building", "landuse", "leisure", "natural", "amenity", "man_made", "historic", "surface")


@query("area_ways", f"""
WITH f AS (SELECT *, id % 4 AS n FROM {tagged_sql()})
SELECT id, CASE WHEN n = 0 THEN false WHEN area_ IS NOT DISTINCT FROM 'yes' THEN true WHEN area_ IS NOT DISTINCT FROM 'no' THEN false WHEN n = 1 THEN false WHEN highway_ IS NOT NULL OR barrier_ IS NOT NULL THEN false
 WHEN waterway_ IS NOT NULL THEN waterway_ IN {tags.AREA_WATERWAYS!r} ELSE {' OR '.join(f'{k}_ IS NOT NULL' for k in _SOME_KEYS)} END AS area,
 CASE {' '.join(f"WHEN highway_ = '{name}' THEN {mat}" for name, mat, _ in tags.LAYER_ROADS)} END::INT AS mat, CASE {' '.join(f"WHEN highway_ = '{name}' THEN {half}" for name, _, half in tags.LAYER_ROADS)} END::DOUBLE AS half_m FROM f""")
def area_ways(spark, sf):
    """Which of parts' features are areas by their tags and rings, and the layer map's material and half width of those that are roads."""
    k = F.col("id")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("lat"), F.lit(float(y)).alias("lng"))
    rings = [F.array(point(0, 0), point(0, 1)), F.array(point(0, 0), point(0, 1), point(1, 1)), F.array(point(0, 0), point(0, 1), point(1, 1), point(0, 0)), F.array(point(0, 0), point(0, 2), point(2, 2), point(2, 0), point(0, 0))]
    ring = F.when(k % 4 == 0, rings[0]).when(k % 4 == 1, rings[1]).when(k % 4 == 2, rings[2]).otherwise(rings[3])
    road = tags.layer_road(F.col("tags"))
    return tagged(spark, sf).select("id", tags.area_like(F.col("tags"), ring).alias("area"), road["mat"].alias("mat"), road["half_m"].alias("half_m"))
