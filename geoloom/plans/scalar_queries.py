"""Queries of the scalar functions, coordinate systems and tag rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import crs, scalars, tags

from .registry import query
from .views import POINTS, points, read, tagged, tagged_sql

R6 = "floor(({}) * 1000000 + 0.5) / 1000000"


def r6(x):
    return scalars.round_to(x, 6)


# The SQL of the projections is written apart from the library's formulas: the conformal latitude by tangents, the series by
# published coefficients of WGS84 (rectifying radius, forward and backward terms), and latitudes by Newton's steps.
_RECTIFYING, _ECC = "6367449.145823415", "0.0818191908426215"
_FORWARD = ("8.377318206244698e-4", "7.608527773572307e-7", "1.197645503329453e-9", "2.429170607201359e-12")
_BACKWARD = ("8.377321640579488e-4", "5.905870152220203e-8", "1.673482665283997e-10", "2.164798110490642e-13")


def _conformal(tan: str) -> str:
    return f"({tan} * sqrt(1 + pow(sinh({_ECC} * atanh({_ECC} * {tan} / sqrt(1 + {tan} * {tan}))), 2)) - sinh({_ECC} * atanh({_ECC} * {tan} / sqrt(1 + {tan} * {tan}))) * sqrt(1 + {tan} * {tan}))"


def _forward_sql(rows: str, keep: str) -> str:
    """CTEs t, x, m of rows with lat, lng and mid (the central meridian): east and north in metres from the equator."""
    north = "".join(f" + {a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_FORWARD, 1))
    east = "".join(f" + {a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_FORWARD, 1))
    return f"""t AS (SELECT *, tan(radians(CAST(lat AS DOUBLE))) AS tn, radians(CAST(lng AS DOUBLE) - mid) AS dl FROM ({rows})),
u AS (SELECT *, {_conformal("tn")} AS tc FROM t),
x AS (SELECT *, atan2(tc, cos(dl)) AS xi, asinh(sin(dl) / sqrt(tc * tc + cos(dl) * cos(dl))) AS eta FROM u),
m AS (SELECT {keep}, {_RECTIFYING} * (eta{east}) AS east, {_RECTIFYING} * (xi{north}) AS north FROM x)"""


def _newton(n: int) -> str:
    """CTE n{n} with a better tangent tn of the latitude whose conformal tangent is tc."""
    e2 = f"{_ECC} * {_ECC}"
    return f"n{n} AS (SELECT id, lng, tc, tn + (tc - {_conformal('tn')}) / sqrt(1 + pow({_conformal('tn')}, 2)) * (1 + (1 - {e2}) * tn * tn) / ((1 - {e2}) * sqrt(1 + tn * tn)) AS tn FROM n{n - 1})"


_BLAT, _BLNG = crs.tmerc_inverse_sql("east", "north", 50.0, 10.0)


_FROM_50 = _forward_sql(f"SELECT id, lat, lng, floor(lng / 6) * 6 + 3 AS mid FROM {POINTS} UNION ALL SELECT -1, 50.0, 0.0, 0", "id")


@query("local_projection", f"""
WITH {_FROM_50}
SELECT id, floor(east * 10 + 0.5) / 10 AS east, floor((north - (SELECT north FROM m WHERE id = -1)) * 10 + 0.5) / 10 AS north FROM m WHERE id <> -1""")
def local_projection(spark, sf):
    """Metres from latitude 50 and the middle of each point's six-degree strip, to a tenth: the SQL's series is shorter."""
    x, y = crs.local_xy("lat", "lng", 50.0, "(floor(lng / 6) * 6 + 3)")
    return points(spark, sf).select("id", scalars.round_to(x, 1).alias("east"), scalars.round_to(y, 1).alias("north"))


_BACK_N = "".join(f" - {b} * sin({2 * j} * a) * cosh({2 * j} * b)" for j, b in enumerate(_BACKWARD, 1))
_BACK_E = "".join(f" - {b} * cos({2 * j} * a) * sinh({2 * j} * b)" for j, b in enumerate(_BACKWARD, 1))


@query("local_projection_inverse", f"""
WITH {_forward_sql("SELECT 50.0 AS lat, 0.0 AS lng, 0 AS mid", "0 AS id")},
p AS (SELECT i.id, ((i.id % 300 - 150) * 1000.0 + m.north) / {_RECTIFYING} AS a, (i.id % 400 - 200) * 1000.0 / {_RECTIFYING} AS b FROM {POINTS} i, m),
q AS (SELECT id, a{_BACK_N} AS xi, b{_BACK_E} AS eta FROM p),
n0 AS (SELECT id, 10 + degrees(atan2(sinh(eta), cos(xi))) AS lng, sin(xi) / sqrt(pow(sinh(eta), 2) + pow(cos(xi), 2)) AS tc, sin(xi) / sqrt(pow(sinh(eta), 2) + pow(cos(xi), 2)) AS tn FROM q),
{_newton(1)}, {_newton(2)}, {_newton(3)}
SELECT id, {R6.format("degrees(atan(tn))")} AS lat, {R6.format("lng")} AS lng FROM n3""")
def local_projection_inverse(spark, sf):
    p = points(spark, sf).select("id", ((F.col("id") % 400 - 200) * 1000.0).alias("east"), ((F.col("id") % 300 - 150) * 1000.0).alias("north"))
    return p.select("id", r6(F.expr(_BLAT)).alias("lat"), r6(F.expr(_BLNG)).alias("lng"))


_UTM = crs.utm_sql("lat", "lng")


@query("utm", f"""
WITH {_forward_sql(f"SELECT id, lat, lng, floor(lng / 6) * 6 + 3 AS mid FROM {POINTS}", "id, lat, CAST(floor(lng / 6) AS INT) + 31 AS zone")}
SELECT id, zone, CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + zone AS epsg, floor((east * 0.9996 + 500000) * 10 + 0.5) / 10 AS easting, floor((north * 0.9996 + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END) * 10 + 0.5) / 10 AS northing FROM m""")
def utm(spark, sf):
    p = points(spark, sf)
    return p.select("id", F.expr(_UTM["zone"]).alias("zone"), F.expr(_UTM["epsg"]).alias("epsg"), scalars.round_to(F.expr(_UTM["easting"]), 1).alias("easting"), scalars.round_to(F.expr(_UTM["northing"]), 1).alias("northing"))


_PX, _PY = crs.mercator_sql("lat", "lng", 12)


@query("mercator_tiles", f"""
WITH p AS (SELECT id, (CAST(lng AS DOUBLE) + 180) / 360 * 1048576 AS px, (1 - asinh(tan(radians(CAST(lat AS DOUBLE)))) / pi()) / 2 * 1048576 AS py FROM {POINTS})
SELECT id, round(px, 4) AS px, round(py, 4) AS py, CAST(floor(px / 256) AS BIGINT) % 4096 AS tx, CAST(floor(py / 256) AS BIGINT) AS ty FROM p""")
def mercator_tiles(spark, sf):
    x, y = F.expr(_PX), F.expr(_PY)
    return points(spark, sf).select("id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"), (F.floor(x / 256) % 4096).alias("tx"), F.floor(y / 256).alias("ty"))


@query("tile_cover", """
SELECT i AS id, z, tx % CAST(pow(2, z) AS BIGINT) AS tx, ty FROM (
  SELECT c_custkey AS i, 10 AS z, unnest(range(CAST(c_custkey % 1000 AS BIGINT), CAST(c_custkey % 1000 + c_custkey % 4 AS BIGINT) + 1)) AS tx, c_custkey % 7 AS y0, c_custkey % 3 AS dy FROM customer), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y0 + dy AS BIGINT) + 1)) AS ty)""")
def tile_cover(spark, sf):
    """All map tiles of a range, columns wrapped at the date line."""
    k = F.col("c_custkey")
    t = read(spark, sf, "customer").select(k.alias("id"), F.lit(10).alias("z"), F.explode(F.sequence(k % 1000, k % 1000 + k % 4)).alias("tx"), (k % 7).alias("y0"), (k % 3).alias("dy"))
    return t.select("id", "z", F.pmod("tx", F.lit(1024).cast("bigint")).alias("tx"), F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("dy"))).alias("ty"))


_HAV = crs.haversine_sql("lat", "lng", "48.0", "11.0")


@query("haversine", f"""
WITH p AS (SELECT id, radians(CAST(lat AS DOUBLE)) AS a, radians(CAST(lng AS DOUBLE)) AS b FROM {POINTS}),
v AS (SELECT id, cos(a) * cos(b) - cos(radians(48)) * cos(radians(11)) AS x, cos(a) * sin(b) - cos(radians(48)) * sin(radians(11)) AS y, sin(a) - sin(radians(48)) AS z FROM p)
SELECT id, round(2 * 6371000 * asin(least(1, sqrt(x * x + y * y + z * z) / 2)), 3) AS metres FROM v""")
def haversine(spark, sf):
    return points(spark, sf).select("id", F.round(F.expr(_HAV), 3).alias("metres"))


@query("longitudes", f"""
SELECT id, round(((CAST(lng AS DOUBLE) * 3 + 180) % 360 + 360) % 360 - 180, 6) AS normal, round(CAST(lng AS DOUBLE) * 3 - 360 * ceil((lng * 3 - 170 - 180) / 360), 6) AS near,
       round(111320 * cos(radians(lat)), 6) AS metres_of_degree FROM {POINTS}""")
def longitudes(spark, sf):
    p, t = points(spark, sf), F.col("lng") * 3
    return p.select("id", F.round(crs.normalize_lng(t), 6).alias("normal"), F.round(crs.unwrap_lng(t, F.lit(170.0)), 6).alias("near"), F.round(crs.DEGREE_M * F.cos(F.radians("lat")), 6).alias("metres_of_degree"))


@query("square_bounds", f"""
WITH p AS (SELECT *, 512.0 * (1 + id % 4) AS size FROM {POINTS}),
b AS (SELECT *, lat + size / 2 / 111320 AS n, lat - size / 2 / 111320 AS s, lng + size / 2 / (111320 * cos(radians(lat))) AS e, lng - size / 2 / (111320 * cos(radians(lat))) AS w FROM p)
SELECT id, round(n, 6) AS north, round(s, 6) AS south, round(e, 6) AS east, round(w, 6) AS west,
       50.0 BETWEEN s AND n AND 10.0 BETWEEN w AND e AS holds_centre, s <= 60 AND 40 <= n AND w <= 20 AND 0 <= e AS meets_area FROM b""")
def square_bounds(spark, sf):
    p = points(spark, sf).withColumn("b", crs.square_bounds(F.col("lat"), F.col("lng"), 512.0 * (1 + F.col("id") % 4)))
    area = F.struct(F.lit(60.0).alias("north"), F.lit(40.0).alias("south"), F.lit(20.0).alias("east"), F.lit(0.0).alias("west"))
    return p.select("id", *[F.round(f"b.{x}", 6).alias(x) for x in ("north", "south", "east", "west")], crs.in_bounds(F.lit(50.0), F.lit(10.0), F.col("b")).alias("holds_centre"), crs.bounds_overlap(F.col("b"), area).alias("meets_area"))


@query("crs_codes", """
SELECT p_partkey AS id, CASE WHEN c = 3857 THEN 'web_mercator' WHEN c = 2180 THEN 'poland_1992'
  WHEN c BETWEEN 32601 AND 32660 THEN concat('utm_north_', c % 100) WHEN c BETWEEN 32701 AND 32760 THEN concat('utm_south_', c % 100) END AS crs,
  c > 0 AND c <> 32767 AND NOT c BETWEEN 7000 AND 7999 AS valid,
  CASE WHEN w >= 8192 THEN 8192 WHEN w >= 4096 THEN 4096 WHEN w >= 2048 THEN 2048 WHEN w >= 1024 THEN 1024 ELSE 512 END AS resolution
FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 3857 WHEN 1 THEN 2180 WHEN 2 THEN 32600 + p_partkey % 70 WHEN 3 THEN 32700 + p_partkey % 70 ELSE 6990 + p_partkey % 20 END AS c, least(p_partkey * 13 % 9000, p_size * 300) AS w FROM part)""")
def crs_codes(spark, sf):
    k = F.col("p_partkey")
    c = F.when(k % 5 == 0, 3857).when(k % 5 == 1, 2180).when(k % 5 == 2, 32600 + k % 70).when(k % 5 == 3, 32700 + k % 70).otherwise(6990 + k % 20)
    p = read(spark, sf, "part").withColumn("c", c)
    return p.select(k.alias("id"), crs.built_in_crs(F.col("c")).alias("crs"), crs.valid_crs(F.col("c")).alias("valid"), crs.suggested_resolution(k * 13 % 9000, F.col("p_size") * 300).alias("resolution"))


@query("numbers", """
SELECT e.event_id AS id, floor(value * 1000 + 0.5) / 1000 AS rounded, greatest(10.0, least(60.0, value)) AS clamped,
  round(t * t * (3 - 2 * t), 9) AS smooth, floor(value * 0.25 + 1.5 * 0.75 + 0.5) AS mixed,
  least(30000.0, 1000.0 * pow(2.0, event_id % 9)) AS backoff, CASE WHEN event_id % 256 * 256 + event_id % 251 + event_id % 7 / 256 - 32768 > -32760 THEN event_id % 256 * 256 + event_id % 251 + event_id % 7 / 256 - 32768 END AS height
FROM (SELECT *, greatest(0.0, least(1.0, (value - 5) / 40)) AS t FROM events) e""")
def numbers(spark, sf):
    v, k = F.col("value"), F.col("event_id")
    e = read(spark, sf, "events")
    return e.select(
        k.alias("id"), scalars.round_to(v).alias("rounded"), scalars.clamp(v, 10.0, 60.0).alias("clamped"), F.round(scalars.smoothstep_between(5, 45, v), 9).alias("smooth"),
        scalars.js_round(scalars.lerp(F.lit(1.5), v, F.lit(0.25))).cast("double").alias("mixed"), scalars.backoff_ms(k % 9 + 1).alias("backoff"), scalars.terrarium_height(k % 256, k % 251, k % 7).alias("height"),
    )


@query("text_keys", """
SELECT p_partkey AS id, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS fnv,
  lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS hex,
  trim(regexp_replace(p_type || '! ' || p_brand, '[^A-Za-z0-9_]+', '_', 'g'), '_') AS name,
  printf('R%dC%d', p_partkey // 7 + 1, p_partkey % 7 + 1) AS label, list_extract(string_split(p_type, ' '), 1) || ', b, c' AS place
FROM part""")
def text_keys(spark, sf):
    p = read(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), scalars.fnv1a(F.col("p_name")).alias("fnv"), scalars.fnv1a_hex(F.col("p_name")).alias("hex"),
        scalars.sanitize_name(F.concat_ws("! ", "p_type", "p_brand")).alias("name"), scalars.tile_label(F.col("p_partkey"), 7).alias("label"),
        scalars.short_place(F.concat(F.split("p_type", " ")[0], F.lit(",b, c,d"))).alias("place"),
    )


@query("durations", """
SELECT event_id AS id, CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS spent,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
FROM (SELECT *, CAST(floor(value * 100000 / 1000) AS BIGINT) AS s FROM events)""")
def durations(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), scalars.duration_text(F.col("value") * 100000).alias("spent"), scalars.iso_text(F.col("ts")).alias("iso"))


_T = tagged_sql()
_OW = "(coalesce(lower(trim(oneway_)) IN ('yes','1','true','-1','reverse'), false) OR coalesce(junction_ = 'roundabout', false) OR coalesce(highway_ IN ('motorway','motorway_link'), false))"
_WIDTH = """w FROM (SELECT * REPLACE (CASE WHEN w > 0 THEN w END AS w) FROM (SELECT *, CASE WHEN contains(raw, 'ft') THEN TRY_CAST(regexp_extract(trim(replace(raw, 'ft', '')), '^([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) * 0.3048
  WHEN contains(raw, 'm') THEN TRY_CAST(regexp_extract(trim(replace(raw, 'm', '')), '^([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE)
  WHEN TRY_CAST(regexp_extract(raw, '^([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) > 40 THEN TRY_CAST(regexp_extract(raw, '^([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) * 0.3048
  ELSE TRY_CAST(regexp_extract(raw, '^([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) END AS w FROM (SELECT *, lower(trim(width_)) AS raw FROM """ + _T + ")))"


# The values that the synthetic tags take, as the SQL's own lists.
_FAST, _MAIN, _MINOR = ("motorway", "motorway_link", "trunk", "trunk_link"), ("primary", "primary_link", "secondary", "secondary_link"), ("tertiary", "tertiary_link")
_LINKS = ("motorway_link", "primary_link")
_MAJOR = ("motorway", "motorway_link", "trunk", "primary", "primary_link", "secondary")


def _in(key: str, values) -> str:
    return f"coalesce({key}_ IN ({', '.join(repr(v) for v in values)}), false)"


@query("feature_kinds", f"""
SELECT id, CASE WHEN man_made_ = 'bridge' AND highway_ IS NULL THEN 'bridge_infra' WHEN building_ IS NOT NULL OR historic_ IN ('castle', 'ruins') THEN 'building'
  WHEN natural_ = 'coastline' THEN 'coastline' WHEN natural_ = 'water' OR waterway_ IS NOT NULL OR landuse_ IN ('reservoir', 'basin') OR leisure_ = 'marina' THEN 'water'
  WHEN barrier_ IS NOT NULL THEN 'barrier' WHEN coalesce(landuse_, leisure_, natural_, amenity_, man_made_, historic_, surface_) IS NOT NULL THEN 'landuse' END AS kind,
  CASE WHEN natural_ IN ('heath', 'wood') THEN 1 WHEN natural_ = 'sand' THEN 3 WHEN natural_ = 'rock' THEN 4 WHEN natural_ = 'mud' THEN 2 WHEN natural_ = 'water' THEN -1
    WHEN landuse_ = 'forest' THEN 1 WHEN landuse_ = 'farmland' THEN 2 WHEN landuse_ = 'retail' THEN 7 WHEN landuse_ = 'residential' THEN 1 WHEN landuse_ = 'quarry' THEN 4 WHEN landuse_ = 'railway' THEN 6 WHEN landuse_ = 'reservoir' THEN -1
    WHEN leisure_ = 'park' THEN 1 WHEN leisure_ = 'stadium' THEN 7 WHEN leisure_ = 'track' THEN 5 WHEN amenity_ = 'parking' THEN 7 WHEN amenity_ = 'fuel' THEN 5
    WHEN surface_ = 'asphalt' THEN 5 WHEN surface_ = 'concrete' THEN 7 WHEN surface_ = 'gravel' THEN 6 WHEN surface_ = 'grass' THEN 1 WHEN surface_ = 'sand' THEN 3 ELSE -1 END AS material FROM {_T}""")
def feature_kinds(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select("id", tags.feature_kind(t).alias("kind"), tags.area_material(t).alias("material"))


@query("road_rules", f"""
SELECT id, {_OW} AS oneway,
  coalesce(TRY_CAST(regexp_extract(trim(layer_), '^([-+]?\\d+)', 1) AS DOUBLE), CAST({_in('bridge', ('yes', 'viaduct'))} OR coalesce(man_made_ = 'bridge', false) AS INT) - CAST(coalesce(tunnel_ = 'yes', false) AS INT))
  + CASE WHEN barrier_ = 'retaining_wall' AND NOT {_in('bridge', ('yes', 'viaduct'))} AND NOT coalesce(man_made_ = 'bridge', false) AND NOT coalesce(tunnel_ = 'yes', false) THEN 0.5 ELSE 0 END
  + CASE WHEN embankment_ = 'yes' THEN 0.5 ELSE 0 END AS layer,
  CASE WHEN lane_markings_ = 'no' THEN true WHEN lane_markings_ = 'yes' THEN false ELSE coalesce(surface_ IN ('gravel', 'dirt', 'grass', 'sand'), false) OR coalesce(highway_ = 'track', false) END AS unmarked,
  {_in('highway', _MAJOR)} AND NOT CASE WHEN lane_markings_ = 'yes' THEN false WHEN lane_markings_ = 'no' THEN true ELSE coalesce(lower(trim(surface_)) IN ('gravel', 'dirt', 'grass', 'sand'), false) END AS marked,
  {_in('highway', _MAJOR)} AND NOT coalesce(lower(trim(surface_)) IN ('gravel', 'dirt', 'grass', 'sand'), false) AS grass_edge,
  highway_ IS NOT NULL AND NOT ({_in('highway', ('footway', 'service'))} OR coalesce(area_ = 'yes', false) OR coalesce(lower(trim(service_)) IN ('alley', 'driveway'), false)) AS decal
FROM {_T}""")
def road_rules(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select("id", tags.one_way(t).alias("oneway"), tags.road_layer(t).alias("layer"), tags.unmarked_surface(t).alias("unmarked"), tags.uses_lane_markings(t).alias("marked"), tags.uses_grass_edge(t).alias("grass_edge"), tags.makes_decal_road(t).alias("decal"))


@query("road_widths", f"""
SELECT id, round(greatest(lo, least(hi, coalesce(w / 2, lanes * lane_w / 2))), 6) AS half_width, lane_w, most FROM (
 SELECT *, greatest(CASE WHEN {_in('highway', ('motorway', 'trunk'))} THEN CASE WHEN ow THEN 2 ELSE 4 END WHEN {_in('highway', (*_LINKS, 'service', 'track'))} THEN 1 ELSE CASE WHEN ow THEN 1 ELSE 2 END END, CASE WHEN l > 0 THEN l ELSE lf + lb END) AS lanes FROM (
 SELECT id, highway_, {_OW} AS ow, greatest(0, coalesce(TRY_CAST(regexp_extract(trim(lanes_), '^([-+]?\\d+)', 1) AS BIGINT), 0)) AS l,
  greatest(0, coalesce(TRY_CAST(regexp_extract(trim(lanes_forward_), '^([-+]?\\d+)', 1) AS BIGINT), 0)) AS lf, greatest(0, coalesce(TRY_CAST(regexp_extract(trim(lanes_backward_), '^([-+]?\\d+)', 1) AS BIGINT), 0)) AS lb,
  CASE WHEN {_in('highway', _FAST)} THEN 3.7 WHEN {_in('highway', _MAIN)} THEN 3.5 WHEN {_in('highway', _MINOR)} THEN 3.25 WHEN {_in('highway', ('service', 'track'))} THEN 2.8 ELSE 3.0 END::DOUBLE AS lane_w,
  CASE WHEN {_in('highway', _FAST)} THEN 3.5 WHEN {_in('highway', _MAIN)} THEN 2.8 WHEN {_in('highway', ('service', 'track'))} THEN 1.8 ELSE 2.2 END::DOUBLE AS lo,
  CASE WHEN {_in('highway', _FAST)} THEN 9.0 WHEN {_in('highway', _MAIN)} THEN 6.0 WHEN {_in('highway', ('service', 'track'))} THEN 3.5 ELSE 5.0 END::DOUBLE AS hi,
  CASE WHEN {_in('highway', ('motorway', 'trunk'))} THEN CASE WHEN {_OW} THEN 6 ELSE 10 END WHEN {_in('highway', _LINKS)} THEN CASE WHEN {_OW} THEN 3 ELSE 4 END WHEN {_in('highway', ('primary', 'secondary'))} THEN CASE WHEN {_OW} THEN 5 ELSE 8 END ELSE CASE WHEN {_OW} THEN 4 ELSE 6 END END AS most,
  {_WIDTH}))""")
def road_widths(spark, sf):
    t = F.col("tags")
    ow = tags.one_way(t)
    return tagged(spark, sf).select("id", F.round(tags.half_width(t, ow), 6).alias("half_width"), tags.road_lane_width(t).alias("lane_w"), tags.most_lanes(t, ow).alias("most"))


_N = lambda key: f"CASE WHEN TRY_CAST(regexp_extract(trim({key}_), '^([-+]?\\d+)', 1) AS BIGINT) > 0 THEN TRY_CAST(regexp_extract(trim({key}_), '^([-+]?\\d+)', 1) AS BIGINT) END"
_BARS = lambda key: f"nullif(len(list_filter(string_split({key}_, '|'), lambda x: trim(x) <> '')), 0)"


@query("lane_counts", f"""
WITH g AS (SELECT id, highway_, {_OW} AS ow, {_N('lanes')} AS t, coalesce({_N('lanes_forward')}, {_BARS('turn_lanes_forward')}) AS f, {_N('lanes_backward')} AS b, {_BARS('turn_lanes')} AS turn,
  {_in('highway', ('motorway', 'trunk'))} AS fast, {_in('highway', (*_LINKS, 'service', 'track'))} AS narrow,
  CASE WHEN {_in('highway', ('motorway', 'trunk'))} THEN CASE WHEN {_OW} THEN 6 ELSE 10 END WHEN {_in('highway', _LINKS)} THEN CASE WHEN {_OW} THEN 3 ELSE 4 END
   WHEN {_in('highway', ('primary', 'secondary'))} THEN CASE WHEN {_OW} THEN 5 ELSE 8 END ELSE CASE WHEN {_OW} THEN 4 ELSE 6 END END AS most FROM {_T}),
h AS (SELECT *, coalesce(t, CASE WHEN fast THEN 4 WHEN narrow THEN 1 ELSE 2 END) AS guess FROM g),
s AS (SELECT *, CASE WHEN ow THEN greatest(1, least(most, coalesce(f, t, turn, CASE WHEN fast THEN 2 ELSE 1 END))) WHEN f IS NULL AND b IS NULL THEN (guess + 1) // 2 ELSE coalesce(f, CASE WHEN t IS NOT NULL THEN greatest(1, t - b) END, 1) END AS f0,
  CASE WHEN ow THEN 0 WHEN f IS NULL AND b IS NULL THEN greatest(1, guess - (guess + 1) // 2) ELSE coalesce(b, CASE WHEN t IS NOT NULL THEN greatest(1, t - f) END, 1) END AS b0 FROM h),
c AS (SELECT *, NOT ow AND f0 + b0 > most AS over, CASE WHEN NOT ow AND f0 + b0 > most THEN greatest(1, CAST(floor(f0 * (most / (f0 + b0)) + 0.5) AS BIGINT)) ELSE f0 END AS f1 FROM s),
d AS (SELECT *, CASE WHEN over THEN greatest(1, most - f1) ELSE b0 END AS b1 FROM c)
SELECT id, CASE WHEN ow THEN f1 ELSE greatest(2, f1 + b1) END AS total, f1 AS forward, b1 AS backward FROM d""")
def lane_counts(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select("id", tags.lane_counts(t, tags.one_way(t)).alias("n")).select("id", "n.total", "n.forward", "n.backward")


@query("lane_lines", f"""
SELECT id, CASE WHEN {_OW} OR coalesce(suffix(highway_, '_link'), false) THEN NULL WHEN highway_ IN ('motorway', 'trunk') THEN 'white solid' WHEN highway_ IN ('primary', 'secondary') THEN CASE WHEN id % 6 + 1 >= 4 THEN 'yellow double' ELSE 'yellow dashed' END
  WHEN highway_ = 'tertiary' THEN 'yellow dashed' WHEN highway_ IN ('residential', 'unclassified') AND id % 6 + 1 >= 4 THEN 'yellow dashed' END AS centre,
  CASE WHEN {_in('highway', _FAST)} THEN 0.15 WHEN highway_ IN ('primary', 'secondary') THEN 0.1 END::DOUBLE AS edge,
  CASE WHEN {_in('highway', _FAST)} THEN 3.7 WHEN {_in('highway', _MAIN)} THEN 3.5 WHEN {_in('highway', _MINOR)} THEN 3.25 WHEN highway_ = 'service' THEN 2.8 ELSE 3.0 END::DOUBLE AS lane_width FROM {_T}""")
def lane_lines(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf).select("id", tags.centre_line(t, F.col("id") % 6 + 1, tags.one_way(t)).alias("centre"), tags.edge_line_width(t).alias("edge"), tags.painter_lane_width(t).alias("lane_width"))


@query("colour_materials", """
WITH p AS (SELECT event_id AS id, CAST(event_id * 37 % 256 AS INT) AS r, CAST(event_id * 101 % 256 AS INT) AS g, CAST(event_id * 173 % 256 AS INT) AS b FROM events),
q AS (SELECT *, greatest(r, g, b) / 255 AS hi, least(r, g, b) / 255 AS lo FROM p),
s AS (SELECT *, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s, CASE WHEN hi <= lo THEN 0 WHEN hi = r / 255 THEN (g / 255 - b / 255) / (hi - lo) * 60
  WHEN hi = g / 255 THEN ((b / 255 - r / 255) / (hi - lo) + 2) * 60 ELSE ((r / 255 - g / 255) / (hi - lo) + 4) * 60 END AS h0 FROM q),
h AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM s)
SELECT id, CASE WHEN hi < 0.25 THEN 5 WHEN h >= 170 AND h <= 265 AND s > 0.25 THEN 0 WHEN h >= 60 AND h <= 160 AND s > 0.12 THEN 1 WHEN h >= 40 AND h < 60 AND s > 0.1 AND hi > 0.35 THEN 1
  WHEN h >= 30 AND h < 60 AND s > 0.15 AND hi > 0.55 THEN 3 WHEN h >= 15 AND h < 45 AND s > 0.15 THEN 2 WHEN (h < 20 OR h > 340) AND s > 0.2 THEN 7
  WHEN s < 0.1 THEN CASE WHEN hi < 0.4 THEN 4 WHEN hi < 0.72 THEN 7 ELSE 1 END ELSE 1 END AS material FROM h""")
def colour_materials(spark, sf):
    k = F.col("event_id")
    return read(spark, sf, "events").select(k.alias("id"), tags.colour_material((k * 37 % 256).cast("int"), (k * 101 % 256).cast("int"), (k * 173 % 256).cast("int")).alias("material"))
