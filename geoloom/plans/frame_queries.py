"""Queries of terrain frames, bounds and points, and of what readers take from headers and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import frames, scalars
from geoloom.sources import text_grids

from .registry import query
from .views import POINTS, points, read

_B = f"(SELECT *, lat + 0.02 * (1 + id % 5) AS north, lat - 0.01 * (1 + id % 3) AS south, lng + 0.03 * (1 + id % 4) AS east, lng - 0.02 * (1 + id % 7) AS west FROM (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM {POINTS}))"


def _bounded(spark, sf):
    k, lat, lng = F.col("id"), F.col("lat"), F.col("lng")
    b = frames.bounds(lat + 0.02 * (1 + k % 5), lat - 0.01 * (1 + k % 3), lng + 0.03 * (1 + k % 4), lng - 0.02 * (1 + k % 7))
    return points(spark, sf).withColumn("b", b)


def _rounded(x, places=6):
    return F.round(x, places)


@query("scene_frames", f"""
WITH w AS (SELECT *, (east - west) * 111320 * cos((north + south) * pi() / 360) AS wide FROM {_B})
SELECT id, round((north + south) / 2, 6) AS lat, round((east + west) / 2, 6) AS lng, round(100 / wide, 9) AS units, floor(CASE WHEN id % 2 = 0 THEN 1.5 + id % 9 * 0.013 ELSE wide / 1024 END * 100 + 0.5) / 100 AS square,
  round(CASE WHEN id % 2 = 0 THEN 1.5 + id % 9 * 0.013 ELSE greatest(0.01, (abs(wide) + abs(north - south) * 110574) / 2 / 1024) END, 6) AS metres,
  CAST(greatest(1, floor(abs(wide) + 0.5)) AS BIGINT) AS native_width, CAST(greatest(1, floor((north - south) * 111320 + 0.5)) AS BIGINT) AS native_height,
  greatest(512, least(16384, CAST(pow(2, floor(log2(greatest(1, least(abs(wide), (north - south) * 111320))))) AS INT))) AS resolution
FROM w""")
def scene_frames(spark, sf):
    """Centres, units and sizes of frames; half of them name their metres a pixel."""
    f, b = _bounded(spark, sf), F.col("b")
    given = F.when(F.col("id") % 2 == 0, 1.5 + F.col("id") % 9 * 0.013)
    f = f.select("id", frames.centre(b).alias("c"), frames.units_per_metre(b).alias("units"), frames.square_size(b, F.lit(1024), given).alias("square"), frames.metres_per_pixel(b, F.lit(1024), given).alias("metres"), frames.coverage_summary(b).alias("s"))
    return f.select("id", _rounded("c.lat").alias("lat"), _rounded("c.lng").alias("lng"), _rounded("units", 9).alias("units"), "square", _rounded("metres").alias("metres"), F.col("s.width").alias("native_width"), F.col("s.height").alias("native_height"), F.col("s.resolution").alias("resolution"))


@query("moved_bounds", f"""
WITH p(k, place, up, rt) AS (VALUES (0, 'NW', 1, -1), (1, 'N', 1, 0), (2, 'NE', 1, 1), (3, 'W', 0, -1), (4, 'E', 0, 1), (5, 'SW', -1, -1), (6, 'S', -1, 0), (7, 'SE', -1, 1)),
m AS (SELECT id, north + up * (north - south) AS n1, west + rt * (east - west) AS w1, north - (id % 100) * (north - south) / 512 AS n2, south, west, north, east,
        north - (id % 100 + 128) * (north - south) / 512 AS s2, west + (id % 50) * (east - west) / 256 AS w2, west + (id % 50 + 128) * (east - west) / 256 AS e2 FROM {_B} JOIN p ON k = id % 8),
sel AS (SELECT id, 1000.0 * (1 + id % 6) / 111320 AS tall, 1000.0 * (1 + id % 6) / (111320 * cos(radians(lat))) AS wide, lat + 0.02 * (id % 3 - 1) AS clat, lng + 0.05 * (id % 5 - 2) AS clng, north, south, east, west FROM {_B}),
slid AS (SELECT id, CASE WHEN tall >= north - south OR wide >= east - west THEN south WHEN clat - tall / 2 < south THEN south WHEN clat + tall / 2 > north THEN north - tall ELSE clat - tall / 2 END AS s3,
  CASE WHEN tall >= north - south OR wide >= east - west THEN west WHEN clng - wide / 2 < west THEN west WHEN clng + wide / 2 > east THEN east - wide ELSE clng - wide / 2 END AS w3 FROM sel)
SELECT id, round(n1, 6) AS north1, round(w1, 6) AS west1, round(n2, 10) AS north2, round(s2, 10) AS south2, round(w2, 10) AS west2, round(e2, 10) AS east2, round(s3, 6) AS south3, round(w3, 6) AS west3 FROM m JOIN slid USING (id)""")
def moved_bounds(spark, sf):
    """Bounds of neighbours, of crops by pixels, and of squares slid into their coverage."""
    f, b, k = _bounded(spark, sf), F.col("b"), F.col("id")
    place = F.element_at(F.array(*map(F.lit, ("NW", "N", "NE", "W", "E", "SW", "S", "SE"))), (k % 8 + 1).cast("int"))
    chosen = frames.slid_into(_square(F.col("lat"), F.col("lng"), k), b)
    f = f.select("id", frames.neighbour_bounds(b, place).alias("n"), frames.cropped_bounds(b, F.lit(256), F.lit(512), k % 50, k % 100, F.lit(128)).alias("c"), chosen.alias("s"))
    return f.select("id", _rounded("n.north").alias("north1"), _rounded("n.west").alias("west1"), _rounded("c.north", 10).alias("north2"), _rounded("c.south", 10).alias("south2"), _rounded("c.west", 10).alias("west2"), _rounded("c.east", 10).alias("east2"), _rounded("s.south").alias("south3"), _rounded("s.west").alias("west3"))


def _square(lat, lng, k):
    size = 1000.0 * (1 + k % 6)
    tall, wide = size / 111320, size / (111320 * F.cos(F.radians(lat)))
    clat, clng = lat + 0.02 * (k % 3 - 1), lng + 0.05 * (k % 5 - 2)
    return frames.bounds(clat + tall / 2, clat - tall / 2, clng + wide / 2, clng - wide / 2)


@query("frame_pixels", f"""
WITH a AS (SELECT *, lat + 0.05 * (id % 3 - 1) AS plat, lng + 0.06 * (id % 4 - 1) AS plng, id % 256 AS x, id * 7 % 128 AS y FROM {_B})
SELECT id, round(greatest(south, least(north, plat)), 6) AS held_lat, round(greatest(west, least(east, plng)), 6) AS held_lng,
  round(north - y / 127 * (north - south), 6) AS lat, round(((west + x / 255 * (east - west)) + 540) % 360 - 180, 6) AS lng,
  CAST(greatest(0, least(1023, floor((plng - west) / (east - west) * 1023 + 0.5))) AS INT) AS px, CAST(greatest(0, least(1023, floor((plat - south) / (north - south) * 1023 + 0.5))) AS INT) AS py,
  round(x / 255 * 100 - 50, 6) AS scene_x, round(y / 127 * 100 - 50, 6) AS scene_z,
  floor((greatest(0, least(1, (plng - west) / (east - west))) - 0.5) * 2048 * 10 + 0.5) / 10 AS world_x, floor((0.5 - greatest(0, least(1, (north - plat) / (north - south)))) * 2048 * 10 + 0.5) / 10 AS world_y
FROM a""")
def frame_pixels(spark, sf):
    f, b, k = _bounded(spark, sf), F.col("b"), F.col("id")
    lat, lng = F.col("lat") + 0.05 * (k % 3 - 1), F.col("lng") + 0.06 * (k % 4 - 1)
    x, y = k % 256, k * 7 % 128
    f = f.select("id", frames.held_point(lat, lng, b).alias("h"), frames.pixel_point(x, y, F.lit(256), F.lit(128), b).alias("p"), frames.south_west_pixel(lat, lng, b, F.lit(1024)).alias("t"), frames.scene_position(x, y, F.lit(256), F.lit(128)).alias("s"), frames.world_position(lat, lng, b, F.lit(2048.0)).alias("w"))
    return f.select("id", _rounded("h.lat").alias("held_lat"), _rounded("h.lng").alias("held_lng"), _rounded("p.lat").alias("lat"), _rounded("p.lng").alias("lng"), "t.px", "t.py", _rounded("s.x").alias("scene_x"), _rounded("s.z").alias("scene_z"), F.col("w.x").alias("world_x"), F.col("w.y").alias("world_y"))


@query("plane_vectors", """
WITH v AS (SELECT c_custkey AS id, (c_custkey % 21 - 10)::DOUBLE AS x, (c_custkey * 3 % 17 - 8)::DOUBLE AS y, (c_custkey * 5 % 13 - 6)::DOUBLE AS x2, (c_custkey * 11 % 19 - 9)::DOUBLE AS y2 FROM customer),
n AS (SELECT *, sqrt(x * x + y * y) AS a, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS b FROM v)
SELECT id, round(CASE WHEN a = 0 THEN 0 ELSE x / a END, 6) AS ux, round(CASE WHEN a = 0 THEN 1 ELSE x / a END, 6) AS nx, round(CASE WHEN a = 0 THEN 0 ELSE y / a END, 6) AS uy,
  round(CASE WHEN a = 0 OR b = 0 THEN 90 ELSE degrees(acos(greatest(-1, least(1, (x * (x2 - x) + y * (y2 - y)) / a / b)))) END, 4) AS turn,
  [floor(cos(x / 3) * 1000000 + 0.5) / 1000000, floor(sin(x / 3) * 1000000 + 0.5) / 1000000, 0, -floor(sin(x / 3) * 1000000 + 0.5) / 1000000, floor(cos(x / 3) * 1000000 + 0.5) / 1000000, 0, 0, 0, 1]::DOUBLE[] AS yaw,
  round((x + 10) * 4 + 8, 6) AS u, round((9 - y) * 4 + 8, 6) AS v, round((x - 8) / 4 - 10, 6) AS wx, round(9 - (y - 8) / 4, 6) AS wy, round(sin((x + 0.17) * 12.9898) * 43758.5453123 - floor(sin((x + 0.17) * 12.9898) * 43758.5453123), 4) AS share
FROM n""")
def plane_vectors(spark, sf):
    """Directions, turns at a point, yaw matrices and the pixels of a plane."""
    k = F.col("c_custkey")
    at = lambda n, m, o: (k * n % m - o).cast("double")
    v = read(spark, sf, "customer").select(k.alias("id"), at(1, 21, 10).alias("x"), at(3, 17, 8).alias("y"), at(5, 13, 6).alias("x2"), at(11, 19, 9).alias("y2"))
    x, y, b = F.col("x"), F.col("y"), F.struct(F.lit(-10.0).alias("min_x"), F.lit(10.0).alias("max_x"), F.lit(-9.0).alias("min_y"), F.lit(9.0).alias("max_y"))
    point = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    turn = frames.turn_degrees(point(F.lit(0.0), F.lit(0.0)), point(x, y), point(F.col("x2"), F.col("y2")))
    v = v.select("id", frames.unit_vector(x, y).alias("d"), frames.unit_vector(x, y, still=(1.0, 0.0)).alias("n"), turn.alias("turn"), frames.yaw_matrix(x / 3).alias("yaw"), frames.plane_pixel(x, y, b, 4.0, 8.0).alias("p"), frames.plane_point(x, y, b, 4.0, 8.0).alias("w"), frames.seeded_share(x + 0.17).alias("share"))
    return v.select("id", _rounded("d.x").alias("ux"), _rounded("n.x").alias("nx"), _rounded("d.y").alias("uy"), _rounded("turn", 4).alias("turn"), "yaw", _rounded("p.u").alias("u"), _rounded("p.v").alias("v"), _rounded("w.x").alias("wx"), _rounded("w.y").alias("wy"), _rounded("share", 4).alias("share"))


@query("listing_fields", """
WITH p AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 6 AS k FROM part)
SELECT id, CASE WHEN k = 5 THEN NULL ELSE CAST(id % 10000 AS INT) END AS returned, list_reverse(list_sort(list_distinct(list_filter([CAST(2014 + n % 9 AS INT), CAST(2017 + n % 5 AS INT)], lambda y: y BETWEEN 2018 AND 2020)))) AS years,
  [2180, 2176, 2177, 2178, 2179, 2180][k + 1] AS zone, CASE WHEN k < 3 THEN 2180 WHEN k < 5 AND NOT n BETWEEN 10 AND 19 THEN 32600 + n::INT END AS wkt_code,
  CASE WHEN k = 0 THEN NULL WHEN 7000 - 25 + n BETWEEN 7000 AND 7999 THEN NULL ELSE CAST(7000 - 25 + n AS INT) END AS key_code,
  CASE WHEN k = 1 THEN 'meters' WHEN k = 2 THEN 'feet' WHEN k = 3 THEN 'us_survey_feet' ELSE 'unknown' END AS unit, k IN (0, 2, 4) AS zip, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0 WHEN k = 2 THEN 1500 ELSE n * 1000 END AS wait_ms,
  k IN (1, 2) AS gml, k = 3 AS tile, k = 4 AS token
FROM p""")
def listing_fields(spark, sf):
    """What readers take from listings, definitions in text, key directories and first bytes."""
    k, n = F.col("p_partkey") % 6, F.col("p_size")
    text = lambda c: c.cast("string")
    of = lambda *v: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]), (k + 1).cast("int"))
    xml = F.concat(F.lit('<wfs numberreturned="'), F.when(k == 5, "x").otherwise(text(F.col("p_partkey") % 10000)), F.lit('"><Name>SkorowidzNMT'), text(2014 + n % 9), F.lit("</Name><Name>skorowidznmt"), text(2017 + n % 5), F.lit("</Name>"))
    label = of("PL-1992", "uk pl-2000:s5", "PL-2000 S6", "pl-2000:S7", "PL-2000 s8", "")
    code = F.when(n.between(10, 19), F.lit(7000)).otherwise(32600 + n)
    wkt = F.when(k < 3, F.concat(F.lit('COMPD_CS["x",PROJCS["y",GEOGCS["z",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","2180"]],VERT_CS["h",AUTHORITY["EPSG","5621"]]]'))).when(k < 5, F.concat(F.lit('PROJCRS["u",ID["epsg",'), text(code), F.lit("]]")))
    keys = F.array(F.struct(F.lit(1024).alias("id"), F.lit(0).alias("location"), F.lit(1).alias("value")), F.struct(F.when(k == 0, 9).otherwise(F.when(k % 2 == 0, 3072).otherwise(2048)).alias("id"), F.lit(0).alias("location"), (7000 - 25 + n).cast("int").alias("value")))
    first = of("PK\x03\x04rest", "PK\x03", "PK\x05\x06", "PKxx", "PK\x07\x08z", "")
    wait = F.when(k == 0, "soon").when(k == 1, "-3").when(k == 2, " 1.5").when(k == 3, text(n)).otherwise(F.concat(F.lit("Tue, 05 Mar 2024 10:00:"), F.lpad(text(n), 2, "0"), F.lit(" GMT")))
    wait = F.when((k > 3) & (n > 59), text(n)).otherwise(wait)
    now = F.to_timestamp(F.lit("2024-03-05 10:00:00"))
    p = read(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), text_grids.number_returned(xml).alias("returned"), text_grids.survey_years(xml).alias("years"), text_grids.epsg_of_label(label).alias("zone"), text_grids.epsg_of_wkt(wkt).alias("wkt_code"), text_grids.epsg_of_keys(keys).alias("key_code"),
        text_grids.linear_unit(9000 + k).alias("unit"), text_grids.zipped(first.cast("binary")).alias("zip"), scalars.retry_after_ms(wait, now).alias("wait_ms"),
        scalars.gml_name(of("a.gmlx", "B.GML", "c.Xml", "xml", ".gm", "d.txt")).alias("gml"), scalars.tile_key(of("x|1", "ter|", "sa|t|", "sat|3", "TERR|", "")).alias("tile"), scalars.token_like(of("a.b.c", "eyJ", "eyJx.eyJy", "eyJa.b.c.d", " eyJa-_1.eyJb.Zc ", "")).alias("token"),
    )


@query("combined_coverages", """
WITH f AS (SELECT s_suppkey AS id, s_nationkey AS g, 10.0 + s_suppkey % 9 AS a0, 95.0 + s_suppkey % 7 AS b0, 1 + s_suppkey % 3 AS d, s_suppkey % 2 = 0 AS flip, s_suppkey % 5 = 4 AS none FROM supplier),
b AS (SELECT *, CASE WHEN NOT none THEN CASE WHEN flip THEN a0 + d ELSE a0 + d END END AS north, CASE WHEN NOT none THEN a0 END AS south, CASE WHEN NOT none THEN CASE WHEN flip THEN b0 + d ELSE b0 + 100 + d END END AS east, CASE WHEN NOT none THEN CASE WHEN flip THEN b0 ELSE b0 + 100 END END AS west FROM f)
SELECT g, count(*) AS files, max(north)::DOUBLE AS north, min(south)::DOUBLE AS south, max(east)::DOUBLE AS east, min(west)::DOUBLE AS west,
  CASE WHEN count(DISTINCT 6660 + g % 4 + id % 2) FILTER (id % 3 > 0) = 1 THEN min(CAST(6660 + g % 4 + id % 2 AS INT)) FILTER (id % 3 > 0) END AS epsg, CASE WHEN count(*) FILTER (id % 4 = 0) > 0 THEN 'meters' ELSE 'unknown' END AS unit
FROM b GROUP BY g""")
def combined_coverages(spark, sf):
    """Envelopes with either axis first, a fifth without corners, combined by nation."""
    k, g = F.col("s_suppkey"), F.col("s_nationkey")
    a0, b0, d = 10.0 + k % 9, 95.0 + k % 7, 1 + k % 3
    pair = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    flip, wide = k % 2 == 0, b0 + 100
    low = F.when(flip, pair(a0, b0)).otherwise(pair(wide + d, a0))
    high = F.when(flip, pair(a0 + d, b0 + d)).otherwise(pair(wide, a0 + d))
    text = F.when(k % 5 == 4, "<gml:Envelope><gml:lowerCorner>1</gml:lowerCorner></gml:Envelope>").otherwise(F.concat(F.lit("<gml:Envelope><gml:lowerCorner> "), low, F.lit("</gml:lowerCorner><gml:upperCorner>"), high, F.lit("</gml:upperCorner></gml:Envelope>")))
    f = read(spark, sf, "supplier").select(g.alias("g"), text_grids.envelope_bounds(text).alias("bounds"), F.when(k % 3 > 0, (6660 + g % 4 + k % 2).cast("int")).alias("epsg"), F.when(k % 4 == 0, "meters").otherwise("unknown").alias("unit"))
    return text_grids.combined_sources(f, ["g"])


@query("aoi_frames", f"""
WITH c AS (SELECT id, north, south, east, west, radians((north + south) / 2) AS a, radians((east + west) / 2) AS o FROM {_B}),
e AS (SELECT *, 6378137 / sqrt(1 - 0.00669437999014 * sin(a) * sin(a)) AS n FROM c),
p AS (SELECT *, n * cos(a) * cos(o) AS x, n * cos(a) * sin(o) AS y, n * (1 - 0.00669437999014) * sin(a) AS z, sqrt(pow(n * cos(a), 2) + pow(n * (1 - 0.00669437999014) * sin(a), 2)) AS r FROM e)
SELECT id, round(greatest((east - west) * 111320 * cos(a), (north - south) * 111320), 4) AS extent, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(z / r, 9) AS up_z, round(-sin(o), 9) AS east_x, round(sqrt(x * x + y * y) / r, 9) AS north_z,
  round(greatest(0, least(511, (lng + 0.01 - west) / (east - west) * 511)), 5) AS col, round(greatest(0, least(511, 511 - (lat - 0.005 - south) / (north - south) * 511)), 5) AS row,
  CASE WHEN id % 4 > 0 THEN floor(-(sin(id) * 90) * 1000 + 0.5) / 1000 ELSE 0 END AS sea, concat('v3|', printf('%.7f,%.7f,%.7f,%.7f', north, south, east, west), '|', id % 9 + 1, 'x512|et=5|sweep=true', CASE WHEN id % 2 = 0 THEN concat('|corr=150:', id) ELSE '' END) AS key
FROM p JOIN (SELECT id, lat, lng FROM {_B}) USING (id)""")
def aoi_frames(spark, sf):
    """Earth-centred frames, height-map places, sea levels and keys of areas."""
    f, b, k = _bounded(spark, sf), F.col("b"), F.col("id")
    key = frames.bake_key(3, b, k % 9 + 1, F.lit(512), [("et", F.lit(5)), ("sweep", F.lit(True))], F.when(k % 2 == 0, F.concat(F.lit("150:"), k.cast("string"))))
    f = f.select("id", frames.aoi_frame(b).alias("f"), frames.height_map_place(F.col("lat") - 0.005, F.col("lng") + 0.01, b, F.lit(512)).alias("h"), frames.sea_level(F.when(k % 4 > 0, F.sin(k) * 90)).alias("sea"), key.alias("key"))
    c, u = F.col("f.centre"), F.col("f.up")
    return f.select("id", _rounded("f.extent", 4).alias("extent"), *[_rounded(c[i], 3).alias(n) for i, n in enumerate("xyz")], _rounded(u[2], 9).alias("up_z"), _rounded(F.col("f.east")[0], 9).alias("east_x"), _rounded(F.col("f.north")[2], 9).alias("north_z"), _rounded("h.col", 5).alias("col"), _rounded("h.row", 5).alias("row"), "sea", "key")
