"""Queries of readers and sinks: files are composed from the test tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import scalars
from geoloom.sinks import exports
from geoloom.sources import records, text_grids

from .registry import query
from .views import WAYS, read, ways


def _grids(spark, sf):
    """One 8 x 8 grid an embedding, in hundredths; some cells are holes."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v"))
    h = F.floor(F.col("v").cast("double") * 100)
    return e.select("id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.when(h > -15, h.cast("double")).alias("h"))


_CELLS = "SELECT vec_id AS id, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, CASE WHEN floor(CAST(embedding[i] AS DOUBLE) * 100) > -15 THEN floor(CAST(embedding[i] AS DOUBLE) * 100) END AS h FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)"


@query("asc_grids", _CELLS)
def asc_grids(spark, sf):
    return text_grids.read_asc(exports.asc_text(_grids(spark, sf), 10.0, 40.0, 0.01))


@query("asc_headers", """
SELECT c_custkey AS id, c_custkey % 9 + 1 AS cols, c_custkey % 5 + 1 AS rows,
  CASE WHEN x > 180 THEN x - 360 ELSE x END::DOUBLE AS west, round((c_custkey % 50)::DOUBLE - CASE WHEN c_custkey % 4 < 2 THEN cell / 2 ELSE 0 END + cell * (c_custkey % 5 + 1), 6) AS north, cell, c_custkey % 3 > 0 AS likely
FROM (SELECT *, 0.25 * (1 + c_custkey % 3)::DOUBLE AS cell, (c_custkey % 350)::DOUBLE - CASE WHEN c_custkey % 4 < 2 THEN 0.125 * (1 + c_custkey % 3) ELSE 0 END AS x FROM customer)""")
def asc_headers(spark, sf):
    """Headers that name corners, centres or both; a third lacks the cell size's line among the first 2048 characters."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    edge = lambda axis, v: F.concat(F.when(k % 4 > 0, F.concat(F.lit(f"{axis}llcorner "), text(F.when(k % 4 == 1, v + 3).otherwise(v)), F.lit("\n"))).otherwise(""), F.when(k % 4 < 2, F.concat(F.lit(f"{axis}llcenter "), text(v), F.lit("\n"))).otherwise(""))
    head = F.concat(F.lit("NCOLS "), text(k % 9 + 1), F.lit("\nnrows   "), text(k % 5 + 1), F.lit("\n"), edge("x", k % 350), edge("y", k % 50))
    late = F.when(k % 3 == 0, F.repeat(F.lit("# remark\n"), 300)).otherwise("")
    keys = read(spark, sf, "customer").select("c_custkey")
    # a few bytes a key become a file of some thousand: they are dealt out first
    c = keys.repartition(max(16, keys.count() // 20_000)).select(k.alias("id"), F.concat(head, late, F.lit("cellsize "), text(0.25 * (1 + k % 3)), F.lit("\n1 2 3\n")).alias("text"))
    return text_grids.asc_meta(c, text_grids.likely_asc(F.col("text")).alias("likely")).select("id", "cols", "rows", "west", F.round("north", 6).alias("north"), "cell", "likely")


@query("gml_grids", f"SELECT * FROM ({_CELLS})")
def gml_grids(spark, sf):
    g = _grids(spark, sf)
    lists = g.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "h"))), lambda c: F.concat(F.lit("v,"), F.coalesce(c["h"].cast("string"), F.lit("none")))), " ").alias("v"))
    text = F.format_string('<gml:RectifiedGridCoverage srsName="urn:ogc:def:crs:EPSG::6668"><gml:low>0 0</gml:low><gml:high>7 7</gml:high><gml:tupleList>%s</gml:tupleList></gml:RectifiedGridCoverage>', "v")
    return text_grids.read_gml(lists.select("id", text.alias("text")))


@query("xyz_grids", """
WITH p AS (SELECT l_orderkey % 50 AS id, l_partkey % 4 AS x, l_suppkey % 3 AS y, max(l_quantity) AS h FROM lineitem GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY x) - 1 AS c, dense_rank() OVER (PARTITION BY id ORDER BY y DESC) - 1 AS r FROM p)
SELECT id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, h FROM r QUALIFY count(*) OVER (PARTITION BY id) / ((max(c) OVER (PARTITION BY id) + 1) * (max(r) OVER (PARTITION BY id) + 1)) BETWEEN 0.8 AND 1.2""")
def xyz_grids(spark, sf):
    li = read(spark, sf, "lineitem")
    line = F.format_string("%d.0 %d.0 %s", F.col("l_partkey") % 4, F.col("l_suppkey") % 3, F.col("l_quantity").cast("string"))
    files = li.groupBy((F.col("l_orderkey") % 50).alias("id")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return text_grids.read_xyz(files)


@query("decoded_polylines", f"""
SELECT way AS id, idx, (px * 911 % 1800000 - 900000) / 100000.0::DOUBLE AS lat, (py * 1777 % 3600000 - 1800000) / 100000.0::DOUBLE AS lng FROM {WAYS}""")
def decoded_polylines(spark, sf):
    """Lines of orders, encoded by the published rule and decoded again."""
    p = ways(spark, sf).select(F.col("way").alias("id"), "idx", (F.col("px") * 911 % 1800000 - 900000).alias("lat"), (F.col("py") * 1777 % 3600000 - 1800000).alias("lng"))
    w = Window.partitionBy("id").orderBy("idx")
    step = lambda c: records.encoded_number(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)))
    text = p.withColumn("t", F.concat(step("lat"), step("lng"))).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "t"))), lambda s: s["t"]), "").alias("text"))
    c = text.select("id", F.posexplode(records.decode_polyline(F.col("text"))).alias("idx", "p"))
    return c.select("id", "idx", "p.lat", "p.lng")


@query("map_elements", """
SELECT l_orderkey AS file, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS ord, l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'node' ELSE 'way' END AS type, l_returnflag AS kind FROM lineitem""")
def map_elements(spark, sf):
    li = read(spark, sf, "lineitem")
    e = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.to_json(F.struct(F.when(F.col("l_linenumber") % 2 == 0, "node").otherwise("way").alias("type"), F.col("l_partkey").alias("id"), F.create_map(F.lit("kind"), F.col("l_returnflag")).alias("tags"))).alias("j"))
    files = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit('{"elements":['), F.array_join(F.transform(F.sort_array(F.collect_list(e)), lambda x: x["j"]), ","), F.lit("]}")).alias("text"))
    return records.read_elements(files).select("file", "ord", "id", "type", F.col("tags")["kind"].alias("kind"))


@query("sheet_links", """
WITH m AS (SELECT l_orderkey AS id, l_partkey AS n, CASE WHEN l_linenumber % 3 = 0 THEN concat('ftp://x/', l_partkey) ELSE concat('https://x/', l_partkey) END AS url, CASE WHEN l_suppkey % 2 = 0 THEN concat('N-', l_suppkey % 5) END AS sheet FROM lineitem)
SELECT id, coalesce(sheet, url) AS key, arg_min(url, n) AS url FROM m WHERE url LIKE 'https%' GROUP BY id, coalesce(sheet, url)""")
def sheet_links(spark, sf):
    li = read(spark, sf, "lineitem")
    url = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "ftp://x/").otherwise("https://x/"), F.col("l_partkey").cast("string"))
    sheet = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("<ms:godlo>N-"), (F.col("l_suppkey") % 5).cast("string"), F.lit("</ms:godlo>"))).otherwise("")
    block = F.struct(F.col("l_partkey").alias("n"), F.concat(F.lit("<wfs:member><ms:url_do_pobrania>"), url, F.lit("</ms:url_do_pobrania>"), sheet, F.lit("</wfs:member>")).alias("b"))
    files = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]), "").alias("text"))
    return records.links_in_xml(files)


@query("page_keys", """
WITH p AS (SELECT page_id AS id, concat('v1|GET|', url, '|') AS k, url FROM pages)
SELECT id, concat('k_', lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0'))) AS key,
  regexp_matches(url, 'utm_|ref=') AS skips FROM p""")
def page_keys(spark, sf):
    p = read(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), F.concat(F.lit("k_"), scalars.fnv1a_hex(F.concat(F.lit("v1|GET|"), F.col("url"), F.lit("|")))).alias("key"), F.col("url").rlike("utm_|ref=").alias("skips"))


@query("folder_names", "SELECT p_partkey AS idx, CASE WHEN n = 1 THEN p_type ELSE concat(p_type, '_', n) END AS folder FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)")
def folder_names(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("name"))
    return exports.deduplicated_names(p).select("idx", "folder")


@query("geojson_features", """
SELECT s_suppkey AS id, concat('{"type":"Feature","properties":{"id":"', s_suppkey, '","feature_type":"', CASE WHEN s_suppkey % 3 = 0 THEN 'building' ELSE 'road' END, '","tags":{"name":"', s_name, '"}},"geometry":{"type":"', CASE WHEN s_suppkey % 3 = 0 THEN 'Polygon","coordinates":[[[1,2],[3,4],[1,2]]]' ELSE 'LineString","coordinates":[[1,2],[3,4],[1,2]]' END, '}}') AS json FROM supplier""")
def geojson_features(spark, sf):
    k = F.col("s_suppkey")
    point = lambda a, b: F.struct(F.lit(b).alias("lat"), F.lit(a).alias("lng"))
    kind = F.when(k % 3 == 0, "building").otherwise("road")
    return read(spark, sf, "supplier").select(k.alias("id"), exports.feature_json(kind, F.create_map(F.lit("name"), F.col("s_name")), F.array(point(1, 2), point(3, 4), point(1, 2)), k.cast("string")).alias("json"))


@query("terrain_files")
def terrain_files(spark, sf):
    files = exports.terrain_files(_grids(spark, sf), 8, ["grass", "rock"])
    return files.select("id", F.length("content").alias("bytes"), F.crc32("content").alias("crc32"))


@query("tiff_grids", _CELLS)
def tiff_grids(spark, sf):
    from geoloom.sources import tiff

    return tiff.read_tiff(tiff.tiff_files(_grids(spark, sf), 10.0, 41.0, 0.01))


@query("places", """
SELECT c_custkey AS id, CAST(i AS INT) AS n, CASE WHEN i = 0 THEN c_name ELSE c_mktsegment END AS name, c_acctbal + i AS lat FROM customer, (VALUES (0), (1)) AS v(i)""")
def places(spark, sf):
    c = read(spark, sf, "customer")
    j = F.to_json(F.array(*[F.struct((F.col("c_acctbal") + i).cast("string").alias("lat"), F.lit("1.5").alias("lon"), F.concat(F.col(n), F.lit(", b")).alias("display_name"), F.col(n).alias("name"), F.lit("city").alias("type")) for i, n in ((0, "c_name"), (1, "c_mktsegment"))]))
    return records.read_places(c.select(F.col("c_custkey").alias("id"), j.alias("text"))).select("id", "n", "name", F.round("lat", 6).alias("lat"))
