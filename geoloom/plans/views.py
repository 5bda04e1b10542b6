"""Geographic views of the test tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.operators.shared import dealt, parts_of

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POINTS = "(SELECT c_custkey AS id, 30 + (c_custkey % 500) * 0.1 AS lat, -180 + (c_custkey * 37 % 3600) * 0.1 AS lng FROM customer)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), (30 + (k % 500) * 0.1).alias("lat"), (-180 + (k * 37 % 3600) * 0.1).alias("lng"))


GRID = "(SELECT vec_id AS y, CAST(i - 1 AS INT) AS x, CASE WHEN CAST(embedding[i] AS DOUBLE) < -0.3 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END AS h FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, h of the embeddings as a raster; values under -0.3 are holes."""
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    v = F.col("v").cast("double")
    return cells.select("y", "x", F.when(v >= -0.3, v).alias("h"))


WAYS = "(SELECT l_orderkey AS way, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS idx, concat(l_partkey, ':', l_suppkey) AS node, l_partkey % 997 AS px, l_suppkey * 7 % 991 AS py FROM lineitem)"


def _place() -> list[Column]:
    """node, px, py of rows of lineitem."""
    node = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
    return [node.alias("node"), (F.col("l_partkey") % 997).alias("px"), (F.col("l_suppkey") * 7 % 991).alias("py")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, node, px, py: the rows of `ways` as they are read, in no order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), *_place())


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, idx, node, px, py: orders as lines through (part, supplier) nodes, in parts by way."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dealt(rows, parts_of(rows), "l_orderkey").select(F.col("l_orderkey").alias("way"), (F.row_number().over(w) - 1).alias("idx"), *_place())


_HIGHWAYS = ("motorway", "motorway_link", "trunk", "primary", "primary_link", "secondary", "tertiary", "residential", "unclassified", "service", "track", "footway", "living_street")
_VALUES = {
    "lanes": ("", "2", "4 lanes", "7", "x", "1;2", "12"),
    "lanes:forward": ("", "", "1", "3", "-1"),
    "lanes:backward": ("", "2", "", ""),
    "turn:lanes:forward": ("", "left|through|right", "", "|", "left| "),
    "turn:lanes": ("", "left|right", ""),
    "oneway": ("", "yes", "no", "-1", " TRUE", "reverse", "0", ""),
    "width": ("", "12", "12.5 m", "40 ft", "60", "wide", "-3", ".5", "4;5"),
    "surface": ("", "asphalt", "gravel", " Dirt", "concrete", "sand", "grass", ""),
    "lane_markings": ("", "", "yes", "no", ""),
    "layer": ("", "", "1", "-2", "x", "2.7"),
    "bridge": ("", "yes", "", "viaduct", ""),
    "tunnel": ("", "", "yes"),
    "embankment": ("", "", "", "yes"),
    "service": ("", "alley", "", "Driveway"),
    "junction": ("", "", "", "", "roundabout"),
    "natural": ("", "wood", "water", "sand", "", "rock", "coastline", "mud", "heath"),
    "landuse": ("", "forest", "reservoir", "", "retail", "quarry", "farmland", "residential", "railway", ""),
    "leisure": ("", "", "park", "stadium", "track", "", "marina", ""),
    "amenity": ("", "", "parking", "", "fuel", "", "school"),
    "building": ("", "", "", "yes", "", "", ""),
    "barrier": ("", "", "", "", "wall", "retaining_wall"),
    "waterway": ("", "", "", "", "river", "dock", "", ""),
    "historic": ("", "", "", "", "", "castle", "ruins"),
    "man_made": ("", "", "", "", "", "", "", "bridge"),
    "area": ("", "", "", "yes", "", "no", "", ""),
}


def tag_specs() -> list[tuple[str, tuple[str, ...], int]]:
    """Key, values and step of each synthetic tag: values turn with the id at unlike speeds."""
    return [(k, v, 3 + 2 * i) for i, (k, v) in enumerate({"highway": ("", *_HIGHWAYS)} .items())] + [(k, v, 5 + 2 * i) for i, (k, v) in enumerate(_VALUES.items())]


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and tags of synthetic features, one a part."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    pairs = []
    for key, values, step in tag_specs():
        n = F.floor(F.col("id") / step + F.col("id")).cast("bigint") % len(values)
        pairs += [F.lit(key), F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))]
    tags = F.map_filter(F.create_map(*pairs), lambda _, v: v != "")
    return rows.select("id", tags.alias("tags"))


def tagged_sql() -> str:
    """The same features with one column a tag, null where it is missing (a colon becomes _)."""
    cols = []
    for key, values, step in tag_specs():
        items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        cols.append(f"nullif(([{items}])[CAST(floor(p_partkey / {step} + p_partkey) AS BIGINT) % {len(values)} + 1], '') AS {key.replace(':', '_')}_")
    return f"(SELECT p_partkey AS id, {', '.join(cols)} FROM part)"


TRACKS = "(SELECT user_id AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, value AS step FROM events)"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.row_number().over(w) - 1).alias("idx"), F.col("value").alias("step"))
