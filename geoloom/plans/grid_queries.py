"""Queries of rasters over the embeddings grid and of the point cloud of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import grid

from .registry import query
from .views import GRID, read
from .views import grid as cells


@query("hole_shares", f"SELECT y, count(*) AS cells, count(*) - count(h) AS holes, avg(CAST(h IS NULL AS INT)) AS hole_share, min(h) AS lowest, max(h) AS highest FROM {GRID} GROUP BY y")
def hole_shares(spark, sf):
    return grid.coverage(cells(spark, sf), ["y"])


@query("row_blur", f"SELECT y, x, round(CASE WHEN h IS NOT NULL THEN avg(h) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) END, 9) AS h FROM {GRID}")
def row_blur(spark, sf):
    return grid.blur_axis(cells(spark, sf), "x", 8).select("y", "x", F.round("h", 9).alias("h"))


@query("smooth", f"""
WITH a AS (SELECT y, x, CASE WHEN h IS NOT NULL THEN avg(h) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) END AS h FROM {GRID}),
b AS (SELECT y, x, CASE WHEN h IS NOT NULL THEN avg(h) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) END AS h FROM a),
c AS (SELECT y, x, CASE WHEN h IS NOT NULL THEN avg(h) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) END AS h FROM b)
SELECT y, x, round(CASE WHEN h IS NOT NULL THEN avg(h) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) END, 8) AS h FROM c""")
def smooth(spark, sf):
    return grid.smooth(cells(spark, sf)).select("y", "x", F.round("h", 8).alias("h"))


_NINE = f"(SELECT y + dy AS y, x + dx AS x, h AS v FROM {GRID}, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE h IS NOT NULL)"


@query("mean_3x3", f"SELECT g.y, g.x, round(m, 9) AS h FROM {GRID} g LEFT JOIN (SELECT y, x, avg(v) AS m FROM {_NINE} GROUP BY y, x) n ON g.y = n.y AND g.x = n.x")
def mean_3x3(spark, sf):
    return grid.mean_3x3(cells(spark, sf)).select("y", "x", F.round("h", 9).alias("h"))


@query("spikes", f"""
WITH a AS (SELECT y, x, list_sort(list(v)) AS a FROM {_NINE} GROUP BY y, x), m AS (SELECT *, a[len(a) // 2 + 1] AS m FROM a),
d AS (SELECT *, list_sort(list_transform(a, lambda v: abs(v - m)))[len(a) // 2 + 1] AS d FROM m)
SELECT g.y, g.x, round(CASE WHEN g.y > y0 AND g.y < y1 AND g.x > 0 AND g.x < 63 AND len(a) >= 5 AND (abs(h - m) > greatest(0.1, d * 2.0) OR abs(h) > 12000) THEN m ELSE h END, 9) AS h
FROM {GRID} g LEFT JOIN d ON g.y = d.y AND g.x = d.x, (SELECT min(vec_id) AS y0, max(vec_id) AS y1 FROM embeddings)""")
def spikes(spark, sf):
    return grid.suppress_spikes(cells(spark, sf), floor=0.1, times=2.0).select("y", "x", F.round("h", 9).alias("h"))


@query("bilinear", f"""
WITH r AS (SELECT max(vec_id) AS y1, 7 * ((max(vec_id) + 1) * 3 // 20 + 3) + 1 AS m FROM embeddings),
p AS (SELECT c_custkey AS id, greatest(0.0, least(63.0, c_custkey % 71 * 0.93 - 1)) AS x, greatest(0.0, least(y1, c_custkey * 7 % m * 0.97::DOUBLE)) AS y, y1 FROM customer, r),
q AS (SELECT *, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0 FROM p),
c AS (SELECT id, least(y0 + a, y1) AS cy, least(x0 + b, 63) AS cx, (CASE WHEN a = 1 THEN y - y0 ELSE 1 - (y - y0) END) * (CASE WHEN b = 1 THEN x - x0 ELSE 1 - (x - x0) END) AS w FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT id, round(CASE WHEN count(h) = 4 THEN sum(h * w) END, 9) AS h FROM c LEFT JOIN {GRID} g ON g.y = cy AND g.x = cx GROUP BY id""")
def bilinear(spark, sf):
    k, last = F.col("c_custkey"), read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    height = 0 if last is None else last + 1
    # prime to the 7 and a little beyond the last row, so that points fall on all rows and past the edge
    m = 7 * (height * 3 // 20 + 3) + 1
    p = read(spark, sf, "customer").select(k.alias("id"), (k % 71 * 0.93 - 1).alias("px"), (k * 7 % m * 0.97).alias("py"))
    return grid.sample_bilinear(cells(spark, sf), p, 64, height).select("id", F.round("h", 9).alias("h"))


@query("push_pull", f"""
WITH g AS {GRID}, a AS (SELECT y // 2 AS y, x // 2 AS x, avg(h) AS h FROM g GROUP BY ALL), b AS (SELECT y // 2 AS y, x // 2 AS x, avg(h) AS h FROM a GROUP BY ALL), c AS (SELECT y // 2 AS y, x // 2 AS x, avg(h) AS h FROM b GROUP BY ALL)
SELECT g.y, g.x, round(coalesce(g.h, a.h, b.h, c.h), 9) AS h FROM g LEFT JOIN a ON a.y = g.y // 2 AND a.x = g.x // 2 LEFT JOIN b ON b.y = g.y // 4 AND b.x = g.x // 4 LEFT JOIN c ON c.y = g.y // 8 AND c.x = g.x // 8""")
def push_pull(spark, sf):
    return grid.push_pull(cells(spark, sf), 3).select("y", "x", F.round("h", 9).alias("h"))


@query("quantise", f"SELECT y, x, CAST(greatest(0, least(65535, floor((coalesce(h, -0.3) + 0.3) / 0.9 * 65535))) AS INT) AS q FROM {GRID}")
def quantise(spark, sf):
    lo, hi = F.lit(-0.3), F.lit(0.6)
    return cells(spark, sf).select("y", "x", grid.quantised(F.col("h"), lo, hi).alias("q"))


@query("crop", f"SELECT y - 100 AS y, x - 10 AS x, h FROM {GRID} WHERE y BETWEEN 100 AND 131 AND x BETWEEN 10 AND 41")
def crop(spark, sf):
    return grid.cropped(cells(spark, sf), 100, 10, 32)


@query("mosaic", f"SELECT y % 90 AS y, x, arg_max(h, CASE WHEN h IS NOT NULL THEN y // 60 END) AS h FROM {GRID} GROUP BY y % 90, x")
def mosaic(spark, sf):
    """Rows of rasters that overlap: layer by 60 rows, place by 90; of one layer's cells there is one."""
    c = cells(spark, sf).select(F.floor(F.col("y") / 60).alias("layer"), (F.col("y") % 90).alias("y"), "x", "h")
    return grid.mosaic(c)


@query("scatter_medians", "SELECT CAST(floor(l_partkey / 40.0) AS BIGINT) AS cx, CAST(floor(l_suppkey / 8.0) AS BIGINT) AS cz, median(l_extendedprice) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2")
def scatter_medians(spark, sf):
    s = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("z"), F.col("l_extendedprice").alias("value"))
    # cells of 40 by 8: the second axis is stretched to the first's cell
    return grid.scatter_medians(s.withColumn("z", F.col("z") * 5), 40.0)


@query("point_grid", """
WITH b AS (SELECT min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_suppkey) AS y1 FROM lineitem)
SELECT CAST(floor((y1 - y0) / 4.0) AS INT) - CAST(floor((l_suppkey - y0) / 4.0) AS INT) AS row, CAST(floor((l_partkey - x0) / 50.0) AS INT) AS col, round(avg(l_extendedprice), 6) AS h, count(*) AS n
FROM lineitem, b WHERE l_linenumber IN (2, 6) AND l_suppkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2""")
def point_grid(spark, sf):
    p = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_linenumber").alias("class"))
    b = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, x1, y1 = b if None not in b else (0, 0, 0, 0)
    return grid.gridded_points(p, (2, 6), x0, y0, 50.0, 4.0, int((x1 - x0) // 50) + 1, int((y1 - y0) // 4) + 1).select("row", "col", F.round("h", 6).alias("h"), "n")


@query("percentile_rules", """
SELECT user_id % 50 AS g, list_sort(list(value))[CAST(floor(count(*) * 0.05) AS BIGINT) + 1] AS low, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.8) AS BIGINT) + 1] AS surface,
  round(quantile_cont(value, 0.9), 9) AS linear FROM events GROUP BY 1""")
def percentile_rules(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 50).alias("g"), "value")
    got = grid.rank_values(e, ["g"], "value", {"low": (0.05, "floor_n"), "surface": (0.8, "floor_n1"), "linear": (0.9, "linear")})
    return got.select("g", "low", "surface", F.round("linear", 9).alias("linear"))


@query("finished_rasters")
def finished_rasters(spark, sf):
    """Rasters of 50 rows with their holes in-painted, grown into and relaxed."""
    from geoloom.operators import rasters

    c = cells(spark, sf).select(F.floor(F.col("y") / 50).alias("id"), "y", "x", "h")
    return rasters.per_raster(c, lambda a: rasters.finished(a, smooth=False, fill=True))


@query("highest_cells", f"SELECT y // 10 AS block, arg_min({{'y': y, 'x': x, 'h': h}}, (-h, y, x)).y AS top_y, arg_min({{'y': y, 'x': x, 'h': h}}, (-h, y, x)).x AS top_x, max(h) AS top_h FROM {GRID} WHERE h IS NOT NULL GROUP BY 1")
def highest_cells(spark, sf):
    return grid.highest(cells(spark, sf).withColumn("block", F.floor(F.col("y") / 10)), ["block"])
