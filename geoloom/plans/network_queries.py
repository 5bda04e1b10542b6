"""Queries of road networks, joins and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import network
from geoloom.operators.shared import parts_of, table

from .registry import query
from .views import WAYS, nodes, read, ways


def shared_folder(spark):
    """Stores tables in the application's part of the folder that all executors share."""
    return lambda df: table(df, "graph")


@query("shared_nodes", f"SELECT node, count(DISTINCT way) AS ways FROM {WAYS} GROUP BY node HAVING count(DISTINCT way) >= 2")
def shared_nodes(spark, sf):
    return network.shared_nodes(nodes(spark, sf))


_PIECES = f"""
w AS (SELECT *, min(idx) OVER (PARTITION BY way) AS i0, max(idx) OVER (PARTITION BY way) AS i1 FROM {WAYS}),
s AS (SELECT node FROM w GROUP BY node HAVING count(DISTINCT way) >= 2),
c AS (SELECT w.*, CAST(s.node IS NOT NULL AND idx > i0 AND idx < i1 AS INT) AS cut FROM w LEFT JOIN s USING (node)),
p AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY way ORDER BY idx) - cut AS INT) AS p0 FROM c),
v AS (SELECT way, p0 AS piece, idx, node FROM p UNION ALL SELECT way, p0 + 1, idx, node FROM p WHERE cut = 1)"""


def _pieces(spark, sf):
    """The pieces of all ways, and the parts in which their rows are dealt."""
    parts = parts_of(read(spark, sf, "lineitem"))
    return network.split_ways(ways(spark, sf).select("way", "idx", "node"), parts), parts


@query("road_pieces", f"WITH {_PIECES} SELECT way, piece, CAST(row_number() OVER (PARTITION BY way, piece ORDER BY idx) - 1 AS INT) AS pos, idx, node FROM v")
def road_pieces(spark, sf):
    return _pieces(spark, sf)[0].select("way", "piece", "pos", "idx", "node")


_SEGS = _PIECES + ", g AS (SELECT way, piece, arg_min(node, idx) AS start, arg_max(node, idx) AS end_, count(*) AS points FROM v GROUP BY way, piece HAVING count(*) > 1)"


@query("segments", f'WITH {_SEGS} SELECT way, piece, start, end_ AS "end", points FROM g')
def segments(spark, sf):
    return network.segments(_pieces(spark, sf)[0])


@query("intersections", f"WITH {_SEGS}, e AS (SELECT way, start AS node FROM g UNION ALL SELECT way, end_ FROM g) SELECT node, count(*) AS entries, count(DISTINCT way) AS ways FROM e GROUP BY node HAVING count(*) > 1")
def intersections(spark, sf):
    pieces, parts = _pieces(spark, sf)
    return network.intersections(network.segments(pieces), parts)


@query("chain_nodes", f"""WITH {_SEGS}, e AS (SELECT way % 3 AS style, concat(way, '/', piece) AS seg, start AS node FROM g UNION ALL SELECT way % 3, concat(way, '/', piece), end_ FROM g)
SELECT node FROM e GROUP BY node HAVING count(*) = 2 AND count(DISTINCT seg) = 2 AND count(DISTINCT style) = 1""")
def chain_nodes(spark, sf):
    pieces, parts = _pieces(spark, sf)
    return network.chain_nodes(network.segments(pieces).withColumn("style", F.col("way") % 3), parts)


_CHAIN_WAYS = "(SELECT c_custkey AS way, 0 AS piece, CAST(c_custkey AS VARCHAR) AS a, CAST(CASE WHEN c_custkey % 17 = 16 THEN c_custkey - 16 WHEN c_custkey % 23 = 22 THEN c_custkey * 7 % 50 ELSE c_custkey + 1 END AS VARCHAR) AS b, c_custkey // 40 % 2 AS style, c_custkey % 3 = 0 AS turned FROM customer)"


@query("merged_segments", f"""
WITH RECURSIVE s AS (SELECT way, style, CASE WHEN turned THEN b ELSE a END AS s, CASE WHEN turned THEN a ELSE b END AS e FROM {_CHAIN_WAYS}),
ends AS (SELECT way, style, s AS node FROM s UNION ALL SELECT way, style, e FROM s),
j AS (SELECT node FROM ends GROUP BY node HAVING count(*) = 2 AND count(DISTINCT way) = 2 AND count(DISTINCT style) = 1),
p AS (SELECT x.way AS a, y.way AS b FROM ends x JOIN ends y ON x.node = y.node AND x.way <> y.way JOIN j ON j.node = x.node),
r AS (SELECT way, way AS seen FROM s UNION SELECT r.way, p.b FROM r JOIN p ON p.a = r.seen),
c AS (SELECT way, min(seen) AS chain, count(*) AS members FROM r GROUP BY way),
walk(chain, way, pos, leave, back) AS (SELECT c.chain, c.way, 0, s.e, false FROM c JOIN s ON s.way = c.way WHERE c.way = c.chain
  UNION ALL SELECT w.chain, n.way, w.pos + 1, CASE WHEN n.s = w.leave THEN n.e ELSE n.s END, n.s <> w.leave FROM walk w JOIN j ON j.node = w.leave JOIN s n ON (n.s = w.leave OR n.e = w.leave) AND n.way <> w.way AND n.way <> w.chain),
rear(chain, way, pos, enter, back) AS (SELECT c.chain, c.way, 0, s.s, false FROM c JOIN s ON s.way = c.way WHERE c.way = c.chain AND NOT EXISTS (SELECT 1 FROM walk v WHERE v.chain = c.chain AND v.way <> c.chain AND v.leave = s.s AND s.s IN (SELECT node FROM j))
  UNION ALL SELECT w.chain, n.way, w.pos - 1, CASE WHEN n.e = w.enter THEN n.s ELSE n.e END, n.e <> w.enter FROM rear w JOIN j ON j.node = w.enter JOIN s n ON (n.s = w.enter OR n.e = w.enter) AND n.way <> w.way AND n.way <> w.chain),
o AS (SELECT chain, way, pos, back FROM walk UNION SELECT chain, way, pos, back FROM rear)
SELECT way, CAST(0 AS INT) AS piece, chain AS chain_way, CAST(0 AS INT) AS chain_piece, CAST(pos - min(pos) OVER (PARTITION BY chain) AS INT) AS pos, back AS reversed FROM o""")
def merged_segments(spark, sf):
    """Chains of customers' links, some of them rings, a third of the links drawn the other way round."""
    k = F.col("c_custkey")
    b = F.when(k % 17 == 16, k - 16).when(k % 23 == 22, k * 7 % 50).otherwise(k + 1)
    s = read(spark, sf, "customer").select(k.alias("way"), F.lit(0).alias("piece"), k.cast("string").alias("a"), b.cast("string").alias("b"), (F.floor(k / 40) % 2).alias("style"), (k % 3 == 0).alias("turned"))
    pick = lambda x, y: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x))
    return network.merged_segments(s.select("way", "piece", pick("a", "b").alias("start"), pick("b", "a").alias("end"), "style"), shared_folder(spark))


_LINKS = "(SELECT p_partkey AS a, CASE WHEN p_partkey % 7 = 0 THEN greatest(p_partkey - 7, 0) ELSE p_partkey // 7 // 2 * 7 + p_partkey % 7 END AS b FROM part)"


@query("graph_components", f"SELECT node, min(node) OVER (PARTITION BY node % 7) AS label FROM (SELECT a AS node FROM {_LINKS} UNION SELECT b FROM {_LINKS})")
def graph_components(spark, sf):
    """Seven components over all keys by their rest: one a long path, the others trees.  The SQL knows that."""
    k = F.col("p_partkey")
    b = F.when(k % 7 == 0, F.greatest(k - 7, F.lit(0))).otherwise(F.floor(F.floor(k / 7) / 2) * 7 + k % 7)
    return network.components(read(spark, sf, "part").select(k.alias("a"), b.cast("bigint").alias("b")), shared_folder(spark))


@query("handed_down_tags", """
WITH m AS (SELECT l_partkey AS ref, l_orderkey AS ord, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END AS natural_tag, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS name FROM lineitem),
d AS (SELECT ref, ord, max(natural_tag) AS natural_tag, max(name) AS name FROM m GROUP BY ref, ord),
f AS (SELECT ref, arg_min(natural_tag, ord) FILTER (natural_tag IS NOT NULL) AS n, arg_min(name, ord) FILTER (name IS NOT NULL) AS m FROM d GROUP BY ref)
SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 4 = 0 THEN p_type END, n) AS natural_tag, coalesce(CASE WHEN p_size % 5 = 0 THEN p_name END, m) AS name FROM part LEFT JOIN f ON ref = p_partkey""")
def handed_down_tags(spark, sf):
    li = read(spark, sf, "lineitem")
    m = li.select(F.col("l_partkey").alias("ref"), F.col("l_orderkey").alias("ord"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).alias("natural_tag"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("name"))
    m = m.groupBy("ref", "ord").agg(F.max("natural_tag").alias("natural_tag"), F.max("name").alias("name"))
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).alias("natural_tag"), F.when(F.col("p_size") % 5 == 0, F.col("p_name")).alias("name"))
    return network.handed_down(p, m, ["natural_tag", "name"])


@query("unconsumed_ways", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unconsumed_ways(spark, sf):
    m = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref"), F.when(F.col("l_returnflag") == "R", "outer").otherwise("inner").alias("role"))
    return network.unconsumed(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), m)


_RECTS = "(SELECT c_custkey AS id, c_nationkey % 4 AS level, c_custkey % 300 * 1.0 AS x0, c_custkey * 13 % 310 * 1.0 AS y0, c_custkey % 300 + 1 + c_custkey % 9 AS x1, c_custkey * 13 % 310 + 1 + c_custkey % 7 AS y1 FROM customer)"


@query("carve_targets", f"SELECT a.id AS coarse, b.id AS fine FROM {_RECTS} a JOIN {_RECTS} b ON a.level > b.level AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def carve_targets(spark, sf):
    k = F.col("c_custkey")
    r = read(spark, sf, "customer").select(k.alias("id"), (F.col("c_nationkey") % 4).alias("level"), (k % 300 * 1.0).alias("x0"), (k * 13 % 310 * 1.0).alias("y0"), (k % 300 + 1 + k % 9).alias("x1"), (k * 13 % 310 + 1 + k % 7).alias("y1"))
    return network.overlapping(r, 8.0)


@query("nearest_targets", """
WITH p AS (SELECT c_custkey AS id, (c_custkey % 997)::DOUBLE AS x, (c_custkey * 31 % 991)::DOUBLE AS y FROM customer), t AS (SELECT s_suppkey AS target, (s_suppkey * 10 % 997)::DOUBLE AS tx, (s_suppkey * 77 % 991)::DOUBLE AS ty FROM supplier),
d AS (SELECT id, target, (x - tx) * (x - tx) + (y - ty) * (y - ty) AS d2 FROM p, t)
SELECT id, arg_min(target, (d2, target)) AS target, min(d2) AS d2 FROM d WHERE d2 <= 2500 GROUP BY id""")
def nearest_targets(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = read(spark, sf, "customer").select(k.alias("id"), (k % 997 * 1.0).alias("x"), (k * 31 % 991 * 1.0).alias("y"))
    t = read(spark, sf, "supplier").select(s.alias("target"), (s * 10 % 997 * 1.0).alias("tx"), (s * 77 % 991 * 1.0).alias("ty"))
    return network.nearest(p, t, 50.0)


_TILES = "(SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 3 + CASE WHEN p_partkey // 3 = 0 THEN 1 ELSE 0 END END AS parent, p_size % 3 = 0 AS selected FROM part WHERE p_partkey > 0)"


@query("finest_covering", f"""
WITH RECURSIVE t AS (SELECT * FROM {_TILES}), up AS (SELECT id, id AS anc, 0 AS n FROM t UNION ALL SELECT u.id, t.parent, n + 1 FROM up u JOIN t ON u.anc = t.id WHERE t.parent IS NOT NULL),
leaf AS (SELECT id FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
near AS (SELECT up.id AS leaf, arg_min(anc, n) AS pick FROM up JOIN t ON t.id = anc AND t.selected WHERE up.id IN (SELECT id FROM leaf) GROUP BY up.id)
SELECT DISTINCT pick AS id FROM near""")
def finest_covering(spark, sf):
    k = F.col("p_partkey")
    third = F.floor(k / 3)
    t = read(spark, sf, "part").where("p_partkey > 0").select(k.alias("id"), F.when(k > 1, F.greatest(third, F.lit(1))).alias("parent"), (F.col("p_size") % 3 == 0).alias("selected"))
    return network.finest_covering(t, shared_folder(spark))
