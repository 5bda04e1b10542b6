"""Queries that a larger table or another deal of its rows broke."""

import random
from math import ceil, cos, floor, hypot, pi, sin

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalars
from geoloom.operators import batch, clusters, fields, gaps, geometry, junctions, mesh, network, polylines, projected, routes, shapes, shared
from geoloom.plans import geometry_queries, registry
from geoloom.sources import records, text_grids


def test_remaining_time_adds_in_order(spark, tmp_path):
    draw, jobs = random.Random(3), {}

    def left(ms):
        total = 0.0
        for x in ms:
            total += x
        return floor(total / len(ms) * 3 + 0.5)

    while len(jobs) < 8:
        ms = [draw.randrange(10**5, 4 * 10**7) / 100 for _ in range(6)]
        if left(ms) != left(ms[::-1]):
            jobs[len(jobs)] = ms
    rows = [(j, n, "done", x) for j, ms in jobs.items() for n, x in enumerate(ms)] + [(j, n, "queued", 1.0) for j in jobs for n in (6, 7, 8)]
    for dealt in (spark.createDataFrame(rows[::-1], "job int, seq int, status string, ms double").coalesce(1), spark.createDataFrame(rows, "job int, seq int, status string, ms double").repartition(5)):
        assert {r["job"]: r["left_ms"] for r in batch.remaining_ms(dealt).collect()} == {j: left(ms) for j, ms in jobs.items()}
    # a missing status is neither finished nor left, as in the SQL
    orders = spark.createDataFrame([(1, 1, "F", 2.5), (2, 1, "O", 9.0), (3, 1, None, 9.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["left_ms"] for r in registry.queries()["remaining_time"](spark, str(tmp_path)).collect()] == [3]


def test_remaining_time_adds_rows_as_they_lie(spark, tmp_path):
    draw = random.Random(4)
    halves = [(j, draw.randrange(10**5, 4 * 10**7) / 100) for j in range(4000) for _ in range(6)]
    # the keys run against the rows, and the second file begins within jobs
    rows = [(len(halves) - i, j, "F", ms) for i, (j, ms) in enumerate(halves)] + [(-1, j, "O", 1.0) for j in range(4000) for _ in range(3)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    for name, part in (("a", rows[1::2]), ("b", rows[::2])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / "orders.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "orders.parquet" / f"{name}.parquet")
    duck = duckdb.connect()
    duck.execute(f"SET threads = 1; CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = dict(duck.execute(registry.oracle_sql()["remaining_time"]).fetchall())
    got = {r["job"]: r["left_ms"] for r in registry.queries()["remaining_time"](spark, str(tmp_path)).collect()}
    assert {j: (want[j], got.get(j)) for j in want if want[j] != got.get(j)} == {}


def test_area_masks_by_bands(spark, monkeypatch):
    draw = random.Random(5)
    point = lambda x, y: {"x": x, "y": y}
    star = lambda x, y, r, n: [point(x + r * draw.uniform(0.2, 1) * cos(2 * pi * k / n), y + r * draw.uniform(0.2, 1) * sin(2 * pi * k / n)) for k in range(n)]
    rows = [(i, star(draw.uniform(-5, 45), draw.uniform(-5, 45), draw.uniform(2, 30), draw.randrange(3, 40)), [star(20, 20, 9, 7), [point(1.0, 1.0)]] if i % 2 else []) for i in range(12)]
    schema = "id int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"
    areas = spark.createDataFrame(rows, schema)
    cells = spark.range(40).select(F.col("id").alias("cx")).crossJoin(spark.range(40).select(F.col("id").alias("cz")))
    x, y = F.col("cx") + 0.5, F.col("cz") + 0.5
    met = areas.crossJoin(cells).select("cx", "cz", geometry.point_in_ring(x, y, F.col("ring")).alias("inside"), geometry.ring_distance(x, y, F.col("ring")).alias("gap"), F.exists("holes", lambda h: (F.size(h) >= 3) & geometry.point_in_ring(x, y, h)).alias("hole"))
    wanted = {}
    for r in met.collect():
        t = (4.0 - r["gap"]) / 4.0
        w = None if r["inside"] and r["hole"] else 1.0 if r["inside"] else t * t * (3 - 2 * t) if t > 0 else None
        if w is not None:
            wanted[r["cx"], r["cz"]] = max(w, wanted.get((r["cx"], r["cz"]), 0.0))
    got = lambda a: {(r["cx"], r["cz"]): r["w"] for r in fields.area_mask(a, 40, 4.0).collect()}
    for band, pairs, gathered in ((64, 1 << 20, 1 << 20), (7, 900, 50)):
        for name, value in (("BAND", band), ("PAIRS", pairs), ("GATHERED", gathered)):
            monkeypatch.setattr(fields, name, value)
        assert {k: round(v, 9) for k, v in got(areas).items()} == {k: round(v, 9) for k, v in wanted.items()}
    # areas without a list of holes, or with a missing hole, are whole
    square = [point(1.0, 1.0), point(4.0, 1.0), point(4.0, 4.0), point(1.0, 4.0)]
    assert got(spark.createDataFrame([(1, square, None), (2, square, [None])], schema))[2, 2] == 1.0
    assert got(areas.limit(0)) == {}


def test_ground_masks_of_one_split_are_dealt(spark):
    roads = spark.createDataFrame([(1.0, 2.0, 3.0, 30.0, 17.0), (2.0, 9.0, 9.0, 9.0, 9.0)], "half double, ax double, az double, bx double, bz double").coalesce(1)
    mask = junctions.ground_mask(roads, 32, 3.0)
    assert "RoundRobinPartitioning(16)" in mask._jdf.queryExecution().executedPlan().toString()
    got = {(r["cx"], r["cz"]): r["w"] for r in mask.collect()}
    for i in range(32):
        for j in range(32):
            edges = []
            for half, ax, az, bx, bz in ((1.0, 2.0, 3.0, 30.0, 17.0), (2.0, 9.0, 9.0, 9.0, 9.0)):
                size = (bx - ax) ** 2 + (bz - az) ** 2
                t = min(1.0, max(0.0, ((i + 0.5 - ax) * (bx - ax) + (j + 0.5 - az) * (bz - az)) / size)) if size else 0.0
                edges.append(hypot(i + 0.5 - ax - t * (bx - ax), j + 0.5 - az - t * (bz - az)) - half)
            u = min(1.0, (3.0 - min(edges)) / 3.0)
            assert ((i, j) in got) == (u > 0) and (u <= 0 or abs(got[i, j] - u * u * (3 - 2 * u)) < 1e-9)


def test_places_ask_tiles_by_rounds(spark, monkeypatch):
    """Tiles over one another, most of them full of holes: a later round finds what an earlier one left."""
    draw = random.Random(7)
    tiles = [(t, 30 - t, None, 10.0, 50.0, 0.01, -0.01, 6, 6) for t in range(30)]
    cells = [(t, y, x, float(t) if draw.random() < (0.6 if t else 0.9) else None) for t in range(30) for y in range(6) for x in range(6)]
    places = [(i, 50.0 - draw.uniform(-0.01, 0.06), 10.0 + draw.uniform(-0.01, 0.06)) for i in range(150)] + [(500, 12.0, 13.0)]
    known = {(t, y, x): h for t, y, x, h in cells}
    frames_of = lambda rows, schema: spark.createDataFrame(rows, schema)
    monkeypatch.setattr(projected, "TILES", 2)
    df = projected.sampled_across(frames_of(places, "id int, lat double, lng double"), frames_of(tiles, "tile int, ord int, code int, origin_x double, origin_y double, step_x double, step_y double, width int, height int"), frames_of(cells, "tile int, y int, x int, h double"))
    got = {r["id"]: r["tile"] for r in df.collect()}
    for i, lat, lng in places:
        px, py = (lng - 10.0) / 0.01, (lat - 50.0) / -0.01
        inside = 0 <= px < 5 and 0 <= py < 5
        whole = [t for t in range(29, -1, -1) if inside and all(known[t, int(py) + a, int(px) + b] is not None for a in (0, 1) for b in (0, 1))]
        assert got[i] == (whole[0] if whole else None)
    assert len(got) == 151 and len(set(got.values())) > 5


def test_polylines_of_odd_ends(spark):
    known = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    texts = [(1, known), (2, None), (3, ""), (4, "_p~iF"), (5, known + "_"), (6, known[:10] + "_ulL")]
    got = {r["id"]: [(p["lat"], p["lng"]) for p in r["p"]] for r in spark.createDataFrame(texts, "id int, text string").coalesce(1).select("id", records.decode_polyline(F.col("text")).alias("p")).collect()}
    line = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert got == {1: line, 2: [], 3: [], 4: [], 5: line, 6: line[:1]}
    numbers = spark.createDataFrame([(0,), (1,), (-1,), (15,), (16,), (-17998321,), (36000000,)], "n int")
    pairs = numbers.select("n", records.decode_polyline(F.concat(records.encoded_number(F.col("n")), F.lit("?")))[0]["lat"].alias("back"))
    assert all(round(r["back"] * 1e5) == r["n"] for r in pairs.collect())


def test_dense_targets_are_met_by_near_points_only(spark, monkeypatch):
    draw, reaches, step = random.Random(9), [], network._nearest
    monkeypatch.setattr(network, "_nearest", lambda p, t, reach: reaches.append(reach) or step(p, t, reach))
    targets = [(i, float(draw.randrange(60)), float(draw.randrange(60))) for i in range(900)]
    points = [(i, draw.uniform(-20, 70), draw.uniform(-20, 70)) for i in range(200)] + [(900, 500.0, 0.0)]
    got = network.nearest(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(targets, "target int, tx double, ty double"), 15.0).collect()
    wanted = {}
    for i, x, y in points:
        d2, t = min(((x - a) * (x - a) + (y - b) * (y - b), t) for t, a, b in targets)
        if d2 <= 225.0:
            wanted[i] = (t, d2)
    assert {r["id"]: (r["target"], r["d2"]) for r in got} == wanted and len(got) == len(wanted) < 201
    assert reaches[0] < 3 and reaches[-1] == 15.0


def test_chains_and_rings_pass_no_table_through_the_driver(spark):
    """A ring of 17, one of 3 and chains: rounds by the logarithm of the longest, all joins by shuffle."""
    ring = lambda ids: list(zip(ids, ids[1:] + ids[:1]))
    links = [*ring(list(range(17))), *ring([20, 21, 22]), *[(k, k + 1) for k in range(30, 43)], (100, 101)]
    rows = [(way, 0, str(b if way % 3 == 0 else a), str(a if way % 3 == 0 else b), 1) for way, (a, b) in enumerate(links)]
    many = [(1000 + k, 0, f"{k}a", f"{k}b", 1) for k in range(3000)]
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.table(df)

    out = network.merged_segments(spark.createDataFrame(rows + many, "way int, piece int, start string, end string, style int"), write)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans) and len(plans) < 20
    got = {r["way"]: (r["chain_way"], r["pos"], r["reversed"]) for r in out.collect()}
    assert len(got) == len(rows) + len(many) and all(got[1000 + k] == (1000 + k, 0, False) for k in range(3000))
    chains = {}
    for way, (chain, pos, _) in got.items():
        chains.setdefault(chain, {})[pos] = way
    whole = [[w for _, w in sorted(c.items())] for k, c in sorted(chains.items()) if k < 1000]
    # a first link that is drawn the other way round turns its chain
    assert whole == [[0, *range(16, 0, -1)], [17, 18, 19], list(range(20, 33)), [33]]
    assert [got[w][2] for w in (0, 16, 15, 17, 18)] == [False, True, False, False, True]


def test_stations_are_counted_before_they_are_made(spark):
    draw = random.Random(11)
    points = [(r, i, draw.uniform(-600, 600), draw.uniform(-600, 600)) for r in range(6) for i in range(1 + 4 * r)]
    got = routes.corridor_stations(spark.createDataFrame(points, "route int, idx int, e double, north double"), 300.0, 40.0, 960.0, 25)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the uppermost step that makes rows stands over all sorts: places are neither sorted nor shuffled
    assert plan.index("Generate explode") < plan.index("Sort [") and plan.index("Generate explode") < plan.index("Window")
    rows, wanted = got.collect(), []
    for r in range(6):
        line, arc, places = [p[2:] for p in points if p[0] == r], 0.0, []
        for (ax, ay), (bx, by) in zip(line, line[1:]):
            size = hypot(bx - ax, by - ay)
            for s in range(max(0, ceil((arc - 20) / 40)), ceil((arc + size - 20) / 40)):
                u = (s * 40 + 20 - arc) / size
                for side in (0, 1, -1, 2, -2):
                    x, y = ax + (bx - ax) * u - (by - ay) / size * side * 127.5, ay + (by - ay) * u + (bx - ax) / size * side * 127.5
                    places += [(r, s, side, round(x, 6), round(y, 6))] if abs(x) <= 480 and abs(y) <= 480 else []
            arc += size
        stride = max(1.0, len(places) / 25)
        wanted += [places[n] for n in sorted({floor(t * stride + 1e-9) for t in range(25)}) if n < len(places)]
    assert sorted((p["route"], p["sample"], p["side"], round(p["e"], 6), round(p["north"], 6)) for p in rows) == sorted(wanted) and len(wanted) > 60


def test_plain_rounding(spark):
    draw = random.Random(13)
    values = [draw.uniform(-1e4, 1e4) for _ in range(500)] + [k / 128 for k in range(-300, 300)] + [0.0, -0.0, None, float("nan"), float("inf"), -float("inf"), 1e300, 1e17 + 2, 5e-324]
    for digits in (0, 5, 6):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", digits).alias("a"), scalars.rounded(F.col("v"), digits).alias("b")).collect()
        assert [r for r in rows if repr(r["a"]) != repr(r["b"])] == []


def test_ways_are_split_in_parts(spark):
    draw = random.Random(17)
    ways_ = {w: [f"n{draw.randrange(60)}" for _ in range(draw.randrange(1, 9))] for w in range(40)}
    df = spark.createDataFrame([(w, i * 3, n) for w, line in ways_.items() for i, n in enumerate(line)], "way int, idx int, node string")
    touched = {}
    for w, line in ways_.items():
        for n in line:
            touched.setdefault(n, set()).add(w)
    wanted = []
    for w, line in ways_.items():
        piece = pos = 0
        for i, n in enumerate(line):
            wanted.append((w, piece, pos, i * 3, n))
            pos += 1
            if 0 < i < len(line) - 1 and len(touched[n]) > 1:
                piece, pos = piece + 1, 1
                wanted.append((w, piece, 0, i * 3, n))
    for parts in (None, 7):
        pieces = network.split_ways(df, parts)
        plan = pieces._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and plan.count("Sort [") == 2 and (not parts or plan.count(", 7)") == 2)
        assert sorted((r["way"], r["piece"], r["pos"], r["idx"], r["node"]) for r in pieces.collect()) == sorted(wanted)
        segs = network.segments(pieces).withColumn("style", F.col("way") % 2)
        for step in (network.intersections, network.chain_nodes):
            assert not parts or ", 7)" in step(segs, parts)._jdf.queryExecution().executedPlan().toString().partition("Generate")[0]
        ends = {}
        for s in segs.collect():
            for n in (s["start"], s["end"]):
                ends.setdefault(n, []).append((s["way"], s["piece"]))
        assert {(r["node"], r["entries"], r["ways"]) for r in network.intersections(segs, parts).collect()} == {(n, len(e), len({w for w, _ in e})) for n, e in ends.items() if len(e) > 1}
        assert {r["node"] for r in network.chain_nodes(segs, parts).collect()} == {n for n, e in ends.items() if len(e) == 2 == len(set(e)) and len({w % 2 for w, _ in e}) == 1}
    assert "REPARTITION_BY_NUM" in shared.dealt(df, 5, "way")._jdf.queryExecution().executedPlan().toString() and shared.dealt(df, None, "way") is df


def test_parts_follow_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 10)
    assert shared.parts_of(spark.range(1000)) == 100 and shared.parts_of(spark.range(30)) is None
    plan = registry.queries()["corner_cutting"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert ", 600)" in plan or ", 60" in plan


def test_headers_are_dealt_and_read_once(spark):
    plan = registry.queries()["asc_headers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(16)" in plan and "Join" not in plan
    # remarks and empty lines by the ten thousand, blanks before keys, other line ends, a key within a line
    head = "\n" * 40000 + " \t ncols 2\r\n\r\n// xllcorner 9\n# nrows 7\n  NROWS\t1\nxllcorner 190\n a yllcorner 5\n\n\nyllcenter 3\ncellsize 2\n" + "# remark\n" * 20000 + "\n1 -9999\n"
    got = text_grids.asc_meta(spark.createDataFrame([(1, head), (2, None)], "id int, text string"), F.length("text").alias("size")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, -170.0, 4.0, 2.0, -9999.0, [5.0, 1.0, -9999.0], len(head)), (2, None, None, None, None, None, -9999.0, None, None)]
    assert [r["likely"] for r in spark.createDataFrame([("\n \n ncols 1\nnrows 2\n xllcenter 0\nyllcorner 1\ncellsize 1\n",), ("a ncols 1",)], "text string").select(text_grids.likely_asc(F.col("text")).alias("likely")).collect()] == [True, False]


def test_stripped_triangles_meet_their_vertices_once(spark):
    v = spark.createDataFrame([(1, i, x, y, z) for i, (x, y, z) in enumerate([(0.0, 0.5, 0.0), (1.0, 0.5, 0.0), (0.0, 0.5, 1.0), (0.0, 9.0, 0.0), (1.0, 9.0, 0.0), (0.0, 9.0, 1.0), (0.0, 3.0, 0.0)])], "mesh int, vi int, x double, y double, z double")
    t = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 3, 4, 5), (1, 2, 0, 1, 6), (1, 3, 0, 1, 99), (1, 4, 0, 0, 0)], "mesh int, ti int, i0 int, i1 int, i2 int")
    terrain = spark.createDataFrame([(0, 0, 0.25), (7, 7, 1.0)], "cx long, cz long, h double")
    for whole, left in ((False, [1, 2, 3, 4]), (True, [1, 2, 4])):
        kept = mesh.strip_ground(t, v, terrain, 5.0, whole=whole)
        # flat and low: 0; one that lacks a vertex: 3; high, upright and without area stay
        assert sorted(r["ti"] for r in kept.collect()) == left and kept.columns == t.columns
    plan = registry.queries()["stripped_triangles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 6 and plan.count("broadcast") == 3  # three corners, each with its terrain, which is sent


def plain_hull(p):
    """Andrew's chains over the points of one line, one after another."""
    p = p[np.lexsort((-p[:, 2], p[:, 1], p[:, 0]))]
    p = p[np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(axis=1)])]
    halves = []
    for points in (p, p[::-1]):
        half = []
        for q in points:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (q[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (q[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(q)
        halves += half[:-1]
    return np.array(halves) if len(p) > 2 else p


@pytest.mark.parametrize("side_by_side", [2, 8, 64])
def test_hulls_of_many_lines_at_once(monkeypatch, side_by_side):
    monkeypatch.setattr(polylines, "SIDE_BY_SIDE", side_by_side)
    rng = np.random.default_rng(12)
    lines = [np.column_stack([rng.integers(0, most, (k, 2)), rng.integers(0, 5, k)]).astype(float) for k in (1, 2, 3, 4, 5, 9, 33, 64, 65, 200, 1) for most in (1, 2, 4, 30, 1000)]
    lines += [np.column_stack([np.arange(7.0), np.arange(7.0), np.zeros(7)]), rng.normal(size=(50, 3))]
    p, n = np.concatenate(lines), np.array([len(line) for line in lines])
    at, counts = polylines.hulls(p[:, 0], p[:, 1], n, p[:, 2])
    for got, line in zip(np.split(p[at], np.cumsum(counts)[:-1]), lines):
        assert got.tolist() == plain_hull(line).tolist()


def test_hulls_take_no_call_a_key(spark, monkeypatch, capsys):
    """The points of thousands of keys travel in batches, not in calls a key; a key that goes on in the next batch stays whole."""
    monkeypatch.setattr(clusters, "PART", 9_000)
    k = F.col("id")
    points = spark.range(60_000).select((F.when(k < 30_000, k % 6_000).otherwise(-1 - k % 2)).alias("k"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"), (k % 7).cast("double").alias("z"))
    found = clusters.hull_rings(points, "k")
    found.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    got = {r["k"]: [tuple(q) for q in r["ring"]] for r in found.collect()}
    rows = points.toPandas()
    want = {key: [tuple(q) for q in plain_hull(g[["x", "y", "z"]].to_numpy()).tolist()] for key, g in rows.groupby("k")}
    assert got == want


def test_sides_of_many_rows_are_not_sent(spark, monkeypatch, capsys):
    """Written tables of many rows are joined by shuffle, however small their files."""
    monkeypatch.setattr(shared, "PART_ROWS", 50)
    rng = random.Random(4)
    cells = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(1500)], "px int, py int")
    points = spark.createDataFrame([(i, rng.random() * 900, rng.random() * 900) for i in range(800)], "id int, x double, y double")
    links = clusters.within(points)
    targets = points.select(F.col("id").alias("target"), F.col("y").alias("tx"), F.col("x").alias("ty"))
    for found in (gaps.patches(cells), links, network.components(links), network.spread_labels(points.select(F.col("id").alias("node")), links), network.nearest(points, targets, 500.0)):
        capsys.readouterr()
        found.explain()
        plan = capsys.readouterr().out
        assert "Join" in plan and "Broadcast" not in plan
    assert network.nearest(points, targets, 2000.0).count() == 800


def test_corridor_meets_segments_by_the_squares_near_them(spark, capsys):
    rng = np.random.default_rng(5)
    segs = [*map(tuple, rng.uniform(-40, 40, (30, 4)).round(2).tolist()), (3.0, 3.0, 3.0, 3.0), (-20.0, 7.0, 20.0, 7.0), (7.0, 20.0, 7.0, -20.0), (0.0, 0.0, 4.5, 4.5), (None, 1.0, 2.0, 3.0)]
    route = spark.createDataFrame(segs, "ax double, az double, bx double, bz double")
    p = rng.uniform(-45, 45, (9000, 2)).round(2)
    vertices = spark.createDataFrame([(i // 3000, i, float(x), 0.0, float(z)) for i, (x, z) in enumerate((p + rng.uniform(-1, 1, p.shape)).tolist())], "mesh int, vi int, x double, y double, z double")
    triangles = spark.createDataFrame([(i // 3000, i, i, i + 1, i + 2) for i in range(0, 9000, 3)], "mesh int, ti int, i0 int, i1 int, i2 int")
    at = {(r["mesh"], r["vi"]): (r["x"], r["z"]) for r in vertices.collect()}
    for half in (0.45, 3.0):
        want = set()
        for i in range(0, 9000, 3):
            px, pz = ((at[i // 3000, i][k] + at[i // 3000, i + 1][k] + at[i // 3000, i + 2][k]) / 3 for k in (0, 1))
            for ax, az, bx, bz in segs[:-1]:
                dx, dz = bx - ax, bz - az
                t = max(0.0, min(1.0, ((px - ax) * dx + (pz - az) * dz) / (dx * dx + dz * dz))) if dx or dz else 0.0
                if (px - ax - dx * t) ** 2 + (pz - az - dz * t) ** 2 <= half * half:
                    want.add((i // 3000, i))
        found = mesh.in_corridor(triangles, vertices, route, half)
        capsys.readouterr()
        found.explain()
        plan = capsys.readouterr().out
        # no triangle is kept once a segment and made one again
        assert "LeftSemi" in plan and "Aggregate" not in plan and found.columns == triangles.columns
        got = [(r["mesh"], r["ti"]) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
    # of a long way across the squares near it, not those of the box around it
    long = spark.createDataFrame([(0.0, 0.0, 900.0, 900.0)], "_ax double, _az double, _bx double, _bz double")
    assert mesh.near_squares(long, 1.0).count() < 10 * 900


def test_many_tree_rows_take_little_disk(spark, monkeypatch, tmp_path):
    draw, rows = random.Random(6), []
    for line in range(40_000):  # stretches of one of five numbers of steps between whole places
        x, y, n = draw.randrange(300), draw.randrange(300), (61, 67, 71, 73, 79)[line % 5]
        dx = draw.randrange(8 * n)
        rows += [(line, 0, float(x), float(y)), (line, 1, float(x + dx), float(y + ceil(((8 * n) ** 2 - dx**2) ** 0.5)))]
    points = spark.createDataFrame(rows, "line long, idx int, x double, y double").coalesce(1)
    points.write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    monkeypatch.setattr(geometry_queries, "lines", lambda spark, sf: points)
    monkeypatch.setattr(geometry_queries, "read", lambda spark, sf, name: points)
    written = {}
    for name, stretches in (("whole", 1 << 40), ("dealt", 16_000)):
        monkeypatch.setattr(shapes, "STRETCHES", stretches, raising=False)
        registry.queries()["tree_rows"](spark, "").write.parquet(f"{tmp_path}/{name}")
        written[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    whole, dealt = (spark.read.parquet(f"{tmp_path}/{name}") for name in written)
    assert dealt.count() == whole.count() > 1_000_000
    assert not dealt.exceptAll(whole).limit(1).count() and not whole.exceptAll(dealt).limit(1).count()
    assert written["dealt"] < 0.75 * written["whole"], written
