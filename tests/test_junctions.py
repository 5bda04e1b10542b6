"""Junction rings, clusters and gaps against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import clusters, gaps, network, rasters


def classes(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def found_classes(n, links):
    return classes(n, [tuple(r) for r in links.collect()])


@pytest.mark.parametrize("few", [2, 64])
def test_overlaps_give_the_classes_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(clusters, "FEW", few)
    rng = np.random.default_rng(4)
    lo = np.concatenate([rng.uniform(-100, 100, (60, 2)), rng.uniform(0, 3, (40, 2)), np.repeat([[500.0, 500.0]], 30, 0), [[64, 64], [66, 64], [70, 0], [68, 2]]])
    size = np.concatenate([rng.uniform(0, 30, (60, 2)), rng.uniform(0.5, 1, (40, 2)), np.repeat([[2.0, 2.0]], 30, 0), [[2, 2], [2, 2], [2, 2], [2, 2]]])
    boxes = [(i, *map(float, (*a, *(a + s)))) for i, (a, s) in enumerate(zip(lo, size))]
    pairs = [(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]]
    got = clusters.overlaps(spark.createDataFrame(boxes, "id int, x0 double, y0 double, x1 double, y1 double"), 16.0)
    assert found_classes(len(boxes), got) == classes(len(boxes), pairs)
    assert set(map(tuple, got.collect())) <= {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}


@pytest.mark.parametrize("few", [1, 64])
def test_points_within_a_reach(spark, monkeypatch, few):
    monkeypatch.setattr(clusters, "FEW", few)
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.uniform(-150, 150, (120, 2)), rng.uniform(0, 4, (60, 2)) + [400, 0], rng.uniform(0, 4, (60, 2)) + [418.5, 0], np.repeat([[0.0, 300.0]], 20, 0), [[0, 315.0], [15.0, 315.0001], [-9, 312]]])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    got = clusters.within(spark.createDataFrame(rows, "id int, x double, y double"), 15.0)
    assert found_classes(len(p), got) == classes(len(p), [(a, b) for a, b in zip(*np.where(d2 <= 225)) if a < b])
    assert all(d2[a, b] <= 225 for a, b in map(tuple, got.collect()))


def test_a_full_square_makes_no_pairs(spark):
    """20,000 boxes and centres of one place: a star, not 2e8 pairs."""
    many = spark.range(20_000).select("id", (F.col("id") % 100 * 1e-3).alias("x"), (F.floor(F.col("id") / 100) * 1e-3).alias("y"))
    assert clusters.within(many).count() == 19_999
    boxes = many.select("id", (F.col("x") - 1).alias("x0"), (F.col("y") - 1).alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))
    links = clusters.overlaps(boxes)
    assert links.count() < 40 * 20_000 and network.components(links).select("label").distinct().count() == 1


def ring(cx, cy, r, z=0.0, lift=0.0):
    return [tuple(map(float, p)) for p in ((cx - r, cy - r, z), (cx + r, cy - r, z + lift), (cx + r, cy + r, z), (cx - r, cy + r, z))]


def test_clusters_merge_what_is_close_and_level(spark):
    rows = [(1, ring(0, 0, 2)), (2, ring(10, 0, 2, 0.5)), (3, ring(60, 0, 20)), (4, ring(90, 0, 11)), (5, ring(300, 0, 3)), (6, ring(306, 0, 3, 5.0)), (7, ring(500, 0, 2, 0.0, 30.0)), (8, [(0.0, 900.0, 0.0), (1.0, 900.0, 0.0)]), (9, None)]
    got = {r["cluster"]: r for r in clusters.clustered(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double,z:double>>")).collect()}
    assert {c: r["members"] for c, r in got.items()} == {1: 2, 3: 2, 5: 1, 6: 1, 7: 1}
    assert [(p["x"], p["y"]) for p in got[1]["ring"]] == [(-2, -2), (12, -2), (12, 2), (-2, 2)]
    assert [p["z"] for p in got[7]["ring"]] == [0, 30, 0, 0]
    assert clusters.clustered(spark.createDataFrame([], "id int, ring array<struct<x:double,y:double,z:double>>")).count() == 0


def test_hulls_of_parts_are_hulls_of_all(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PART", 50)
    rng = np.random.default_rng(6)
    p = np.round(rng.normal(size=(1500, 2)) * 20)
    rows = [("a" if i % 3 else "b", float(x), float(y), float(i % 7)) for i, (x, y) in enumerate(p)]
    got = {r["k"]: [tuple(q) for q in r["ring"]] for r in clusters.hull_rings(spark.createDataFrame(rows, "k string, x double, y double, z double"), "k").collect()}
    for k in "ab":
        assert got[k] == [tuple(q) for q in clusters._chain(np.array([r[1:] for r in rows if r[0] == k])).tolist()]
        x, y, _ = np.array(got[k]).T
        turn = np.roll(x, -1) - x, np.roll(y, -1) - y
        assert (turn[0] * np.roll(turn[1], -1) - turn[1] * np.roll(turn[0], -1) > 0).all()


def test_rings_join_corners_that_are_one(spark):
    """Two roads of like width that go on straight share no corner; a square crossing's four arms at their half width do."""
    arms = [(1, i, "start", 2.0 * math.cos(i * math.pi / 2), 2.0 * math.sin(i * math.pi / 2), float(i), math.cos(i * math.pi / 2), math.sin(i * math.pi / 2), 2.0) for i in range(4)]
    arms += [(2, 10, "end", 1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (2, 11, "end", -1.0, 0.0, 0.0, -1.0, 0.0, 1.0), (3, 12, "end", 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (3, 13, "end", None, 0.0, 0.0, 1.0, 0.0, 1.0), (3, 14, "end", 0.0, 0.0, 0.0, 1.0, 0.0, 1.0)]
    got = clusters.rings_of_arms(spark.createDataFrame(arms, "node int, seg int, end string, x double, y double, z double, dx double, dy double, half double")).collect()
    assert [r["node"] for r in got] == [1] and len(got[0]["ring"]) == 4
    assert sorted((round(p["x"]), round(p["y"])) for p in got[0]["ring"]) == [(-2, -2), (-2, 2), (2, -2), (2, 2)]
    assert math.isclose(got[0]["cz"], sum(p["z"] for p in got[0]["ring"]) / 4)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_patches_are_the_flooded_ones(spark, monkeypatch, block):
    monkeypatch.setattr(gaps, "BLOCK", block)
    monkeypatch.setattr(network, "FEW_LINKS", 5)
    rng = np.random.default_rng(7)
    mask = rng.random((24, 31)) < 0.6
    rows = [(int(x) - 9, int(y) - 5) for y, x in np.argwhere(mask)]
    got = gaps.patches(spark.createDataFrame(rows * 2, "px int, py int")).collect()
    want = rasters.flood_components(mask)
    by: dict = {}
    cells = 0
    for r in got:
        for x in range(r["x0"], r["x1"] + 1):
            by.setdefault(r["patch"], set()).add(int(want[r["py"] + 5, x + 9]))
            cells += 1
    assert cells == mask.sum() and len(by) == want.max() and all(len(v) == 1 and 0 not in v for v in by.values())
    first = {int(want[y, x]): (y - 5) * 2**32 + x - 9 + 2**31 for y, x in reversed(np.argwhere(mask).tolist())}
    assert {next(iter(v)): k for k, v in by.items()} == first


def test_cells_of_round_and_flat_ends(spark):
    rng = np.random.default_rng(8)
    segs = [(float(rng.uniform(0.3, 4)), *map(float, rng.uniform(-20, 20, 4)), bool(rng.random() < 0.5), bool(rng.random() < 0.5)) for _ in range(15)] + [(2.0, 5.0, 5.0, 5.0, 5.0, True, True), (2.0, 0.0, -30.0, 10.0, -30.0, False, False)]
    got = {tuple(r) for r in gaps.covered_cells(spark.createDataFrame(segs, "half double, ax double, ay double, bx double, by double, round_a boolean, round_b boolean")).collect()}
    want = set()
    for half, ax, ay, bx, by, ra, rb in segs:
        for px in range(-40, 40):
            for py in range(-40, 40):
                x, y, dx, dy = px + 0.5, py + 0.5, bx - ax, by - ay
                size, along = dx * dx + dy * dy, (px + 0.5 - ax) * dx + (py + 0.5 - ay) * dy
                t = max(0.0, min(1.0, along / size)) if size else 0.0
                if (ra or along >= 0) and (rb or along <= size) and (x - ax - dx * t) ** 2 + (y - ay - dy * t) ** 2 <= half * half:
                    want.add((px, py))
    assert got == want


def test_a_gap_needs_two_level_roads(spark):
    """Two roads that end 4 m apart leave a gap; one that ends alone, or two on unlike heights, don't."""
    seg = "half double, ax double, ay double, bx double, by double, round_a boolean, round_b boolean"
    ends, nodes, ref, cov = [], [], [], []
    for k, (two, lift) in enumerate([(True, 0.0), (False, 0.0), (True, 3.0)]):
        y = 100.0 * k
        ref += [(3.0, -20.0, y, 0.0, y, True, True)] + [(3.0, 0.0, y, 20.0, y, True, True)] * two
        cov += [(3.0, -20.0, y, -2.0, y, False, False)] + [(3.0, 2.0, y, 20.0, y, False, False)] * two
        ends += [(10 * k, 0.0, y, 1.0)] + [(10 * k + 1, 0.0, y, 1.0 + lift)] * two
        nodes += [(10 * k, -2.0, y, 1.0), (10 * k + 1, 2.0, y, 1.5)]
    cells = [gaps.covered_cells(spark.createDataFrame(x, seg)) for x in (ref, cov)]
    got = gaps.gap_junctions(*cells, spark.createDataFrame(ends, "seg int, x double, y double, z double"), spark.createDataFrame(nodes, "target int, x double, y double, z double"), 1.0, 3.0).collect()
    assert len(got) == 1 and abs(got[0]["cx"]) < 1e-9 and abs(got[0]["cy"]) < 1e-9 and got[0]["cells"] == 24
    assert {p["z"] for p in got[0]["ring"]} == {1.0, 1.5} and max(p["x"] for p in got[0]["ring"]) > 1.5
    none = cells[0].limit(0)
    assert gaps.gap_junctions(none, none, spark.createDataFrame([], "seg int, x double, y double, z double"), spark.createDataFrame([], "target int, x double, y double, z double"), 1.0, 3.0).count() == 0


def test_what_lies_on_the_ground(spark):
    """A road east to west through the middle of 200 m by 200 m at a metre a cell, as in the mask's own numbers; bridges, tunnels and layers don't count, nor
    do footways; a parking place is filled but for its hole."""
    from geoloom.operators import junctions

    road = [{"x": 0.0, "y": 100.0}, {"x": 200.0, "y": 100.0}]
    square = [{"x": x, "y": y} for x, y in ((80.0, 80.0), (120.0, 80.0), (120.0, 120.0), (80.0, 120.0))]
    hole = [[{"x": x, "y": y} for x, y in ((95.0, 95.0), (105.0, 95.0), (105.0, 105.0), (95.0, 105.0))]]
    schema = "type string, tags map<string,string>, geometry array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"

    def mask(*features):
        return {(r["cx"], r["cz"]): r["w"] for r in junctions.ground_cover(spark.createDataFrame(list(features), schema), 200, 1.0, 3.0).collect()}

    home = mask(("road", {"highway": "residential"}, road, None))
    assert home[100, 100] > 0.95 and home.get((100, 110), 0) < 0.05 and mask(("road", {"highway": "motorway"}, road, None))[100, 110] > 0.9
    for tags in ({"bridge": "yes"}, {"tunnel": "culvert"}, {"layer": "1"}, {"layer": "x"}, {"highway": "footway"}):
        assert mask(("road", {"highway": "residential"} | tags, road, None)) == {}
    assert mask(("road", {"highway": "residential", "bridge": "no", "layer": " 0 "}, road, None)) == home
    assert mask(("landuse", {"highway": "residential"}, road, None)) == {} and mask(("road", {}, None, None)) == {}
    park = mask(("landuse", {"amenity": "parking"}, square, hole))
    assert park[85, 100] == 1 and (100, 100) not in park and mask(("landuse", {"amenity": "parking", "building": "yes"}, square, None)) == {}
