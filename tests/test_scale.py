"""Operators whose plans split what one task would hold, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import frames, tags
from geoloom.operators import batch, fields, geometry, grid, junctions, network
from geoloom.plans.network_queries import shared_folder


def test_blocked_windows(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 4)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2, 13, 11))
    a[rng.random(a.shape) < 0.2] = np.nan
    rows = [(r, y, x, None if np.isnan(v) else float(v)) for (r, y, x), v in np.ndenumerate(a)]
    cells = spark.createDataFrame(rows, "raster int, y int, x int, h double")
    mean = {(r["raster"], r["y"], r["x"]): r["h"] for r in grid.mean_3x3(cells, ["raster"]).collect()}
    blur = {(r["raster"], r["y"], r["x"]): r["h"] for r in grid.blur_axis(cells, "y", 5, ["raster"]).collect()}
    for (r, y, x), v in np.ndenumerate(a):
        near = a[r, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        assert np.isclose(mean[r, y, x], np.nanmean(near)) if (~np.isnan(near)).any() else mean[r, y, x] is None
        assert blur[r, y, x] is None if np.isnan(v) else np.isclose(blur[r, y, x], np.nanmean(a[r, max(0, y - 5) : y + 6, x]))
    one = cells.where("raster = 0")
    spikes = {(r["y"], r["x"]): r["h"] for r in grid.suppress_spikes(one, floor=0.1, times=2.0).collect()}
    for (y, x), v in np.ndenumerate(a[0]):
        near = a[0, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        s = np.sort(near[~np.isnan(near)])
        want = v
        if 0 < y < 12 and 0 < x < 10 and len(s) >= 5 and not np.isnan(v):
            m = s[len(s) // 2]
            d = np.sort(abs(s - m))[len(s) // 2]
            want = m if abs(v - m) > max(0.1, 2 * d) else v
        assert spikes[y, x] is None if np.isnan(want) else np.isclose(spikes[y, x], want)


@pytest.mark.parametrize("values", [1, 20, 500_000])
def test_ranks(spark, monkeypatch, values):
    monkeypatch.setattr(grid, "GROUP_VALUES", values)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=101).round(1), "b": np.zeros(7), "c": np.array([5.0]), "d": rng.integers(0, 3, 50).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    got = grid.rank_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": (0.3, "floor_n"), "high": (0.8, "floor_n1"), "mid": (0.5, "linear"), "top": (1.0, "linear")})
    got = {r["g"]: r for r in got.collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, n = np.sort(vs), len(vs)
        assert np.isclose(got[g]["low"], s[min(n - 1, int(n * 0.3))]) and np.isclose(got[g]["high"], s[int((n - 1) * 0.8)])
        assert np.isclose(got[g]["mid"], np.median(vs)) and np.isclose(got[g]["top"], s[-1])


def covered(tiles):
    """Nearest selected ancestor or self of each leaf, tile by tile."""
    parent, picked = {i: p for i, p, _ in tiles}, {i: s for i, _, s in tiles}
    out = set()
    for leaf in set(parent) - set(parent.values()):
        at = leaf
        while at is not None and not picked.get(at):
            at = parent.get(at)
        if at is not None:
            out.add(at)
    return out


def test_finest_covering(spark):
    rng = np.random.default_rng(3)
    write = shared_folder(spark)
    for n, up in ((1, lambda i: 0), (60, lambda i: i // 3), (200, lambda i: i - 1)):
        tiles = [(i, None if i == 0 else up(i), bool(rng.random() < 0.2)) for i in range(n)] + [(1000, 999, True), (1001, 999, None)]
        got = network.finest_covering(spark.createDataFrame(tiles, "id long, parent long, selected boolean"), write)
        assert {r["id"] for r in got.collect()} == covered(tiles)
    assert network.finest_covering(spark.createDataFrame([], "id long, parent long, selected boolean"), write).count() == 0
    # many tiles, deep on one side: each tile of the last level has a selected one at most a few levels above
    big = spark.range(300_000).select("id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).alias("parent"), (F.col("id") % 5 == 1).alias("selected"))
    assert network.finest_covering(big, write).count() > 30_000


def walked(segs):
    """Chains as a walk from each first segment finds them."""
    at = {}
    for i, s, e, style in segs:
        for node in (s, e):
            at.setdefault(node, []).append((i, style))
    joint = {n for n, x in at.items() if len(x) == 2 and x[0][0] != x[1][0] and x[0][1] == x[1][1]}
    own, seen, out = {i: (s, e) for i, s, e, _ in segs}, set(), {}
    for seed in sorted(own):
        if seed in seen:
            continue
        chain = [(seed, False)]
        seen.add(seed)
        for ahead in (True, False):
            i, node = seed, own[seed][ahead]
            while node in joint:
                j = next(k for k, _ in at[node] if k != i)
                if j in seen:
                    break
                seen.add(j)
                back = own[j][0] != node if ahead else own[j][1] != node
                chain.append((j, back)) if ahead else chain.insert(0, (j, back))
                i, node = j, own[j][0 if back else 1] if ahead else own[j][1 if back else 0]
        out |= {j: (seed, n, back) for n, (j, back) in enumerate(chain)}
    return out


def test_merged_segments(spark):
    rng = np.random.default_rng(5)
    segs = [(i, f"n{i}", f"n{i + 1}", 0) for i in range(40)] + [(50 + i, f"r{i}", f"r{(i + 1) % 9}", 1) for i in range(9)]
    segs += [(70 + i, f"m{rng.integers(0, 30)}", f"m{rng.integers(0, 30)}", int(rng.integers(0, 2))) for i in range(25)] + [(100, "o", "o", 0), (101, "p", "q", 0), (102, "q", "p", 0)]
    segs = [(i, e, s, k) if rng.random() < 0.5 else (i, s, e, k) for i, s, e, k in segs]
    df = spark.createDataFrame([(i, 0, s, e, k) for i, s, e, k in segs], "way long, piece int, start string, end string, style int")
    got = {r["way"]: (r["chain_way"], r["pos"], r["reversed"]) for r in network.merged_segments(df, shared_folder(spark)).collect()}
    assert got == walked(segs)
    assert network.merged_segments(df.limit(0), shared_folder(spark)).count() == 0


def test_caches_by_bytes(spark):
    rng = np.random.default_rng(6)
    rows = [(f"b{i % 3}", f"k{i:03}", int(rng.integers(0, 40)), int(rng.integers(1, 9))) for i in range(200)]
    want = set()
    for b in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: (r[2], r[1]), reverse=True):
            total += r[3]
            if total <= 100:
                want.add(r[:2])
    df = spark.createDataFrame(rows, "bucket string, key string, at long, bytes long")
    for spans in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", spans)
        assert {(r["bucket"], r["key"]) for r in batch.newest_within_bytes(df, 100).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert batch.newest_within_bytes(df.limit(0), 100).count() == 0


def test_caps(spark):
    rows = [(c, p, o) for c in ("a", "b", None) for o, p in enumerate((3, 1, 3, 2))]
    got = junctions.capped(spark.createDataFrame(rows, "category string, priority int, ord int"), {"a": 2, "z": 9}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 3, 0), ("a", 3, 2), *[r for r in rows if r[0] != "a"]], key=repr)
    assert junctions.capped(spark.createDataFrame(rows, "category string, priority int, ord int"), {}).count() == len(rows)


def test_segments_walked_by_rows(spark):
    rng = np.random.default_rng(7)
    segs = [(i, i % 5, float(rng.choice([0.4, 1.0, 2.5])), *map(float, rng.uniform(-8, 40, 4))) for i in range(25)] + [(90, 9, 1.5, 5.0, 5.0, 5.0, 5.0), (91, 8, 1.0, 3.0, 20.0, 30.0, 20.0), (92, 7, 1.0, 50.0, 50.0, 60.0, 60.0)]
    got = {(r["px"], r["py"]): r["mat"] for r in geometry.rasterized_segments(spark.createDataFrame(segs, "ord int, mat int, half double, ax double, ay double, bx double, by double"), 32).collect()}
    want = {}
    for _, mat, half, ax, ay, bx, by in sorted(segs):
        for px in range(32):
            for py in range(32):
                dx, dy = bx - ax, by - ay
                t = min(1, max(0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                if (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2 <= half * half:
                    want[px, py] = mat
    assert got == want


def test_fields_without_samples_and_with_one(spark):
    none = spark.createDataFrame([], "x double, z double, value double")
    flat = fields.scalar_field(none, 5, shared_folder(spark), fallback=7.5).collect()
    assert len(flat) == 25 and {r["h"] for r in flat} == {7.5} and not any(r["measured"] for r in flat)
    one = spark.createDataFrame([(0.0, 0.0, 3.0), (90.0, -90.0, float("nan"))], "x double, z double, value double")
    got = fields.scalar_field(one, 5, shared_folder(spark)).collect()
    assert len(got) == 25 and all(np.isclose(r["h"], 3.0) for r in got) and sum(r["measured"] for r in got) == 1


def test_frames_and_rules_of_single_values(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = one(frames.closed_ring(F.array(p(0, 0), p(1, 0), p(1, 1))))
    assert len(ring) == 4 and one(frames.closed_ring(F.array(p(0, 0), p(1, 0)))) == []
    grown = one(frames.grown_polygon(F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1)), 2**0.5))
    assert np.allclose([(q["x"], q["y"]) for q in grown], [(-2, -2), (2, -2), (2, 2), (-2, 2)])
    moved = one(frames.jittered(F.lit(10.0), F.lit(20.0), F.lit(5.0), F.lit(3.0)))
    assert 0 < abs(moved["lat"] - 10) < 5 / 111320 * 1.01 and one(frames.jittered(F.lit(10.0), F.lit(20.0), F.lit(None).cast("double"), F.lit(3.0)))["lat"] == 10
    size = one(frames.plane_frame(F.struct(F.lit(0.0).alias("min_x"), F.lit(2.1).alias("max_x"), F.lit(0.0).alias("min_y"), F.lit(1.0).alias("max_y")), 10.0, 3.0))
    assert (size["width"], size["height"]) == (27, 16)
    t = lambda **kv: F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("__", ":"), v)])
    assert one(tags.flat_ground(t(amenity="parking"))) and not one(tags.flat_ground(t(amenity="parking", building="yes"))) and one(tags.flat_ground(t(area__highway="yes")))
    assert one(tags.mask_half_width(t(highway="primary"))) == 8 and one(tags.mask_half_width(t(highway="primary", bridge="yes"))) is None and one(tags.mask_half_width(t(highway="steps"))) is None


@pytest.mark.parametrize("few", [100_000, 40])
def test_components_of_stars_chains_and_meshes(spark, monkeypatch, few):
    monkeypatch.setattr(network, "FEW_LINKS", few)
    rng = np.random.default_rng(11)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(300)] + [(3000 + int(a), 3000 + int(b)) for a, b in rng.integers(0, 400, (380, 2))] + [(9000, 9000), (None, 5), (9001, 9000)]
    links += [(9100, 9100)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in network.components(df).collect()} == {(x, find(x)) for x in parent}
    nodes = spark.createDataFrame([(0,), (7,), (77777,)], "node long")
    assert sorted(map(tuple, network.spread_labels(nodes, df).collect())) == [(0, 0), (7, 0), (77777, 77777)]
    assert network.components(df.limit(0)).count() == 0


def most_of_a_key(monkeypatch, module):
    """The largest number of rows of one key, null included, that a shuffled side of a join has held in a task."""
    seen = []
    plain = module.join_hot

    def watched(rows, side, keys, hot, how="inner"):
        left = rows if hot is None else rows.join(hot, keys, "left_anti")
        seen.append(left.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)
        return plain(rows, side, keys, hot, how)

    monkeypatch.setattr(module, "join_hot", watched)
    return seen


def test_no_task_holds_a_star_or_a_root_of_many_tiles(spark, monkeypatch):
    seen = most_of_a_key(monkeypatch, network)
    monkeypatch.setattr(network, "FEW_LINKS", 1000)
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = network.components(star.union(spark.range(200_000, 200_100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))))
    assert [tuple(r) for r in got.groupBy("label").count().orderBy("label").collect()] == [(0, 100_001), (200_000, 101)]
    tiles = spark.range(20_001).select("id", F.when(F.col("id") > 0, F.when(F.col("id") <= 10, F.lit(0)).otherwise(F.col("id") - 10 * (1 + F.col("id") % 3))).cast("long").alias("parent"), (F.col("id") == 0).alias("selected"))
    tiles = tiles.withColumn("parent", F.when(F.col("id") > 0, F.greatest("parent", F.lit(0))))
    assert [r["id"] for r in network.finest_covering(tiles).collect()] == [0]
    assert max(seen) <= 200
    loop = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, 1, False), (4, None, True), (5, 4, False)], "id long, parent long, selected boolean")
    assert [r["id"] for r in network.finest_covering(loop).collect()] == [4]


def largest_part(table_of, monkeypatch, module):
    """Rows of the fullest range of each table that the module writes."""
    seen = []
    monkeypatch.setattr(module, "table", lambda df, name="table": seen.append(df.groupBy(df.columns[-1]).count().agg({"count": "max"}).first()[0]) or table_of(df, name))
    return seen


def test_ranks_beside_infinities_and_far_values(spark, monkeypatch):
    from geoloom.operators.shared import table

    rows = [("a", v) for v in (-1.0, 3.0, float("inf"))] + [("b", v) for v in (float("-inf"), float("-inf"), 2.0, float("nan"))] + [("c", float("inf"))] * 2 + [(None, 1.0)]
    got = grid.rank_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": (0.5, "linear"), "top": (1.0, "floor_n1")}).collect()
    assert {r["g"]: (r["m"], r["top"]) for r in got} == {"a": (3.0, float("inf")), "b": (float("-inf"), 2.0), "c": (float("inf"), float("inf"))}
    # one value of 1e12 among 400,000: no range holds more than a share
    monkeypatch.setattr(grid, "GROUP_VALUES", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = largest_part(table, monkeypatch, grid)
        far = spark.range(400_001).select(F.lit("a").alias("g"), F.when(F.col("id") == 400_000, 1e12).otherwise(F.col("id") / 7).alias("v"))
        assert grid.rank_values(far, ["g"], "v", {"m": (0.5, "linear")}).first()["m"] == 200_000 / 7
        assert max(seen) < 3 * 400_001 / 16
        # a burst: all entries of one time
        seen = largest_part(table, monkeypatch, batch)
        burst = spark.range(100_000).select(F.lit("b").alias("bucket"), F.format_string("%06d", "id").alias("key"), F.lit(5).alias("at"), F.lit(1).alias("bytes"))
        kept = batch.newest_within_bytes(burst, 30_000)
        assert kept.count() == 30_000 and kept.agg(F.min("key")).first()[0] == "070000" and max(seen) < 3 * 100_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
