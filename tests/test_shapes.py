import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.operators import shapes
from geoloom.sources import records, tiff


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 9))
def test_tiff_round_trip(h, w, deflate, seed):
    a = np.random.default_rng(seed).normal(size=(h, w)).astype(np.float32).astype(float)
    a[0, 0] = np.nan
    content = tiff.write(a, 10.0, 41.0, 0.5, 0.25, 32633 if seed % 2 else 4326, deflate=deflate)
    assert np.array_equal(tiff.raster(content), a, equal_nan=True)
    m = tiff.meta(content)
    assert (m["width"], m["height"], m["west"], m["north"], m["dx"], m["dy"], m["epsg"]) == (w, h, 10.0, 41.0, 0.5, 0.25, 32633 if seed % 2 else 4326)


def test_tiff_faults():
    with pytest.raises(ValueError):
        tiff.raster(b"PK\3\4" + b"\0" * 20)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 9))
def test_png_round_trip(h, w, seed):
    a = np.random.default_rng(seed).integers(0, 65536, (h, w))
    assert (tiff.png_pixels(tiff.png16(a))[..., 0] == a).all()


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(4)
    want = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    raw, rows = want.reshape(5, 12).astype(int), b""
    for y in range(5):
        left = np.concatenate([[0, 0, 0], raw[y, :-3]])
        up = raw[y - 1] if y else np.zeros(12, int)
        corner = np.concatenate([[0, 0, 0], up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        rows += bytes([y]) + ((raw[y] - (0, left, up, (left + up) // 2, paeth)[y]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (tiff.png_pixels(content) == want).all()
    h = tiff.elevation_pixels(content)
    assert h[1, 2] == want[1, 2, 0] * 256.0 + want[1, 2, 1] + want[1, 2, 2] / 256 - 32768


def test_ways_join_in_order():
    assert shapes.joined([["a", "b"], ["c", "b"], ["c", "a"]]) == [["a", "b", "c", "a"]]
    assert shapes.joined([]) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=2, max_size=4), max_size=8))
def test_joining_keeps_every_way(ways):
    out = shapes.joined(ways)
    edges = lambda ls: sorted(tuple(sorted(e)) for x in ls for e in zip(x, x[1:]))
    assert edges(out) == edges(ways)


def test_places_and_sheets(spark):
    assert records.year_order(2019) == [2019, 2018, 2020] and records.year_order(2030) == [2020, 2019, 2018]
    idx = spark.createDataFrame([("a", 2018, "u1"), ("a", 2020, "u2"), ("b", 2020, "u3"), ("c", 1999, "u4")], "sheet string, year int, url string")
    assert {tuple(r) for r in records.newest_sheets(idx, records.year_order(2019)).collect()} == {("a", 2018, "u1"), ("b", 2020, "u3")}


def test_throttle(spark):
    df = spark.createDataFrame([("k", t, float(t)) for t in (0, 500, 1200, 1300, 2500, 2600)], "key string, at long, value double")
    assert [r["at"] for r in shapes.throttled(df, 1200, 2).orderBy("at").collect()] == [1200, 2500]


def test_trees_stand_every_eight_metres(spark, tmp_path):
    from geoloom.plans import registry

    rows = [(1, 1, 0, 0), (1, 2, 600, 0), (1, 3, 601, 0), (1, 4, 601, 0), (2, 1, 990, 5), (2, 2, 3, 141), (3, 1, 7, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = []
    for (line, i, ax, ay), (other, _, bx, by) in zip(rows, rows[1:]):
        if line != other:
            continue
        ax, ay, bx, by = ax % 997, ay * 7 % 991, bx % 997, by * 7 % 991
        n = max(1, math.floor(math.hypot(bx - ax, by - ay) / 8))
        want += [(line, i - 1, k, round(ax + (bx - ax) * k / n, 6), round(ay + (by - ay) * k / n, 6)) for k in range(n + 1)]
    got = sorted(map(tuple, registry.queries()["tree_rows"](spark, str(tmp_path)).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in sorted(want)], atol=1e-6)
    assert len(got) > 200
