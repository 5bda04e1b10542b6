import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import crs, scalars, tags
from geoloom.operators import geometry, grid, network, rasters, routes
from geoloom.sinks import exports
from geoloom.sources import records, text_grids


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("r")).first()["r"]


# readers


ASC = "ncols 2\nnrows 2\nxllcorner -120\nyllcorner 39.99\ncellsize .01\nNODATA_value -9999\n1 2\n3 4\n"
GML = '<gml:RectifiedGridCoverage><gml:low>0 0</gml:low><gml:high>1 1</gml:high><gml:tupleList>10 20 30 40</gml:tupleList></gml:RectifiedGridCoverage>'
GML_START = '<gml:RectifiedGridCoverage srsName="http://www.opengis.net/def/crs/EPSG/0/6668"><gml:low>0 0</gml:low><gml:high>1 1</gml:high><gml:tupleList>a,10 b,20\n c,30</gml:tupleList><gml:startPoint>1 0</gml:startPoint></gml:RectifiedGridCoverage>'


def grid_of(df, n):
    got = {(r["row"], r["col"]): r["h"] for r in df.collect()}
    return [got.get((i, j)) for i in range(n) for j in range(n)]


def test_asc(spark):
    f = spark.createDataFrame([(1, ASC), (2, "# note\nNCOLS 1\r\nNROWS 1\r\nXLLCENTER 200\nYLLCENTER 9\nCELLSIZE 1\n-9999")], "id long, text string")
    assert grid_of(text_grids.read_asc(f.where("id = 1")), 2) == [1, 2, 3, 4]
    assert grid_of(text_grids.read_asc(f.where("id = 2")), 1) == [None]
    m = {r["id"]: r for r in text_grids.asc_meta(f).collect()}
    assert (m[1]["west"], round(m[1]["north"], 6)) == (-120, 40.01) and (m[2]["west"], m[2]["north"]) == (-160.5, 9.5)
    assert one(spark, text_grids.likely_asc(F.col("t")), t=ASC) and not one(spark, text_grids.likely_asc(F.col("t")), t=GML)
    more = spark.createDataFrame([(1, ASC + "5"), (2, ASC.replace("xllcorner -120", "xllcorner -120\nxllcenter 7"))], "id long, text string")
    assert grid_of(text_grids.read_asc(more.where("id = 1")), 2) == [1, 2, 3, 4]
    assert {r["id"]: round(r["west"], 6) for r in text_grids.asc_meta(more).collect()} == {1: -120, 2: 6.995}
    bad = spark.createDataFrame([(1, ASC[:-2])], "id long, text string")
    assert text_grids.read_asc(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="too few"):
        text_grids.read_asc(bad).collect()


def test_gml(spark):
    f = spark.createDataFrame([(1, GML), (2, GML_START)], "id long, text string")
    assert grid_of(text_grids.read_gml(f.where("id = 1")), 2) == [10, 20, 30, 40]
    assert grid_of(text_grids.read_gml(f.where("id = 2")), 2) == [None, 10, 20, 30]
    assert {r["id"]: r["epsg"] for r in text_grids.gml_meta(f).collect()} == {1: None, 2: 6668}


def test_xyz(spark):
    f = spark.createDataFrame([(1, "10 5 1\n20 5 2\n10 6 3\n20 6 4"), (2, "1 1 1\n2 2 2\n3 3 3"), (3, "")], "id long, text string")
    assert grid_of(text_grids.read_xyz(f), 2) == [3, 4, 1, 2]


def las(points, kind=1):
    size = 20 if kind < 6 else 30
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, kind, size, len(points))
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<3i", *p[:3]) + b"\0" * (3 if kind < 6 else 4) + bytes([p[3]]) + b"\0" * (size - 16 - (kind >= 6)) for p in points)
    return bytes(head) + body


def test_las(spark):
    pts = [(100, 200, 5000, 2), (150, 250, 6000, 0xE9), (0, 0, 0, 5)]
    for kind in (1, 6):
        df = records.read_las(spark.createDataFrame([(1, las(pts, kind))], "id long, content binary"))
        got = [tuple(r)[1:] for r in df.collect()]
        assert np.allclose([g[:3] for g in got], [(101, 202, 50), (101.5, 202.5, 60), (100, 200, 0)]) and [g[3] for g in got] == [2, 9, 5]
    cells = grid.gridded_points(df, (2, 9), 101.0, 202.0, 1.0, 1.0, 2, 2).collect()
    assert [(r["row"], r["col"], r["h"], r["n"]) for r in cells] == [(1, 0, 55.0, 2)]


def test_archives_and_containers(spark):
    e = spark.createDataFrame([(1, 2, "a.gml", b"new"), (1, 1, "a.gml", b"old"), (1, 3, "b.txt", b"x")], "id long, ord int, path string, content binary")
    z = exports.archives(e)
    assert zipfile.ZipFile(io.BytesIO(z.first()["content"])).read("a.gml") == b"new"
    assert [tuple(r) for r in records.unzipped(z, (".gml",)).collect()] == [(1, "a.gml", "new")]
    head, payload = records.read_container(exports.container({"a": 1}, b"abc"))
    assert head == {"a": 1} and payload == b"abc"


def test_terrain_file(spark):
    cells = spark.createDataFrame([(1, r, c, float(r * 2 + c)) for r in range(2) for c in range(2)], "id long, row int, col int, h double")
    content = exports.terrain_files(cells, 2, ["grass"]).first()["content"]
    assert struct.unpack_from("<BI", content) == (9, 2) and struct.unpack_from("<4H", content, 5) == (43690, 65535, 0, 21845)
    assert content[-10:] == struct.pack("<I", 1) + b"\x05grass"


# functions


def test_parsing(spark):
    for text, width in (("12", 12.0), ("12.5 m", 12.5), ("40 ft", 40 * 0.3048), ("60", 60 * 0.3048), ("4;5", 4.0), ("", None), ("-3", None), ("wide", None)):
        got = one(spark, scalars.parse_width_m(F.col("t")), t=text)
        assert got == width or abs(got - width) < 1e-9
    assert one(spark, scalars.parse_int(F.col("t")), t=" 12 m") == 12 and one(spark, scalars.parse_int(F.col("t")), t="x") is None
    assert one(spark, scalars.round_to(F.col("t"), 0), t=-2.5) == -2
    assert one(spark, scalars.fnv1a_hex(F.col("t")), t="") == "811c9dc5" and one(spark, scalars.fnv1a_hex(F.col("t")), t="a") == "e40c292c"
    assert one(spark, scalars.sanitize_file_part(F.col("t")), t=" ** ") == "tile"
    assert one(spark, scalars.decode_entities(F.col("t")), t="&lt;&amp;lt;") == "<&lt;"


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(48.2, 11.9), (47.5, 9.0)], "lat double, lng double")
    x, y = crs.local_xy("lat", "lng", 48.0, 11.0)
    lat, lng = crs.tmerc_inverse_sql("x", "y", 48.0, 11.0)
    for r in df.withColumn("x", x).withColumn("y", y).select("lat", "lng", F.expr(lat).alias("a"), F.expr(lng).alias("b")).collect():
        assert abs(r["lat"] - r["a"]) < 1e-9 and abs(r["lng"] - r["b"]) < 1e-9
    # a published example: Paris in zone 31
    u = crs.utm_sql("48.8566", "2.3522")
    r = spark.range(1).select(*[F.expr(v).alias(k) for k, v in u.items()]).first()
    assert (r["zone"], r["epsg"]) == (31, 32631) and abs(r["easting"] - 452483) < 2 and abs(r["northing"] - 5411718) < 3


def test_road_rules(spark):
    df = spark.createDataFrame([({"highway": "motorway", "lanes": "3"},), ({"highway": "residential"},), ({"highway": "primary", "lanes:forward": "4", "lanes:backward": "9"},), (None,)], "tags map<string,string>")
    got = [tuple(r["n"]) for r in df.select(tags.lane_counts(F.col("tags"), tags.one_way(F.col("tags"))).alias("n")).collect()]
    assert got == [(3, 3, 0), (2, 1, 1), (8, 2, 6), (2, 1, 1)]


# rasters and geometry


def test_kernels():
    rng = np.random.default_rng(1)
    a = np.add.outer(np.arange(20.0), np.arange(24.0))
    holes = a.copy()
    holes[5:9, 6:12] = np.nan
    done = rasters.finished(holes, smooth=False, fill=True)
    assert not np.isnan(done).any() and np.abs(done - a).max() < 1.5 and (done[~np.isnan(holes)] == a[~np.isnan(holes)]).all()
    assert rasters.finished(a, smooth=True, fill=True) is a
    many = np.where(rng.random(a.shape) < 0.4, np.nan, a)
    assert rasters.finished(many, smooth=True, fill=True) is many
    b = rasters.box_blur(holes, 2)
    assert abs(b[15, 15] - 30) < 1e-9 and np.isnan(b[6, 7])
    two = np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 1]], bool)
    assert len(np.unique(rasters.flood_components(two))) == 4 and rasters.flood_components(two, 2).max() == 2
    corner = np.full((10, 10), np.nan)
    corner[0, 0], corner[9, 9] = 0, 10
    assert rasters.dilate(corner)[4, 5] == 5 and not np.isnan(rasters.dilate(corner)).any()


def test_empty_and_null_rasters(spark):
    c = spark.createDataFrame([(0, 0, None), (0, 1, 2.0)], "y long, x int, h double")
    assert [r["h"] for r in grid.blur_axis(c, "x", 1).orderBy("x").collect()] == [None, 2.0]
    assert [r["h"] for r in grid.mean_3x3(c).orderBy("x").collect()] == [2.0, 2.0]
    none = c.limit(0)
    assert grid.suppress_spikes(none).count() == grid.push_pull(none, 2).count() == 0


def test_routes():
    line = np.column_stack([np.full(50, 48.137), np.linspace(11.5, 11.5 + 5000 / (111320 * np.cos(np.radians(48.137))), 50)])
    n = routes.chunk_centres(line, 1024, 150)
    assert 4 <= len(n) <= 8 and (np.diff(n) > 0).all()
    assert len(routes.chunk_centres(line[:3], 1024, 150)) == 1
    assert routes.chunk_size("ultra", 512) == 1000 and routes.chunk_size("x", None) == 1024 and routes.overlap(1024, 150) == 180


def test_hull_and_simplify(spark):
    pts = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])]
    df = spark.createDataFrame(pts, "line int, idx int, x double, y double")
    assert [(r["x"], r["y"]) for r in geometry.hull(df).orderBy("idx").collect()] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    bend = spark.createDataFrame([(1, i, float(i), 0.1 if i == 2 else 0.0) for i in range(5)] + [(2, 0, 0.0, 0.0)], "line int, idx int, x double, y double")
    assert geometry.simplify(bend, 0.5).where("line = 1").count() == 2 and geometry.simplify(bend, 0.05).where("line = 1").count() == 3


def test_components_of_a_chain(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(99, 99)], "a long, b long")

    n = 0

    def write(df):
        nonlocal n
        n += 1
        df.write.parquet(f"{tmp_path}/{n}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{n}")

    got = {r["node"]: r["label"] for r in network.components(links, write).collect()}
    assert got == {i: 0 for i in range(31)} | {99: 99}


def test_point_grid_spans_the_table(spark, tmp_path):
    from geoloom.plans import registry

    rows = [(0, 0, 2, 10.0), (0, 3, 6, 20.0), (3300, 129, 2, 30.0), (9000, 400, 6, 40.0), (9000, 400, 1, 99.0), (9100, 408, 1, 99.0), (None, 5, 2, 1.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["point_grid"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(2, 180, 40.0, 1), (70, 66, 30.0, 1), (102, 0, 15.0, 2)]


def test_bilinear_samples_all_rows(spark, tmp_path):
    from geoloom.plans import registry

    height = 700
    spark.createDataFrame([(y, [float(y)] * 64) for y in range(height)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(k,) for k in range(2000)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = [r["h"] for r in registry.queries()["bilinear"](spark, str(tmp_path)).collect()]
    assert len(got) == 2000 and max(got) == height - 1
    assert {int(h) for h in got} == set(range(height))
