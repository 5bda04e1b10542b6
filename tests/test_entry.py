import __spark_entry__ as entry
from geoloom.operators import shapes


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scattered_points_lie_inside_and_repeat(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 30.0, "y": 0.0}, {"x": 0.0, "y": 30.0}]
    df = spark.createDataFrame([(1, ring), (2, ring)], "id long, ring array<struct<x:double,y:double>>")
    a = sorted(map(tuple, shapes.scattered(df, 3.0, 2000).collect()))
    assert a == sorted(map(tuple, shapes.scattered(df, 3.0, 2000).collect()))
    assert all(x + y < 30 and x > 0 and y > 0 for _, _, x, y in a) and 60 < len(a) < 140
    assert [x for i, _, x, _ in a if i == 1] != [x for i, _, x, _ in a if i == 2]
