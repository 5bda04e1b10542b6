import hashlib
import math

import duckdb
import numpy as np
import pytest

from geoloom.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<double>, id string, v int, cluster int, distance string"


def brute(rows, k, dim, scale, rounds, salt="1:"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    at = [v for _, v in sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    if not at:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for n in range(rounds + 1):
        got = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if n < rounds:
            own = [[v for (_, v), (_, j) in zip(kept, got) if j == n] for n in range(len(at))]
            at = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, at)]
    top = 2**63 - 1
    sums = [sum(d for d, j in got if j == n) for n in range(len(at))]
    return sorted([(i, j, min(d, top), min(sums[j], top), min(sum(sums), top), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got)], key=repr)


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "a", 1, 2, "b") for i, v in rows], SCHEMA)
    got = sorted(map(tuple, ce.clusters(df, **how).collect()), key=repr)
    assert got == brute(rows, how["k"], how["dim"], how["scale"], how["rounds"])
    return got


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 6))
    rows = [(i, (base[i % 5] + 0.4 * rng.normal(size=6)).tolist()) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(1000, 1300)]  # a third of one vector
    rows += [(7, [1.0] * 6), (7, [-1.0] * 6), (7, [1.0] * 6), (None, [2.0] * 6), (2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [None] + [0.0] * 5), (2005, [float("nan")] * 6), (2006, [float("inf")] + [0.0] * 5), (2007, [0.0] * 6)]
    check(spark, rows, k=16, dim=6, scale=64.0, rounds=3)
    check(spark, rows, k=2, dim=6, scale=10.0, rounds=1)


@pytest.mark.parametrize("size", [1e7, 1e12, 1e30, 1e306])
def test_wide_vectors_and_centroids(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(80)]
    rows += [(100 + i, (size * rng.normal(size=4)).tolist()) for i in range(30)] + [(200, [1e308] * 4)]
    check(spark, rows, k=9, dim=4, scale=64.0, rounds=3)
    check(spark, [(i, [size, size, 0.0, float(i % 3)]) for i in range(20)], k=3, dim=4, scale=64.0, rounds=2)


def test_bound_is_safe_and_sharp_sums_are_exact():
    for dim in (1, 3, 64, 768):
        b = ce.plain_bound(dim)
        assert dim * (2 * b) ** 2 < 2**53 and b * ce.BLOCK < 2**53
        x = np.full((3, dim), float(b))
        x[1] = -b
        label, dist = ce.nearest(x, [[-b] * dim, [b] * dim, [b] * dim])
        assert label.tolist() == [1, 0, 1] and dist == [0, 0, 0]
        assert ce.nearest(x[:1], [[-b] * dim])[1] == [dim * (2 * b) ** 2]


def test_few_vectors_ties_and_none(spark):
    check(spark, [(1, [1.0, 2.0])], k=16, dim=2, scale=64.0, rounds=3)
    check(spark, [(5, [1.0, 2.0])] * 4 + [(6, [1.0, 2.0])], k=3, dim=2, scale=64.0, rounds=3)
    check(spark, [(i, [float(i), 0.0]) for i in range(3)], k=2, dim=2, scale=1.0, rounds=3)
    assert check(spark, [(None, [1.0, 2.0]), (1, [1.0])], k=2, dim=2, scale=1.0, rounds=3) == []
    assert check(spark, [], k=2, dim=2, scale=1.0, rounds=3) == []


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
        df = ce.op12_centroid_clusters(spark, sf)
        names = ", ".join(df.columns)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {names} from ({ce.ORACLE_SQL})").fetchall())
