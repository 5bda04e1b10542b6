import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import top_k as tk

SCHEMA = "vec_id long, embedding array<double>, v string, norm string, bucket int"


def brute(rows, k, is_query):
    usable = [(i, [math.floor(1024 * x) if abs(1024 * x) < 2**52 else int(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v)]
    out = []
    for q, a in usable:
        if is_query(q):
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in usable if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("steep, seeds, block", [(0.6, 1024, 4096), (0.01, 30, 16), (0.01, 8, 50)])
def test_against_brute_force(spark, monkeypatch, steep, seeds, block):
    monkeypatch.setattr(tk, "STEEP", steep)
    monkeypatch.setattr(tk, "VECTORS", block)
    monkeypatch.setattr(tk, "QUERIES", 4)
    monkeypatch.setattr(tk, "HELD", 2)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + 0.2 * rng.normal(size=8)) * rng.lognormal(0, 1)) for i in range(900)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(1000 + i, [0.25] * 8) for i in range(300)] + [(2000, [0.0] * 8), (2001, [-1.0] * 8), (2010, [1e12] * 8), (2011, [-1e300] * 8), (2020, [1e307] * 8)]
    rows += [(3000, None), (3010, []), (3020, [None] * 8), (3030, [float("nan")] * 8), (3040, [float("inf")] * 8), (None, [1.0] * 8), (4000, [1.0, 2.0]), (4010, [3.0, 1.0]), (4011, [1.0])]
    df = spark.createDataFrame([(i, v, "", "", 1) for i, v in rows], SCHEMA)
    got = tk.top_k(df, F.col("vec_id") % 10 == 0, 10, seeds=seeds).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, lambda q: q % 10 == 0)


def test_repeated_and_no_rows(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])]
    got = tk.top_k(spark.createDataFrame([(i, v, "", "", 1) for i, v in rows], SCHEMA), F.col("vec_id") == 10, 10).collect()
    assert sorted(map(tuple, got)) == sorted(2 * [(10, 1, 1, 2 * 1024 * 1024), (10, 2, 2, 2 * 1024 * 1024)])
    assert tk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 10, 10).count() == 0
