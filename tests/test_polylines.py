"""Lines that are simplified and wrapped many at a time, against plain computations a line."""

import numpy as np
import pytest

from geoloom.operators import geometry, polylines


def plain_simplified(p, tolerance):
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, chord = p[a + 1 : b] - p[a], p[b] - p[a]
        size = float(chord @ chord)
        t = np.clip(d @ chord / size, 0, 1) if size else np.zeros(len(d))
        away = np.hypot(*(d - t[:, None] * chord).T)
        i = int(away.argmax())
        if away[i] > tolerance:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return p[sorted(keep)]


def some_lines():
    rng = np.random.default_rng(8)
    lines = [rng.integers(0, most, (k, 2)).astype(float) for k in (1, 2, 3, 7, 40, 300) for most in (1, 3, 50, 1000)]
    return lines + [np.array([(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)]), np.array([(0.0, 0.0)] * 5), np.array([(0.0, 0.0), (1.0, 4.0), (2.0, -4.0), (3.0, 4.0), (4.0, 0.0)])]


@pytest.mark.parametrize("tolerance", [0.0, 1.0, 20.0, 300.0])
def test_simplified_lines_are_those_of_each(tolerance):
    lines = some_lines()
    p, n = np.concatenate(lines), np.array([len(line) for line in lines])
    at, counts = polylines.simplified(p[:, 0], p[:, 1], n, tolerance)
    for got, line in zip(np.split(p[at], np.cumsum(counts)[:-1]), lines):
        assert got.tolist() == plain_simplified(line, tolerance).tolist()


@pytest.mark.parametrize("name", ["simplify", "hull"])
def test_lines_travel_as_arrays(spark, capsys, name):
    """No line is turned into objects of its own on the way to Python and back, and rows come back in order, of keys of any kind."""
    lines = some_lines()
    rows = [(f"l{k}", i, x, y) for k, line in enumerate(lines) for i, (x, y) in enumerate(line.tolist())]
    points = spark.createDataFrame(rows[::-1], "line string, idx int, x double, y double").repartition(5)
    found = geometry.simplify(points, 20.0) if name == "simplify" else geometry.hull(points)
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["line"], r["idx"])):
        got.setdefault(r["line"], []).append((r["idx"], r["x"], r["y"]))
    for k, line in enumerate(lines):
        x, y = line.T.copy()
        want = plain_simplified(line, 20.0) if name == "simplify" else line[polylines.hulls(x, y, np.array([len(line)]))[0]]
        assert got[f"l{k}"] == [(i, *q) for i, q in enumerate(want.tolist())]
    assert (geometry.simplify(points.limit(0), 20.0) if name == "simplify" else geometry.hull(points.limit(0))).count() == 0
