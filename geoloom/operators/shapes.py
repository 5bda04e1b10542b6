"""Shapes made from features: rings joined from ways, ribbons and walls along lines, points along and inside features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import point_in_ring


def joined(ways: list[list]) -> list[list]:
    """Lines made by joining ways end to end, in order of the first way; a ring closes and is done.

    An end is extended before a start, and a way that fits as it runs before one that has to be turned."""
    left = {i: list(w) for i, w in enumerate(ways) if w}
    out = []
    while left:
        line = left.pop(next(iter(left)))
        while not (line[0] == line[-1] and len(line) > 2):
            tests = (
                (lambda w: w[0] == line[-1], lambda w: line + w[1:]),  # noqa: B023
                (lambda w: w[-1] == line[-1], lambda w: line + w[::-1][1:]),  # noqa: B023
                (lambda w: w[-1] == line[0], lambda w: w[:-1] + line),  # noqa: B023
                (lambda w: w[0] == line[0], lambda w: w[::-1][:-1] + line),  # noqa: B023
            )
            found = next(((i, grow) for fits, grow in tests for i, w in left.items() if fits(w)), None)
            if not found:
                break
            line = found[1](left.pop(found[0]))
        out.append(line)
    return out


def rings_of_relations(members: DataFrame) -> DataFrame:
    """rel, ring, nodes, closed of the member ways (rel, ord, nodes: array<string>) of relations.  Relations travel to
    Python many at a time; one has to fit in memory."""

    @F.pandas_udf("array<array<string>>")
    def run(ways: pd.Series) -> pd.Series:
        return pd.Series([joined([list(w["nodes"]) for w in rel]) for rel in ways])

    whole = members.groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("ord", "nodes"))).alias("w"))
    out = whole.select("rel", run("w").alias("rings")).select("rel", F.posexplode("rings").alias("ring", "nodes"))
    return out.withColumn("closed", (F.size("nodes") > 2) & (F.element_at("nodes", 1) == F.element_at("nodes", -1)))


def ribbon(points: DataFrame, half: float) -> DataFrame:
    """line, vi, x, y of a strip along lines: the left and right side of each point, numbered 2 * idx and 2 * idx + 1."""
    w = Window.partitionBy("line").orderBy("idx")
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    p = points.withColumn("dx", dx).withColumn("dy", dy).withColumn("n", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    p = p.withColumn("nx", F.when(F.col("n") > 0, -F.col("dy") / F.col("n")).otherwise(0.0)).withColumn("ny", F.when(F.col("n") > 0, F.col("dx") / F.col("n")).otherwise(0.0))
    side = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(half).alias("d")), F.struct(F.lit(1).alias("k"), F.lit(-half).alias("d")))).alias("s")
    p = p.select("line", "idx", "x", "y", "nx", "ny", side)
    return p.select("line", (F.col("idx") * 2 + F.col("s.k")).alias("vi"), (F.col("x") + F.col("nx") * F.col("s.d")).alias("x"), (F.col("y") + F.col("ny") * F.col("s.d")).alias("y"))


def ribbon_triangles(points: DataFrame) -> DataFrame:
    """line, ti, i0, i1, i2: two triangles between neighbouring points of a ribbon."""
    w = Window.partitionBy("line").orderBy("idx")
    p = points.select("line", "idx", F.lead("idx").over(w).alias("next")).where("next is not null")
    a = F.col("idx") * 2
    both = F.explode(F.array(F.struct(a.alias("i0"), (a + 1).alias("i1"), (F.col("next") * 2).alias("i2"), F.lit(0).alias("k")), F.struct((a + 1).alias("i0"), (F.col("next") * 2 + 1).alias("i1"), (F.col("next") * 2).alias("i2"), F.lit(1).alias("k")))).alias("t")
    return p.select("line", "idx", both).select("line", (F.col("idx") * 2 + F.col("t.k")).alias("ti"), "t.i0", "t.i1", "t.i2")


#: Stretches of one part where they are dealt by their steps: some millions of points.
STRETCHES = 62_500


def along(points: DataFrame, spacing: float, parts: int | None = None) -> DataFrame:
    """line, idx, k, x, y: points at most `spacing` apart on each stretch of lines, both ends included.

    With `parts` stretches are dealt in so many parts by their number of steps, and the first points of a part's stretches come before the rest.  Between
    whole places, stretches of as many steps have few coordinates, which then fill a part's files over and over and are written as numbers of these instead
    of doubles.  The points are the same in any case."""
    w = Window.partitionBy("line").orderBy("idx")
    s = points.select("line", "idx", "x", "y", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    d = F.sqrt((F.col("bx") - F.col("x")) * (F.col("bx") - F.col("x")) + (F.col("by") - F.col("y")) * (F.col("by") - F.col("y")))
    s = s.withColumn("n", F.greatest(F.lit(1), F.floor(d / spacing)).cast("int"))
    if parts:
        first, rest = (F.struct(a.alias("a"), b.alias("b")) for a, b in ((F.lit(0), F.lit(0)), (F.lit(1), F.col("n"))))
        s = s.repartitionByRange(parts, "n", "line").withColumn("ks", F.explode(F.array(first, rest))).sortWithinPartitions(F.col("ks.a") * F.col("n"))
    s = s.withColumn("k", F.explode(F.sequence("ks.a", "ks.b") if parts else F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return s.select("line", "idx", "k", (F.col("x") + (F.col("bx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("by") - F.col("y")) * t).alias("y"))


def unit_number(*keys: Column) -> Column:
    """A number from 0 to 1 that follows from keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / float(1 << 20)


def scattered(rings: DataFrame, spacing: float, most: int) -> DataFrame:
    """id, n, x, y: points inside rings (id, ring), one try for each square of the spacing up to `most`, at places that
    follow from the id and number."""
    lo = lambda k: F.array_min(F.transform("ring", lambda p: p[k]))
    hi = lambda k: F.array_max(F.transform("ring", lambda p: p[k]))
    r = rings.select("id", "ring", lo("x").alias("x0"), hi("x").alias("x1"), lo("y").alias("y0"), hi("y").alias("y1"))
    tries = F.least(F.lit(most), F.ceil((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (spacing * spacing))).cast("int")
    r = r.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), tries))))
    at = lambda k, salt: F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * unit_number(F.col("id"), F.col("n"), F.lit(salt))
    r = r.withColumn("px", at("x", 1)).withColumn("py", at("y", 2))
    return r.where(point_in_ring(F.col("px"), F.col("py"), F.col("ring"))).select("id", "n", F.col("px").alias("x"), F.col("py").alias("y"))


def extruded(rings: DataFrame) -> DataFrame:
    """id, wall, corner, x, y, z: the four corners of each wall over the edges of rings (id, ring, low, high)."""
    nxt = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    e = rings.select("id", "low", "high", F.posexplode(F.arrays_zip(F.col("ring").alias("a"), nxt.alias("b"))).alias("wall", "e"))
    corner = lambda p, z: F.struct(F.col(f"e.{p}.x").alias("x"), F.col(f"e.{p}.y").alias("y"), F.col(z).cast("double").alias("z"))
    return e.select("id", "wall", F.posexplode(F.array(corner("a", "low"), corner("b", "low"), corner("b", "high"), corner("a", "high"))).alias("corner", "c")).select("id", "wall", "corner", "c.*")


def throttled(samples: DataFrame, least_ms: int, most: int) -> DataFrame:
    """samples (key, at, value) of which each is `least_ms` after the last kept one, the newest `most` of a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        kept, last = [], -np.inf
        for i, t in enumerate(pdf["at"]):
            if t - last >= least_ms:
                kept.append(i)
                last = t
        return pdf.iloc[kept[-most:]]

    return samples.select("key", "at", "value").groupBy("key").applyInPandas(run, samples.select("key", "at", "value").schema)
