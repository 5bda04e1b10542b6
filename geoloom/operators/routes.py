"""Routes: corridor tiers, chunks of a route by area, stations along it and progress."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.crs import DEGREE_M, EARTH_R

# fixed values: tier, corridor half width and chunk size in metres; share of work at a phase's start
TIERS = (("draft", 50, 1024), ("standard", 150, 1024), ("fine", 300, 2048), ("ultra", 500, 2048))
PHASES = (("pending", 0), ("terrain", 0), ("bake", 12), ("encode", 92), ("done", 100), ("error", 0))


def tier(name: str) -> tuple[int, int]:
    """Half width and chunk size; an unknown name is the standard tier."""
    known = {n: (h, c) for n, h, c in TIERS}
    return known.get(name, known["standard"])


def chunk_size(name: str, override: float | None = None) -> float:
    half, size = tier(name)
    return size if not override or override <= 0 else max(256, 2 * half, math.floor(override + 0.5))


def overlap(size: float, half: float) -> float:
    return min(0.5 * size, max(64.0, 1.2 * half))


def haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (p, l), (q, m) = np.radians(a.T), np.radians(b.T)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((m - l) / 2) ** 2
    return 2 * EARTH_R * np.arcsin(np.minimum(1, np.sqrt(h)))


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greater of the distances in metres along the axes."""
    north, east = np.abs(a[:, 0] - b[0]), np.abs(a[:, 1] - b[1]) * np.cos(np.radians((a[:, 0] + b[0]) / 2))
    return DEGREE_M * np.maximum(north, east)


def chunk_centres(route: np.ndarray, size: float, half: float) -> np.ndarray:
    """Arc lengths of square boxes that cover a route (lat, lng) in turn.

    The route is sampled finely; a box is set as far ahead of the first uncovered sample as still leaves the
    wanted overlap, and covers the run of samples it holds."""
    step = haversine(route[:-1], route[1:])
    total = float(step.sum())
    if total <= size:
        return np.array([total / 2])
    fine, arcs = [route[:1]], [np.zeros(1)]
    done = 0.0
    for a, b, d in zip(route[:-1], route[1:], step):
        n = max(1, math.ceil(d / max(8.0, size / 32)))
        f = np.arange(1, n + 1) / n
        fine.append(a + (b - a) * f[:, None])
        arcs.append(done + d * f)
        done += d
    p, arc = np.concatenate(fine), np.concatenate(arcs)
    lead, out, at = max(1.0, size / 2 - overlap(size, half)), [], 0
    while at < len(p):
        ahead = np.flatnonzero(_reach(p[at:], p[at]) >= lead)
        centre = at + int(ahead[0]) if len(ahead) else len(p) - 1
        out.append(arc[centre])
        outside = np.flatnonzero(_reach(p[at:], p[centre]) > size / 2)
        at = max(at + 1, at + int(outside[0]) if len(outside) else len(p))
    return np.array(out)


def chunks(points: DataFrame, name: str = "standard", override: float | None = None) -> DataFrame:
    """route, chunk, lat, lng (centre), north, south, east, west, arc of routes (route, idx, lat, lng); one route a
    task."""
    size, half = chunk_size(name, override), tier(name)[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("idx")[["lat", "lng"]].to_numpy(float)
        if len(r) < 2:
            return pd.DataFrame(columns=["route", "chunk", "lat", "lng", "north", "south", "east", "west", "arc"])
        arc = np.concatenate([[0], np.cumsum(haversine(r[:-1], r[1:]))])
        at = chunk_centres(r, size, half)
        lat, lng = np.interp(at, arc, r[:, 0]), np.interp(at, arc, r[:, 1])
        dy, dx = size / 2 / DEGREE_M, size / 2 / (DEGREE_M * np.cos(np.radians(lat)))
        return pd.DataFrame({"route": pdf["route"].iloc[0], "chunk": range(len(at)), "lat": lat, "lng": lng, "north": lat + dy, "south": lat - dy, "east": lng + dx, "west": lng - dx, "arc": at})

    kind = dict(points.dtypes)["route"]
    return points.groupBy("route").applyInPandas(run, f"route {kind}, chunk int, lat double, lng double, north double, south double, east double, west double, arc double")


def stations(points: DataFrame, spacing: float, least: float) -> DataFrame:
    """route, n, x, y: places every `spacing` metres along lines (route, idx, x, y) that keep `least` metres from those
    kept before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("idx")[["x", "y"]].to_numpy(float)
        arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        at = np.arange(0, arc[-1] + 1e-9, spacing)
        s = np.column_stack([np.interp(at, arc, p[:, 0]), np.interp(at, arc, p[:, 1])])
        kept: list[np.ndarray] = []
        for q in s:
            if all((q - k) @ (q - k) >= least * least for k in kept):
                kept.append(q)
        k = np.array(kept)
        return pd.DataFrame({"route": pdf["route"].iloc[0], "n": range(len(k)), "x": k[:, 0], "y": k[:, 1]})

    return points.groupBy("route").applyInPandas(run, f"route {dict(points.dtypes)['route']}, n int, x double, y double")


def phase_floor(phase: Column) -> Column:
    out = F.lit(0)
    for name, share in PHASES:
        out = F.when(phase == name, share).otherwise(out)
    return out


def progress(events: DataFrame) -> DataFrame:
    """job, chunks, done, errors, active, percent of events (job, chunk, seq, phase, share): a chunk's fill never
    falls; the share of the bake counts between that phase's and the next one's start."""
    fill = F.when((F.col("phase") == "bake") & F.col("share").isNotNull(), F.floor(12 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share"))) * 80 + 0.5)).otherwise(phase_floor(F.col("phase")))
    per = events.groupBy("job", "chunk").agg(F.max_by("phase", "seq").alias("phase"), F.max(fill).alias("fill"))
    active = F.count_if(F.col("phase").isin("terrain", "bake", "encode"))
    out = per.groupBy("job").agg(F.count("*").alias("chunks"), F.count_if(F.col("phase") == "done").alias("done"), F.count_if(F.col("phase") == "error").alias("errors"), active.alias("active"), F.avg("fill").alias("a"))
    return out.select("job", "chunks", "done", "errors", "active", F.floor(F.col("a") + 0.5).alias("percent"))


# fixed values: part of the half width that side stations reach, half width of a ring of them, most rings
RING_SHARE, RING_M, MOST_RINGS = 0.85, 160.0, 3


def corridor_stations(points: DataFrame, half_width: float, spacing: float, extent: float, most: int) -> DataFrame:
    """route, n, sample, side, e, north, dir_e, dir_n of routes (route, idx, e, north in metres from the middle of a box): every
    `spacing` along the route, half of it in, and for wide corridors in rings to the left (side 1, 2, 3) and right (-1, -2, -3).

    Places beyond the box of `extent` metres go; of more than `most` an even selection stays, never the first ones only."""
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("idx")
    s = points.select("route", "idx", "e", "north", F.lead("e").over(w).alias("e2"), F.lead("north").over(w).alias("north2"))
    s = s.withColumn("len", F.coalesce(F.hypot(F.col("e2") - F.col("e"), F.col("north2") - F.col("north")), F.lit(0.0)))
    s = s.withColumn("arc", F.sum("len").over(w) - F.col("len")).where("len > 1e-6")
    lo, hi = F.ceil((F.col("arc") - spacing / 2) / spacing), F.ceil((F.col("arc") + F.col("len") - spacing / 2) / spacing) - 1
    s = s.withColumn("n0", F.greatest(F.lit(0), lo)).withColumn("n1", hi).where("n1 >= n0").withColumn("sample", F.explode(F.sequence("n0", "n1")))
    u, de, dn = (F.col("sample") * spacing + spacing / 2 - F.col("arc")) / F.col("len"), (F.col("e2") - F.col("e")) / F.col("len"), (F.col("north2") - F.col("north")) / F.col("len")
    rings = min(MOST_RINGS, math.floor(half_width / RING_M + 0.5))
    sides = [0, *[side * r for r in range(1, rings + 1) for side in (1, -1)]]
    s = s.select("route", "sample", (F.col("e") + (F.col("e2") - F.col("e")) * u).alias("e"), (F.col("north") + (F.col("north2") - F.col("north")) * u).alias("north"), de.alias("dir_e"), dn.alias("dir_n"))
    off = [half_width * x / rings * RING_SHARE if x else 0.0 for x in sides]
    at = lambda o: (F.col("e") - F.col("dir_n") * o, F.col("north") + F.col("dir_e") * o)
    inside = lambda o: F.when((F.abs(at(o)[0]) <= extent / 2) & (F.abs(at(o)[1]) <= extent / 2), 1).otherwise(0)
    # the places of a sample are counted before they are made, so what is sorted is samples, not places; bit k: the place at side k stays
    by_sample = Window.partitionBy("route").orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("mask", sum((inside(o) * 2**k for k, o in enumerate(off)), F.lit(0))).where("mask > 0")
    own = F.bit_count("mask")
    s = s.withColumn("first", F.sum(own).over(by_sample) - own).withColumn("total", F.sum(own).over(by_sample.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.lit(2**k).alias("bit"), F.lit(o).alias("off")) for k, (x, o) in enumerate(zip(sides, off))])).alias("o")
    s = s.select("*", side).where(F.col("mask").bitwiseAND(F.col("o.bit")) > 0)
    stride, n = F.greatest(F.lit(1.0), F.col("total") / most), F.col("first") + F.bit_count(F.col("mask").bitwiseAND(F.col("o.bit") - 1))
    s = s.withColumn("n", n.cast("int")).withColumn("stride", stride)
    taken = F.ceil(F.col("n") / F.col("stride") - 1e-9)
    s = s.where((F.floor(taken * F.col("stride") + 1e-9) == F.col("n")) & (taken < most))
    return s.select("route", "n", "sample", "o.side", at(F.col("o.off"))[0].alias("e"), at(F.col("o.off"))[1].alias("north"), "dir_e", "dir_n")


def route_frames(chunks_: DataFrame, size: float) -> DataFrame:
    """route, chunk, east, north, up, scale, and the route's min_x, max_x, min_z, max_z: chunks (route, chunk, lat, lng, low, units:
    scene units a metre) placed in metres from each route's first chunk; x runs east, z south."""
    from pyspark.sql import Window

    first = chunks_.groupBy("route").agg(F.min_by(F.struct("lat", "lng", F.coalesce("low", F.lit(0.0)).alias("low")), "chunk").alias("a"))
    c = chunks_.join(first, "route")
    wide = DEGREE_M * F.cos(F.radians("a.lat"))
    c = c.select("route", "chunk", ((F.col("lng") - F.col("a.lng")) * wide).alias("east"), ((F.col("lat") - F.col("a.lat")) * DEGREE_M).alias("north"), (F.coalesce("low", F.lit(0.0)) - F.col("a.low")).alias("up"), F.when(F.col("units") > 0, 1 / F.col("units")).otherwise(1.0).alias("scale"))
    w = Window.partitionBy("route")
    return c.select("*", (F.min("east").over(w) - size / 2).alias("min_x"), (F.max("east").over(w) + size / 2).alias("max_x"), (-F.max("north").over(w) - size / 2).alias("min_z"), (-F.min("north").over(w) + size / 2).alias("max_z"))


def spawn_places(roads: DataFrame, centres: DataFrame) -> DataFrame:
    """area, lat, lng of areas' centres (area, lat, lng), or of the nearest middle vertex of their roads (area, road, idx, lat, lng, highway)
    by degrees, ties to the smaller road; ways on foot don't count."""
    from geoloom.functions.tags import MASK_SKIP

    drivable = roads.where(~F.coalesce(F.col("highway").isin(*MASK_SKIP), F.lit(False)))
    size = drivable.groupBy("area", "road").agg(F.count("*").alias("n"))
    mids = drivable.join(size, ["area", "road"]).where("idx = floor(n / 2)").select("area", "road", F.col("lat").alias("mlat"), F.col("lng").alias("mlng"))
    near = mids.join(centres, "area").groupBy("area").agg(F.min_by(F.struct("mlat", "mlng"), F.struct(F.hypot(F.col("mlat") - F.col("lat"), F.col("mlng") - F.col("lng")), F.col("road"))).alias("m"))
    return centres.join(near, "area", "left").select("area", F.coalesce("m.mlat", "lat").alias("lat"), F.coalesce("m.mlng", "lng").alias("lng"))
