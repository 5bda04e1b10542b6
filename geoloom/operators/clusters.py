"""Junction polygons: rings around the ends of roads, clusters of rings that lie close, hulls of any number of points.

Links between boxes that overlap and between centres within a reach are found by squares of the plane.  A square that is
full is not compared pair by pair: where one box covers it whole, every box in it overlaps that one and a star of links says all;
centres in a square whose diagonal is within the reach are a star as well; other full squares are quartered until few are left in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import components
from .polylines import hulls, starts_of, whole_groups
from .shared import by_shuffle, hot_keys, join_hot, table

# fixed values: least arms of a junction, corners nearer than this are one, distance of centres and slack of boxes that make
# a cluster, heights that a cluster may span
LEAST_ARMS, SAME_CORNER, REACH, SLACK, MOST_Z = 3, 0.01, 15.0, 0.5, 1.5
#: Boxes or pairs of centres of a square that are compared one by one; side of the first squares of boxes; points of a part of a hull.
FEW, SIDE, PART = 64, 64.0, 20_000
_POINT = "struct<x:double,y:double,z:double>"


def rings_of_arms(arms: DataFrame) -> DataFrame:
    """node, ring, cx, cy, cz of arms (node, seg, end, x, y, z, dx, dy, half): where at least LEAST_ARMS arms with a direction (unit vector
    away from the node) end, the right and the left corner of each arm's end, arms by angle, then seg and end.  A corner that is
    as good as the one before it is joined to it at the mean height, the last one to the first as well; rings of fewer than three
    corners go.  c: mean of the corners."""
    arm = F.struct(F.atan2("dy", "dx").alias("angle"), "seg", "end", "x", "y", "z", "dx", "dy", "half")
    known = arms.where("x is not null and y is not null and z is not null and half is not null and (dx != 0 or dy != 0)")
    nodes = known.groupBy("node").agg(F.array_sort(F.collect_list(arm)).alias("arms")).where(F.size("arms") >= LEAST_ARMS)
    corner = lambda a, side: F.struct((a["x"] + side * a["dy"] * a["half"]).alias("x"), (a["y"] - side * a["dx"] * a["half"]).alias("y"), a["z"].alias("z"))
    corners = F.flatten(F.transform("arms", lambda a: F.array(corner(a, 1.0), corner(a, -1.0))))
    same = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])) < SAME_CORNER
    at_mean = lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((p["z"] + q["z"]) * 0.5).alias("z"))

    def add(ring: Column, p: Column) -> Column:
        last = F.try_element_at(ring, F.lit(-1))
        joined = F.concat(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.array(at_mean(last, p)))
        return F.when(F.coalesce(same(last, p), F.lit(False)), joined).otherwise(F.concat(ring, F.array(p)))

    rings = nodes.select("node", F.aggregate(corners, F.array().cast(f"array<{_POINT}>"), add).alias("r"))
    first, last = F.element_at("r", 1), F.element_at("r", -1)
    closed = F.concat(F.array(at_mean(first, last)), F.slice("r", 2, F.greatest(F.size("r") - 2, F.lit(0))))
    rings = rings.select("node", F.when((F.size("r") > 1) & same(first, last), closed).otherwise(F.col("r")).alias("ring"))
    return with_centre(rings.where(F.size("ring") > 2))


def with_centre(rings: DataFrame) -> DataFrame:
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c]) / F.size("ring")
    return rings.select("*", mean("x").alias("cx"), mean("y").alias("cy"), mean("z").alias("cz"))


def overlaps(boxes: DataFrame, side: float = SIDE) -> DataFrame:
    """a, b: links that join exactly the boxes (id, x0, y0, x1, y1) that overlap or touch, directly or by others."""
    at = lambda lo, hi, s: F.explode(F.sequence(F.floor(F.col(lo) / s).cast("long"), F.floor(F.col(hi) / s).cast("long")))
    boxes = boxes.select("id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    here = table(boxes.withColumn("qx", at("x0", "x1", side)).withColumn("qy", at("y0", "y1", side)), "boxes")
    found = []
    while True:
        x, y = F.col("qx") * side, F.col("qy") * side
        covers = (F.col("x0") <= x) & (F.col("y0") <= y) & (F.col("x1") >= x + side) & (F.col("y1") >= y + side)
        squares = table(here.groupBy("qx", "qy").agg(F.count("*").alias("n"), F.min(F.when(covers, F.col("id"))).alias("cover")).where("n > 1"), "squares")
        size = here.count()
        held = table(join_hot(here, squares, ["qx", "qy"], hot_keys(squares, ["qx", "qy"], size), size=size), "held")
        found.append(held.where("cover is not null and id != cover").select(F.col("id").alias("a"), F.col("cover").alias("b")))
        open_ = held.where("cover is null")
        # quartering squares below a millimetre would only follow edges that touch
        pairs = open_ if side < 1e-3 else open_.where(F.col("n") <= FEW)
        a, b = (pairs.select("qx", "qy", *[F.col(c).alias(p + c) for c in ("id", "x0", "y0", "x1", "y1")]) for p in "ab")
        meet = (F.col("aid") < F.col("bid")) & (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
        found.append(a.join(by_shuffle(b, size), ["qx", "qy"]).where(meet).select(F.col("aid").alias("a"), F.col("bid").alias("b")))
        full = open_.where(F.col("n") > FEW)
        if side < 1e-3 or not full.limit(1).count():
            break
        side /= 2
        inner = lambda lo, hi, q: F.explode(F.sequence(F.greatest(F.col(q) * 2, F.floor(F.col(lo) / side).cast("long")), F.least(F.col(q) * 2 + 1, F.floor(F.col(hi) / side).cast("long"))))  # noqa: E731, B023
        here = table(full.drop("n", "cover").withColumn("rx", inner("x0", "x1", "qx")).withColumn("ry", inner("y0", "y1", "qy")).drop("qx", "qy").withColumnsRenamed({"rx": "qx", "ry": "qy"}), "boxes")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct()


def within(points: DataFrame, reach: float = REACH) -> DataFrame:
    """a, b: links that join exactly the points (id, x, y) whose distance is at most reach, directly or by others."""
    points = table(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    # points of one place are one; a square's diagonal is within the reach
    places = table(points.groupBy("x", "y").agg(F.min("id").alias("first"), F.count("*").alias("n")), "places")
    size = points.count()
    hot = hot_keys(places, ["x", "y"], size)
    links = [join_hot(points, places.drop("n"), ["x", "y"], hot, size=size).where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))]
    places, side = places.select(F.col("first").alias("id"), "x", "y"), reach / 2**0.5 * (1 - 1e-9)
    square = lambda s: [F.floor(F.col("x") / s).cast("long").alias("qx"), F.floor(F.col("y") / s).cast("long").alias("qy")]
    dealt = places.select("*", *square(side))
    cells = table(dealt.groupBy("qx", "qy").agg(F.count("*").alias("n"), F.min("id").alias("least")), "cells")
    size = places.count()
    stars = join_hot(dealt, cells.drop("n"), ["qx", "qy"], hot_keys(cells, ["qx", "qy"], size), size=size)
    links.append(stars.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half]))
    near = cells.select("qx", "qy", "n", "least", step.alias("s")).select("qx", "qy", "n", "least", (F.col("qx") + F.col("s.i")).alias("rx"), (F.col("qy") + F.col("s.j")).alias("ry"))
    pairs = near.join(by_shuffle(cells.select(F.col("qx").alias("rx"), F.col("qy").alias("ry"), F.col("n").alias("m"), F.col("least").alias("other")), size), ["rx", "ry"])
    while True:
        gap = lambda p, q: F.greatest(F.abs(F.col(p) - F.col(q)) - 1, F.lit(0)) * side  # noqa: E731, B023
        span = lambda p, q: (F.abs(F.col(p) - F.col(q)) + 1) * side  # noqa: E731, B023
        least, most = (f("qx", "rx") * f("qx", "rx") + f("qy", "ry") * f("qy", "ry") for f in (gap, span))
        judged = table(pairs.withColumn("least2", least).withColumn("most2", most).where(F.col("least2") <= reach * reach * (1 + 1e-9)), "pairs")
        sure = F.col("most2") <= reach * reach * (1 - 1e-9)
        links.append(judged.where(sure).select(F.col("least").alias("a"), F.col("other").alias("b")))
        few = judged.where(~sure & (F.col("n") * F.col("m") <= FEW * FEW))
        dealt = places.select("*", *square(side))
        one = few.join(by_shuffle(dealt, size), ["qx", "qy"]).select("qx", "qy", "rx", "ry", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        two = dealt.select(F.col("qx").alias("rx"), F.col("qy").alias("ry"), F.col("id").alias("b"), "x", "y")
        d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
        links.append(one.join(by_shuffle(two, size), ["rx", "ry"]).where(d2 <= reach * reach).select("a", "b"))
        full = judged.where(~sure & (F.col("n") * F.col("m") > FEW * FEW))
        if not full.limit(1).count():
            break
        # both squares of a full pair are quartered
        side /= 2
        parts = places.select("*", *square(side)).groupBy("qx", "qy").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        up = lambda c: F.floor(F.col(c) / 2).cast("long")
        mine = parts.select(up("qx").alias("qx"), up("qy").alias("qy"), F.col("qx").alias("ax"), F.col("qy").alias("ay"), F.col("n").alias("an"), F.col("least").alias("al"))
        other = parts.select(up("qx").alias("rx"), up("qy").alias("ry"), F.col("qx").alias("bx"), F.col("qy").alias("by"), F.col("n").alias("bn"), F.col("least").alias("bl"))
        both = full.select("qx", "qy", "rx", "ry").join(by_shuffle(mine, size), ["qx", "qy"]).join(by_shuffle(other, size), ["rx", "ry"])
        pairs = both.select(F.col("ax").alias("qx"), F.col("ay").alias("qy"), F.col("bx").alias("rx"), F.col("by").alias("ry"), F.col("an").alias("n"), F.col("bn").alias("m"), F.col("al").alias("least"), F.col("bl").alias("other"))
    whole = links[0]
    for more in links[1:]:
        whole = whole.union(more)
    return whole.distinct()


def _chain(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of points (x, y, z) from the leftmost, the lower of these first; of points of one place the highest counts,
    points on an edge don't."""
    return p[hulls(p[:, 0], p[:, 1], np.array([len(p)]), p[:, 2])[0]]


def hull_rings(points: DataFrame, key: str) -> DataFrame:
    """key, ring: the convex hull of each key's points (key, x, y, z), all in one row.  Points of a key of more than PART are dealt to parts, whose
    hulls come first, so a task holds a part or the hulls of a key's parts, never all its points.  A batch of points of many keys is one step."""
    kind = dict(points.dtypes)[key]
    points = table(points.where(F.col(key).isNotNull()).select(key, *[F.col(c).cast("double").alias(c) for c in "xyz"]), "points")
    # a key that is in here has more than PART points, so it is a small share of them
    full = table(points.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PART), "full")

    def corners(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        for rows, n in whole_groups(batches, keys):
            at, n = hulls(*[rows.column(c).to_numpy() for c in "xy"], n, rows.column("z").to_numpy())
            yield rows.take(at), n

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in corners(batches, [key, "part"]):
            yield from rows.select([key, "x", "y", "z"]).to_batches()

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in corners(batches, [key]):
            p = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in "xyz"], names=list("xyz"))
            rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), p)
            yield pa.RecordBatch.from_arrays([rows.column(key).combine_chunks().take(pa.array(starts_of(n))), rings], names=[key, "ring"])

    whole = points
    if full.limit(1).count():
        n = F.broadcast(full)
        dealt = points.join(n, key).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n") / PART)).cast("int")).drop("n")
        parts = dealt.repartition(key, "part").sortWithinPartitions(key, "part").mapInArrow(flat, f"{key} {kind}, x double, y double, z double")
        whole = points.join(n, key, "left_anti").union(parts)
    return whole.repartition(key).sortWithinPartitions(key).mapInArrow(ring, f"{key} {kind}, ring array<{_POINT}>")


def clustered(rings: DataFrame, reach: float = REACH, slack: float = SLACK, most_z: float = MOST_Z) -> DataFrame:
    """cluster, members, ring, cx, cy, cz: rings (id, ring of x, y, z) that belong together as one convex ring.  Rings belong
    together if their boxes, each wider by slack on every side, meet or their centres (means of points) are within reach, directly or by
    others.  Members whose points together span more than most_z in height stay apart, each as its own hull, so roads on unlike
    levels don't join.  cluster: least id of the members.  Hulls of fewer than three points go."""
    rings = table(with_centre(rings.select("id", "ring").where(F.size("ring") > 0)), "rings")
    end = lambda f, c, s: (f(F.transform("ring", lambda p: p[c])) + s)
    boxes = rings.select("id", end(F.array_min, "x", -slack).alias("x0"), end(F.array_min, "y", -slack).alias("y0"), end(F.array_max, "x", slack).alias("x1"), end(F.array_max, "y", slack).alias("y1"))
    links = overlaps(boxes).union(within(rings.select("id", F.col("cx").alias("x"), F.col("cy").alias("y")), reach))
    labels = table(components(links).withColumnRenamed("node", "id"), "labels")
    heights = rings.select("id", F.array_min(F.transform("ring", lambda p: p["z"])).alias("z0"), F.array_max(F.transform("ring", lambda p: p["z"])).alias("z1"), "ring")
    size = rings.count()
    own = table(heights.join(by_shuffle(labels, size), "id", "left").withColumn("label", F.coalesce("label", "id")), "own")
    spans = table(own.groupBy("label").agg(F.min("z0").alias("lo"), F.max("z1").alias("hi"), F.count("*").alias("n")), "spans")
    judged = join_hot(own, spans, ["label"], hot_keys(spans, ["label"], size), size=size)
    flat = F.col("hi") - F.col("lo") <= most_z
    judged = judged.select("id", F.when(flat, F.col("label")).otherwise(F.col("id")).alias("cluster"), F.when(flat, F.col("n")).otherwise(1).alias("members"), "ring")
    judged = table(judged, "judged")
    found = hull_rings(judged.select("cluster", F.explode("ring").alias("p")).select("cluster", "p.x", "p.y", "p.z"), "cluster")
    out = with_centre(found.where(F.size("ring") > 2))
    return out.join(by_shuffle(judged.groupBy("cluster").agg(F.max("members").alias("members")), size), "cluster").select("cluster", "members", "ring", "cx", "cy", "cz")
