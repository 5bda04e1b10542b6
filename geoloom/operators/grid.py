"""Rasters as rows (y, x, h), null where there is no data: summaries, windows, samples, mosaics.

Neighbourhoods along one axis are window frames; those along both are sums of shifted cells keyed by
the cell they reach, so a raster's rows need no common task.  Cells are whole numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

from geoloom.functions.scalars import clamp


def coverage(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cells, holes, share of holes, extremes."""
    hole = F.col("h").isNull() | F.isnan("h")
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(hole).alias("holes"), F.avg(hole.cast("int")).alias("hole_share"), F.min(F.when(~hole, F.col("h"))).alias("lowest"), F.max(F.when(~hole, F.col("h"))).alias("highest"))


#: Cells along an axis that one task's window holds.
BLOCK = 4096


def around(cells: DataFrame, axis: str, reach: int, aggregates: dict, by: list[str] = ()) -> DataFrame:
    """cells with aggregates (name -> from a window of them to a column) over the cells within `reach` along x or y, for each
    raster (`by`).  An axis is cut into blocks of BLOCK cells that also hold `reach` cells beyond both ends, so
    that no task holds a whole row or column."""
    other, at = ("y" if axis == "x" else "x"), lambda d: F.floor((F.col(axis) + d) / BLOCK)
    held = cells.withColumn("_block", F.explode(F.sequence(at(-reach), at(reach))))
    w = Window.partitionBy(*by, other, "_block").orderBy(axis).rangeBetween(-reach, reach)
    for name, make in aggregates.items():
        held = held.withColumn(name, make(w))
    return held.where(F.col("_block") == at(0)).drop("_block")


def blur_axis(cells: DataFrame, axis: str, radius: int, by: list[str] = ()) -> DataFrame:
    """Mean over a frame along x or y that leaves holes out; holes stay."""
    near = around(cells.select(*by, "y", "x", "h"), axis, radius, {"_m": lambda w: F.avg("h").over(w)}, by)
    return near.select(*by, "y", "x", F.when(F.col("h").isNotNull(), F.col("_m")).alias("h"))


def smooth(cells: DataFrame, radius: int = 8, rounds: int = 2, by: list[str] = ()) -> DataFrame:
    for _ in range(rounds):
        cells = blur_axis(blur_axis(cells, "x", radius, by), "y", radius, by)
    return cells


def mean_3x3(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean of the known values of the 3 x 3 cells; also fills holes that have a known neighbour.  All cells of the
    raster are listed, holes as null."""
    rows = around(cells.select(*by, "y", "x", "h"), "x", 1, {"_s": lambda w: F.sum("h").over(w), "_n": lambda w: F.count("h").over(w)}, by)
    both = around(rows.drop("h"), "y", 1, {"_t": lambda w: F.sum("_s").over(w), "_k": lambda w: F.sum("_n").over(w)}, by)
    return both.select(*by, "y", "x", F.when(F.col("_k") > 0, F.col("_t") / F.col("_k")).alias("h"))


def suppress_spikes(cells: DataFrame, least: int = 5, floor: float = 8.0, times: float = 6.0, most: float = 12000.0) -> DataFrame:
    """Inner cells that stray from the upper median of their 3 x 3 cells by more than `times` the median
    deviation (`floor` at least), or beyond `most`, take the median.  All cells of the raster are listed."""
    upper = lambda a: F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))
    y0, y1, x0, x1 = cells.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    rows = around(cells.select("y", "x", "h"), "x", 1, {"_a": lambda w: F.collect_list("h").over(w)})
    near = around(rows, "y", 1, {"_b": lambda w: F.collect_list("_a").over(w)}).withColumn("a", F.sort_array(F.flatten("_b")))
    near = near.withColumn("m", F.when(F.size("a") > 0, upper(F.col("a"))))
    near = near.withColumn("d", F.when(F.size("a") > 0, upper(F.sort_array(F.transform("a", lambda v: F.abs(v - F.col("m")))))))
    inner = (F.col("y") > F.lit(y0)) & (F.col("y") < F.lit(y1)) & (F.col("x") > F.lit(x0)) & (F.col("x") < F.lit(x1))
    off = inner & (F.size("a") >= least) & ((F.abs(F.col("h") - F.col("m")) > F.greatest(F.lit(floor), F.col("d") * times)) | (F.abs("h") > most))
    return near.select("y", "x", F.when(off, F.col("m")).otherwise(F.col("h")).alias("h"))


def sample_bilinear(cells: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """points (id, px, py in cells) with h; a missing neighbour makes it null.  Clamped to the raster."""
    x, y = clamp(F.col("px"), 0.0, width - 1.0), clamp(F.col("py"), 0.0, height - 1.0)
    p = points.select("id", x.alias("_x"), y.alias("_y"))
    x0, y0 = F.floor("_x").cast("int"), F.floor("_y").cast("int")
    p = p.select("id", x0.alias("x0"), y0.alias("y0"), (F.col("_x") - x0).alias("fx"), (F.col("_y") - y0).alias("fy"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("c")
    q = p.select("id", "x0", "y0", "fx", "fy", corner)
    weight = F.when(F.col("c.a") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("c.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    q = q.select("id", F.least(F.col("y0") + F.col("c.a"), F.lit(height - 1)).cast("bigint").alias("y"), F.least(F.col("x0") + F.col("c.b"), F.lit(width - 1)).alias("x"), weight.alias("w"))
    got = q.join(cells, ["y", "x"], "left").groupBy("id").agg(F.sum(F.col("h") * F.col("w")).alias("s"), F.count("h").alias("n"))
    return got.select("id", F.when(F.col("n") == 4, F.col("s")).alias("h"))


def halved(cells: DataFrame) -> DataFrame:
    """Mean of the known values of 2 x 2 cells."""
    half = lambda c: F.floor(F.col(c) / 2).cast("bigint").alias(c)
    return cells.groupBy(half("y"), half("x")).agg(F.avg("h").alias("h"))


def push_pull(cells: DataFrame, levels: int) -> DataFrame:
    """Holes take the value of the finest coarser level that knows one (2 x 2 means, level by level)."""
    out, coarse = cells, cells
    for n in range(1, levels + 1):
        coarse = halved(coarse)
        up = coarse.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("h").alias("_h"))
        key = lambda c: F.floor(F.col(c) / 2**n).cast("bigint")  # noqa: B023, E731
        out = out.join(up, (key("y") == F.col("_y")) & (key("x") == F.col("_x")), "left").select("y", "x", F.coalesce("h", "_h").alias("h"))
    return out


def quantised(h: Column, lo: Column, hi: Column, steps: int = 65535) -> Column:
    """Whole steps of a height range, cut off at its ends; holes are 0."""
    t = F.when(hi > lo, (F.coalesce(h, lo) - lo) / (hi - lo)).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(t * steps))).cast("int")


def cropped(cells: DataFrame, y0: int, x0: int, size: int) -> DataFrame:
    inside = F.col("y").between(y0, y0 + size - 1) & F.col("x").between(x0, x0 + size - 1)
    return cells.where(inside).select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "h")


def mosaic(layers: DataFrame, last_wins: bool = True) -> DataFrame:
    """layers (layer, y, x, h): of overlapping cells the last layer's (or the first's) known value."""
    pick = F.max_by if last_wins else F.min_by
    known = F.when(F.col("h").isNotNull(), F.col("layer"))
    return layers.groupBy("y", "x").agg(pick("h", known).alias("h"))


def scatter_medians(samples: DataFrame, cell: float) -> DataFrame:
    """cx, cz, value, n: the median of scattered samples (x, z, value) in square cells."""
    at = lambda c: F.floor(F.col(c) / cell).alias("c" + c)
    return samples.groupBy(at("x"), at("z")).agg(F.median("value").alias("value"), F.count("*").alias("n"))


def gridded_points(points: DataFrame, classes: tuple[int, ...], min_x: float, min_y: float, step_x: float, step_y: float, width: int, height: int) -> DataFrame:
    """Mean height of a point cloud's cells (x, y, z, class), rows from the north; cells without a
    point of the classes aren't listed."""
    cx = F.floor((F.col("x") - min_x) / step_x).cast("int")
    cy = F.floor((F.col("y") - min_y) / step_y).cast("int")
    kept = points.where(F.col("class").isin(*classes)).select((height - 1 - cy).alias("row"), cx.alias("col"), "z").where(f"row between 0 and {height - 1} and col between 0 and {width - 1}")
    return kept.groupBy("row", "col").agg(F.avg("z").alias("h"), F.count("*").alias("n"))


#: Distinct values of a group up to which one task ranks it.
GROUP_VALUES = 500_000


def rank_values(rows: DataFrame, by: list[str], col: str, picks: dict[str, tuple[float, str]]) -> DataFrame:
    """by and, for each pick (share, rule), the value at that rank of the group's values: floor_n (n * share), floor_n1
    ((n - 1) * share), both rounded down, or linear between the two values around (n - 1) * share.  Nulls and NaNs don't count; infinities do.

    Values are counted first, so equal ones are one row.  If a group has more than GROUP_VALUES unlike ones, all are dealt by ranges of
    (group, value), which are cut where the rows are, and written; counts of the ranges lead to the ranges that hold a rank, and only these
    are looked into.  So no task holds a group, however its values are spread."""
    v = F.col(col).cast("double")
    counted = rows.where(F.col(col).isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    counted = counted.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True)))
    size = counted.groupBy(*by).agg(F.sum("_c").alias("_size"))
    most = counted.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= GROUP_VALUES:
        parted = counted.withColumn("_part", F.lit(0))
    else:
        parted = table(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    in_order = Window.partitionBy(*by).orderBy("_part")
    counts = parted.groupBy(*by, "_part").agg(F.sum("_c").alias("_c")).withColumn("_first", F.sum("_c").over(in_order) - F.col("_c"))
    wanted = []
    for name, (share, rule) in picks.items():
        n, whole = F.col("_size"), F.lit(1.0)
        at = {"floor_n": F.floor(n * share), "floor_n1": F.floor((n - 1) * share)}.get(rule)
        if at is None:
            place = (n - 1) * F.lit(share)
            lo, rest = F.floor(place), place - F.floor(place)
            wanted += [F.struct(F.lit(name).alias("name"), lo.alias("rank"), (1 - rest).alias("w")), F.struct(F.lit(name).alias("name"), F.least(lo + 1, n - 1).alias("rank"), rest.alias("w"))]
        else:
            wanted.append(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(n - 1, at)).alias("rank"), whole.alias("w")))
    asked = size.select(*by, F.explode(F.array(*wanted)).alias("p")).select(*by, F.col("p.name").alias("_name"), F.col("p.rank").alias("_rank"), F.col("p.w").alias("_w"))
    # a rank without weight would turn an infinity beside the wanted one into NaN
    hits = asked.where("_w > 0").join(counts, by).where("_rank >= _first and _rank < _first + _c").select(*by, "_part", "_name", "_rank", "_w", "_first")
    inside = parted.join(hits.select(*by, "_part").distinct(), [*by, "_part"], "left_semi") if most > GROUP_VALUES else parted
    inside = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    got = hits.join(inside.select(*by, "_part", "_v", "_c", "_upto"), [*by, "_part"]).where("_rank - _first >= _upto - _c and _rank - _first < _upto")
    return got.groupBy(*by).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_v") * F.col("_w"))).alias(name) for name in picks])


def highest(cells: DataFrame, by: list[str]) -> DataFrame:
    """The highest cell of each group, of equal ones the first by row and column."""
    best = F.min_by(F.struct("y", "x", "h"), F.struct((-F.col("h")).alias("d"), "y", "x"))
    return cells.where("h is not null").groupBy(*by).agg(best.alias("b")).select(*by, *[F.col(f"b.{c}").alias(f"top_{c}") for c in ("y", "x", "h")])
