"""Batch tiles: grids, job states, stage timings, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.crs import DEGREE_M
from geoloom.functions.scalars import js_round, number_text, round_to, tile_label

from .shared import table

# fixed values: states and score weights
JOB_STATES = ("pending", "running", "paused", "canceled", "completed", "failed")
TILE_STATES = ("queued", "processing", "done", "failed", "skipped")
LEGACY_JOB = {"idle": "pending", "completed_with_errors": "completed"}
LEGACY_TILE = {"pending": "queued", "completed": "done"}
SECOND_W, GIB_W, FAILURE_W, WAIT_W, RISK_GIB = 1.0, 120.0, 900.0, 0.25, 2.2


def stage_timings(samples: DataFrame) -> DataFrame:
    """stage, count, avg_ms, median_ms, max_ms of samples (tile, stage, ms), whole milliseconds."""
    from .grid import rank_values

    some = samples.select("stage", F.coalesce(F.col("ms"), F.lit(0.0)).alias("ms"))
    out = some.groupBy("stage").agg(F.count("*").alias("count"), F.avg("ms").alias("a"), F.max("ms").alias("x"))
    out = out.join(rank_values(some, ["stage"], "ms", {"m": (0.5, "linear")}), "stage")
    return out.select("stage", "count", js_round(F.col("a")).alias("avg_ms"), js_round(F.col("m")).alias("median_ms"), js_round(F.col("x")).alias("max_ms"))


def slowest_tiles(samples: DataFrame, k: int = 1) -> DataFrame:
    """The k tiles with the greatest sums, ties to the smaller tile."""
    total = samples.groupBy("tile").agg(F.sum("ms").alias("ms"))
    return total.orderBy(F.desc("ms"), "tile").limit(k).select("tile", js_round(F.col("ms")).alias("total_ms"))


def score(duration_s: Column, peak_bytes: Column, failures: Column, wait_s: Column) -> Column:
    """Lower is better."""
    return js_round(duration_s * SECOND_W + peak_bytes / 2**30 * GIB_W + failures * FAILURE_W + wait_s * WAIT_W)


def recommendation(failures: Column, peak_bytes: Column) -> Column:
    return F.when(failures > 0, "unstable").when(peak_bytes / 2**30 > RISK_GIB, "memory_risk").otherwise("good")


def job_scores(tiles: DataFrame) -> DataFrame:
    """One row a job of tiles (job, status, started, ended, peak_bytes, wait_ms): counts, score."""
    fails = F.count_if(F.col("status") == "failed")
    out = tiles.groupBy("job").agg(
        F.count("*").alias("tiles"), F.count_if(F.col("status") == "done").alias("done"), fails.alias("failed"),
        (F.max("ended") - F.min("started")).alias("duration_s"), F.max("peak_bytes").alias("peak_bytes"), (F.sum("wait_ms") / 1000).alias("wait_s"),
    )
    out = out.withColumn("score", score(F.col("duration_s"), F.col("peak_bytes"), F.col("failed"), F.col("wait_s")))
    return out.withColumn("recommendation", recommendation(F.col("failed"), F.col("peak_bytes")))


def valid_state(col: Column, states=TILE_STATES) -> Column:
    return F.coalesce(col.isin(*states), F.lit(False))


def repaired_state(col: Column, states, legacy: dict, default: str) -> Column:
    out = F.lit(default)
    for old, new in legacy.items():
        out = F.when(col == old, new).otherwise(out)
    return F.when(valid_state(col, states), col).otherwise(out)


def scheduler(resolution: Column, profile: Column, heavy: Column) -> Column:
    """struct(profile, fetch, tiles, interval_ms) of a job: as asked for, else by resolution; heavy: it exports
    meshes or map textures."""
    row = lambda name, fetch, tiles, ms: F.struct(F.lit(name).alias("profile"), (fetch if isinstance(fetch, Column) else F.lit(fetch)).alias("fetch"), (tiles if isinstance(tiles, Column) else F.lit(tiles)).alias("tiles"), F.lit(ms).alias("interval_ms"))
    pick = lambda cond, a, b: F.when(cond, a).otherwise(b)
    high = resolution >= 8192
    return (
        F.when(profile == "throughput", row("throughput", pick(high, 3, 4), pick(high, 12, 20), 550))
        .when(profile == "low_memory", row("low_memory", pick(resolution >= 4096, 1, 2), pick(high, 6, 8), 900))
        .when(high, row("highres_8192", 2, pick(heavy, 8, 10), 750))
        .when(resolution >= 4096, row("highres_4096", 3, 12, 650))
        .otherwise(row("balanced", 4, 20, 600))
    )


def last_states(events: DataFrame) -> DataFrame:
    """key -> the latest state of events (key, at, seq, state) and how many there were."""
    last = F.max_by("state", F.struct("at", "seq"))
    return events.groupBy("key").agg(last.alias("state"), F.count("*").alias("steps"))


def grid_tiles(jobs: DataFrame) -> DataFrame:
    """Tiles of grids (job, lat, lng, size_m, cols, rows): row, col, index, label and bounds.

    Columns run east, rows south; all tiles of a grid use its centre's length of a degree."""
    cells = jobs.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    dlat, dlng = F.col("size_m") / DEGREE_M, F.col("size_m") / (DEGREE_M * F.cos(F.radians("lat")))
    clat = F.col("lat") + ((F.col("rows") - 1) / 2 - F.col("row")) * dlat
    clng = F.col("lng") + (F.col("col") - (F.col("cols") - 1) / 2) * dlng
    index = F.col("row") * F.col("cols") + F.col("col")
    return cells.select("job", "row", "col", index.alias("index"), tile_label(index, F.col("cols")).alias("label"), clat.alias("lat"), clng.alias("lng"), (clat + dlat / 2).alias("north"), (clat - dlat / 2).alias("south"), (clng + dlng / 2).alias("east"), (clng - dlng / 2).alias("west"))


def with_offsets(tiles: DataFrame, offsets: DataFrame) -> DataFrame:
    """Tiles moved by offsets (job, index, seq, dx, dy) in metres; of repeated ones the last counts."""
    last = offsets.groupBy("job", "index").agg(F.max_by(F.struct("dx", "dy"), "seq").alias("o"))
    joined = tiles.join(last, ["job", "index"], "left")
    zero = lambda x: F.coalesce(F.col(f"o.{x}"), F.lit(0.0))
    return joined.withColumn("lat", F.col("lat") + zero("dy") / DEGREE_M).withColumn("lng", F.col("lng") + zero("dx") / (DEGREE_M * F.cos(F.radians("lat")))).drop("o")


def normalization(tiles: DataFrame) -> DataFrame:
    """One row a job: the range of heights over all its tiles, null where there is none."""
    r = tiles.groupBy("job").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ok = F.col("hi") > F.col("lo")
    return r.select("job", F.when(ok, F.col("lo")).alias("lo"), F.when(ok, F.col("hi")).alias("hi"))


def elevation_report(tiles: DataFrame) -> DataFrame:
    """One row a job: counts, extremes and the tiles that hold them, and the lines of the report."""
    line = F.concat_ws(" ", "label", number_text(F.col("lo"), 2), number_text(F.col("hi"), 2))
    out = tiles.groupBy("job").agg(
        F.count("*").alias("tiles"), F.min("lo").alias("lowest"), F.min_by("label", F.struct("lo", "label")).alias("lowest_tile"), F.max("hi").alias("highest"),
        F.max_by("label", F.struct("hi", "label")).alias("highest_tile"), F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"),
    )
    return out.withColumn("range", round_to(F.col("highest") - F.col("lowest"), 2))


def newest_within(entries: DataFrame, cap: int) -> DataFrame:
    """Cache entries (bucket, key, at) that stay: the newest `cap` of each bucket."""
    w = Window.partitionBy("bucket").orderBy(F.desc("at"), F.desc("key"))
    return entries.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def newest_within_bytes(entries: DataFrame, most: int) -> DataFrame:
    """Cache entries (bucket, key, at, bytes) that stay: the newest whose sizes sum to at most `most`; of one time the greater key is newer.

    Entries are dealt by ranges of (bucket, time, key) from the newest on, which are cut where the rows are, and written; the ranges' sums tell what is newer
    than a range, and a range that begins beyond `most` isn't looked into.  So no task holds a bucket, nor a burst of one time."""
    order = [F.col("bucket"), F.desc("at"), F.desc("key")]
    some = table(entries.repartitionByRange(*order).withColumn("_span", F.spark_partition_id()), "spans")
    newer = Window.partitionBy("bucket").orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)
    sums = some.groupBy("bucket", "_span").agg(F.sum("bytes").alias("_b")).withColumn("_before", F.sum("_b").over(newer) - F.col("_b"))
    kept = some.join(sums.where(F.col("_before") <= most).select("bucket", "_span", "_before"), ["bucket", "_span"])
    own = Window.partitionBy("bucket", "_span").orderBy(F.desc("at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("_total", F.col("_before") + F.sum("bytes").over(own)).where(F.col("_total") <= most).drop("_total", "_before", "_span")


def remaining_ms(done: DataFrame) -> DataFrame:
    """job, left_ms: mean of the finished tiles' ms times the number of unfinished ones, of tiles (job, seq, status, ms).

    Milliseconds are added in the order of seq, so a half is rounded alike however the rows are dealt; a job's rows are sorted and
    streamed, never held."""
    ms = F.when(F.col("status") == "done", F.col("ms"))
    so_far = Window.partitionBy("job").orderBy("seq", ms).rowsBetween(Window.unboundedPreceding, 0)
    run = done.select("job", F.row_number().over(Window.partitionBy("job").orderBy("seq", ms)).alias("n"), F.avg(ms).over(so_far).alias("mean"), F.col("status").isin("queued", "processing").alias("left"))
    out = run.groupBy("job").agg(F.max_by("mean", "n").alias("mean"), F.count_if("left").alias("left"))
    return out.select("job", js_round(F.col("mean") * F.col("left")).alias("left_ms"))


def number_key(x: Column, places: int) -> Column:
    """A rounded number as text without a trailing zero part."""
    return F.regexp_replace(round_to(x, places).cast("string"), r"\.0$", "")


def tile_ids(tiles: DataFrame) -> DataFrame:
    """tiles (job, row, col, lat, lng, north, south, east, west) with `tile`, a key that follows from the job, the place
    and the bounds to six places."""
    from geoloom.functions.scalars import fnv1a_hex

    text = lambda c: F.col(c).cast("string")
    key = F.concat_ws("|", text("job"), text("row"), text("col"), *[number_key(F.col(c), 6) for c in ("lat", "lng", "north", "south", "east", "west")])
    return tiles.withColumn("tile", F.concat(F.lit("tile_"), fnv1a_hex(key)))


def combinations(spark, options: dict[str, list]) -> DataFrame:
    """One row for each combination of a few options' values."""
    from itertools import product

    return spark.createDataFrame(list(product(*options.values())), list(options))


def reset_failed(tiles: DataFrame) -> DataFrame:
    """tiles (status, error, attempts) ready to run again: failed ones are queued without an error or attempts."""
    bad = F.coalesce(F.col("status") == "failed", F.lit(False))
    out = {"status": F.when(bad, "queued").otherwise(F.col("status")), "error": F.when(~bad, F.col("error")), "attempts": F.when(bad, 0).otherwise(F.col("attempts"))}
    return tiles.withColumns(out)


def tile_names(names: DataFrame, cols: int, most: int) -> DataFrame:
    """index, name of tiles (index, name) below `most` that have a name of their own: trimmed, not empty, not the default label."""
    out = names.select("index", F.trim("name").alias("name")).where(F.col("index").between(0, most - 1))
    return out.where((F.col("name") != "") & (F.col("name") != tile_label(F.col("index"), F.lit(cols))))
