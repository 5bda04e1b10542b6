"""Queries of batch tiles, job states and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import batch

from .registry import query
from .views import read


def _samples(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("tile"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))


@query("stage_timings", """
SELECT event_type AS stage, count(*) AS count, CAST(floor(avg(value) + 0.5) AS BIGINT) AS avg_ms, CAST(floor(median(value) + 0.5) AS BIGINT) AS median_ms,
       CAST(floor(max(value) + 0.5) AS BIGINT) AS max_ms FROM events GROUP BY event_type""")
def stage_timings(spark, sf):
    return batch.stage_timings(_samples(spark, sf))


@query("slowest_tiles", """
SELECT user_id AS tile, CAST(floor(sum(value) + 0.5) AS BIGINT) AS total_ms FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 10""")
def slowest_tiles(spark, sf):
    return batch.slowest_tiles(_samples(spark, sf), 10)


@query("job_scores", """
WITH j AS (SELECT l_orderkey % 200 AS job, count(*) AS tiles, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS failed,
 max(l_partkey) - min(l_suppkey) AS duration_s, max(CAST(l_extendedprice * 40000 AS BIGINT)) AS peak_bytes, sum(l_quantity * 20) / 1000 AS wait_s FROM lineitem GROUP BY 1)
SELECT *, CAST(floor(duration_s + peak_bytes / 1073741824 * 120 + failed * 900 + wait_s * 0.25 + 0.5) AS BIGINT) AS score,
 CASE WHEN failed > 0 THEN 'unstable' WHEN peak_bytes / 1073741824 > 2.2 THEN 'memory_risk' ELSE 'good' END AS recommendation FROM j""")
def job_scores(spark, sf):
    status = F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "R", "failed").otherwise("queued")
    t = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("job"), status.alias("status"), F.col("l_suppkey").alias("started"), F.col("l_partkey").alias("ended"), F.round(F.col("l_extendedprice") * 40000).cast("bigint").alias("peak_bytes"), (F.col("l_quantity") * 20).alias("wait_ms"))
    return batch.job_scores(t)


@query("job_states", """
SELECT o_orderkey AS id, CASE WHEN s IN ('pending', 'running', 'paused', 'canceled', 'completed', 'failed') THEN s WHEN s = 'completed_with_errors' THEN 'completed' ELSE 'pending' END AS state,
 s IN ('queued', 'processing', 'done', 'failed', 'skipped') AS tile_state
FROM (SELECT *, ['pending', 'completed_with_errors', 'idle', 'x', 'done', 'running', 'failed'][o_orderkey % 7 + 1] AS s FROM orders)""")
def job_states(spark, sf):
    names = ("pending", "completed_with_errors", "idle", "x", "done", "running", "failed")
    s = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), batch.repaired_state(s, batch.JOB_STATES, batch.LEGACY_JOB, "pending").alias("state"), batch.valid_state(s).alias("tile_state"))


@query("last_states", "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS state, count(*) AS steps FROM events GROUP BY user_id")
def last_states(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return batch.last_states(e)


_GRID = """SELECT c_custkey AS job, 40 + c_custkey % 20 AS lat, 5 + c_custkey % 10 AS lng, 1024 AS size_m, 1 + c_custkey % 4 AS cols, 1 + c_custkey % 3 AS rows FROM customer"""


@query("grid_tiles", f"""
WITH t AS (SELECT *, unnest(range(0, cols)) AS col FROM (SELECT *, unnest(range(0, rows)) AS row FROM ({_GRID}))),
c AS (SELECT *, size_m / 111320 AS dlat, size_m / (111320 * cos(radians(lat))) AS dlng FROM t),
d AS (SELECT *, lat + ((rows - 1) / 2 - row) * dlat AS clat, lng + (col - (cols - 1) / 2) * dlng AS clng FROM c)
SELECT job, row, col, row * cols + col AS index, printf('R%dC%d', row + 1, col + 1) AS label, round(clat, 6) AS lat, round(clng, 6) AS lng, round(clat + dlat / 2, 6) AS north, round(clat - dlat / 2, 6) AS south, round(clng + dlng / 2, 6) AS east, round(clng - dlng / 2, 6) AS west FROM d""")
def grid_tiles(spark, sf):
    k = F.col("c_custkey")
    jobs = read(spark, sf, "customer").select(k.alias("job"), (40 + k % 20).alias("lat"), (5 + k % 10).alias("lng"), F.lit(1024).alias("size_m"), (1 + k % 4).cast("int").alias("cols"), (1 + k % 3).cast("int").alias("rows"))
    t = batch.grid_tiles(jobs)
    return t.select("job", "row", "col", "index", "label", *[F.round(x, 6).alias(x) for x in ("lat", "lng", "north", "south", "east", "west")])


@query("tile_offsets", """
WITH t AS (SELECT o_custkey AS job, o_orderkey % 5 AS index, arg_max(o_totalprice / 1000, o_orderkey) AS dx, arg_max(-o_totalprice / 2000, o_orderkey) AS dy FROM orders GROUP BY 1, 2)
SELECT c_custkey AS job, i AS index, round(48 + coalesce(dy, 0) / 111320, 6) AS lat, round(11 + coalesce(dx, 0) / (111320 * cos(radians(48 + coalesce(dy, 0) / 111320))), 6) AS lng
FROM customer, (SELECT unnest(range(0, 5)) AS i) LEFT JOIN t ON t.job = c_custkey AND t.index = i""")
def tile_offsets(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 5).alias("index"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000).alias("dx"), (-F.col("o_totalprice") / 2000).alias("dy"))
    t = read(spark, sf, "customer").select(F.col("c_custkey").alias("job"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("index"), F.lit(48.0).alias("lat"), F.lit(11.0).alias("lng"))
    return batch.with_offsets(t, o).select("job", "index", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_HEIGHTS = "SELECT o_custkey AS job, o_orderkey AS tile, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def _heights(spark, sf):
    li = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("job"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select("job", F.col("o_orderkey").alias("tile"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("label"), "lo", "hi")


@query("normalization", f"SELECT job, CASE WHEN max(hi) > min(lo) THEN min(lo) END AS lo, CASE WHEN max(hi) > min(lo) THEN max(hi) END AS hi FROM ({_HEIGHTS}) GROUP BY job")
def normalization(spark, sf):
    return batch.normalization(_heights(spark, sf))


@query("elevation_report", f"""
WITH t AS (SELECT *, concat('T', tile) AS label, concat('T', tile, ' ', printf('%.2f', lo), ' ', printf('%.2f', hi)) AS line FROM ({_HEIGHTS}))
SELECT job, count(*) AS tiles, min(lo) AS lowest, arg_min(label, (lo, label)) AS lowest_tile, max(hi) AS highest, arg_max(label, (hi, label)) AS highest_tile,
  string_agg(line, chr(10) ORDER BY line) AS lines, floor((max(hi) - min(lo)) * 100 + 0.5) / 100 AS range FROM t GROUP BY job""")
def elevation_report(spark, sf):
    return batch.elevation_report(_heights(spark, sf))


@query("cache_eviction", """
SELECT event_type AS bucket, event_id AS key FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 120""")
def cache_eviction(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("bucket"), F.col("event_id").alias("key"), F.col("ts").alias("at"))
    return batch.newest_within(e, 120).select("bucket", "key")


@query("cache_eviction_bytes", """
SELECT event_type AS bucket, event_id AS key FROM (SELECT *, sum(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS t FROM events) WHERE t <= 3000000""")
def cache_eviction_bytes(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("bucket"), F.col("event_id").alias("key"), F.col("ts").alias("at"), F.floor(F.col("value") * 1000).alias("bytes"))
    return batch.newest_within_bytes(e, 3000000).select("bucket", "key")


@query("remaining_time", """
SELECT o_custkey AS job, CAST(floor(avg(o_totalprice) FILTER (o_orderstatus = 'F') * count(*) FILTER (o_orderstatus <> 'F') + 0.5) AS BIGINT) AS left_ms FROM orders GROUP BY 1""")
def remaining_time(spark, sf):
    """Adds a job's milliseconds as its rows lie in the table, file by file, which is what the SQL does on one thread."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus").isNotNull(), "queued")
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("job"), place.alias("seq"), status.alias("status"), F.col("o_totalprice").alias("ms"))
    return batch.remaining_ms(o)


@query("route_progress", """
WITH e AS (SELECT user_id % 20 AS job, user_id AS chunk, event_id AS seq, ['pending', 'terrain', 'bake', 'encode', 'done', 'error'][event_id % 6 + 1] AS phase, value / 40 AS share FROM events),
f AS (SELECT *, CASE WHEN phase = 'bake' THEN floor(12 + greatest(0.0, least(1.0, share)) * 80 + 0.5) WHEN phase = 'encode' THEN 92 WHEN phase = 'done' THEN 100 ELSE 0 END AS fill FROM e),
c AS (SELECT job, chunk, arg_max(phase, seq) AS phase, max(fill) AS fill FROM f GROUP BY job, chunk)
SELECT job, count(*) AS chunks, count(*) FILTER (phase = 'done') AS done, count(*) FILTER (phase = 'error') AS errors, count(*) FILTER (phase IN ('terrain', 'bake', 'encode')) AS active, CAST(floor(avg(fill) + 0.5) AS BIGINT) AS percent FROM c GROUP BY job""")
def route_progress(spark, sf):
    from geoloom.operators import routes

    phases = F.array(*[F.lit(p) for p, _ in routes.PHASES])
    e = read(spark, sf, "events").select((F.col("user_id") % 20).alias("job"), F.col("user_id").alias("chunk"), F.col("event_id").alias("seq"), F.element_at(phases, (F.col("event_id") % 6 + 1).cast("int")).alias("phase"), (F.col("value") / 40).alias("share"))
    return routes.progress(e)


@query("route_chunks")
def route_chunks(spark, sf):
    """Chunks of routes through the event tracks: steps north and east by turns."""
    from pyspark.sql import Window

    from geoloom.operators import routes

    from .views import tracks

    w = Window.partitionBy("track").orderBy("idx")
    t = tracks(spark, sf)
    t = t.withColumn("lat", 48 + F.sum(F.when(F.col("idx") % 2 == 0, F.col("step")).otherwise(0.0)).over(w) * 2e-5).withColumn("lng", 11 + F.sum(F.when(F.col("idx") % 2 == 1, F.col("step")).otherwise(0.0)).over(w) * 3e-5)
    return routes.chunks(t.select(F.col("track").alias("route"), "idx", "lat", "lng"), "draft")


@query("stage_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS ms FROM events GROUP BY ALL")
def stage_windows(spark, sf):
    """The tumbling windows of the stream, over the table as a whole."""
    from geoloom.streaming import states

    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return states.windowed(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("ms", 6).alias("ms"))


@query("user_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf):
    from geoloom.streaming import states

    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return states.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("schedulers", """
SELECT p_partkey AS id, CASE WHEN prof = 'throughput' THEN 'throughput' WHEN prof = 'low_memory' THEN 'low_memory' WHEN r >= 8192 THEN 'highres_8192' WHEN r >= 4096 THEN 'highres_4096' ELSE 'balanced' END AS profile,
 CASE WHEN prof = 'throughput' THEN CASE WHEN r >= 8192 THEN 3 ELSE 4 END WHEN prof = 'low_memory' THEN CASE WHEN r >= 4096 THEN 1 ELSE 2 END WHEN r >= 8192 THEN 2 WHEN r >= 4096 THEN 3 ELSE 4 END AS fetch,
 CASE WHEN prof = 'throughput' THEN CASE WHEN r >= 8192 THEN 12 ELSE 20 END WHEN prof = 'low_memory' THEN CASE WHEN r >= 8192 THEN 6 ELSE 8 END WHEN r >= 8192 THEN CASE WHEN p_size % 2 = 0 THEN 8 ELSE 10 END WHEN r >= 4096 THEN 12 ELSE 20 END AS tiles,
 CASE WHEN prof = 'throughput' THEN 550 WHEN prof = 'low_memory' THEN 900 WHEN r >= 8192 THEN 750 WHEN r >= 4096 THEN 650 ELSE 600 END AS interval_ms
FROM (SELECT *, [512, 1024, 4096, 8192, 16384][p_partkey % 5 + 1] AS r, ['', 'throughput', 'low_memory', 'x'][p_partkey % 4 + 1] AS prof FROM part)""")
def schedulers(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    s = batch.scheduler(pick(5, 512, 1024, 4096, 8192, 16384), pick(4, "", "throughput", "low_memory", "x"), F.col("p_size") % 2 == 0)
    return read(spark, sf, "part").select(k.alias("id"), s.alias("s")).select("id", "s.*")


_KEY = "regexp_replace(CAST(floor({} * 1000000 + 0.5) / 1000000 AS VARCHAR), '\\.0$', '')"


@query("tile_ids", f"""
WITH t AS (SELECT o_orderkey AS job, o_custkey % 5 AS row, o_custkey % 7 AS col, 40 + o_custkey * 0.001::DOUBLE AS lat, 9 + o_orderkey * 0.0001::DOUBLE AS lng FROM orders),
k AS (SELECT *, concat_ws('|', job, row, col, {", ".join(_KEY.format(c) for c in ("lat", "lng", "(lat + 0.005::DOUBLE)", "(lat - 0.005::DOUBLE)", "(lng + 0.007::DOUBLE)", "(lng - 0.007::DOUBLE)"))}) AS k FROM t)
SELECT job, concat('tile_', lower(lpad(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0'))) AS tile FROM k""")
def tile_ids(spark, sf):
    o = read(spark, sf, "orders")
    lat, lng = 40 + F.col("o_custkey") * 0.001, 9 + F.col("o_orderkey") * 0.0001
    t = o.select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("row"), (F.col("o_custkey") % 7).alias("col"), lat.alias("lat"), lng.alias("lng"), (lat + 0.005).alias("north"), (lat - 0.005).alias("south"), (lng + 0.007).alias("east"), (lng - 0.007).alias("west"))
    return batch.tile_ids(t).select("job", "tile")
