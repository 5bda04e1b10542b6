import shutil

from pyspark.sql import functions as F

from geoloom.streaming import states

SF = "/root/testdata/sf0.001"


def test_replay_equals_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = states.events_stream(spark, str(tmp_path / "in"), table.schema)
    out = states.replay(states.windowed(stream), "w", str(tmp_path / "c1"), "complete")
    whole = states.windowed(table.withColumn("ts", F.col("ts").cast("timestamp")))
    assert {(r["start"], r["event_type"], r["n"]) for r in out.collect()} == {(r["start"], r["event_type"], r["n"]) for r in whole.collect()}
    tiles = states.replay(states.tile_states(stream), "t", str(tmp_path / "c2"), "update")
    want = table.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"), F.max_by("event_type", F.struct("ts", "event_id")).alias("e")).collect()
    assert {(r["tile"], r["state"], r["steps"], r["failures"]) for r in tiles.collect()} == {(r["user_id"], states.NEXT[r["e"]], r["n"], r["f"]) for r in want}
