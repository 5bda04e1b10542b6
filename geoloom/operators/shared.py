"""What operators share at scale: the work folder of the application, tables that cut a lineage, joins on hot keys and
sides that are sent only if they are measured to be small."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors share, spark.checkpoint.dir.
    Where that is unset a folder of this machine serves if Spark runs on this machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        shared = "file:///tmp/checkpoints"
    return f"{shared.rstrip('/')}/geoloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the cut in its lineage."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove intermediate tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/geoloom/" in folder:
                where = spark._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once no result that reads them is needed any more: a
    result is computed from them only when it is used, so the operators can't remove its tables themselves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of one part of a table that is dealt by keys.
PART_ROWS = 250_000


def parts_of(df: DataFrame, rows: int = 0) -> int | None:
    """The parts of about `rows` rows (PART_ROWS, if not given) by which to deal a table (best as it is read, so that only its footers are counted);
    None if the cores together hold no more anyway."""
    parts = df.count() // (rows or PART_ROWS)
    return parts if parts > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by a shuffle on keys in so many parts, so what one task sorts and counts doesn't grow with the table; as it is without parts."""
    return df.repartition(parts, *keys) if parts else df


#: A key is hot if it holds more than one of HOT_SHARE rows - so fewer keys than this are, whatever the table - and more
#: than a task does in no time anyway.
HOT_SHARE, HOT_ROWS = 4096, 100


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """The hot keys of `counts` (keys, n rows of total) as a written table of fewer than HOT_SHARE rows; None if there are
    none."""
    found = table(counts.where((F.col("n") * HOT_SHARE > total) & (F.col("n") > HOT_ROWS)).select(*keys).coalesce(1), "hot")
    return found if found.limit(1).count() else None


def by_shuffle(side: DataFrame, size: int) -> DataFrame:
    """A side of `size` rows at most, for a join by shuffle if these are more than PART_ROWS: compressed files of a few MB look small enough to be sent
    through the driver, whatever they hold."""
    return side.hint("merge") if size > PART_ROWS else side


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner", size: int = 0) -> DataFrame:
    """rows joined with side (one row a key, no null keys).  The side's rows of hot keys, fewer than HOT_SHARE, are sent to
    where the rows are; only the rows of other keys are shuffled, so no key gathers its rows in one task.  size: the most rows that the side
    may have, as in by_shuffle; without it Spark goes by the size of the files."""
    if hot is None:
        return rows.join(by_shuffle(side, size), keys, how)
    hot = F.broadcast(hot)
    sent = F.broadcast(side.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(sent, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(by_shuffle(side, size), keys, how))


def join_salted(rows: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """rows (a written table) joined with side (one row a key, of any size).  The rows of a hot key are dealt by `by` over as many parts
    as they are hot shares, and the side's row is shuffled to each of these; a part holds about a hot key's least rows, and
    there are fewer than 2 * HOT_SHARE parts of hot keys."""
    total = rows.count()
    least = max(HOT_ROWS, total / HOT_SHARE)
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = table(counts.select(key, F.ceil(F.col("n") / least).cast("int").alias("_parts")).coalesce(1), "hot")
    if not hot.limit(1).count():
        return rows.join(side, key)
    hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = side.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


#: Rows and bytes of strings up to which a join's side is sent to all executors.
SENT_ROWS, SENT_BYTES = 2_000_000, 64_000_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """A written table as the side of a join: sent to all executors if it is measured to be within SENT_ROWS and
    SENT_BYTES; else as it is, for a join by shuffle."""
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(F.count("*").alias("n"), sum(texts, F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= SENT_ROWS and size["b"] <= SENT_BYTES else df
