"""Exact top-k search by inner product with norm buckets and local pruning.

Vectors are grouped by length: bucket b holds the norms in [g**b, g**(b+1)), so there are at most
a few thousand buckets whatever the table.  A first look at the longest vectors gives each query a
score that its k-th best can't be below.  From that score, the query's norm and the bucket's largest
norm follows the least cosine (local threshold) that a vector of the bucket needs; a bucket where it
is above 1 is skipped, and as this holds for all shorter buckets a query meets a run of buckets
only.  Buckets are cut into blocks of bounded size, queries into blocks as well.  Some blocks of one bucket lie together in a
task, and each block of queries whose run has the bucket is sent there once, streamed past the vectors' blocks that are
held; vectors are not copied.
Inside a block each query takes the cheaper way its local threshold allows: *length* pruning
cuts the block's vectors, sorted by norm, where they get too short; *coordinate* pruning, for high
thresholds, also keeps only vectors whose value in the query's largest coordinates lies in the range
that a unit vector at that cosine must have.  The rest is verified by whole products.

Products are exact: components are integers, and where a float64 sum could round, Python integers
take over, held to the range of a 64-bit integer.  Vectors of unlike dimensions have no product.

Nulls: vectors that are null, empty or hold components that are null or,
scaled, not finite, and rows with a null id,
take no part.  Repeated ids are rows of their own; a query's own id is no candidate.  Ties go to
the smaller id.  Empty tables give no rows.  Other columns are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, join_salted, sliced, table

#: Ratio of a norm bucket's ends; longest vectors looked at first; rows of a block of vectors and
#: of queries; blocks of vectors that are held at once; local threshold from which coordinates prune; coordinates that are looked at.
GROWTH, SEEDS, VECTORS, QUERIES, HELD, STEEP, FOCUS = 1.05, 1024, 4096, 256, 8, 0.6, 3
_LONG = 2**63


def integer_vectors(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (unique once written), vec_id, v (array of whole doubles floor(scale * x)), norm, dim and
    bucket of the usable vectors."""
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(scale)) < F.lit(float("inf"))))
    # floor() to a long would not hold components of 2**63 and more; whole doubles do
    scaled = F.transform(F.col(vector_col), lambda x: F.when(F.abs(x.cast("double") * F.lit(scale)) < 2.0**52, F.floor(x.cast("double") * F.lit(scale)).cast("double")).otherwise(x.cast("double") * F.lit(scale)))
    rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    norm = F.when(top == 0, 0.0).otherwise(top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))))
    rows = rows.withColumn("norm", norm).withColumn("dim", F.size("v"))
    return rows.withColumn("bucket", F.when(F.col("norm") < 1, -1).otherwise(F.floor(F.log("norm") / math.log(GROWTH))).cast("int"))


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of a and b as int64; bound: the largest product of norms."""
    if bound < 2.0**52:
        return (a @ b.T).astype(np.int64)
    big = a.astype(object), b.astype(object)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in big]
    return np.clip(whole[0] @ whole[1].T, -_LONG, _LONG - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _matrix(v: list[list[float]]) -> np.ndarray:
    return np.array(v, np.float64)


def thresholds(queries: DataFrame, vectors: DataFrame, k: int, seeds: int) -> DataFrame:
    """queries with `least`: a score that the k-th best of each can't be below, or null."""
    longest = vectors.orderBy(F.desc("norm"), "vec_id").limit(seeds).select("vec_id", "v", "norm").collect()
    by_dim: dict[int, tuple] = {}
    for d in {len(r["v"]) for r in longest}:
        own = [r for r in longest if len(r["v"]) == d]
        by_dim[d] = (_matrix([r["v"] for r in own]), np.array([r["vec_id"] for r in own]), max(r["norm"] for r in own))

    def make():
        def f(batch):
            rows, least = batch.to_pylist(), []
            for r in rows:
                m, ids, top = by_dim.get(len(r["v"]), (None, (), 0))
                own = products(_matrix([r["v"]]), m, r["norm"] * top)[0][ids != r["vec_id"]] if m is not None else ()
                least.append(int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else None)
            return {x: batch.column(x) for x in ("row", "vec_id", "v", "norm", "dim")} | {"least": least}

        return f

    return arrow_map(queries.select("row", "vec_id", "v", "norm", "dim"), make, "row long, vec_id long, v array<double>, norm double, dim int, least long")


def blocks(rows: DataFrame, by: list[str], size: int, sizes: DataFrame) -> DataFrame:
    """Rows dealt into blocks of about `size` within each `by` (hot ones into many) and each block
    gathered in one row.  `sizes` (n rows for each `by`) is small: norm buckets are few."""
    dealt = rows.join(F.broadcast(sizes), by).withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / size)).cast("int"))
    return dealt.groupBy(*by, "block").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in by])).alias("rows"))


def top_k(vectors: DataFrame, is_query, k: int, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best of all other rows.  is_query: a
    condition on `vec_id`."""
    all_rows = table(integer_vectors(vectors, scale, id_col, vector_col), "vectors")
    asked = table(thresholds(all_rows.where(is_query), all_rows, k, seeds), "queries")

    # buckets: at most a few thousand, by their norms' range
    sizes = all_rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top"))
    held = blocks(all_rows.select("dim", "bucket", "row", "vec_id", "v", "norm"), ["dim", "bucket"], VECTORS, sizes.select("dim", "bucket", "n"))
    held = held.join(sizes.select("dim", "bucket", "top"), ["dim", "bucket"])

    # queries of a like least cosine share a block: a block then skips what all of its queries skip
    asked = asked.withColumn("need", F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm") * (1 - 1e-9)).otherwise(0.0))
    asked = asked.withColumn("need_bucket", F.when(F.col("need") < 1, -1).otherwise(F.floor(F.log("need") / math.log(GROWTH)) - 1).cast("int"))
    needs = asked.groupBy("dim", "need_bucket").agg(F.count("*").alias("n"))
    asked_blocks = blocks(asked.select("dim", "need_bucket", "row", "vec_id", "v", "norm", "need"), ["dim", "need_bucket"], QUERIES, needs)
    asked_blocks = table(asked_blocks.select("dim", "need_bucket", F.concat_ws(":", "dim", "need_bucket", "block").alias("ask"), "rows"), "asked")
    # each block of queries meets a run of buckets: names alone are joined by bucket, then its rows go to every group of blocks once
    runs = asked_blocks.select("dim", "need_bucket", "ask").join(F.broadcast(sizes.groupBy("dim").agg(F.max("bucket").alias("last"))), "dim")
    runs = runs.where("need_bucket <= last").withColumn("bucket", F.explode(F.sequence("need_bucket", "last")))
    runs = runs.groupBy(F.concat_ws(":", "dim", "bucket").alias("at")).agg(F.collect_list("ask").alias("asks"))
    number = F.explode(F.sequence(F.lit(0), (F.ceil(F.ceil(F.col("n") / VECTORS) / HELD) - 1).cast("int")))
    groups = table(sizes.select(F.concat_ws(":", "dim", "bucket").alias("at"), "dim", "bucket", number.alias("group")), "groups")
    met = join_salted(groups, runs, "at", "group").select("dim", "bucket", "group", F.explode("asks").alias("ask"))
    met = table(met.withColumn("slot", F.xxhash64("dim", "bucket", "group")), "met")
    met = join_salted(met, asked_blocks.select("ask", F.col("rows").alias("queries")), "ask", "slot")
    place = ["dim", "bucket", "group"]
    kind = "array<struct<row:bigint,vec_id:bigint,v:array<double>,norm:double,need:double>>"
    sent = met.select(*place, F.lit(1).alias("asks"), F.lit(0.0).alias("top"), F.col("queries").cast(kind).alias("rows"))
    kept = held.select("dim", "bucket", F.floor(F.col("block") / HELD).cast("int").alias("group"), F.lit(0).alias("asks"), "top", F.transform("rows", lambda r: r.withField("need", F.lit(0.0))).cast(kind).alias("rows"))
    met = kept.union(sent).repartition(*place).sortWithinPartitions(*place, "asks")

    def run(batches):
        at, blocks_here = None, []
        for one in sliced(batches, 1):
            here = tuple(one.column(c)[0].as_py() for c in place)
            if here != at:
                at, blocks_here = here, []
            rows = one.column("rows")[0].values
            if not one.column("asks")[0].as_py():
                blocks_here.append(Block(rows, one.column("top")[0].as_py()))
            else:
                yield _search(rows, blocks_here, k)

    found = met.mapInArrow(run, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _field(structs: pa.StructArray, name: str) -> np.ndarray:
    kept = structs.field(name)
    return kept.to_numpy(zero_copy_only=False)


def _stack(structs: pa.StructArray) -> np.ndarray:
    lists = structs.field("v")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


class Block:
    """A block of vectors by falling norm; top: its bucket's largest norm."""

    def __init__(self, rows: pa.StructArray, top: float) -> None:
        order = np.argsort(-_field(rows, "norm"), kind="stable")
        self.top, self.ids, self.norms, self.v = top, _field(rows, "vec_id")[order], _field(rows, "norm")[order], _stack(rows)[order]
        self.unit, self.by_value = None, {}

    def near(self, q: np.ndarray, norm: float, need: float) -> np.ndarray:
        """Rows that a query's local threshold doesn't rule out."""
        # a vector needs norm * cosine >= need: the block's cosines reach need / top at least
        cosine = need / self.top if self.top > 0 else 0.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        some = np.arange(int(np.searchsorted(-self.norms, -need, side="right")))
        if cosine >= STEEP and len(some) > 64:
            if self.unit is None:
                self.unit = np.where(self.norms[:, None] > 0, self.v / self.norms[:, None], 0.0)
            some = _in_ranges(self.unit, self.by_value, q / norm, cosine - 1e-9, len(some))
        return some


def _search(queries: pa.StructArray, blocks: list[Block], k: int) -> pa.RecordBatch:
    """The k best of the blocks' vectors for each query."""
    q_ids, q_norms, need, q = _field(queries, "vec_id"), _field(queries, "norm"), _field(queries, "need"), _stack(queries)
    out: list[list[np.ndarray]] = [[], [], []]
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(len(q_ids)):
            ids, scores = [], []
            for block in blocks:
                some = block.near(q[i], q_norms[i], need[i])
                some = some[block.ids[some] != q_ids[i]]
                if len(some):
                    score = products(q[i : i + 1], block.v[some], q_norms[i] * block.norms[0])[0]
                    won = best(score, block.ids[some], k)
                    ids.append(block.ids[some][won])
                    scores.append(score[won])
            if ids:
                found, score = np.concatenate(ids), np.concatenate(scores)
                won = best(score, found, k)
                for kept, x in zip(out, (np.full(len(won), i), found[won], score[won])):
                    kept.append(x)
    at, vec, score = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
    rows_of = _field(queries, "row")
    return pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[at], pa.int64()), "query_row": pa.array(rows_of[at], pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})


def _in_ranges(unit: np.ndarray, by_value: dict, q: np.ndarray, cosine: float, prefix: int) -> np.ndarray:
    """Rows before `prefix` whose values in q's largest coordinates a unit vector of that cosine to q
    can have: q_f * cosine -/+ sqrt((1 - cosine**2) (1 - q_f**2))."""
    focus = np.argsort(-np.abs(q))[:FOCUS]
    mid, half = q[focus] * cosine, np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - q[focus] ** 2)) + 1e-9
    lo, hi = np.where(q[focus] >= 0, mid - half, -1.0), np.where(q[focus] >= 0, 1.0, mid + half)
    f = int(focus[0])
    if f not in by_value:
        sort = np.argsort(unit[:, f])
        by_value[f] = sort, unit[sort, f]
    sort, values = by_value[f]
    some = sort[np.searchsorted(values, lo[0]) : np.searchsorted(values, hi[0], side="right")]
    for n in range(1, len(focus)):
        x = unit[some, focus[n]]
        some = some[(x >= lo[n]) & (x <= hi[n])]
    return np.sort(some[some < prefix])


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op1_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)
