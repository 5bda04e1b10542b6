"""Centroid clustering over whole-number vectors, exact to the last unit.

A vector's components become floor(scale * x).  Each round assigns every vector to its nearest centroid by the expansion
|x|^2 - 2 x.c + |c|^2, computed for a block of vectors and all centroids as one product of float64 matrices.  All its terms are whole
numbers and a bound on the components keeps every sum below 2^53, so the floats are exact and ties are real ties.  Beyond the bound
whole numbers of any size take over: for wide vectors wholly, for a wide centroid only where its widest component doesn't already put it
farther off than the best of the others.  A task adds up its blocks - a sum and a count for each centroid - and the tasks'
sums are combined by treeAggregate over an RDD, so the driver gets one total for each centroid, whatever the number of vectors.  Centroids
(k vectors, part of each round's closure) are all that is ever sent out.  No round keeps a table: a lost executor's part is read again.

Nulls: vectors that are null, have another number of components, or hold one that is null or, scaled, not finite take no part.
Rows with a null id are assigned and averaged but never start a centroid.  Repeated ids are rows of their own; of equal ids the
least vector starts first, and of equal centroids the smaller number gets the vectors.  With fewer vectors than k there are as many
centroids as vectors with an id; an empty table, or one without ids, gives no rows.  Distances and their sums are exact and held to 2^63 - 1
in the result.  Other columns are not read."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components, scale and centroids of the query; rounds; what ids are hashed with; rows of a product.
DIM, SCALE, K, ROUNDS, SALT, BLOCK = 64, 64.0, 16, 3, "1:", 4096
_LONG = 2**63 - 1

Centroids = list[list[int]]


def plain_bound(dim: int) -> int:
    """Components up to this in size, of vectors and centroids, keep |x|^2 + 2 |x.c| + |c|^2 <= dim * (2 * bound)^2 below 2^53."""
    return int((2.0**53 / max(dim, 1)) ** 0.5 / 2) - 1


def whole_vectors(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch (its column v) that take part, and their floor(scale * x) as whole float64."""
    v = batch.column("v")
    some = np.flatnonzero(pc.equal(pc.list_value_length(v), dim).fill_null(False).to_numpy(zero_copy_only=False))
    if not dim or not len(some):
        return some[:0], np.zeros((0, dim))
    x = v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    good = np.isfinite(x).all(axis=1)
    return some[good], x[good]


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, list[int]]:
    """For each row the nearest centroid, ties to the smaller number, and the squared distance."""
    dim, bound = x.shape[1], plain_bound(x.shape[1])
    tight = [j for j, c in enumerate(centroids) if max(map(abs, c), default=0) <= bound]
    label, dist = np.full(len(x), -1), np.full(len(x), np.inf)
    plain = np.abs(x).max(axis=1, initial=0) <= bound
    if tight:
        c = np.array([centroids[j] for j in tight], np.float64)
        p = x[plain]
        d = np.einsum("ij,ij->i", p, p)[:, None] - 2 * (p @ c.T) + np.einsum("ij,ij->i", c, c)
        best = d.argmin(axis=1)
        label[plain], dist[plain] = np.array(tight)[best], d[np.arange(len(p)), best]
    exact = ~plain
    for j in set(range(len(centroids))) - set(tight):
        # its widest component alone is this far off, at least
        exact |= float(min((max(map(abs, centroids[j])) - bound) ** 2, 2**62)) <= dist
    whole = [0] * len(x) if exact.all() else [int(v) if f else 0 for v, f in zip(dist, ~exact)]
    for i in np.flatnonzero(exact):
        row = [int(v) for v in x[i]]
        whole[i], label[i] = min((sum((a - b) * (a - b) for a, b in zip(row, c)), j) for j, c in enumerate(centroids))
    return label, whole


class Totals:
    """Counts, sums of components and of distances for each centroid, as whole numbers of any size."""

    def __init__(self, k: int, dim: int) -> None:
        self.count, self.spread, self.sums = [0] * k, [0] * k, np.zeros((k, dim), object)

    def add(self, x: np.ndarray, label: np.ndarray, dist: list[int]) -> Totals:
        k = len(self.count)
        plain = np.abs(x).max(axis=1, initial=0) <= plain_bound(x.shape[1])  # at most BLOCK rows: their sums stay below 2^53
        some = np.zeros((k, len(x)))
        some[label[plain], np.flatnonzero(plain)] = 1.0
        self.sums += (some[:, plain] @ x[plain]).astype(np.int64).astype(object)
        for i in np.flatnonzero(~plain):
            self.sums[label[i]] += np.array([int(v) for v in x[i]], object)
        for j, d in zip(label.tolist(), dist):
            self.count[j] += 1
            self.spread[j] += d
        return self

    def merge(self, other: Totals) -> Totals:
        self.sums = self.sums + other.sums
        self.count = [a + b for a, b in zip(self.count, other.count)]
        self.spread = [a + b for a, b in zip(self.spread, other.spread)]
        return self


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows, x = whole_vectors(part, dim, scale)
            yield part, rows, x


def totals(vectors: DataFrame, centroids: Centroids, dim: int, scale: float) -> Totals:
    """What the assignment of all vectors (id, v) adds up to: one total a task, combined in a tree."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Totals(k, dim)
        for _, _, x in _blocks(batches, dim, scale):
            own.add(x, *nearest(x, centroids))
        yield pa.RecordBatch.from_pydict({"totals": [pickle.dumps(own)]})

    parts = vectors.select("v").mapInArrow(run, "totals binary").rdd.map(lambda r: pickle.loads(r[0]))
    return parts.treeAggregate(Totals(k, dim), Totals.merge, Totals.merge)


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: float, salt: str) -> Centroids:
    """The vectors with the k least sha256 of salt and id; each task puts forward its own k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[float]]] = []
        for part, rows, x in _blocks(batches, dim, scale):
            ids = part.column("id").to_pylist()
            hashed = sorted((hashlib.sha256(f"{salt}{ids[r]}".encode()).hexdigest(), i) for i, r in enumerate(rows) if ids[r] is not None)
            # more than k of one block can matter only as repeats of one id
            cut = hashed[k - 1][0] if len(hashed) > k else ""
            best = sorted(best + [(h, x[i].tolist()) for n, (h, i) in enumerate(hashed) if n < k or h == cut])[:k]
        yield pa.RecordBatch.from_pydict({"hash": pa.array([h for h, _ in best], pa.string()), "v": pa.array([v for _, v in best], pa.list_(pa.float64()))})

    found = vectors.mapInArrow(run, "hash string, v array<double>").orderBy("hash", "v").limit(k).collect()
    return [[int(x) for x in r["v"]] for r in found]


def moved(centroids: Centroids, sums: Totals) -> Centroids:
    """Non-empty centroids at the floor of their vectors' mean."""
    return [[int(s) // n for s in own] if n else c for c, own, n in zip(centroids, sums.sums.tolist(), sums.count)]


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, scale: float = SCALE, rounds: int = ROUNDS, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Centroids, Totals]:
    """(vec_id, cluster, distance), the centroids and what the last assignment adds up to."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    at = first_centroids(own, k, dim, scale, salt)
    sums = Totals(len(at), dim)
    for n in range(rounds + 1 if at else 0):
        at = moved(at, sums) if n else at
        sums = totals(own, at, dim, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _blocks(batches, dim, scale):
            if at:
                label, dist = nearest(x, at)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("id").take(pa.array(rows)), "cluster": pa.array(label, pa.int32()), "distance": pa.array([min(d, _LONG) for d in dist], pa.int64())})

    return own.mapInArrow(run, "vec_id long, cluster int, distance long"), at, sums


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    rows, at, sums = cluster(vectors, **how)
    told = [(j, min(sums.spread[j], _LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(at)]
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    out = rows.join(F.broadcast(about), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(sum(sums.spread), _LONG)).cast("long").alias("inertia"), "centroid_sha256")


def _oracle() -> str:
    v = f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), e) - 1 AS INTEGER) AS cluster, e AS c FROM v WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {K})"""
    for n in range(ROUNDS + 1):
        v += f""",
d{n} AS (SELECT row, cluster, CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{n}),
a{n} AS (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM d{n} GROUP BY row)"""
        if n < ROUNDS:
            v += f""",
s{n} AS (SELECT cluster, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, {DIM + 1})) AS i FROM v JOIN a{n} USING (row)) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY cluster),
c{n + 1} AS (SELECT o.cluster, coalesce(m{n}.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} ON o.cluster = m{n}.cluster)"""
    return f"""WITH {v}
SELECT vec_id, a{ROUNDS}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{ROUNDS}.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (row) JOIN c{ROUNDS} ON a{ROUNDS}.cluster = c{ROUNDS}.cluster"""


ORACLE_SQL = _oracle()


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of 16 centroids over all vectors of 64 components."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
