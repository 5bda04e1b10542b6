"""Document fingerprints by locally consistent parsing.

A text's code points are symbols.  A level of parsing first names runs of one symbol, so that
neighbours differ, and then tosses coins deterministically: each symbol gets the lowest bit where it
differs from its left neighbour, as place and value; repeated on these labels, four rounds leave
numbers below six in which neighbours still differ.  Phrases start where such a label is a local
minimum, so where a phrase ends depends on a few symbols around it only and equal substrings are cut
alike but for their edges, wherever they stand.  A phrase's name is a hash of its symbols; names are
the next level's symbols, until one is left.

The fingerprint keeps the SKETCH least 32-bit hashes of the distinct names from level BASE on and of the text's
one last name, as hexadecimal digits: the same levels for every text.  The likeness of two fingerprints is the Jaccard similarity that these least
hashes estimate; texts with fewer names have it exactly.

Nulls: a null text is an empty one; its fingerprint is the empty string, whose likeness is 1 to
itself and 0 to any other.  Null doc_ids come last in descending order; rows of one doc_id follow
each other by a hash of the text.  One row follows itself.  An empty table gives no rows; other columns are not
read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, mix64, table

BASE, SKETCH, ROUNDS = 2, 64, 4
#: Code points that are parsed at once.
AT_ONCE = 300_000
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: small labels that differ between neighbours of a text."""
    for _ in range(ROUNDS):
        one = x.dtype.type(1)
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = x[first] ^ one
        diff = x ^ left
        place = np.bitwise_count((diff & (~diff + one)) - one) & np.uint8(8 * x.itemsize - 1)
        x = ((x >> place.astype(x.dtype)) & one).astype(np.uint8) + np.uint8(2) * place
    return x


def parse_level(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of texts whose symbols (unsigned 64-bit) lie one after another, and
    the phrases' texts."""
    new = np.empty(len(x), bool)
    new[:1] = True
    new[1:] = owner[1:] != owner[:-1]
    start = new.copy()
    start[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(start)
    if len(at) < len(x):  # name the runs
        run = np.diff(at, append=len(x)).astype(np.uint64)
        x = np.where(run > 1, mix64(x[at] + run * _LENGTH), x[at])
        owner, new = owner[at], new[at]
    first = np.flatnonzero(new)
    label = _labels(x, first)
    low = np.ones(len(x), bool)
    low[1:] = label[1:] < label[:-1]
    low[:-1] &= label[:-1] <= label[1:]
    # the last symbol joins the phrase before it; a text's first symbol always starts one
    low[np.concatenate([first[1:] - 1, [len(x) - 1]])] = False
    low[first] = True
    at = np.flatnonzero(low)
    place = np.arange(len(x)) - np.repeat(at, np.diff(at, append=len(x)))
    names = mix64(np.add.reduceat(mix64(x + (place.astype(np.uint64) + np.uint64(1)) * _PLACE), at) + np.diff(at, append=len(x)).astype(np.uint64))
    return names, owner[at]


def signatures(texts: list[str]) -> list[list[tuple[int, np.ndarray]]]:
    """For each text its phrases' names (unsigned 64-bit) from level 1 up to the one name."""
    codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    x = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    owner, level = np.repeat(np.arange(len(texts)), sizes), 0
    while len(x):
        x, owner = parse_level(x, owner)
        level += 1
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = np.append(at[1:], len(x))
        for o, a, b in zip(owner[at].tolist(), at.tolist(), ends.tolist()):
            out[o].append((level, x[a:b]))
        more = np.repeat(ends - at > 1, ends - at)
        x, owner = x[more], owner[more]
    return out


def sketch(levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The least hashes of a text's names, ascending."""
    if not levels:
        return np.zeros(0, np.uint32)
    kept = [n for level, n in levels if level >= BASE or level == len(levels)]
    return np.unique((np.concatenate(kept) >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def fingerprint(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity by the least hashes of both; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SKETCH]
    return float(len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both))


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sketches of texts of any number and length, some code points at a time."""
    out: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= AT_ONCE:
            out += map(sketch, signatures(part))
            part, size = [], 0
    return out + list(map(sketch, signatures(part)))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many code points of the next text, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_column(docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text, for use without the order of documents."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(s) for s in fingerprints([t or "" for t in texts])])

    bound_batches(docs.sparkSession)
    return docs.withColumn(to, of(F.col(text_col)))


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, home: ranges of the descending order of doc_ids, a partition each and numbered by home.

    Ranges are cut by doc_id, hash of the text and row, so that no doc_id and no text has to lie in one range."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), "tie", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("home"))


_KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(pairs: list[tuple]) -> list[list]:
    """Columns of _KINDS for pairs (doc_id, text, next text)."""
    changed = [edited(t, n) for _, t, n in pairs]
    # a next text is most often the following pair's own
    texts, own = [], []
    for _, t, n in pairs:
        if not texts or texts[-1] is not t:
            texts.append(t)
        own.append(len(texts) - 1)
        texts.append(n)
    prints, after = fingerprints(texts), fingerprints(changed)
    rows = [(d, len(t), hashlib.sha256(c.encode()).hexdigest(), fingerprint(prints[i]), fingerprint(e), likeness(prints[i], e), likeness(prints[i], prints[i + 1])) for (d, t, _), c, i, e in zip(pairs, changed, own, after)]
    return [list(x) for x in zip(*rows)]


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Within a range each row has the next one beside it.  A range's first and last texts are written with
    the results; the last one's results follow from a join with the first of the next range that has rows, so texts are
    shuffled once and two of each range once more."""
    spark = docs.sparkSession
    kinds = _KINDS.append(pa.field("home", pa.int32())).append(pa.field("first", pa.string())).append(pa.field("last", pa.string()))

    def batch_of(columns: list[list], home=None, first=None, last=None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip([*columns, [home] * n, [first] * n, [last] * n], kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = home = None
        pairs, size = [], 0
        for batch in batches:
            for doc, text, home in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "home"))):
                if last is None:
                    first = text
                else:
                    pairs.append((*last, text))
                    size += len(last[1])
                last = doc, text
                if size >= AT_ONCE:
                    yield batch_of(_judged(pairs))
                    pairs, size = [], 0
        if pairs:
            yield batch_of(_judged(pairs))
        if last:
            yield batch_of([[last[0]], *[[None]] * 6], home, first, last[1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(_judged([(row["doc_id"], row["last"], row["first"])]), _KINDS)], schema=_KINDS)

    bound_batches(spark)
    found = table(in_order(docs, id_col, text_col).mapInArrow(run, _RESULT + ", home int, first string, last string"), "likeness")
    ends = found.where("home is not null")
    # one row a range: the next range's number, without its texts
    homes = ends.select("home")
    following = homes.select(F.col("home").alias("at"), F.lead("home").over(Window.orderBy("home")).alias("to"))
    least = homes.agg(F.min("home")).first()[0]
    following = following.select("at", F.coalesce("to", F.lit(least)).alias("to"))
    open_ends = ends.select("doc_id", "home", "last").join(F.broadcast(following), F.col("home") == F.col("at"))
    paired = open_ends.join(ends.select(F.col("home").alias("there"), "first"), F.col("to") == F.col("there")).select("doc_id", "last", "first")
    return found.where("home is null").drop("home", "first", "last").unionByName(paired.mapInArrow(close, _RESULT))


def op3_local_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with likeness to both neighbours."""
    return neighbour_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
