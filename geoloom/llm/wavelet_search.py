"""Ranked lexical search over dual-sorted wavelet trees, exact to the last tie.

Documents are cut into shards where they are read, without a shuffle.  A shard holds the postings of all its terms, one list after
another; within a list they fall by impact - what a document's count of the term is worth, without the term's weight - and
a wavelet tree over the documents' places makes the same sequence navigable by document: each node stands for a range of
places, keeps the order of impacts, and the part of a term's list that lies in it is one interval.  So the first posting of an interval has
the greatest impact of the term among the node's documents, and the weighted sum of first impacts bounds every score below the node.
A search takes the best nodes first, some at a time, maps the intervals of all its terms into both children at once and ends when no node left
can beat the k-th best found; at a leaf the bound is the score.  Places follow doc_id, so ties are pruned as well: a group of
copies costs k leaves.  The tree is kept as a wavelet matrix, one bit row a level, zeros before ones.

Two passes make the index - document lengths first, as impacts need the mean - and it is written to the shared folder.  Queries are
searched in blocks of bounded size against every shard: the document frequencies of a block's terms are counted from the
shards' lists, then each task searches its shards and hands on the k best it has seen of each query.  What one shard has found prunes the
next.  Nothing of the corpus is sent to the driver or broadcast, but a block's queries and frequencies.

Scores are whole numbers.  A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact (10^9 tf) div (1000 tf + 12 m), with m
= 75 + (25 n N) div L; N counts the documents with a term, L is the sum of their lengths n.

Nulls: a null text has no terms and is found by nothing; a null or empty item finds nothing; documents with a null doc_id come after all others
among equal scores.  Repeated documents and repeated items are rows of their own.  Very long texts are postings like others: a shard ends after
the document that fills it.  Terms repeated in an item count as often.  No documents, no items, no rows.  Other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, new_path, sliced, table

#: Postings and documents that end a shard; rows and bytes of a block of queries; nodes opened at once; tokens counted at once.
POSTINGS, DOCS, QUERIES, QUERY_BYTES, OPENED, TOKENS = 600_000, 1 << 16, 256, 4_000_000, 64, 500_000
_NO_ID = 2**63 - 1
#: Bytes that end a term become blanks, A-Z become a-z: a term is letters and digits of ASCII and all bytes beyond it.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def as_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                own = len(terms_of(text)) if text else 0
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    bound_batches(texts.sparkSession)
    got = texts.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return got["n"] or 0, got["total"] or 0


def length_factor(n: int, docs: int, total: int) -> int:
    return 75 + (25 * n * docs) // total


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Builder:
    """Gathers documents and turns them into a shard."""

    def __init__(self, docs: int, total: int) -> None:
        self.docs, self.total = docs, total
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.factors: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[int] = []
        self.lengths: list[int] = []
        self.postings = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        known = self.vocabulary
        self.waiting += [known.setdefault(t, len(known)) for t in terms]
        self.lengths.append(len(terms))
        self.ids.append(doc_id)
        self.factors.append(length_factor(len(terms), self.docs, self.total))
        if len(self.waiting) >= TOKENS:
            self.count()

    def count(self) -> None:
        """The waiting terms as (term, document) keys with their counts."""
        first = len(self.ids) - len(self.lengths)
        keys = np.array(self.waiting, np.int64) << 20 | np.repeat(np.arange(first, len(self.ids)), self.lengths)
        keys, tf = np.unique(keys, return_counts=True)
        self.parts.append((keys, tf))
        self.postings += len(keys)
        self.waiting, self.lengths = [], []

    @property
    def full(self) -> bool:
        return self.postings + len(self.waiting) // 2 >= POSTINGS or len(self.ids) >= DOCS

    def shard(self) -> dict:
        """Its columns: terms (in order, blank between), starts of their lists, ids by place, impacts in list order, bits a level."""
        if self.waiting:
            self.count()
        keys, tf = (np.concatenate(x) for x in zip(*self.parts))
        term, doc = keys >> 20, keys & ((1 << 20) - 1)
        factor = np.array([min(12 * f, 2**62) for f in self.factors], np.int64)[doc]
        tf = tf.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + factor)
        # places by doc_id, null last; lists by term
        by_id = np.array(sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0)))
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        words = sorted(self.vocabulary)
        number = np.empty(len(words), np.int64)
        number[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        term, doc = number[term], place[doc]
        order = np.argsort(term << 40 | ((1 << 20) - 1 - impact) << 20 | doc) if len(words) < 1 << 22 else np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        levels = []
        for level in range(depth(len(by_id)) - 1, -1, -1):
            bit = (doc >> level & 1).astype(bool)
            levels.append(np.packbits(bit).tobytes())
            doc = np.concatenate([doc[~bit], doc[bit]])
        starts = np.searchsorted(term, np.arange(len(words) + 1))
        out = {"terms": b" ".join(words), "starts": starts.astype("<i4").tobytes(), "ids": [self.ids[i] for i in by_id], "impacts": impact.astype("<i4").tobytes(), "levels": levels}
        self.clear()
        return out


def depth(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


_SHARD = pa.schema([("terms", pa.binary()), ("starts", pa.binary()), ("ids", pa.list_(pa.int64())), ("impacts", pa.binary()), ("levels", pa.list_(pa.binary()))])


class Index:
    """The shards of a corpus (a written table) with its N and L."""

    def __init__(self, shards: DataFrame, docs: int, total: int) -> None:
        self.shards, self.docs, self.total = shards, docs, total


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """All documents with a term, in shards; written to `path`, or to the shared folder."""
    texts = as_bytes(docs, id_col, text_col)
    count, total = corpus_size(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Builder(count, total)
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if text and (terms := terms_of(text)):
                    own.add(doc_id, terms)
                    if own.full:
                        yield pa.RecordBatch.from_pylist([own.shard()], schema=_SHARD)
        if own.ids:
            yield pa.RecordBatch.from_pylist([own.shard()], schema=_SHARD)

    bound_batches(docs.sparkSession)
    return Index(table(texts.mapInArrow(run, "terms binary, starts binary, ids array<long>, impacts binary, levels array<binary>"), "shards", path), count, total)


def intervals(terms: bytes, starts: bytes, wanted: list[bytes]) -> list[tuple[int, int, int]]:
    """(which, start, end) of the lists of wanted terms that a shard has."""
    words = {w: i for i, w in enumerate(terms.split(b" "))}
    at = np.frombuffer(starts, "<i4")
    return [(n, int(at[i]), int(at[i + 1])) for n, w in enumerate(wanted) if (i := words.get(w)) is not None]


def frequencies(shards: DataFrame, wanted: list[bytes]) -> list[int]:
    """In how many documents each wanted term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                for n, a, b in intervals(terms, starts, wanted):
                    own[n] += b - a
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(own[some])})

    out = [0] * len(wanted)
    for r in shards.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Best:
    """The k best (score, doc_id) of a query so far, by falling score and rising doc_id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def may_enter(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id < self.id[-1]))


class Shard:
    """A shard opened for searching: ranks and impacts of every level."""

    def __init__(self, row: dict) -> None:
        self.ids = np.array([_NO_ID if i is None else i for i in row["ids"]], np.int64)
        impact = np.frombuffer(row["impacts"], "<i4")
        size, self.depth = len(impact), len(row["levels"])
        self.zeros = np.empty((self.depth, size + 1), np.int32)  # zeros before a position
        self.impact = np.zeros((self.depth + 1, size + 1), np.int32)
        self.impact[0, :size] = impact
        for level, packed in enumerate(row["levels"]):
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).view(bool)
            self.zeros[level, 0] = 0
            np.cumsum(~bit, out=self.zeros[level, 1:], dtype=np.int32)
            before = self.impact[level, :size]
            self.impact[level + 1, :size] = np.concatenate([before[~bit], before[bit]])

    @staticmethod
    def foremost(bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The OPENED nodes of the greatest bounds; of equal ones those of the first places, which lead to copies' leaves straight."""
        if bound.max() < 1 << 45:  # places have 17 bits
            return np.argpartition(first - (bound << 17), OPENED)[:OPENED]
        return np.lexsort((first, -bound))[:OPENED]

    def search(self, lists: list[tuple[int, int]], weights: np.ndarray, best: Best) -> None:
        """Best-first over the nodes: level, place prefix, and the interval of each term in the node."""
        a, b = (np.array([x], np.int64) for x in zip(*lists))
        level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.impact[0, a[0]].astype(np.int64) * weights).sum()[None]
        if not best.may_enter(bound, self.ids[:1]).any():
            return
        while len(bound):
            top = self.foremost(bound, place << (self.depth - level)) if len(bound) > OPENED else np.arange(len(bound))
            leaf = level[top] == self.depth
            if leaf.any():
                best.add(bound[top[leaf]], self.ids[place[top[leaf]]])
            o = top[~leaf]
            lv, lo, hi = level[o], a[o], b[o]
            z0, z1 = self.zeros[lv[:, None], lo], self.zeros[lv[:, None], hi]
            n0 = self.zeros[lv, -1][:, None]
            a2, b2 = np.concatenate([z0, n0 + lo - z0]), np.concatenate([z1, n0 + hi - z1])
            lv2 = np.concatenate([lv, lv]) + 1
            pl2 = np.concatenate([place[o] << 1, place[o] << 1 | 1])
            bd2 = (np.where(b2 > a2, self.impact[lv2[:, None], a2], 0).astype(np.int64) * weights).sum(axis=1)
            rest = np.ones(len(bound), bool)
            rest[top] = False
            level, place, a, b, bound = (np.concatenate([x[rest], y]) for x, y in ((level, lv2), (place, pl2), (a, a2), (b, b2), (bound, bd2)))
            if len(bound):
                least = np.minimum(place << (self.depth - level), len(self.ids) - 1)
                keep = best.may_enter(bound, self.ids[least])
                level, place, a, b, bound = level[keep], place[keep], a[keep], b[keep], bound[keep]


def search_block(index: Index, items: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    """item, doc_id, score: for each (number, text) what the tasks have found, k rows a task at most."""
    counted: list[tuple[int, dict[bytes, int]]] = []
    for number, text in items:
        own: dict[bytes, int] = {}
        for t in terms_of(text):
            own[t] = own.get(t, 0) + 1
        if own:
            counted.append((number, own))
    wanted = sorted({t for _, own in counted for t in own})
    if not wanted or not index.docs:
        return None
    weights = [weight(df, index.docs) if df else 0 for df in frequencies(index.shards, wanted)]
    at = {t: n for n, t in enumerate(wanted)}
    queries = [(number, [(at[t], n * weights[at[t]]) for t, n in own.items() if weights[at[t]]]) for number, own in counted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: Best(k) for number, _ in queries}
        for one in sliced(batches, 1):
            row = one.to_pylist()[0]
            lists = {n: (a, b) for n, a, b in intervals(row["terms"], row["starts"], wanted) if weights[n]}
            shard = Shard(row)
            for number, own in queries:
                held = [(lists[n], w) for n, w in own if n in lists]
                if held:
                    shard.search([x for x, _ in held], np.array([w for _, w in held], np.int64), best[number])
        item = np.concatenate([np.full(len(b.score), n) for n, b in best.items()]).astype(np.int64)
        ids, score = (np.concatenate([getattr(b, c) for b in best.values()]).astype(np.int64) for c in ("id", "score"))
        yield pa.RecordBatch.from_pydict({"item": pa.array(item), "doc": pa.array(ids, mask=ids == _NO_ID), "score": pa.array(score)})

    return index.shards.mapInArrow(run, "item long, doc long, score long")


def ranked(index: Index, items: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item."""
    spark = items.sparkSession
    asked = table(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")), "items")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    path, block, size = new_path(spark, "found"), [], 0
    schema = "item long, rank int, doc long, score long"
    spark.createDataFrame([], schema).write.parquet(path)

    def close() -> None:
        found = search_block(index, block, k)
        if found is not None:  # a block's results are written, so the plan doesn't grow with the number of blocks
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            found.select("item", "rank", "doc", "score").write.mode("append").parquet(path)

    for row in asked.where("octet_length(text) > 0").select("item", "text").toLocalIterator():
        if block and (len(block) == QUERIES or size + len(row["text"]) > QUERY_BYTES):
            close()
            block, size = [], 0
        block.append((row["item"], bytes(row["text"])))
        size += len(row["text"])
    if block:
        close()
    rows = spark.read.schema(schema).parquet(path)
    return rows.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _PATTERN + "'))"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, {_TERMS} AS term FROM d) GROUP BY row, term),
n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY row),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, {_TERMS} AS term FROM b) GROUP BY item, term),
f AS (SELECT item, p.row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
      FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term JOIN n ON n.row = p.row, s GROUP BY item, p.row),
r AS (SELECT item, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank FROM f JOIN d ON d.row = f.row WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN b ON b.item = r.item WHERE rank <= 20
"""


def op13_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ranked(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)
