"""Line dedup: a line that many documents hold stays in one of them.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case.  The key of every line that is long
enough goes as a 128-bit hash with its document and position to a range partition by (hash, document falling, text, position),
so the rows of a key lie together, in order, and those of a very common one are spread over as many partitions as they
fill.  Each partition is streamed: of a key's run the first document - the greatest doc_id - keeps its lines and those of the others
are dropped once the run has shown enough documents.  Only the first and the last run of a partition can go on in another one: the
rows of these are put off, and a few documents of each (`least` at most, with the greatest) settle them afterwards; that
is two runs a partition, whatever the data.

What comes back is not text but a bitmap for each document that loses lines: one bit a line, 1 if it stays, deflated; lines beyond
its end stay.  Bitmaps are few bytes and are sent to the texts where they are measured to be small, else both are joined by shuffle.

Nulls: a null or empty text is one empty line; rows with a null doc_id are one document, before all others.  Rows of one
doc_id are one document: its lines count once, and all its rows keep them or lose them.  Very long texts are cut into lines in one
task; a document's lines never meet another's there.  Equal lines within the document that keeps them all stay.  An empty table gives no
rows.  Other columns pass through `deduplicated` untouched, whatever their names.  Keys with equal 128-bit hashes count as equal."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, restored, sent_if_small, table

#: Code points of a key from which lines count, and documents from which on a key is common.
MIN_CHARS, LEAST_DOCS = 40, 5
#: The doc_id that stands for null: the least long.
NO_ID = -(2**63)
_ROW = ("h1", "h2", "doc", "mark", "pos")
_DROPPED, _OPEN, _EDGE = 0, 1, 2


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line of UTF-8, or None if it is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(b" \t\n\x0b\x0c\r").lower()  # of bytes: A-Z alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode(errors="replace")) < min_chars):
        return None
    return key


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark (which text of the doc_id), text as bytes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def hashed_lines(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc, mark, pos of the lines that count.  A task takes equal rows once."""

    def make():
        seen: set[tuple[int, int]] = set()

        def f(batch):
            hashes, doc, mark, pos = [], [], [], []
            for d, m, text in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").to_pylist()):
                if len(text) < min_chars or (d, m) in seen:
                    continue
                seen.add((d, m))
                for n, line in enumerate(text.split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        doc.append(d)
                        mark.append(m)
                        pos.append(n)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            return {"h1": h[:, 0], "h2": h[:, 1], "doc": doc, "mark": mark, "pos": pos}

        return f

    return arrow_map(texts, make, "h1 long, h2 long, doc long, mark long, pos long")


class _Run:
    """The rows of one key as far as a partition has shown them.  `open`: it may have begun in the partition before."""

    def __init__(self, rows: np.ndarray, least: int, open_: bool) -> None:
        self.key, self.least, self.open = rows[:2, :1], least, open_
        self.docs: list[int] = []
        self.held: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        docs = rows[2]
        if len(self.docs) < self.least:
            for d in docs[np.concatenate([[True], docs[1:] != docs[:-1]])][: self.least + 1].tolist():
                if len(self.docs) < self.least and (not self.docs or self.docs[-1] != d):
                    self.docs.append(d)
        if self.open:
            yield _OPEN, rows
        elif len(self.docs) < self.least:
            self.held.append(rows)
        else:
            for x in (*self.held, rows):
                yield _DROPPED, x[:, x[2] != self.docs[0]]
            self.held = []

    def end(self, last: bool) -> Iterator[tuple[int, np.ndarray]]:
        if self.open or last:
            yield from ((_OPEN, x) for x in self.held)
            edge = np.zeros((5, len(self.docs)), np.int64)
            edge[:2], edge[2] = self.key, self.docs
            yield _EDGE, edge


def _runs(batches: Iterator[np.ndarray], least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, rows) of a partition's rows (5 x n, in order): lines dropped, lines to be settled, documents that settle them."""
    run = None
    for rows in batches:
        cuts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [rows.shape[1]]])
        head = rows[:, : ends[0]]
        if run is not None and (run.key == head[:2, :1]).all():
            yield from run.add(head)
        else:
            if run is not None:
                yield from run.end(False)
            run = _Run(head, least, run is None)
            yield from run.add(head)
        if len(starts) == 1:
            continue
        yield from run.end(False)
        if len(starts) > 2:  # runs that this batch holds whole
            a, b = starts[1], starts[-1]
            own, at = rows[:, a:b], starts[1:-1] - a
            fresh = np.concatenate([[True], own[2, 1:] != own[2, :-1]])
            fresh[at] = True
            n = np.diff(np.append(at, b - a))
            common = np.repeat(np.add.reduceat(fresh, at) >= least, n)
            yield _DROPPED, own[:, common & (own[2] != np.repeat(own[2, at], n))]
        run = _Run(rows[:, starts[-1] :], least, False)
        yield from run.add(rows[:, starts[-1] :])
    if run is not None:
        yield from run.end(True)


def dropped_lines(lines: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """doc, mark, pos of the lines that go.  lines: a written table of h1, h2, doc, mark, pos."""
    kind = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in _ROW)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (np.stack([b.column(c).to_numpy() for c in _ROW]) for b in batches if b.num_rows)
        for what, rows in _runs(arrays, least):
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], what, np.int8)), *map(pa.array, rows)], schema=kind)

    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("mark"), F.col("pos")]
    streamed = table(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, "kind byte, h1 long, h2 long, doc long, mark long, pos long"), "streamed")
    # at most 2 * least rows a partition
    edges = streamed.where(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeps")).where(F.col("n") >= least)
    settled = streamed.where(F.col("kind") == _OPEN).join(F.broadcast(edges), ["h1", "h2"]).where("doc != keeps")
    return streamed.where(F.col("kind") == _DROPPED).select("doc", "mark", "pos").union(settled.select("doc", "mark", "pos"))


def pack_bits(gone: np.ndarray) -> bytes:
    """The keep bitmap of a document that loses the lines at these places."""
    keep = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without the lines that go, its lines before and the number of those that went."""
    n = text.count(b"\n") + 1
    if bitmap is None:
        return text, n, 0
    lines, keep = text.split(b"\n"), unpack_bits(bitmap)
    kept = [line for line, stays in zip(lines, keep) if stays] + lines[len(keep) :]
    return b"\n".join(kept), n, n - len(kept)


def keep_bitmaps(texts: DataFrame, least: int = LEAST_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, mark, keep of the documents (see `marked`) that lose lines, as a written table."""
    gone = dropped_lines(table(hashed_lines(texts, min_chars), "lines"), least)

    def make():
        def f(batch):
            return {"doc": batch.column("doc"), "mark": batch.column("mark"), "keep": [pack_bits(np.array(g)) for g in batch.column("gone").to_pylist()]}

        return f

    # a set of places: within a group there are no more than its document has lines
    return table(arrow_map(gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone")), make, "doc long, mark long, keep binary"), "bitmaps")


def with_bitmaps(texts: DataFrame, bitmaps: DataFrame) -> DataFrame:
    return texts.join(sent_if_small(bitmaps), ["doc", "mark"], "left")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines that go taken out of their texts; all columns as before."""
    texts = marked(docs, id_col, text_col)
    bitmaps = keep_bitmaps(texts, least, min_chars)
    own = docs.select(*carried(docs.columns), *[c.alias(f"_{n}") for n, c in zip(("doc", "mark"), (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))])
    joined = own.join(sent_if_small(bitmaps.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "keep")), ["_doc", "_mark"], "left").drop("_doc", "_mark")
    place = docs.columns.index(text_col)
    schema = joined.drop("keep").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = [t if k is None or t is None else kept_lines(t.encode(), k)[0].decode() for t, k in zip(texts, batch.column("keep").to_pylist())]
            yield batch.set_column(place, batch.schema.names[place], pa.array(new, batch.column(place).type)).drop_columns(["keep"])

    return joined.mapInArrow(cut, schema).select(*restored(docs.columns))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    texts = marked(docs, id_col, text_col)

    def make():
        def f(batch):
            out = [kept_lines(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist())]
            return {"doc": batch.column("doc"), "n_lines": [n for _, n, _ in out], "n_dropped": [n for _, _, n in out], "kept_sha256": [hashlib.sha256(t).hexdigest() for t, _, _ in out]}

        return f

    found = arrow_map(with_bitmaps(texts, keep_bitmaps(texts, least, min_chars)), make, "doc long, n_lines long, n_dropped long, kept_sha256 string")
    return found.select(F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, {NO_ID}) AS doc, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT row, doc, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM d),
k AS (SELECT row, doc, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc) AS keeps FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
m AS (SELECT row, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND doc <> keeps) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL OR doc = keeps), '') AS kept FROM k LEFT JOIN c ON k.key = c.key GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN m ON d.row = m.row
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold, taken out of all but the last of them, over all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
