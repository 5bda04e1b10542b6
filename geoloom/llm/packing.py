"""Best-two-fit packing of token sequences.

A document is its ids and an end id; one longer than a sequence is cut into pieces, of which only
the last may be shorter.  Full pieces are sequences of their own.  The others are packed by
length alone: how many pieces have each length is a table of at most `seq_len` entries whatever
the corpus, so one packing of the whole corpus is made on the driver and no shard leaves a
part-filled sequence behind.  A bin is filled greedily with the longest piece that fits; then its
shortest piece gives way to two unpacked ones if they fit the widened gap more tightly.  The
bin's pattern is repeated as often as the counts allow.  Pieces take the patterns' places by
their rank among the pieces of their length, which is found from counts of each task.

Nulls: a null text is an empty one, a document of just the end id; null and repeated doc_ids are
packed as documents of their own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import arrow_map, table, texts_of


def pieces(docs: DataFrame, vocab_path: str, end_id: int, seq_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and rank among the pieces of
    its length in that task."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        from pyspark import TaskContext

        enc, seen, part = encoder(vocab_path), Counter(), TaskContext.get().partitionId()

        def f(batch):
            out = {x: [] for x in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch))):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    own = ids[at : at + 4 * seq_len]
                    n = len(own) // 4
                    for x, v in zip(out.values(), (doc, i, at // 4, n, zlib.crc32(own), part, seen[n])):
                        x.append(v)
                    seen[n] += 1
            return out

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_two_fit(counts: dict[int, int], seq_len: int) -> list[tuple[int, list[int]]]:
    """Patterns (times, lengths) that use up `counts` (pieces of each length).

    At most a few patterns for each length and unit of it that a bin can hold: bounded by seq_len."""
    left = np.zeros(seq_len + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    #: The longest unpacked piece of at most each length, 0 for none.
    fits = np.maximum.accumulate(np.where(left > 0, np.arange(seq_len + 1), 0))
    out: list[tuple[int, list[int]]] = []

    def take(n: int, k: int) -> None:
        left[n] += k
        if left[n] == (k if k > 0 else 0):
            lower = fits[n - 1]
            if k > 0:
                fits[n:] = np.maximum(fits[n:], n)
            else:
                fits[n:][fits[n:] == n] = lower

    while fits[seq_len]:
        bin_, gap = [], seq_len
        while n := int(fits[gap]):
            bin_.append(n)
            take(n, -1)
            gap -= n
        if gap and len(bin_) > 1:
            last, room = bin_[-1], gap + bin_[-1]
            small = np.flatnonzero(left[: room // 2 + 1])
            mates = fits[room - small]
            mates = np.where((mates == small) & (left[small] < 2), fits[small - 1] if len(small) else 0, mates)
            total = np.where(mates > 0, small + mates, 0)
            if len(total) and total.max() > last:
                i = int(total.argmax())
                take(last, 1)
                bin_[-1:] = [int(mates[i]), int(small[i])]
                take(int(mates[i]), -1)
                take(int(small[i]), -1)
        use = Counter(bin_)
        more = min(int(left[n]) // k for n, k in use.items())
        if more:
            for n, k in use.items():
                take(n, -k * more)
        out.append((1 + more, bin_))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length its runs of places, by the rank of their first piece: (first rank, times,
    the pattern's first sequence, place in the sequence)."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for times, lengths in patterns:
        at = 0
        for n in lengths:
            found.setdefault(n, []).append((ranks[n], times, sequence, at))
            ranks[n] += times
            at += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in found.items()}


def pack(found: DataFrame, seq_len: int) -> DataFrame:
    """sequence_id and offset for `pieces` rows that were written to a table."""
    by_task = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = places(best_two_fit(counts, seq_len))
    before = by_task.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def make():
        def f(batch):
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = (batch.column("before").to_numpy(zero_copy_only=False) + batch.column("nth").to_numpy(zero_copy_only=False)).astype(np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                first, _, base, place = at[int(length[rows[0]])]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = base[run] + rank[rows] - first[run]
                offset[rows] = place[run]
            return {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

        return f

    return arrow_map(found.join(before, ["part", "length"]), make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 1, seq_len: int = 4096) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(table(pieces(docs, vocab_path, end_id, seq_len), "pieces"), seq_len)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
