"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code.

File format.  A folder holds two Parquet tables.  `ranks` (rank int, token long) lists the ids
by falling frequency over all documents, ties by id.  `shards` has one row a document, in
ascending doc_id order within a shard and from shard to shard: shard, doc_id, start_in_shard (ids of the shard's documents before it), n_tokens, control and
data.  An id is stored as its rank in 1 to 4 little-endian bytes of `data`; `control` holds the
byte counts less one, two bits each, four to a byte, lowest bits first, the last byte padded with
zeros.  Common ids so take one byte, and a reader finds all places from the control bytes alone.

Nulls: a null text is an empty one; a null doc_id sorts first.  Repeated doc_ids are ordered by
their number of ids and their stored bytes within a shard; a doc_id that would fill several shards is
dealt over as many.  Empty texts hold the end id only.  An empty table gives an
empty folder of both tables.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import arrow_map, bound_batches, drop, new_path, table, texts_of

#: Bytes of each of a control byte's four ids, and of all four.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
#: Ids of a shard on average, and most shards.
SHARD_TOKENS, MAX_SHARDS = 1_000_000, 100_000
#: Ids below this are counted in an array.
DENSE = 1 << 20
#: Text chunks whose ids a worker keeps: this writer's tasks hold little else.
MEMO_CHUNKS = 2_000_000


def token_ids(docs: DataFrame, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned, `width` bytes) of each whole text and the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        enc = encoder(vocab_path, MEMO_CHUNKS)

        def f(batch):
            ids = [x + end for x in enc.encode(texts_of(batch))]
            stored = ids if width == 4 else [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in ids]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": stored}

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, make, "doc_id long, n_tokens long, ids binary")


def token_counts(tokens: DataFrame, width: int = 4) -> DataFrame:
    """token, n over all documents; each task counts before the shuffle."""

    def run(batches):
        total: dict[int, int] = defaultdict(int)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}")
            if ids.max(initial=0) < DENSE:
                n = np.bincount(ids)
                own = np.flatnonzero(n)
                n = n[own]
            else:
                own, n = np.unique_counts(ids)
            for t, k in zip(own.tolist(), n.tolist()):
                total[t] += k
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    bound_batches(tokens.sparkSession)
    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pack_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of documents whose ranks lie one after another."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    raw = ranks.view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]].tobytes()
    groups = (counts + 3) // 4
    first = np.cumsum(groups) - groups
    starts = np.cumsum(counts) - counts
    place = np.arange(len(ranks)) - np.repeat(starts, counts) + np.repeat(4 * first, counts)
    bits = np.zeros(4 * int(groups.sum()), np.uint8)
    bits[place] = size - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])
    c, d = np.concatenate([[0], np.cumsum(groups)]).tolist(), ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [control[a:b] for a, b in zip(c, c[1:])], [data[a:b] for a, b in zip(d, d[1:])]


def unpack_ranks(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ranks of documents one after another, by table lookup of their control bytes."""
    groups = (counts + 3) // 4
    size = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].reshape(-1)
    starts, first = np.cumsum(counts) - counts, np.cumsum(groups) - groups
    size = size[np.arange(int(counts.sum())) - np.repeat(starts, counts) + np.repeat(4 * first, counts)].astype(np.int64)
    raw = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8)
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def write_token_files(docs: DataFrame, path: str, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the format above to `path`.

    The tokens go to an intermediate table first, as the ranks need the counts over all of them.
    Ids are coded before the shuffle into ranges of doc_ids, which are cut at approximate
    quantiles.  The driver holds the vocabulary's counts and at most MAX_SHARDS cuts."""
    spark = docs.sparkSession
    width = 2 if max(encoder(vocab_path).vocab_size - 1, end_id) < 1 << 16 else 4
    tokens = table(token_ids(docs, vocab_path, end_id, id_col, text_col, width), "tokens")
    counts = sorted(token_counts(tokens, width).collect(), key=lambda r: (-r["n"], r["token"]))
    by_rank = np.array([r["token"] for r in counts], np.int64)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, token long").coalesce(1).write.parquet(f"{path}/ranks")
    to_rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    to_rank[by_rank] = np.arange(len(by_rank))
    shards = max(1, min(MAX_SHARDS, sum(r["n"] for r in counts) // SHARD_TOKENS))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    cuts = [] if shards == 1 else tokens.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)], max(10_000, 20 * shards))).first()[0]
    cut, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    own_shards = np.where(times > 1, times, 0)  # of a doc_id that is a cut several times
    first = np.concatenate([[0], np.cumsum(1 + own_shards)])

    def code():
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()

        def shard_of(ids: np.ndarray) -> np.ndarray:
            nonlocal at
            place = np.searchsorted(cut, ids)
            out = first[place]
            hot = np.flatnonzero((place < len(cut)) & (np.append(own_shards, 0)[place] > 0))
            hot = hot[cut[place[hot]] == ids[hot]]
            out[hot] += 1 + (at + np.arange(len(hot))) % own_shards[place[hot]]
            at += len(hot)
            return out

        def f(batch):
            n = np.array(batch.column("n_tokens").to_pylist(), np.int64)
            control, data = pack_ranks(to_rank[np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}")], n)
            ids = [-(2**63) if d is None else d for d in batch.column("doc_id").to_pylist()]
            return {"shard": shard_of(np.array(ids, np.int64)), "doc_id": batch.column("doc_id"), "n_tokens": n, "control": control, "data": data}

        return f

    def place():
        shard, before = None, 0

        def f(batch):
            nonlocal shard, before
            start = []
            for s, n in zip(batch.column("shard").to_pylist(), batch.column("n_tokens").to_pylist()):
                shard, before = s, before if s == shard else 0
                start.append(before)
                before += n
            return {x: batch.column(x) for x in ("shard", "doc_id", "n_tokens", "control", "data")} | {"start_in_shard": start}

        return f

    coded = arrow_map(tokens, code, "shard int, doc_id long, n_tokens long, control binary, data binary")
    ordered = coded.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "data", "control")
    arrow_map(ordered, place, "shard int, doc_id long, start_in_shard long, n_tokens long, control binary, data binary").write.parquet(f"{path}/shards")
    drop(spark, tokens)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), decoded from the files.  The
    shards' first places are sent to all executors: MAX_SHARDS rows at most."""
    rows = spark.read.parquet(f"{path}/shards")
    by_rank = np.array([r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    placed = rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "control", "data")

    def make():
        def f(batch):
            n = np.array(batch.column("n_tokens").to_pylist(), np.int64)
            ids = by_rank[unpack_ranks(batch.column("control").to_pylist(), batch.column("data").to_pylist(), n)].tobytes()
            cut = np.concatenate([[0], 4 * np.cumsum(n)]).tolist()
            return {x: batch.column(x) for x in ("doc_id", "start", "n_tokens")} | {"ids": [ids[a:b] for a, b in zip(cut, cut[1:])]}

        return f

    return arrow_map(placed, make, "doc_id long, start long, n_tokens long, ids binary")


def crc_digest(tokens: DataFrame) -> DataFrame:
    """The unsigned crc32 of each document's ids, computed from the decoded ids."""
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return crc_digest(read_token_files(spark, path))


__all__ = ["crc_digest", "op2_token_files", "pack_ranks", "read_token_files", "token_counts", "token_ids", "unpack_ranks", "write_token_files"]
