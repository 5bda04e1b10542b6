"""Near-duplicate classes of documents by weighted DartMinHash signatures and a banded join.

Words are runs between white space; a document's elements are its five-word shingles (all words as one
shingle if there are fewer), each with the number of times it occurs as its weight.  Two documents are
linked when the weighted Jaccard similarity - the sum of least weights over the sum of greatest - is at
least 0.8; a class is a connected component of links.  The plan:

1. Each document becomes its weighted elements, a signature and its band keys, written as a table.  The
   n-th occurrence of a shingle has a hash of its own, so that weighted sets are compared as plain ones.
2. Equal weighted sets are one node from here on (grouped by a 128-bit hash): copies cost nothing more.
3. In each bucket of a band key the least node leads; every other node makes one pair with it.
   Pairs are compared set against set; the similar ones are links, and links give labels.
4. A bucket of three nodes or more that still holds two labels may hide links between nodes that
   didn't lead.  Where more than a block of nodes have another label than the lead, a node of another label leads next, LEADERS
   times or until that finds no link.
5. In what is left, the nodes outside a bucket's largest label are dealt into blocks of bounded size, in nodes and in
   bytes of their sets, and compared with one another and with blocks of the largest label, each pair of blocks in one task, which
   reports only the links that join two labels.  So no bucket needs a cap, no list of all its pairs is ever
   made, and what travels grows with the nodes outside the largest label, not with the bucket's square.

With 40 bands of 7 a pair at exactly 0.8 shares no bucket with probability 8e-5, at 0.85 2e-7.  Sets are
compared by 32-bit hashes: two sets of m and n elements take about m n / 2**32 unlike ones for equal.
Buckets, hubs, classes and copies that hold many rows are joined by `join_hot`, and the pairs of a node that leads many by
`join_salted`, never in one task.

Nulls: a null text is an empty one, and documents without words form one class, as their texts
don't differ in any word.  Null and repeated doc_ids stay rows of their own; class_id is the
class's least doc_id, null if it has none.  An empty table gives no rows; other columns are not
read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, drop, hot_keys, join_hot, join_salted, mix64, own_memo, sent_if_small, table, texts_of
from .components import components
from .dart_minhash import band_keys, signatures

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 7
#: Nodes of a block and bytes of its sets, on average, when a bucket is compared in full; further leaders of a bucket before that.
BLOCK, BLOCK_BYTES, LEADERS = 256, 8_000_000, 2
_MEMO_WORDS = 600_000
_word_hash: dict[str, int] = {}


def shingle_sets(texts: list[str], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct 64-bit shingle hashes of each text, ascending, and how often each occurs."""
    memo = _word_hash
    split = [t.split() for t in texts]
    if len(memo) > _MEMO_WORDS:
        memo.clear()
    for ws in split:
        for w in ws:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w) | 1
    out = []
    for ws in split:
        h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        if 0 < len(h) < words:
            h = np.concatenate([h, np.zeros(words - len(h), np.uint64)])
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for i in range(words):
            s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        out.append(np.unique_counts(s))
    return out


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 32-bit hash for every occurrence of each element, ascending and distinct."""
    first = (elements >> np.uint64(32)).astype("<u4")
    more = np.flatnonzero(counts > 1)
    if len(more):
        times = counts[more] - 1
        nth = np.arange(1, int(times.sum()) + 1) - np.repeat(np.cumsum(times) - times, times)
        again = mix64(np.repeat(elements[more], times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.concatenate([first, (again >> np.uint64(32)).astype("<u4")])
    return np.unique(first)


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row (unique: row_col, or made here), doc_id, h1, h2 (hash of the weighted set), keys (one a band), shingles
    (hashes of occurrences, ascending little-endian unsigned 32-bit) and their bytes."""

    def make():
        from pyspark import TaskContext

        next_row = TaskContext.get().partitionId() << 40
        own_memo("words", _word_hash.clear)

        def f(batch):
            nonlocal next_row
            sets = shingle_sets(texts_of(batch), words)
            some = [(s, n) for s, n in sets if len(s)]
            flat = np.concatenate([s for s, _ in some]) if some else np.zeros(0, np.uint64)
            weights = np.concatenate([n for _, n in some]).astype(np.float64) if some else np.zeros(0)
            sig = signatures(flat, weights, np.array([len(s) for s, _ in some], np.int64), bands * rows)
            found = iter(band_keys(sig, bands, rows).tolist())
            whole = [xxhash.xxh3_128_digest(s.tobytes() + n.tobytes()) for s, n in sets]
            ids = batch.column("row") if row_col else np.arange(next_row, next_row + len(sets))
            next_row += len(sets)
            return {
                "row": ids,
                "doc_id": batch.column("doc_id"),
                "h1": [int.from_bytes(h[:8], "little", signed=True) for h in whole],
                "h2": [int.from_bytes(h[8:], "little", signed=True) for h in whole],
                "keys": [next(found) if len(s) else [] for s, _ in sets],
                "shingles": (shingles := [occurrences(s, n).tobytes() for s, n in sets]),
                "bytes": [len(x) for x in shingles],
            }

        return f

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    return arrow_map(rows_, make, "row long, doc_id long, h1 long, h2 long, keys array<long>, shingles binary, bytes long")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return len(x) and len(y) and min(len(x), len(y)) / max(len(x), len(y))  # an upper bound
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b; a written table) whose sets are similar enough; sets: node, shingles.  b is in few pairs, one a band at
    most and round; a may lead any number."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = join_salted(pairs, left, "a", "b").join(right, "b").select("a", "b", "x", "y")

    def make():
        def f(batch):
            hit = [jaccard(x, y) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            kept = batch.select(["a", "b"]).filter(pa.array(hit))
            return {"a": kept.column(0), "b": kept.column(1)}

        return f

    return arrow_map(both, make, "a long, b long")


def links_in_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links that join two labels, for rows (key, i, j, own, node, label, shingles) of which those
    of a (key, i, j) lie together; own: the row's block; j is negative for blocks of the largest label.  A block
    pair's rows are held at once."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (here := (r["key"], r["i"], r["j"])) != at:
                    if out := _join_labels(held, threshold):
                        yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
                    held, at = [], here
                held.append(r)
        if out := _join_labels(held, threshold):
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    bound_batches(blocks.sparkSession)
    return blocks.mapInArrow(run, "a long, b long")


def _join_labels(rows: list[dict], threshold: float) -> tuple[list[int], list[int]] | None:
    """The links found between different labels of one block pair; a label that was joined to
    another counts as the same from then on."""
    if len({r["label"] for r in rows}) < 2:
        return None
    sets = [np.frombuffer(r["shingles"], "<u4") for r in rows]
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    label = np.unique([r["label"] for r in rows], return_inverse=True)[1]
    own = np.array([r["own"] for r in rows])
    flags = np.zeros(int(ids.max()) + 1, np.int64)
    a, b = [], []
    for k in range(len(rows) - 1):
        other = np.flatnonzero((label[k + 1 :] != label[k]) & ((own[k + 1 :] != own[k]) | (rows[k]["i"] == rows[k]["j"]))) + k + 1
        other = other[np.minimum(sizes[other], sizes[k]) >= threshold * np.maximum(sizes[other], sizes[k])]
        if not len(other):
            continue
        mine = ids[starts[k] : starts[k] + sizes[k]]
        flags[mine] = 1
        for o in other:
            if label[o] == label[k]:
                continue
            both = int(flags[ids[starts[o] : starts[o] + sizes[o]]].sum())
            if both >= threshold * (sizes[k] + sizes[o] - both):
                a.append(rows[k]["node"])
                b.append(rows[o]["node"])
                label[label == label[o]] = label[k]
        flags[mine] = 0
    return (a, b) if a else None


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, row and first (whether this row is
    the class's first: least doc_id, then least row) for every document; row_col: a column that
    numbers the rows, taken for row."""
    spark = docs.sparkSession
    made = table(sketches(docs, words, bands, rows, id_col, text_col, row_col), "sketches")
    members = table(made.select("row", "doc_id", "h1", "h2"), "members")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("least")
    nodes = table(members.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("n"), least), "nodes")
    keys = table(made.select(F.col("row").alias("node"), "keys", "bytes").join(nodes.select("node"), "node", "left_semi"), "keys")
    exploded = keys.select("node", "bytes", F.explode("keys").alias("key"))
    buckets = table(exploded.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
    hot = hot_keys(buckets, ["key"], bands * keys.count())
    in_buckets = table(join_hot(exploded, buckets, ["key"], hot), "buckets")
    pairs = table(in_buckets.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = table(in_buckets.select("node").distinct(), "wanted")
    sets = table(made.select(F.col("row").alias("node"), "shingles").join(sent_if_small(wanted), "node", "left_semi"), "sets")
    drop(spark, made, keys)
    links = table(verified(pairs, sets, threshold), "verified")
    # only nodes that aren't linked to their bucket's lead can have another label than it
    apart = in_buckets.where("n > 2 and node != lead").select("key", F.col("lead").alias("a"), F.col("node").alias("b"), "bytes")
    apart = table(apart.join(links, ["a", "b"], "left_anti"), "apart")
    labels = wanted.join(components(links), "node", "left")
    labels = table(labels.select("node", F.coalesce("label", "node").alias("label")), "labels")
    drop(spark, pairs, wanted)

    found, round_ = True, 0
    while found:
        left, strays = unlike_buckets(in_buckets, apart, labels, hot)
        if not left.limit(1).count():
            break
        round_ += 1
        # the strays of other buckets are one block already, which further leaders couldn't make fewer
        many = strays.where(F.col("strays") > BLOCK).select("key")
        found = round_ <= LEADERS and bool(many.limit(1).count())
        if found:
            many = table(join_keys(left, many, hot, "left_semi"), "many")
            links = table(verified(table(next_pairs(many, hot, round_), "pairs"), sets, threshold), "verified")
            found = bool(links.limit(1).count())
        if not found:
            links = table(links_in_blocks(dealt(left, hot).join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), threshold), "more")
            labels = relabelled(labels, links) if links.limit(1).count() else labels
            break
        labels = relabelled(labels, links)
        drop(spark, left)

    of_nodes = table(nodes.join(labels, "node", "left").select("h1", "h2", "n", "least", F.coalesce("label", "node").alias("class")), "classes")
    classes = of_nodes.groupBy("class").agg(F.min("least").alias("least"), F.sum("n").alias("class_size"), F.count("*").alias("n"))
    of_nodes = join_hot(of_nodes.select("h1", "h2", "class"), classes.drop("n"), ["class"], hot_keys(classes, ["class"], of_nodes.count()))
    whole = join_hot(members, of_nodes.drop("class"), ["h1", "h2"], hot_keys(nodes, ["h1", "h2"], members.count()))
    return whole.select("doc_id", F.col("least.doc_id").alias("class_id"), "class_size", "row", (F.col("least.row") == F.col("row")).alias("first"))


def join_keys(rows: DataFrame, side: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with side (one row a bucket) by key: sent to the rows if it is measured to be small, else by join_hot."""
    side = table(side, "keyed")
    sent = sent_if_small(side)
    return rows.join(sent, ["key"], how) if sent is not side else join_hot(rows, side, ["key"], hot, how)


def unlike_buckets(in_buckets: DataFrame, apart: DataFrame, labels: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(key, node, lead, label, bytes) of the buckets of three nodes or more that hold two labels or more, and (key, strays) of these: the
    number of nodes that have another label than the lead.  apart: key, a (lead), b, bytes of the nodes that aren't linked to their lead; all
    others have the lead's label."""
    often = hot_keys(apart.groupBy("a").agg(F.count("*").alias("n")), ["a"], apart.count())
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    known = table(join_hot(apart, of("a"), ["a"], often).join(of("b"), "b").select("key", F.col("b").alias("node"), F.col("a").alias("lead"), "la", F.col("lb").alias("label"), "bytes"), "known")
    mixed = table(known.where("la != label").groupBy("key", "la").agg(F.count("*").alias("strays")), "mixed")
    others = table(join_keys(known, mixed.select("key"), hot, "left_semi"), "others")
    linked = join_keys(in_buckets.where("n > 2"), mixed.select("key", "la"), hot).join(others.select("key", "node"), ["key", "node"], "left_anti")
    left = others.select("key", "node", "lead", "label", "bytes").union(linked.select("key", "node", "lead", F.col("la").alias("label"), "bytes"))
    return table(left, "unlike"), mixed.select("key", "strays")


def next_pairs(left: DataFrame, hot: DataFrame | None, round_: int) -> DataFrame:
    """Pairs (a, b) of a new lead a in each bucket - the least node of a label drawn by the round's number, in the
    first round one that the lead doesn't have - and the bucket's nodes b of other labels."""
    drawn = F.when(F.col("label") == F.col("of_lead"), F.lit(-(2**63))) if round_ == 1 else F.lit(None).cast("long")
    of_lead = left.where("node = lead").select("key", F.col("label").alias("of_lead"))
    known = join_hot(left, of_lead, ["key"], hot)
    draw = F.coalesce(drawn, F.xxhash64("label", F.lit(round_)))
    leads = known.groupBy("key").agg(F.max(F.struct(draw.alias("draw"), "label", (-F.col("node")).alias("least"))).alias("top"))
    leads = leads.select("key", F.col("top.label").alias("its"), (-F.col("top.least")).alias("a"))
    return join_hot(left, leads, ["key"], hot).where("label != its").select("a", F.col("node").alias("b")).distinct()


def dealt(left: DataFrame, hot: DataFrame | None) -> DataFrame:
    """key, i, j, own, node, label: each bucket's nodes (left: key, node, label, bytes) in all pairs of blocks that have to be compared."""
    by_label = left.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("bytes").alias("size"))
    largest = by_label.groupBy("key").agg(F.max(F.struct("m", "label", "size")).alias("top"), F.sum("m").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    strays = blocks(F.col("n") - F.col("top.m"), F.col("size") - F.col("top.size"))
    largest = largest.select("key", F.col("top.label").alias("main"), blocks(F.col("top.m"), F.col("top.size")).alias("mains"), strays.alias("strays"))
    known = join_keys(left, largest, hot).withColumn("stray", F.col("label") != F.col("main"))
    known = known.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))).cast("int"))
    among = known.where("stray").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strays") - 1)))
    among = among.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    across = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stray"), F.col("mains")).otherwise(F.col("strays")) - 1)))
    i, j = F.when(F.col("stray"), F.col("own")).otherwise(F.col("other")), F.when(F.col("stray"), F.col("other")).otherwise(F.col("own"))
    return among.union(across.select("key", i.alias("i"), (-1 - j).alias("j"), F.col("stray").cast("int").alias("own"), "node", "label"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links (a, b) between their nodes."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    joined = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    often = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), ["label"], labels.count())
    moved = join_hot(labels, joined.select(F.col("node").alias("label"), F.col("label").alias("to")), ["label"], often, "left")
    return table(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows less all but the first of each class, whatever their doc_ids: of copies that share a
    doc_id or have none one row stays as well.  Rows are numbered in a written copy of docs."""
    row = "_row" + "_" * max(map(len, docs.columns))  # longer than any column's name
    keyed = table(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    gone = near_duplicate_classes(keyed, id_col=id_col, row_col=row, **options).where("not first").select(F.col("row").alias(row))
    return keyed.join(sent_if_small(table(gone, "gone")), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_size of all documents."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size")
