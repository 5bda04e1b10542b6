import hashlib
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from geoloom.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, doc string, mark int, keep string, pos int"
LONG = [f"{w} stands on a line of its own that is long enough" for w in "one two three four five six seven eight".split()]


def brute(rows, least, min_chars):
    """Kept text, lines and dropped ones of each row, by the contract's words."""
    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    lines = [(t or "").split("\n") for _, t in rows]
    holders = defaultdict(set)
    for (d, _), own in zip(rows, lines):
        for line in own:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(ld.NO_ID if d is None else d)
    out = []
    for (d, _), own in zip(rows, lines):
        kept = [x for x in own if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == (ld.NO_ID if d is None else d)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "a", 1, "b", 2) for d, t in rows], SCHEMA)


def some_rows(n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        own = [rng.choice(LONG) if rng.random() < 0.5 else rng.choice(["short", "", "  ", f"a line of the document {i} that no other one has at all {rng.random()}"]) for _ in range(rng.randrange(9))]
        own = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " \x0c"]) for x in own]
        rows.append((i * 7 % n, "\n".join([LONG[0]] * (i % 3 == 0) + own)))
    rows += [(None, None), (None, "\n".join(LONG[:2])), (1000, ""), (1001, "\n\n"), (3, "\n".join(LONG[:3])), rows[5], rows[5], (2000, "\n".join(["ä" * 39, "ä" * 40, "é" * 10, LONG[3]] * 300))]
    rows += [(3000 + i, "ä" * 40 + "\n" + "ä" * 39) for i in range(6)] + [(4000 + i, "Ä" * 40 + "\n\x85" + LONG[2] + "\x85\n") for i in range(5)]
    return rows


@pytest.mark.parametrize("least, min_chars, partitions", [(5, 40, 4), (5, 40, 64), (2, 10, 16), (1, 5, 3)])
def test_against_brute_force(spark, least, min_chars, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = some_rows()
        got = ld.digests(frame(spark, rows).repartition(5), least=least, min_chars=min_chars).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, least, min_chars)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_runs_over_every_cut_of_partitions_and_batches():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, least = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        rows = np.array([(int(k), 0, -int(d), 0, int(p)) for k, d, p in zip(rng.integers(0, 4, n), rng.integers(0, 7, n), rng.integers(0, 3, n))], np.int64)
        rows = rows[np.lexsort((rows[:, 4], -rows[:, 2], rows[:, 0]))].T
        dropped, open_, edges = [], [], defaultdict(set)
        cuts = [0, *sorted(rng.integers(0, n + 1, 3)), n]
        for a, b in zip(cuts, cuts[1:]):
            inner = [a, *sorted(rng.integers(a, b + 1, 2)), b]
            for kind, x in ld._runs((rows[:, i:j] for i, j in zip(inner, inner[1:]) if j > i), least):
                if kind == ld._EDGE:
                    assert x.shape[1] <= least
                    for k, d in zip(x[0].tolist(), x[2].tolist()):
                        edges[k].add(d)
                else:
                    (dropped if kind == ld._DROPPED else open_).extend(map(tuple, x.T.tolist()))
        dropped += [r for r in open_ if len(edges[r[0]]) >= least and r[2] != max(edges[r[0]])]
        docs = defaultdict(set)
        for r in rows.T.tolist():
            docs[r[0]].add(r[2])
        want = [tuple(r) for r in rows.T.tolist() if len(docs[r[0]]) >= least and r[2] != max(docs[r[0]])]
        assert sorted(dropped) == sorted(want)


def test_a_line_in_most_rows_is_spread_over_the_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, LONG[0] + "\n" + (LONG[1] if i % 3 else f"{i} has a line of its own that nobody else has, it is said")) for i in range(8000)]
        lines = ld.table(ld.hashed_lines(ld.marked(frame(spark, rows).repartition(8), "doc_id", "text")))
        order = ["h1", "h2", ld.F.desc("doc"), "mark", "pos"]
        sizes = [r["count"] for r in lines.repartitionByRange(*order).groupBy(ld.F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3 * sum(sizes) / 16
        gone = ld.dropped_lines(lines)
        assert gone.count() == 7999 + len([i for i in range(8000) if i % 3]) - 1
        assert gone.where("doc = 7999").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_come_back_with_all_columns(spark):
    rows = [(i, LONG[0].upper() + f"\nkept {i}") for i in range(6)] + [(9, None)]
    got = ld.deduplicated(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"], r["text"], r["keep"]) for r in got.collect()) == sorted([(i, f"kept {i}", "b") for i in range(5)] + [(5, rows[5][1], "b"), (9, None, "b")], key=lambda r: r[0])


def test_bitmaps_round_trip():
    for gone in ([0], [7], [8], [3, 4, 900], list(range(50))):
        keep = ld.unpack_bits(ld.pack_bits(np.array(gone)))
        assert np.flatnonzero(~keep).tolist() == gone and len(keep) % 8 == 0


def test_no_documents(spark):
    assert ld.digests(frame(spark, [])).count() == 0


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        path = f"{sf}/documents.parquet"
        con.execute(f"create view documents as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
        got = sorted(map(tuple, ld.op11_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
        assert got == sorted(con.execute(ld.ORACLE_SQL).fetchall())
        assert sum(r[2] for r in got) > 0
