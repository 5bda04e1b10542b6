import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from geoloom.llm import wavelet_search as ws

SCHEMA = "doc_id long, text string, id string, score int, item long, rank string"
PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    docs_n, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        own, scored = Counter(terms(text)), []
        for (d, _), c, m in zip(docs, counts, n):
            s = 0
            for t, times in own.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1)))
                    s += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * m * docs_n // total)))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(n=700):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["ähre", "Ähre", "İ", "x_y", "don't", "日本", "A1b2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(rng.randrange(10**6) if i % 40 else None, rng.choice([" ", "\n", "--"]).join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60])))) for i in range(n)]
    docs += [(5_000_000 + i, "w1 w2 w3 w50 copies of one text") for i in range(300)] + [(7, None), (8, ""), (9, " .,- "), (7, "w59 w58"), (7, "w59 w58"), (10, "w59 " * 5000 + "w3")]
    rng.shuffle(docs)
    items = [(i % 23, " ".join(rng.choices(words, k=rng.choice([1, 2, 9, 40])))) for i in range(40)] + [(100, None), (101, ""), (102, "!?"), (103, "nowhere"), (104, "w50 W50 w50 copies"), (None, "w59"), (106, "text of copies")]
    return docs, items


@pytest.mark.parametrize("postings, queries, opened, k, parts", [(600_000, 256, 64, 20, 3), (300, 7, 1, 20, 4), (50, 256, 4, 3, 2), (1, 1000, 64, 1, 1)])
def test_against_brute_force(spark, monkeypatch, postings, queries, opened, k, parts):
    for name, value in (("POSTINGS", postings), ("QUERIES", queries), ("OPENED", opened)):
        monkeypatch.setattr(ws, name, value)
    docs, items = corpus(700 if postings > 1 else 60)
    index = ws.build_index(spark.createDataFrame([(d, t, "a", 1, 2, "b") for d, t in docs], SCHEMA).repartition(parts))
    got = ws.ranked(index, spark.createDataFrame([(i, t, "a", 1, 2, "b") for i, t in items], "item_id long, text string, item string, rank int, doc long, score string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def shard_of(docs):
    own = ws.Builder(len(docs), sum(len(ws.terms_of(t)) for _, t in docs))
    for d, t in docs:
        own.add(d, ws.terms_of(t))
    return own.shard()


def test_lists_fall_by_impact_and_levels_lead_to_every_document():
    docs = [(d, t.encode()) for d, t in corpus(200)[0] if t and terms(t)]
    row = shard_of(docs)
    shard = ws.Shard(row)
    starts, words = np.frombuffer(row["starts"], "<i4"), row["terms"].split(b" ")
    ids = [d for d, _ in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))]
    assert row["ids"] == ids and words == sorted({t for _, x in docs for t in ws.terms_of(x)})
    holders = {w: Counter(d for d, t in docs if w in ws.terms_of(t)) for w in words}
    for i, w in enumerate(words):
        a, b = starts[i], starts[i + 1]
        assert (np.diff(shard.impact[0, a:b]) <= 0).all()
        found = Counter()
        for p in range(a, b):  # down to the leaf
            place = 0
            for level in range(shard.depth):
                z = shard.zeros[level]
                one = z[p + 1] == z[p]
                place, p = place << 1 | int(one), int(z[-1] + p - z[p] if one else z[p])
            found[ids[place]] += 1
        assert found == holders[w]


def test_copies_cost_few_nodes(monkeypatch):
    docs = [(i, b"one two three and some more") for i in range(5000)] + [(9000 + i, f"other {i}".encode()) for i in range(50)]
    shard, best = ws.Shard(row := shard_of(docs)), ws.Best(20)
    monkeypatch.setattr(ws, "OPENED", 8)
    seen = []
    enter = ws.Best.may_enter
    monkeypatch.setattr(ws.Best, "may_enter", lambda self, bound, least: seen.append(len(bound)) or enter(self, bound, least))
    found = ws.intervals(row["terms"], row["starts"], [b"one", b"three"])
    shard.search([(a, b) for _, a, b in found], np.array([3, 5]), best)
    assert best.id.tolist() == list(range(20)) and sum(seen) < 3000


def test_no_documents_or_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ws.ranked(ws.build_index(none), items, 20).count() == 0
    some = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert ws.ranked(ws.build_index(some), items.limit(0), 20).count() == 0


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            path = f"{sf}/{t}.parquet"
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
        got = sorted(map(tuple, ws.op13_wavelet_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()))
        assert got == sorted(con.execute(ws.ORACLE_SQL).fetchall()) and got
