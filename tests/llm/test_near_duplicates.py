from collections import Counter

import numpy as np
import pytest

from geoloom.operators import shared
from geoloom.llm import near_duplicates as nd
from geoloom.llm.components import components
from geoloom.llm.dart_minhash import signatures


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for n, shared, scale in ((40, 30, 1), (3000, 2400, 1), (300, 200, 3)):
        ids = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        w = np.ceil(rng.random(2 * n - shared) * scale)
        a, b = slice(0, n), slice(n - shared, 2 * n - shared)
        sig = signatures(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], w[b]]), np.array([n, n]), 1024)
        want = w[n - shared : n].sum() / w.sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.06
        assert (signatures(ids[b], w[b], np.array([n]), 1024)[0] == sig[1]).all()
    assert (signatures(ids[:1], np.ones(1), np.array([1]), 64) == signatures(ids[:1], np.ones(1), np.array([1]), 64)).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (3, 2)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else Counter() for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = (sets[i] & sets[j]).total()
            if sets[i] == sets[j] or both >= 0.8 * (sets[i] | sets[j]).total() > 0:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    size = np.bincount(label)
    return sorted(((d, least.get(x), int(size[x])) for (d, _), x in zip(rows, label)), key=repr)


def corpus():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: list(rng.choice(vocab, n))
    out = []
    for base in range(6):
        t = text(150)
        for c in range(12):
            x = list(t)
            for _ in range(int(rng.integers(0, 6))):
                x[rng.integers(0, len(x))] = rng.choice(vocab)
            out.append(" ".join(x))
    passage = text(80)
    out += [" ".join(text(60) + passage + text(40)) for _ in range(40)]
    chain = text(200)
    for i in range(8):
        out.append(" ".join(chain))
        chain[i * 20 : i * 20 + 2] = text(2)
    line = text(12)
    for n in (10, 11, 13, 30, 33, 40):  # one set of shingles, unlike weights
        out.append(" ".join(line * n + chain[:30]))
    return out + ["", None, "  ", "a b", "a  b", "a b c d e", "a b c d e", " ".join(text(9000))]


@pytest.mark.parametrize("block", [4])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = [((7 * i) % 1000 if i % 17 else None, t) for i, t in enumerate(corpus())] + [(70, "repeated id"), (70, "repeated id")]
    df = spark.createDataFrame([(d, t, 1, "", 2) for d, t in rows], "doc_id long, text string, row int, node string, label int")
    got = nd.near_duplicate_classes(df).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] != 70]
    assert set(ids) <= {c for _, c, _ in brute(rows)} | {70}


def test_hot_groups_against_brute_force(spark, monkeypatch):
    """Exact copies, near copies around a hub and boilerplate that shares buckets but not enough: many keys count as hot,
    or none does."""
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(300)]
    hub = list(rng.choice(vocab, 120))
    texts = [" ".join(hub)] * 40
    for i in range(40):
        x = list(hub)
        x[3 * i : 3 * i + 1] = ["zz" + str(i)]
        texts.append(" ".join(x))
    for i in range(40):  # about 0.7 to the hub and to one another
        texts.append(" ".join([*hub[:100], *[f"u{i}" for _ in range(10)], *rng.choice(vocab, 8)]))
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for share, block in ((10, 3), (4096, 256)):
        monkeypatch.setattr(shared, "HOT_SHARE", share)
        monkeypatch.setattr(shared, "HOT_ROWS", 5 if share < 4096 else 100)
        monkeypatch.setattr(nd, "BLOCK", block)
        got = nd.near_duplicate_classes(df).select("doc_id", "class_id", "class_size").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicate_classes(df).count() == 0 and nd.drop_near_duplicates(df).count() == 0


def test_blocks_join_only_unlike_labels():
    same = np.arange(100, dtype="<u4").tobytes()
    rows = [dict(key=1, i=0, j=0, own=0, node=n, label=n, shingles=same) for n in range(4)] + [dict(key=1, i=0, j=0, own=0, node=9, label=9, shingles=np.arange(500, 600, dtype="<u4").tobytes())]
    a, b = nd._join_labels(rows, 0.8)
    assert len(a) == 3 and 9 not in a + b


def test_one_row_of_each_class_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "x30")
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (None, "m n o p q r"), (7, long), (7, "s t u v w x"), (3, near), (3, near), (9, "s t u v w x"), (None, long)]
    df = spark.createDataFrame([(t, d, n) for n, (d, t) in enumerate(rows)], "text string, doc_id long, _row int").repartition(3)
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = kept.select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(5, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r"), (3, near), (7, "s t u v w x")], key=repr)
    assert nd.drop_near_duplicates(df.withColumnRenamed("doc_id", "id").withColumnRenamed("text", "body"), id_col="id", text_col="body").count() == 5


def test_a_leader_of_many_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_SHARE", 64)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    base = np.arange(1000, dtype="<u4")
    sets = [(0, base.tobytes())] + [(n, np.concatenate([base[: 800 + n % 200], np.arange(5000, 5000 + n % 7, dtype="<u4")]).tobytes()) for n in range(1, 1500)]
    pairs = shared.table(spark.createDataFrame([(0, n) for n in range(1, 1500)] + [(n, n + 1) for n in range(1, 500)], "a long, b long"))
    frame = spark.createDataFrame(sets, "node long, shingles binary")
    of = dict(sets)
    want = sorted((a, b) for a, b in map(tuple, pairs.collect()) if nd.jaccard(of[a], of[b]) >= 0.8)
    assert sorted(map(tuple, nd.verified(pairs, frame, 0.8).collect())) == want
    joined = shared.join_salted(pairs, frame.withColumnRenamed("node", "a"), "a", "b")
    assert joined.count() == pairs.count()


def test_blocks_are_bounded_by_the_bytes_of_their_sets(spark):
    rng = np.random.default_rng(8)
    big = np.sort(rng.choice(2**31, 1_000_000, replace=False)).astype("<u4")
    nodes = [(1, n, n // 3, 4_000_000) for n in range(40)] + [(2, 100 + n, n % 2, 1200) for n in range(600)]
    left = spark.createDataFrame(nodes, "key long, node long, label long, bytes long")
    blocks = nd.dealt(left, None).join(left.select("node", "bytes"), "node").groupBy("key", "i", "j").agg({"bytes": "sum", "node": "count"}).collect()
    assert max(r["sum(bytes)"] for r in blocks if r["key"] == 1) <= 12 * 4_000_000 and max(r["count(node)"] for r in blocks if r["key"] == 2) > 256
    # sets of a million shingles: two like ones of different labels and one apart
    like = np.concatenate([big[:-1000], np.arange(2**31, 2**31 + 1000, dtype="<u4")])
    rows = [(1, 0, 0, n, n, n, x.tobytes()) for n, x in enumerate((big, like, big[:500_000]))]
    found = nd.links_in_blocks(spark.createDataFrame(rows, "key long, i int, j int, own int, node long, label long, shingles binary").coalesce(1), 0.8)
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
