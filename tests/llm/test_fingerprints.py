import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import fingerprints as fp

RNG = np.random.default_rng(3)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))


def test_shared_passages_share_interior_names_at_any_offset():
    core = words(300, 1)
    a, b = fp.signatures([words(20, 2) + core + words(15, 3), words(37, 4) + "x" + core])
    for level in range(4):
        mine, other = set(a[level][1].tolist()), set(b[level][1].tolist())
        alone = set(fp.signatures([core])[0][level][1].tolist())
        assert len(mine & other) >= 0.95 * len(alone) - 8


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n😀é", max_size=80), max_size=6))
def test_batches_do_not_matter(texts):
    together = fp.fingerprints(texts)
    for t, s in zip(texts, together):
        assert s.tolist() == fp.fingerprints([t])[0].tolist()
        assert fp.likeness(s, s) == 1.0
        levels = fp.signatures([t])[0]
        assert not t or len(levels[-1][1]) == 1
        assert all(len(b) < len(a) for (_, a), (_, b) in zip(levels, levels[1:]))


def test_likeness_follows_what_is_shared():
    a, b = words(400, 5), words(400, 6)
    x, y, z = fp.fingerprints([a, b, fp.edited(a, b)])
    assert fp.likeness(x, y) < 0.05 < 0.35 < fp.likeness(x, z) < 0.65
    assert fp.likeness(*fp.fingerprints(["", ""])) == 1 and fp.likeness(*fp.fingerprints(["", "a"])) == 0


ROWS = [(5, "eee " * 30), (3, None), (None, "null id"), (9, "nine " * 50), (9, "again nine"), (7, ""), (1, "one, the last but the null"), (2, "x" * 5000), (4, words(3000, 9))]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [], [(7, "same text, same id")] * 9 + [(None, "")] * 5 + ROWS])
@pytest.mark.parametrize("ranges", ["1", "3", "8"])
def test_neighbours_against_brute_force(spark, rows, ranges):
    docs = spark.createDataFrame([(d, t, "k", True) for d, t in rows], "doc_id long, text string, key string, ghost boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fp.neighbour_likeness(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    tie = {r["text"] or "": r["tie"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    want = sorted(((d if d is not None else -(2**63), t or "", d) for d, t in rows), key=lambda r: (-r[0], tie[r[1]]))
    expect = []
    for i, (_, t, d) in enumerate(want):
        n = want[(i + 1) % len(want)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        s = fp.fingerprints([t, e, n])
        expect.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(s[0]), fp.fingerprint(s[1]), fp.likeness(s[0], s[1]), fp.likeness(s[0], s[2])))
    assert sorted(map(tuple, got), key=repr) == sorted(expect, key=repr)
    assert fp.fingerprint_column(docs).select("fingerprint").count() == len(rows)


MASK = 2**64 - 1


def mix(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def plain_level(symbols):
    """One level of one text, symbol by symbol."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    x = [mix(s + n * 0xC2B2AE3D27D4EB4F & MASK) if n > 1 else s for s, n in runs]
    label, width = list(x), 64
    for _ in range(4):
        new = []
        for i, v in enumerate(label):
            left = label[i - 1] if i else v ^ 1
            diff = v ^ left
            bit = (diff & -diff).bit_length() - 1 if diff else width
            bit &= width - 1
            new.append(2 * bit + (v >> bit & 1))
        label, width = new, 8
    n = len(x)
    starts = [0] + [i for i in range(1, n - 1) if label[i] < label[i - 1] and label[i] <= label[i + 1]]
    names = []
    for a, b in zip(starts, [*starts[1:], n]):
        total = sum(mix(x[a + k] + (k + 1) * 0x9E3779B97F4A7C15 & MASK) for k in range(b - a)) & MASK
        names.append(mix(total + b - a & MASK))
    return names


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(alphabet="ab \n😀é", max_size=90), st.text(max_size=60), st.integers(0, 40).map(lambda n: words(n, n))))
def test_levels_against_a_plain_parser(text):
    x, levels = [ord(c) for c in text], []
    while x:
        x = plain_level(x)
        levels.append(x)
        if len(x) == 1:
            break
    got = fp.signatures([text])[0]
    assert [n.tolist() for _, n in got] == levels
    kept = {v >> 32 for k, names in enumerate(levels, 1) for v in names if k >= 2 or k == len(levels)}
    assert fp.sketch(got).tolist() == sorted(kept)[:64]


def test_one_letter_edits_stay_alike_at_every_length():
    rng = np.random.default_rng(2)
    for n in (30, 60, 100, 150, 200, 400, 1000):
        near = []
        for seed in range(60):
            t = words(n, seed)[:n]
            k = int(rng.integers(0, n))
            near.append(fp.likeness(*fp.fingerprints([t, t[:k] + "#" + t[k + 1 :]])))
        assert np.mean(near) > (0.3 if n < 100 else 0.5) and min(near) > 0.02, (n, np.mean(near), min(near))
