import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import shared
from geoloom.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_labels_are_matched(spark):
    got = q.op9_hierarchical_quality(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([r["keep"] == (r["quality"] > 0) for r in rows]) > 0.97
    assert sum(not r["keep"] for r in rows if r["quality"] > 0) <= 3


def brute(rows, base_k):
    """Posteriors by plain grouping; rows: logit, site, path."""
    p = [1 / (1 + np.exp(-x)) for x, _, _ in rows]
    base = (sum(p) + 1) / (len(p) + 2)

    def strength(groups, above):
        some = [(g, a) for g, a in zip(groups, above) if len(g) > 1]
        if not some:
            return q.LEAST_STRENGTH
        n = sum(len(g) for g, _ in some)
        within = np.mean([(sum(x * x for x in g) - sum(g) ** 2 / len(g)) / (len(g) - 1) for g, _ in some])
        between = (sum(len(g) * (np.mean(g) - a) ** 2 for g, a in some) - len(some) * within) / n
        return q.MOST_STRENGTH if between <= 0 else np.clip(within / between, q.LEAST_STRENGTH, q.MOST_STRENGTH)

    def group(key):
        out = {}
        for x, r in zip(p, rows):
            out.setdefault(key(r), []).append(x)
        return out

    sites, paths = group(lambda r: r[1]), group(lambda r: r[1:])
    k1 = strength(list(sites.values()), [base] * len(sites))
    rate = {s: (k1 * base + sum(g)) / (k1 + len(g)) for s, g in sites.items()}
    k2 = strength(list(paths.values()), [rate[s] for s, _ in paths])
    lo = lambda x: np.log(x / (1 - x))
    out = []
    for own, (x, s, t) in zip(p, rows):  # a document's rates are those of the others
        of_site = (k1 * base + sum(sites[s]) - own) / (k1 + len(sites[s]) - 1)
        of_path = (k2 * of_site + sum(paths[s, t]) - own) / (k2 + len(paths[s, t]) - 1)
        out.append(1 / (1 + np.exp(-(x + lo(of_path) - lo(base)))))
    return out


def test_held_out_labels_are_matched(spark):
    """The model is fitted on four fifths of the labels and judged by the rest."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = q.judge(docs, labels.where(~rest), ["doc_id"]).join(labels.where(rest), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["keep"] == (r["quality"] > 0) for r in rows]) > 0.95


def test_each_source_and_language_is_a_path(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 2}", f"l{i % 3}") for i in range(60)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 6 > 1)) for i in range(60)], "doc_id long, quality int")
    rates = {}
    for r in q.judge(docs, labels, ["source", "lang", "doc_id"]).collect():
        rates.setdefault((r["source"], r["lang"]), []).append((r["own_score"], r["path_rate"]))
    for rows in rates.values():  # the rate of the others plus the own share is the same for a whole path
        assert len(rows) == 10 and len({round(o, 6) for o, _ in rows}) >= 1
        by_score = sorted(rows)
        assert all(a[1] >= b[1] - 1e-12 for a, b in zip(by_score, by_score[1:]))


def test_hot_paths_are_joined_alike(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.normal()), "s" if i % 3 else None, f"p{i % 40 // 30}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, own_logit double, source string, lang string")
    plain = sorted((r["doc_id"], r["quality_score"]) for r in q.posteriors(df, "source", "lang").collect())
    monkeypatch.setattr(shared, "HOT_SHARE", 3)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    split = sorted((r["doc_id"], r["quality_score"]) for r in q.posteriors(df, "source", "lang").collect())
    assert [i for i, _ in plain] == [i for i, _ in split] and np.allclose([x for _, x in plain], [x for _, x in split])


def test_posteriors_against_plain_grouping(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.normal(2 * (i % 5 - 2), 1)), f"s{i % 5}" if i % 5 else None, f"p{i % 3}" if i % 3 else None) for i in range(300)] + [(3.0, "lone", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, own_logit double, source string, lang string")
    got = {r["doc_id"]: r["quality_score"] for r in q.posteriors(df, "source", "lang").collect()}
    assert np.allclose([got[i] for i in range(len(rows))], brute(rows, 1), atol=1e-9)
    few = q.posteriors(df.where("source = 'lone'"), "source", "lang").collect()
    assert 0 < few[0]["quality_score"] < 1
    assert q.posteriors(df.limit(0), "source", "lang").count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, True), (2, "", "a", "b", True), (None, "x " * 90000, "a", "b", True), (2, "", "a", "b", True)], "doc_id long, text string, source string, lang string, keep boolean")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    rows = q.judge(docs, none, ["doc_id"]).collect()
    assert len(rows) == 4 and all(r["keep"] for r in rows)
    assert q.judge(docs.limit(0), none, ["doc_id"]).count() == 0
    both = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (7, 1)], "doc_id long, quality int")
    assert len(q.judge(docs, both, ["doc_id"]).collect()) == 4
