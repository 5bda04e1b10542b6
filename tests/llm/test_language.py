import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import crf
from geoloom.llm import language_id as li

SF = "/root/testdata/sf0.01"


def plain(scores, sizes, trans):
    """Forward-backward word by word."""
    out, at = [], 0
    for n in sizes:
        e, a = np.exp(scores[at : at + n].astype(float)), np.exp(trans)
        f, b = [e[0] / e[0].sum()], [np.ones(len(a))]
        for t in range(1, n):
            x = (f[-1] @ a) * e[t]
            f.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            x = a @ (e[t] * b[-1])
            b.append(x / x.sum())
        p = np.array(f) * np.array(b[::-1])
        out.append(p / p.sum(1, keepdims=True))
        at += n
    return np.concatenate(out)


def test_segments_give_the_plain_posteriors():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 48, 49, 47, 400, 2, 96, 97])
    scores, trans = rng.normal(size=(sizes.sum(), 3)) * 2, rng.normal(size=(3, 3))
    got, _, _ = crf.posteriors(scores, sizes, trans)
    assert np.allclose(got, plain(scores, sizes, trans), atol=1e-9)


def test_many_labels_need_no_matrices(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.array([3, 200, 1, 97])
    scores, trans = rng.normal(size=(sizes.sum(), 20)) * 2, rng.normal(size=(20, 20))
    want = plain(scores, sizes, trans)
    assert np.allclose(crf.posteriors(scores, sizes, trans)[0], want, atol=1e-9)
    monkeypatch.setattr(crf, "MATRICES", 100)
    assert np.allclose(crf.posteriors(scores, sizes, trans)[0], want, atol=1e-9)
    letters = rng.integers(1, 9, sizes.sum()).astype(float)
    for chunk in (1, 7, 1000):
        got = crf.label_sums(lambda lo, hi: scores[lo:hi], len(scores), letters, trans, chunk)
        assert np.allclose(got, (plain(scores, np.array([len(scores)]), trans) * letters[:, None]).sum(0), atol=1e-8)


def test_three_hundred_languages(spark):
    rng = np.random.default_rng(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = ["".join(rng.choice(list(alphabet), 3)) for _ in range(300)]
    text = lambda k, n: " ".join(own[k] + "".join(rng.choice(list(alphabet), 2)) for _ in range(n))
    rows = [(300 * j + k, text(k, 30), f"l{k:03}") for k in range(300) for j in range(3)] + [(9999, text(7, 3000), "l007")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert len(model.labels) == 300 and model.weights.shape[0] <= (1 << crf.BITS) + crf.LEXICON + 1
    judge = li.Judge(model)
    judge.at_once = 256
    got = judge.judge([t for _, t, _ in rows])
    assert np.mean([g == lang for (g, _), (_, _, lang) in zip(got, rows)]) > 0.9 and got[-1][0] == "l007"
    assert np.isclose(got[-1][1], li.Judge(model).judge([rows[-1][1]])[0][1], atol=1e-5)


def test_the_sample_is_bounded(spark, monkeypatch):
    rows = [(1, "the same row again", "en")] * 3000 + [(i, f"un deux trois {i}", "fr") for i in range(2, 3000)] + [(5, "x" * 3000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(crf.Crf, "train", classmethod(lambda cls, texts, labels: seen.append((len(texts), sum(len(w) for t in texts for w in t)))))
    li.learn(docs, 100)
    monkeypatch.setattr(li, "SAMPLE_CHARS", 1000)
    monkeypatch.setattr(li, "SAMPLE_BYTES", 500)
    li.learn(docs, 100)
    assert seen[0][0] < 160 and seen[1][1] < 1000 + 500 and seen[1][0] < 60


def test_prediction_equals_a_plain_field():
    """The whole prediction, features by plain loops over letters and words, against the judge."""
    texts = [["le", "chat", "est", "noir"], ["the", "cat", "is", "black"], ["der", "hund", "ist", "da"]] * 20
    model = crf.Crf.train(texts, ["fr", "en", "de"] * 20)
    judge = li.Judge(model)
    for text in ("le chat is black", "Der Hund est là, the end", "ça x", "é"):
        words = li.WORD.findall(text.lower())
        e = np.concatenate([model.weights[model.row_of[np.concatenate([f[s[0] :] for f, s in crf.feature_blocks([w], model.lexicon)])]].sum(0)[None] for w in words])
        p = plain(e, np.array([len(words)]), model.trans)
        share = sum(len(w) * x for w, x in zip(words, p)) / sum(map(len, words))
        (lang, score), = judge.judge([text])
        assert lang == model.labels[int(share.argmax())] and np.isclose(score, share.max(), atol=1e-5)


def test_only_letters_make_words():
    assert li.words_of("x²y ½ ① Ⅷ ab_c d4e ñandú 日本") == ["x", "y", "ab", "c", "d", "e", "ñandú", "日本"]
    model = crf.Crf.train([["le", "chat"], ["the", "cat"]] * 9, ["fr", "en"] * 9)
    assert li.Judge(model).judge(["² ½", "① Ⅷ 12", "", "the"])[:3] == [("und", 0.0)] * 3


def test_memo_scores_equal_direct_scores():
    model = crf.Crf.train([["le", "chat", "est"], ["the", "cat", "is"]] * 30, ["fr", "en"] * 30)
    words = ["le", "cat", "x", "chaton", "é", "theis"]
    e = crf.emissions(model.blocks(words), model.weights)
    one = np.concatenate([crf.emissions(model.blocks([w]), model.weights) for w in words])
    assert np.allclose(e, one, atol=1e-5)
    labels = [lab for _, lab, _ in li.Judge(model).label_words("the cat is the cat is le chat est le chat est")]
    assert labels == ["en"] * 6 + ["fr"] * 6


def test_held_out_accuracy(spark):
    from geoloom.llm.language_id import op6_crf_language_id

    got = op6_crf_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(i, "the cat sat on that mat with the hat", "en", 1) for i in range(40)] + [(i, "le chat est dans une maison avec du pain", "fr", 1) for i in range(40, 80)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "12 34 !!", "fr", 1), (None, "the cat sat on", "en", 1), (103, "le chat", None, 1), (104, "the hat " * 5000, "en", 1), (103, "le chat", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = li.learn(docs)
    assert learned.labels == ["en", "fr"]
    got = {(r["doc_id"], r["lang_pred"]) for r in li.predict(li.held_out(docs), learned, ["doc_id", "held_out"]).where("doc_id >= 100 or doc_id is null").collect()}
    assert got == {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "fr"), (104, "en")}
    none = li.predict(docs, li.learn(docs.where(F.lit(False))), ["doc_id"])
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert li.predict(docs.limit(0), learned, ["doc_id"]).count() == 0


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(5)
    words = "the cat le chat die katze sat sur auf mat".split()
    model = crf.Crf.empty(words, np.arange(len(words)), ["a", "b", "c"])
    blocks = model.blocks(words)
    weights, trans = rng.normal(size=model.weights.shape), rng.normal(size=(3, 3))
    weights[-1] = 0
    sizes = np.array([7, 1, 60, 2])
    inv, gold = rng.integers(0, len(words), sizes.sum()), rng.integers(0, 3, sizes.sum())

    def likelihood(w, t):
        """Log of the labels' share, by the plain forward sums."""
        scores, total, at = crf.emissions(blocks, w)[inv], 0.0, 0
        for n in sizes:
            s, y = scores[at : at + n], gold[at : at + n]
            total += s[np.arange(n), y].sum() + t[y[:-1], y[1:]].sum()
            v = s[0]
            for k in range(1, n):
                v = np.log(np.exp(v[:, None] + t).sum(0)) + s[k]
            total -= np.log(np.exp(v).sum())
            at += n
        return total

    used, gw, gt = crf.gradient(blocks, inv, gold, sizes, weights, trans)
    assert (gw[used == len(weights) - 1] == 0).all()
    for k in rng.choice(np.flatnonzero(used < len(weights) - 1), 25, replace=False):
        for label in range(3):
            up, down = weights.copy(), weights.copy()
            up[used[k], label] += 1e-5
            down[used[k], label] -= 1e-5
            assert abs((likelihood(up, trans) - likelihood(down, trans)) / 2e-5 - gw[k, label]) < 1e-4
    for i in range(3):
        for j in range(3):
            up, down = trans.copy(), trans.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            assert abs((likelihood(weights, up) - likelihood(weights, down)) / 2e-5 - gt[i, j]) < 1e-4


def test_spans_tile_a_text():
    rng = np.random.default_rng(1)
    for n in (1, 5, 6, 40, 41, 333):
        spans = crf.spans_of(n, rng)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(crf.SHORT <= b - a <= crf.LONG for a, b in spans[:-1])
    assert crf.spans_of(0, rng) == []


def test_rare_languages_and_those_of_long_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_CHARS", 2000)
    monkeypatch.setattr(li, "SAMPLE_BYTES", 60_000)
    rng = np.random.default_rng(3)
    vocabulary = {lab: ["".join(rng.choice(list(alphabet), rng.integers(3, 8))) for _ in range(80)] for lab, alphabet in (("aa", "abcdefg"), ("bb", "hijklmn"), ("rare", "opqrst"), ("long", "uvwxyz"))}
    text = lambda lab, n: " ".join(rng.choice(vocabulary[lab], n))
    rows = [(i, text(lab, 40), lab) for i, lab in enumerate(["aa", "bb"] * 400)] + [(5000, text("rare", 30), "rare")] + [(6000 + i, text("long", 3000), "long") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert model.labels == ["aa", "bb", "long", "rare"]
    asked = spark.createDataFrame([(i, text(lab, 25), lab) for i, lab in enumerate(["aa", "bb", "rare", "long"] * 5)], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in li.predict(asked, model, ["lang"]).collect())
