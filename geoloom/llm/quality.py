"""Quality classification by hierarchical empirical Bayes.

A logistic model over counts of a text's characters, words and lines gives each document's own
evidence, calibrated on held-back labels.  Sites (source) and their paths (source and language) each
have a rate of good documents: the mean of the documents' evidence, shrunk toward the level above -
a path toward its site, a site toward the whole corpus - by as many pseudo-documents as the spread of
rates on that level calls for (method of moments).  Sparse sites so stay near the global prior while
large ones speak for themselves.  A document's posterior odds are its own odds times the odds of its
path against the corpus, where the rates of its path and site leave its own evidence out, so that no
evidence counts twice.  All rates are grouped sums; only the model and three numbers reach the driver.

The model is fitted on at most SAMPLE labelled documents, chosen by a hash of the id.

Nulls: a null text is an empty one; a null source or language is a site or path of its own; labels
that are null aren't learned from, and of several labels of an id the lowest counts.  Without both
good and bad labels there is no evidence: every document keeps the prior of 1/2, and stays.
Repeated rows are judged alike.  An empty table gives no rows; other columns aren't read."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, hot_keys, join_hot, own_memo, restored, table, texts_of

SAMPLE, KEEP = 6000, 0.5
#: Bounds of a level's pseudo-documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e4
#: A document's own odds are bounded by this logarithm, so that a site's can speak too.
MOST_LOGIT = 12.0
_SPREAD = 1 << 30
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": b".,;:", "bang": b"!?", "sign": b"#$%&*@^~|\\<>=+/_{}[]", "quote": b"'\"()-`", "high": range(128, 256), "control": [*range(9), *range(14, 32), 127]}
_CLASS_OF = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i


def features(text: str) -> list[float]:
    """Shares of character classes, of distinct words and lines, and sizes."""
    raw = text.encode()
    hist = np.bincount(_CLASS_OF, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(_CLASSES))
    words = text.split()
    often = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n, w = max(1, len(raw)), max(1, len(words))
    out = (np.sqrt(hist / n)).tolist()
    out += [np.log1p(len(words)), len(often) / w, max(often.values(), default=0) / w, np.log1p(len(text) / w), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines)))]
    ends = sum(x.rstrip()[-1:] in ".!?…\"'" for x in lines) / max(1, len(lines))
    marked = len(_MARKED.findall(text)) / w
    return [*out, ends, marked]


_MARKED = re.compile(r"[#$%&*@!]{2,}(?=\s|$)")


class Logistic:
    """A standardised logistic model, fitted by Newton's steps with a ridge."""

    def __init__(self, mean, scale, weights, bias, slope=1.0, shift=0.0, prior=0.5):
        self.mean, self.scale, self.weights, self.bias, self.slope, self.shift, self.prior = mean, scale, weights, bias, slope, shift, prior

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
        x1 = np.column_stack([x, np.ones(len(x))])
        b, pen = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
        pen[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
            step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(pen), x1.T @ (y - p) - pen * b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return b

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Logistic | None":
        if len(set(y.tolist())) < 2:
            return None
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - mean) / scale, -8, 8)
        fit, hold = np.arange(len(y)) % 4 != 0, np.arange(len(y)) % 4 == 0
        if len(set(y[fit].tolist())) < 2 or len(set(y[hold].tolist())) < 2:
            fit = hold = np.ones(len(y), bool)
        b = cls._newton(z[fit], y[fit], 1.0)
        # calibration: the held-back labels may be noisier than the margin says
        c = cls._newton((z[hold] @ b[:-1] + b[-1])[:, None], y[hold], 0.1)
        return cls(mean, scale, b[:-1], b[-1], max(0.05, float(c[0])), float(c[1]), float(y.mean()))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(self.slope * (z @ self.weights + self.bias) + self.shift, -MOST_LOGIT, MOST_LOGIT)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Logistic | None:
    """A model from a bounded sample of the labelled documents; features travel, not texts."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label"))
    total = marks.count()
    part = min(_SPREAD, _SPREAD * sample // max(1, total) + 1)
    some = marks.where(F.pmod(F.xxhash64("_id"), F.lit(_SPREAD)) < part).limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(some), "_id").select("_id", "_text", "_label")

    def make():
        return lambda b: {"id": b.column("_id"), "x": [features(t) for t in texts_of(b, "_text")], "label": b.column("_label")}

    found = sorted(arrow_map(rows, make, "id long, x array<double>, label int").limit(4 * sample).collect())
    if not found:
        return None
    return Logistic.fit(np.array([r["x"] for r in found]), np.array([float(r["label"] > 0) for r in found]))


def evidence(docs: DataFrame, model: Logistic | None, keep: list[str], site: str = "source", path: str = "lang", text_col: str = "text") -> DataFrame:
    """The carried columns `keep`, _site and _path with own_logit: the calibrated log odds of a good document by its
    text."""
    rows = docs.select(*carried(keep), F.col(site).cast("string").alias("_s"), F.col(path).cast("string").alias("_p"), F.col(text_col).cast("string").alias("_text"))
    kinds = rows.dtypes[:-1]

    def make():
        own_memo("quality", lambda: None)  # it keeps none, but empties the others'

        def f(batch):
            texts = texts_of(batch, "_text")
            own = model.logits(np.array([features(t) for t in texts])) if model else np.zeros(len(texts))
            return {x: batch.column(x) for x, _ in kinds} | {"own_logit": own}

        return f

    return arrow_map(rows, make, "".join(f"`{x}` {kind}, " for x, kind in kinds) + "own_logit double")


def _strength(rates: DataFrame, above: str) -> float:
    """Pseudo-documents of a level with columns n, s (sum of evidence), v (sum of its squares) and the
    rate above: from how much more the groups' means spread than their documents alone explain."""
    d = F.col("s") / F.col("n") - F.col(above)
    within = (F.col("v") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    got = rates.where("n > 1").agg(F.sum(F.col("n") * d * d).alias("d2"), F.sum(within).alias("w"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not got["n"]:
        return LEAST_STRENGTH
    within_mean = got["w"] / got["k"]
    between = (got["d2"] - got["k"] * within_mean) / got["n"]
    return MOST_STRENGTH if between <= 0 else float(np.clip(within_mean / between, LEAST_STRENGTH, MOST_STRENGTH))


def posteriors(judged: DataFrame, site: str, path: str) -> DataFrame:
    """judged (a written table with own_logit, site and path columns) with site_rate and path_rate - of the other
    documents - and quality_score."""
    judged = judged.withColumn("_own", 1 / (1 + F.exp(-F.col("own_logit")))).withColumn("_key", F.to_json(F.struct(F.col(site).alias("s"), F.col(path).alias("p"))))
    sums = [F.count("*").alias("n"), F.sum("_own").alias("s"), F.sum(F.col("_own") * F.col("_own")).alias("v")]
    by_path = table(judged.groupBy("_key", F.col(site).alias("_site")).agg(*sums), "rates")
    by_site = by_path.groupBy("_site").agg(*[F.sum(x).alias(x) for x in ("n", "s", "v")])
    whole = by_site.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = (whole["s"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    by_site = table(by_site.withColumn("base", F.lit(base)), "site-rates")
    k1 = _strength(by_site, "base")
    by_site = by_site.select(F.col("_site").alias("_up"), F.col("n").alias("site_n"), F.col("s").alias("site_s"))
    by_site = by_site.withColumn("_rate", (F.lit(k1 * base) + F.col("site_s")) / (F.lit(k1) + F.col("site_n")))
    by_path = table(by_path.join(by_site, F.col("_site").eqNullSafe(F.col("_up"))).drop("_up", "_site"), "path-rates")
    k2 = _strength(by_path, "_rate")
    both = join_hot(judged, by_path.drop("v", "_rate"), ["_key"], hot_keys(by_path, ["_key"], int(whole["n"] or 0)))
    both = both.withColumn("site_rate", (F.lit(k1 * base) + F.col("site_s") - F.col("_own")) / (F.lit(k1) + F.col("site_n") - 1))
    both = both.withColumn("path_rate", (F.lit(k2) * F.col("site_rate") + F.col("s") - F.col("_own")) / (F.lit(k2) + F.col("n") - 1))
    logit = lambda x: F.log(x / (1 - x))
    odds = F.col("own_logit") + logit(F.col("path_rate")) - F.lit(float(np.log(base / (1 - base))))
    return both.withColumn("quality_score", 1 / (1 + F.exp(-odds))).drop("_own", "_key", "n", "s", "site_n", "site_s")


def _judged(docs: DataFrame, labels: DataFrame, columns: list[str], site: str, path: str, **options) -> DataFrame:
    return posteriors(table(evidence(docs, fit(docs, labels, **options), columns, site, path), "evidence"), "_s", "_p")


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], site: str = "source", path: str = "lang", threshold: float = KEEP, **options) -> DataFrame:
    """The columns `keep` with own_score, site_rate, path_rate, quality_score and keep, which replace kept columns
    of these names."""
    keep = [c for c in keep if c not in ("own_score", "site_rate", "path_rate", "quality_score", "keep")]
    scored = _judged(docs, labels, keep, site, path, **options)
    return scored.select(*restored(keep), (1 / (1 + F.exp(-F.col("own_logit")))).alias("own_score"), "site_rate", "path_rate", "quality_score", (F.col("quality_score") >= threshold).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", threshold: float = KEEP, **options) -> DataFrame:
    """The rows of docs whose posterior reaches the threshold."""
    return _judged(docs, labels, docs.columns, site, path, **options).where(F.col("quality_score") >= threshold).select(*restored(docs.columns))


def op9_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, own_score, site_rate, path_rate, quality_score, keep of all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
