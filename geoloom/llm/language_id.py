"""Language identification by a conditional random field over words.

Words are runs of letters, in lower case.  The field labels each word of a text, so texts that
switch between languages are labelled span by span; a text's language is the one with most letters
by posterior, and its score is that share.  The field is trained on about `per_label` texts of every language, chosen by a hash
of id and text - all, if a language has fewer, and one at least; fewer if they would hold more than SAMPLE_BYTES in
all.  Of a chosen text of more than SAMPLE_CHARS code points a part of that length counts, at a place drawn by the hash.  Everything else covers
all rows and whole texts.

Nulls: a null text or one without letters (characters of a Unicode letter category) is `und` with score 0, as
is every text if nothing could be learned.  Rows with a null label or id are not learned from; a null id isn't held out.  Repeated
rows are judged alike.  An empty table gives no rows; other columns are not read."""

from __future__ import annotations

import re
import uuid

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, own_memo, restored, texts_of
from .crf import Crf, label_sums, posteriors

WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
PER_LABEL, UNKNOWN, MEMO_WORDS = 250, "und", 700_000
#: Bounds of the sample that is learned from: code points of a text, and bytes of all.
SAMPLE_CHARS, SAMPLE_BYTES = 200_000, 64_000_000
#: Words times labels whose chains are computed at once, and words at most.
NUMBERS, AT_ONCE = 2_000_000, 150_000
_SPREAD = 1 << 30


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; what counts as a word character but is no letter (as ² or Ⅷ) parts them."""
    words = WORD.findall(text.lower())
    if not "".join(words).isalpha():
        words = [x for w in words for x in ([w] if w.isalpha() else LETTERS.findall(w))]
    return words


def learn(docs: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Crf:
    """A field trained on a bounded sample of the rows of docs."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where("id is not null and text is not null and label is not null")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(_SPREAD))
    over = F.length("text") - SAMPLE_CHARS
    part = F.when(over > 0, F.substring("text", F.pmod(F.xxhash64("text", "id"), over + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    rows = rows.withColumn("draw", draw)
    # bytes of a part are at most four a code point
    held_by = F.sum(F.least(F.octet_length("text"), F.lit(4 * SAMPLE_CHARS)))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), held_by.alias("bytes"), F.min("draw").alias("first")).collect()
    if not sizes:
        return Crf.train([], [])
    held = sum(r["bytes"] * min(1.0, per_label / r["n"]) for r in sizes)
    share = min(1.0, SAMPLE_BYTES / max(1.0, held))
    limits = rows.sparkSession.createDataFrame([(r["label"], max(r["first"] + 1, min(_SPREAD, int(_SPREAD * share * per_label / r["n"]) + 1))) for r in sizes], "label string, below long")  # one row a language
    some = rows.join(F.broadcast(limits), "label").where(F.col("draw") < F.col("below")).select("id", "label", part.alias("text")).distinct().collect()
    some = sorted(some, key=lambda r: (r["id"], r["label"], r["text"]))
    return Crf.train([words_of(r["text"]) for r in some], [r["label"] for r in some])


class Judge:
    """Predictions with a memo of words' scores."""

    def __init__(self, model: Crf):
        self.model, self.rows, self.new = model, {}, []
        self.at_once = max(256, min(AT_ONCE, NUMBERS // max(1, len(model.labels))))
        self.memo_words = min(MEMO_WORDS, 16 * NUMBERS // max(1, len(model.labels)))
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def _index(self, words: list[str]) -> np.ndarray:
        rows, new = self.rows, self.new
        got = list(map(rows.get, words))
        at = -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            w = words[at]
            if (i := rows.get(w)) is None:
                i = rows[w] = len(rows)
                new.append(w)
            got[at] = i
        return np.array(got, np.int64)

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        part, size = [], 0
        for t in texts:
            words = words_of(t)
            if part and size + len(words) > self.at_once:
                out += self._judge(part)
                part, size = [], 0
            if len(words) > 2 * self.at_once:
                out.append(self._judge_long(words))
            else:
                part.append(words)
                size += len(words)
        return out + self._judge(part)

    def _judge_long(self, words: list[str]) -> tuple[str, float]:
        """One text, with `at_once` words' chains held at a time."""
        if not self.model.labels:
            return UNKNOWN, 0.0
        letters = np.fromiter(map(len, words), np.float64, len(words))
        share = label_sums(lambda lo, hi: self.model.scores(words[lo:hi]), len(words), letters, self.model.trans, self.at_once) / letters.sum()
        best = int(share.argmax())
        return self.model.labels[best], float(min(1.0, max(0.0, share[best])))

    def _judge(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        out, labels = [(UNKNOWN, 0.0)] * len(texts), self.model.labels
        some = [i for i, t in enumerate(texts) if t]
        if not some or not labels:
            return out
        if len(self.rows) > self.memo_words:
            self.rows, self.scores = {}, self.scores[:0]
        ids = [self._index(texts[i]) for i in some]
        if self.new:
            self.scores = np.concatenate([self.scores, self.model.scores(self.new)])
            self.new.clear()
        sizes = np.array([len(x) for x in ids], np.int64)
        prob, _, _ = posteriors(self.scores[np.concatenate(ids)], sizes, self.model.trans)
        letters = np.fromiter((len(w) for i in some for w in texts[i]), np.float64, len(prob))
        starts = np.cumsum(sizes) - sizes
        share = np.add.reduceat(prob * letters[:, None], starts) / np.add.reduceat(letters, starts)[:, None]
        for i, s in zip(some, share):
            best = int(s.argmax())
            out[i] = labels[best], float(min(1.0, max(0.0, s[best])))
        return out

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its language and the posterior."""
        words = words_of(text)
        if not words or not self.model.labels:
            return []
        prob, _, _ = posteriors(self.model.scores(words), np.array([len(words)]), self.model.trans)
        return [(w, self.model.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, prob)]


_judges: dict[str, Judge] = {}


def predict(docs: DataFrame, model: Crf, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred and score, which replace kept columns of these names."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    return _predicted(docs, model, keep, text_col).select(*restored(keep), "lang_pred", "score")


def identified(docs: DataFrame, model: Crf, share: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known and has at least that share of the letters."""
    found = _predicted(docs, model, docs.columns, text_col)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= share)).select(*restored(docs.columns))


def _predicted(docs: DataFrame, model: Crf, keep: list[str], text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by crf.MODEL
    key = uuid.uuid4().hex
    rows = docs.select(*carried(keep), F.col(text_col).cast("string").alias("_text"))
    kinds = rows.dtypes[:-1]

    def make():
        if key not in _judges:
            _judges.clear()
            _judges[key] = Judge(sent.value)
        own_memo("languages", _judges.clear)
        judge = _judges[key]

        def f(batch):
            found = judge.judge(texts_of(batch, "_text"))
            return {x: batch.column(x) for x, _ in kinds} | {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return f

    return arrow_map(rows, make, "".join(f"`{x}` {kind}, " for x, kind in kinds) + "lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents, learned from those not held out."""
    docs = held_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return predict(docs, learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
