"""The corpus pipeline: documents are judged, sorted by language, thinned of near copies and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to
Parquet and hands it, read again, to the next.  All but the last return the columns of documents.

1. quality: documents below even posterior odds go; labels are those of sf_dir.
2. language: the field is learned from the stage's own labelled documents; documents without a letter,
   and those whose language takes less than half of the letters, go.
3. near_duplicates: of each class one document stays, the least doc_id.
4. packing: sequences of 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import language_id, near_duplicates, packing, quality
from geoloom.llm.common import new_path

#: SQL can't express the fitted models and the packing; tests compare the stages with plain ones.
ORACLE_SQL = None

LANGUAGE_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, labels)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identified(docs, language_id.learn(docs), LANGUAGE_SHARE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
