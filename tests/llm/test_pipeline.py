import corpus_pipeline as cp
from geoloom.llm import language_id, near_duplicates, quality

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = [docs]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, left[-1], SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        left.append(out.cache())
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in left]
    assert ids[0] > ids[1] >= ids[2] > ids[3]
    good = {i for i in ids[0] if labels.get(i) == 1}
    assert len(good - ids[1]) <= 3 and sum(labels.get(i) == 0 for i in ids[1]) <= 3
    # each stage decides as its operator does on its own input
    model = language_id.learn(left[1])
    kept = {r["doc_id"] for r in language_id.predict(left[1], model, ["doc_id"]).where("lang_pred != 'und' and score >= 0.5").collect()}
    assert kept == ids[2]
    firsts = {r["class_id"] for r in near_duplicates.near_duplicate_classes(left[2]).collect()}
    assert firsts == ids[3]
    packed = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == ids[3]
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(ends.values()) // 4096) * 1.01 + 1
    assert quality.KEEP == cp.LANGUAGE_SHARE == 0.5


def test_odd_rows_and_clashing_columns(spark):
    rows = [(i, "the and of to in that it with for was " * 3 + str(i), "en", "s", 40, 0.5, "x", True, 1) for i in range(30)]
    rows += [(100, None, None, None, None, None, None, None, None), (None, "the and of to in that", "en", None, 1, 0.1, "", False, 2), (7, "!!", "en", "s", 2, 0.1, "", False, 2), (101, "the and of it " * 9000, "en", "t", 0, 0.0, "", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, keep boolean, _s int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(where := (spark.conf.get("spark.checkpoint.dir") + "/odd/labels.parquet"))
    for data in (docs, docs.limit(0)):
        out = data
        for name, stage in cp.STAGES:
            out = stage(spark, out, where.rpartition("/")[0])
            n = out.count()
            assert name == "packing" or out.columns == docs.columns
        assert n > 0 or data is not docs
