"""The pipeline's stages on odd rows, and their decisions on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_odd_rows_and_empty_tables(spark, docs):
    odd = spark.createDataFrame([(None, "plain words and more of them, a line of text.", None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "twice the same words in here, of course.", "en", "s", 9), (3, "twice the same words in here, of course.", "en", "s", 9)], docs.schema)
    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        if name != "token_ids":
            assert out.columns == docs.columns
        assert out.count() <= 5 and stage(spark, odd.limit(0), SF).count() == 0
    assert P.near_duplicates(spark, odd, SF).count() == 4 - 1 + 0  # null and empty texts are one class


def test_columns_of_any_name_stay_as_they_are(spark, docs):
    names = ["k_own", "score", "predicted", "_redacted", "a.b", "in_text", "digest", "class_id", "cosine", "root"]
    wide = docs.limit(60).select("*", *(F.concat(F.lit(f"{k}-"), F.col("doc_id")).alias(n) for k, n in enumerate(names)))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{k}-{r.doc_id}" for k in range(len(names))], name


def test_quality_keeps_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = P.quality(spark, docs, SF).join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.98 * docs.join(labels, "doc_id").where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()


def test_one_document_of_each_group_stays(spark, docs):
    from tidewrack.llm import minhash_join

    kept = {r.doc_id for r in P.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r.class_id for r in minhash_join.group(docs).select("class_id").distinct().collect()}


def test_unlike_texts_of_one_key_all_stay(spark, docs):
    names = [" ".join(f"{x}{k}" for k in range(30)) for x in "abcdef"]
    keyed = [(None, names[0]), (None, names[1]), (None, names[1]), (3, names[2]), (3, names[3]), (3, names[3]), (4, names[3] + " more"), (5, names[4]), (None, names[4]), (5, names[5])]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in keyed], docs.schema)
    kept = [(r.doc_id, r.text) for r in P.near_duplicates(spark, df, SF).collect()]
    assert sorted(kept, key=str) == sorted([(None, names[0]), (None, names[1]), (3, names[2]), (3, names[3]), (5, names[4]), (5, names[5])], key=str)


def test_leaks_go_and_others_stay(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    gone = {r.doc_id for r in docs.select("doc_id").subtract(P.decontaminate(spark, docs, SF).select("doc_id")).collect()}
    assert len(leaking & gone) >= 0.95 * len(leaking) and len(gone - leaking) <= 3


def test_texts_are_redacted(spark, docs):
    out = P.private_data(spark, docs, SF)
    assert out.count() == docs.count()
    assert out.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    assert out.where("n_chars <> char_length(text)").count() == 0


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("not round_trip").count() == 0
