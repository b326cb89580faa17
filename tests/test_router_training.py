"""The fitted router against a fit on one machine, and on odd rows."""

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewrack.functions.slices import slices
from tidewrack.operators import router
from tidewrack.operators import router_training as R
from tidewrack.plans import training

SF = "/root/testdata/sf0.001"


def counts(text):
    out = Counter()
    for found, n in router.ngrams(text):
        for g in found:
            out[g] += n
    return out


def single_machine(texts, labels, terms, penalty, steps=3000):
    """Plain gradient descent on the same loss, from the same features."""
    df = Counter(g for t in texts for g in counts(t))
    names = sorted(sorted((t for t in df if df[t] >= 2), key=lambda t: (-df[t], t))[:terms])
    idf = np.array([math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in names])
    at = {t: k for k, t in enumerate(names)}

    def vector(text):
        v = np.zeros(len(names))
        for g, n in counts(text).items():
            if g in at:
                v[at[g]] = n
        v *= idf
        return v / np.linalg.norm(v) if v.any() else v

    x, classes = np.array([vector(t) for t in texts]), sorted(set(labels))
    y = np.eye(len(classes))[[classes.index(c) for c in labels]]
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - y) / len(x)
        w, b = w - 4 * (x.T @ g + penalty * w), b - 4 * g.sum(0)
    return names, idf, lambda text: classes[int(np.argmax(vector(text) @ w + b))]


def test_held_out_f1_is_that_of_a_single_machine(spark, tmp_path):
    rows = [(x.doc_id, x.text, x.lang) for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if x.text and len(x.text) < 4000]
    langs = sorted({x[2] for x in rows})
    data = [(k, t, langs.index(c)) for k, t, c in rows]
    fit, held = [x for x in data if x[0] % 3], [x for x in data if x[0] % 3 == 0]
    df = spark.createDataFrame(data, "k long, text string, label int")
    parts = R.train(df.where("k % 3 <> 0"), terms=800, penalty=1e-3)
    names, idf, told = single_machine([t for _, t, _ in fit], [y for _, _, y in fit], 800, 1e-3)
    got = {r.term: r.idf for r in parts[0].collect()}
    assert sorted(got) == names and np.allclose([got[t] for t in names], idf)
    R.router.save(str(tmp_path / "m"), *parts)
    again = router.load(spark, [str(tmp_path / "m")])
    said = router.decide(df.where("k % 3 = 0"), *again, "k", "text").select("k", F.col("class").alias("predicted")).join(df, "k")
    ours = R.macro_f1(said, "label", "predicted")
    theirs = spark.createDataFrame([(k, y, told(t)) for k, t, y in held], "k long, label int, predicted int")
    assert ours >= R.macro_f1(theirs, "label", "predicted") - 0.02 and ours > 0.8


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, None)], "y int, p int")
    assert R.macro_f1(df, "y", "p") == pytest.approx((2 / 3 + 2 / 4 + 0) / 3)


def test_odd_rows(spark):
    rows = [("aa bb", 3), ("aa bb", 3), (None, 7), ("", 7), ("cc dd", 7), ("cc aa", None)]
    df = spark.createDataFrame(rows, "text string, label int").withColumn("class", F.lit("clash")).withColumn("grams", F.lit(1))
    parts = R.train(df)
    model = router.model_of(*parts)
    assert model.classes == [3, 7] and " aa " in model.terms and "cc" not in model.terms
    asked = spark.createDataFrame([(1, "aa bb"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r["class"] for r in router.decide(asked, *parts, "k", "t").collect()} == {1: 3, 2: 7, 3: 7}
    one = R.train(df.where("label = 3"))
    assert {r["class"] for r in router.decide(asked, *one, "k", "t").collect()} == {3}
    with pytest.raises(ValueError):
        R.train(df.limit(0))
    with pytest.raises(ValueError):
        R.train(spark.range(200).select(F.lit("x").alias("text"), F.col("id").alias("label")))


def test_a_model_that_does_not_fit_together_is_refused_before_it_is_collected(spark, monkeypatch):
    parts = R.train(spark.createDataFrame([("aa bb", 0), ("aa cc", 1)], "text string, label int"))
    for bad in (parts[1].limit(1), parts[1].unionAll(parts[1].limit(1)), parts[1].withColumn("weight", F.lit(None).cast("double")), parts[1].withColumn("class", F.lit(9))):
        with pytest.raises(ValueError, match="weights"):
            router.model_of(parts[0], bad, parts[2])
    monkeypatch.setattr(router, "MOST_WEIGHTS", 1)
    with pytest.raises(ValueError, match="at most 1 weights"):
        router.model_of(*parts)


def test_export_and_batch(spark, tmp_path):
    rows = [("menu of the hall", 0), ("menu today", 0), ("shuttle bus", 1), ("bus to town", 1)]
    R.export(spark.createDataFrame(rows, "text string, label int"), str(tmp_path / "m"))
    (tmp_path / "q.json").write_text(json.dumps([{"question": "the bus?"}, {"user": "menu"}, {"question": ""}]))
    R.classify_batch(spark, str(tmp_path / "q.json"), str(tmp_path / "m"), str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["question"] for x in lines] == ["the bus?", "menu", ""] and [x["label"] for x in lines][:2] == [1, 0]
    none = R.classify_batch(spark, str(tmp_path / "q.json"), str(tmp_path / "none"), str(tmp_path / "out2"))
    assert [r.label for r in none.collect()] == [None] * 3


def test_query(spark):
    out = training.router_languages(spark, SF)
    held = out.where("held_out AND label IS NOT NULL")
    assert held.count() and R.macro_f1(held, "label", "predicted") > 0.8
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_terms_are_counted_in_slices_of_bounded_text(spark, monkeypatch):
    texts = ["aa bb", "aa aa", None, "", "x" * 50, "aa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = Counter(g for t in texts for g in counts(t))
    assert {r.term: r.documents for r in R.document_frequencies(df, "text").collect()} == want
    monkeypatch.setattr(R, "MOST_HELD", 1)
    assert {r.term: r.documents for r in R.document_frequencies(df, "text").collect()} == want
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [s.column(0).to_pylist() for s in slices(batch, 0, most=10)] == [["aa bb", "aa aa", None, ""], ["x" * 50], ["aa"]]


def test_the_sample_is_that_of_the_order_by_hash(spark):
    df = spark.createDataFrame([(f"t{k % 7}", k % 3) for k in range(60)] + [(None, 1)] * 3, "text string, class int").repartition(3)
    for most in (0, 1, 8, 9, 40, 63, 100):
        want = df.orderBy(F.xxhash64("text"), "text", "class").limit(most)
        assert sorted(map(str, R.sampled(df, most).collect())) == sorted(map(str, want.collect()))


def test_weights_are_fitted_on_all_rows(spark):
    df = spark.range(100_400).select(F.lit("aa").alias("text"), (F.col("id") >= 100_000).cast("int").alias("label"))
    model = router.model_of(*R.train(df, terms=5))
    x = np.array([counts("aa")[t] for t in model.terms]) * model.idf
    score = model.weight @ x / np.linalg.norm(x) + model.bias
    assert abs(score[1] - score[0] - math.log(400 / 100_000)) < 0.05


def test_slopes_are_those_of_the_loss(spark, monkeypatch):
    rows = [("aa bb aa", 0), ("bb cc", 1), (None, 1), ("cc " * 300, 2), ("aa dd", 0), ("dd", 2)]
    names, idf = sorted({g for t, _ in rows for g in counts(t)}), np.linspace(1, 2, len({g for t, _ in rows for g in counts(t)}))
    known, r = spark.createDataFrame(rows, "text string, class int"), np.random.default_rng(1)
    w, b = r.normal(size=(3, len(names))), r.normal(size=3)
    x = np.array([[counts(t)[g] for g in names] for t, _ in rows]) * idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    p = np.exp(x @ w.T + b)
    p /= p.sum(1, keepdims=True)
    y = np.eye(3)[[c for _, c in rows]]
    for full in (0, 9):
        monkeypatch.setattr(R, "FULL", full)
        got = R._summed(R.features(known, names, idf, [0, 1, 2]), w * idf, b)
        assert np.allclose(got[:, : len(names)] * idf, (p - y).T @ x, atol=1e-5)
        assert np.allclose(got[:, -3], (p - y).sum(0), atol=1e-5) and got[:, -1].tolist() == [2, 2, 2]
        assert np.allclose(got[:, -2].sum(), -np.log(p[y > 0]).sum(), atol=1e-5)


def test_the_least_value_is_found():
    a = np.diag(np.linspace(1, 50, 12))
    found = R.minimum(lambda x: (x @ a @ x / 2 - x.sum() + 9, a @ x - 1), np.zeros(12), 200)
    assert np.allclose(found, 1 / np.diag(a), atol=2e-2)
