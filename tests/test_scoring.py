"""Retrieval against brute force on small corpora, turns and ties, and the model tables."""

import math
import random
from collections import Counter

import pytest

from tidewrack.operators import evaluation, knowledge, retrieval, router, scoring
from tidewrack.runtime import over_all_cores


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(f"d{k:03}", " ".join(r.choice(words) for _ in range(r.randint(0, 30))) if k % 17 else None) for k in range(n)]


def brute_bm25(docs, query, k):
    split = [scoring.words(t or "") for _, t in docs]
    mean = sum(map(len, split)) / len(split)
    out = []
    for (key, _), own in zip(docs, split):
        tf, s = Counter(own), 0.0
        for w in scoring.words(query):
            n = sum(w in o for o in split)
            if tf[w]:
                s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / mean))
        out.append((key, s))
    return sorted(((x, round(s, 6)) for x, s in out if s > 0), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("cells,turn", [(4_000_000, 200_000), (50, 3)])
def test_bm25_in_blocks_and_turns(spark, monkeypatch, cells, turn):
    monkeypatch.setattr(scoring, "CELLS", cells)
    monkeypatch.setattr(scoring, "TURN_TERMS", turn)
    docs = corpus(1, 90)
    asked = [(1, "w1 w2 w2 W3"), (2, "none of these"), (3, "w5"), (4, ""), (5, None), (6, "w7 w8 w9 w10 w11 w12")]
    got = {}
    for r in scoring.bm25_top(spark.createDataFrame(docs, "id string, text string").repartition(5), spark.createDataFrame(asked, "item_id int, text string"), 7, "id").collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.id, r.score))
    want = {q: brute_bm25(docs, t or "", 7) for q, t in asked}
    assert {q: [(i, pytest.approx(s, abs=2e-6)) for _, i, s in sorted(x)] for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_ties_go_by_key_and_all_is_filled_up(spark):
    docs = spark.createDataFrame([(f"k{n}", None, "same words", None, {"domain": "x"}, None, None) for n in (4, 2, 9, 1)], "id string, title string, text string, domain string, metadata map<string,string>, source_url string, source_name string")
    asked = spark.createDataFrame([(1, "same"), (2, "other"), (3, "!!")], "item_id int, text string")
    got = {}
    for r in knowledge.retrieve(docs, asked, 3).orderBy("rank").collect():
        got.setdefault(r.item_id, []).append(r.id)
    assert got == {1: ["k1", "k2", "k4"], 2: ["k1", "k2", "k4"]}
    assert knowledge.retrieve(docs.limit(0), asked, 3).count() == 0 and knowledge.retrieve(docs, asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        knowledge.retrieve(docs, asked, 3, "dense")
    assert knowledge.search_knowledge_base(docs, asked, 2, "x").count() == 4 and knowledge.search_knowledge_base(docs, asked, 2, "y").count() == 0


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 40)
    monkeypatch.setattr(scoring, "TURN_NUMBERS", 8)
    r = random.Random(2)
    v = [(k, [float(r.randint(-3, 3)) for _ in range(4)]) for k in range(80)]
    df = spark.createDataFrame(v, "vec_id int, embedding array<double>")
    asked = df.where("vec_id % 9 = 0").selectExpr("vec_id AS q", "embedding AS query")
    for others in (False, True):
        got = {}
        for x in scoring.dense_top(df.repartition(3), asked, 5, "vec_id", "q", others=others).collect():
            got.setdefault(x.q, []).append((x["rank"], x.vec_id, x.score))
        for q in range(0, 80, 9):
            want = sorted(((-sum(a * b for a, b in zip(x, v[q][1])), k) for k, x in v if not others or k != q))[:5]
            assert [(k, -s) for s, k in want] == [(k, s) for _, k, s in sorted(got[q])]


def test_model_tables(spark, tmp_path):
    vocabulary = spark.createDataFrame([("ab", 1.5), (" a", 1.0)], "term string, idf double")
    weights = spark.createDataFrame([(t, c, 1.0 + c) for t in ("ab", " a") for c in (0, 1)], "term string, class int, weight double")
    bias = spark.createDataFrame([(0, 0.1), (1, 0.1)], "class int, bias double")
    router.save(str(tmp_path / "m"), vocabulary, weights, bias)
    parts = router.load(spark, [str(tmp_path / "none"), str(tmp_path / "m")])
    asked = spark.createDataFrame([(1, "ab ab"), (2, ""), (3, None)], "k int, t string")
    assert {(r.k, r["class"]) for r in router.decide(asked, *parts, "k", "t").collect()} == {(1, 1), (2, 0), (3, 0)}
    for bad in ((vocabulary.union(vocabulary), weights, bias), (vocabulary, weights.limit(3), bias), (vocabulary, weights, bias.limit(0)), (vocabulary.selectExpr("term", "CAST(NULL AS double) AS idf"), weights, bias)):
        with pytest.raises(ValueError):
            router.model_of(*bad)
    assert router.load(spark, [str(tmp_path / "none")]) is None


def test_advice_and_report():
    assert "unavailable" in evaluation.advice({"lexical": (1, 2)}, 0)[0]
    counts = {"lexical": (1, 2), "bm25": (2, 3), "dense": (1, 2), "hybrid": (1, 3), "bm25_dense": (3, 4)}
    assert evaluation.advice(counts, 1)[-2:] == ["use bm25_dense", "caution: 1 questions regressed"]
    assert evaluation.advice({m: (1, 2) for m in evaluation.MODES}, 0) == ["keep the present way and collect more data"]
    text = evaluation.report({"dining": 2}, {"ok": 1}, counts, 4, 1, 0)
    assert "| `ocr_gap` | 0 |" in text and "| bm25_dense | 3/4 (75.0%) | 4/4 (100.0%) |" in text


def test_term_counts(spark):
    got = {r.term: (r.df, r.cf) for r in retrieval.term_counts(spark.createDataFrame([("a b A",), ("b",), (None,), ("",), ("!!",)], "text string"), "text").collect()}
    assert got == {"a": (1, 2), "b": (2, 2)}


def test_small_scans_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(0, 1000, 1, 9).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    assert over_all_cores(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in over_all_cores(one).collect()) == list(range(1000))
    assert over_all_cores(many).rdd.getNumPartitions() == max(many.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    assert over_all_cores(one.limit(0)).count() == 0
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in over_all_cores(one).where("id = 3")._jdf.queryExecution().toString()


def test_texts_are_scored_in_slices(spark, monkeypatch):
    docs, asked = corpus(3, 60), [(1, "w1 w2 w3"), (2, "w5")]
    df, questions = spark.createDataFrame(docs, "id string, text string").coalesce(1), spark.createDataFrame(asked, "item_id int, text string")
    df = df.withColumn("title", df.text)
    both = lambda: [sorted(map(tuple, x.collect())) for x in (scoring.bm25_top(df, questions, 5, "id"), scoring.lexical_top(df, questions, 5, "title", "id"))]
    want = both()
    monkeypatch.setattr(scoring, "TEXT_BYTES", 1)
    assert both() == want


def test_a_table_of_one_file_is_dealt_by_key(spark, tmp_path):
    from tidewrack.plans.registry import dealt

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = dealt(spark.read.parquet(str(tmp_path / "one")), "id")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and rows.count() == 1000
