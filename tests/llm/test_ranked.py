"""Ranked search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.llm import queries, ranked_search

from test_ops import ODD, SCHEMA, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    bags = [(key, Counter(terms(t))) for key, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for key, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return out


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_radix_sums_equal_a_dictionary():
    r = np.random.default_rng(1)
    for n, items, docs in ((0, 3, 3), (1, 1, 1), (5000, 7, 300), (20_000, 70_000, 5), (3000, 3, 1 << 21)):
        item, doc, impact = r.integers(0, items, n), r.integers(0, docs, n), r.integers(0, 10**15, n)
        want = Counter()
        for q, d, s in zip(item.tolist(), doc.tolist(), impact.tolist(), strict=True):
            want[q, d] += s
        q, d, s = ranked_search.summed(item, doc, impact, docs)
        assert list(zip(q.tolist(), d.tolist(), strict=True)) == sorted(want) and [want[x] for x in sorted(want)] == s.tolist()


def test_heaps_order_ties_and_null_keys():
    r, rows = random.Random(2), []
    held = ranked_search.Best(4)
    for _ in range(500):
        row = (r.randrange(3), r.randrange(5), r.choice([None, *range(30)]))
        rows.append(row)
        held.add(*row)
    for item in range(3):
        want = sorted(((-s, k is None, k or 0, k) for q, s, k in rows if q == item))[:4]
        assert [(s, k) for q, s, k, _ in held.rows() if q == item] == [(-x[0], x[3]) for x in want]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # turns of few items, blocks of few triples
        monkeypatch.setattr(ranked_search, "TURN_TERMS", 3)
        monkeypatch.setattr(ranked_search, "CELLS", 2)
    odd = spark.createDataFrame([(k, t, None, "s", None, 9, 0.5, "z", 1, 2, 3, "h") for k, t in ODD], SCHEMA)
    items = [(1, "Same words, here; ÜBER über"), (1, "lorem ipsum"), (1, "lorem ipsum"), (2, None), (3, ""), (None, "a text and x"), (4, "日本語の文章"), (5, "x" * 40_000)]
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    assert got(ranked_search.search(odd, table)) == sorted(brute(ODD, items), key=str)
    assert got(ranked_search.search(odd, table, k=1)) == sorted(brute(ODD, items, 1), key=str)
    for empty in (ranked_search.search(odd.limit(0), table), ranked_search.search(odd, table.limit(0)), ranked_search.search(odd, table.where("item_id = 2"))):
        assert empty.count() == 0


def test_many_copies_tie_by_key(spark):
    docs = [(k, "common words of all copies") for k in range(500)] + [(1000 + k, f"common w{k}") for k in range(50)]
    items = [(1, "common words"), (2, "copies w7"), (3, "nothing here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("extra", F.lit(1))
    assert got(ranked_search.search(df, spark.createDataFrame(items, "item_id long, text string"))) == sorted(brute(docs, items), key=str)


def test_query_equals_brute_force_and_sql(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = got(queries.op12_ranked_search(spark, SF))
    assert found == sorted(brute(docs, items), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP12})").fetchall(), key=str) == found
