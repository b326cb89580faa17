from pyspark.sql import functions as F

from tidewrack.functions import boards as B
from tidewrack.operators import answers as A


def test_batch(spark):
    rows = spark.createDataFrame([("q", "a", None), ("q", None, "b"), ("q", None, None), ("", "a", None), (None, None, None)], "question string, x string, y string")
    got = [(r.model, r.mode) for r in A.batch(rows, F.col("x"), F.col("y"), F.lit("stored"), "ask something").collect()]
    assert got == [("a", "llm"), ("b", "llm_retry"), ("stored", "fallback"), ("ask something", "fallback"), ("ask something", "fallback")]


def test_routed_without_evidence(spark):
    rows = spark.createDataFrame([("q", None, None, None, None, None), ("q", "t", None, None, None, None), ("q", "t", "r", "", "", True)], "question string, forced string, rag string, fresh string, again string, refused boolean")
    assert [r.answer for r in A.routed(rows, A.Echo(), "none", "failed", "refused").collect()] == ["none", "failed", "refused"]


def test_tools():
    tools = A.Tools()
    tools.tool("twice", "doubles", {"x": "int"})(lambda x: [x, x])
    tools.tool("bad", "fails", {})(lambda: 1 / 0)
    assert [d["name"] for d in tools.definitions()] == ["twice", "bad"]
    assert (tools.dispatch("twice", {"x": 3}), tools.dispatch("bad", None), tools.dispatch("none", {}), tools.dispatch("twice", {"y": 1})) == ([3, 3], [], [], [])


def test_notices_of_odd_pages(spark):
    pages = [None, "", "<tr><td>1</td></tr>", '<TR><TD>공지</TD><td><a href="http://x/y">A</a></td><td></td><td>24.03.05</td></TR>']
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", B.notices(F.col("html"), "http://b").alias("n"))
    got = {r.k: [tuple(x) for x in r.n] for r in rows.collect()}
    assert got == {0: [], 1: [], 2: [], 3: [("A", "", "2024-03-05", "http://x/y", True)]}
