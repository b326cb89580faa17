"""The jobs over growing input, run again, and taken up after a failure."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from jobs import answer_batch, cli, index_documents, queries
from tidewrack.operators import postings as P
from tidewrack.operators import scoring as X
from tidewrack.runtime import run_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def put(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def held(spark, out):
    return sorted((r.key, r.length, r.batch) for r in P.documents(index_of(spark, out)).collect())


def index_of(spark, out):
    return index_documents.index_of(spark, out)


def test_index_takes_only_what_is_new(spark, tmp_path):
    docs, out = str(tmp_path / "d"), str(tmp_path / "o")
    put(spark, docs, [(1, "a b", "s"), (2, None, "s"), (2, "b", "s"), (None, "no key", "s")])
    assert index_documents.run(spark, docs, out) == 2
    before = held(spark, out)
    assert before == [(1, 2, 0), (2, 1, 0)]
    assert index_documents.run(spark, docs, out) == 0 and held(spark, out) == before
    put(spark, docs, [(1, "another text of a known key", "s"), (3, "a c", "s"), (4, "", "s")])
    assert index_documents.run(spark, docs, out) == 2
    assert held(spark, out) == [*before, (3, 2, 1), (4, 0, 1)]
    asked = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    whole = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "a c"), (4, "")], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("item_id", "doc_id", "score", "rank").collect()))
    assert rows(P.search(index_of(spark, out), asked, 5)) == rows(X.bm25_top(whole, asked, 5))


def test_index_takes_a_failed_batch_again(spark, tmp_path):
    docs, out = str(tmp_path / "d"), str(tmp_path / "o")
    put(spark, docs, [(1, "a b", "s")])
    index_documents.run(spark, docs, out)
    put(spark, docs, [(2, "b c d", "s"), (3, "x", "s")])
    index_documents.run(spark, docs, out)
    want = held(spark, out)
    for name in ("1", ".1.crc"):  # as if the run had ended before the second batch was noted
        os.remove(f"{out}/checkpoint/commits/{name}")
    assert index_documents.run(spark, docs, out) == 2 and held(spark, out) == want


def test_index_by_files_and_without_rows(spark, tmp_path):
    docs, out = str(tmp_path / "d"), str(tmp_path / "o")
    put(spark, docs, [])
    assert index_documents.run(spark, docs, out) == 0 and index_of(spark, out) is None
    for k in range(3):
        put(spark, docs, [(k, f"w{k} common", "s")])
    assert index_documents.run(spark, docs, out, files_per_batch=1, slice_docs=1) == 3
    assert len({b for _, _, b in held(spark, out)}) == 3


def test_index_of_a_growing_copy_of_the_table(spark, tmp_path):
    docs, out = str(tmp_path / "d"), str(tmp_path / "o")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    table.where("doc_id % 2 = 0").write.parquet(docs)
    index_documents.run(spark, docs, out)
    table.where("doc_id % 2 = 1").write.mode("append").parquet(docs)
    index_documents.run(spark, docs, out)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda df: sorted(map(tuple, df.select("item_id", "doc_id", "score", "rank").collect()))
    assert rows(P.search(index_of(spark, out), items, 4)) == rows(X.bm25_top(table, items, 4))


@pytest.mark.parametrize("name", ["job1_index_documents", "job2_answer_batch"])
def test_queries_equal_their_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "run_folder", lambda _, job: f"file://{tmp_path}/{job}")
    df = queries.register.queries[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.register.sql[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want, key=str) and want
    assert len(os.listdir(tmp_path)) == 1  # both runs went to one folder, which stays


def test_answers_follow_the_input(spark, tmp_path):
    docs, chats, out = (str(tmp_path / x) for x in "dco")
    put(spark, docs, [(1, "The hall opens at nine. It is big.", "hall"), (2, "", "none"), (3, None, None)])
    turns = [(1, 1, "user", "old"), (1, 2, "assistant", "x"), (1, 3, "user", "when opens the hall"), (2, 1, "user", "unknown words"), (3, 1, "user", None), (4, 1, "assistant", "no question"), (None, 1, "user", "hall")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(chats)
    want = [(1, "The hall opens at nine. (source: hall)", "1", "fallback"), (2, answer_batch.NOTHING, "", "empty"), (3, answer_batch.NOTHING, "", "empty")]
    for _ in range(2):
        assert answer_batch.run(spark, docs, chats, out) == {"fallback": 1, "empty": 2}
        assert sorted(map(tuple, answer_batch.written(spark, out).select("conv_id", "answer", "doc_ids", "mode").collect())) == want
    assert len([x for x in os.listdir(f"{out}/index")]) == 1
    put(spark, docs, [(4, "unknown words are here", "late")])
    answer_batch.run(spark, docs, chats, out)
    assert {r.conv_id: r.answer for r in answer_batch.written(spark, out).collect()}[2] == "unknown words are here (source: late)"
    for table in (docs, chats):
        shutil.rmtree(table)
    put(spark, docs, [])
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(chats)
    assert answer_batch.run(spark, docs, chats, out) == {} and answer_batch.written(spark, out).count() == 0


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    for told, error in (({"key": "k"}, None), ({"kex": 1}, "unknown"), ({"key": 3}, "must be str"), ([1], "object")):
        file.write_text(json.dumps(told))
        if error:
            with pytest.raises(ValueError, match=error):
                cli.settings(str(file), {"key": str})
        else:
            assert cli.settings(str(file), {"key": str}) == told
    with pytest.raises(SystemExit):
        cli.main(index_documents.run, ["documents", "out"], {}, ["--documents", "d"])


def test_command_line(spark, tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    put(spark, str(tmp_path / "d"), [(1, "a b", "s")])
    command = [sys.executable, f"{here}/jobs/index_documents.py", "--config", f"{here}/jobs/index_documents.json", "--documents", str(tmp_path / "d"), "--out", str(tmp_path / "o")]
    done = subprocess.run(command, capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "added 1 documents" in done.stderr and held(spark, str(tmp_path / "o")) == [(1, 2, 0)]


def test_jobs_import_nothing_of_the_training_operators():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; import jobs.queries; print([m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline'])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=here).stdout.strip() == "[]"


def test_session_settings_stay(spark, tmp_path):
    put(spark, str(tmp_path / "d"), [(1, "a b", "s")])
    held_by = lambda: sorted(map(tuple, spark.sql("SET").collect()))
    before = held_by()
    index_documents.run(spark, str(tmp_path / "d"), str(tmp_path / "o"))
    assert held_by() == before


def test_each_run_has_a_folder_of_its_own(spark):
    a, b = (run_folder(spark, "job") for _ in range(2))
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir", "file:///").rstrip("/"))


def test_texts_are_cut_before_they_meet_the_rankings(spark):
    docs = spark.createDataFrame([(1, "The hall opens. " * 1000, "hall")], DOCS)
    asked = spark.createDataFrame([(7, "hall")], "conv_id long, question string")
    ranked = spark.createDataFrame([(7, 1, 1.0, 1)], "conv_id long, doc_id long, score double, rank int")
    made = answer_batch.answers(docs, asked, ranked, 0.4, 20)
    join = next(x for x in made._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1:])
    assert "cut#" in join and [(r.answer, r.evidence) for r in made.collect()] == [("The hall opens. (source: hall)", "[1] hall\nThe hall opens. The...")]


def test_a_ranking_is_made_once_for_the_same_files(spark, tmp_path, monkeypatch):
    docs, chats, out = (str(tmp_path / x) for x in ("docs", "chats", "out"))
    spark.createDataFrame([(1, "a bus to town.", "s"), (2, "menu of the hall.", "s")], "doc_id long, text string, source string").write.parquet(docs)
    kind = "conv_id long, turn int, role string, text string"
    spark.createDataFrame([(1, 0, "user", "the bus?")], kind).write.parquet(chats)
    made, search = [], answer_batch.P.search
    monkeypatch.setattr(answer_batch.P, "search", lambda *a: made.append(1) or search(*a))
    both = []
    for _ in range(2):
        answer_batch.run(spark, docs, chats, out)
        both.append(sorted(map(str, answer_batch.written(spark, out).collect())))
    assert made == [1] and both[0] == both[1]
    spark.createDataFrame([(2, 0, "user", "menu?")], kind).write.mode("append").parquet(chats)
    answer_batch.run(spark, docs, chats, out)
    assert made == [1, 1] and answer_batch.written(spark, out).where("doc_ids = '2'").count() == 1
    answer_batch.run(spark, docs, chats, out, top_k=1)
    assert made == [1, 1, 1]
