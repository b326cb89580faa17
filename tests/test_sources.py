import json

import pytest

from tidewrack.sources import jsonl
from tidewrack.streaming import trace


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_strict_read_and_write(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [{"id": "1", "text": "t", "extra": 3, "metadata": {"k": "v"}}, "", {"id": "2", "text": "u", "title": "T"}])
    df = jsonl.read_documents(spark, p)
    assert [(r.id, r.title, r.metadata) for r in df.orderBy("id").collect()] == [("1", "", {"k": "v"}), ("2", "T", None)]
    jsonl.write_documents(df, str(tmp_path / "out"))
    assert jsonl.read_documents(spark, str(tmp_path / "out")).count() == 2


def test_strict_read_fails_on_bad_rows(spark, tmp_path):
    with pytest.raises(Exception):
        jsonl.read_documents(spark, write(tmp_path / "b.jsonl", [{"id": "1"}])).collect()


def test_health(spark, tmp_path):
    p = write(tmp_path / "c.jsonl", [{"id": "1", "text": "a", "source_name": "n", "source_url": "u"}, {"id": "1", "text": "b"}, {"id": "2", "text": " "}, "not json", {"id": "3"}])
    r = jsonl.health(spark, p).first()
    assert (r.total, r.invalid, r.duplicate, r.empty, r.no_source_name, r.no_source_url) == (3, 2, 1, 1, 2, 2)


def test_questions_keep_their_order(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps([{"user": "a"}, {"question": "b"}, {"user": "", "question": "c"}, {}]))
    assert [r.question for r in jsonl.read_questions(spark, str(p)).orderBy("index").collect()] == ["a", "b", "c", ""]


def test_trace_stream_picks_up_appended_turns(spark, tmp_path):
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    turn = lambda q, kind=None: spark.createDataFrame([(q, kind)], "question string, type string")
    jsonl.append_trace(turn("one"), log)
    trace.append(trace.read_turns(spark, log), out, mark).awaitTermination()
    jsonl.append_trace(turn("two"), log)
    jsonl.append_trace(turn("good", "feedback"), log)
    trace.append(trace.read_turns(spark, log), out, mark).awaitTermination()
    assert sorted(r.question for r in spark.read.json(out).collect()) == ["one", "two"]
