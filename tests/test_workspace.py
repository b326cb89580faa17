import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewrack import workspace as W
from tidewrack.sources import vectors

GOOD = """
[workspace]
name = "campus"
timezone = "Asia/Seoul"
[[workspace.periods]]
label = "spring"
start = 2026-03-02
end = "2026-06-20"
[rag]
index_path = "data/index.jsonl"
top_k = 4
[prompts]
system = "system.txt"
[evals]
smoke = "smoke.json"
"""


@pytest.fixture
def root(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / W.SETTINGS).write_text(GOOD)
    (tmp_path / "system.txt").write_text(" be brief \n")
    (tmp_path / "smoke.json").write_text("[]")
    (tmp_path / "data/index.jsonl").write_text('{"id": "a", "text": "b", "source_name": "s", "source_url": "u"}\n')
    return tmp_path


def test_settings(root):
    c = W.load_config(root / W.SETTINGS, {W.ENV_MODEL: "m2"})
    assert (c.workspace.name, c.rag.top_k, c.rag.max_fact_chars, c.runtime.model) == ("campus", 4, 500, "m2")
    assert c.workspace.periods == (W.Period("spring", date(2026, 3, 2), date(2026, 6, 20)),)
    assert c.rag.index_path == root / "data/index.jsonl" and c.evals["smoke"] == root / "smoke.json"
    assert W.system_prompt(c) == "be brief" and W.missing_files(c) == []


@pytest.mark.parametrize("old,new,said", [
    ("[rag]", "[other]", "missing section"), ("top_k = 4", "top_k = 0", "top_k"), ("top_k = 4", 'backend = "no"', "backend"), ('system = "system.txt"', "", "system"), ("start = 2026-03-02", 'start = "x"', "periods"), ("name =", "name ==", "can't be read"), ('name = "campus"', "", "workspace"),
])
def test_wrong_settings(root, old, new, said):
    (root / W.SETTINGS).write_text(GOOD.replace(old, new, 1))
    with pytest.raises(W.ConfigError, match=said):
        W.load_config(root / W.SETTINGS, {})


@pytest.mark.parametrize("closed", [False, True])
def test_discovery_and_paths(root, tmp_path, monkeypatch, closed):
    """Whatever the machine has at /data; ``closed``: a folder that can't be entered."""
    stat = os.stat

    def told(path, *args, **kwargs):
        if str(path).startswith("/data/"):
            raise PermissionError(13, "closed") if closed else FileNotFoundError(2, "none")
        return stat(path, *args, **kwargs)

    monkeypatch.setattr(os, "stat", told)
    deep = root / "a/b"
    deep.mkdir(parents=True)
    assert W.discover(None, {}, deep) == root / W.SETTINGS
    assert W.discover(str(root), {}, deep) == root / W.SETTINGS and W.discover(None, {W.ENV_WORKSPACE: "/x/y.toml"}, deep).name == "y.toml"
    for bad in (None, " ", root / "none.toml"):
        with pytest.raises(W.ConfigError):
            W.load_config(bad, {})
    (root / "data/q.json").write_text("[]")
    assert W.input_path("/data/q.json", root, deep) == W.input_path("data/q.json", root, deep) == W.input_path("q.json", root, deep) == root / "data/q.json"
    assert W.input_path("other.json", root, deep) == deep / "data/other.json"
    assert W.output_path("/outputs/a.json", root, cwd=deep) == W.output_path("a.json", root, cwd=deep) == root / "outputs/a.json"
    assert W.output_path("outputs/a.json", root, True, deep) == deep / "outputs/a.json" and (deep / "outputs").is_dir()
    assert W.output_path(str(root / "x/y.json"), root) == root / "x/y.json"
    warned = []
    assert W.token_config(root / "none.json", warned.append) is None and len(warned) == 1 and W.token_config(None) is None


def test_checks(spark, root):
    said = W.doctor(spark, str(root / W.SETTINGS))
    assert said["status"] == "ok" and said["exit_code"] == 0
    assert W.doctor(spark, str(root / W.SETTINGS), lambda url: "down")["exit_code"] == 3
    (root / "data/index.jsonl").write_text('{"id": "a", "text": "b"}\nbroken\n')
    said = W.doctor(spark, str(root / W.SETTINGS), lambda url: "down")
    assert said["exit_code"] == 1 and said["components"]["docs"]["status"] == "fail" and len(said["errors"]) == 2
    (root / "system.txt").unlink()
    assert W.validate(str(root / W.SETTINGS))[1].errors and W.doctor(spark, None)["status"] == "fail"
    assert W.main(["validate", "--workspace", str(root / "none.toml")]) == 1


def test_batch_keeps_order_and_says_how(spark, root):
    asked = [{"user": "one"}, {"question": "two"}, {"user": ""}, {"user": "four"}]
    (root / "data/q.json").write_text(json.dumps(asked))

    def answer(df):
        fails = F.col("question").isin("two", "four")
        return df.withColumns({"first": F.when(~fails, F.concat(F.lit("A "), "question")), "second": F.when(F.col("question") == "two", F.lit("B")), "fallback": F.lit("C"), "error": F.lit("broke")})

    out = W.run_batch(spark, W.load_config(root / W.SETTINGS, {}), "data/q.json", "a.json", answer, True)
    assert [r["model"] for r in json.loads(out.read_text())][::3] == ["A one", "C"] and [r["user"] for r in json.loads(out.read_text())] == ["one", "two", "", "four"]
    how = json.loads((out.parent / "a.provenance.json").read_text())
    assert [(r["index"], r["mode"], r["error"]) for r in how] == [(0, "llm", ""), (1, "llm_retry", "broke"), (2, "fallback", "missing question"), (3, "fallback", "broke")]
    assert W.check_answers(out) == [] and len(W.digest(out)) == 64
    with pytest.raises(W.WorkspaceError):
        W.write_answers([{"index": 0, "question": "q", "model": " ", "mode": "llm"}], root / "bad.json")
    assert not (root / "bad.json").exists()


def test_vectors_are_made_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y")], "id string, title string, text string")
    made = []

    def embed(df):
        made.append(1)
        return df.select("id", F.array(F.lit(1.0)).alias("vector"))

    for _ in range(2):
        assert vectors.cached_vectors(docs.orderBy(F.rand()), str(tmp_path), "m/1", embed).count() == 2
    assert len(made) == 1
    vectors.cached_vectors(docs, str(tmp_path), "m2", embed)
    assert vectors.cached_vectors(docs.limit(1), str(tmp_path), "m2", embed).count() == 1 and len(made) == 3
