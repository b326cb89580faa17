"""Pages of several charsets from files."""

from tidewrack.sources import pages as P


def test_files_in_their_own_charsets(spark, tmp_path):
    text = "<title>공지사항 안내</title>"
    files = {
        "a.html": b"<meta charset=euc-kr>" + text.encode("euc-kr"),
        "deep/b.html": b'<META http-equiv="Content-Type" content="text/html; CHARSET = \'UTF-8\'">' + text.encode(),
        "c.html": text.encode(),
        "unknown.html": b"<meta charset='no-such-set'>" + text.encode(),
        "codec.html": b"<meta charset='rot13'>plain",
        "late.html": b" " * 2100 + b"<meta charset=euc-kr>" + text.encode(),
        "broken.html": b"<meta charset=utf-8>\xff\xfeok",
        "empty.html": b"",
        "skipped.txt": b"x",
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.charset, r.html) for r in P.read_pages(spark, str(tmp_path)).collect()}
    assert set(got) == {n.rsplit("/")[-1] for n in files} - {"skipped.txt", "empty.html"}
    assert got["a.html"] == ("euc-kr", "<meta charset=euc-kr>" + text) and got["b.html"][0] == "utf-8" and got["b.html"][1].endswith(text)
    assert got["c.html"] == ("utf-8", text) and got["unknown.html"][1].endswith(text) and got["codec.html"][1].endswith("plain")
    assert got["late.html"][0] == "utf-8" and got["broken.html"][1] == "<meta charset=utf-8>��ok"


def test_null_bytes(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "k int, content binary")
    assert [(r.k, r.charset, r.html) for r in P.with_text(df).orderBy("k").collect()] == [(1, "utf-8", None), (2, "utf-8", "x")]
    assert P.with_text(df.limit(0)).count() == 0
