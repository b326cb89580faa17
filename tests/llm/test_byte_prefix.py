"""Prefix encoding against the library; edits against encoding anew."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewrack.llm import byte_prefix

from test_ops import ODD, SCHEMA, SF

LETTERS = "ab c'srevlt \n\t12.,!é日😀xX \x00"


@pytest.fixture(scope="module")
def codec():
    return byte_prefix.load(*byte_prefix.ranks_path())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("test", pat_str=byte_prefix.ranks_path()[1], mergeable_ranks=codec.ranks, special_tokens={})


def some(r, most):
    return "".join(r.choice(LETTERS) for _ in range(r.randrange(most)))


def test_each_prefix_has_the_last_token_of_its_encoding(codec, library):
    r = random.Random(3)
    for _ in range(300):
        piece = bytes(r.choice(b"aeinst th\xc3\xa9\xff..") for _ in range(r.randrange(1, 40)))
        last = codec.last_tokens(piece)
        for k in range(1, len(piece) + 1):
            assert last[k - 1] == library._core_bpe.encode_single_piece(piece[:k])[-1]


def test_ids_are_the_librarys(codec, library):
    r = random.Random(4)
    for _ in range(4000):
        text = some(r, 60)
        assert codec.encode(text).tolist() == codec.ids(codec.prefixes(text)).tolist() == library.encode_ordinary(text)
    for text in ("x" * 200_000, " " * 50_000 + "y", "<|endoftext|>", "word " * 120_000):
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_merges_of_equal_rank_and_a_small_vocabulary(tmp_path):
    """Runs of one byte, and a token that no merge makes."""
    import base64

    pieces = [bytes([b]) for b in range(256)] + [b"aa", b"aaa", b"ab", b"aab", b"bcde", b"aaaa"]
    file = tmp_path / "ranks"
    file.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(pieces)))
    codec = byte_prefix.Codec(str(file), "[a-z]+|[^a-z]+")
    library = tiktoken.Encoding("own", pat_str="[a-z]+|[^a-z]+", mergeable_ranks={p: k for k, p in enumerate(pieces)}, special_tokens={})
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("aaaabcde ") for _ in range(r.randrange(30)))
        assert codec.encode(text).tolist() == library.encode_ordinary(text)
    assert codec.encode("bcde").tolist() == library.encode_ordinary("bcde") == [260]


def test_a_vocabulary_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        byte_prefix.Codec(str(tmp_path / "ranks"), ".")


def test_edits_give_what_encoding_anew_gives(codec):
    r = random.Random(6)
    for _ in range(6000):
        text, put = some(r, 40), some(r, 6)
        a = len(text) if r.random() < 0.3 else r.randrange(len(text) + 1)
        z = min(len(text), a + r.choice([0, 0, 1, 2, 7]))
        last = codec.edited(text.encode(), codec.prefixes(text), len(text[:a].encode()), len(text[a:z].encode()), put.encode())
        assert last.tolist() == codec.prefixes(text[:a] + put + text[z:]).tolist()


def test_an_append_to_a_long_pre_token_only_adds(codec, monkeypatch):
    text = "x" * 100_000
    last, asked = codec.prefixes(text), []
    stand = codec.stand
    monkeypatch.setattr(codec, "stand", lambda a, b: asked.append(1) or stand(a, b))
    grown = codec.edited(text.encode(), last, len(text), 0, b"yz")
    assert len(asked) < 100 and grown[:-2].tolist() == last.tolist() and len(grown) == len(text) + 2


def test_columns(spark, codec, library):
    odd = spark.createDataFrame([(k, t, None, "s", None, 9, 0.5, "z", 1, 2, 3, "h") for k, t in ODD], SCHEMA)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd, odd.limit(0)):
        rows = byte_prefix.decode(byte_prefix.encode(df, carry=["doc_id", "text"])).collect()
        assert len(rows) == df.count()
        for x in rows:
            assert x.ids == library.encode_ordinary(x.text or "") and bytes(x.decoded).decode() == (x.text or "")
    clash = odd.withColumn("last", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("decoded", F.lit(3))
    assert byte_prefix.decode(byte_prefix.encode(clash)).columns == [*(c for c in clash.columns if c not in ("ids", "decoded")), "ids", "decoded"]
    told = byte_prefix.encode(docs, prefixes=True, carry=["doc_id", "text"])
    changed = told.select("doc_id", "text", F.when(F.col("doc_id") % 5 > 0, F.col("last")).alias("last"), (F.col("doc_id") * 7 % 400).alias("at"), (F.col("doc_id") % 4).alias("n"), F.when(F.col("doc_id") % 3 > 0, " it's né").alias("put"))
    for x in byte_prefix.edit(changed, "at", "n", "put").collect():
        assert x.ids == library.encode_ordinary(x.text) and x.last == codec.prefixes(x.text).tolist()
    before = {x.doc_id: x for x in changed.collect()}
    for x in byte_prefix.edit(changed, "at", "n", "put").select("doc_id", "text").collect():
        old = before[x.doc_id]
        assert x.text == old.text[: old["at"]] + (old.put or "") + old.text[old["at"] + old.n :]


def test_query(spark, library, monkeypatch):
    from tidewrack.llm import queries

    monkeypatch.setattr(byte_prefix, "BLOCK", 50)
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_byte_prefix(spark, SF).collect()
    assert len(got) == len(docs)
    for x in got:
        ids = library.encode_ordinary(docs[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(docs[x.doc_id].encode()).hexdigest()
    empty = byte_prefix.digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in empty} == {(0, *[hashlib.sha256(b"").hexdigest()] * 2)}
