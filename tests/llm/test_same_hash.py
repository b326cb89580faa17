"""Different texts that polynomial hashes modulo 2**64 take for equal, through the operators."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewrack.llm import fertility, packing, spm_codec, token_counts, vocab

from test_ops import brute_rules


def twins(a, b, order=11):
    """A Thue-Morse text of two letters, and its complement."""
    bits = [0]
    for _ in range(order):
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789.,-+é"
    return [twins("1", "x"), *(twins(*r.sample(letters, 2), order=r.choice([10, 11])) for _ in range(1000))]


def test_tokens_of_each_twin(pairs):
    v = vocab.load(vocab.model_path())
    texts = pa.array([t for p in pairs for t in p], pa.large_string())
    ids = [part for _, _, ids, n in v.encode(texts) for part in np.split(ids, n.cumsum()[:-1])]
    counts = [int(x) for _, _, n, _ in v.count(texts) for x in n]
    for text, own, n in zip(texts.to_pylist(), ids, counts, strict=True):
        want = v.sp.encode(text)
        assert own.tolist() == want and n == len(want)


def test_twins_through_spark(spark, pairs):
    """Each twin is counted, encoded, packed and ruled on as itself; as words and lines too."""
    v = vocab.load(vocab.model_path())
    texts = [t for p in pairs[:40] for t in p] + [f"{a}\n{b}\n{a}" for a, b in pairs[:5]] + [f"{a} {b} {a} {b} {b} {a}" for a, b in pairs[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for x in token_counts.count_tokens(df).collect():
        assert x.n_tokens == len(v.sp.encode(x.text))
    for x in spm_codec.encode(df).collect():
        assert list(x.ids) == v.sp.encode(texts[x.doc_id]) and x.round_trip
    for x in fertility.screen(df, lang=None).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_rules(x.text)
    parts = {}
    for x in packing.pack(df, capacity=256).collect():
        ids = np.frombuffer(x.ids, "<u2")
        parts |= {(k, p): ids[a:z].tolist() for k, p, a, z in zip(x["keys"], x.parts, x.cu_seqlens, x.cu_seqlens[1:])}
    for k, text in enumerate(texts):
        n = sum(1 for x in parts if x[0] == k)
        assert [i for p in range(n) for i in parts[k, p]] == v.sp.encode(text)
