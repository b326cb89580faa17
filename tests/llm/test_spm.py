"""The tree of the scan, and decoding without the library against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewrack.llm import spm_codec, vocab


@pytest.fixture(scope="module")
def path():
    return vocab.model_path()


def test_states_of_a_tree_equal_those_of_one_fold(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for row, n in enumerate([1, 2, 5, 16, 17, 70]):
        sizes = [1, *r.integers(1, 5, n - 1).tolist(), 1]
        made = [np.where(r.random((a, b)) < 0.3, spm_codec.LOWEST, r.integers(-9, 0, (a, b)).astype(float)) for a, b in zip(sizes, sizes[1:])]
        for m in made:
            m[0, 0] = -3.0  # some path always goes through
        states = spm_codec.resolve(made)
        total = lambda at, made=made: sum(m[a, b] for m, a, b in zip(made, [0, *at], at))
        want[row] = (total(states), total, n)
        rows += [(row, k, len(m), m.astype("<f4").tobytes()) for k, m in enumerate(made)]
    df = spark.createDataFrame(rows, "row long, part long, height long, matrix binary")
    for fan in (2, 4, 64):
        got = spm_codec.scan(df, 69, fan).collect()
        for row, (best, total, n) in want.items():
            own = sorted((x.part, x.entry, x.exit) for x in got if x.row == row)
            assert [k for k, _, _ in own] == list(range(n))
            assert [a for _, a, _ in own] == [0, *(z for _, _, z in own[:-1])]
            assert total([z for _, _, z in own]) == best


def test_many_chunks_give_the_librarys_ids(spark, path, monkeypatch):
    monkeypatch.setattr(spm_codec, "FAN", 4)
    monkeypatch.setattr(spm_codec.scan, "__defaults__", (4,))
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "the", "ing", " ", "\n", "é", "日", "😀", "==", "tion", "x" * 9]) for _ in range(n)) for n in (10, 400, 2500)]
    got = {x.doc_id: x for x in spm_codec.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk=64).collect()}
    sp = vocab.load(path).sp
    assert all(list(got[k].ids) == sp.encode(t) and got[k].round_trip for k, t in enumerate(texts))
    assert got[2].n_chunks > 64


def test_decoding_equals_the_library(path):
    sp = vocab.load(path).sp
    r = random.Random(9)
    lists = [[], [1], [0, 5], *([r.randrange(sp.get_piece_size()) for _ in range(r.randint(1, 12))] for _ in range(3000))]
    lists += [sp.encode(t) for t in ["", " ", "  a  b", "é😀\n\n日本", "▁x", "a\tb"]]
    assert spm_codec.decode_ids(path, lists) == [sp.decode(x) for x in lists]


def test_round_trip_flags(path):
    sp = vocab.load(path).sp
    texts = ["plain words", "", "▁ mark", "é\n 日", " lead"]
    ids = [sp.encode(t) for t in texts]
    for wrong in (None, 0, 3):
        own = [x if k != wrong else [*x[:-1], x[-1] + 1] for k, x in enumerate(ids)]
        flat, n = np.array([x for one in own for x in one], np.int64), np.array([len(x) for x in own])
        assert spm_codec._same(path, flat, n, pa.array(texts, pa.large_string())).tolist() == [k != wrong for k in range(len(texts))]
    some = [0, 3, 4]
    flat, n = np.array([x for k in some for x in ids[k]]), np.array([len(ids[k]) for k in some])
    assert spm_codec._same(path, flat, n, pa.array([texts[k] for k in some], pa.large_string())).all()
