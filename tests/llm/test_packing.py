"""Packing: numbering by lots, both ways of joining the counts, and written matrices."""

import numpy as np
import pytest

from tidewrack.llm import packing, vocab

SF = "/root/testdata/sf0.001"


def pieces(packed, capacity):
    out = {}
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        for k, p, a, z in zip(r["keys"], r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            out.setdefault((k, p), []).append(ids[a:z].tolist())
    return out


@pytest.mark.parametrize("most", [0, 500_000])
def test_many_lots_and_copies_are_packed_as_one_by_one(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(docs.limit(30)).unionByName(docs.limit(1).crossJoin(spark.range(50)).select("doc_id", "text")).repartition(7)
    v = vocab.load(vocab.model_path())
    texts = [(r.doc_id, r.text) for r in df.collect()]
    packed = packing.pack(df, capacity=128)
    got = pieces(packed, 128)
    want, lengths = {}, []
    for k, t in texts:
        ids = v.sp.encode(t or "")
        for p in range(-(-len(ids) // 128)):
            want.setdefault((k, p), []).append(ids[128 * p : 128 * p + 128])
            lengths.append(len(ids[128 * p : 128 * p + 128]))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= x]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(128 - x)
    assert sorted(128 - r.n_tokens for r in packed.select("n_tokens").collect()) == sorted(rooms)
    assert sorted(r.bin for r in packed.select("bin").collect()) == list(range(len(rooms)))


def test_written_matrices_give_the_rows_back(spark, tmp_path):
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), capacity=64)
    folder = str(tmp_path / "matrices")
    packing.write_matrices(packed, folder, rows=50)
    rows = {r.bin: r for r in packed.collect()}
    read = {r.matrix: r for r in spark.read.parquet(folder).collect()}
    assert sum(r.rows for r in read.values()) == len(rows) and max(r.rows for r in read.values()) == 50
    for m, r in read.items():
        ids, positions, cuts = packing.matrices_of(r, 64)
        keys = []
        for k in range(r.rows):
            one = rows[m * 50 + k]
            assert ids[k].tobytes() == bytes(one.ids) and positions[k].tobytes() == bytes(one.positions) and cuts[k].tolist() == one.cu_seqlens
            keys += one["keys"]
        assert r["keys"] == keys
