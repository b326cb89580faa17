"""Best-fit-decreasing packing of token ids into fixed rows.

Texts are encoded once and cut losslessly into pieces of at most ``capacity`` tokens.
Which row a piece goes to depends on its length alone, so the plan is made from the
histogram of lengths, at most ``capacity`` numbers whatever the input: lengths are
taken from the largest down, and a segment tree over remaining capacities finds the
tightest rows that still fit.  Pieces of one length are numbered without being brought
together: each task that encodes texts, a lot, numbers its own pieces of a length from 0,
and a prefix sum over the lots' counts tells how many pieces of that length lie before.
Each piece then looks its row and place up in the plan, and each row of ids is gathered
from its own pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocab
from .arrow_text import column
from .store import keep

CAPACITY = 2048
#: Most (lot, length) counts, of 24 bytes, that are broadcast; more are joined by a shuffle on both.
BROADCAST_COUNTS = 500_000
#: Packed rows in one written matrix.
MATRIX_ROWS = 256


class CapacityTree:
    """A segment tree over remaining capacities 0..size; a leaf counts the open rows."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = np.zeros(2 * self.width, np.int64)

    def add(self, room: int, rows: int) -> None:
        k = room + self.width
        while k:
            self.open[k] += rows
            k //= 2

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` with an open row, or -1."""
        k = least + self.width
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return -1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, first row, rows, pieces a row, place) of best-fit-decreasing.

    Placing pieces of one length one by one fills the tightest row for as long as they
    fit, so whole blocks of rows with equal room are filled at once; the result is what
    the placing one by one gives.
    """
    tree, blocks = CapacityTree(capacity), {}
    runs, rows = [], 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, number = counts[length], 0

        def put(first: int, n: int, each: int, room: int) -> None:
            nonlocal left, number
            runs.append((length, number, first, n, each, capacity - room))
            number += n * each
            left -= n * each
            if (rest := room - each * length) > 0:
                blocks.setdefault(rest, []).append((first, n))
                tree.add(rest, n)

        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                n, over = divmod(left, each)
                if n:
                    put(rows, n, each, capacity)
                    rows += n
                if over:
                    put(rows, 1, over, capacity)
                    rows += 1
                continue
            first, n = blocks[room].pop()
            tree.add(room, -n)
            each = room // length
            use = min(n, left // each)
            if use:
                put(first, use, each, room)
            if use < n and left:
                over = left
                put(first + use, 1, over, room)
                use += 1
            if use < n:
                blocks[room].append((first + use, n - use))
                tree.add(room, n - use)
    return runs


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each packed row of ``capacity`` ids.

    bin long, keys (array of the pieces' keys), parts (which piece of its text each is),
    ids (little-endian unsigned 16-bit numbers, padded with 0), cu_seqlens (where each
    piece starts, then the end of the last), positions (as ids: each id's place in its
    piece, 0 in the padding), n_tokens, n_segments.  Pieces of a text hold all its ids
    in order.  Null and empty texts have no ids and no place.  Repeated rows are packed
    as often as they occur; a null key stays null.  Texts of any length are cut; an empty
    table gives no rows.  Other columns of the input are not read, so none can clash.
    Pieces of equal length tie: they are numbered by task and then by arrival, so which of
    them goes to which row follows from how the input is split; the rows' fill does not.
    """
    path = model or vocab.model_path()
    kind = df.schema[key].dataType.simpleString()

    def encode(batches):
        v = vocab.load(path)
        if len(v.pieces) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        lot, before = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            keys = b.column(0)
            for i, _, ids, per_row in v.encode(column(b, text)):
                n = -(-per_row // capacity)
                row = np.repeat(np.arange(len(per_row)), n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, per_row[row] - part * capacity)
                ends = np.append(0, np.cumsum(length))
                raw = ids.astype("<u2").tobytes()
                tokens = pa.array([raw[2 * a : 2 * z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                order = np.argsort(length, kind="stable")
                seen = np.bincount(length, minlength=capacity + 1)
                own = np.empty(len(length), np.int64)
                own[order] = np.arange(len(length)) - np.repeat(np.cumsum(seen) - seen, seen) + before[length[order]]
                before += seen
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + i)), pa.array(part), pa.array(length), pa.array(np.full(len(row), lot, np.int64)), pa.array(own), tokens], names=[key, "part", "length", "lot", "own", "tokens"])

    # written once: a lot's numbers hold whatever task reads them later
    pieces = keep(df.select(key, text).mapInArrow(encode, f"`{key}` {kind}, part long, length long, lot long, own long, tokens binary"), "pack-pieces")
    spark = df.sparkSession
    lots = keep(pieces.groupBy("lot", "length").agg(F.count("*").alias("n")), "pack-lots")
    # at most capacity rows, whatever the input
    counts = {r.length: r.n for r in lots.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table: dict[int, np.ndarray] = {}
    for run in plan(counts, capacity):
        table.setdefault(run[0], []).append(run[1:])
    shared = spark.sparkContext.broadcast({length: np.array(own, np.int64).T.copy() for length, own in table.items()})
    # a window holds the lots of one length: as many rows as there were tasks
    starts = lots.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("lot")) - F.col("n")).drop("n")
    starts = starts.hint("broadcast" if lots.count() <= BROADCAST_COUNTS else "merge")
    numbered = pieces.join(starts, ["lot", "length"]).withColumn("number", F.col("ahead") + F.col("own"))

    def place(batches):
        for b in batches:
            length, number = (np.asarray(b.column(c)) for c in ("length", "number"))
            bins, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0])).tolist() if len(length) else []
            for a, z in zip(cuts, [*cuts[1:], len(length)], strict=True):
                own = order[a:z]
                x = int(length[own[0]])
                first, row, _, each, room = shared.value[x]
                k = np.searchsorted(first, number[own], side="right") - 1
                q = number[own] - first[k]
                bins[own], at[own] = row[k] + q // each[k], room[k] + q % each[k] * x
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bins), pa.array(at)], names=[key, "part", "tokens", "bin", "at"])

    placed = numbered.select(key, "part", "tokens", "length", "number").mapInArrow(place, f"`{key}` {kind}, part long, tokens binary, bin long, at long")
    rows = placed.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("at", F.col(key).alias("key"), "part", "tokens"))).alias("held"))

    def lay(batches):
        for b in batches:
            ids, places, cuts, held = [], [], [], b.column(1)
            for one in held.field("tokens").to_pylist() if isinstance(held, pa.StructArray) else [[x["tokens"] for x in row] for row in held.to_pylist()]:
                row, pos, ends = np.zeros(capacity, "<u2"), np.zeros(capacity, "<u2"), [0]
                for tokens in one:
                    n = len(tokens) // 2
                    row[ends[-1] : ends[-1] + n] = np.frombuffer(tokens, "<u2")
                    pos[ends[-1] : ends[-1] + n] = np.arange(n)
                    ends.append(ends[-1] + n)
                ids.append(row.tobytes())
                places.append(pos.tobytes())
                cuts.append(ends)
            flat, off = held.flatten(), held.offsets
            off = pa.array(np.asarray(off) - off[0].as_py(), pa.int32())
            lists = [pa.ListArray.from_arrays(off, flat.field(flat.type.get_field_index(c))) for c in ("key", "part")]
            n = [c[-1] for c in cuts]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(ids, pa.binary()), pa.array(cuts, pa.list_(pa.int32())), pa.array(places, pa.binary()), pa.array(n, pa.int64()), pa.array([len(c) - 1 for c in cuts], pa.int64())], names=["bin", "keys", "parts", "ids", "cu_seqlens", "positions", "n_tokens", "n_segments"])

    return rows.mapInArrow(lay, f"bin long, keys array<{kind}>, parts array<long>, ids binary, cu_seqlens array<int>, positions binary, n_tokens long, n_segments long")


def write_matrices(packed: DataFrame, folder: str, rows: int = MATRIX_ROWS) -> None:
    """Write packed rows as binary matrices, one Parquet row for each run of ``rows`` rows of ids.

    matrix (its number), rows, ids and positions (little-endian unsigned 16-bit, row by
    row), cu_seqlens (little-endian 32-bit, all rows' lengths so far, each from 0) and
    segments (32-bit, how many of cu_seqlens each row has), keys and parts of all pieces in order.
    """
    kind = packed.schema["keys"].dataType.simpleString()
    dealt = packed.withColumn("matrix", F.floor(F.col("bin") / rows).cast("long"))
    dealt = dealt.repartition("matrix").sortWithinPartitions("matrix", "bin")

    def stack(batches):
        held: list[pa.Table] = []

        def made():
            t = pa.concat_tables(held).combine_chunks()
            join = lambda c: b"".join(t[c].to_pylist())
            cuts = t["cu_seqlens"].combine_chunks()
            flat = [np.asarray(cuts.flatten()).astype("<i4").tobytes(), np.diff(np.asarray(cuts.offsets)).astype("<i4").tobytes()]
            lists = [[x for own in t[c].to_pylist() for x in own] for c in ("keys", "parts")]
            arrays = [pa.array([t["matrix"][0].as_py()]), pa.array([t.num_rows]), pa.array([join("ids")]), pa.array([join("positions")]), *(pa.array([x]) for x in flat), *(pa.array([x], t.schema.field(c).type) for x, c in zip(lists, ("keys", "parts"), strict=True))]
            return pa.RecordBatch.from_arrays(arrays, names=["matrix", "rows", "ids", "positions", "cu_seqlens", "segments", "keys", "parts"])

        for b in batches:
            of = np.asarray(b.column(b.schema.get_field_index("matrix")))
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
            for a, z in zip(cuts, [*cuts[1:], len(of)], strict=True):
                if held and held[0]["matrix"][0].as_py() != of[a]:
                    yield made()
                    held.clear()
                held.append(pa.Table.from_batches([b.slice(a, z - a)]))
        if held:
            yield made()

    dealt.mapInArrow(stack, f"matrix long, rows long, ids binary, positions binary, cu_seqlens binary, segments binary, keys {kind}, parts array<long>").write.parquet(folder)


def matrices_of(row, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids, positions and the cumulative lengths of each row of a written matrix."""
    ids, positions = (np.frombuffer(row[c], "<u2").reshape(row["rows"], capacity) for c in ("ids", "positions"))
    return ids, positions, np.split(np.frombuffer(row["cu_seqlens"], "<i4"), np.cumsum(np.frombuffer(row["segments"], "<i4"))[:-1])
