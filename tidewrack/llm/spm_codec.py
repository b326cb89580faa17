"""SentencePiece encoding and decoding by a max-plus parallel scan.

The encoding of a text is the best path through the lattice of pieces that match it.
In a unigram model a path weighs the sum of its pieces' scores.  In a BPE model it
weighs 0 if each pair of adjacent pieces is what the merges make of their joined text,
and minus infinity otherwise; exactly one path, the library's encoding, weighs 0.

A giant text is cut into chunks.  A state at a cut is a piece that ends at the cut or
spans it, so there are few states at any cut.  Each chunk yields the max-plus matrix of
the best weights from the states at its start to those at its end, without knowing the
rest of the text.  Matrices combine associatively, in a tree: each run of ``FAN`` matrices
is multiplied to one, level by level, until a text has few; the states at the ends of the
last ones are then handed down, each run finds those at its inner cuts, and each chunk is
traced back by itself.  Where a chunk holds a border that no piece crosses, its matrix is the outer
product of two vectors and only the text up to its first border and from its last one
takes part; what lies between is encoded as it would be alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .arrow_text import column
from .store import keep

#: Code points of a chunk; longer texts are cut.
CHUNK = 16384
#: Matrices that one step of the scan multiplies.
FAN = 64
LOWEST = float("-inf")
MARK = vocab.MARK


@dataclass(frozen=True)
class Piece:
    """A lattice piece: text[start:end]; id is -1 for a character that has no piece."""

    start: int
    end: int
    id: int


class Lattice:
    """The pieces of a vocabulary over a normalised text, and the weights of its paths."""

    def __init__(self, v: vocab.Vocabulary, unigram: bool = False):
        self.unigram = unigram
        self.ids = {p: i for i, p in enumerate(v.pieces) if not (v.is_byte[i] or v.special[i])}
        self.longest = max(map(len, self.ids))
        self.score = [v.sp.get_score(i) for i in range(len(v.pieces))]
        self.fine: dict[tuple[str, str], bool] = {}
        if not unigram:  # pieces that the merges never leave standing take no part
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}

    def merge(self, text: str) -> list[str]:
        """The merges on a short text: again and again the pair with the best score, leftmost first."""
        parts = list(text)
        while True:
            best, at = LOWEST, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.score[i] > best:
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def at(self, text: str, start: int) -> list[Piece]:
        """The pieces that start at a place."""
        out = [Piece(start, end, self.ids[text[start:end]]) for end in range(start + 1, min(len(text), start + self.longest) + 1) if text[start:end] in self.ids]
        return out if out and out[0].end == start + 1 else [Piece(start, start + 1, -1), *out]

    def states(self, text: str, cut: int) -> list[Piece]:
        """The pieces that end at the cut or span it."""
        return [p for s in range(max(0, cut - self.longest), cut) for p in self.at(text, s) if p.end >= cut]

    def weight(self, text: str, a: Piece | None, b: Piece) -> float:
        """What b adds after a."""
        if self.unigram:
            return self.score[b.id] if b.id >= 0 else min(self.score) - 10
        if a is None or a.id < 0 or b.id < 0:
            return 0.0
        pair = (text[a.start : a.end], text[b.start : b.end])
        if pair not in self.fine:
            if len(self.fine) > 500_000:
                self.fine.clear()
            self.fine[pair] = self.merge(pair[0] + pair[1]) == list(pair)
        return 0.0 if self.fine[pair] else LOWEST

    def paths(self, text: str, first: Piece | None, begin: int, stop: int) -> dict[Piece, tuple[float, Piece | None]]:
        """Best weight and predecessor of each piece that starts before ``stop``, after ``first``, which ends at ``begin``."""
        best: dict[Piece, tuple[float, Piece | None]] = {}
        ending: dict[int, list[Piece | None]] = {begin: [first]}
        for s in range(begin, stop):
            before = ending.pop(s, None)
            if not before:
                continue
            for p in self.at(text, s):
                w, a = max(((best[a][0] if a in best else 0.0) + self.weight(text, a, p), -k) for k, a in enumerate(before))
                if w > LOWEST:
                    best[p] = (w, before[-a])
                    ending.setdefault(p.end, []).append(p)
        return best

    def matrix(self, text: str, start: int, end: int) -> np.ndarray:
        """The max-plus matrix from the states at ``start`` to those at ``end``; text holds what they reach."""
        rows = self.states(text, start) if start else [None]
        cols = self.states(text, end)
        out = np.full((len(rows), len(cols)), LOWEST)
        for i, p in enumerate(rows):
            if p is not None and p.end > end:
                out[i] = [0.0 if q == p else LOWEST for q in cols]
                continue
            best = self.paths(text, p, p.end if p else 0, end)
            for j, q in enumerate(cols):
                if q == p:
                    out[i, j] = 0.0
                elif q in best:
                    out[i, j] = best[q][0]
        return out

    def trace(self, text: str, first: Piece | None, last: Piece, start: int) -> list[Piece]:
        """The pieces after ``first`` up to ``last`` on the best path."""
        if first == last:
            return []
        best = self.paths(text, first, first.end if first else start, last.start + 1)
        out, p = [], last
        while p is not None and p != first:
            out.append(p)
            p = best[p][1]
        return out[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def resolve(matrices: list[np.ndarray], entry: int = 0, exit_: int | None = None) -> list[int]:
    """The state of the best path at the end of each chunk, given those at both ends (exit: None, the best).

    A scan forwards, then one backwards.
    """
    ahead = [matrices[0][entry : entry + 1]]
    for m in matrices[1:]:
        ahead.append(product(ahead[-1], m))
    at = [int(ahead[-1][0].argmax()) if exit_ is None else exit_]
    for k in range(len(matrices) - 1, 0, -1):
        at.append(int((ahead[k - 1][0] + matrices[k][:, at[-1]]).argmax()))
    return at[::-1]


def _matrices(pdf) -> list[np.ndarray]:
    return [np.frombuffer(m, "<f4").reshape(h, -1).astype(float) for m, h in zip(pdf.matrix, pdf.height, strict=True)]


def scan(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """row, part, entry and exit state of each of the chunks, from (row, part, height, matrix).

    most: the largest part.  A task holds a run of ``fan`` matrices at most, so that a
    text of any number of chunks is scanned by many tasks, in log(chunks) levels.
    """
    tasks = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def multiply(pdf):
        found = _matrices(pdf.sort_values("part"))
        whole = found[0]
        for m in found[1:]:
            whole = product(whole, m)
        return pdf[["row", "run"]].head(1).assign(height=len(whole), matrix=[whole.astype("<f4").tobytes()])

    def down(pdf):
        pdf = pdf.sort_values("part")
        states = resolve(_matrices(pdf), int(pdf.entry.iloc[0]), None if pdf.exit.iloc[0] < 0 else int(pdf.exit.iloc[0]))
        return pdf[["row", "part"]].assign(entry=[int(pdf.entry.iloc[0]), *states[:-1]], exit=states)

    if most >= fan:  # read on the way up and on the way down
        matrices = keep(matrices, "spm-matrices")
    # a number of partitions that is stated stays: matrices are few bytes for their work, and would be merged into a few tasks
    levels = [matrices.withColumn("run", F.floor(F.col("part") / fan).cast("long")).repartition(tasks, "row", "run")]
    while most >= fan:
        most //= fan
        up = keep(levels[-1].groupBy("row", "run").applyInPandas(multiply, "row long, run long, height long, matrix binary").select("row", F.col("run").alias("part"), "height", "matrix"), "spm-level")
        levels.append(up.withColumn("run", F.floor(F.col("part") / fan).cast("long")).repartition(tasks, "row", "run"))
    told = levels.pop().withColumns({"entry": F.lit(0).cast("long"), "exit": F.lit(-1).cast("long")})
    states = told.groupBy("row", "run").applyInPandas(down, "row long, part long, entry long, exit long")
    for level in reversed(levels):
        above = keep(states.withColumnRenamed("part", "run"), "spm-states")
        states = level.join(above, ["row", "run"]).groupBy("row", "run").applyInPandas(down, "row long, part long, entry long, exit long")
    return states


def border(text: str, a: int, b: int) -> int:
    """The first place in (a, b] where a new segment starts, or -1: no piece crosses it."""
    for k in range(a + 1, min(b + 1, len(text))):
        if text[k] == "\n" or text[k - 1] == "\n" or (text[k] == MARK and text[k - 1] != MARK):
            return k
    return -1


def last_border(text: str, a: int, b: int) -> int:
    for k in range(min(b, len(text) - 1), a, -1):
        if text[k] == "\n" or text[k - 1] == "\n" or (text[k] == MARK and text[k - 1] != MARK):
            return k
    return -1


class Chunk:
    """text[start:end] with ``longest`` characters of context on either side."""

    def __init__(self, lattice: Lattice, text: str, start: int, end: int):
        self.l, self.text, self.start, self.end = lattice, text, start, end
        self.head = 0 if not start else border(text, start, end)
        self.tail = len(text) if end == len(text) else last_border(text, start, end)

    @property
    def last(self) -> bool:
        return self.end == len(self.text)

    def matrix(self) -> np.ndarray:
        """From the states at its start to those at its end; one state stands before and after a text."""
        t, s, e = self.text, self.start, self.end
        if self.head < 0 or self.tail < 0:
            if not self.last:
                return self.l.matrix(t, s, e)
            return self.l.matrix(t, s, e).max(1, keepdims=True)
        left = np.zeros((1, 1))
        if s:
            at = self.head
            left = self.l.matrix(t[:at], s, at).max(1, keepdims=True) if at > s else np.array([[0.0 if p.end == s else LOWEST] for p in self.l.states(t, s)])
            left = np.where(np.array([[p.end > at] for p in self.l.states(t, s)]), LOWEST, left) if self.l.states(t, s) else left
        right = np.zeros((1, 1))
        if not self.last:
            right = self._after(self.tail)
        return left + right

    def _after(self, at: int) -> np.ndarray:
        best = self.l.paths(self.text, None, at, self.end)
        return np.array([[best[q][0] if q in best and q.start >= at else (0.0 if q.end == at == self.end else LOWEST) for q in self.l.states(self.text, self.end)]])

    def encode(self, v: vocab.Vocabulary, entry: int, exit_: int) -> list[int]:
        """Ids of the pieces that begin after its entry state, up to its exit state."""
        t, s, e = self.text, self.start, self.end
        first = self.l.states(t, s)[entry] if s else None
        goal = None if self.last else self.l.states(t, e)[exit_]
        if self.head < 0 or self.tail < 0:
            if goal is None:
                goal = self._best_end(t, first, e)
            return self._ids(v, self.l.trace(t, first, goal, s))
        out: list[int] = []
        if s and first.end < self.head:
            cut = t[: self.head]
            out += self._ids(v, self.l.trace(cut, first, self._best_end(cut, first, self.head), s))
        out += _segments(v, t[self.head : self.tail])
        if goal is not None and goal.start >= self.tail:
            out += self._ids(v, self.l.trace(t, None, goal, self.tail))
        return out

    def _best_end(self, text: str, first: Piece | None, end: int) -> Piece:
        if first is not None and first.end == end:
            return first
        best = self.l.paths(text, first, first.end if first else 0, end)
        return max((p for p in best if p.end == end), key=lambda p: best[p][0])

    def _ids(self, v: vocab.Vocabulary, pieces: list[Piece]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += [p.id] if p.id >= 0 else [v.sp.piece_to_id(f"<0x{b:02X}>") for b in self.text[p.start : p.end].encode()]
        return out


def _segments(v: vocab.Vocabulary, text: str) -> list[int]:
    """Ids of a part of a normalised text that starts and ends at borders."""
    if not text:
        return []
    if text[0] == MARK and len(text) > 1:
        return v.sp.encode(text[1:])
    return v.sp.encode("\n" + text)[2:] if text != MARK else v.mark


def normal(text: str) -> str:
    """What the model's normaliser makes of a text: a mark before it and for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


_lattices: dict[tuple[str, bool], Lattice] = {}


def lattice(path: str, unigram: bool = False) -> Lattice:
    key = (path, unigram)
    if key not in _lattices:
        _lattices[key] = Lattice(vocab.load(path), unigram)
    return _lattices[key]


def chunks(text: str, size: int, reach: int):
    """(number, text with context, start, end) of each chunk of a normalised text."""
    for k, s in enumerate(range(0, max(len(text), 1), size)):
        e, a = min(len(text), s + size), max(0, s - reach)
        # a chunk that ends the text ends its context; others get more on their right
        yield k, text[a : min(len(text), e + reach)] if e < len(text) else text[a:], s - a, e - a


def encode_chunked(text: str, path: str, size: int) -> list[int]:
    """The whole scan on one machine, as tests use it."""
    l, v = lattice(path), vocab.load(path)
    parts = [Chunk(l, t, s, e) for _, t, s, e in chunks(normal(text), size, l.longest)]
    states = resolve([p.matrix() for p in parts])
    return [x for k, p in enumerate(parts) for x in p.encode(v, states[k - 1] if k else 0, states[k])] if text else []


_pieces: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}


def pieces_of(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The bytes that each piece stands for, their numbers, and whether a piece is none of its own (control, unknown)."""
    if path not in _pieces:
        v = vocab.load(path)
        own = [bytes([int(p[3:5], 16)]) if b else b"" if s else p.replace(MARK, " ").encode() for p, b, s in zip(v.pieces, v.is_byte, v.special, strict=True)]
        _pieces[path] = (pa.array(own, pa.large_binary()), np.array([len(x) for x in own]), v.special)
    return _pieces[path]


def decoded(path: str, ids: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of piece ids, end to end, and where each row begins; the space that encoding puts first is still there."""
    table, length, _ = pieces_of(path)
    data = np.frombuffer(table.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
    ends = np.append(0, np.cumsum(length[ids]))
    return data[: ends[-1]], ends[np.append(0, np.cumsum(per_row))]


def decode_ids(path: str, ids: list[list[int]]) -> list[str]:
    """Texts of id lists, as the library gives them; lists with special ids or odd bytes go through it."""
    flat = np.fromiter((x for one in ids for x in one), np.int64)
    per_row = np.array([len(x) for x in ids], np.int64)
    data, at = decoded(path, flat, per_row)
    raw, special = data.tobytes(), np.append(0, np.cumsum(pieces_of(path)[2][flat]))
    rows = np.append(0, np.cumsum(per_row))
    out = []
    for k, one in enumerate(ids):
        text = None
        if special[rows[k + 1]] == special[rows[k]]:
            own = raw[at[k] : at[k + 1]]
            try:
                text = own[own[:1] == b" " :].decode()
            except UnicodeDecodeError:
                pass
        out.append(vocab.load(path).sp.decode(one) if text is None else text)
    return out


def decode(df: DataFrame, ids: str = "ids", to: str = "text", model: str | None = None) -> DataFrame:
    """Adds the text of each id array; null ids give a null text."""
    from pyspark.sql.types import StringType, StructField, StructType

    path = model or vocab.model_path()
    out = StructType([*(f for f in df.schema if f.name != to), StructField(to, StringType())])

    def run(batches):
        for b in batches:
            at = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = decode_ids(path, [x or [] for x in at])
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in out[:-1]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([None if x is None else t for x, t in zip(at, texts, strict=True)], pa.string())], names=out.names)

    return df.mapInArrow(run, out)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """key, ids (array of int), n_tokens, n_chunks, round_trip (decoding gives the text back).

    Texts of one chunk are encoded where they are read.  Chunks of longer ones are dealt
    out over the cluster, and of each only its matrix goes on to the scan.  A null
    text counts as empty and has no ids.  Repeated rows and null keys each keep a row:
    longer texts are followed by a row number of their own, not by their key.  An empty
    table gives an empty one.  Only ``key`` and ``text`` are read, so no other column can clash.
    """
    path = model or vocab.model_path()
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text))
    size = F.coalesce(F.char_length(F.col(text)), F.lit(0))
    short = rows.where(size < chunk)

    def whole(batches):
        v = vocab.load(path)
        for b in batches:
            texts = column(b, text)
            keys = b.column(b.schema.get_field_index(key))
            for i, j, ids, per_row in v.encode(texts):
                off = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                same = _same(path, ids, per_row, texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists, pa.array(per_row.astype(np.int64)), pa.array(np.ones(j - i, np.int64)), pa.array(same)], names=[key, "ids", "n_tokens", "n_chunks", "round_trip"])

    schema = f"`{key}` {kind}, ids array<int>, n_tokens long, n_chunks long, round_trip boolean"
    small = short.mapInArrow(whole, schema)

    def cut(batches):
        l = lattice(path)
        for b in batches:
            for k, t, n in zip(*(b.column(c).to_pylist() for c in ("row", text, key)), strict=True):
                t = normal(t)
                said = hashlib.sha256(t.encode()).hexdigest()
                for part, piece, s, e in chunks(t, chunk, l.longest):
                    yield pa.RecordBatch.from_pydict({"row": [k], key: pa.array([n], b.column(2).type), "said": [said], "part": [part], "piece": [piece], "start": [s], "end": [e]})

    numbered = rows.where(size >= chunk).select(F.monotonically_increasing_id().alias("row"), text, key)
    parts = keep(numbered.mapInArrow(cut, f"row long, `{key}` {kind}, said string, part long, piece string, start long, end long").repartition("row", "part"), "spm-parts")

    def matrices(batches):
        l = lattice(path)
        for b in batches:
            made = [Chunk(l, t, s, e).matrix() for t, s, e in zip(*(b.column(c).to_pylist() for c in ("piece", "start", "end")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(m) for m in made], pa.int64()), pa.array([m.astype("<f4").tobytes() for m in made], pa.binary())], names=["row", "part", "height", "matrix"])

    of_chunk = parts.select("row", "part", "piece", "start", "end").mapInArrow(matrices, "row long, part long, height long, matrix binary")

    states = scan(of_chunk, parts.agg(F.max("part")).first()[0] or 0)

    def back(batches):
        l, v = lattice(path), vocab.load(path)
        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            ids = [Chunk(l, t, s, e).encode(v, a, z) for t, s, e, a, z in zip(*(get[c].to_pylist() for c in ("piece", "start", "end", "entry", "exit")), strict=True)]
            yield pa.RecordBatch.from_arrays([get["row"], get[key], get["said"], get["part"], pa.array(ids, pa.list_(pa.int32()))], names=["row", key, "said", "part", "ids"])

    traced = parts.join(states, ["row", "part"]).select("row", key, "said", "part", "piece", "start", "end", "entry", "exit").mapInArrow(back, f"row long, `{key}` {kind}, said string, part long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids")))
    joined = traced.groupBy("row").agg(F.first(key).alias(key), F.first("said").alias("said"), ordered.alias("all")).select(key, "said", F.flatten("all.ids").alias("ids"), F.size("all").cast("long").alias("n_chunks"))

    def close(batches):
        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            again = decode_ids(path, get["ids"].to_pylist())
            same = [hashlib.sha256(normal(t).encode()).hexdigest() == c for t, c in zip(again, get["said"].to_pylist(), strict=True)]
            n = pa.array([len(x) for x in get["ids"]], pa.int64())
            yield pa.RecordBatch.from_arrays([get[key], get["ids"], n, get["n_chunks"], pa.array(same)], names=[key, "ids", "n_tokens", "n_chunks", "round_trip"])

    large = joined.mapInArrow(close, schema)
    return small.unionByName(large)


def _same(path: str, ids: np.ndarray, per_row: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether decoding gives each text back; a literal U+2581 is a space to the model."""
    data, at = decoded(path, ids, per_row)
    prefixed = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.replace_substring(texts, MARK, " "), pa.scalar(" ", pa.large_string()))
    size = np.asarray(pc.binary_length(texts)) > 0
    out = np.diff(at) == np.where(size, np.asarray(pc.binary_length(prefixed)), 0)
    off = np.frombuffer(prefixed.buffers()[1], np.int64)[prefixed.offset : prefixed.offset + len(prefixed) + 1]
    said = np.frombuffer(prefixed.buffers()[2], np.uint8)
    if out.all() and size.all():
        wrong = np.flatnonzero(data != said[off[0] : off[-1]])
        out[np.searchsorted(at[1:], wrong, side="right")] = False
        return out
    for k in np.flatnonzero(out & size).tolist():
        out[k] = np.array_equal(data[at[k] : at[k + 1]], said[off[k] : off[k + 1]])
    return out
