"""Vectorised text kernels over Arrow string columns.

A column's UTF-8 bytes are viewed as one array; words, lines and windows are then
found for many rows at once.  Rows are handled in slices of ``SLICE_BYTES`` so that
the working memory of a Python worker does not depend on the Arrow batch size; a
single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


#: Words are the runs without ASCII white space.
SPACE_WORDS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of digits, small ASCII letters and non-ASCII characters.
ALNUM_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """A slice of rows: ``data`` holds the bytes, row i is ``data[off[i]:off[i + 1]]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.n = len(off) - 1
        self._sums: np.ndarray | None = None
        self._first: np.ndarray | None = None

    @property
    def first(self) -> np.ndarray:
        """Marks the first byte of each row, and the place after the last one."""
        if self._first is None:
            self._first = np.zeros(len(self.data) + 1, bool)
            self._first[self.off] = True
        return self._first

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off[1:], at, side="right")

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.off)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of the row of each."""
        w = is_word[self.data]
        if not len(w):
            none = np.zeros(0, np.int64)
            return none, none, none
        before = np.empty(len(w), bool)
        before[0] = False
        before[1:] = w[:-1]
        after = np.empty(len(w), bool)
        after[-1] = False
        after[:-1] = w[1:]
        starts = np.flatnonzero(w & (~before | self.first[:-1]))
        ends = np.flatnonzero(w & (~after | self.first[1:])) + 1
        return starts, ends, self.row_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between newlines; an empty row has one empty line."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.off[:-1], cuts + 1])
        rows = np.concatenate([np.arange(self.n), self.row_of(cuts)])
        order = np.lexsort((starts, rows))
        starts, rows = starts[order], rows[order]
        last = np.empty(len(rows), bool)
        if len(rows):
            last[-1] = True
            last[:-1] = rows[1:] != rows[:-1]
        ends = np.empty(len(rows), np.int64)
        ends[:-1] = starts[1:] - 1
        ends[last] = self.off[1:]
        return starts, ends, rows

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, equal for equal bytes."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_CODE[self.data] * up[:-1], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Running count of the bytes that the table marks."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=out[1:])
        return out


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The spans between the bounds as an Arrow array."""
    if not len(bounds):
        return pa.array([], pa.large_binary())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def codes(t: Texts, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each span, equal for equal bytes, and how many there are; ``inside`` marks the spans' bytes in the data."""
    told = binary(t.data[inside], np.append(0, np.cumsum(ends - starts))).dictionary_encode()
    return told.indices.to_numpy().astype(np.int64), len(told.dictionary)


def windows(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that stay in one row, and the index of their first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : len(h) - k + 1 + j]
    at = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
    return mix(out[at]), at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls read as empty."""
    a = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(a.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut a large_string column without nulls into (first row, end row, Texts)."""
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def with_columns(batch: pa.RecordBatch, drop: set[str], **new: pa.Array) -> pa.RecordBatch:
    """The batch without some columns and with new ones at its end."""
    keep = [f.name for f in batch.schema if f.name not in drop and f.name not in new]
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*arrays, *new.values()], names=[*keep, *new])


def add_columns(df, text: str, fields: str, fn, carry: list[str] | None = None, second: str | None = None):
    """``carry`` columns of ``df`` (all, if None) and those that ``fn`` makes of the texts.

    ``fn`` maps a large_string array without nulls to a dict of arrays, one for each
    name in the DDL string ``fields``; with ``second``, it also gets that column, or None
    where ``df`` has none of that name.  A carried column whose name is among the new
    ones is replaced.  There is no shuffle; rows keep their partition.
    """
    from pyspark.sql.types import StructField, StructType

    new = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if carry is None else carry) if c not in new.names]
    more = [second] if second in df.columns else []
    read = list(dict.fromkeys([*kept, text, *more]))
    # columns go by place: a name with a dot could not be passed to Python
    source = df.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(read)))
    out = StructType([*(StructField(c, source.schema[read.index(c)].dataType) for c in kept), *new])

    def run(batches):
        for batch in batches:
            args = [batch.column(read.index(c)) for c in more] or [None] * (second is not None)
            made = fn(column(batch, f"c{read.index(text)}"), *args)
            arrays = [batch.column(read.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(made[c]) for c in new.names)], names=out.names)

    return source.mapInArrow(run, out)


def quoted(name: str):
    """The column of exactly this name."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")
