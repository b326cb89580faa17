"""Byte-level BPE by a dynamic program over byte prefixes.

Each prefix of a pre-token has one last token that a valid encoding of it can have.  Of the
tokens that end at a byte, it is the one that the merges leave standing next to the last token of
the prefix before it; two tokens stand if no merge over their border comes before the merges
that made them.  The last tokens are all that is stored: ids are read backwards from them,
more bytes only add to them, and after an edit those before it and those from the next
common pre-token border on stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow_text import add_columns, column, quoted

#: Pre-tokens and token pairs that a worker remembers before it starts anew.
MEMO_ENTRIES = 300_000
#: Longer pre-tokens, in characters, aren't remembered.
MEMO_CHARS = 64
#: Pre-tokens of a text that are held at once.
BLOCK = 100_000
NEVER = 1 << 62


class Codec(dict):
    """A file of ranks with its pre-token pattern; as a dict, the ids of the pre-tokens met so far."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a vocabulary must hold every single byte")
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.size = [len(piece) for piece in self.bytes_of]
        self.names = [str(k) for k in range(len(self.bytes_of))]
        # for each token, the tokens that end (begin) with its last (first) byte while it is
        # being merged, the smallest first, and the rank at which each of them is used up
        self.ending: dict[int, list[tuple[bytes, int]]] = {}
        self.beginning: dict[int, list[tuple[bytes, int]]] = {}
        self.tokens = ahocorasick.Automaton()
        for piece, rank in sorted(self.ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if self._grow(piece, rank):
                self.tokens.add_word(piece.decode("latin-1"), rank)
        self.tokens.make_automaton()
        self.widest = max(self.size)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _grow(self, piece: bytes, rank: int) -> bool:
        """Enters how the token comes about; False if merges never make it."""
        if len(piece) == 1:
            self.ending[rank] = self.beginning[rank] = [(piece, NEVER)]
            return True
        for k in range(1, len(piece)):
            a, b = self.ranks.get(piece[:k], NEVER), self.ranks.get(piece[k:], NEVER)
            if a in self.ending and b in self.ending and not self._crossed(a, b, rank):
                self.ending[rank] = [*self.ending[b][:-1], (piece[k:], rank), (piece, NEVER)]
                self.beginning[rank] = [*self.beginning[a][:-1], (piece[:k], rank), (piece, NEVER)]
                return True
        return False

    def _crossed(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether a merge over the border of two tokens comes before those that make them, or else before ``until``."""
        left, right, i, j = self.ending[a], self.beginning[b], 0, 0
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            merge = self.ranks.get(x + y, NEVER)
            # of equal ranks the leftmost pair is merged first
            if merge < min(x_used, until) and merge <= y_used:
                return True
            if x_used == y_used == NEVER:
                return False
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def stand(self, a: int, b: int) -> bool:
        """Whether two tokens can follow each other within a pre-token."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = not self._crossed(a, b)
        return known

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of a pre-token; ``known`` are those of its first prefixes."""
        last = list(known or ())
        n = len(last)
        for end, token in self.tokens.iter(piece.decode("latin-1"), max(0, n + 1 - self.widest)):
            if end == n:
                start = end + 1 - self.size[token]
                if not start or self.stand(last[start - 1], token):
                    last.append(token)
                    n += 1
        return last

    def backwards(self, last: list[int]) -> list[int]:
        """The ids that the last tokens of a pre-token's prefixes tell."""
        ids, at = [], len(last)
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= self.size[token]
        return ids[::-1]

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.backwards(self.last_tokens(raw))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some pre-tokens at a time."""
        if len(text) <= BLOCK:
            yield list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield list(chain.from_iterable(map(self.__getitem__, block)))

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(np.array(ids, np.int32) for ids in self.blocks(text))])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def prefixes(self, text: str) -> np.ndarray:
        """The last token of each byte's prefix; complemented where a pre-token begins."""
        return self.edited(b"", np.zeros(0, np.int32), 0, 0, text.encode())

    def ids(self, last: np.ndarray) -> np.ndarray:
        """The ids that ``prefixes`` tell."""
        borders = [*np.flatnonzero(last < 0).tolist(), len(last)]
        plain, out = np.where(last < 0, ~last, last).tolist(), []
        for a, z in pairwise(borders):
            own = plain[a:z]
            whole = self.ranks.get(self.decode(self.backwards(own)))
            out += [whole] if whole is not None else self.backwards(own)
        return np.array(out, np.int32)

    def edited(self, old: bytes, last: np.ndarray, at: int, removed: int, inserted: bytes) -> np.ndarray:
        """``prefixes`` of the text with ``removed`` bytes from ``at`` on replaced, from those of the old one."""
        new, shift = old[:at] + inserted + old[at + removed :], len(inserted) - removed
        starts = np.flatnonzero(last < 0)
        ends = np.append(starts[1:], len(last))[: len(starts)]
        # a pre-token is told by its characters and at most two more
        sure = at
        for _ in range(2):
            sure -= 1
            while sure > 0 and old[sure] & 0xC0 == 0x80:
                sure -= 1
        first = int(starts[np.searchsorted(ends, sure, side="right")]) if sure > 0 and len(starts) else 0
        first = min(first, at)
        parts, place = [last[:first]], first
        old_starts = set(starts[starts >= first].tolist())
        old_end = dict(zip(starts.tolist(), ends.tolist(), strict=True))
        for m in self.pattern.finditer(new[first:].decode()):
            piece = m.group().encode()
            before = place - shift
            if before >= at + removed and before in old_starts:
                parts.append(last[before:])
                return np.concatenate(parts)
            known = last[place : min(at, old_end[place], place + len(piece))].tolist() if place < at and place in old_starts else []
            if known:
                known[0] = ~known[0]
            own = np.array(self.last_tokens(piece, known), np.int32)
            own[0] = ~own[0]
            parts.append(own)
            place += len(piece)
        return np.concatenate(parts)


_loaded: dict[tuple[str, str], Codec] = {}


def load(path: str, pattern: str) -> Codec:
    """The codec of this process; a file is loaded once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pre-token pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode(df: DataFrame, text: str = "text", ranks: tuple[str, str] | None = None, prefixes: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Adds ids (array<int>), and with ``prefixes`` also last (array<int>, one number for each byte).

    Each match of the pattern is encoded by itself; special strings are ordinary text.  A null
    text counts as empty, which has no ids.  Rows are independent: repeated rows get equal ids,
    an empty table gives an empty one, and a text is encoded whole at any length, in time
    linear in it also where it is a single pre-token.  No two encodings tie: each prefix has
    one valid last token.  Columns with the name of an added one are replaced.
    """
    ranks = ranks or ranks_path()

    def run(texts: pa.Array) -> dict:
        codec, out = load(*ranks), {"ids": [], "last": []}
        for x in texts.to_pylist():
            if prefixes:
                out["last"].append(codec.prefixes(x))
            out["ids"].append(codec.ids(out["last"][-1]) if prefixes else codec.encode(x))
        return {c: _lists(rows) for c, rows in out.items()}

    return add_columns(df, text, "ids array<int>" + ", last array<int>" * prefixes, run, carry)


def decode(df: DataFrame, ids: str = "ids", ranks: tuple[str, str] | None = None) -> DataFrame:
    """Adds decoded (binary): the bytes of the ids.  Null ids have none; a null or unknown id is an error."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    ranks = ranks or ranks_path()
    names = [c for c in df.columns if c != "decoded"]
    source = df.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(names)))
    out = StructType([*(StructField(c, f.dataType) for c, f in zip(names, source.schema, strict=True)), StructField("decoded", BinaryType())])

    def run(batches):
        codec = load(*ranks)
        for b in batches:
            told = b.column(names.index(ids))
            made = [codec.decode(told[k].as_py() or ()) for k in range(len(told))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=out.names)

    return source.mapInArrow(run, out)


def edit(df: DataFrame, at: str, removed: str, inserted: str, text: str = "text", last: str = "last", ranks: tuple[str, str] | None = None) -> DataFrame:
    """Replaces text and last by those after an edit of each row, and adds ids.

    ``at`` and ``removed`` name columns of code points, ``inserted`` one of text; an edit at the
    end of a text appends.  Places beyond a text's end mean its end; a null place or insertion
    is 0 or empty, and null last tokens are made anew.  The result is what encoding the new text
    gives; only what lies between the edit and the next common border is encoded again.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    ranks = ranks or ranks_path()
    names = [c for c in df.columns if c != "ids"]
    source = df.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(names)))
    kinds = {text: StringType(), last: ArrayType(IntegerType())}
    out = StructType([*(StructField(c, kinds.get(c, f.dataType)) for c, f in zip(names, source.schema, strict=True)), StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        codec = load(*ranks)
        for b in batches:
            get = {c: b.column(names.index(c)) for c in (at, removed, last)}
            olds, more = column(b, f"c{names.index(text)}"), column(b, f"c{names.index(inserted)}")
            texts, lasts, ids = [], [], []
            for k in range(b.num_rows):
                old, put = olds[k].as_py(), more[k].as_py()
                a = max(0, min(get[at][k].as_py() or 0, len(old)))
                z = min(a + max(0, get[removed][k].as_py() or 0), len(old))
                held = get[last][k]
                known = held.values.to_numpy().astype(np.int32) if held.is_valid else codec.prefixes(old)
                texts.append(old[:a] + put + old[z:])
                lasts.append(codec.edited(old.encode(), known, len(old[:a].encode()), len(old[a:z].encode()), put.encode()))
                ids.append(codec.ids(lasts[-1]))
            own = {text: pa.array(texts, pa.string()), last: _lists(lasts)}
            yield pa.RecordBatch.from_arrays([*(own.get(c, b.column(k)) for k, c in enumerate(names)), _lists(ids)], names=out.names)

    return source.mapInArrow(run, out)


def digests(df: DataFrame, text: str = "text", ranks: tuple[str, str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256 (of the bytes that the ids decode to).

    Odd rows count as in ``encode``; ids of a long text are held a block at a time.
    """
    ranks = ranks or ranks_path()

    def run(texts: pa.Array) -> dict:
        codec, out = load(*ranks), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for k in range(len(texts)):
            n, said, back = 0, hashlib.sha256(), hashlib.sha256()
            for ids in codec.blocks(texts[k].as_py()):
                said.update((" " * (n > 0 and len(ids) > 0) + " ".join(map(codec.names.__getitem__, ids))).encode())
                back.update(codec.decode(ids))
                n += len(ids)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(said.hexdigest())
            out["decoded_sha256"].append(back.hexdigest())
        return out

    return add_columns(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", run, carry)
