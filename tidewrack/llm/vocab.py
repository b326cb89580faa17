"""Encoding with a SentencePiece model through a memo of independent segments.

A text, with its dummy prefix, falls into segments that no piece of the vocabulary
crosses: each starts at a run of spaces, and each newline is
one by itself.  That no piece crosses such a border is proved when the model is
loaded, by going through the vocabulary; a model that fails the proof is refused.
Segments recur, so each distinct one is encoded once by the library and its ids are
reused.  A text that holds U+2581, the library's own space mark, is encoded whole.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from .arrow_text import SLICE_BYTES, Texts, binary, slices

MARK = "▁"
#: Each is a segment by itself.
ALONE = b"\n"
#: Distinct segments, and their bytes, held before the memo starts anew; bounds a worker's memory.
MEMO_ENTRIES, MEMO_BYTES = 300_000, 64 << 20


class Vocabulary:
    """A loaded model, its proofs, and the memo of a worker process."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(n)])
        self.special = np.array([self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(n)])
        for i, piece in enumerate(self.pieces):
            if not (self.is_byte[i] or self.special[i]) and (MARK in piece.lstrip(MARK) or any(chr(c) in piece for c in ALONE)):
                raise ValueError(f"a piece crosses a segment border: {piece!r}")
        self.mark = [self.sp.piece_to_id(MARK)]
        probe = " a  b\n \tc  "
        if self.sp.encode(probe) != self._whole_by_segments(probe):
            raise ValueError("the model normalises texts in a way that segments don't follow")
        self.whole = self._whole_tokens()
        self.start_memo()

    def _segments(self, texts: list[str]) -> list[list[int]]:
        """Ids of distinct segments; those without a space of their own get a newline before them, whose ids go."""
        spaced = [len(x) > 1 and x[0] == " " for x in texts]
        said = self.sp.encode([x[1:] if s else "\n" + x for x, s in zip(texts, spaced, strict=True)], num_threads=1)
        return [self.mark if x == " " else one if s else one[2:] for x, one, s in zip(texts, said, spaced, strict=True)]

    def _whole_by_segments(self, text: str) -> list[int]:
        t = Texts(np.frombuffer((" " + text).encode(), np.uint8), np.array([0, len(text.encode()) + 1]))
        starts, ends, _ = segments(t)
        return [x for one in self._segments([bytes(t.data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]) for x in one]

    def _whole_tokens(self) -> list[tuple[bytes, int]]:
        """Offline proof: the pieces that a text encodes to by themselves, as segments."""
        at = [i for i in range(len(self.pieces)) if not (self.is_byte[i] or self.special[i])]
        texts = [self.pieces[i].replace(MARK, " ") for i in at]
        return [(x.encode(), i) for i, x, ids in zip(at, texts, self._segments(texts), strict=True) if ids == [i]]

    def start_memo(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 18, np.uint16 if len(self.pieces) <= 1 << 16 else np.int32)
        self.at = np.zeros(MEMO_ENTRIES + 1, np.int64)
        self.fill = self.entries = self.held = 0
        self._add([piece for piece, _ in self.whole], [[i] for _, i in self.whole])
        self.shortcut = self.entries

    def _add(self, keys: list[bytes], ids: list[list[int]]) -> None:
        flat = np.fromiter(chain.from_iterable(ids), self.ids.dtype)
        while self.fill + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.fill : self.fill + len(flat)] = flat
        if self.entries + len(ids) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(ids)), np.int64)])
        self.at[self.entries + 1 : self.entries + 1 + len(ids)] = self.fill + np.cumsum(np.fromiter(map(len, ids), np.int64))
        self.known.update(zip(keys, range(self.entries, self.entries + len(ids)), strict=True))
        self.entries += len(ids)
        self.fill += len(flat)
        self.held += sum(map(len, keys))

    def entries_of(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """For each segment of rows that begin with the dummy prefix: its memo entry, its row."""
        if self.entries > MEMO_ENTRIES or self.held > MEMO_BYTES:
            self.start_memo()
        starts, ends, rows = segments(t)
        # segments lie side by side, so they are an Arrow array as they stand; it tells equal ones by their bytes
        told = binary(t.data, np.append(starts, len(t.data))).dictionary_encode()
        listed = told.dictionary.to_pylist()
        entry = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(entry < 0).tolist()
        if new:
            keys = [listed[k] for k in new]
            ids = self._segments([x.decode() for x in keys])
            entry[new] = self.entries + np.arange(len(new))
            self._add(keys, ids)
        return entry[told.indices.to_numpy()], rows

    def _slices(self, texts: pa.Array, limit: int):
        prefixed = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        for i, j, t in slices(prefixed, limit):
            entry, rows = self.entries_of(t)
            lens = self.at[entry + 1] - self.at[entry]
            yield i, j, entry, rows, np.where(empty[i:j][rows], 0, lens) if empty[i:j].any() else lens

    def encode(self, texts: pa.Array, limit: int = SLICE_BYTES):
        """Yield (first row, end row, ids of all rows, tokens of each row), slice by slice."""
        odd = np.asarray(pc.match_substring(texts, MARK))
        for i, j, entry, rows, lens in self._slices(texts, limit):
            total = np.cumsum(lens)
            ids = self.ids[np.repeat(self.at[entry] - (total - lens), lens) + np.arange(int(total[-1]) if len(total) else 0)]
            per_row = np.bincount(rows, weights=lens, minlength=j - i).astype(np.int64)
            if odd[i:j].any():
                parts = np.split(ids, np.cumsum(per_row)[:-1])
                for k in np.flatnonzero(odd[i:j]).tolist():
                    parts[k] = np.array(self.sp.encode(texts[i + k].as_py()), ids.dtype)
                ids, per_row = np.concatenate(parts), np.array([len(p) for p in parts])
            yield i, j, ids, per_row

    def count(self, texts: pa.Array, limit: int = SLICE_BYTES):
        """Yield (first row, end row, tokens of each row, those of proved whole strings)."""
        odd = np.asarray(pc.match_substring(texts, MARK))
        for i, j, entry, rows, lens in self._slices(texts, limit):
            n = np.bincount(rows, weights=lens, minlength=j - i).astype(np.int64)
            whole = np.bincount(rows, weights=lens * (entry < self.shortcut), minlength=j - i).astype(np.int64)
            for k in np.flatnonzero(odd[i:j]).tolist():
                n[k], whole[k] = len(self.sp.encode(texts[i + k].as_py())), 0
            yield i, j, n, whole


def segments(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the segments of rows that begin with a space, and their rows."""
    d = t.data
    space = d == 32
    alone = d == ALONE[0]
    start = alone.copy()
    start[1:] |= alone[:-1]
    start[1:] |= space[1:] & ~space[:-1]
    start |= t.first[:-1]
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(d)) if len(starts) else starts, t.row_of(starts)


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """The vocabulary of this process; a path is loaded once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(ids, "<i4").tobytes()).hexdigest()
