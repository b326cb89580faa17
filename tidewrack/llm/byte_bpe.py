"""A byte-level vocabulary: ids of whole texts, and which tokens are parts of a code point."""

from __future__ import annotations

import base64

import numpy as np
import regex
import tiktoken


def _part(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return True
    return False


class ByteVocabulary:
    """The vocabulary of a file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        self.is_byte[[rank for piece, rank in ranks.items() if _part(piece)]] = True

    def encode(self, text: str) -> np.ndarray:
        """The ids; special strings are ordinary text."""
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the library gives up on runs of a million spaces
            return self.by_pieces(text)

    def by_pieces(self, text: str) -> np.ndarray:
        """The same ids from pre-tokens that are cut here."""
        core = self.encoding._core_bpe
        return np.concatenate([np.array(core.encode_single_piece(m.group().encode()), np.uint32) for m in self.pattern.finditer(text)] or [np.zeros(0, np.uint32)])


_loaded: dict[str, ByteVocabulary] = {}


def load(path: str, pattern: str) -> ByteVocabulary:
    """The vocabulary of this process; a path is loaded once."""
    if path not in _loaded:
        _loaded[path] = ByteVocabulary(path, pattern)
    return _loaded[path]


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pre-token pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
