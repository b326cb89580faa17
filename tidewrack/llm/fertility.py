"""Quality rules and tokeniser fertility.

The rules need whole texts only: counts of words, symbols, repeated lines and repeated
word windows.  Fertility asks how public vocabularies take a text: characters per
token, the share of byte-fallback tokens (of a byte-level vocabulary: tokens that are
parts of a code point), and the entropy of the token distribution.  Two vocabularies are
asked, one of pieces and a multilingual one of bytes.  Bands of these, one per language
or else per script, reject texts that a vocabulary finds too easy, too hard or too
monotonous.  Bands hold for texts of all lengths; they are wider by the error that a mean
over so few tokens has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import byte_bpe, vocab
from .arrow_text import SPACE_WORDS, Texts, add_columns, codes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: True for the first byte of each code point.
POINTS = (np.arange(256) & 0xC0) != 0x80
MIN_WORDS = 50
#: Spread of one token's characters, of its being a byte and of its share of entropy: by
#: these over the root of the number of tokens a band is wider.
SPREAD = np.array([2.0, 0.5, 0.5])


@dataclass(frozen=True)
class Band:
    """Accepted ranges; entropy is in bits and relative to the most that the token count allows."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: By vocabulary and language; languages not listed go by script.
LANGUAGE_BANDS = {
    "piece": {
        "en": Band(2.0, 4.9, 0.08, 0.55),
        "de": Band(2.1, 4.9, 0.08, 0.535),
        "fr": Band(1.8, 4.9, 0.08, 0.53),
        "es": Band(1.9, 4.9, 0.08, 0.54),
    },
    "bytes": {
        "en": Band(2.3, 5.4, 0.06, 0.56),
        "de": Band(2.4, 5.4, 0.06, 0.545),
        "fr": Band(2.1, 5.4, 0.06, 0.54),
        "es": Band(2.2, 5.4, 0.06, 0.54),
    },
}
#: By vocabulary and script, told from the lead bytes of a text's letters.
SCRIPT_BANDS = {
    "piece": {
        "latin": Band(1.4, 5.2, 0.10, 0.50),
        "cyrillic": Band(1.2, 4.5, 0.15, 0.50),
        "east_asian": Band(0.3, 2.5, 0.75, 0.45),
        "other": Band(0.2, 5.0, 0.95, 0.40),
    },
    "bytes": {
        "latin": Band(1.7, 5.8, 0.12, 0.50),
        "cyrillic": Band(1.0, 5.0, 0.50, 0.50),
        "east_asian": Band(0.3, 2.5, 0.95, 0.40),
        "other": Band(0.2, 5.4, 1.00, 0.40),
    },
}
_SCRIPT = np.full(256, -1)
_SCRIPT[65:91] = _SCRIPT[97:123] = 0
_SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xD0:0xD4] = 1
_SCRIPT[0xE3:0xEE] = 2
_SCRIPT[0xCA:0xD0] = _SCRIPT[0xD4:0xE3] = _SCRIPT[0xEE:0xF5] = 3
#: Scripts first, then languages; a text's band is its index here.
NAMES = [*SCRIPT_BANDS["piece"], *LANGUAGE_BANDS["piece"]]


def limits_of(kind: str) -> np.ndarray:
    """The four limits of each band of NAMES."""
    return np.array([[b.least_chars, b.most_chars, b.most_bytes, b.least_entropy] for b in (SCRIPT_BANDS[kind] | LANGUAGE_BANDS[kind]).values()])


def rules(t: Texts) -> dict[str, np.ndarray]:
    """The counts of the base rules, for each row."""
    starts, ends, rows = t.words(SPACE_WORDS)
    points, symbols, word_bytes = t.count_bytes(POINTS), t.count_bytes(SYMBOLS), t.count_bytes(SPACE_WORDS)
    n_words = np.bincount(rows, minlength=t.n)
    word_chars = np.bincount(rows, weights=points[ends] - points[starts], minlength=t.n)
    ls, le, lr = t.lines()
    line, _ = codes(t, ls, le, t.data != 10)
    full = word_bytes[le] > word_bytes[ls]
    n_dup = np.bincount(lr[full], minlength=t.n)
    once = np.unique(line[full] * t.n + lr[full])
    n_dup = n_dup - np.bincount(once % t.n, minlength=t.n) if t.n else n_dup
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[t.off[1:]] - symbols[t.off[:-1]],
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words(*codes(t, starts, ends, SPACE_WORDS[t.data]), rows, t.n),
    }


def repeat_words(word: np.ndarray, words: int, rows: np.ndarray, n: int, k: int = 3) -> np.ndarray:
    """Words in k-word windows that stand twice or more in their row; equal words have equal numbers, below ``words``."""
    if len(word) < k:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
    # windows grow by a word at a time and are numbered anew, so no number leaves 64 bits
    number = rows[at]
    for j in range(k):
        number = pd.factorize(number * np.int64(words) + word[at + j])[0]
    hit = at[np.bincount(number, minlength=1)[number] > 1]
    inside = np.zeros(len(word), bool)
    for j in range(k):
        inside[hit + j] = True
    return np.bincount(rows[inside], minlength=n)


def fertility(is_byte: np.ndarray, ids: np.ndarray, per_row: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
    """chars_per_token, byte_share and entropy (bits) of rows of so many ids and characters."""
    size, of_row = len(per_row), np.repeat(np.arange(len(per_row)), per_row)
    n = np.maximum(per_row, 1)
    keys = np.sort(of_row * len(is_byte) + ids.astype(np.int64))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(keys)))
    of = keys[new] // len(is_byte)
    entropy = np.log2(n) - np.bincount(of, weights=counts * np.log2(np.maximum(counts, 1)), minlength=size) / n
    return {
        "chars_per_token": chars / n,
        "byte_share": np.bincount(of_row, weights=is_byte[ids], minlength=size) / n,
        "entropy": entropy,
    }


def outside(measured: dict[str, np.ndarray], per_row: np.ndarray, lim: np.ndarray) -> np.ndarray:
    """Rows whose measures lie outside their limits by more than their own error; never rows without tokens."""
    chars, share, whole = SPREAD[:, None] / np.sqrt(np.maximum(per_row, 1))
    # one token has all the entropy that it can have
    full = np.where(per_row > 1, measured["entropy"] / np.log2(np.clip(per_row, 2, 4096)), 1.0)
    cpt = measured["chars_per_token"]
    return (per_row > 0) & ((cpt < lim[:, 0] - chars) | (cpt > lim[:, 1] + chars) | (measured["byte_share"] > lim[:, 2] + share) | (full < lim[:, 3] - whole))


def script_of(t: Texts) -> np.ndarray:
    """Index in SCRIPT_BANDS of the script with the most letters; latin on ties and without letters."""
    kinds = _SCRIPT[t.data]
    rows = np.repeat(np.arange(t.n), np.diff(t.off))
    seen = kinds >= 0
    counts = np.bincount(rows[seen] * 4 + kinds[seen], minlength=4 * t.n).reshape(t.n, 4)
    return counts.argmax(1)


def screen(df: DataFrame, text: str = "text", lang: str | None = "lang", model: str | None = None, ranks: tuple[str, str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds the rule counts, the fertility measures, base_failed, band_failed and kept.

    ``model`` is a SentencePiece file, ``ranks`` a byte vocabulary's file and pattern; the
    measures of the latter are the columns multi_*.  A null text counts as empty: it fails
    the base rules, and no band.  An unknown or null language goes by script.  Rows are
    judged one by one, so repeated rows get equal verdicts and an empty table gives no rows;
    a text is measured whole at any length, within slices of 1 MiB or alone.  Columns of
    ``df`` with the name of an added one are replaced.
    """
    path, ranks = model or vocab.model_path(), ranks or byte_bpe.ranks_path()
    measures = ["chars_per_token", "byte_share", "entropy"]
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, band_failed boolean, kept boolean, chars_per_token double, byte_share double, entropy double, n_tokens long, multi_chars_per_token double, multi_byte_share double, multi_entropy double, multi_tokens long, band string"
    kinds = dict(f.split() for f in fields.split(", "))
    of_lang = {c: NAMES.index(c) for c in LANGUAGE_BANDS["piece"]}
    piece_limits, byte_limits = limits_of("piece"), limits_of("bytes")

    def measure(texts: pa.Array, langs: pa.Array | None = None) -> dict:
        v, multi = vocab.load(path), byte_bpe.load(*ranks)
        found: list[dict] = []
        told = langs.to_pylist() if langs is not None else None
        for (i, j, ids, n), t in zip(v.encode(texts), _aligned(texts), strict=True):
            x = rules(t)
            points = t.count_bytes(POINTS)
            chars = points[t.off[1:]] - points[t.off[:-1]]
            band = script_of(t)
            if told is not None:
                band = np.array([of_lang.get(c, s) for c, s in zip(told[i:j], band.tolist(), strict=True)], np.int64)
            pieces = fertility(v.is_byte, ids, n, chars)
            own = [multi.encode(texts[k].as_py()) for k in range(i, j)]
            m = np.array([len(one) for one in own])
            parts = fertility(multi.is_byte, np.concatenate(own), m, chars)
            x["base_failed"] = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            x["band_failed"] = outside(pieces, n, piece_limits[band]) | outside(parts, m, byte_limits[band])
            x["kept"] = ~x["base_failed"] & ~x["band_failed"]
            found.append(x | pieces | {"n_tokens": n, "multi_tokens": m, "band": np.array(NAMES)[band]} | {f"multi_{c}": parts[c] for c in measures})
        whole = {c: np.concatenate([x[c] for x in found]) if found else [] for c in kinds}
        return {c: np.asarray(x, np.int64) if kinds[c] == "long" else x for c, x in whole.items()}

    return add_columns(df, text, fields, measure, carry, second=lang)


def _aligned(texts: pa.Array):
    """The texts in the slices that the encoder makes of them with its prefix byte."""
    from .arrow_text import SLICE_BYTES

    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    ahead = off + np.arange(len(off))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + SLICE_BYTES, side="right")) - 1)
        yield Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j
