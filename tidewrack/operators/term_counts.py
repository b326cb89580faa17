"""N-grams of padded words, counted in arrays of code points, a slice of texts at a time.

The words of a text stand padded one after the other, so two spaces part them, and an n-gram
is a stretch of code points without two spaces.  No n-gram becomes a string but those that
are told by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Lengths of the n-grams.
SHORTEST, LONGEST = 2, 5
#: Places of a text that are worked on at once, and cells of a table of successors; a larger one is searched.
PLACES, CELLS = 1 << 21, 1 << 24
SPACE = ord(" ")


def code_points(texts: list[str | None], once: bool) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts' padded words, each word or, once, each different word of a text; and the text of each place."""
    made = [f" {'  '.join(set(w) if once else w)} " if (w := (t or "").lower().split()) else "" for t in texts]
    codes = np.frombuffer("".join(made).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.repeat(np.arange(len(made)), [len(x) for x in made])


def _named(codes: np.ndarray) -> list[str]:
    """The strings of the rows of code points."""
    whole, n = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), codes.shape[1]
    return [whole[i : i + n] for i in range(0, len(whole), n)]


def frequencies(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Terms and how many of the texts hold each; a term may come again.

    Letters are numbered by slice, so that an n-gram and its text are one whole number.  Texts
    of too many letters for that are halved; a single one's n-grams are told apart as strings.
    """
    codes, of = code_points(texts, True)
    there = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there[codes] = True
    used = np.flatnonzero(there)
    bits, low = len(used).bit_length(), max(len(texts) - 1, 0).bit_length()
    if LONGEST * bits + low > 63 or len(codes) > 4 * PLACES:
        if len(texts) > 1:
            half = len(texts) // 2
            yield from frequencies(texts[:half])
            yield from frequencies(texts[half:])
            return
        padded = [f" {w} " for w in set((texts[0] or "").lower().split())]
        found = {p[i : i + n] for p in padded for n in range(SHORTEST, LONGEST + 1) for i in range(len(p) - n + 1)}
        yield list(found), [1] * len(found)
        return
    if not len(codes):
        return
    number = np.zeros(int(used[-1]) + 1, np.int64)
    number[used] = np.arange(1, len(used) + 1)
    letter = number[codes]
    joined = ~((codes[:-1] == SPACE) & (codes[1:] == SPACE))
    key, whole = letter, np.ones(len(codes), bool)
    for n in range(SHORTEST, LONGEST + 1):
        if len(codes) < n:
            return
        key = key[:-1] << bits | letter[n - 1 :]
        whole = whole[:-1] & joined[n - 2 :]
        pairs = key[whole] << low | of[: len(key)][whole]
        if not len(pairs):
            continue
        pairs.sort()
        gram = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] >> low
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        rows = np.stack([used[(gram[first] >> bits * (n - 1 - j) & (1 << bits) - 1) - 1] for j in range(n)], 1)
        yield _named(rows), np.diff(np.append(first, len(gram))).tolist()


class Terms:
    """The terms of a model as a trie, by whose nodes all places of a slice go at once."""

    def __init__(self, terms: list[str]):
        known = [(k, t) for k, t in enumerate(terms) if SHORTEST <= len(t) <= LONGEST and "  " not in t]  # others are no n-gram
        inner = dict.fromkeys(t[:n] for _, t in known for n in range(len(t))) | {"": None}
        node = {p: i + 1 for i, p in enumerate(inner)}  # 0 is none
        self.size, self.root = len(terms), node[""]
        for _, t in known:
            node.setdefault(t, len(node) + 1)
        letters = sorted({c for _, t in known for c in t})
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 1
        self.letter = np.zeros((ord(letters[-1]) if letters else 0) + 2, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.width)
        term = {t: k for k, t in known}
        # an edge, by the place of its node's row and its letter: the place of the next node's row, 0 for none, and the term that it ends
        edges = sorted((node[p[:-1]] * self.width + number[p[-1]], i * self.width if p in inner else 0, term.get(p, self.size)) for p, i in node.items() if p)
        self.edges, self.row, self.term = (np.array([e[k] for e in edges], np.int64) for k in range(3))
        self.full = (len(inner) + 1) * self.width <= CELLS
        if self.full:
            self.row, self.term = np.zeros((len(inner) + 1) * self.width, np.int32), np.full((len(inner) + 1) * self.width, self.size, np.int32)
            self.row[self.edges], self.term[self.edges] = zip(*(e[1:] for e in edges), strict=True) if edges else ((), ())

    def _next(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next row and the term, or size, of each edge."""
        if self.full:
            return self.row[key], self.term[key]
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        there = self.edges[at] == key
        return np.where(there, self.row[at], 0), np.where(there, self.term[at], self.size)

    def _found(self, codes: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length, the terms of the n-grams that begin at the places of ``of``, or size, and their texts."""
        letter = self.letter[np.minimum(codes, len(self.letter) - 1)]
        row, _ = self._next(self.root * self.width + letter)
        for n in range(SHORTEST, LONGEST + 1):
            row, term = self._next(row[:-1] + letter[n - 1 :])
            yield term[: len(of)], of[: len(term)]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and how often it stands there, by text and term."""
        codes, of = code_points(texts, False)
        wide, keys, times = self.size + 1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(codes) if len(self.edges) else 0, PLACES):
            found = self._found(codes[a : a + PLACES + LONGEST - 1], of[a : a + PLACES])
            if len(texts) * wide <= 4 * len(codes):
                cells = np.zeros(len(texts) * wide, np.int64)
                for term, own in found:
                    cells += np.bincount(own * wide + term, minlength=len(cells))
                cells[self.size :: wide] = 0
                own = np.flatnonzero(cells)
                n = cells[own]
            else:
                own, n = np.unique(np.concatenate([(own * wide + term)[term < self.size] for term, own in found]), return_counts=True)
            if len(keys):  # a text that goes on from the places before
                own, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
                n = np.bincount(back, np.concatenate([times, n]), len(own)).astype(np.int64)
            keys, times = own, n
        return *np.divmod(keys, wide), times
