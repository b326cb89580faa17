"""N-grams counted in arrays against those counted as strings."""

import random
from collections import Counter

import pytest

from tidewrack.operators import router
from tidewrack.operators import term_counts as K


def texts():
    r = random.Random(3)
    made = [" ".join("".join(r.choice("abcé한 ") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 30))) for _ in range(30)]
    return ["aa bb", "aa aa", None, "", "x" * 50, "a", "  Aé　日本 \x00z\x00 ", "한국어 공지 aİB", "\x1c q", "😀😀 w", "ß ẞ", *made]


def grams(text):
    out = Counter()
    for w, n in router.words(text):
        for g in router.word_ngrams(w):
            out[g] += n
    return out


def test_frequencies_are_those_of_strings():
    many = [" ".join(map(chr, range(0x4E00, 0x4E00 + 6000))), "aa 一"]  # too many letters for whole numbers
    for given in (texts(), many, []):
        got = Counter()
        for terms, counts in K.frequencies(given):
            for t, n in zip(terms, counts, strict=True):
                got[t] += n
        assert got == Counter(g for t in given for g in grams(t))


@pytest.mark.parametrize("cells", [0, 1 << 24])
@pytest.mark.parametrize("places", [7, 1 << 20])
def test_counts_are_those_of_strings(monkeypatch, cells, places):
    monkeypatch.setattr(K, "CELLS", cells)
    monkeypatch.setattr(K, "PLACES", places)
    given = texts()
    every = sorted({g for t in given for g in grams(t)})
    for names in (every[::2] + ["  ", "a", "too long", "b c"], every[:3], []):
        text, term, times = K.Terms(names).counts(given)
        want = {(i, g): n for i, t in enumerate(given) for g, n in grams(t).items() if g in set(names)}
        assert {(a, names[b]): n for a, b, n in zip(text.tolist(), term.tolist(), times.tolist(), strict=True)} == want
