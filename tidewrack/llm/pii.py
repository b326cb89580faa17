"""Personal data: exact base formats, and boosted trees over further candidates.

Base kinds are matched as stated and always stay.  High-recall generators propose
overlapping spans of further kinds; trees judge each by its format and its context, and
a threshold for each kind, calibrated on candidates that the trees were not fitted on,
selects what is added.  Accepted spans that overlap a base span or a likelier one go; of
a secret around digits that pass for a card or phone, what is beside these stays.
The trees are fitted on made-up sentences, generated from a fixed seed: real formats in
telling contexts against look-alikes such as dates, prices, versions and plain words.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .arrow_text import add_columns, quoted, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "national_id", "iban", "local_phone", "masked_email")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# a run of digits is entered at its start only, where a match inside it would have started
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: what stands before an @ reaches back over all local characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: kind number -> pattern; each proposes more than is accepted.
_GENERATORS = [
    (4, re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{12,}+")),
    (4, re.compile(r"""(?i)(?<![a-z])(?:token|secret|password|passwd|api_?key|key|auth)["']?\s{0,3}[=:]\s{0,3}["']?(?P<s>[^\s"',;]{6,}+)""")),
    (5, re.compile(r"(?<![0-9.,/+-])[0-9]{7,19}+(?![0-9.,/-])")),
    (6, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (7, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (8, re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")),
    (9, re.compile(r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+ ?[\[(]? ?at ?[\])]? ?[a-z0-9-]{2,63}+ ?[\[(]? ?dot ?[\])]? ?[a-z]{2,24}+(?![a-z])")),
]
_HINTS = [
    re.compile(r"(?i)token|secret|passw|api.?key|\bkey\b|auth|bearer"),
    re.compile(r"(?i)account|acct|konto|compte|cuenta|customer|client|\bid\b|number|no\.|nr"),
    re.compile(r"(?i)phone|tel|call|fax|mobile|contact|ssn|social|iban|mail|write"),
    re.compile(r"(?i)version|release|isbn|commit|sha|page|total|price|cost|\$|€|year|date|order|size|bytes"),
]


def candidates(text: str) -> list[tuple[int, int, int]]:
    out = set()
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            a, z = m.span("s") if "s" in pattern.groupindex else m.span()
            out.add((a, kind, z))
    return sorted(out)


def describe(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context features of candidate spans."""
    rows = []
    for a, kind, z in spans:
        s, before, after = text[a:z], text[max(0, a - 32) : a], text[z : z + 16]
        n = len(s)
        digits, uppers, lowers = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
        counts = Counter(s).values()
        entropy = -sum(c / n * np.log2(c / n) for c in counts)
        flips = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
        rows.append(
            [kind, n, digits / n, uppers / n, lowers / n, entropy, flips / n, sum(not c.isalnum() for c in s) / n]
            + [float(all(c in "0123456789abcdefABCDEF" for c in s)), float(luhn(s) if s.isascii() and s.isdigit() else 0)]
            + [float(bool(h.search(before))) for h in _HINTS]
            + [float(before[-1:] in "\"'"), float(bool(re.search(r"[=:]\s?[\"']?$", before))), float(after[:1] in "\"'"), float(before[-1:].isspace() or not before), float(kind == 5 and len(s) in (4, 8) and s[:2] in ("19", "20"))]
        )
    return np.array(rows, float).reshape(len(rows), 8 + 2 + len(_HINTS) + 5)


def made_up(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in n made-up sentences."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("etaoinshrdlucmf", r.randint(2, 9))
    digits, hexes, mixed = string.digits, "0123456789abcdef", string.ascii_letters + string.digits
    xs, ys = [], []
    for _ in range(n):
        yes = r.random() < 0.5
        kind = r.choice(["secret", "account", "national", "iban", "phone", "mail"])
        if kind == "secret":
            if yes:
                body = r.choice([pick(hexes, r.choice([32, 40, 64])), pick(mixed, r.randint(20, 44)), "sk-" + pick(mixed, 24), "AKIA" + pick(string.ascii_uppercase + digits, 16), word() + pick(digits + "!@#", 4), pick(mixed + r.choice(["-_", "+/"]), r.choice([86, 128, 342, r.randint(257, 1200)])), pick(hexes, r.choice([96, 128, 512]))])
                s, lead = body, r.choice(['token = "', 'api_key: "', "password=", "secret = ", "Bearer ", "key=", "auth: "])
            else:
                s = r.choice([word() + word() + "-" + pick(digits, 2), f"{word()}_{word()}_{r.randint(1, 99)}", f"{word()}-{r.randint(1, 9)}-{word()}-{word()}", "2024-0" + pick(digits, 1) + "-1" + pick(digits, 1) + "T10-00", word() + word() + word() + pick(digits, 1), r.choice("-_/").join(word() for _ in range(r.randint(20, 120))) + "-" + pick(digits, 2)])
                lead = r.choice([word() + " ", "commit ", "version ", "file " + word() + "/", word() + ", "])
                if r.random() < 0.1:  # prose without spaces is none, whatever stands before it
                    s, lead = pick("".join(map(chr, range(0x4E00, 0x4E80))), r.randint(6, 400)), r.choice(["key: ", "auth: ", "password: "])
        elif kind == "account":
            s = pick(digits[1:], 1) + pick(digits, r.choice([8, 9, 11, 12, 15]) if yes else r.choice([6, 7, 9, 11, 15, 15]))
            lead = r.choice(["account ", "customer no. ", "id ", "konto ", "account number "]) if yes else r.choice(["total ", "page ", "size ", "bytes ", word() + " "])
            if not yes and r.random() < 0.4:
                s = r.choice(["19", "20"]) + pick(digits, 2) + r.choice(["01", "11", "07"]) + pick("12", 2)
        elif kind == "national":
            s = f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"
            lead = r.choice(["ssn ", "social security ", word() + " ", "id "]) if yes else r.choice(["isbn ", "release ", "order ", "version "])
        elif kind == "iban":
            s = (r.choice(["DE", "FR", "ES", "GB", "NL"]) + pick(digits, 2) + " " + " ".join(pick(digits, 4) for _ in range(r.randint(3, 5)))) if yes else r.choice(["AB", "RX", "PN"]) + pick(digits, 2) + pick(string.ascii_uppercase, 4) + pick(string.ascii_uppercase, 4)
            lead = r.choice(["iban ", word() + " "]) if yes else r.choice(["version ", word() + " "])
        elif kind == "phone":
            s = r.choice([f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}"]) if yes else f"{pick(digits, 3)} {pick(digits, 3)} {pick(digits, 4)}"
            lead = r.choice(["call ", "tel ", "phone: ", word() + " "]) if yes else r.choice(["total ", "size ", "price $ "])
        else:
            s = f"{word()}.{word()} at {word()} dot com" if yes else f"{word()} at {word()} dot {word()}"
            if yes and r.random() < 0.5:
                s = f"{word()}{pick(digits, 2)} [at] {word()} [dot] org"
            lead = r.choice(["mail ", "write to ", "contact "]) if yes else word() + " "
        text = f"{word()} {word()} {lead}{s}" + ('"' if lead.endswith('"') else "") + f" {word()} {word()}"
        at = len(text) - len(text.split(lead, 1)[1]) if lead in text else 0
        found = candidates(text)
        for (a, _, z), x in zip(found, describe(text, found), strict=True):
            xs.append(x)
            ys.append(float(yes and a < at + len(s) and z > at and z - a >= 0.7 * len(s)))
    return np.array(xs), np.array(ys)


@dataclass(frozen=True)
class Model:
    trees: boosting.Boosted
    thresholds: dict[int, float]


def learn(size: int = 6000, precision: float = 0.97) -> Model:
    """Fit the trees, then set for each kind the least threshold with that precision on unseen candidates."""
    x, y = made_up(size, 11)
    trees = boosting.fit(x, y)
    x, y = made_up(size // 2, 12)
    p = trees.probability(x)
    thresholds = {}
    for kind in range(len(BASE_KINDS), len(KINDS)):
        own = x[:, 0] == kind
        order = np.argsort(-p[own], kind="stable")
        hits = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(hits >= precision)
        thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.0
    return Model(trees, thresholds)


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, as (start, kind number, end), sorted."""
    base = base_spans(text)
    offered = candidates(text)
    if not offered:
        return base, base
    p = model.trees.probability(describe(text, offered))
    taken = Taken([(a, z) for a, _, z in base])
    numbers = [(b, e) for b, kind, e in base if kind >= 2]
    spans = list(base)
    for k in np.argsort(-p, kind="stable").tolist():
        a, kind, z = offered[k]
        if p[k] < model.thresholds[kind]:
            continue
        parts = [(a, z)]
        if kind == KINDS.index("secret"):
            for b, e in numbers[bisect.bisect_left(numbers, (a, a)) :]:
                if b >= z:
                    break
                if e <= z and parts and parts[-1][1] > b:
                    i, j = parts.pop()
                    parts += [(x, y) for x, y in ((i, min(j, b)), (max(i, e), j)) if x < y]
        if all(map(taken.free, parts)):
            for x, y in parts:
                taken.add(x, y)
                spans.append((x, kind, y))
    return base, sorted(spans)


class Taken:
    """Disjoint intervals in order, so that a question costs the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, z in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(z, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(z)

    def free(self, span: tuple[int, int]) -> bool:
        k = bisect.bisect_left(self.starts, span[1])
        return k == 0 or self.ends[k - 1] <= span[0]

    def add(self, a: int, z: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, z)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


_NO_SPAN = hashlib.sha256(b"").hexdigest()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = _DIGIT[64] = True
#: What each generator that needs no digit needs at least: the key word and its sign, or the words at and dot after a space or bracket.
_WORDY = r"(?is)(token|secret|password|passwd|api_?key|key|auth)[\"']?[\s\x{80}-\x{10FFFF}]{0,3}[=:]|[ \[(]at.*[ \[(]dot"


def _telling(texts: pa.Array) -> list[bool]:
    """Rows that can hold a span, by a pattern that lets all pass that a base kind or a generator could match."""
    import pyarrow.compute as pc

    out = np.zeros(len(texts), bool)
    for i, j, t in slices(texts):
        c = t.count_bytes(_DIGIT)
        out[i:j] = c[t.off[1:]] > c[t.off[:-1]]
    rest = pa.array(np.flatnonzero(~out))
    out[np.asarray(rest)] = np.asarray(pc.match_substring_regex(texts.take(rest), _WORDY))
    return out.tolist()


def detect(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    A null text counts as empty; rows are independent, so repeated rows get equal spans
    and an empty table gives an empty one.  Texts of any length are read whole.  Clashing
    columns are replaced.  Of overlapping spans the base ones stay, then the likeliest; of
    equally likely ones the one that was offered first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(texts: pa.Array) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for k, some in enumerate(_telling(texts)):
            base, spans = find(texts[k].as_py(), shared.value) if some else ([], [])
            kinds = [x[1] for x in base]
            for n, c in enumerate(BASE_KINDS):
                out[f"n_{c}"].append(kinds.count(n))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest() if base else _NO_SPAN)
            out["spans"].append(_joined(spans))
        return {c: pa.array(x, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c, x in out.items()}

    return add_columns(df, text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", measure, carry)


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The frame with each span of ``text`` replaced by its kind in brackets.

    A null text stays null; all other columns stay, whatever their names.  Rows are
    independent and keep their place, so repeated rows are redacted alike and an empty table
    gives an empty one; texts of any length are read whole.
    """
    new = "_redacted"
    while new in df.columns:
        new += "_"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(texts: pa.Array) -> dict:
        flags = _telling(texts)
        if not any(flags):
            return {new: texts.cast(pa.string())}
        out = []
        for k, some in enumerate(flags):
            t = texts[k].as_py()
            if some:
                parts, done = [], 0
                for a, kind, z in find(t, shared.value)[1]:
                    if z > done:
                        parts += [t[done : max(a, done)], f"[{KINDS[kind].upper()}]" if a >= done else ""]
                        done = z
                t = "".join(parts) + t[done:]
            out.append(t)
        return {new: pa.array(out, pa.string())}

    made = add_columns(df, text, f"{new} string", measure)
    return made.select(*(F.when(quoted(c).isNotNull(), F.col(new)).alias(c) if c == text else quoted(c) for c in df.columns))
