"""Document quality from a linear-chain conditional random field over lines.

Each line that has a word is good (1) or bad (0).  A line's features are its own and
those of the lines before and after it; the chain's transition weights tie neighbours.
Forward-backward gives each line's probability of being good, and a document's quality
is the mean of these, weighted by the lines' lengths and mapped to a probability.

Labels are known for documents only.  A line's own label is learned from them: a first
field sees each line alone, so a line that looks as lines of good documents do counts as
good in a bad one too, and the other way round.  At least half of a document, by length,
keeps the document's label, the lines that suit it best.

The fit takes all labelled documents.  Their lines' features are written once; each step
sums what it needs of every document in the tasks, and only these sums reach the driver.
They are sums of whole numbers, so their order and the partitions don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import SPACE_WORDS, Texts, add_columns, column, mix, slices
from .store import forget, keep

#: Bounds on the labelled rows of a fit and on the lines that they hold together; None takes all,
#: as every query does.  Rows are taken by the order of their keys' hashes, those of least lines first.
SAMPLE: int | None = None
SAMPLE_LINES: int | None = None
#: Most sums of gradients of a fit, and the greatest gradient that ends it before.
STEPS, FLAT = 60, 1e-4
#: What a text adds to a sum is rounded to whole parts of this.
UNIT = 2.0**30
#: Lines that are worked on at once; one longer text is by itself.
BLOCK_LINES = 1 << 16
#: Steps of a log-odds by which texts are counted for the map to probabilities.
GRAIN = 256
#: A line counts with the other label from this probability on, good and bad documents being held equally likely.
SURE = 0.6


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "upper": _marks(bytes(range(65, 91))),
    "lower": _marks(bytes(range(97, 123))),
    "digit": _marks(b"0123456789"),
    "pipe": _marks(b"|<>"),
    "symbol": _marks(b"#*$%&@~^=_+{}[]\\"),
    "stop": _marks(b".!?"),
    "loud": _marks(b"!?"),
    "comma": _marks(b",;:"),
    "wide": np.arange(256) >= 0x80,
}
FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_length", "same_as_last_word", "distinct_words", "repeats_line", "ends_stop"]


def line_features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of the lines with a word, their rows and their lengths in bytes."""
    ls, le, lr = t.lines()
    word_bytes = t.count_bytes(SPACE_WORDS)
    full = word_bytes[le] > word_bytes[ls]
    ls, le, lr = ls[full], le[full], lr[full]
    if not len(ls):
        return np.zeros((0, len(FEATURES)), np.float32), lr, le - ls
    length = le - ls
    cols = []
    for table in _CLASSES.values():
        c = t.count_bytes(table)
        cols.append((c[le] - c[ls]) / length)
    ws, we, _ = t.words(SPACE_WORDS)
    h = t.hashes(ws, we)
    line = np.searchsorted(le, ws, side="right")
    n = np.bincount(line, minlength=len(ls))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    keys = np.sort(mix(h + line.astype(np.uint64)))
    doubled = np.unique(keys[1:][keys[1:] == keys[:-1]])
    k = mix(h + line.astype(np.uint64))
    again = np.zeros(len(h), bool)
    if len(doubled):
        again = doubled[np.minimum(np.searchsorted(doubled, k), len(doubled) - 1)] == k
    line_hash = mix(t.hashes(ls, le) + lr.astype(np.uint64))
    _, inverse, times = np.unique(line_hash, return_inverse=True, return_counts=True)
    cols += [
        np.log1p(length),
        np.log1p(n),
        (word_bytes[le] - word_bytes[ls]) / n,
        np.bincount(line, weights=same, minlength=len(ls)) / n,
        1 - np.bincount(line, weights=again, minlength=len(ls)) / n,
        times[inverse] > 1,
        _CLASSES["stop"][t.data[le - 1]],
    ]
    return np.stack(cols, 1).astype(np.float32), lr, length


def with_neighbours(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (else zeros), and two edge marks."""
    n, f = own.shape
    out = np.zeros((n, 3 * f + 3), np.float32)
    out[:, :f] = own
    if n > 1:
        joined = rows[1:] == rows[:-1]
        out[1:, f : 2 * f] = own[:-1] * joined[:, None]
        out[:-1, 2 * f : 3 * f] = own[1:] * joined[:, None]
        out[1:, 3 * f] = ~joined
        out[:-1, 3 * f + 1] = ~joined
    if n:
        out[0, 3 * f] = out[-1, 3 * f + 1] = 1
    out[:, 3 * f + 2] = 1
    return out


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, pair marginals of each line with the next one, and log-likelihood normaliser of many chains.

    emit: log-odds of good for each line; step: 2x2 transition weights.  The chains are
    advanced together, one line at a time; what a chain gets doesn't depend on the others.
    """
    n, order = len(emit), np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    most = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(most), side="left")  # chains longer than t
    off = np.concatenate([[0], np.cumsum(live)]).tolist()
    live = live.tolist()
    # line t of all chains stands together, the longest chain first
    at = np.empty(n, np.int64)
    for t in range(most):
        at[off[t] : off[t + 1]] = starts[: live[t]] + t
    odds = np.exp(np.clip(emit, -30, 30))[at]
    e0, e1 = 1 / (1 + odds), odds / (1 + odds)
    (m00, m01), (m10, m11) = np.exp(step).tolist()
    a0, a1, scale = np.empty(n), np.empty(n), np.empty(n)
    for t in range(most):
        now = slice(off[t], off[t + 1])
        x0, x1 = e0[now], e1[now]
        if t:
            p = slice(off[t - 1], off[t - 1] + live[t])
            p0, p1 = a0[p], a1[p]
            x0, x1 = (p0 * m00 + p1 * m10) * x0, (p0 * m01 + p1 * m11) * x1
        scale[now] = total = x0 + x1
        a0[now], a1[now] = x0 / total, x1 / total
    b0, b1, pairs = np.ones(n), np.ones(n), np.zeros((4, n))
    for t in range(most - 2, -1, -1):
        now, nxt = slice(off[t], off[t] + live[t + 1]), slice(off[t + 1], off[t + 2])
        x0, x1 = e0[nxt] * b0[nxt] / scale[nxt], e1[nxt] * b1[nxt] / scale[nxt]
        pairs[0, now], pairs[1, now] = a0[now] * (m00 * x0), a0[now] * (m01 * x1)
        pairs[2, now], pairs[3, now] = a1[now] * (m10 * x0), a1[now] * (m11 * x1)
        b0[now], b1[now] = m00 * x0 + m01 * x1, m10 * x0 + m11 * x1
    b1 *= a1
    good, out = np.empty(n), np.empty((4, n))
    good[at] = b1 / (a0 * b0 + b1)
    out[:, at] = pairs
    return good, out, float(np.log(scale).sum())


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    step: np.ndarray
    prior: float
    #: Slope and offset of the map from mean marginals to probabilities.
    turn: tuple[float, float] = (1.0, 0.0)

    def emit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weight

    def score(self, t: Texts) -> np.ndarray:
        """Quality of each row, 0 to 1; rows without a word get the share of good texts in the fit."""
        own, rows, length = line_features(t)
        out = np.full(t.n, self.prior)
        if len(rows):
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            good, _, _ = forward_backward(self.emit(with_neighbours(own, rows)), starts, np.diff(np.append(starts, len(rows))), self.step)
            total = np.bincount(rows, weights=length, minlength=t.n)
            some = total > 0
            out[some] = self.calibrated((np.bincount(rows, weights=good * length, minlength=t.n)[some] / total[some]).clip(0, 1))
        return out

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.turn[0] * _logit(share) + self.turn[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class Sampled:
    """Lines of one labelled text: their own features, their lengths, and the label."""

    lines: np.ndarray
    length: np.ndarray
    label: int


def sampled(own: np.ndarray, length: np.ndarray, label: int) -> Sampled:
    """All lines of a text."""
    return Sampled(own, length, label)


@dataclass(frozen=True)
class Block:
    """Lines of several labelled texts: own features, lengths, the number of lines of each text and its label."""

    own: np.ndarray
    length: np.ndarray
    sizes: np.ndarray
    label: np.ndarray

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.own.T)

    def each(self, x: np.ndarray) -> np.ndarray:
        """What a text has, for each of its lines."""
        return np.repeat(x, self.sizes)

    def sum(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def ahead(self, x: np.ndarray) -> np.ndarray:
        """What the next line of the same text has, else 0."""
        out = np.append(x[1:], 0.0)
        out[self.starts[1:] - 1] = 0
        return out

    def behind(self, x: np.ndarray) -> np.ndarray:
        """What the line before in the same text has, else 0."""
        out = np.append(0.0, x[:-1])
        out[self.starts] = 0
        return out

    def emit(self, u: np.ndarray, offset: float, near: bool = True) -> np.ndarray:
        """Log-odds of the lines for weights of features as they are; ``near``: with the neighbours' features.

        Lines are summed alike wherever they stand, which a matrix product doesn't promise.
        """
        f = len(FEATURES)
        own = [sum(x.astype(float) * w for x, w in zip(self.columns, u[k * f : (k + 1) * f].tolist(), strict=True)) for k in range(3 if near else 1)]
        out = own[0] + (u[-1] - offset)
        if near:
            out += self.behind(own[1]) + self.ahead(own[2])
            out[self.starts] += u[3 * f]
            out[self.starts + self.sizes - 1] += u[3 * f + 1]
        return out

    def weighed(self, r: np.ndarray, near: bool = True, squared: bool = False) -> np.ndarray:
        """Sums of r times each feature by text; without ``near``, of the own features and the constant."""
        rs = [r, self.ahead(r), self.behind(r)] if near else [r]
        out = [[], [], []]
        for x in self.columns:
            x = x.astype(float)
            for k, v in enumerate(rs):
                out[k].append(self.sum((x * x if squared else x) * v))
        edges = [r[self.starts], r[self.starts + self.sizes - 1]] if near else []
        return np.stack([*out[0], *out[1], *out[2], *edges, self.sum(r)])


def blocks(own: np.ndarray, length: np.ndarray, sizes: np.ndarray, label: np.ndarray):
    """Texts, none of them without lines, in blocks of at most BLOCK_LINES lines or one text."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        lo = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_LINES, side="right")))
        yield Block(own[lo : ends[j - 1]], length[lo : ends[j - 1]], sizes[i:j], label[i:j])
        i = j


def exact(x: np.ndarray) -> list[int]:
    """Sums over the texts in whole units, which come out alike in any order."""
    x = np.rint(x * UNIT)
    if np.abs(x).max(initial=0) * x.shape[1] < 2**62:
        return x.astype(np.int64).sum(1).tolist()
    return [sum(map(int, row)) for row in x.tolist()]


def line_labels(b: Block, good: np.ndarray) -> np.ndarray:
    """Labels of all lines, given how good each looks alone."""
    told = b.each(b.label)
    p = np.where(told > 0, good, 1 - good)
    order = np.lexsort((-p, b.each(np.arange(len(b.sizes)))))
    length = b.length[order]
    total = np.cumsum(length)
    before = total - length - b.each((total - length)[b.starts])
    must = np.zeros(len(p), bool)
    must[order] = 2 * before < b.each(b.sum(b.length))
    return np.where(must | (p > 1 - SURE), told, 1 - told)


def climb(gradient: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int) -> np.ndarray:
    """The top of a concave function by its gradients, at most ``steps`` of them: limited-memory BFGS.

    Along a line the slope only falls, so a step that went too far is known by its slope.
    """
    g, past = gradient(x), []
    k = 1
    while k < steps and np.abs(g).max() > FLAT:
        d, held = g.copy(), []
        for s, y, sy in reversed(past):
            held.append(s @ d / sy)
            d -= held[-1] * y
        d *= past[-1][2] / (past[-1][1] @ past[-1][1]) if past else min(1.0, 1 / np.linalg.norm(g))
        for (s, y, sy), a in zip(past, reversed(held), strict=True):
            d += (a - y @ d / sy) * s
        rise, t = g @ d, 1.0
        while True:
            new, k = gradient(x + t * d), k + 1
            if new @ d >= -0.5 * rise or k >= steps:
                break
            t *= max(0.1, rise / (rise - new @ d))
        s, y = t * d, g - new
        x, g = x + s, new
        if s @ y > 0:
            past = [*past, (s, y, s @ y)][-10:]
    return x


def fit(texts: list[Sampled], steps: int = STEPS, penalty: float = 1e-3) -> LineField:
    """The field of labelled texts that are at hand."""
    texts = [t for t in texts if len(t.length)]
    own = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *(t.lines for t in texts)])
    length = np.concatenate([np.zeros(0, np.int64), *(t.length for t in texts)])
    held = list(blocks(own, length, np.array([len(t.length) for t in texts], np.int64), np.array([t.label for t in texts], np.int64)))
    return fitted(lambda make: [sum(c) for c in zip(*map(make, held), strict=True)], steps, penalty)


def fitted(total: Callable[[Callable[[Block], list[int]]], list[int]], steps: int = STEPS, penalty: float = 1e-3) -> LineField:
    """The field of labelled texts: line labels first, then the chain, then the map to probabilities.

    ``total`` sums what a function makes of each block of texts.  Every text weighs alike,
    whatever its number of lines: a line weighs the inverse of its text's lines, and so do
    a chain's transitions.  The result depends on the texts alone, not on any randomness.
    """
    f = len(FEATURES)
    width = 3 * f + 3

    def measure(b: Block) -> list[int]:
        one = np.ones(len(b.own))
        return [int((b.label == 0).sum()), int((b.label != 0).sum()), *exact(b.weighed(one)), *exact(b.weighed(one, squared=True))]

    got = total(measure)
    n0, n1 = got[:2] if got else (0, 0)
    n = n0 + n1
    if not n0 or not n1:
        prior = float(n1 > 0) if n else 0.5
        return LineField(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), prior, (0.0, float(_logit(np.array(prior)))))
    first, second = got[2 : 2 + width], got[2 + width :]
    lines = first[-1]
    mean = np.array([a / lines for a in first])
    spread = np.sqrt([max(q * lines - a * a, 0) / (lines * lines) for a, q in zip(first, second, strict=True)]) + 1e-3
    mean[-1], spread[-1] = 0, 1

    def plain(w: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights for features as they are, and what to take off."""
        u = w / spread
        return u, float(mean @ u)

    def normal(sums: np.ndarray, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Sums of r times normalised features, of those of features as they are; the last one is r's."""
        return (sums - mean[at] * sums[-1]) / spread[at]

    own = np.r_[0:f, width - 1]  # the line itself and the constant

    def widened(w: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        out[own] = w
        return out

    def alone_gradient(w: np.ndarray) -> np.ndarray:
        u, offset = plain(widened(w))

        def make(b: Block) -> list[int]:
            # good and bad texts weigh alike together
            even = np.where(b.label > 0, n / (2 * n1), n / (2 * n0)) / b.sizes
            return exact(b.weighed(b.each(even) * (b.each(b.label) - _sigmoid(b.emit(u, offset, False))), False))

        return normal(np.array(total(make), float) / UNIT / n, own) - penalty * w

    u, offset = plain(widened(climb(alone_gradient, np.zeros(f + 1), steps)))

    def observed(b: Block) -> list[int]:
        y = line_labels(b, _sigmoid(b.emit(u, offset, False)))
        inner = np.ones(len(y))
        inner[b.starts + b.sizes - 1] = 0
        pair = 2 * y + b.ahead(y)
        return exact(np.concatenate([b.weighed(y / b.each(b.sizes)), [b.sum(inner * (pair == k)) / b.sizes for k in range(4)]]))

    seen = np.array(total(observed), float) / UNIT / n

    def chain_gradient(v: np.ndarray) -> np.ndarray:
        (u, offset), step = plain(v[:width]), v[width:].reshape(2, 2)

        def make(b: Block) -> list[int]:
            good, pairs, _ = forward_backward(b.emit(u, offset), b.starts, b.sizes, step)
            return exact(np.concatenate([b.weighed(good / b.each(b.sizes)), [b.sum(p) / b.sizes for p in pairs]]))

        g = seen - np.array(total(make), float) / UNIT / n
        return np.append(normal(g[:width]), g[width:]) - penalty * v

    v = climb(chain_gradient, np.zeros(width + 4), steps)
    w, step = v[:width], np.clip(v[width:].reshape(2, 2), -8, 8)
    (u, offset), most = plain(w), int(np.rint(_logit(np.array(1.0)) * GRAIN))

    def counted(b: Block) -> list[int]:
        good, _, _ = forward_backward(b.emit(u, offset), b.starts, b.sizes, step)
        at = np.rint(_logit(b.sum(good * b.length) / b.sum(b.length)) * GRAIN).astype(np.int64) + most
        return np.bincount(2 * at + (b.label > 0), minlength=2 * (2 * most + 1)).tolist()

    count = np.array(total(counted))
    some = np.flatnonzero(count)
    return LineField(mean, spread, w, step, n1 / n, slope((some // 2 - most) / GRAIN, (some % 2).astype(float), count[some]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slope(x: np.ndarray, y: np.ndarray, count: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """A logistic curve through (x, y), each of them ``count`` times, by Newton steps; it never falls."""
    a, b = 1.0, 0.0
    share = count / count.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h, r = share * p * (1 - p), share * (y - p)
        g = np.array([(r * x).sum() - penalty * (a - 1), r.sum() - penalty * b])
        m = np.array([[(h * x * x).sum() + penalty, (h * x).sum()], [(h * x).sum(), h.sum() + penalty]])
        move = np.clip(np.linalg.solve(m, g), -1, 1)
        a, b = a + move[0], b + move[1]
    return max(float(a), 0.0), float(b)


def held_out(key):
    """True where crc32 of the key's text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int | None = SAMPLE) -> LineField:
    """Fit on all labelled rows that aren't held out, or on at most ``sample`` of them, of SAMPLE_LINES lines together.

    The features of the rows' lines, which come whole, are written to the shared folder for
    the time of the fit.  Rows with a null key or label and texts without a word are left out;
    of a key's repeated labels the largest counts, of its repeated rows the least text.
    Without labels, or with one kind only, every text gets that share as its score.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    if sample is not None:
        known = known.orderBy(F.xxhash64(key), key).limit(sample)
    whole = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(known.withColumnRenamed(key, "_key"), "_key").groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    if SAMPLE_LINES is not None:
        lines, order = 1 + F.length("_text") - F.length(F.translate("_text", "\n", "")), ["_lines", F.xxhash64("_key"), "_key"]
        few = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over at most SAMPLE_LINES rows, as each has a line
        whole = whole.withColumn("_lines", lines).orderBy(*order).limit(SAMPLE_LINES).withColumn("_total", F.sum("_lines").over(few)).where(F.col("_total") <= SAMPLE_LINES)

    def run(batches):
        for b in batches:
            texts, y = column(b, "_text"), b.column(b.schema.get_field_index("_label")).to_pylist()
            for i, j, t in slices(texts):
                own, rows, length = line_features(t)
                cut = np.searchsorted(rows, np.arange(t.n + 1))
                got = [(own[a:z], length[a:z], y[i + k]) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
                cols = [pa.array([x.astype("<f4").tobytes() for x, _, _ in got], pa.binary()), pa.array([x.astype("<i8").tobytes() for _, x, _ in got], pa.binary()), pa.array([x for _, _, x in got], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["own", "length", "label"])

    rows = keep(whole.select("_text", "_label").mapInArrow(run, "own binary, length binary, label int"), "crf-lines")
    try:
        return fitted(lambda make: summed(rows, make))
    finally:
        forget(rows)


def summed(rows: DataFrame, make: Callable[[Block], list[int]]) -> list[int]:
    """Sums of what ``make`` gives for each block of the rows; each task sends one list of sums."""

    def values(a: pa.Array, kind: str) -> np.ndarray:
        a = a.cast(pa.large_binary())
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind)

    def run(batches):
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            own, length = values(b.column(0), "<f4").reshape(-1, len(FEATURES)), values(b.column(1), "<i8")
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            for one in blocks(own, length, sizes, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)):
                got = make(one)
                out = got if out is None else [p + q for p, q in zip(out, got, strict=True)]
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, out))])], names=["sums"])

    parts = [map(int, r.sums.split()) for r in rows.mapInArrow(run, "sums string").collect()]
    return [sum(c) for c in zip(*parts, strict=True)]


def score(docs: DataFrame, field: LineField, text: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds score and predicted.

    A null text counts as empty; texts without a word get the fit's share of good ones.
    Rows are scored one by one, from all lines of a text, so repeated rows get equal
    scores; a very long text is scored alone.  An empty table gives an empty one.  Columns
    called score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def measure(texts: pa.Array) -> dict:
        s = np.concatenate([shared.value.score(t) for _, _, t in slices(texts)]) if len(texts) else np.zeros(0)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return add_columns(docs, text, "score double, predicted int", measure, carry)
