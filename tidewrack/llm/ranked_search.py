"""Ranked lexical search by sorting instead of accumulators.

Texts are read once; each sends on the wanted terms that it holds, with their counts.  From
these rows come the corpus statistics, and then the scores: a task concatenates the (item,
document, impact) triples of its documents, packs item and document into one key, sorts the
keys by radix, and sums the impacts of equal keys.  A heap for each item keeps a task's best
documents; these are dealt by ranges of items, and a last heap selects among them.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow_text import Texts, byte_table, column, quoted, slices
from .store import keep

#: Words are runs of ASCII letters, digits and non-ASCII characters.
WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
K = 10
#: Distinct terms of the items of one turn, and (item, document, impact) triples that are sorted at once.
TURN_TERMS, CELLS = 200_000, 1_000_000
#: Bits of a key that one pass sorts by.
DIGIT = 16


class Wanted:
    """The distinct terms of a turn's items, and for each the items that hold it."""

    def __init__(self, terms: list[list[bytes]]):
        """terms: the distinct terms of each item."""
        self.number = {t: k for k, t in enumerate(sorted({t for own in terms for t in own}))}
        held: list[list[int]] = [[] for _ in self.number]
        for q, own in enumerate(terms):
            for t in own:
                held[self.number[t]].append(q)
        self.start = np.cumsum([0, *map(len, held)])
        self.item = np.array([q for one in held for q in one], np.int64)
        self.items = len(terms)

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms in a row: index in ``term`` and item of each (occurrence, item that holds it)."""
        n = self.start[term + 1] - self.start[term]
        of = np.repeat(np.arange(len(term)), n)
        return of, self.item[np.repeat(self.start[term], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]


def terms_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, end row, rows, codes, terms) of slices: each word's row, and its place in the slice's distinct terms."""
    for i, j, t in slices(texts):
        low = t.lowered()
        starts, ends, rows = low.words(WORDS)
        # without separators the words lie side by side, and Arrow tells equal ones by their bytes
        packed = np.ascontiguousarray(low.data[WORDS[low.data]])
        bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
        told = words.dictionary_encode()
        yield i, j, rows, told.indices.to_numpy(), told.dictionary.to_pylist()


def distinct_terms(text: str | None) -> list[bytes]:
    """The terms of one item, each once."""
    return [t for _, _, _, _, terms in terms_of(pa.array([text or ""], pa.large_string())) for t in terms]


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys below 2**bits; numpy sorts 16-bit digits by radix."""
    order = np.arange(len(keys))
    for low in range(0, bits, DIGIT):
        digit = ((keys[order] >> np.uint64(low)) & np.uint64((1 << DIGIT) - 1)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def summed(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum of impacts), ordered by item and doc, by sorting packed keys."""
    if not len(item):
        return item, doc, impact
    width = max(1, int(docs).bit_length())
    keys = (item.astype(np.uint64) << np.uint64(width)) | doc.astype(np.uint64)
    order = radix_order(keys, width + max(1, int(item.max()).bit_length()))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first]
    return (keys >> np.uint64(width)).astype(np.int64), (keys & np.uint64((1 << width) - 1)).astype(np.int64), np.add.reduceat(impact[order], first)


class Best:
    """A heap of the k best (score, key) of each item; equal scores go by the least key, null keys last."""

    def __init__(self, k: int):
        self.k, self.heaps = k, defaultdict(list)

    def add(self, item: int, score: int, key) -> None:
        # the heap's least entry is the worst one: a lower score, or a later key
        entry = (score, _Later(key))
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif heap[0] < entry:
            heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple[int, int, object, int]]:
        """item, score, key, rank."""
        for item, heap in self.heaps.items():
            for rank, (score, later) in enumerate(sorted(heap, reverse=True), 1):
                yield item, score, later.key, rank


class _Later:
    """Orders keys backwards; null is the last key, so the least here."""

    __slots__ = ("key",)

    def __init__(self, key):
        self.key = key

    def __lt__(self, other: _Later) -> bool:
        if self.key is None or other.key is None:
            return self.key is None and other.key is not None
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def weights(documents: int, freq: np.ndarray) -> np.ndarray:
    """Whole-number weights of terms that so many of the documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in freq.tolist()], np.int64)


def _turns(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(id, distinct terms) of the distinct items, up to TURN_TERMS terms and those of one item more at a time."""
    held, total = [], 0
    for row in items.distinct().toLocalIterator():
        own = distinct_terms(row[1])
        held.append((row[0], own))
        total += len(own)
        if total >= TURN_TERMS:
            yield held
            held, total = [], 0
    if held:
        yield held


def _matches(docs: DataFrame, wanted, key: str, text: str) -> DataFrame:
    """key, n, terms, counts: the wanted terms that a document with a term holds, as packed 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        number = wanted.value.number
        for b in batches:
            for i, j, rows, codes, terms in terms_of(column(b, "text")):
                of = np.fromiter((number.get(t, -1) for t in terms), np.int64, len(terms))
                n = np.bincount(rows, minlength=j - i)
                known = of[codes] >= 0
                found, times = np.unique(rows[known] * np.int64(len(number) + 1) + of[codes[known]], return_counts=True)
                at, term = np.divmod(found, len(number) + 1)
                cuts = np.searchsorted(at, np.arange(j - i + 1))
                own, counts, full = term.astype("<u4"), times.astype("<u4"), np.flatnonzero(n)
                spans = [(int(cuts[r]), int(cuts[r + 1])) for r in full]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(full)), pa.array(n[full]), pa.array([own[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([counts[a:z].tobytes() for a, z in spans], pa.binary())],
                    names=["key", "n", "terms", "counts"],
                )

    return docs.select(quoted(key).alias("key"), quoted(text).alias("text")).mapInArrow(run, f"key {kind}, n long, terms binary, counts binary")


def _statistics(matched: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each wanted term."""

    def run(batches):
        freq, documents, total = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            own = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4")
            freq += np.bincount(own, minlength=terms)
            documents, total = documents + b.num_rows, total + int(np.sum(b.column(0).to_numpy()))
        seen = np.flatnonzero(freq)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(freq[seen], [documents, total]))], names=["term", "n"])

    # at most the terms of one turn come back
    got = dict(matched.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    documents, total = got.pop(-1, 0), got.pop(-2, 0)
    freq = np.zeros(terms, np.int64)
    freq[list(got)] = list(got.values())
    return documents, total, freq


def _blocks(b: pa.RecordBatch, per_term: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with some CELLS triples; a document is never cut."""
    ends = np.cumsum([int(per_term[np.frombuffer(x, "<u4")].sum()) for x in b.column(2).to_pylist()])
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, side="right")))
        yield a, z
        a = z


def _scored(matched: DataFrame, wanted, told, k: int) -> DataFrame:
    """item, score, key of each task's k best documents of each item."""
    kind, key_type = matched.schema["key"].dataType.simpleString(), to_arrow_type(matched.schema["key"].dataType)

    def run(batches):
        w, (weight, documents, total) = wanted.value, told.value
        best, least = Best(k), np.full(w.items, 0, np.int64)
        per_term = np.diff(w.start)
        for b in batches:
            n = b.column(1).to_numpy()
            norm = 8 * (10 + (90 * n * documents) // max(total, 1))
            order_of = np.asarray(pc.rank(b.column(0), "ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
            for a, z in _blocks(b, per_term):
                term = np.frombuffer(b"".join(b.column(2).slice(a, z - a).to_pylist()), "<u4").astype(np.int64)
                times = np.frombuffer(b"".join(b.column(3).slice(a, z - a).to_pylist()), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(z - a), [len(x) // 4 for x in b.column(2).slice(a, z - a).to_pylist()])
                impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + norm[a + doc]))
                of, item = w.pairs(term)
                item, row, score = summed(item, doc[of], impact[of], z - a)
                # of each item, only the block's k best that can enter its heap leave the arrays
                able = np.flatnonzero((score > 0) & (score >= least[item]))
                able = able[np.lexsort((order_of[a + row[able]], -score[able], item[able]))]
                able = able[np.arange(len(able)) - np.searchsorted(item[able], item[able]) < k]
                keys = b.column(0).take(pa.array(a + row[able])).to_pylist()
                for q, s, key in zip(item[able].tolist(), score[able].tolist(), keys, strict=True):
                    best.add(q, s, key)
                    if len(best.heaps[q]) == k:
                        least[q] = best.heaps[q][0][0]
        found = list(best.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], key_type)], names=["item", "score", "key"])

    return matched.mapInArrow(run, f"item int, score long, key {kind}")


def _selected(best: DataFrame, k: int) -> DataFrame:
    """item, score, key, rank: the k best of each item, whose rows a range of items brings together."""
    key_type = to_arrow_type(best.schema["key"].dataType)

    def run(batches):
        held = Best(k)
        for b in batches:
            for q, s, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.add(q, s, key)
        found = list(held.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], key_type), pa.array([r[3] for r in found], pa.int32())], names=["item", "score", "key", "rank"])

    kind = best.schema["key"].dataType.simpleString()
    return best.repartitionByRange("item").mapInArrow(run, f"item int, score long, key {kind}, rank int")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """item, rank, key, score of the k best documents of each item with a score above 0.

    All documents are ranked, by whole texts of any length; statistics cover all of them.  A
    null text has no terms.  Equal scores go by ascending key, a null key last; repeated rows
    of ``docs`` are documents of their own, each with its rank.  Repeated rows of ``items`` are
    one item; different texts under one id, null among them, are ranked each by itself.
    Empty tables give no rows.  Other columns of the tables are ignored.
    """
    spark, out = docs.sparkSession, None
    kinds = {c: f.schema[n].dataType.simpleString() for c, f, n in (("item", items, item), ("key", docs, key))}
    for rows in _turns(items.select(quoted(item), quoted(query))):
        turn = Wanted([terms for _, terms in rows])
        wanted = spark.sparkContext.broadcast(turn)  # bounded by TURN_TERMS
        matched = keep(_matches(docs, wanted, key, text), "ranked-matches")
        documents, total, freq = _statistics(matched, len(turn.number))
        told = spark.sparkContext.broadcast((weights(documents, freq), documents, total))
        best = keep(_scored(matched, wanted, told, k), "ranked-best")
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(rows)], f"item int, id {kinds['item']}")
        part = _selected(best, k).join(names, "item").select(F.col("id").alias(item), "rank", F.col("key").alias(key), "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"`{item}` {kinds['item']}, rank int, `{key}` {kinds['key']}, score long") if out is None else out
