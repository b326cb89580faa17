"""Top-k retrieval in one pass: texts are scored where they are read.

The queries of a turn are sent to the tasks, a stated bound of them at a time.  A task
counts only the wanted terms of a text, scores it against all queries of the turn, and
sends on its best k rows of each query; nothing of the size of texts x queries, and no
inverted index, is shuffled.  BM25 reads the texts twice: the first pass gives the number
of texts, their mean length and each wanted term's document frequency.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.slices import slices
from ..functions.text import TOKEN

K1, B = 1.5, 0.75
#: Distinct terms, and vector numbers, of the queries of one turn.
TURN_TERMS, TURN_NUMBERS = 200_000, 2_000_000
#: Scores that are held at once, and bytes of text whose terms are.
CELLS, TEXT_BYTES = 1_000_000, 1 << 18

Tokenizer = Callable[[str], list[str]]
_TOKEN = re.compile(TOKEN)


def words(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _turns(queries: DataFrame, size: Callable[[object], int], most: int) -> Iterator[list]:
    """(id, query) rows of a turn after the other; a turn ends where its sizes reach the bound."""
    held, total = [], 0
    for row in queries.toLocalIterator():
        held.append((row[0], row[1]))
        total += size(row[1])
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def best(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """by, key, score, rank of the k best rows of each query, ties by key."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, key, "score", "rank")


class _Best:
    """The best k rows of each query that a task has seen."""

    def __init__(self, queries: int, k: int, key: pa.DataType):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.rows = pa.table({"q": pa.array([], pa.int32()), "score": pa.array([], pa.float64()), "key": pa.array([], key)})

    def add(self, scores: np.ndarray, seen: np.ndarray, keys: pa.Array) -> None:
        """scores: queries x rows; seen marks those that count."""
        q, d = np.nonzero(seen & (scores >= self.least[:, None]))
        new = pa.table({"q": pa.array(q.astype(np.int32)), "score": pa.array(scores[q, d]), "key": keys.take(pa.array(d))})
        held = pa.concat_tables([self.rows, new.cast(self.rows.schema)]).sort_by([("q", "ascending"), ("score", "descending"), ("key", "ascending")]).combine_chunks()
        own = held["q"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        last = np.flatnonzero(place == self.k - 1)
        self.least[own[last]] = held["score"].to_numpy()[last]
        self.rows = held.filter(pa.array(place < self.k))

    def batch(self, ids: pa.Array, names: list[str]) -> pa.RecordBatch:
        t = self.rows.combine_chunks()
        one = lambda c: t[c].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(one("q")), one("key"), one("score")], names=names)


class Wanted:
    """The terms of a turn's queries, and for each the queries that hold it."""

    def __init__(self, rows: list, tokenizer: Tokenizer, once: bool):
        counts = [Counter(tokenizer(text or "")) for _, text in rows]
        self.ids = [k for k, _ in rows]
        self.number = {t: n for n, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        pairs = sorted((self.number[t], q, 1 if once else n) for q, c in enumerate(counts) for t, n in c.items())
        self.query = np.array([q for _, q, _ in pairs], np.int64)
        self.times = np.array([n for _, _, n in pairs], float)
        self.start = np.searchsorted([t for t, _, _ in pairs], np.arange(len(self.number) + 1))

    def scores(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
        """queries x docs sums of the weights of (doc, term), each times how often a query has the term."""
        n = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.query[at] * docs + np.repeat(doc, n), weights=np.repeat(weight, n) * self.times[at], minlength=len(self.ids) * docs).reshape(-1, docs)


def _entries(texts: list, wanted: Wanted, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the wanted terms, and the length of each text."""
    doc, term, times, length = [], [], [], []
    for i, text in enumerate(texts):
        found = tokenizer(text or "")
        length.append(len(found))
        for t, n in Counter(found).items():
            if (j := wanted.number.get(t)) is not None:
                doc.append(i)
                term.append(j)
                times.append(n)
    return np.array(doc, np.int64), np.array(term, np.int64), np.array(times, float), np.array(length, float)


def _parts(batches: Iterable[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of TEXT_BYTES of text, so that a worker's entries don't grow with its batches."""
    return (part for b in batches for part in slices(b, *columns, most=TEXT_BYTES))


def _spans(rows: int, queries: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(queries, 1))
    return ((a, min(a + step, rows)) for a in range(0, rows, step))


def _each_turn(queries: DataFrame, size: Callable, most: int, search: Callable[[list], DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    out = None
    for rows in _turns(queries, size, most):
        part = search(rows)
        out = part if out is None else out.unionByName(part)
    return empty() if out is None else out


def _schema(df: DataFrame, queries: DataFrame, key: str, qid: str) -> str:
    return f"`{qid}` {queries.schema[qid].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, score double"


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", qid: str = "item_id", query: str = "text", tokenizer: Tokenizer = words) -> DataFrame:
    """qid, key, score, rank of the k best documents of each query; a term that a query repeats counts as often.

    Statistics cover all of ``docs``.  Documents that share no term with a query aren't
    among its rows (see ``filled``).  Null texts are empty.
    """
    spark, schema, names = docs.sparkSession, _schema(docs, queries, key, qid), [qid, key, "score"]
    id_type, key_type = to_arrow_type(queries.schema[qid].dataType), to_arrow_type(docs.schema[key].dataType)

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Wanted(rows, tokenizer, False))

        def count(batches):
            w = shared.value
            freq, n, total = np.zeros(len(w.number), np.int64), 0, 0
            for b in _parts(batches, 0):
                _, term, _, length = _entries(b.column(0).to_pylist(), w, tokenizer)
                freq += np.bincount(term, minlength=len(freq))
                n, total = n + len(length), total + int(length.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(freq)), [-1, -2])), pa.array(np.append(freq, [n, total]))], names=["term", "n"])

        # at most TURN_TERMS rows and those of one query more
        got = dict(docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        n, total = got.get(-1, 0), got.get(-2, 0)
        freq = np.array([got.get(t, 0) for t in range(len(got) - 2)], float)
        told = spark.sparkContext.broadcast((np.log1p((n - freq + 0.5) / (freq + 0.5)), total / max(n, 1)))

        def score(batches):
            w, (idf, mean) = shared.value, told.value
            top = _Best(len(w.ids), k, key_type)
            for b in _parts(batches, 1):
                texts = b.column(1).to_pylist()
                for a, z in _spans(len(texts), len(w.ids)):
                    doc, term, times, length = _entries(texts[a:z], w, tokenizer)
                    if len(doc):
                        weight = idf[term] * times / (times + K1 * (1 - B + B * length[doc] / mean))
                        scores = w.scores(doc, term, weight, z - a)
                        top.add(np.round(scores, 6), scores > 0, b.column(0).slice(a, z - a))
            yield top.batch(pa.array(w.ids, id_type), names)

        return docs.select(key, text).mapInArrow(score, schema)

    every = _each_turn(queries.select(qid, query), lambda t: len(t or ""), 6 * TURN_TERMS, search, lambda: spark.createDataFrame([], schema))
    return best(every, qid, key, k)


def lexical_top(docs: DataFrame, queries: DataFrame, k: int, title: str, key: str = "doc_id", text: str = "text", qid: str = "item_id", query: str = "text", tokenizer: Tokenizer = words) -> DataFrame:
    """qid, key, score, rank: three for each query term in the title and one for each in the text; rows with a score only."""
    spark, schema, names = docs.sparkSession, _schema(docs, queries, key, qid), [qid, key, "score"]
    id_type, key_type = to_arrow_type(queries.schema[qid].dataType), to_arrow_type(docs.schema[key].dataType)

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Wanted(rows, tokenizer, True))

        def score(batches):
            w = shared.value
            top = _Best(len(w.ids), k, key_type)
            for b in _parts(batches, 1, 2):
                titles, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
                for a, z in _spans(len(texts), len(w.ids)):
                    doc, term, _, _ = _entries(texts[a:z], w, tokenizer)
                    doc3, term3, _, _ = _entries(titles[a:z], w, tokenizer)
                    scores = w.scores(np.concatenate([doc, doc3]), np.concatenate([term, term3]), np.repeat([1.0, 3.0], [len(doc), len(doc3)]), z - a)
                    top.add(scores, scores > 0, b.column(0).slice(a, z - a))
            yield top.batch(pa.array(w.ids, id_type), names)

        return docs.select(key, title, text).mapInArrow(score, schema)

    every = _each_turn(queries.select(qid, query), lambda t: len(t or ""), 6 * TURN_TERMS, search, lambda: spark.createDataFrame([], schema))
    return best(every, qid, key, k)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, key: str, qid: str, vector: str = "embedding", query: str = "query", others: bool = False) -> DataFrame:
    """qid, key, score, rank by the dot product, as one matrix product for a block of vectors and a turn of queries.

    others: a vector doesn't count for the query of its own key.  Vectors are of one
    length; null ones are left out.
    """
    spark, schema, names = vectors.sparkSession, _schema(vectors, queries, key, qid), [qid, key, "score"]
    id_type, key_type = to_arrow_type(queries.schema[qid].dataType), to_arrow_type(vectors.schema[key].dataType)

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([i for i, _ in rows], np.array([v for _, v in rows], np.float64)))

        def score(batches):
            ids, asked = shared.value
            top, own = _Best(len(ids), k, key_type), pa.array(ids, id_type)
            for b in batches:
                for a, z in _spans(b.num_rows, len(ids)):
                    lists = b.column(1).slice(a, z - a)
                    block = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
                    scores, keys = asked @ block.T, b.column(0).slice(a, z - a)
                    seen = np.ones(scores.shape, bool)
                    if others:
                        seen = np.array(ids, dtype=object)[:, None] != np.array(keys.to_pylist(), dtype=object)[None, :]
                    top.add(np.round(scores, 6), seen, keys)
            yield top.batch(own, names)

        return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(score, schema)

    asked = queries.where(F.col(query).isNotNull()).select(qid, query)
    every = _each_turn(asked, len, TURN_NUMBERS, search, lambda: spark.createDataFrame([], schema))
    return best(every, qid, key, k)


def filled(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int, key: str, qid: str) -> DataFrame:
    """The rankings with documents of score 0 up to k rows, the least keys first, as an index over all documents gives them.

    Only the k least keys can be needed, so the queries meet k rows.
    """
    least = docs.select(key).distinct().orderBy(key).limit(k)
    zero = queries.select(qid).distinct().join(F.broadcast(least)).join(ranked.select(qid, key), [qid, key], "left_anti").withColumn("score", F.lit(0.0))
    return best(ranked.select(qid, key, "score").unionByName(zero.select(qid, key, "score")), qid, key, k)
