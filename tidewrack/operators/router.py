"""Linear classifier over character n-grams: TF-IDF scaled to length one, weights by class.

The model is three small tables.  A text's n-grams are counted and weighed where the text
is read, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import slices
from . import term_counts

#: Lengths of the n-grams.
SHORTEST, LONGEST = term_counts.SHORTEST, term_counts.LONGEST


#: Words whose n-grams a worker remembers, some 25 MB of them, and the longest of these; a longer one is cut each time.
WORDS, WORD_CHARS = 1 << 14, 32


def _cut(word: str) -> tuple[str, ...]:
    p = f" {word} "
    return tuple(p[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(p) - n + 1))


_remembered = lru_cache(maxsize=WORDS)(_cut)


def word_ngrams(word: str) -> tuple[str, ...]:
    """The n-grams of a padded word; lengths beyond the padded word's own have none."""
    return _remembered(word) if len(word) <= WORD_CHARS else _cut(word)


def words(text: str | None) -> Iterable[tuple[str, int]]:
    """Each different word of a text, and how often it stands there."""
    return Counter((text or "").lower().split()).items()


def ngrams(text: str | None) -> Iterator[tuple[tuple[str, ...], int]]:
    """N-grams of each different word, and how often the word stands there."""
    return ((word_ngrams(w), n) for w, n in words(text))


def ngram_profile(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ngrams, distinct_ngrams of each row, without a shuffle; texts without a word have none and go."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            total, distinct = [], []
            for t in b.column(1).to_pylist():
                found = list(ngrams(t))
                total.append(sum(len(g) * n for g, n in found))
                distinct.append(len(set().union(*(g for g, _ in found))) if found else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(distinct, pa.int64())], names=[key, "ngrams", "distinct_ngrams"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ngrams long, distinct_ngrams long").where("ngrams > 0")


@dataclass(frozen=True)
class Model:
    """terms and their idf, classes, weights (classes x terms) and biases."""

    terms: dict[str, int]
    idf: np.ndarray
    classes: list[int]
    weight: np.ndarray
    bias: np.ndarray


#: Most terms and weights of a model; it is held by each task.
MOST_TERMS, MOST_WEIGHTS = 2_000_000, 20_000_000


def model_of(vocabulary: DataFrame, weights: DataFrame, intercepts: DataFrame) -> Model:
    """The model of tables (term, idf), (term, class, weight), (class, bias); raises where they don't fit together.

    Terms and classes must each be there once, each term needs a number and a weight for
    each class, and there must be a class.
    """
    size = vocabulary.agg(F.count("*").alias("n"), F.count_distinct("term").alias("d"), F.count("idf").alias("idf")).first()
    if size.n > MOST_TERMS:
        raise ValueError(f"{size.n} terms; a model has at most {MOST_TERMS}")
    if size.d != size.n:
        raise ValueError("terms are null or there twice")
    if size.idf != size.n:
        raise ValueError("a term has no idf")
    biases = sorted((r[0], r[1]) for r in intercepts.select("class", "bias").collect())
    classes = [c for c, _ in biases]
    if not classes or len(set(classes)) != len(classes):
        raise ValueError("there must be classes, each once")
    if size.n * len(classes) > MOST_WEIGHTS:
        raise ValueError(f"{size.n} terms by {len(classes)} classes; a model has at most {MOST_WEIGHTS} weights")
    # all that could be wrong is counted before a row leaves the tasks
    fits = weights.join(vocabulary.select("term"), "term").where(F.col("class").isin(classes) & F.col("weight").isNotNull())
    told, good = weights.count(), fits.agg(F.count("*").alias("n"), F.count_distinct("term", "class").alias("d")).first()
    if not told == good.n == good.d == size.n * len(classes):
        raise ValueError("weights must be there once for each term and class")
    terms = sorted((r[0], r[1]) for r in vocabulary.select("term", "idf").collect())
    number, place = {t: k for k, (t, _) in enumerate(terms)}, {c: k for k, c in enumerate(classes)}
    rows = weights.select("term", "class", "weight").collect()
    weight = np.zeros((len(classes), len(terms)))
    for t, c, w in rows:
        weight[place[c], number[t]] = w
    return Model(number, np.array([x for _, x in terms], float), classes, weight, np.array([b for _, b in biases], float))


def _scored(df: DataFrame, model: Model, key: str, text: str, give: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]], names: list[str]) -> DataFrame:
    """What ``give`` makes of slices of rows and their scores (rows x classes); names are those of key, class and score."""
    shared = df.sparkSession.sparkContext.broadcast((model, term_counts.Terms(list(model.terms))))

    def run(batches):
        m, terms = shared.value
        for part in (s for whole in batches for s in slices(whole, 1)):
            of, term, times = terms.counts(part.column(1).to_pylist())
            value = times * m.idf[term]
            norm = np.sqrt(np.bincount(of, value * value, part.num_rows))
            norm[norm == 0] = 1  # without a known n-gram a row's products are 0
            made = np.stack([np.bincount(of, value * w[term], part.num_rows) / norm for w in m.weight], 1)
            made = np.round(m.bias + made, 6)
            yield pa.RecordBatch.from_arrays(give(part, made), names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{names[0]}` {kind}, class int, score double")


def scores(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """key, class, score of each row and class."""

    def give(part, made):
        at = pa.array(np.repeat(np.arange(part.num_rows), len(model.classes)))
        return [part.column(0).take(at), pa.array(np.tile(model.classes, part.num_rows), pa.int32()), pa.array(made.ravel())]

    return _scored(df, model, key, text, give, [key, "class", "score"])


def decide(df: DataFrame, vocabulary: DataFrame, weights: DataFrame, intercepts: DataFrame, key: str, text: str) -> DataFrame:
    """key, class, score: the best class of each row, the first of equals.

    Rows without a known n-gram get the intercepts alone.  Rows of one key are one.
    """
    model = model_of(vocabulary, weights, intercepts)

    def give(part, made):
        at = made.argmax(1)  # classes are in order
        return [part.column(0), pa.array(np.array(model.classes)[at], pa.int32()), pa.array(made[np.arange(len(at)), at])]

    every = _scored(df, model, key, text, give, [key, "class", "score"])
    return every.groupBy(key).agg(F.max(F.struct("score", -F.col("class"))).alias("m")).select(key, (-F.col("m.col2")).alias("class"), F.col("m.score").alias("score"))


PARTS = ("vocabulary", "weights", "intercepts")


def save(folder: str, vocabulary: DataFrame, weights: DataFrame, intercepts: DataFrame) -> None:
    """Write a model's tables, after they were found to fit together."""
    model_of(vocabulary, weights, intercepts)
    for name, df in zip(PARTS, (vocabulary, weights, intercepts), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The tables of the first folder that holds a whole model; None without one, and questions then go unrouted."""
    for folder in folders:
        try:
            parts = tuple(spark.read.parquet(f"{folder}/{name}") for name in PARTS)
            model_of(*parts)
            return parts
        except Exception:  # noqa: BLE001 - a model that is missing or broken is one that isn't there
            continue
    return None
