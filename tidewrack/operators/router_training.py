"""Fits the router: terms by document frequency, then multinomial logistic regression.

Terms are chosen by one count over all labelled texts, and weights are fitted on all of
them: their features are made once, and each step of the fit (L-BFGS) is a sum of gradients
that tasks make of their rows.  What it gives becomes the three tables that ``router``
saves, checks and loads.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import slices
from ..sources.jsonl import read_questions
from . import router, term_counts

#: Terms of a model, least documents of a term, and most classes.
TERMS, LEAST, MOST_CLASSES = 20_000, 2, 100
#: Terms that a task counts before it passes them on.
MOST_HELD = 300_000
#: Cells of features that are worked on at once, the share of them from which a block holds all, and blocks that a task gets at once.
CELLS, FULL, BLOCKS = 1 << 18, 0.02, 4
#: Steps that L-BFGS remembers, and the share of the loss below which a step is the last one.
STEPS, ENOUGH = 10, 1e-6


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """term, documents: how many rows hold each n-gram.

    A task counts slices of bounded text, and passes on its counts once there are MOST_HELD
    terms, or a slice more; only these sums are shuffled.
    """

    def run(batches):
        held: dict[str, int] = {}

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "documents"])

        for part in (s for b in batches for s in slices(b, 0)):
            for terms, counts in term_counts.frequencies(part.column(0).to_pylist()):
                for t, n in zip(terms, counts, strict=True):
                    held[t] = held.get(t, 0) + n
            if len(held) >= MOST_HELD:
                yield told()
                held = {}
        yield told()

    return df.select(text).mapInArrow(run, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))


def vocabulary(df: DataFrame, text: str = "text", terms: int = TERMS, least: int = LEAST) -> DataFrame:
    """term, documents, idf of the n-grams that most rows' texts hold, the first of equals by name."""
    n = df.agg(F.count("*").alias("n"))
    counted = document_frequencies(df, text).where(F.col("documents") >= least)
    best = counted.orderBy(F.col("documents").desc(), "term").limit(terms)
    idf = F.ln((1 + F.col("n")) / (1 + F.col("documents"))) + 1
    return best.join(F.broadcast(n)).select("term", "documents", idf.alias("idf"))  # one number


def sampled(known: DataFrame, most: int) -> DataFrame:
    """``most`` rows of (text, class) at most, by the order of their texts' hashes, then of texts and classes.

    For callers that want fewer rows; ``train`` fits on all that it is given.  Only hashes are brought together to find the last one; the texts stay in their tasks.
    """
    hashed = known.withColumn("_hash", F.xxhash64("text"))
    first = hashed.select("_hash").orderBy("_hash").limit(most).agg(F.count("*").alias("n"), F.max("_hash").alias("last")).first()
    if first.n < most or not most:
        return known if most else known.limit(0)
    at = F.col("_hash")
    left = most - hashed.where(at < first["last"]).count()
    tied = hashed.where(at == first["last"]).orderBy("text", "class").limit(left)  # one text, or texts of one hash
    return hashed.where(at < first["last"]).unionByName(tied).drop("_hash")


def features(known: DataFrame, names: list[str], idf: np.ndarray, classes: list[int]) -> DataFrame:
    """Blocks of (text, class) rows: their classes by number, their scales, and how often they have the terms.

    A feature is a count times its term's idf and its row's scale, which makes rows of length
    one.  Where many features are there, width is a count's bytes, and counts are rows x terms,
    packed; else width is 0, and entries, terms and counts say which they are.
    """
    shared, number = known.sparkSession.sparkContext.broadcast((term_counts.Terms(names), idf)), {c: k for k, c in enumerate(classes)}

    def run(batches):
        terms, weigh = shared.value
        for part in (s for b in batches for s in slices(b, 0)):
            of, term, times = terms.counts(part.column(0).to_pylist())
            n, kind = part.num_rows, np.min_scalar_type(int(times.max(initial=0)))
            norm = np.sqrt(np.bincount(of, (times * weigh[term]) ** 2, n))
            scale = np.divide(1.0, norm, out=np.zeros(n), where=norm > 0)
            label, width, entries = np.array([number[c] for c in part.column(1).to_pylist()], np.int32), 0, b""
            if len(times) >= FULL * n * len(weigh):
                x = np.zeros((n, len(weigh)), kind)
                x[of, term] = times
                width, own, counts = kind.itemsize, b"", pa.compress(x.tobytes(), codec="lz4", asbytes=True)
            else:
                entries, own, counts = np.bincount(of, minlength=n).astype(np.int64).tobytes(), term.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *(pa.array([x], pa.binary()) for x in (label.tobytes(), scale.tobytes(), entries, own, counts))], names=_BLOCK)

    return known.select("text", "class").mapInArrow(run, "width int, label binary, scale binary, entries binary, term binary, counts binary")


_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BLOCK = ["width", "label", "scale", "entries", "term", "counts"]


def slopes(batch: pa.RecordBatch, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """For each class the gradient of the loss by its terms' features (without idf) and bias, the loss of its rows, and their number."""
    k, terms = weight.shape
    out, few = np.zeros((k, terms + 3)), weight.T.astype(np.float32)

    def left(z: np.ndarray, label: np.ndarray) -> np.ndarray:
        """What the classes' shares miss, of rows of scores; adds up all but the terms' slopes."""
        rows = np.arange(len(label))
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1)
        p /= total[:, None]
        out[:, terms + 1] += np.bincount(label, np.log(total) - z[rows, label], k)
        out[:, terms + 2] += np.bincount(label, minlength=k)
        p[rows, label] -= 1
        out[:, terms] += p.sum(0)
        return p

    for width, *raw in zip(*(batch.column(c).to_pylist() for c in range(len(_BLOCK))), strict=True):
        label, scale = np.frombuffer(raw[0], np.int32), np.frombuffer(raw[1])
        n = len(label)
        if width:
            whole = np.frombuffer(pa.decompress(raw[4], n * terms * width, codec="lz4", asbytes=True), f"u{width}").reshape(n, terms)
            for a in range(0, n, step := max(1, CELLS // terms)):
                x, size = whole[a : a + step].astype(np.float32), scale[a : a + step, None]
                p = left((x @ few) * size + bias, label[a : a + step])
                out[:, :terms] += (p * size).T.astype(np.float32) @ x
        else:
            of, (term, times) = np.repeat(np.arange(n), np.frombuffer(raw[2], np.int64)), (np.frombuffer(x, np.int32) for x in raw[3:])
            value = times * scale[of]
            p = left(np.stack([np.bincount(of, value * w[term], n) for w in weight], 1) + bias, label)
            for c in range(k):
                out[c, :terms] += np.bincount(term, value * p[of, c], terms)
    return out


def _summed(made: DataFrame, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The slopes of all blocks; a class's sums are added up by one task, in the order of the tasks that made them."""
    shared = made.sparkSession.sparkContext.broadcast((weight, bias))

    def run(batches):
        out = np.zeros((len(weight), weight.shape[1] + 3))
        for b in batches:
            out += slopes(b, *shared.value)
        part = pa.array(np.full(len(out), TaskContext.get().partitionId()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), part, pa.array(list(out), pa.list_(pa.float64()))], names=["k", "part", "sums"])

    def add(table):
        rows = table.sort_by("part")
        total = rows["sums"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(0)
        return pa.table({"k": rows["k"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    each = made.mapInArrow(run, "k int, part int, sums array<double>").groupBy("k").applyInArrow(add, "k int, sums array<double>")
    got = each.toArrow().sort_by("k")  # a row of each class
    shared.destroy()
    return got["sums"].combine_chunks().flatten().to_numpy().reshape(len(weight), -1)


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS from x on; f gives a convex function's value and slope.  It ends after so many steps, or once a step gains next to nothing."""
    value, slope = f(x)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, gains = slope.copy(), []
        for s, y in reversed(held):
            gains.append(s @ way / (s @ y))
            way -= gains[-1] * y
        way *= held[-1][0] @ held[-1][1] / (held[-1][1] @ held[-1][1]) if held else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, y), gain in zip(held, reversed(gains), strict=True):
            way += s * (gain - y @ way / (s @ y))
        down, size = slope @ way, 1.0
        while (new := f(x - size * way))[0] > value - 1e-4 * size * down:
            size /= 4
            if size < 1e-6:
                return x
        step, turn, gained = -size * way, new[1] - slope, value - new[0]
        x, value, slope = x + step, *new
        if step @ turn > 1e-12 * (turn @ turn):
            held = [*held, (step, turn)][-STEPS:]
        if gained <= ENOUGH * max(abs(value), 1e-9):
            break
    return x


def fitted(made: DataFrame, idf: np.ndarray, classes: int, penalty: float, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases with the least mean loss of all rows plus half the penalty times the weights' squares.

    Biases aren't penalised; they begin with the classes' shares, and their mean is 0.
    """
    terms = len(idf)
    n = _summed(made, np.zeros((classes, terms)), np.zeros(classes))[:, terms + 2]

    def loss(x):
        w, b = x[: classes * terms].reshape(classes, terms), x[classes * terms :]
        got = _summed(made, w * idf, b)
        slope = np.concatenate([(got[:, :terms] * idf / n.sum() + penalty * w).ravel(), got[:, terms] / n.sum()])
        return got[:, terms + 1].sum() / n.sum() + penalty / 2 * (w * w).sum(), slope

    x = minimum(loss, np.concatenate([np.zeros(classes * terms), np.log(n)]), iterations)
    bias = x[classes * terms :]
    return x[: classes * terms].reshape(classes, terms), bias - bias.mean()


def train(labelled: DataFrame, text: str = "text", label: str = "label", terms: int = TERMS, least: int = LEAST, penalty: float = 1e-4, iterations: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables (term, idf), (term, class, weight), (class, bias) of a model of (text, label).

    Labels are whole numbers; rows with a null label are left out, and a null text is empty.
    Terms are counted over all rows, and weights are fitted on all of them.  Repeated rows
    count as often.  A single class gets a model that always says it; without a labelled row
    there is none, and that is an error.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("class"))
    classes = sorted(r[0] for r in known.select("class").distinct().limit(MOST_CLASSES + 1).collect())
    if not classes or len(classes) > MOST_CLASSES:
        raise ValueError(f"a router needs 1 to {MOST_CLASSES} classes")
    chosen = vocabulary(known, "text", terms, least).orderBy("term").collect()  # at most ``terms`` rows
    names, idf = [r.term for r in chosen], np.array([r.idf for r in chosen])
    weight, bias = np.zeros((len(classes), len(names))), np.zeros(len(classes))
    if len(classes) > 1 and names:
        made, at_once = features(known, names, idf, classes).persist(StorageLevel.DISK_ONLY), spark.conf.get(_AT_ONCE)
        try:
            made.count()  # the blocks are made by as many tasks as read the texts, and summed by a few for each core
            spark.conf.set(_AT_ONCE, BLOCKS)
            weight, bias = fitted(made.coalesce(2 * spark.sparkContext.defaultParallelism), idf, len(classes), penalty, iterations)
        finally:
            spark.conf.set(_AT_ONCE, at_once)
            made.unpersist()
    each = {"term": pa.array([t for t in names for _ in classes], pa.string()), "class": pa.array(classes * len(names), pa.int32()), "weight": pa.array(weight.T.ravel())}
    tables = {"term": pa.array(names, pa.string()), "idf": pa.array(idf, pa.float64())}, each, {"class": pa.array(classes, pa.int32()), "bias": pa.array(bias)}
    return tuple(spark.createDataFrame(pa.table(t)) for t in tables)


def export(labelled: DataFrame, folder: str, text: str = "text", label: str = "label", **settings) -> None:
    """Fit a router and write its tables, after they were found to fit together."""
    router.save(folder, *train(labelled, text, label, **settings))


def classify_batch(spark: SparkSession, questions: str, folder: str, out: str) -> DataFrame:
    """Reads a JSON array of questions, writes question and label as JSON lines in their order, and returns them with their index.

    Without a whole model in the folder the labels are null.
    """
    asked, parts = read_questions(spark, questions), router.load(spark, [folder])
    if parts is None:
        made = asked.withColumn("label", F.lit(None).cast("int"))
    else:
        made = asked.join(router.decide(asked, *parts, "index", "question").select("index", F.col("class").alias("label")), "index", "left")
    made.orderBy("index").select("question", "label").write.mode("overwrite").option("ignoreNullFields", False).json(out)
    return made


def macro_f1(df: DataFrame, label: str, predicted: str) -> float:
    """The mean over the classes among the labels of 2 hits / (labelled + predicted)."""
    one = lambda c: df.groupBy(F.col(c).alias("class")).agg(F.count("*").alias(f"n_{c}"))
    hits = df.where(F.col(label) == F.col(predicted)).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("hits"))
    score = 2 * F.coalesce("hits", F.lit(0)) / (F.col(f"n_{label}") + F.coalesce(f"n_{predicted}", F.lit(0)))
    return one(label).join(one(predicted), "class", "left").join(hits, "class", "left").agg(F.avg(score)).first()[0]
