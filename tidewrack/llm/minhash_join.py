"""N-gram Jaccard join by MinHash banding.

Texts are sets of five-word shingles.  Band and row counts are chosen for a target
recall at the similarity threshold.  Equal texts are one class from the start, so that
copies are never paired.  Classes meet by shuffling on their band hashes; a bucket is
cut into cells of bounded size, in which the classes' sketches are compared by blocks and
only the local components go on.  The components of these are the candidate groups; each
sends its full shingle sets once, again in bounded cells, and every pair in them is
verified exactly.  Links are counted where they are found, never written out as pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SPACE_WORDS, Texts, column, mix, slices, windows
from .components import apart, connect
from .store import keep

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Most classes of a bucket in one cell of the sketch comparison.
CELL = 1024
#: Most shingles of a group in one half of a verifying cell.
CELL_SHINGLES = 400_000
#: Rows of a cell's matrices that are worked on at once.
STRIP = 256
#: Bits of the filter that keeps the sets of texts without a candidate from being shuffled;
#: what passes it by chance finds no partner in the join.
FILTER_BITS = 1 << 22
#: Sketches that agree less than this belong to pairs far below the threshold.
SKETCH_LEAST = 0.5


def banding(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): the fewest bands of that many rows with the target recall at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def shingles(t: Texts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the row of each.

    Words are runs without ASCII white space.  A text of fewer than k words but some has
    one shingle, all its words; a text without words has none.
    """
    starts, ends, rows = t.words(SPACE_WORDS)
    h = t.hashes(starts, ends)
    s, at = windows(h, rows, k)
    of = rows[at]
    n = np.bincount(rows, minlength=t.n)
    first = np.cumsum(n) - n
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            whole[has] = mix(whole[has] * np.uint64(31) + h[first[few[has]] + j])
        s, of = np.concatenate([s, whole]), np.concatenate([of, few])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[fresh], of[fresh]


def signatures(s: np.ndarray, of: np.ndarray, n: int, hashes: int) -> np.ndarray:
    """MinHash values, n x hashes, of sets given as shingles and their rows."""
    out = np.full((n, hashes), 0xFFFFFFFF, np.uint32)
    if not len(s):
        return out
    factors = np.random.default_rng(5).integers(1, 2**63, (hashes, 2), dtype=np.uint64) | np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rows = of[starts]
    low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    for k in range(hashes):
        a, c = np.uint32(factors[k, 0] & np.uint64(0xFFFFFFFF)), np.uint32(factors[k, 1] >> np.uint64(32))
        v = low * a
        v ^= c
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[rows, k] = np.minimum.reduceat(v, starts)
    return out


def pairs_within(sizes: np.ndarray, limit: int):
    """Index pairs i < j within consecutive groups, in runs of about ``limit`` pairs."""
    at = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > 64):
        n = int(sizes[g])
        step = max(1, limit // n)
        for a in range(0, n, step):
            i = np.repeat(np.arange(a, min(a + step, n)), n)
            j = np.tile(np.arange(n), min(a + step, n) - a)
            yield at[g] + i[i < j], at[g] + j[i < j]
    few = np.flatnonzero((sizes > 1) & (sizes <= 64))
    for n in np.unique(sizes[few]).tolist():
        i, j = np.triu_indices(n, 1)
        groups = at[few[sizes[few] == n]]
        step = max(1, limit // len(i))
        for a in range(0, len(groups), step):
            own = groups[a : a + step, None]
            yield (own + i).ravel(), (own + j).ravel()


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items is linked to, directly or not."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def grouped(batches, key: str):
    """Batches cut at the ends of sorted groups: the last group waits for its rest."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        last = k[len(k) - 1].as_py()
        if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() == last:
            held.append(b)
            continue
        values = np.asarray(k)
        cut = int(np.flatnonzero(values != last)[-1]) + 1 if (values != last).any() else 0
        if held or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cells(key: str, blocks: str) -> list:
    """Columns (cell, side): a member of block x goes to the cells {x, y} of every block y."""
    low = F.least(F.col("_block"), F.col("_other"))
    high = F.greatest(F.col("_block"), F.col("_other"))
    return [F.xxhash64(key, low, high).alias("cell"), F.when(low == high, 0).when(F.col("_block") == low, 1).otherwise(2).cast("int").alias("side")]


def in_cells(df: DataFrame, key: str, node: str, blocks: str) -> DataFrame:
    """Adds _block, _other, one row for each cell of a member."""
    return df.withColumn("_block", F.pmod(F.xxhash64(node, F.lit(17)), F.col(blocks))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition("cell").sortWithinPartitions("cell")


def group(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """key, digest, class_id, n_links of each row, rep (the least key of its text) and root.

    Two rows are linked if their shingle sets have the given Jaccard similarity; equal
    texts are.  class_id is the least key of the rows that links connect; n_links counts
    the other rows linked to a row.  A null text counts as empty; texts without words
    are linked to equal ones only.  Repeated rows count as rows.  An empty table gives an
    empty one.  Other columns take no part.  Null keys come last, so
    a class of them only has a null id.  Keys that stand for several texts can give several
    classes one id; root, a digest, is each class's own.
    """
    bands, rows = banding(similarity, recall)
    kind = df.schema[key].dataType.simpleString()
    hashes = bands * rows

    def sign(batches):
        for b in batches:
            for i, j, t in slices(column(b, text)):
                s, of = shingles(t)
                n = np.bincount(of, minlength=t.n)
                sig = signatures(s, of, t.n, hashes)
                raw = np.ascontiguousarray(sig).view(np.uint64)
                mixed = np.zeros((t.n, bands), np.uint64)
                for k in range(rows // 2):
                    mixed = mix(mixed + raw[:, k :: rows // 2])
                mixed = mix(mixed + np.arange(bands, dtype=np.uint64))
                off = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(off)).astype(np.int32)), pa.array(mixed[n > 0].ravel().view(np.int64)))
                sketch = pa.array([x.tobytes() for x in (sig & np.uint32(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n), lists, sketch], names=[key, "digest", "n_shingles", "bands", "sketch"])

    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest")
    signed = keep(df.select(key, text, digest).mapInArrow(sign, f"`{key}` {kind}, digest binary, n_shingles long, bands array<long>, sketch binary"), "minhash")
    reps = signed.groupBy("digest").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    one = signed.dropDuplicates(["digest"]).select("digest", "n_shingles", "bands", "sketch")

    # buckets with two classes or more, and the number of cells of each
    entries = one.select("digest", F.explode("bands").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    met = entries.join(full, "bucket").join(one.select("digest", "sketch"), "digest")
    sent = in_cells(met, "bucket", "digest", "blocks").select(*cells("bucket", "blocks"), "digest", "sketch")

    def compare(batches):
        for b in grouped(batches, "cell"):
            at = np.asarray(b["cell"])
            side = np.asarray(b["side"])
            sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(at)))
            sk = np.frombuffer(b"".join(b["sketch"].to_pylist()), np.uint8).reshape(-1, hashes)
            left, right = [], []
            for i, j in pairs_within(sizes, 200_000):
                ok = (side[i] == 0) | (side[i] != side[j])
                i, j = i[ok], j[ok]
                same = np.count_nonzero(sk[i] == sk[j], axis=1) >= SKETCH_LEAST * hashes
                left.append(i[same])
                right.append(j[same])
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                root = local_roots(len(at), i, j)
                linked = np.flatnonzero(root != np.arange(len(at)))
                d = b["digest"]
                yield pa.RecordBatch.from_arrays([d.take(pa.array(x)).combine_chunks() for x in (linked, root[linked])], names=["a", "b"])

    edges = dealt(sent).mapInArrow(compare, "a binary, b binary")
    tight = connect(edges.distinct())

    # the groups' full shingle sets, in cells of bounded size
    member = tight.join(reps, tight.node == reps.digest).join(one.select("digest", "n_shingles"), "digest").select("digest", "rep", "copies", "root", "n_shingles")
    member = keep(member, "minhash-members")
    width = member.groupBy("root").agg(verifying_blocks().alias("blocks"))
    member = member.join(apart(width, "root"), "root").select("digest", F.col("rep").alias("_rep"), "copies", "root", "blocks")
    slot = 1 + F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    seen = marks(member.select(slot.alias("slot")))
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), digest).withColumn("slot", slot)

    def shingle(batches):
        for b in batches:
            b = b.filter(pa.array(seen[np.asarray(b.column(3))]))
            for i, j, t in slices(column(b, "_text")):
                s, of = shingles(t)
                off = np.append(0, np.cumsum(np.bincount(of, minlength=t.n)) * 8)
                raw = s.tobytes()
                sets = pa.array([raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (0, 2)), sets], names=["_key", "_digest", "shingles"])

    sets = texts.select("_key", "_text", "digest", "slot").mapInArrow(shingle, f"_key {kind}, _digest binary, shingles binary")
    sets = sets.join(member.hint("merge"), (F.col("_digest") == F.col("digest")) & F.col("_key").eqNullSafe(F.col("_rep"))).dropDuplicates(["_digest", "_key"])
    sets = in_cells(sets, "root", "digest", "blocks").select(*cells("root", "blocks"), "digest", "copies", "shingles")

    def verify(batches):
        for b in grouped(batches, "cell"):
            at, side, copies = (np.asarray(b[c]) for c in ("cell", "side", "copies"))
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            links, root = np.zeros(len(at), np.int64), np.arange(len(at))
            for a, z in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist(), strict=True):
                if z - a < 2:
                    continue
                own = [np.frombuffer(x.as_py(), np.uint64) for x in b["shingles"].slice(a, z - a)]
                linked = alike(own, side[a:z], similarity)
                links[a:z] = linked @ copies[a:z]
                i, j = np.nonzero(np.triu(linked))
                root[a:z] = a + local_roots(z - a, i, j)
            some = pa.array(np.flatnonzero(links > 0))
            d = b["digest"]
            yield pa.RecordBatch.from_arrays([d.take(some).combine_chunks(), d.take(pa.array(root)).take(some).combine_chunks(), pa.array(links).take(some)], names=["a", "b", "links"])

    links = keep(dealt(sets).mapInArrow(verify, "a binary, b binary, links long"), "minhash-links")
    counted = links.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    classes = connect(links.select("a", "b")).select(F.col("node").alias("digest"), "root")
    named = reps.join(classes, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ids = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(apart(ids, "root"), "root").join(counted, "digest", "left").select("digest", "rep", "root", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select(key, "digest").join(apart(named, "digest"), "digest").select(key, "digest", "class_id", "n_links", "rep", "root")


def verifying_blocks():
    """Blocks of a group, so that a cell is bounded in shingles and, for its square arrays, in sets."""
    return F.ceil(F.greatest(F.sum("n_shingles") / CELL_SHINGLES, F.count("*") / CELL)).cast("int")


def marks(slots: DataFrame) -> np.ndarray:
    """Marks the slots, from 1 on, that occur; a fixed number of bits, gathered as a few partial bitmaps."""
    got = slots.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS + (1 << 16), bool)
    for r in got:
        # bit x of bucket k stands for slot 32768 * (k - 1) + x + 1
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.k - 1) * len(bits) + 1 + np.flatnonzero(bits)] = True
    return out


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets are similar enough to which, exactly, by counting common shingles in blocks."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    ids, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    distinct, col, times = np.unique(ids, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    on = shared[col]
    col, of = number[col[on]], of[on]
    order = np.argsort(col, kind="stable")
    col, of = col[order], of[order]
    common = np.zeros((n, n), np.uint16 if len(sizes) and sizes.max() < 1 << 16 else np.uint32)
    width = 2048
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [c, c + width])
        there = np.unique(of[lo:hi])
        dense = np.zeros((len(there), width), np.float32)
        dense[np.searchsorted(there, of[lo:hi]), col[lo:hi] - c] = 1
        for a in range(0, len(there), STRIP):
            common[np.ix_(there[a : a + STRIP], there)] += (dense[a : a + STRIP] @ dense.T).astype(common.dtype)
    out = np.zeros((n, n), bool)
    for a in range(0, n, STRIP):
        own = slice(a, a + STRIP)
        union = sizes[own, None] + sizes[None, :] - common[own].astype(np.int64)
        out[own] = (common[own] >= similarity * union - 1e-6) & (union > 0) & ((side[own, None] == 0) | (side[own, None] != side[None, :]))
    np.fill_diagonal(out, False)
    return out
