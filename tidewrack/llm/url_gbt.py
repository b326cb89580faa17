"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

All of it is DataFrame expressions.  The trees are grown level by level from histograms:
one aggregation by node, feature and bin gives the gradient sums, of which the driver
gets a bounded number (nodes x features x bins).  The model is a list of split tables,
applied as one expression of the binned features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import quoted
from .store import keep

#: Labelled URLs that the trees are fitted on, chosen by the hash of the URL.
SAMPLE = 20_000
BINS = 16
TREES = 8
DEPTH = 3
RATE = 0.4
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTED = _SMALL + "0123456789-._/%?=&"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of (verdict, host, path) that fits, and its verdict; nulls if none does."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits.append((((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), h + p, verdict))
    return tuple(F.coalesce(*(F.when(c, F.lit(x[k])) for c, *x in fits)) for k in (0, 1)) if fits else (F.lit(None).cast("string"),) * 2


#: What ``with_features`` adds, each with the prefix ``f_``.  Marks of a form stand before lengths,
#: which are the least specific: of splits with equal gain the first feature counts.
FEATURES = ["host_hyphens", "host_digits", "numeric_host", "digit_ratio", "parameters", "escapes", "path_hyphens", "host_labels", "depth", "entropy", "secure", "longest_label", "host_length", "path_length", "query_length", "length"]


def with_features(df: DataFrame, url: Column) -> DataFrame:
    """Adds the parts u_* and the lexical features f_* of a URL; a null one counts as empty.

    The parts come first and are columns of their own, so that no expression is repeated.
    """
    df = df.withColumn("u_all", F.coalesce(url, F.lit("")))
    df = df.withColumns({"u_rest": _rest(F.col("u_all")), "u_low": F.translate("u_all", _UPPER, _SMALL)})
    df = df.withColumns({"u_host": host_of(F.col("u_all")), "u_path": path_of(F.col("u_all")), "u_query": F.regexp_extract("u_rest", r"\?([^#]*)", 1)})
    url, low, host, path, query = (F.col(c) for c in ("u_all", "u_low", "u_host", "u_path", "u_query"))
    n = F.length(url)

    def count(text: Column, chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    df = df.withColumn("u_counts", F.expr(f"array({', '.join(f"length(u_low) - length(replace(u_low, '{c}', ''))" for c in _COUNTED)})"))
    counts = F.concat("u_counts", F.array(n - F.aggregate("u_counts", F.lit(0), lambda a, x: a + x)))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x / n)).otherwise(0.0))
    digits = "0123456789"
    made = {
        "host_hyphens": count(host, "-"), "host_digits": count(host, digits), "numeric_host": F.when(host.rlike(r"^[0-9.]+$"), 1).otherwise(0), "digit_ratio": count(url, digits) / F.greatest(n, F.lit(1)),
        "parameters": F.when(F.length(query) > 0, count(query, "&;") + 1).otherwise(0), "escapes": count(url, "%"), "path_hyphens": count(path, "-_"), "host_labels": count(host, "."), "depth": count(path, "/"),
        "entropy": F.when(n > 0, bits / n).otherwise(0.0), "secure": F.when(F.startswith(low, F.lit("https")), 1).otherwise(0), "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query), "length": n,
    }
    return df.withColumns({f"f_{k}": made[k].cast("double") for k in FEATURES}).drop("u_counts")


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


@dataclass
class Trees:
    names: list[str]
    cuts: list[list[float]]
    base: float = 0.0
    #: One dict a tree: node -> (feature, bin) or a leaf's value.  Node k has children 2k and 2k+1.
    trees: list[dict] = field(default_factory=list)
    #: suffix, blocked, seen over all labelled URLs, of the suffixes seen LEAST_SEEN times or more.
    suffixes: DataFrame | None = None
    prior: float = 0.5

    def leaf(self, tree: dict, node: int = 1) -> str:
        """The value of a tree as SQL over the bins."""
        x = tree[node]
        if not isinstance(x, tuple):
            return f"{float(x)!r}D"
        return f"CASE WHEN _bins[{x[0]}] <= {x[1]} THEN {self.leaf(tree, 2 * node)} ELSE {self.leaf(tree, 2 * node + 1)} END"

    def margin(self) -> Column:
        return F.expr(" + ".join([f"{float(self.base)!r}D", *map(self.leaf, self.trees)]))


#: Suffixes seen less often give the prior, so that no URL's own label is its statistic.
LEAST_SEEN = 50


def _rate(prior: float) -> Column:
    return F.when(F.col("seen") >= LEAST_SEEN, F.col("blocked") / F.col("seen")).otherwise(F.lit(float(prior)))


def _binned(names: list[str], cuts: list[list[float]]) -> Column:
    """For each column, how many of its cuts it lies above."""
    above = [" + ".join(f"int({c} > {float(x)!r}D)" for x in own) or "0" for c, own in zip(names, cuts, strict=True)]
    return F.expr(f"array({', '.join(above)})")


def learn(labelled: DataFrame, url: str = "url", label: str = "label", trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost logistic-loss trees on (url, label), label 1 to block.

    The prior and the suffixes' statistics are counted over all distinct labelled URLs, the
    trees are fitted on at most SAMPLE of them; null labels are left out.  Hosts fall in two
    halves, and a URL's suffix rate in the fit is that of the other half, so no label meets
    itself or its host's others.  Repeated rows count once, and a URL with both labels once
    with each, so that its own evidence cancels; of splits with equal gain the first feature
    and bin counts.  With no rows or one label only, the model gives the prior.  Other columns
    aren't read.
    """
    known = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(label).cast("int").alias("y")).distinct()
    host = host_of(F.col("url"))
    known = keep(known.withColumns({"suffix": suffix_of(host), "half": F.crc32(host.cast("binary")) % 2}), "url-labelled")
    n, prior = known.agg(F.count("*"), F.avg("y")).first()
    prior = 0.5 if prior is None else prior
    halves = known.groupBy("suffix").agg(F.sum("y").alias("blocked"), F.count("*").alias("seen"), *(F.sum(F.when(F.col("half") == h, x).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c, x in (("blocked", F.col("y")), ("seen", F.lit(1)))))
    stats = keep(halves.where(F.col("seen") >= LEAST_SEEN), "url-suffixes")
    names = [*FEATURES, "suffix_rate"]
    model = Trees(names, [[] for _ in names], suffixes=stats.select("suffix", "blocked", "seen"), prior=prior)
    model.base = math.log((prior + 1e-3) / (1 - prior + 1e-3))
    if not n or prior in (0.0, 1.0):
        return model
    own = known.orderBy(F.xxhash64("url"), "url", "y").limit(SAMPLE).join(stats, "suffix", "left")
    other = lambda c: F.when(F.col("half") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    own = own.withColumns({"blocked": other("blocked"), "seen": other("seen")})
    # written, so that the plans of the many small jobs below begin at a short scan
    wide = keep(with_features(own, F.col("url")).select("y", *(F.col(f"f_{k}").alias(k) for k in FEATURES), _rate(prior).alias("suffix_rate")), "url-features")
    points = [(k + 1) / BINS for k in range(BINS - 1)]
    found = wide.agg(*(F.percentile_approx(c, points, 1000).alias(c) for c in names)).first()
    model.cuts = [sorted(set(found[c] or [])) for c in names]
    binned = wide.select("y", _binned(names, model.cuts).alias("_bins"))
    # equal rows of the bounded sample are one from here on
    rows = keep(binned.groupBy("_bins").agg(F.sum("y").alias("y"), F.count("*").alias("n")).withColumn("m", F.lit(float(model.base))).coalesce(1), "url-bins")
    used = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("m")))
        at = rows.select("_bins", (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        tree: dict = {}
        for level in range(depth):
            if level and not any(isinstance(tree.get(k), tuple) for k in range(2 ** (level - 1), 2**level)):
                break
            # the node of a row follows from the splits made so far
            node = F.lit(1)
            for k in range(level):
                node = _descend(node, tree, k)
            sums = at.withColumn("node", node).select("node", "g", "h", F.posexplode("_bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for k in {r.node for r in sums if r.node > 0}:
                split = _best([(r.feature, r.bin, r.g, r.h) for r in sums if r.node == k], len(names))
                left, right, feature, cut = split
                if feature is None:
                    tree[k] = left
                else:
                    tree[k] = (feature, cut)
                    tree[2 * k], tree[2 * k + 1] = left, right
        model.trees.append(tree)
        # the margin is a column, so the expression of a tree is evaluated once
        rows = rows.withColumn("m", F.col("m") + F.expr(model.leaf(tree))).persist()
        used.append(rows)
    for x in used:
        x.unpersist()
    return model


def _descend(node: Column, tree: dict, level: int) -> Column:
    out = F.lit(-1)
    for k in range(2**level, 2 ** (level + 1)):
        if isinstance(tree.get(k), tuple):
            f, b = tree[k]
            out = F.when(node == k, F.when(F.col("_bins")[f] <= b, 2 * k).otherwise(2 * k + 1)).otherwise(out)
    return out


def _best(sums: list[tuple[int, int, float, float]], n: int, penalty: float = 1.0, least: float = 1.0):
    """(value left, value right, feature, bin) of the split with the most gain, or a leaf's value and Nones."""
    total_g = sum(g for f, _, g, _ in sums if f == 0)
    total_h = sum(h for f, _, _, h in sums if f == 0)
    value = lambda g, h: RATE * g / (h + penalty)
    best = (1e-6, None)
    for f in range(n):
        g = h = 0.0
        for _, b, dg, dh in sorted(x for x in sums if x[0] == f):
            g, h = g + dg, h + dh
            if min(h, total_h - h) < least:
                continue
            gain = g * g / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - total_g**2 / (total_h + penalty)
            if gain > best[0] * (1 + 1e-9):  # sums of equal parts differ in their last digits
                best = (gain, (value(g, h), value(total_g - g, total_h - h), f, b))
    return best[1] or (value(total_g, total_h), None, None, None)


def judge(df: DataFrame, model: Trees, rules: list[tuple[str, str, str]], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_score and verdict; clashing columns are replaced.

    A null URL has an empty host and path, fits no rule and is judged as an empty text.
    Repeated rows get equal verdicts, URLs of any length are read whole, and an empty table
    gives an empty one.  The columns of the work in between begin with f_, u_ or an
    underscore; columns of ``df`` with such names are kept apart and come back unchanged.
    """
    new = ["host", "path", "rule", "block_score", "verdict"]
    kept = [c for c in df.columns if c not in new]
    # positional names keep the work's own columns from clashing with those of df
    inner = {c: f"in_{k}" for k, c in enumerate(kept)}
    source = df.select(*(quoted(c).alias(inner[c]) for c in kept), quoted(url).alias("in_url"))
    out = with_features(source, F.col("in_url"))
    rule, said = rule_of(F.col("u_host"), F.col("u_path"), rules)
    stats = model.suffixes.select(F.col("suffix").alias("u_match"), "blocked", "seen")
    out = out.withColumns({"u_suffix": suffix_of(F.col("u_host")), "u_rule": rule, "u_said": said}).join(stats, F.col("u_suffix") == F.col("u_match"), "left")
    out = out.withColumn("u_rate", _rate(model.prior)).withColumn("_bins", _binned([*(f"f_{c}" for c in FEATURES), "u_rate"], model.cuts))
    out = out.withColumn("u_score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.coalesce(F.col("u_said"), F.when(F.col("u_score") >= threshold, "block").otherwise("allow"))
    return out.select(*(F.col(inner[c]).alias(c) for c in kept), F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_rule").alias("rule"), F.col("u_score").alias("block_score"), verdict.alias("verdict"))
