"""Comparing ways of retrieval over stated questions, and the reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of failure, in the report's order.
FAILURES = ("ok", "data_missing", "retrieval_miss", "generation_issue", "ocr_gap", "ambiguous_question", "classifier_issue", "tool_needed", "evaluation_unclear")
#: The ways compared, and the domain that an id tells, by the first word that it holds.
MODES = ("lexical", "bm25", "dense", "hybrid", "bm25_dense")
DOMAINS = (("dining", "dining"), ("shuttle", "shuttle"), ("calendar", "academic_calendar"), ("graduation", "graduation"), ("notice", "notices"))


def domain_of(id_: Column, rules: Sequence[tuple[str, str]] = DOMAINS) -> Column:
    return F.coalesce(*(F.when(F.contains(id_, F.lit(word)), name) for word, name in rules), F.lit("unknown"))


def hits(ranked: DataFrame, questions: DataFrame, qid: str, domain: Column) -> DataFrame:
    """qid, mode, found, top1, topk of each question (qid, expected) and mode: whether the expected domain leads, and is there.

    ranked: mode, qid, rank, and what ``domain`` needs.  Questions without an expectation
    hit nothing.
    """
    asked = questions.select(qid, F.nullif("expected", F.lit("")).alias("expected"))
    modes = ranked.select("mode").distinct()
    own = ranked.select("mode", qid, "rank", domain.alias("_d")).join(asked, qid)
    same = F.coalesce(F.col("_d") == F.col("expected"), F.lit(False))
    seen = own.groupBy("mode", qid).agg(F.count("*").alias("found"), F.bool_or(same & (F.col("rank") == 1)).alias("top1"), F.bool_or(same).alias("topk"))
    every = asked.join(F.broadcast(modes))  # modes are a handful of names
    no = F.lit(False)
    return every.join(seen, ["mode", qid], "left").select(qid, "expected", "mode", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("top1", no).alias("top1"), F.coalesce("topk", no).alias("topk"))


def by_mode(measured: DataFrame) -> DataFrame:
    """mode, questions, top1, topk."""
    return measured.groupBy("mode").agg(F.count("*").alias("questions"), F.count_if("top1").alias("top1"), F.count_if("topk").alias("topk"))


def failure(found: Column, expected: Column, there: Column) -> Column:
    """Nothing found: data are missing; no expectation: ok; the expected domain isn't there: a miss."""
    return F.when(found == 0, "data_missing").when(expected.isNull() | there, "ok").otherwise("retrieval_miss")


def histogram(spark: SparkSession, failures: DataFrame, kind: str = "failure") -> DataFrame:
    """failure, documents of all kinds, those that don't occur too; an unknown kind keeps its own row."""
    taxonomy = spark.createDataFrame([(k, f) for k, f in enumerate(FAILURES)], "ord int, failure string")
    counted = failures.groupBy(F.coalesce(kind, F.lit("unknown")).alias("failure")).agg(F.count("*").alias("n"))
    return taxonomy.join(counted, "failure", "full_outer").select(F.coalesce("ord", F.lit(len(FAILURES))).alias("ord"), "failure", F.coalesce("n", F.lit(0)).alias("documents"))


def compared(measured: DataFrame, previous: DataFrame, qid: str) -> DataFrame:
    """qid, before, improved, regressed: a miss that some newer way now hits; an ok that one now loses while the lexical way hits.

    previous: qid, failure of an earlier run; a question without one is neither.
    """
    newer = F.col("mode") != "lexical"
    sums = measured.groupBy(qid).agg(F.bool_or(newer & F.col("topk")).alias("any"), F.bool_or(newer & ~F.col("topk")).alias("lost"), F.bool_or(~newer & F.col("topk")).alias("base"))
    rows = sums.join(previous.select(qid, F.col("failure").alias("before")), qid, "left")
    is_ = lambda s: F.coalesce(F.col("before") == s, F.lit(False))
    return rows.select(qid, "before", (is_("retrieval_miss") & F.col("any")).alias("improved"), (is_("ok") & F.col("lost") & F.col("base")).alias("regressed"))


def generation(df: DataFrame, answer: str = "answer") -> DataFrame:
    """answered, total, accuracy as printed, as one row."""
    done = F.count_if(F.coalesce(answer, F.lit("")) != "")
    made = df.agg(done.alias("answered"), F.count("*").alias("total"))
    return made.withColumn("accuracy", F.when(F.col("total") > 0, F.format_string("%d/%d (%.1f%%)", "answered", "total", 100 * F.col("answered") / F.col("total"))).otherwise("N/A"))


def advice(counts: dict[str, tuple[int, int]], regressed: int) -> list[str]:
    """What the hits (top1, topk) by mode suggest; modes that couldn't run aren't among them."""
    if "bm25" not in counts or "dense" not in counts:
        missing = [m for m in ("bm25", "dense") if m not in counts]
        return [f"unavailable: {', '.join(missing)}; make it available and run again"]
    k = {m: c[1] for m, c in counts.items()}
    both = k.get("bm25_dense", 0)
    gains = []
    if k["bm25"] > k.get("lexical", 0):
        gains.append("bm25 covers more than lexical")
    if both > k["dense"]:
        gains.append("bm25_dense covers more than dense")
    if both > max(k.get("lexical", 0), k["dense"], k.get("hybrid", 0)):
        gains.append("bm25_dense covers most")
    best = both >= max(k.get("lexical", 0), k["dense"], k.get("hybrid", 0), k["bm25"])
    out = [*gains, "use bm25_dense" if gains and best else "use bm25 for lexical" if gains else "keep the present way and collect more data"]
    return [*out, f"caution: {regressed} questions regressed"] if regressed else out


def report(domains: dict[str, int], failures: dict[str, int], counts: dict[str, tuple[int, int]], questions: int, improved: int, regressed: int) -> str:
    """A report in Markdown of what the aggregates above give."""
    row = lambda *cells: f"| {' | '.join(map(str, cells))} |"
    lines = ["# Evaluation report", "", "## Corpus", row("Domain", "Count"), row("---", "---"), *(row(*x) for x in sorted(domains.items()))]
    lines += ["", "## Failures", row("Failure type", "Count"), row("---", "---"), *(row(f"`{f}`", failures.get(f, 0)) for f in FAILURES)]
    share = lambda n: f"{n}/{questions} ({100 * n / questions:.1f}%)" if questions else "N/A"
    lines += ["", "## Modes", row("Mode", "Top 1", "Top k"), row("---", "---", "---"), *(row(m, share(counts[m][0]), share(counts[m][1])) for m in MODES if m in counts)]
    lines += ["", "## Against the previous run", f"- improved: {improved}", f"- regressed: {regressed}", "", "## Recommendation", *(f"- {x}" for x in advice(counts, regressed))]
    return "\n".join(lines) + "\n"
