"""The knowledge base: domain rules, four ways of finding documents, and evidence rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, expand_dates
from . import retrieval, scoring

#: Fixed value: domains that general search leaves out, as live tools answer for them.
LEFT_OUT = frozenset({"notices"})
#: The ways to retrieve, and the summary of an empty pack.
BACKENDS = ("bm25", "dense", "hybrid", "lexical")


def allowed(docs: DataFrame, left_out: Iterable[str] = LEFT_OUT) -> DataFrame:
    """Documents whose domain, or else their metadata's, isn't left out; those without any stay."""
    names = list(left_out)
    own = F.coalesce(F.nullif("domain", F.lit("")), F.try_element_at("metadata", F.lit("domain")))
    return docs.where(own.isNull() | ~own.isin(*names)) if names else docs


def of_domain(docs: DataFrame, domain: str) -> DataFrame:
    """Documents whose metadata names the domain or label, or whose id begins with it; the domain column isn't asked."""
    wanted = domain.lower()
    named = [F.lower(F.coalesce(F.try_element_at("metadata", F.lit(c)), F.lit(""))) == wanted for c in ("domain", "label")]
    begun = [F.startswith(F.lower("id"), F.lit(wanted + c)) for c in "_-"]
    return docs.where(named[0] | named[1] | begun[0] | begun[1])


def evidence(ranked: DataFrame, docs: DataFrame, qid: str, chars: int = 500) -> DataFrame:
    """qid, rank, score, id, title, text (clipped), source_url, source_name, metadata of ranked ids."""
    kept = docs.select("id", "title", clip(F.col("text"), chars).alias("text"), "source_url", "source_name", "metadata")
    return ranked.join(kept, "id").select(qid, "rank", "score", "id", "title", "text", "source_url", "source_name", "metadata")


def retrieve(docs: DataFrame, questions: DataFrame, k: int, backend: str = "bm25", vectors: DataFrame | None = None, left_out: Iterable[str] = LEFT_OUT, as_of: str | None = None, tokenizer: scoring.Tokenizer = scoring.words, qid: str = "item_id", question: str = "text") -> DataFrame:
    """qid, id, score, rank of each question's k documents.

    bm25 ranks title and text, and like an index over all documents fills up with
    documents of score 0; dense needs ``vectors`` (id, vector) and questions with a column
    ``vector``; hybrid is half of each, scaled within its list; lexical counts shared
    terms and gives only documents with some.  With ``as_of`` a question is searched with
    the dates that its words mean; what is reported is the question's id.  Hybrid without
    vectors is bm25.  Questions without a term have no rows.
    """
    if backend not in BACKENDS:
        raise ValueError(f"no back end {backend}")
    if backend == "dense" and vectors is None:
        raise ValueError("the dense back end needs vectors")
    kept = allowed(docs, left_out)
    asked = questions.withColumn("_asked", expand_dates(F.col(question), as_of) if as_of else F.col(question))
    titled = kept.withColumn("_title", F.coalesce("title", F.lit("")))
    if backend == "lexical":
        return scoring.lexical_top(titled, asked, k, "_title", "id", "text", qid, "_asked", tokenizer)
    sparse = dense = None
    if backend in ("bm25", "hybrid"):
        whole = titled.withColumn("_whole", F.concat("_title", F.lit(" "), F.coalesce("text", F.lit(""))))
        found = scoring.bm25_top(whole, asked, k, "id", "_whole", qid, "_asked", tokenizer)
        spoken = asked.where(F.size(F.regexp_extract_all(F.coalesce("_asked", F.lit("")), F.lit(scoring.TOKEN), F.lit(0))) > 0) if tokenizer is scoring.words else asked
        sparse = scoring.filled(found, kept, spoken, k, "id", qid)
        if backend == "bm25" or vectors is None:
            return sparse
    own = vectors.join(kept.select("id"), "id", "left_semi")
    dense = scoring.dense_top(own, questions, k, "id", qid, "vector", "vector")
    if backend == "dense":
        return dense
    return retrieval.hybrid(sparse, dense, qid, "id", k).select(qid, "id", "score", "rank")


def search_knowledge_base(docs: DataFrame, questions: DataFrame, k: int, domain: str | None = None, left_out: Iterable[str] = LEFT_OUT, qid: str = "item_id", question: str = "text", **how) -> DataFrame:
    """Evidence for each question, of one domain if it is given; asking for a domain that is left out lifts the rule.

    The metadata tell the tool and the domain asked for.  Blank questions find nothing.
    """
    own = of_domain(docs, domain) if domain else docs
    rule = frozenset() if domain in left_out else left_out
    found = retrieve(own, questions.where(F.trim(question) != ""), k, left_out=rule, qid=qid, question=question, **how)
    told = F.create_map(F.lit("tool"), F.lit("search_knowledge_base"), F.lit("domain"), F.lit(domain))
    return evidence(found, own, qid).withColumn("metadata", F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda n, _: ~n.isin("tool", "domain")), told))


def best_score(pack: DataFrame, qid: str) -> DataFrame:
    """qid, summary: how many documents, and the first score that is there, which needn't be the greatest."""
    first = F.min_by("score", F.when(F.col("score").isNotNull(), F.col("rank")))
    made = pack.groupBy(qid).agg(F.count("*").alias("n"), first.alias("s"))
    head = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " document").otherwise(" documents"))
    return made.select(qid, F.when(F.col("s").isNull(), head).otherwise(F.concat(head, F.lit(" (best score "), general(F.col("s")), F.lit(")"))).alias("summary"))


def general(x: Column) -> Column:
    """A number with six digits that count, as short as it gets, between 0.0001 and a million."""
    places = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))).cast("int"))
    shown = F.format_string("%.10f", F.round(x * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places))
    return F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")


def margin(scores: DataFrame, key: str) -> DataFrame:
    """key, margin: the best score minus the second; with one score only, it alone."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc())
    two = scores.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    return two.groupBy(key).agg(F.sum(F.when(F.col("_n") == 1, F.col("score")).otherwise(-F.col("score"))).alias("margin"))
