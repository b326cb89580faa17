"""One thin query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_prefix, fertility, license_scan, line_crf, lsa_search, minhash_join, packing, pii, ranked_search, spm_codec, token_counts, url_gbt
from .store import documents, table

#: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words by which hosts were reported; the pages of a reported host are labelled 1, those of other hosts 0.
REPORTED = ["casino", "bets", "pills", "spam", "ads-", "-track"]


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = fertility.screen(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band_failed", "n_tokens", "chars_per_token", "byte_share", "entropy", "multi_tokens", "multi_chars_per_token", "multi_byte_share", "multi_entropy", "band")


def op2_spm_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_codec.encode(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = line_crf.learn(docs, table(spark, sf_dir, "labels"))
    return line_crf.score(docs, field, carry=["doc_id"]).select("doc_id", line_crf.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges pages by rules, else by trees that learn how reported hosts look.

    The labels are reports of hosts, and cover only the hosts that aren't held out; pages that
    a rule decides aren't among them.  So what a held-out host gets is inferred from its form.
    Held out are the reported hosts with the greatest hashes, up to a third of them, and of
    the others those whose hash leaves 1 when divided by 3.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_gbt.host_of(F.col("url")), url_gbt.path_of(F.col("url"))
    rule, _ = url_gbt.rule_of(host, path, URL_RULES)
    open_ = pages.where(rule.isNull()).select("url", host.alias("host")).where("host <> ''")
    # the greatest hash of the two thirds that stay in: one number
    cut = open_.where(_reported(F.col("host"))).select("host").distinct().agg(F.percentile_approx(_hash(F.col("host")), 2 / 3, 10_000)).first()[0]
    labelled = open_.where(~_held_out(F.col("host"), cut)).select("url", _reported(F.col("host")).cast("int").alias("label"))
    out = url_gbt.judge(pages, url_gbt.learn(labelled), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score", _held_out(F.col("host"), cut).alias("held_out"))


def _hash(host: Column) -> Column:
    return F.crc32(host.cast("binary"))


def _reported(host: Column) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in REPORTED)), lambda w: F.contains(host, w))


def _held_out(host: Column, cut: int | None) -> Column:
    return F.when(_reported(host), _hash(host) > F.lit(cut if cut is not None else 0)).otherwise(_hash(host) % 3 == 1)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir), pii.learn(), carry=["doc_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), carry=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole")


def op8_lsa_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    return lsa_search.search(docs, items, lsa_search.fit(docs))


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.group(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_byte_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_prefix.digests(documents(spark, sf_dir), carry=["doc_id"])


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fertility, op2_spm_codec, op3_packing, op4_line_crf, op5_url_gbt, op6_pii, op7_token_counts, op8_lsa_search, op9_minhash_join, op10_license_scan, op11_byte_prefix, op12_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op9_minhash_join": OP9, "op10_license_scan": op10_sql(), "op12_ranked_search": OP12}


def op10_sql() -> str:
    """The scan in SQL, on the k-grams themselves instead of their hashes."""
    named = [*((p, label, True) for p, label in license_scan.PHRASES), *((t, label, False) for label, t in license_scan.TEMPLATES)]
    grams, about = [], []
    for k, (t, label, base) in enumerate(named):
        w = license_scan.words_of(t)
        own = [" ".join(w[i : i + license_scan.K]) for i in range(len(w) - license_scan.K + 1)]
        grams += [f"('{g}', {k}, {i})" for i, g in enumerate(own)]
        about.append(f"({k}, '{label}', {base}, {len(own)}, {len(w)})")
    return OP10.format(grams=", ".join(grams), about=", ".join(about), merge=license_scan.MERGE, cover=license_scan.COVER, k=license_scan.K)


OP10 = r"""
WITH t(gram, template, tpos) AS (VALUES {grams}), about(template, label, base, grams, words) AS (VALUES {about}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT row, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'pos': i - 1, 'gram': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}}), recursive := true) FROM d),
v AS (SELECT row, template, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM g JOIN t USING (gram) GROUP BY 1, 2, 3),
l AS (SELECT * FROM v JOIN about USING (template)),
b AS (SELECT row, label, true AS base, diagonal AS spot, 1.0::DOUBLE AS share FROM l WHERE base AND votes = grams),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {merge} THEN 0 ELSE 1 END AS fresh FROM l WHERE NOT base),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY row, template ORDER BY diagonal) AS cluster FROM n),
e AS (SELECT *, max(hi) OVER o + {k} - min(lo) OVER o > 2 * words AS wide, arg_max(diagonal, votes * 1000000000 - diagonal) OVER o AS peak FROM c WINDOW o AS (PARTITION BY row, template, cluster)),
m AS (SELECT row, label, least(1.0, sum(votes) / any_value(grams))::DOUBLE AS share FROM e
      GROUP BY row, template, label, cluster, CASE WHEN wide THEN floor((diagonal - peak) / words + 0.5) ELSE 0 END),
f AS (SELECT row, label, base, spot, share FROM b UNION ALL SELECT row, label, false, NULL, share FROM m WHERE share >= {cover}),
r AS (SELECT row, count(*) FILTER (WHERE base) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (row)
"""


#: Exact: every pair of different texts that share a shingle, then the closure of the links.
OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS m, coalesce(text, '') AS t FROM documents),
u AS (SELECT m, min(doc_id) AS rep, count(*) AS copies, any_value(t) AS t FROM d GROUP BY m),
w AS (SELECT m, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM u),
s AS (SELECT DISTINCT m, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT m, count(*) AS n FROM s GROUP BY m),
p AS (SELECT a.m AS x, b.m AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.m <> b.m GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.m = x JOIN n b ON b.m = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT m AS x, m AS y FROM u UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT r.x AS m, min(u.rep) AS class_id FROM r JOIN u ON u.m = r.y GROUP BY 1),
q AS (SELECT x AS m, sum(u.copies) AS links FROM l JOIN u ON u.m = y GROUP BY 1)
SELECT d.doc_id, k.class_id, CAST(u.copies - 1 + coalesce(q.links, 0) AS BIGINT) AS n_links
FROM d JOIN u USING (m) JOIN k USING (m) LEFT JOIN q USING (m)
"""

#: The same ranking by joins; div is // here.
OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT DISTINCT item, item_id, unnest(t) AS term FROM i),
f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
r AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM f JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM r WHERE score > 0 WINDOW o AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 10
"""
