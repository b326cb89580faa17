"""Registered queries over questions, tool calls, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as U
from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import service as V
from .registry import Registry, table

register = Registry()

_CASES = "c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [source, lang] END AS stored, CASE WHEN doc_id % 2 = 0 THEN ['t', 'u'] ELSE [] END AS calls, CASE WHEN doc_id % 5 = 0 THEN ['f1', 'f2'] ELSE [] END AS fresh, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'said' END AS said FROM documents)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    pick = lambda n, some: F.when(k % n == 0, some).otherwise(none)
    return table(spark, sf_dir, "documents").select(
        k, F.lit("q").alias("question"), F.when(k % 3 == 0, none).otherwise(F.array("source", "lang")).alias("stored"), pick(2, F.array(F.lit("t"), F.lit("u"))).alias("calls"),
        pick(5, F.array(F.lit("f1"), F.lit("f2"))).alias("fresh"), F.when(k % 7 == 0, "").otherwise("said").alias("said"),
    )


@register(f"""WITH {_CASES}, k AS (SELECT *, len(stored) = 0 AS none, len(calls) > 0 AS called, len(calls) > 0 AND len(fresh) > 0 AS live FROM c)
SELECT doc_id, CASE WHEN none THEN '' WHEN live THEN 'f2|f1|' || array_to_string(stored, '|') ELSE array_to_string(stored, '|') END AS evidence, CASE WHEN none THEN 'insufficient_evidence' WHEN called THEN 'tool' ELSE 'llm' END AS mode,
CASE WHEN none THEN '{V.INSUFFICIENT}' WHEN live THEN '[echo:local] q' || chr(10) || 'f2' || chr(10) || 'f1' || chr(10) || array_to_string(stored, chr(10)) WHEN called AND said <> '' THEN said || '{A.STORED}' ELSE said END AS answer FROM k""")
def default_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with stored evidence, whose model may call tools; fresh evidence goes first, the last first."""
    out = V.ask(_asked(spark, sf_dir), A.Echo())
    return out.select("doc_id", F.array_join("evidence", "|").alias("evidence"), "mode", "answer")


@register(f"""WITH {_CASES} SELECT doc_id, CASE WHEN len(calls) > 0 THEN array_to_string(fresh, '|') ELSE '' END AS evidence, CASE WHEN len(calls) > 0 THEN '[echo:local] q' || chr(10) || array_to_string(fresh, chr(10)) ELSE said END AS answer FROM c""")
def tool_only_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.ask_tools_only(_asked(spark, sf_dir), A.Echo())
    return out.select("doc_id", F.array_join("evidence", "|").alias("evidence"), "answer")


@register("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of each chat that has a user's turn."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id").distinct()
    return V.last_question(turns.join(asked, "conv_id", "left_semi"), "conv_id", "turn", "role", "text")


_CALL = "struct<name: string, arguments: string>"


def _calls(*said: tuple[str, Column | str]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(a) if isinstance(a, str) else a).alias("arguments")) for n, a in said)).cast(f"array<{_CALL}>")


@register("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN 'refused' WHEN 3 THEN 'food_court' WHEN 4 THEN 'no_call' ELSE 'looked_up' END AS outcome, CASE o_orderkey % 5 WHEN 0 THEN '제3학생회관' WHEN 1 THEN '제2학생회관' END AS hall,
CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS days, CASE o_orderkey % 5 WHEN 0 THEN 'fetch_cafeteria_menu' WHEN 1 THEN 'fetch_cafeteria_menu' WHEN 2 THEN '' WHEN 3 THEN 'other,fetch_cafeteria_menu:food_court_skip' ELSE 'other' END AS called FROM orders""")
def forced_menu_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu calls that the router forces, in five situations."""
    k, tool, iso = F.col("o_orderkey") % 5, V.MENU_TOOL, F.date_format("o_orderdate", "yyyy-MM-dd")
    question = F.when(k == 0, F.concat(iso, F.lit(" 3학 메뉴"))).when(k == 3, "1학생회관 메뉴").otherwise("메뉴 알려줘")
    calls = F.when(k == 0, _calls((tool, '{"dates": ["2020-01-01"]}'))).when(k == 1, _calls((tool, '{"cafeteria": "제2학생회관"}'))).when(k == 2, _calls((tool, F.concat(F.lit('{"dates": "'), iso, F.lit('"}'))))).when(k == 3, _calls(("other", "{}"), (tool, "{}"), ("later", ""))).otherwise(_calls(("other", "{}")))
    retried = F.when(k == 2, _calls((tool, F.concat(F.lit('{"date": "'), iso, F.lit('"}')))))
    out = V.forced_menu_call(table(spark, sf_dir, "orders").select("o_orderkey", question.alias("question"), calls.alias("calls"), retried.alias("retried")), "2026-06-13")
    return out.select("o_orderkey", "outcome", "hall", F.array_join("days", ",").alias("days"), F.array_join("called", ",").alias("called"))


_LABELS = [(0, "notices", "fetch_recent_notices"), (1, "graduation", None)]


@register("SELECT doc_id, CASE quality WHEN 0 THEN 'notices' WHEN 1 THEN 'graduation' END AS domain, CASE quality WHEN 0 THEN 'fetch_recent_notices' END AS forced, quality IS NULL AS unrouted FROM documents LEFT JOIN labels USING (doc_id)")
def routed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("class")), "doc_id", "left")
    return V.route(rows, _LABELS).select("doc_id", "domain", "forced", "unrouted")


@register("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS content, turn % 3 = 0 AS stopped FROM conversations")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as streams of pieces; in some a tool call's mark is spread over two of them."""
    marked = F.col("turn") % 3 == 0
    pieces = F.concat(F.split("text", r"(?<= )"), F.when(marked, F.array(F.lit("<Tool"), F.lit("_call>x"))).otherwise(F.array().cast("array<string>")))
    lines = F.concat(F.array(F.lit(": comment")), F.transform(pieces, lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))))), F.array(F.lit("data: [DONE]"), F.lit("data: {}")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.alias("lines"))
    return V.streamed(rows.select("conv_id", "turn", V.streamed_events(rows).alias("parts"))).select("conv_id", "turn", "content", "stopped")


@register("""SELECT o_orderkey, 'Workspace: w' || chr(10) || 'Timezone: Asia/Seoul' || chr(10) || 'Current Time: ' || strftime(t, '%Y-%m-%d %H:%M') || ' (' || strftime(t, '%A') || ', ' || ['월', '화', '수', '목', '금', '토', '일'][isodow(t)] || '요일)' || chr(10) || 'around ' || o_orderstatus || chr(10) || chr(10) || 'Question:' || chr(10) || o_orderpriority AS prompt FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 HOUR + INTERVAL 9 HOUR AS t FROM orders)""")
def tool_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 20 HOURS")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.tool_prompt(F.col("o_orderpriority"), "w", "Asia/Seoul", at, F.concat(F.lit("around "), "o_orderstatus")).alias("prompt"))


@register("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'fetch_cafeteria_menu(a=' || lang || ', b=2, c=3, d=4) → 2 cafeteria menus' ELSE 'f() → ' || CASE WHEN doc_id % 3 = 0 THEN '1 result' ELSE '2 results' END END AS summary, CASE WHEN doc_id % 5 = 0 THEN '3,4' WHEN doc_id % 5 = 1 THEN '' ELSE lang END AS day FROM documents""")
def tool_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a tool's call and its evidence's day are shown."""
    k = F.col("doc_id")
    arguments = F.when(k % 2 == 0, F.concat(F.lit('{"a": "'), "lang", F.lit('", "b": 2, "c": 3, "d": 4, "e": 5}'))).otherwise("[]")
    fresh = F.when(k % 2 == 0, F.array(F.lit("오늘: x\n one \n\n"), F.lit("two"))).when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    meta = F.when(k % 5 == 0, F.create_map(F.lit("months"), F.lit("3,4"))).when(k % 5 == 1, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("created_at"), F.col("lang"), F.lit("months"), F.lit("1")))
    name = F.when(k % 2 == 0, V.MENU_TOOL).otherwise("f")
    return table(spark, sf_dir, "documents").select(k, V.tool_summary(name, arguments, fresh).alias("summary"), V.evidence_day(meta).alias("day"))


@register("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'f:{"lang":"' || lang || '","n":"' || doc_id || '"}' WHEN 1 THEN 'g:{"n":' || doc_id || '}' ELSE '' END AS calls, CASE doc_id % 4 WHEN 0 THEN 'see  end' WHEN 1 THEN 'see  end' WHEN 2 THEN 'see <tool_call>{bad</tool_call> end' ELSE 'see end' END AS rest, doc_id % 4 = 2 AS broken FROM documents""")
def written_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written in replies as boxes of parameters or as JSON; one that can't be read stays where it is."""
    k = F.col("doc_id")
    tagged = F.concat(F.lit("<tool_call>\n<function=f><parameter=lang>"), "lang", F.lit("</parameter><parameter=n> "), k.cast("string"), F.lit("</parameter></function></tool_call>"))
    json = F.concat(F.lit('<tool_call>{"name": "g", "arguments": {"n": '), k.cast("string"), F.lit("}}</tool_call>"))
    body = F.when(k % 4 == 0, tagged).when(k % 4 == 1, json).otherwise("<tool_call>{bad</tool_call>")
    rows = table(spark, sf_dir, "documents").select(k, F.when(k % 4 == 3, "see end").otherwise(F.concat(F.lit("see "), body, F.lit(" end"))).alias("t")).select("doc_id", U.tool_calls("t").alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x.calls", lambda c: F.concat(c["name"], F.lit(":"), c["arguments"])), "|").alias("calls"), "x.rest", "x.broken")


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with the language that is expected, and each way's documents with theirs."""
    from .catalog import _bm25, _lexical

    ranked = None
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for mode, found in (("lexical", _lexical(spark, sf_dir)), ("bm25", _bm25(spark, sf_dir))):
        one = found.withColumn("mode", F.lit(mode))
        ranked = one if ranked is None else ranked.unionByName(one)
    expected = F.when(F.col("item_id") % 4 == 0, "fr").when(F.col("item_id") % 4 == 1, "").otherwise("en")
    questions = table(spark, sf_dir, "benchmark").select("item_id", expected.alias("expected"))
    previous = questions.where("item_id % 3 <> 0").select("item_id", F.when(F.col("item_id") % 3 == 1, "retrieval_miss").otherwise("ok").alias("failure"))
    return E.hits(ranked.join(langs, "doc_id"), questions, "item_id", F.col("lang")), questions, previous


@register("__MEASURED__ SELECT mode, count(*) AS questions, count(*) FILTER (top1) AS top1, count(*) FILTER (topk) AS topk FROM h GROUP BY mode")
def eval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_mode(_measured(spark, sf_dir)[0])


@register("__MEASURED__, p AS (SELECT item_id, CASE item_id % 3 WHEN 1 THEN 'retrieval_miss' WHEN 2 THEN 'ok' END AS before FROM benchmark), a AS (SELECT item_id, bool_or(mode = 'bm25' AND topk) AS new, bool_or(mode = 'lexical' AND topk) AS old FROM h GROUP BY 1) SELECT item_id, before, coalesce(before = 'retrieval_miss' AND new, false) AS improved, coalesce(before = 'ok' AND old AND NOT new, false) AS regressed FROM a JOIN p USING (item_id)")
def eval_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured, _, previous = _measured(spark, sf_dir)
    return E.compared(measured, previous, "item_id")


@register("__MEASURED__, f AS (SELECT CASE WHEN found = 0 THEN 'data_missing' WHEN expected IS NULL OR topk THEN 'ok' ELSE 'retrieval_miss' END AS failure FROM h WHERE mode = 'bm25') SELECT CAST(i - 1 AS INT) AS ord, k AS failure, (SELECT count(*) FROM f WHERE failure = k) AS documents FROM (SELECT unnest(generate_series(1, 9)) AS i, unnest(" + str(list(E.FAILURES)) + ") AS k)")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine kinds, those that don't occur too."""
    own = _measured(spark, sf_dir)[0].where("mode = 'bm25'")
    return E.histogram(spark, own.select(E.failure(F.col("found"), F.col("expected"), F.col("topk")).alias("failure")))


@register("SELECT count(*) FILTER (trim(text) <> '' AND turn % 4 <> 0) AS answered, count(*) AS total, printf('%d/%d (%.1f%%)', answered, total, 100 * answered / total) AS accuracy FROM conversations WHERE role <> 'user'")
def eval_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role <> 'user'").select(F.when(F.col("turn") % 4 != 0, F.trim("text")).alias("answer"))
    return E.generation(rows)
