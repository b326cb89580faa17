"""Answers by decision table, batches with a retry, and a registry of tools."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: added to an answer from stored rows where live ones were asked for.
STORED = "\n\n(실시간 정보를 가져오지 못해 저장된 자료를 기준으로 답변했습니다.)"


class ChatClient(Protocol):
    def chat(self, prompt: Column) -> Column: ...


@dataclass(frozen=True)
class Echo:
    """Answers with its prompt; stands in for a model."""

    model: str = "local"

    def chat(self, prompt: Column) -> Column:
        return F.concat(F.lit(f"[echo:{self.model}] "), prompt)


def routed(df: DataFrame, client: ChatClient, missing: str, failed: str, refusal: str) -> DataFrame:
    """Adds ``evidence`` (which rows back the answer) and ``answer``.

    ``df`` has question, forced (tool name or null), rag, fresh and again (texts of stored,
    live and re-retrieved evidence, null or empty if none) and refused (boolean).  Without
    a tool, stored evidence answers, or ``missing``; with one: a refusal, live evidence
    alone, else stored evidence with a note, else ``failed``.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tool = F.coalesce(F.col("forced"), F.lit("")) != ""
    kind = F.when(~tool & ~has("rag"), "none").when(~tool, "rag").when(F.coalesce("refused", F.lit(False)), "refused").when(has("fresh"), "fresh").when(has("again"), "again").when(has("rag"), "rag").otherwise("failed")
    used = F.when(F.col("evidence") == "fresh", F.col("fresh")).when(F.col("evidence") == "again", F.col("again")).otherwise(F.col("rag"))
    said = client.chat(F.concat(F.col("question"), F.lit("\n"), used))
    stored = tool & F.col("evidence").isin("again", "rag")
    fixed = F.when(F.col("evidence") == "none", missing).when(F.col("evidence") == "refused", refusal).when(F.col("evidence") == "failed", failed)
    return df.withColumn("evidence", kind).withColumn("answer", F.coalesce(fixed, F.concat(said, F.when(stored, STORED).otherwise(""))))


def batch(df: DataFrame, first: Column, second: Column, fallback: Column, empty: str) -> DataFrame:
    """Adds ``model`` and ``mode``: the first answer, else the second, else the fallback; empty questions get a fixed text."""
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    mode = F.when(blank, "fallback").when(first.isNotNull(), "llm").when(second.isNotNull(), "llm_retry").otherwise("fallback")
    return df.withColumns({"model": F.when(blank, empty).otherwise(F.coalesce(first, second, fallback)), "mode": mode})


class Tools:
    """Named functions with descriptions; listed in the order of their registration."""

    def __init__(self) -> None:
        self._made: dict[str, tuple[str, dict, Callable[..., list]]] = {}

    def tool(self, name: str, description: str, parameters: dict) -> Callable:
        def add(f: Callable[..., list]) -> Callable[..., list]:
            self._made[name] = (description, parameters, f)
            return f

        return add

    def definitions(self) -> list[dict]:
        return [{"name": n, "description": d, "parameters": p} for n, (d, p, _) in self._made.items()]

    def dispatch(self, name: str, arguments: dict[str, Any] | None) -> list:
        """What the tool finds; nothing for an unknown one or one that fails."""
        if name not in self._made:
            return []
        try:
            return list(self._made[name][2](**(arguments or {})))
        except Exception:  # noqa: BLE001 - a failed tool is one without evidence
            return []
