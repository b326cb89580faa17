"""Table grids, and tool calls written in texts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from .dom import grid, tree


def grid_of(html: str | None) -> list[list[str]]:
    """Rows of the first table body, each cell's lines repeated over the rows and columns that it spans."""
    root = tree(html)
    return [["\n".join(c.lines()) if c else "" for c in row] for row in grid((root.first("table") or root).own_rows(), "td", "th")]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_grid(html: pd.Series) -> pd.Series:
    return html.map(grid_of)


_CALLS = StructType().add("calls", ArrayType(StructType().add("name", StringType()).add("arguments", StringType()))).add("rest", StringType()).add("broken", BooleanType())
_OPEN, _SHUT = re.compile(r"<tool_call\b[^>]*>", re.I), re.compile("</tool_call>", re.I)
_BOUND = {k: (re.compile(rf"<{k}\s*=\s*([^>\s]+)\s*>", re.I), re.compile(rf"</{k}>", re.I)) for k in ("function", "parameter")}


def _boxes(text: str, kind: str) -> list[tuple[str, str, int, int]]:
    """(name, inside, start, end) of <kind=name>…</kind> in a text; an open one without an end is none."""
    out, at = [], 0
    begin, finish = _BOUND[kind]
    while (a := begin.search(text, at)) and (z := finish.search(text, a.end())):
        out.append((a[1], text[a.end() : z.start()], a.start(), z.end()))
        at = z.end()
    return out


def _said(body: str) -> tuple[str, str] | None:
    """Name and JSON arguments of one call, written as JSON or as a function box of parameter boxes."""
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    try:
        x = json.loads(body)
    except ValueError:
        found = _boxes(body, "function")
        if len(found) != 1 or (found[0][2], found[0][3]) != (0, len(body)):
            return None
        return found[0][0], dump({k: v.strip() for k, v, _, _ in _boxes(found[0][1], "parameter")})
    if not isinstance(x, dict) or not isinstance(x.get("name"), str) or not x["name"].strip():
        return None
    return x["name"].strip(), dump(x["arguments"] if isinstance(x.get("arguments"), dict) else {})


def calls_of(content: str | None) -> tuple[list[tuple[str, str]], str, bool]:
    """Calls written in a text, the text without them, and whether it holds calls none of which can be read.

    A call that is broken off or can't be read stays in the text.
    """
    text, calls, rest, at = content or "", [], [], 0
    boxes = []
    while (a := _OPEN.search(text, at)) and (z := _SHUT.search(text, a.end())):
        boxes.append((a.start(), z.end(), _said(text[a.end() : z.start()].strip())))
        at = z.end()
    done = 0
    for start, end, one in boxes:
        if one:
            calls.append(one)
            rest.append(text[done:start])
            done = end
    return calls, "".join(rest) + text[done:], not calls and _OPEN.search(text) is not None


@F.pandas_udf(_CALLS)
def tool_calls(content: pd.Series) -> pd.DataFrame:
    found = [calls_of(x) for x in content]
    return pd.DataFrame({"calls": [[{"name": n, "arguments": a} for n, a in c] for c, _, _ in found], "rest": [r for _, r, _ in found], "broken": [b for _, _, b in found]})
