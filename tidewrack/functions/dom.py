"""A small tree of a page, and pandas UDFs over what parsers read from it.

Tables with spans, class marks and nested boxes depend on what was opened before, which
SQL functions can't follow; each page is one row and is parsed by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes, if it is still open and no table lies between.
CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HIDDEN = frozenset(("script", "style", "nav"))
#: Lines end where these do.
LINE_ENDS = frozenset(("p", "h3", "li", "td", "tr"))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self, hidden: frozenset[str] = frozenset()) -> Iterator[tuple[Node | str, bool]]:
        """What is below this one, in order: (text or node, True), and (node, False) where it ends; inside hidden tags nothing.

        Pages nest as deep as they like, so the open nodes are kept here and not on Python's stack.
        """
        open_: list[tuple[Node, Iterator[Node | str]]] = [(self, iter(self.kids))]
        while open_:
            node, rest = open_[-1]
            k = next(rest, None)
            if k is None:
                open_.pop()
                if open_:
                    yield node, False
                continue
            if isinstance(k, str):
                yield k, True
            elif k.tag not in hidden:
                yield k, True
                open_.append((k, iter(k.kids)))

    def all(self, *tags: str, cls: str | None = None, id: str | None = None) -> Iterator[Node]:
        """Nodes below this one, in order, of some tags, with a class word, with an id."""
        for k, begins in self.walk():
            if begins and isinstance(k, Node) and (not tags or k.tag in tags) and (cls is None or cls in k.attrs.get("class", "").split()) and (id is None or k.attrs.get("id") == id):
                yield k

    def first(self, *tags: str, cls: str | None = None, id: str | None = None) -> Node | None:
        return next(self.all(*tags, cls=cls, id=id), None)

    def pieces(self, hidden: frozenset[str] = HIDDEN) -> Iterator[str]:
        return (k for k, _ in self.walk(hidden) if isinstance(k, str))

    def text(self, between: str = " ") -> str:
        """Its words; ``between`` stands where tags were, and a newline also where one stands in the page."""
        parts = (y for p in self.pieces() for y in (p.split("\n") if between == "\n" else [p]))
        return between.join(x for x in (" ".join(p.split()) for p in parts) if x)

    def lines(self) -> list[str]:
        """Lines that breaks and ends of blocks make, without blank ones."""
        out = [k if isinstance(k, str) else "\n" if (k.tag == "br" if begins else k.tag in LINE_ENDS) else " " for k, begins in self.walk()]
        return [x for x in (" ".join(y.split()) for y in "".join(out).splitlines()) if x]

    def own_rows(self) -> list[Node]:
        """Rows of the first table body, else of all that is here."""
        return list((self.first("tbody") or self).all("tr"))

    def cells(self, *tags: str) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and k.tag in (tags or ("td",))]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]
        self.times: Counter[str] = Counter()

    def _end(self) -> str:
        tag = self.open.pop().tag
        self.times[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = CLOSED_BY.get(tag, ())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self._end()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.times[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.times[tag]:
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.open[0]


def span(cell: Node, name: str) -> int:
    told = cell.attrs.get(name, "").strip()
    return max(1, int(told)) if told.isdecimal() else 1


def grid(rows: list[Node], *tags: str) -> list[list[Node | None]]:
    """Cells by row and column, each repeated over the rows and columns that it spans.

    A cell goes to the next column that no span from above fills, and covers those right
    of it whatever fills them.  Rows without any cell are left out.
    """
    out, above = [], {}
    for row in rows:
        line: dict[int, Node] = {}
        below: dict[int, tuple[Node, int]] = {}
        at = 0
        for cell in row.cells(*tags):
            while at in above:
                at += 1
            for c in range(at, at + span(cell, "colspan")):
                line[c] = cell
                below[c] = (cell, span(cell, "rowspan") - 1)
            at += span(cell, "colspan")
        for c, (cell, left) in above.items():
            if c not in line:
                line[c] = cell
                below[c] = (cell, left - 1)
        above = {c: x for c, x in below.items() if x[1] > 0}
        if line:
            out.append([line.get(c) for c in range(max(line) + 1)])
    return out


def parser(fn: Callable[..., list], schema: str) -> Callable[..., Column]:
    """A function of texts, each giving a list of rows, as a function of columns; nulls are passed on."""

    def made(*columns: Column) -> Column:
        @F.pandas_udf(f"array<struct<{schema}>>")
        def run(*values: pd.Series) -> pd.Series:
            return pd.Series([fn(*x) for x in zip(*values, strict=True)], dtype=object)

        return run(*columns)

    return made
