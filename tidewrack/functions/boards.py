"""Notice boards: the rows of two table layouts, bodies of single notices, and printed lines."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dom import Node, parser, tree

#: Fixed value: the number cell of a pinned notice.
PINNED = "공지"
#: Class words or ids of the part that holds a notice's body, by layout, best first.
BODIES = {
    "plain": ("board-view-content", "board_view_content", "view-content", "view-con", "view_cont", "content"),
    "marked": ("b-content", "view-content", "view-con", "board-view-content", "content"),
}
#: Words of a page's frame; where they make up much of a text it is no body.
CHROME = ("본문 바로가기", "로그인", "이전글", "다음글", "목록", "사이트맵")


def iso_day(text: str) -> str:
    """Days in full or with a year of two digits as ISO days; other texts stay."""
    if re.fullmatch(r"\d{4}([.-])\d{2}[.-]\d{2}", text):
        return text.replace(".", "-")
    return "20" + text.replace(".", "-") if re.fullmatch(r"\d{2}\.\d{2}\.\d{2}", text) else text


def _notice(number: str, title: str, author: str, day: str, link: Node | None, base: str) -> list[dict]:
    if not title or not day:
        return []
    return [{"title": title, "author": author, "date": iso_day(day), "url": urljoin(base, link.attrs.get("href", "") if link else ""), "pinned": number == PINNED}]


def plain_rows(html: str | None, base: str) -> list[dict]:
    """Tables of number, title with link, author and day."""
    out = []
    for row in tree(html).own_rows():
        c = row.cells()
        if len(c) >= 4:
            out += _notice(c[0].text(), c[1].text(), c[2].text(), c[3].text(), c[1].first("a"), base)
    return out


def marked_rows(html: str | None, base: str) -> list[dict]:
    """Tables whose title, author and day are marked by classes; without marks, by their place from the right."""
    out = []
    for row in tree(html).own_rows():
        c = row.cells()
        if len(c) < 2:
            continue

        def said(box: Node | None) -> str:
            return box.text() if box else ""

        titled = next((a for b in row.all("div") if "b-title-box" in b.attrs.get("class", "") for a in b.all("a")), None)
        author = next((x for x in row.all("span") if "b-writer" in x.attrs.get("class", "")), None)
        day = next((x for x in row.all("span") if "b-date" in x.attrs.get("class", "")), None)
        out += _notice(c[0].text(), said(titled) or c[1].text(), said(author) or (c[-3].text() if len(c) >= 3 else ""), said(day) or c[-2].text(), c[1].first("a"), base)
    return out


_ITEM = "title: string, author: string, date: string, url: string, pinned: boolean"


def _by_layout(html: str | None, base: str, layout: str) -> list[dict]:
    return (marked_rows if layout == "marked" else plain_rows)(html, base)


def notices(html: Column, base: Column | str, layout: Column | str = "plain") -> Column:
    """array of struct(title, author, date, url, pinned) of a page's table, in its order.

    Rows with too few cells, and those without a title or a day, go.  Targets are resolved
    against ``base``; null pages give an empty array.
    """
    return parser(_by_layout, _ITEM)(html, *(F.lit(x) if isinstance(x, str) else x for x in (base, layout)))


def _holds(n: Node, word: str) -> bool:
    """Whether the word is one of the node's class words or its id; all but letters, digits and dashes parts words."""
    return any(word in re.split(r"[^\w-]+", n.attrs.get(k, "")) for k in ("class", "id"))


def noisy(text: str) -> bool:
    """Four words of a frame or more that make up a quarter of a text or more."""
    hits = [text.count(w) for w in CHROME]
    return sum(hits) >= 4 and sum(h * len(w) for h, w in zip(hits, CHROME, strict=True)) >= 0.25 * len(text)


def body_of(html: str | None, layout: str | None) -> str:
    """The body of a notice: the first part that its layout marks, else the whole page if it is not mostly frame."""
    root = tree(html)
    for word in BODIES.get(layout or "", (*BODIES["plain"], *BODIES["marked"])):
        found = next((n for n in root.all("article", "section", "div") if _holds(n, word)), None)
        if found is not None and (text := found.text()):
            return text
    text = root.text()
    return "" if noisy(text) else text


def notice_body(html: Column, layout: Column) -> Column:
    return parser(lambda h, w: [{"body": body_of(h, w)}], "body: string")(html, layout)[0]["body"]


def notice_line(notice: Column, board: Column, excerpt: Column) -> Column:
    """[date][board] title (author) — url, and the excerpt on a line of its own if there is one."""
    head = F.concat(F.lit("["), notice["date"], F.lit("]"), F.when(F.coalesce(board, F.lit("")) != "", F.concat(F.lit("["), board, F.lit("]"))).otherwise(""), F.lit(" "), notice["title"], F.lit(" ("), notice["author"], F.lit(") — "), notice["url"])
    return F.when(F.coalesce(excerpt, F.lit("")) != "", F.concat(head, F.lit("\n본문 발췌: "), excerpt)).otherwise(head)
