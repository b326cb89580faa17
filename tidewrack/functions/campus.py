"""Parsers of stored and live campus pages: dining tables, academic calendars, shuttle pages."""

from __future__ import annotations

import re

from pyspark.sql import Column

from .dom import Node, grid, parser, span, tree
from .menus import AUDIENCES, CLOSED, HALLS, MEALS

#: What a menu cell says, spaces aside, where there is no menu to print.
PLACEHOLDERS = ("메뉴운영내역", "메뉴는운영중입니다", "메뉴는준비중입니다")
#: Words that tell a hall's name from other headings, and the name of what is not told.
HALL_WORDS = ("학생회관", "대학", "교직원", "생활과학", "기숙사", "식당")
UNKNOWN = "알수없음"
#: Files of academic calendars that hold none.
NO_CALENDARS = frozenset(("academic_calendar.html", "homepage_academic_calendar_module.html", "academic_calendar_english_education_undergrad.html"))
_DAY = re.compile(r"(\d{4})[.-](\d{2})[.-](\d{2})")


def is_placeholder(text: str) -> bool:
    flat = text.replace(" ", "")
    return not flat or any(p in flat for p in PLACEHOLDERS)


def _tight(n: Node | None) -> str:
    return n.text("") if n else ""


def _day(text: str) -> str | None:
    m = _DAY.search(text)
    return "-".join(m.groups()) if m else None


def live_menu(html: str | None) -> list[dict]:
    """Records of a day's table: meal, audience, then a column for each hall."""
    out, meal = [], None
    for row in grid(tree(html).own_rows(), "td"):
        said = [c.text() if c else "" for c in row]
        meal = said[0] if said[0] in MEALS else meal
        if len(row) < 2 or meal is None or said[1] not in AUDIENCES:
            continue
        for hall, cell in zip(HALLS, row[2:], strict=False):
            if cell is None or is_placeholder(cell.text()):
                continue
            name = _tight_space(cell.first("h3"))
            price = re.search(r"\(([\d,]+)\)", name)
            body = cell.first("p")
            text = CLOSED if CLOSED in cell.text() else "\n".join([name, *(body.lines() if body else [])]) if name else cell.text()
            shut = text == CLOSED
            out.append({"hall": hall, "meal": meal, "audience": said[1], "menu_text": text, "menu_name": None if shut else name or None, "price": price[1] if price and not shut else None})
    return out


def _tight_space(n: Node | None) -> str:
    return n.text() if n else ""


_RECORD = "hall: string, meal: string, audience: string, menu_text: string, menu_name: string, price: string"


def live_menus(html: Column) -> Column:
    return parser(live_menu, _RECORD)(html)


def _table(root: Node) -> Node | None:
    return root.first("table", cls="menu-tbl")


def _tab(root: Node) -> str:
    return next((_tight(li) for box in root.all(id="childTab") for li in box.all("li", cls="over")), "")


def dining_view(path: str, html: str | None) -> str:
    """weekly, daily, or why a stored dining file is skipped."""
    name = re.split(r"[\\/]", path)[-1].lower()
    if "notice" in name or "dining_operation" in name:
        return "Skipped notice file"
    root = tree(html)
    table = _table(root)
    if table is None:
        return "No menu table found"
    head = table.first("thead")
    heads = [_tight(th) for th in head.all("th")] if head else []
    tab, hall = _tab(root), lambda t: any(w in t for w in HALL_WORDS)
    if any(map(_day, heads)) and (hall(tab) or not _day(tab)):
        return "weekly"
    if _day(tab) and any(map(hall, heads)):
        return "daily"
    return "Could not determine view type"


def _first_fills(rows: list[Node], width: int) -> list[list[Node | None]]:
    """Cells in a grid of a fixed width; what a span has filled stays, and what goes beyond an edge is cut off."""
    out: list[list[Node | None]] = [[None] * width for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for cell in row.cells("td", "th"):
            while c < width and out[r][c] is not None:
                c += 1
            for line in out[r : r + span(cell, "rowspan")]:
                line[c : c + span(cell, "colspan")] = [cell] * len(line[c : c + span(cell, "colspan")])
            c += span(cell, "colspan")
    return out


def dining_records(path: str, html: str | None) -> list[dict]:
    """Records of a stored week of one hall, or of a stored day of all halls."""
    view = dining_view(path, html)
    if view not in ("weekly", "daily"):
        return []
    root = tree(html)
    table = _table(root)
    first_row = next(iter((table.first("thead") or Node("", {})).all("tr")), None)
    heads = first_row.cells("th", "td") if first_row else []
    if view == "weekly":
        columns = [d for c in heads if (d := _day(_tight(c)))]
        hall = _tab(root) or UNKNOWN
    else:
        columns = [t for c in heads if (t := _tight(c)) and "구분" not in t]
        marked = (_day(s.text()) for n in root.all(cls="menu-navi") if "weekly" in n.attrs["class"].split() for s in n.all("span", cls="term"))
        day = next((d for d in marked if d), None) or _day(_tab(root))
        if day is None:
            return []
    body = table.first("tbody")
    rows = list(body.all("tr")) if body else []
    width = sum(span(c, "colspan") for c in heads) or (sum(span(c, "colspan") for c in rows[0].cells("td", "th")) if rows else 0)
    out, meal = [], UNKNOWN
    for line in _first_fills(rows, width) if width > 1 else []:
        own = line
        if line[0] is not None and "building" in line[0].attrs.get("class", "").split():
            meal, own = _tight(line[0]), line[1:]
        audience = _tight(own[0]) if own[0] else UNKNOWN
        for at, cell in zip(columns, own[1:], strict=False):
            text = cell.text("\n") if cell else ""
            if is_placeholder(text):
                continue
            name = next((_tight(h) for h in cell.all("h3", cls="menu-tit03")), None)
            price = re.search(r"\((\d+)\)", name or "")
            out.append({"day": at if view == "weekly" else day, "hall": hall if view == "weekly" else at, "meal": meal, "audience": audience, "menu_text": text, "menu_name": name, "price": price[1] if price else None})
    return out


def dining_file(path: Column, html: Column) -> Column:
    """array of struct(view, records): one element."""
    return parser(lambda p, h: [{"view": dining_view(p, h), "records": dining_records(p, h)}], f"view: string, records: array<struct<day: string, {_RECORD}>>")(path, html)[0]


def calendar_boxes(html: str | None) -> list[dict]:
    """(box, month, days, event) of each line of a calendar page's boxes; month is null where a box names none."""
    out = []
    for k, box in enumerate(tree(html).all("div", cls="calen_box")):
        month = next((m for n in box.all("div", cls="fl_month") if (m := re.search(r"\d+", _tight(n)))), None)
        for li in box.all("li"):
            days, event = li.first("strong"), li.first("span", cls="list")
            if days and event and event.text():
                out.append({"box": k, "month": int(month[0]) if month else None, "days": days.text(), "event": event.text()})
    return out


_LINE = "box: int, month: int, days: string, event: string"


def calendar_lines(html: Column) -> Column:
    return parser(calendar_boxes, _LINE)(html)


def calendar_state(path: str, html: str | None) -> dict:
    """Year of a stored calendar page, or why it is skipped; lines of boxes that name no month don't count."""
    if re.split(r"[\\/]", path)[-1] in NO_CALENDARS:
        return {"year": None, "skipped": "Skipped file", "lines": []}
    root = tree(html)
    year = root.first("strong", cls="year")
    if year is None or not _tight(year).isdecimal():
        return {"year": None, "skipped": "No year tag found" if year is None else f"Invalid year: {_tight(year)}", "lines": []}
    if root.first("div", cls="calen_box") is None:
        return {"year": None, "skipped": "No calen_box elements found", "lines": []}
    return {"year": int(_tight(year)), "skipped": None, "lines": [x for x in calendar_boxes(html) if x["month"] is not None]}


def calendar_file(path: Column, html: Column) -> Column:
    """struct(year, skipped, lines)."""
    return parser(lambda p, h: [calendar_state(p, h)], f"year: int, skipped: string, lines: array<struct<{_LINE}>>")(path, html)[0]


def _rows(table: Node) -> list[list[Node]]:
    body = table.first("tbody")
    return [c for r in (body.all("tr") if body else ()) if (c := r.cells("td", "th"))]


def shuttle_page(path: str, html: str | None) -> list[dict]:
    """What a stored shuttle page holds: a summary and routes, or a notice of its geology board.

    kind, name, text, first, last, stops, trips.  A route is a schedule's line with the
    first route line whose name holds its name or is held by it, else with the circular
    route of the same kind.
    """
    root, none = tree(html), dict.fromkeys(("name", "text", "first", "last", "stops", "trips", "posted"))
    if "geo_notice" in re.split(r"[\\/]", path)[-1]:
        return [none | x for x in _geo_notice(root)]
    box = root.first("div", id="txt")
    if box is None:
        return []
    out = []
    title, listed = box.first("h4"), box.first("ul", cls="h7_ul")
    said = [*([_tight(title)] if title else []), *(t for li in (listed.all("li") if listed else ()) if (t := _tight(li)))]
    if said:
        out.append(none | {"kind": "operating_summary", "text": "\n".join(said)})
    tables = list(box.all("table", cls="content_table"))
    if len(tables) < 2:
        return out
    flat = lambda n: n.text(" ")
    routes = [{"name": flat(c[0]), "first": flat(c[1]), "last": flat(c[2]), "stops": c[3].text("\n"), "trips": flat(c[4])} for c in _rows(tables[1]) if len(c) >= 5]
    for c in _rows(tables[0]):
        name = flat(c[0])
        fits = [r for r in routes if r["name"] and (name in r["name"] or (name and r["name"] in name))]
        fits = fits or [r for r in routes if "순환" in r["name"] and any(w in name and w in r["name"] for w in ("교내", "캠퍼스"))]
        times = " | ".join(t for x in c[1:] if (t := x.text("\n")))
        out.append(none | (fits[0] if fits else {"stops": ""}) | {"kind": "route", "name": name, "text": times})
    return out


def _geo_notice(root: Node) -> list[dict]:
    title = _tight_space(root.first("title")).replace("Geological Sciences", "").replace("Notice", "").strip()
    dated = (_day(s.text()) for n in root.all(id="mb_announcement_tr_title") for s in n.all("span") if "float:right" in s.attrs.get("style", ""))
    held = root.first(id="hwpEditorBoardContent")
    texts = re.findall(r'"t"\s*:\s*"([^"]+)"', " ".join(held.pieces(frozenset())) if held else "")
    parts = ["\n".join(t for t in texts if len(t) > 1 and re.search("[가-힣]", t))]
    parts += [m.attrs["content"] for m in root.all("meta") if m.attrs.get("property") == "og:description" and m.attrs.get("content")][:1]
    body = "\n".join(p for p in parts if p)
    return [{"kind": "notice", "name": title or "2026학년도 충남대학교 셔틀버스 운영 안내", "text": body, "posted": next((d for d in dated if d), None)}] if body else []


def shuttle_records(path: Column, html: Column) -> Column:
    return parser(shuttle_page, "kind: string, name: string, text: string, first: string, last: string, stops: string, trips: string, posted: string")(path, html)
