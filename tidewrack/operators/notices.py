"""Notice boards as tables: what a request for recent notices gives, and a board's stored documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boards as B
from ..functions.text import title_key
from .relational import keep_first

#: Most notices that a request gets, of all boards and of one; most pinned ones; most of a board.
ALL_REGULAR, ONE_REGULAR, MOST, ALL_PINNED, EACH_BOARD = 10, 10, 20, 5, 5
#: Headings of the printed list, title of several boards' notices, and what stands before other notices than those asked for.
NEWEST, FIXED, TOGETHER = "최신 공지", "고정 공지", "충남대학교/컴퓨터인공지능학부 통합 공지"
NOT_FOUND = "'{}' 관련 최근 공지를 찾지 못해 최신 공지를 표시합니다"
#: Characters of a body that are printed, and how many notices get one.
EXCERPT, EXCERPTS = 800, 2


def keyword_list(values: Sequence[str] | str | None, most: int = 3) -> list[str]:
    """Trimmed, each once, three at most; a text is a list of one."""
    given = [values] if isinstance(values, str) else list(values or [])
    return list(dict.fromkeys(x for v in given if (x := str(v).strip())))[:most]


def read_boards(pages: DataFrame) -> DataFrame:
    """ord, place and the notice of each row of ``pages`` (board, label, ord, page, url, layout, html); pages that can't be read give none."""
    rows = pages.select("board", "label", "ord", "page", F.posexplode(B.notices(F.col("html"), F.col("url"), F.col("layout"))).alias("at", "n"))
    return rows.select("board", "label", "ord", F.struct("page", "at").alias("place"), "n.*")


def mentions(title: Column, keywords: list[str]) -> Column:
    """Whether a title holds one of the keywords, white space and case aside; no keyword, no condition."""
    wanted = [title_key(F.lit(k)) for k in keywords if k.strip()]
    key = title_key(title)
    return F.lit(True) if not wanted else sum((F.contains(key, w).cast("int") for w in wanted), F.lit(0)) > 0


def newest() -> list[Column]:
    """By day, the latest first; of one day as the boards give them."""
    return [F.col("date").desc(), F.col("ord"), F.col("place")]


def recent(items: DataFrame, boards: list[dict], details: DataFrame | None = None, board: str | None = None, limit: int | None = None, keywords: Sequence[str] | str | None = None, first: Sequence[str] = ()) -> DataFrame:
    """One row (id, title, text, source_url, source_name, metadata) for a request; none without any notice.

    items: what ``read_boards`` gives.  boards: dicts of board, label, title and url in
    order.  Without a board all are asked; their notices are cut to five of each kind and
    board, and each board's newest comes before the others' second.  Keywords go by
    titles: the boards named ``first`` are searched, then the others, and if none has a
    match the newest of the first are given with a note.  What matched gets excerpts from
    ``details`` (url, html, layout).  Only top rows of each list go on, never a whole board.
    """
    known = {b["board"]: b for b in boards}
    if board is not None and board not in known:
        return _evidence(items.limit(0), items.limit(0), "", "", "", {}, None)
    wanted = keyword_list(keywords)
    chosen = [board] if board else [b["board"] for b in boards if not wanted or b["board"] in first]
    cap = None if limit is None else max(1, min(int(limit), MOST))
    n = (cap or ONE_REGULAR) if board else min(cap or ALL_REGULAR, ALL_REGULAR)
    n_pinned = n if board else ALL_PINNED
    every = [*chosen, *(b["board"] for b in boards if b["board"] not in chosen)]
    own = F.col("board").isin(chosen)
    fits = mentions(F.col("title"), wanted)
    # 1: matches of the boards asked, 2: of the others, 3: what stands there without a match
    stage = F.when(fits & own, 1).when(fits & F.lit(board is None), 2).when(own, 3) if wanted else F.when(own, 1)
    label = F.when((F.col("stage") == 2) & F.lit(len(every) > 1) | F.lit(len(chosen) > 1), F.col("label")).otherwise("")
    rows = items.withColumn("stage", stage).where("stage IS NOT NULL").withColumn("label", label)
    if wanted:
        match = F.col("stage") < 3
        rows = keep_first(rows, ["stage", F.when(match, F.col("url")), F.when(~match, F.col("ord")), F.when(~match, F.col("place"))], ["ord", "place"])
    # the boards are read once: what can be shown of each stage is kept, a few rows of each list
    few = (_each_board(rows) if board is None else _newest(rows, n)).localCheckpoint()
    at = few.agg(F.min("stage")).first()[0]
    rows = few.where(F.col("stage") == F.lit(at)).drop("stage")
    note = NOT_FOUND.format(", ".join(wanted)) if at == 3 else None
    shown = every if wanted and at == 2 else chosen
    regular, pinned = rows.where("NOT pinned"), rows.where("pinned").orderBy(*newest()).limit(n_pinned)
    if board is None and not wanted:
        regular = spread(regular, n)
    else:
        regular = regular.orderBy(*newest()).limit(n)
    if wanted and note is None and details is not None:
        regular, pinned = _with_excerpts(regular, pinned, details)
    one = known[shown[0]] if len(shown) == 1 else None
    about = {"tool": "fetch_recent_notices"} | ({"board": one["board"]} if one else {"boards": ",".join(shown)}) | ({"keywords": ",".join(wanted)} if wanted else {})
    return _evidence(regular, pinned, f"live_notices_{one['board']}" if one else "live_notices_all", one["title"] if one else TOGETHER, one["url"] if one else boards[0]["url"], about, note)


def _each_board(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("stage", F.coalesce(F.nullif("label", F.lit("")), "url"), "pinned").orderBy("ord", "place")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= EACH_BOARD).drop("_n")


def _newest(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("stage", "pinned").orderBy(*newest())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def spread(regular: DataFrame, n: int) -> DataFrame:
    """The newest of each board in the boards' order, then the newest of all, n together; a url once."""
    best = Window.partitionBy("ord").orderBy(*newest())
    marked = regular.withColumn("_rep", F.row_number().over(best) == 1)
    single = keep_first(marked, ["url"], [F.col("_rep").desc(), *newest()])
    return single.orderBy(F.col("_rep").desc(), F.when(F.col("_rep"), F.col("ord")), *newest()).limit(n).drop("_rep")


def _with_excerpts(regular: DataFrame, pinned: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranked = regular.withColumn("_list", F.lit(0)).unionByName(pinned.withColumn("_list", F.lit(1))).where("url <> ''")
    asked = ranked.orderBy("_list", *newest()).limit(EXCERPTS).select("url", "_list")
    body = F.rtrim(F.substring(B.notice_body(F.col("html"), F.col("layout")), 1, EXCERPT))
    read = details.join(F.broadcast(asked), "url").groupBy("url", "_list").agg(F.min(F.struct("html", "layout")).alias("d")).select("url", "_list", "d.*").select("url", "_list", body.alias("excerpt"))
    return tuple(df.join(read.where(F.col("_list") == k).drop("_list"), "url", "left") for k, df in enumerate((regular, pinned)))


def _evidence(regular: DataFrame, pinned: DataFrame, id_: str, title: str, url: str, about: dict[str, str], note: str | None) -> DataFrame:
    """A list's text is put together from at most MOST rows of each kind."""
    both = None
    for k, df in enumerate((regular, pinned)):
        excerpt = F.col("excerpt") if "excerpt" in df.columns else F.lit(None).cast("string")
        line = B.notice_line(F.struct("title", "author", "date", "url"), F.col("label"), excerpt)
        # newest first: days as numbers, so that the struct sorts them the other way round
        own = df.select(F.lit(k).alias("list"), F.struct(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*newest())).alias("n"), line.alias("line")).alias("x"))
        both = own if both is None else both.unionByName(own)
    lines = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.col("x")))), lambda x: x["line"]), "\n")
    text = F.concat(F.lit(f"{note}\n" if note else ""), F.lit(NEWEST), F.when(F.col("a") != "", F.concat(F.lit("\n"), F.col("a"))).otherwise(""), F.when(F.col("b") != "", F.concat(F.lit(f"\n\n{FIXED}\n"), F.col("b"))).otherwise(""))
    made = both.agg(F.count("*").alias("n"), lines(0).alias("a"), lines(1).alias("b")).where("n > 0")
    meta = F.create_map(*(F.lit(x) for kv in about.items() for x in kv)) if about else F.create_map().cast("map<string,string>")
    return made.select(F.lit(id_).alias("id"), F.lit(title).alias("title"), text.alias("text"), F.lit(url).alias("source_url"), F.lit(title).alias("source_name"), meta.alias("metadata"))


#: Notices that a stored board keeps, characters of a body in a built index, and the printed overview.
STORED, BODY = 20, 2500
#: Fixed value: most pages of a board that a crawl reads.
PAGES = 20
OVERVIEW = "충남대학교 학사공지 게시판 최근 게시글입니다.\n\n"


def pages_read(rows: DataFrame, enough: int = STORED, most: int = PAGES) -> DataFrame:
    """board, page of the pages that a crawl of each board reads.

    rows: board, page (from 1 on), pinned.  A board is read page by page until ``enough``
    rows that aren't pinned are there, a page is empty, or ``most`` pages are read; an empty
    page has no rows.  Only counts by page are brought together, at most ``most`` of a board.
    """
    counted = rows.where(F.col("page").between(1, most)).groupBy("board", "page").agg(F.count_if(~F.col("pinned")).alias("n"))
    per_board = counted.groupBy("board").agg(F.map_from_entries(F.collect_list(F.struct("page", "n"))).alias("n"))

    def go_on(state: Column, page: Column) -> Column:
        """The rows so far and the last page read, as long as each page is there and more are wanted."""
        n = F.try_element_at("n", page)
        more = (state["last"] == page - 1) & (state["sum"] < enough) & n.isNotNull()
        return F.struct(F.when(more, state["sum"] + n).otherwise(state["sum"]).alias("sum"), F.when(more, page.cast("long")).otherwise(state["last"]).alias("last"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("last"))
    pages = F.sequence(F.lit(1), F.lit(most)).cast("array<bigint>")
    last = per_board.select("board", F.aggregate(pages, start, go_on)["last"].alias("last")).where("last > 0")
    return last.select("board", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("page"))


def crawled(rows: DataFrame, enough: int = STORED, most: int = PAGES) -> DataFrame:
    """The rows of the pages that a crawl reads; rows without a board are none's."""
    read = pages_read(rows.where(F.col("board").isNotNull()).withColumn("page", F.col("page").cast("long")), enough, most)
    return rows.join(read, (rows.board == read.board) & (rows.page == read.page), "left_semi")


def board_selection(rows: DataFrame) -> DataFrame:
    """All pinned notices and the newest 20 others of a crawled board, each number once.

    rows: no, title, date, url, pinned, page, at.  Pinned ones count as first seen, others
    after they are sorted by day.
    """
    pinned = keep_first(rows.where("pinned"), ["no"], ["page", "at"])
    regular = keep_first(rows.where("NOT pinned"), ["no"], [F.col("date").desc(), "page", "at"])
    return pinned.unionByName(regular.orderBy(F.col("date").desc(), "page", "at").limit(STORED))


def board_documents(selected: DataFrame, details: DataFrame, most: int | None = None) -> DataFrame:
    """id, title, text, date, department, pinned, failed of each selected notice.

    details: no, title, date, department, body, url.  Without a detail the listed title is
    the text; with an empty body a note that names the attachment's page.  Bodies are whole,
    or their first ``most`` characters.
    """
    d = details.select("no", *(F.col(c).alias(f"d_{c}") for c in ("title", "date", "department", "body", "url")), F.lit(True).alias("d_there"))
    # the selected are held and the bodies pass by them; sorted bodies would fill a task's memory
    rows = d.join(selected.hint("shuffle_hash"), "no", "right")
    filled = lambda c: F.coalesce(F.nullif(f"d_{c}", F.lit("")), c)
    stub = F.concat(F.coalesce("d_title", F.lit("")), F.lit("\n게시일: "), F.coalesce("d_date", F.lit("")), F.lit("\n작성: "), F.coalesce("d_department", F.lit("")), F.lit("\n(본문은 첨부파일 참조: "), F.coalesce("d_url", F.lit("")), F.lit(")"))
    body = F.when(F.col("d_there").isNull(), F.col("title")).when(F.trim(F.coalesce("d_body", F.lit(""))) == "", stub).otherwise(F.col("d_body"))
    title = F.coalesce(F.nullif(filled("title"), F.lit("")), F.concat(F.lit("공지사항 "), "no"))
    return rows.select(F.concat(F.lit("notices_"), "no").alias("id"), title.alias("title"), (body if most is None else F.substring(body, 1, most)).alias("text"), filled("date").alias("date"), F.coalesce("d_department", F.lit("")).alias("department"), "pinned", F.col("d_there").isNull().alias("failed"))


def board_overview(documents: DataFrame) -> DataFrame:
    """id, text, date, posts: the newest 20 that aren't pinned as lines of one document, with the latest day."""
    top = documents.where("NOT pinned").orderBy(F.col("date").desc(), "id").limit(STORED)
    line = F.concat(F.lit("["), "date", F.lit("] "), "title")
    # at most 20 rows
    ranked = top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc(), "id")).alias("n"), line.alias("line"), "date")
    return ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.coalesce(F.max("date"), F.lit("")).alias("date"), F.count("*").alias("posts")).select(F.lit("notices_board_overview").alias("id"), F.concat(F.lit(OVERVIEW), "lines").alias("text"), "date", "posts")


def board_report(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """board_rows, pinned, selected, failed and the numbers that failed, as one row."""
    listed = rows.agg(F.count("*").alias("board_rows"))
    made = documents.agg(F.count_if("pinned").alias("selected_pinned"), F.count_if(~F.col("pinned")).alias("selected_regular"), F.count_if("failed").alias("detail_failed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("id")))), ",").alias("failed_ids"))
    return listed.join(F.broadcast(made))
