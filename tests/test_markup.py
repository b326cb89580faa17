from tidewrack.functions import markup


def test_grid_spans():
    html = "<table><tr><td rowspan=3>a</td><td>b</td></tr><tr><td colspan='2'>c &amp; d</td></tr><tr></tr></table><table><tr><td>no</td></tr></table>"
    assert markup.grid_of(html) == [["a", "b"], ["a", "c & d", "c & d"], ["a"]]
    assert markup.grid_of(None) == [] and markup.grid_of("<p>x") == []
    assert markup.grid_of("<tr><td rowspan=x colspan=0>a<br> b </td></tr>") == [["a\nb"]]


def test_spans_have_no_greatest_size():
    assert len(markup.grid_of("<tr><td colspan=300>a</td></tr>")[0]) == 300
    assert markup.grid_of("<tr><td rowspan=2>a</td><td>b</td></tr><tr><td colspan=2>c</td></tr>") == [["a", "b"], ["a", "c", "c"]]


def test_tool_calls(spark):
    text = 'Let me see. <tool_call>{"name": "menu", "arguments": {"date": "2026-06-13"}}</tool_call> done <tool_call>broken'
    calls, rest, broken = markup.calls_of(text)
    assert calls == [("menu", '{"date":"2026-06-13"}')] and rest == "Let me see.  done <tool_call>broken" and not broken
    tagged = "<TOOL_CALL x=1>\n<function=fetch>\n<parameter=board>\n학사 </parameter><parameter=limit>3</parameter></function>\n</tool_call>"
    assert markup.calls_of(tagged) == ([("fetch", '{"board":"학사","limit":"3"}')], "", False)
    for bad in ("<tool_call>{}</tool_call>", "<tool_call>cut off", "<tool_call></tool_call> x", "<tool_call><function=f></tool_call>"):
        assert markup.calls_of(bad) == ([], bad, True)
    assert markup.calls_of('<tool_call>{"name": "a", "arguments": "b"}</tool_call>') == ([("a", "{}")], "", False)
    df = spark.createDataFrame([(text,), (None,), ("plain",)], "t string").select(markup.tool_calls("t").alias("x")).select("x.*")
    assert [(len(r.calls), r.broken) for r in df.collect()] == [(1, False), (0, False), (0, False)]


def test_tree_of_broken_pages():
    from tidewrack.functions import dom

    t = dom.tree("<ul><li>a<li>b<p>c<p>d</ul></div><table><tr><td>x<td>y<tr><td>z</table>&amp;&#39;")
    assert [n.text() for n in t.all("li")] == ["a", "b c d"] and [len(r.cells()) for r in t.all("tr")] == [2, 1]
    assert t.text().endswith("&'") and dom.tree(None).text() == ""
    assert dom.tree("<script>var a='</p>'</script><b>a</b><i>b</i>").text() == "a b"


def test_pages_nest_as_deep_as_they_like():
    from tidewrack.functions import boards, campus, dom

    deep = 100_000
    page = "<div class='calen_box'>" * deep + "<b>in" + "<p>side</p>" + "</b></div>" * deep + "<li>after"
    root = dom.tree(page)
    assert sum(1 for _ in root.all("div")) == deep and root.text() == "in side after" and root.lines() == ["in side", "after"]
    assert root.first("li").text() == "after" and list(root.pieces()) == ["in", "side", "after"]
    mixed = "".join(f"<t{k % 97}>" for k in range(deep)) + "x" + "".join(f"</u{k % 97}></t{k % 97}>" for k in range(deep))
    assert dom.tree(mixed).text() == "x"
    assert campus.calendar_boxes("<ul>" * deep + "<div class='calen_box'></div>") == campus.calendar_boxes("<div class='calen_box'></div>")
    assert boards.body_of("<section>" * deep + "text", None) == "text"
    assert dom.tree("a<nav>b<i>c</i></nav>d").text() == "a d"


def test_class_words_of_a_body():
    from tidewrack.functions import boards, dom

    for attrs, there in (("class='x fr-view y'", True), ("class='fr-view-2'", False), ("id='fr-view'", True), ("class='a_fr-view'", False), ("class='a.fr-view'", True), ("", False)):
        assert boards._holds(dom.tree(f"<div {attrs}>").first("div"), "fr-view") == there
