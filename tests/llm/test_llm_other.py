"""HTML extraction, chat formatting and the pipeline."""

import itertools
import os
import random
import re
import time

import pytest

from shoebox.llm import chat_format as C
from shoebox.llm import html_text as H


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>Hello <b>wor</b>ld  \n x</p>", "Hello world x"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  1. x\n  2. y\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig</table>", "Name  | Qty\napple | 10\nfig"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>x<td>y<td>z</table>", "ab |   | c\nx  | y | z"),
        ("<head><title>t</title><style>p{}</style></head><body>x<script>var y='</p>'</script></body>", "x"),
        ("<div hidden>no</div><p style='Display : none'>no</p><i style='visibility:hidden'>no</i>yes", "yes"),
        ("<pre>\n a\n   b &lt;</pre>c", " a\n   b <\n\nc"),
        ("<blockquote>q<p>z</blockquote>t", "  q\n\n  z\n\nt"),
        ("<dl><dt>a<dd>b</dl>", "a\n  b"),
        ("x<![foo[y]]>z<!-- c --><!doctype html>&amp;&#65;", "xz&A"),
        ("</p></div><td>loose<li>item", "loose\n- item"),
        ("<b><i>open <p>para", "open\n\npara"),
        ("<img alt='pic'> <img>", "pic"),
        ("<table><tr><td>a<table><tr><td>x<td>y<tr><td>1<td>2</table><td>b<tr><td>long cell here<td>z</table>", "a              | b\nx | y\n1 | 2\nlong cell here | z"),
        ("<table><tr><td><ul><li>p<li>q</ul><td>b</table>", "- p | b\n- q"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<textarea>a&amp;<b></textarea><title>t</title>d < e <", "a&<b>d < e <"),
        ("a<!-->b<!-- x -- y -->c<!-- open", "abc"),
        ("a<b x='>'>c</b>d<i y=\"never ends", "acd"),
    ],
)
def test_render(html, text):
    assert H.render(html) == text


def test_render_survives_any_markup():
    r = random.Random(3)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<![", "<!", "<", ">", "&", "&#x;", "text", "<pre>", "</pre>", "<script>", "</script>", "<div hidden", "</", "<a href='", "\x00", "é"]
    for _ in range(500):
        H.render("".join(r.choice(bits) for _ in range(40)))
    assert H.render("<div>" * 20_000 + "deep") == "deep"


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" + "w " * 200_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>", "<b>" * 16_000 + "</i>" * 16_000, "<p><table>" + "<b>" * 16_000 + "</p>" * 16_000, "<table><tr><td>" * 5000 + "x", "<ul><li>a" * 10_000,
        "<table>" + "<tr><td colspan=1000>a<td>b" * 3000, "<table><tr>" + "<td>a" * 1000 + "<td>" + "x<br>" * 10_000, "<a href='" * 50_000, "<" * 100_000, "<!--" * 50_000, "<a " * 50_000, "word " * 400_000,
    ],
)
def test_long_pages_take_time_and_room_in_proportion(page):
    began = time.process_time()
    text = H.render(page)
    assert time.process_time() - began < 10
    assert len(text) <= 20 * len(page)
    words = lambda t: sorted(t.replace("|", " ").replace("- ", " ").split())
    if "colspan" not in page and "'" not in page:
        assert words(text) == words(re.sub(r"<!--.*|<a .*|<[a-z/][^>]*>", " ", page))


def slow_visible(html):
    """The words of a page by the library's own parser; hidden elements are left out."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title"):
                self.off += 1

        def handle_endtag(self, tag):
            if tag in ("script", "style", "title") and self.off:
                self.off -= 1

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    p = P()
    p.feed(html)
    p.close()
    return " ".join(p.out)


def test_all_words_of_the_pages_come_out_once(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no data")
    pages = spark.read.parquet(path)
    html = {r.page_id: r.html for r in pages.collect()}
    letters = lambda t: re.sub(r"[^\w]|_", "", t)
    out = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    plain = [k for k, h in html.items() if h and not re.search(r"hidden|display|visibility|<ol|alt=|<noscript|<template|<!\[|<svg|<iframe|<object", h)]
    assert set(out) == set(html)
    for k in plain:
        assert sorted(letters(out[k])) == sorted(letters(slow_visible(html[k]))), k


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' text", "1 n_chars")
    out = H.extract_text(pages)
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert H.extract_text(pages.limit(0)).count() == 0


def cheapest(roles):
    """The least cost by trying every label and every merge."""
    best = 10**9
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, state = 0, 0
        for role, label in zip(roles, labels, strict=True):
            cost += C.RELABEL * (label != role)
            if label == state:
                cost += C.MERGE
            elif label == 1 and state:
                cost = 10**9
                break
            else:
                need = {(0, 3): 1, (1, 3): 1}.get((state, label), 0)
                cost += C.INSERT * need
            state = label
        else:
            best = min(best, cost + C.INSERT * {0: 0, 1: 2, 2: 1, 3: 0}[state])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_repair_is_cheapest_and_cuts_do_not_matter(seed):
    r = random.Random(seed)
    roles = [r.choice([None, 1, 2, 2, 3, 3]) for _ in range(r.randint(1, 7))]
    whole = C.route([C.matrix(roles)])
    cuts = sorted({0, len(roles), *[r.randint(0, len(roles)) for _ in range(2)]})
    parts = [roles[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    states = C.route([C.matrix(p) for p in parts])
    cost = sum(s[0] for k, p in enumerate(parts) for s in C.trace(p, states[k], states[k + 1])) + C.INSERT * len(C._ENDS[states[-1]])
    assert cost == cheapest(roles)
    assert cost == sum(s[0] for s in C.trace(roles, whole[0], whole[1])) + C.INSERT * len(C._ENDS[whole[-1]])


def test_format_chats(spark):
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 2, "assistant", "hello"), (2, 0, "user", "a"), (2, 1, "User", "b"), (2, 2, "assistant", None),
        (3, 0, "assistant", "x"), (4, 0, "user", "only"), (None, None, None, None), (None, 1, "assistant", "y"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' part", "'c' n", "'c' task")
    out = {}
    for r in sorted(C.format_chats(df).collect(), key=lambda r: (r.conv_id or 0, r.part)):
        text, n, changed, cost = out.get(r.conv_id, ("", 0, 0, 0))
        out[r.conv_id] = (text + r.text, n + r.n_rows, changed + r.n_relabelled, cost + r.cost)
    im = lambda *turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    assert out[1][0] == im(("system", "be brief"), ("user", "hi"), ("assistant", "hello"))
    assert (out[1][1], out[1][3]) == (4, 0)
    assert out[2][0] == im(("user", "a\nb"), ("assistant", ""))
    assert out[3][0] == im(("user", ""), ("assistant", "x"))
    assert out[4][0] == im(("user", "only"), ("assistant", ""))
    assert out[None][1:] == (2, 1, 3)
    assert C.format_chats(df.limit(0)).count() == 0


def test_rows_do_not_depend_on_partitions(spark):
    r = random.Random(9)
    turns = [(c, k, r.choice(["user", "assistant", "tool"]), f"c{c}t{k}" + "x" * (50_000 if k == 3 and c == 2 else 0)) for c in [*range(12), None] for k in range(r.choice([1, 5, 700, 1300]))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((tuple(x) for x in C.format_chats(df).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    sizes = {}
    for c, *_ in turns:
        sizes[c] = sizes.get(c, 0) + 1
    assert sorted((x[0], x[1]) for x in found[0] if x[0] is not None) == [(c, p) for c in range(12) for p in range(-(-sizes[c] // C.SEGMENT))]


def test_long_conversations_are_cut_and_join_up(spark, monkeypatch):
    turns = [(7, k, ["user", "assistant"][k % 2] if k % 17 else "user", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = sorted(C.format_chats(df).collect(), key=lambda r: r.part)
    assert len(out) > 4
    roles = [C.role_number(t[2]) for t in turns]
    states = C.route([C.matrix(roles)])
    assert "".join(r.text for r in out) == C.render([t[3] for t in turns], C.trace(roles, *states), True, True)
    assert sum(r.n_rows for r in out) == 3000
