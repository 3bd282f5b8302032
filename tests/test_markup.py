"""Tolerant pages and Markdown."""

import pytest

from sparkloom.sources import markup, readers

# page, title, links, blocks
PAGES = [
    ("<html><head><title>A &amp; B</title></head><body><p>x<p>y</body>", "A & B", [], [("text", "x"), ("text", "y")]),
    ("<a href='one'>1</a> <a href=two>2</a> <A HREF=\"three?a=1&amp;b=2\">3</A><a name=x>4</a><a href>5</a>", None, ["one", "two", "three?a=1&b=2"], [("text", "1 2 345")]),
    ("a<!-- <a href='no'>hidden</a> -->b<script>var s = '<a href=\"no\">';</script>c<style>p{}</style>", None, [], [("text", "abc")]),
    ("<h2>Head<br>line</h2><ul><li>one<li>two</ul>tail", None, [], [("h2", "Head"), ("text", "line"), ("li", "one"), ("li", "two"), ("text", "tail")]),
    ("<pre>  a\n   b</pre>", None, [], [("pre", "  a\n   b")]),
    ("1 < 2 &lt; 3 &#228; &nbsp;&unknown; <b>bold</i> text", None, [], [("text", "1 < 2 < 3 ä &unknown; bold text")]),
    ("<title>one</title><title>two</title>", "one", [], []),
    ("<p title='a > b'>quoted</p><img src=x alt=\"p>q\"/>", None, [], [("text", "quoted")]),
    ("", None, [], []),
    ("plain", None, [], [("text", "plain")]),
    ("<p>never closed <a href='x", None, None, None),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES)] + [(99, None)], "id long, html string").repartition(3)
    got = {r["id"]: r for r in markup.page_blocks(df, "id", "html").collect()}
    assert got[99]["title"] is None and got[99]["blocks"] is None
    for i, (_, title, links, blocks) in enumerate(PAGES):
        assert got[i]["title"] == title
        if links is not None:
            assert got[i]["links"] == links
            assert [tuple(b) for b in got[i]["blocks"]] == blocks and got[i]["text"] == "\n".join(t for _, t in blocks)
    text = {r["id"]: r["links"] for r in readers.html_blocks(df, "id", "html").collect()}
    assert text[1] == PAGES[1][2]


TEXTS = [
    ("# A\ntext\n## B ##\nmore", [(1, "A", "text"), (2, "B", "more")]),
    ("intro\n\n# A", [(0, "", "intro"), (1, "A", "")]),
    ("# A\n```\n# not a heading\n```\n# B", [(1, "A", "```\n# not a heading\n```"), (1, "B", "")]),
    ("~~~~ py\n# no\n~~~\n# still no\n~~~~\n# yes", [(0, "", "~~~~ py\n# no\n~~~\n# still no\n~~~~"), (1, "yes", "")]),
    ("```\n# open to the end", [(0, "", "```\n# open to the end")]),
    ("Title\n=====\nbody\n\nSub\n---\nx\n\n---\n", [(1, "Title", "body"), (2, "Sub", "x\n\n---")]),
    ("#no space\n####### seven", [(0, "", "#no space\n####### seven")]),
    ("#\nempty heading", [(1, "", "empty heading")]),
    (None, []), ("", []), (" \n", []),
]


@pytest.mark.parametrize("parse", [markup.text_sections, readers.markdown_sections])
def test_sections(spark, parse):
    df = spark.createDataFrame(list(enumerate(t for t, _ in TEXTS)), "id long, t string")
    found = {}
    for r in parse(df, "id", "t").orderBy("id", "section").collect():
        found.setdefault(r["id"], []).append((r["level"], r["heading"], r["body"]))
    assert [found.get(i, []) for i in range(len(TEXTS))] == [want for _, want in TEXTS]
