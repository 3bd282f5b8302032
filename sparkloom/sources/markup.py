"""Pages and Markdown texts into blocks and sections, tolerant of what stands in real files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements whose text nobody sees, and elements that begin a new block.
HIDDEN = {"script", "style", "template", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "form", "br", "hr", "body", "head", "title"}


class Page(HTMLParser):
    """Title, links and blocks of one page. Entities are decoded, comments and hidden elements left out, unclosed tags closed by what follows."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.links: list[str] = []
        self.blocks: list[tuple[str, str]] = []
        self._hidden: str | None = None
        self._kind, self._words, self._titled = "text", [], False
        self.feed(text)
        self.close()
        self._flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._hidden:
            return
        if tag in HIDDEN:
            self._hidden = tag
        elif tag == "a":
            self.links += [value.strip() for name, value in attrs[:50] if name == "href" and value is not None]
        if tag in BLOCKS:
            self._flush()
            self._kind = tag if tag in HEADINGS | {"li", "pre", "title"} else "text"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self._hidden == tag:
            self._hidden = None

    def handle_endtag(self, tag: str) -> None:
        if self._hidden:
            self._hidden = None if tag == self._hidden else self._hidden
        elif tag in BLOCKS:
            self._flush()
            self._kind = "text"

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._words.append(data)

    def _flush(self) -> None:
        raw, self._words = "".join(self._words), []
        text = raw.strip("\n") if self._kind == "pre" else " ".join(raw.split())
        if not text.strip():
            return
        if self._kind == "title":
            if self.title is None:
                self.title = text
        else:
            self.blocks.append((self._kind, text))


_BLOCK = pa.struct([("kind", pa.string()), ("text", pa.string())])


def _pages(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                own = batch.slice(s, 200)
                pages = [None if t is None else Page(t) for t in own.column(1).to_pylist()]
                columns = [[p and p.title for p in pages], [p and p.links for p in pages], [p and [{"kind": k, "text": t} for k, t in p.blocks] for p in pages],
                           [p and "\n".join(t for _, t in p.blocks) for p in pages]]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema.set(0, pa.field(schema[0].name, own.column(0).type)))

    return run


def page_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, links, blocks, text): blocks are (kind, text) in order, kind h1 to h6, li, pre or text; text has one block a line.

    A null page has nulls, an empty one no title and no blocks. Links are as written, entities decoded.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = pa.schema([(key, pa.null()), ("title", pa.string()), ("links", pa.list_(pa.string())), ("blocks", pa.list_(_BLOCK)), ("text", pa.string())])
    return df.select(key, F.col(html).cast("string").alias("_html")).mapInArrow(_pages(schema), f"{key} {kind}, title string, links array<string>, blocks array<struct<kind: string, text: string>>, text string")


_HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_UNDER = re.compile(r" {0,3}(=+|-{2,})[ \t]*$")


def sections_of(text: str) -> list[tuple[int, str, str]]:
    """(level, heading, body) of a Markdown text; level 0 is what stands before the first heading. Inside a code fence nothing is a heading."""
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    fence = None
    for line in text.splitlines():
        body = out[-1][2]
        if fence:
            mark = _FENCE.match(line)
            if mark and mark[1].startswith(fence) and not mark[2].strip():
                fence = None
        elif (mark := _FENCE.match(line)) and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif mark := _HEAD.match(line):
            out.append((len(mark[1]), (mark[2] or "").strip(), []))
            continue
        elif (mark := _UNDER.match(line)) and body and body[-1].strip() and not body[-1].startswith(("    ", "\t", ">", "- ", "* ")) and (len(body) == 1 or not body[-2].strip()):
            heading = body.pop().strip()
            out.append((1 if mark[1][0] == "=" else 2, heading, []))
            continue
        body.append(line)
    found = [(level, heading, "\n".join(lines).strip()) for level, heading, lines in out]
    return [x for x in found if x[0] or x[2]]


def _sections(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                own = batch.slice(s, 200)
                found = [sections_of(t or "") for t in own.column(1).to_pylist()]
                at = pa.array([i for i, x in enumerate(found) for _ in x], type=pa.int64())
                rows = [(n, *x) for own_sections in found for n, x in enumerate(own_sections)]
                columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([own.column(0).take(at), *columns], schema=schema.set(0, pa.field(schema[0].name, own.column(0).type)))

    return run


def text_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, level, heading, body): sections of Markdown texts by their headings, of either kind, outside code fences. Null and empty texts have none."""
    kind = df.schema[key].dataType.simpleString()
    schema = pa.schema([(key, pa.null()), ("section", pa.int32()), ("level", pa.int32()), ("heading", pa.string()), ("body", pa.string())])
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(_sections(schema), f"{key} {kind}, section int, level int, heading string, body string")
