"""Elements of HTML and Markdown texts, facts of HTML heads, and edits of element tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.chunks import bounded
from lodestone.sources.tables import stored

ELEMENT = "doc_id long, id string, order int, type string, level int, text string"
KINDS = pa.schema([("doc_id", pa.int64()), ("id", pa.string()), ("order", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("text", pa.string())])


def heading_level(kind: Column, level: Column) -> Column:
    """Titles are level 1, section headers one deeper than they say, at most 6; other kinds have none."""
    return F.when(kind == "title", 1).when(kind == "section_header", F.least(F.coalesce(level, F.lit(1)) + 1, F.lit(6)))


class _Blocks(HTMLParser):
    """Collects (type, level, text) of the blocks of a page."""

    KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "caption": "caption", "figcaption": "caption", "table": "table", **{f"h{k}": "heading" for k in range(1, 7)}}
    SILENT = ("script", "style", "head", "template", "noscript")
    OPENS = ("div", "section", "article", "ul", "ol", "nav", "body", "main", "header", "footer", "blockquote")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int | None, str]] = []
        self.parts: list[str] = []
        self.kind, self.level, self.silent, self.in_head = "paragraph", None, 0, False

    def flush(self) -> None:
        text = "".join(self.parts)
        if self.kind == "code":
            text = text.strip("\n")
        elif self.kind == "table":
            text = "\n".join(filter(None, (" ".join(x.split()).strip(" |") for x in text.split("\n"))))
        else:
            text = " ".join(text.split())
        if text.strip():
            self.found.append((self.kind, self.level, text))
        self.parts, self.kind, self.level = [], "paragraph", None

    def handle_starttag(self, tag, attrs):
        if self.in_head and (tag in self.KINDS or tag in self.OPENS):
            # a block ends a head whose end tag is left out
            self.in_head, self.silent = False, 0
        self.in_head |= tag == "head"
        self.silent += tag in self.SILENT
        if self.kind == "table" and tag not in ("table", "caption"):
            self.parts.append({"tr": "\n", "td": " | ", "th": " | ", "br": " "}.get(tag, ""))
        elif tag in self.KINDS:
            self.flush()
            self.kind = self.KINDS[tag]
            self.level = int(tag[1]) if self.kind == "heading" else None
        elif tag in self.OPENS:
            self.flush()
        elif tag == "br":
            self.parts.append("\n" if self.kind == "code" else " ")

    def handle_endtag(self, tag):
        self.in_head &= tag != "head"
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" or (tag in self.KINDS and self.kind != "table") or tag in self.OPENS:
            self.flush()
            if tag in ("caption",):
                self.kind = "table"

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def blocks_of_html(html: str) -> list[tuple[str, int | None, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def blocks_of_markdown(text: str) -> list[tuple[str, int | None, str]]:
    """Headings by #, fenced code, table rows, list items; other lines join into paragraphs up to a blank line."""
    found: list[tuple[str, int | None, str]] = []
    held: list[str] = []
    kind = "paragraph"

    def flush() -> None:
        nonlocal held, kind
        body = "\n".join(held) if kind in ("code", "table") else " ".join(x.strip() for x in held)
        if body.strip():
            found.append((kind, None, body))
        held, kind = [], "paragraph"

    for line in text.splitlines():
        fence = line.lstrip().startswith("```")
        if kind == "code":
            if fence:
                flush()
            else:
                held.append(line)
        elif fence:
            flush()
            kind = "code"
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            if m[2]:
                found.append(("heading", len(m[1]), m[2]))
        elif m := re.match(r"\s*(?:[-*+]|\d{1,3}[.)])\s+(.*)$", line):
            flush()
            kind, held = "list_item", [m[1]]
        elif line.lstrip().startswith("|"):
            if kind != "table":
                flush()
                kind = "table"
            held.append(line.strip())
        elif not line.strip():
            flush()
        else:
            if kind == "table":
                flush()
            held.append(line)
    flush()
    return found


def _elements(frame: DataFrame, blocks) -> DataFrame:
    def rows(doc: int, body: str) -> Iterator[tuple]:
        return ((doc, f"e{k:05d}", k, kind, level, text) for k, (kind, level, text) in enumerate(blocks(body)))

    f = frame.where("body is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "body")
    return f.mapInArrow(lambda batches: bounded(batches, rows, KINDS), ELEMENT)


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements of each page in reading order; null and empty pages have none."""
    return _elements(pages.select(F.col(key).alias("doc_id"), F.col(html).alias("body")), blocks_of_html)


def markdown_elements(documents: DataFrame) -> DataFrame:
    """Elements of each Markdown text; null and empty texts have none."""
    return _elements(documents.select("doc_id", F.col("text").alias("body")), blocks_of_markdown)


def html_title(html: Column, first: int = 65_536) -> Column:
    """The page's <title>, else its first <meta name=title>, from the start of the page; else null."""
    head = F.substring(html, 1, first)
    title = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    tag = F.regexp_extract(head, r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"']?title[\"'\s/>])[^>]*>", 0)  # whatever the order of its attributes
    meta = F.trim(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(meta, F.lit("")))


def heading_paths(elements: DataFrame) -> DataFrame:
    """Elements with heading_path: the last heading of each level above, not ended by a shallower one since."""
    upto = Window.partitionBy("doc_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    last = F.array(*[F.max(F.when((F.col("type") == "heading") & (F.col("level") == k), F.struct("order", "text"))).over(upto) for k in range(1, 7)])
    e = elements.withColumn("heading_path", last)  # the six, then those that live
    at = lambda k: F.get("heading_path", F.lit(k - 1))
    live = []
    for k in range(1, 7):
        shallower = F.greatest(*[F.coalesce(at(j)["order"], F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        live.append(F.when(at(k)["order"] > shallower, at(k)["text"]))
    return e.withColumn("heading_path", F.array_compact(F.array(*live)))


def renumbered(elements: DataFrame, kept: Column) -> DataFrame:
    """What kept leaves, with order again from 0 and no gaps in each document."""
    return elements.where(kept).withColumn("order", (F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1).cast("int"))


def reparented(elements: DataFrame, kept: DataFrame) -> DataFrame:
    """kept(doc_id, id, parent_id, …) with parents moved to the nearest ancestor that is kept, else null.

    What each fallen element leads to is followed in steps that double, each a written table, until all lead to an
    element that is kept or to none; what still leads to a fallen one then lies on a cycle and becomes null."""
    fallen = elements.join(kept.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    up = stored(fallen.select("doc_id", F.col("id").alias("at"), F.col("parent_id").alias("to")), "fallen")
    most = up.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        on = up.select("doc_id", F.col("at").alias("to"), F.col("to").alias("further"), F.lit(True).alias("fell"))
        met = stored(up.join(on, ["doc_id", "to"], "left"), "fallen")
        if not met.where("fell").head(1):
            break
        up = met.select("doc_id", "at", F.when(F.col("fell"), F.col("further")).otherwise(F.col("to")).alias("to"))
    live = kept.select("doc_id", F.col("id").alias("_to"), F.lit(True).alias("_live"))
    moved = kept.join(up.select("doc_id", F.col("at").alias("parent_id"), F.col("to").alias("_new"), F.lit(True).alias("_fell")), ["doc_id", "parent_id"], "left")
    moved = moved.withColumn("_to", F.when(F.col("_fell"), F.col("_new")).otherwise(F.col("parent_id")))
    return moved.join(live, ["doc_id", "_to"], "left").withColumn("parent_id", F.when(F.col("_live"), F.col("_to"))).select(*kept.columns)
