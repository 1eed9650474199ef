"""Text units from marked-up sources; each source row is parsed on its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "li", "td", "th", "blockquote", "pre", "footer", "nav", "div", "article", "section", "br", "tr"} | HEADINGS


class _Blocks(HTMLParser):
    """Collects (region, text): a region is heading, list, note, navigation or body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.units: list[tuple[str, str]] = []
        self.text, self.skip, self.region = [], 0, ["body"]

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            self.units.append((self.region[-1], t))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        if tag in BLOCKS:
            self.flush()
        if tag in HEADINGS or tag in ("nav", "footer", "li"):
            self.region.append("heading" if tag in HEADINGS else {"nav": "navigation", "footer": "note", "li": "navigation" if self.region[-1] == "navigation" else "list"}[tag])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        if tag in BLOCKS:
            self.flush()
        if (tag in HEADINGS or tag in ("nav", "footer", "li")) and len(self.region) > 1:
            self.region.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse_html(html: str) -> list[tuple[str, str]]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.units


def parse_xml(xml: str) -> list[tuple[str, str]]:
    """Paragraphs and notes of an XML document; a note inside a paragraph is a unit of its own."""
    units: list[tuple[str, str]] = []

    def text_of(node, skip_notes: bool) -> str:
        parts = [node.text or ""]
        for child in node:
            if not (skip_notes and child.tag == "note"):
                parts.append(text_of(child, skip_notes))
            parts.append(child.tail or "")
        return "".join(parts)

    for node in ElementTree.fromstring(xml).iter():
        kind = "note" if node.tag == "note" else "heading" if re.fullmatch(r"h\d|title", node.tag) else "body" if node.tag == "p" else None
        t = " ".join(text_of(node, node.tag != "note").split()) if kind else ""
        if t:
            units.append((kind, t))
    return units


def parse_verses(text: str) -> list[tuple[str, str]]:
    r"""One unit per verse of text with \c and \v markers, named chapter:verse."""
    chapter, units = "0", []
    for mark, number, body in re.findall(r"\\(c|v) (\d+)((?:(?!\\[cv] ).)*)", text, re.S):
        if mark == "c":
            chapter = number
        else:
            units.append((f"{chapter}:{number}", " ".join(body.split())))
    return units


def units(rows: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(key, unit, region, text) in source order; null sources have no units."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, i, r, t) for k, s in zip(f["key"], f["text"], strict=True) if s for i, (r, t) in enumerate(parse(s))]
            yield pd.DataFrame(out, columns=["key", "unit", "region", "text"])

    got = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, unit int, region string, text string")
    return got.withColumnRenamed("key", key)


def html_units(rows: DataFrame, key: str, html: str) -> DataFrame:
    return units(rows, key, html, parse_html)
