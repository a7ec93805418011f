"""Reading one saved page: title, labelled fields, links, paragraphs and tables."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle

# Workers get this code with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED = ("title string, fields array<struct<label:string,value:string>>, "
          "links array<struct<href:string,text:string>>, paragraphs array<string>, "
          "tables array<struct<caption:string,header:array<string>,rows:array<array<string>>>>")


def squeeze(text: str) -> str:
    return " ".join(text.split())


class PageReader(HTMLParser):
    """Collects text into whichever of title, link, paragraph, cell or label is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = ""
        self.links: list[dict] = []
        self.paragraphs: list[str] = []
        self.tables: list[dict] = []
        self.fields: list[dict] = []
        self.open: dict[str, list[str]] = {}
        self.href = ""
        self.row: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._finish("p")
        if tag == "a":
            self.href = dict(attrs).get("href") or ""
        if tag == "table":
            self.tables.append({"caption": "", "header": [], "rows": []})
        if tag == "tr":
            self.row = []
        if tag in ("title", "a", "p", "td", "th", "caption", "dt", "dd"):
            self.open[tag] = []

    def handle_data(self, data):
        for parts in self.open.values():
            parts.append(data)

    def handle_endtag(self, tag):
        if tag == "tr" and self.row and self.tables:
            self.tables[-1]["rows"].append(self.row)
            self.row = []
        elif tag in self.open:
            self._finish(tag)

    def close(self):
        super().close()
        self._finish("p")

    def _finish(self, tag):
        if tag not in self.open:
            return
        text = squeeze("".join(self.open.pop(tag)))
        if tag == "title" and not self.title:
            self.title = text
        elif tag == "a":
            self.links.append({"href": self.href, "text": text})
        elif tag == "p":
            self.paragraphs.append(text)
        elif tag == "dt":
            self.fields.append({"label": text.rstrip(":"), "value": ""})
        elif tag == "dd" and self.fields:
            self.fields[-1]["value"] = text
        elif self.tables and tag == "caption":
            self.tables[-1]["caption"] = text
        elif self.tables and tag == "th":
            self.tables[-1]["header"].append(text)
        elif self.tables and tag == "td":
            self.row.append(text)


def read_page(html: str | None) -> dict:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    return {"title": reader.title, "fields": reader.fields, "links": reader.links,
            "paragraphs": reader.paragraphs, "tables": reader.tables}


def read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches with an ``html`` column in, the same rows with the parsed parts out."""
    for batch in batches:
        parsed = [read_page(h) for h in batch["html"]]
        out = batch.drop(columns="html").reset_index(drop=True)
        for name in ("title", "fields", "links", "paragraphs", "tables"):
            out[name] = pd.Series([p[name] for p in parsed], dtype="object")
        yield out
