"""Links and text of raw web pages (page_id, url, html): by expressions, and a document parser for what they can't tell."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Elements whose text is not shown, and those without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "nav", "header", "footer")


def links(pages: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """(page_id, link, pos): a page's links that are relative (made absolute) or go to one of the hosts or their subdomains, each once, at its first place."""
    base = F.concat(F.lit("https://"), F.split(F.split("url", "://")[1], "/")[0])
    rows = pages.select("page_id", base.alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "href"))
    allowed = rf"^https?://([^/]*\.)?({'|'.join(re.escape(h) for h in hosts)})(/|$)"
    own = F.col("href").startswith("/")
    rows = rows.where(own | F.col("href").rlike(allowed))
    return rows.groupBy("page_id", F.when(own, F.concat("base", "href")).otherwise(F.col("href")).alias("link")).agg(F.min("pos").cast("long").alias("pos"))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, text) of all links with their text, relative ones made absolute."""
    base = F.concat(F.lit("https://"), F.split(F.split("url", "://")[1], "/")[0])
    pattern = r'<a href="([^"]+)">([^<]*)'
    pairs = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "href"), (2, "text"))))
    rows = pages.select("page_id", base.alias("base"), F.posexplode(pairs).alias("pos", "a"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("a.href").startswith("/"), F.concat("base", "a.href")).otherwise(F.col("a.href")).alias("url"), F.col("a.text").alias("text"))


def stripped(html: Column) -> Column:
    """Text of a page without hidden elements, comments and tags; blanks and line breaks collapsed."""
    text = F.regexp_replace(html, rf"(?is)<({'|'.join(HIDDEN)})\b.*?</({'|'.join(HIDDEN)})>", "")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", ""), "<[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def main_text(pages: DataFrame, shortest: int = 200) -> DataFrame:
    """(page_id, title, text) of the pages with enough text."""
    rows = pages.select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), stripped(F.col("html")).alias("text"))
    return rows.where(F.length("text") >= shortest)


class Reader(HTMLParser):
    """Title, text and links of the containers found, and label-value pairs of table rows."""

    def __init__(self, containers: tuple[str, ...]):
        super().__init__()
        self.containers, self.hidden, self.inside, self.title, self.parts, self.all, self.cells, self.row, self.pairs, self.stack, self.links, self.anchor = containers, 0, 0, "", [], [], None, [], {}, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        marks = {tag, *(f".{c}" for k, v in attrs if k == "class" for c in (v or "").split()), *(f"#{v}" for k, v in attrs if k == "id")}
        self.stack.append((tag, bool(marks & set(self.containers))))
        self.hidden += tag in HIDDEN
        self.inside += self.stack[-1][1]
        if tag == "a" and self.inside:
            self.anchor = (dict(attrs).get("href") or "", [])
        if tag == "tr":
            self.row = []
        if tag in ("td", "th"):
            self.cells = []

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.stack):  # a stray end tag closes nothing
            t, container = self.stack.pop()
            self.hidden -= t in HIDDEN
            self.inside -= container
            if t == tag:
                break
        if tag == "a" and self.anchor:
            if self.anchor[0]:
                self.links.append((self.anchor[0], "".join(self.anchor[1]).strip()))
            self.anchor = None
        if tag in ("td", "th") and self.cells is not None:
            self.row.append(" ".join(self.cells).strip())
            self.cells = None
        if tag == "tr" and len(self.row) >= 2:
            self.pairs.setdefault(self.row[0].rstrip(":").lower(), self.row[1])

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
        elif not self.hidden and data.strip():
            self.all.append(data.strip())
            if self.inside:
                self.parts.append(data.strip())
            if self.anchor:
                self.anchor[1].append(data.strip())
            if self.cells is not None:
                self.cells.append(data.strip())


def parsed(pages: DataFrame, containers: tuple[str, ...] = ("article", "main", ".content"), shortest: int = 200) -> DataFrame:
    """(page_id, url, title, text, pairs): by a parser in Arrow batches, for containers and tables that expressions can't follow."""

    def run(batches):
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                r = Reader(containers)
                r.feed(html or "")
                text = "\n".join(r.parts or r.all)
                if len(text) >= shortest:
                    out.append((page, url, r.title.strip(), text, list(r.pairs.items())))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["page_id", "url", "title", "text", "pairs"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, title string, text string, pairs map<string,string>")
