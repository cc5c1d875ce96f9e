"""Main text of web pages by the host paths that a host's pages agree on.

Three passes over pages, none of which moves their html: every page scores its containers (text without links, a share of what is nested, more for elements that
say they hold an article) and gives its best one's path a vote; votes are added up by host and path, and a path that at least SHARE of a host's pages and two
of them vote for wins; then each page is read again and its text taken from the most voted winning path that it has, in all places where it has it,
or from its own best container where it has none (the whole body, which every page has, counts only where it is that). A path is the tags from the body down, those of containers alone, with their classes, digits made 0,
so pages of one template share it. A host has at most 1 / SHARE winning paths, kept as 64-bit keys; the table of winners is measured, sent to all tasks
up to BROADCAST bytes and joined by host beyond that, each host in SALT parts.

What is no text of an article is left out wherever it stands: scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts, comments of readers,
by tag, role or the words of a class or id; of an article's own header the headings stay. A form is read only where a page has no other text.

Cases: null html is empty; a page without text gives an empty text. Text without any tag is one block. A page without a host (null or odd URLs) is of the
host ''. Unclosed, crossed and stray tags, and tags that the page's end cuts, are read as browsers would or skipped, in time linear in the page. A break is white
space. Ties between containers go to the first, between paths to the smaller key. Repeated rows and null page_ids give a row each; columns beyond the three are kept
unless they clash with what is added. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import saved, text_places, trimmed, work_dir

#: Share of a host's pages (and pages) that have to vote for a path; bytes of winners that are sent to all tasks; parts of a host otherwise.
SHARE, VOTES = 0.01, 2
BROADCAST = 16 << 20
SALT = 64
#: What a nested container adds to the one around it, and factors of elements that hold an article by their tag or name.
NESTED, NAMED = 0.75, 1.3
FACTORS = {"article": 1.5, "main": 1.3}

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
BOXES = frozenset("article main section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HIDDEN = frozenset("nav footer aside noscript template svg math canvas object audio video button select datalist dialog menu search".split())
HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that name what is no article, as the first or last word of a name.
OTHER = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion banner banners outbrain taboola
    cookie cookies consent gdpr notice notices notification notifications announcement alert alerts popup modal overlay toast copyright newsletter subscribe subscription signup login paywall
    sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs crumbs pagination pager toolbar topbar skip search
    header masthead footer colophon comment comments disqus respond replies reply share sharing social follow related recommended recommendations widget widgets trending""".split()
)
#: Words that turn it round: the name tells how a page is laid out.
LAYOUT_FIRST, LAYOUT_LAST = frozenset("no has with without".split()), frozenset("layout fixed open closed enabled page wrapper".split())
#: The same for names written in one word.
JOINED = re.compile(r"(?:cookie|advert|newsletter|sponsor|sidebar)[a-z]+|[a-z]+(?:nav|menu|footer|sidebar|banner|comments)|ads?(?:box|slot|unit|block|space|frame|wrap)")
ARTICLE = frozenset("article content post entry story main body text".split())
_ENDS = {"li": ("li", "ul ol menu".split()), "dd": ("dd dt", ["dl"]), "dt": ("dd dt", ["dl"]), "tr": ("tr", ["table"]), "td": ("td th", "tr table".split()), "th": ("td th", "tr table".split()), "option": ("option", ["select"])}
ENDS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _ENDS.items()}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?")
_MARK = re.compile(r"(?i)(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))|(?=[\s/]|$))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>]|$)[^>]*>?") for name in RAW}


def _marks(attributes: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _MARK.findall(attributes):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def _is_other(names: list[str]) -> bool:
    """Whether any class or id names what is no article."""
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in LAYOUT_FIRST and words[-1] not in LAYOUT_LAST and (words[0] in OTHER or words[-1] in OTHER or any(JOINED.fullmatch(w) for w in words)):
            return True
    return False


class Page:
    """The blocks of text of a page, (container, text, characters in links), and its containers: key of the path, label, container around it."""

    def __init__(self, html: str):
        self.keys, self.labels, self.around, self.factors = [xxhash.xxh64_intdigest(b"body")], ["body"], [-1], [1.0]
        self.blocks: list[tuple[int, str, int]] = []
        self.in_forms: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int, int, bool]] = []  # tag, container before, hides before, in a form before
        self._open: Counter[str] = Counter()
        self._box = self._hides = self._headings = 0
        self._form = self._linked = False
        self._text: list[str] = []
        self._links = 0
        self._read(html)
        self._flush()
        if not self.blocks:
            self.blocks = self.in_forms

    # --- reading

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self._data(html[at:])
                return
            if lt > at:
                self._data(html[at:lt])
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 2)
                at = end if close < 0 else close + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                close = html.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            m = _TAG.match(html, lt)
            if not m:
                self._data("<")
                at = lt + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._end(name)
            elif name in RAW:
                close = _RAW_END[name].search(html, at)
                at = close.end() if close else end
            else:
                self._start(name, m[3])

    def _data(self, text: str) -> None:
        if not self._hides or self._headings:
            text = unescape(text) if "&" in text else text
            self._text.append(text)
            if self._linked:
                self._links += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                (self.in_forms if self._form else self.blocks).append((self._box, text, min(self._links, len(text))))
            self._text.clear()
        self._links, self._linked = 0, False

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._flush()
            elif name == "br":
                self._data(" ")
            return
        if name == "a":
            self._linked = True
            return
        block = name in BLOCK
        marks = _marks(attributes) if attributes and not attributes.isspace() else {}
        if block:
            self._flush()
            if self._open["p"]:
                self._close(frozenset(("p",)), frozenset(("td", "th", "table", "caption")))
            if name in ENDS:
                self._close(*ENDS[name])
        if name in ("html", "body"):
            return
        hides = name in HIDDEN or "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role") in HIDDEN_ROLES or "display:none" in marks.get("style", "").replace(" ", "").lower()
        names = marks.get("class", "").split()
        if not hides and name not in HEADINGS and name != "main":
            hides = _is_other([*names, marks["id"]] if "id" in marks else names)
        keeps_headings = name == "header" and not hides and self.factors[self._box] > 1
        hides = hides or name == "header"
        if not (block or hides):
            return
        self._stack.append((name, self._box, self._hides, self._form))
        self._open[name] += 1
        if keeps_headings and not self._hides:
            self._hides = -1  # the header of an article: headings are let through
        elif hides:
            self._hides = max(self._hides, 0) + 1
        if name in HEADINGS and self._hides == -1:
            self._headings += 1
        self._form = self._form or name == "form"
        if name in BOXES and self._hides == 0:
            self._open_box(name, names, marks)

    def _open_box(self, name: str, names: list[str], marks: dict[str, str]) -> None:
        label = name
        if name in ("div", "section", "td"):
            label = ".".join([name, *sorted({_DIGITS.sub("0", c) for c in names})] if names else [name, *(["#" + _DIGITS.sub("0", marks["id"])] if marks.get("id") else [])])
        factor = FACTORS.get("main" if marks.get("role") == "main" else name, 1.0)
        if factor == 1.0 and any(w.lower() in ARTICLE for n in [*names, marks.get("id", "")] for w in _WORD.findall(n)):
            factor = NAMED
        self.keys.append(xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), seed=self.keys[self._box]))
        self.labels.append(label)
        self.around.append(self._box)
        self.factors.append(factor)
        self._box = len(self.keys) - 1

    def _pop(self) -> str:
        name, self._box, before, self._form = self._stack.pop()
        if name in HEADINGS and self._hides == -1:
            self._headings -= 1
        self._hides = before
        self._open[name] -= 1
        return name

    def _close(self, tags: frozenset[str], within: frozenset[str]) -> None:
        """Closes the innermost of tags, if it is open within the innermost of `within`."""
        if not any(self._open[t] for t in tags):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in within:
                return

    def _end(self, name: str) -> None:
        if name == "a":
            self._linked = False
            return
        if name == "br":
            self._data(" ")
            return
        if name in BLOCK:
            self._flush()
        if self._open[name] and name not in ("html", "body"):
            while self._pop() != name:
                pass

    # --- choosing

    def best(self) -> int | None:
        """The container with the highest score; None without text."""
        if not self.blocks:
            return None
        score = [0.0] * len(self.keys)
        for box, text, links in self.blocks:
            score[box] += max(0, len(text) - 2 * links)
        for i in range(len(score) - 1, -1, -1):
            score[i] *= self.factors[i]
            if i:
                score[self.around[i]] += NESTED * score[i]
        return max(range(len(score)), key=score.__getitem__)

    def path(self, box: int) -> str:
        out = []
        while box >= 0:
            out.append(self.labels[box])
            box = self.around[box]
        return ">".join(reversed(out))

    def key(self, box: int) -> int:
        return self.keys[box] - (1 << 63)

    def text(self, key: int) -> str:
        """The blocks in all containers of the path with that key; of the whole body, those that are links alone are left out."""
        inside = [k - (1 << 63) == key for k in self.keys]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.around[i]]
        whole = inside[0]
        return "\n\n".join(text for box, text, links in self.blocks if inside[box] and not (whole and links >= len(text)))

    def chosen(self, winners: list[int]) -> tuple[str, bool]:
        """(text, whether by a winning path)."""
        own = self.best()
        if own is None:
            return "", False
        there = {k - (1 << 63) for k in (self.keys if own == 0 else self.keys[1:])}  # every page has a body
        for key in winners:
            if key in there and (text := self.text(key)):
                return text, True
        return self.text(self.key(own)), False


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?` or `#`, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ballots(batches):
    for batch in batches:
        for a, b in text_places(batch.column("html")):
            out = []
            for host, html in zip(batch.column("host").slice(a, b - a).to_pylist(), batch.column("html").slice(a, b - a).to_pylist(), strict=True):
                page = Page(html or "")
                if (box := page.best()) is not None:
                    out.append((host, page.key(box), page.path(box)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "key", "path"])


def host_paths(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(host, key, path, votes, place): the winning paths of every host, most votes first."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = rows.mapInArrow(trimmed(_ballots), "host string, key long, path string").groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("votes"))
    votes = saved(votes, f"{folder or work_dir(pages.sparkSession, 'html')}/votes")
    whole = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    won = votes.join(whole, "host").where((F.col("votes") >= VOTES) & (F.col("votes") >= SHARE * F.col("all_votes"))).drop("all_votes")
    return won.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "key")))


def _extracted(batches):
    for batch in batches:
        for a, b in text_places(batch.column("_html")):
            part, texts, agreed = batch.slice(a, b - a), [], []
            for html, winners in zip(part.column("_html").to_pylist(), part.column("_winners").to_pylist(), strict=True):
                text, by_winner = Page(html or "").chosen(winners or [])
                texts.append(text)
                agreed.append(by_winner)
            kept = [c for c in part.schema.names if c not in ("_html", "_winners")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(agreed, pa.bool_())], names=[*kept, "text", "consensus"])


def main_texts(pages: DataFrame) -> DataFrame:
    """The rows of pages (url, html) without html, and with text, and consensus: whether a winning path of the host gave it."""
    folder = work_dir(pages.sparkSession, "html")
    winners = host_paths(pages, folder).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("_winners"))  # 1 / SHARE keys at most
    winners = saved(winners.withColumnRenamed("host", "_host"), f"{folder}/winners")
    size = winners.agg(F.coalesce(F.sum(F.octet_length("_host") + 8 * F.size("_winners") + 64), F.lit(0))).first()[0]
    kept = [c for c in pages.columns if c not in ("html", "text", "consensus", "_host", "_html", "_winners", "_part")]
    rows = pages.select(*kept, host_of(F.col("url")).alias("_host"), F.col("html").cast("string").alias("_html"))
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(winners), "_host", "left")
    else:
        parts = winners.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_html"), F.lit(SALT)).cast("int")).join(parts, ["_host", "_part"], "left")
    rows = rows.select(*kept, "_html", "_winners")
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "text string", "consensus boolean"])
    return rows.mapInArrow(trimmed(_extracted), schema)
