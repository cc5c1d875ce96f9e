"""Readers of documents: tables, JSON, Markdown, text, binary files, logs. All give (title, content, url, doc_type, source, so_hieu, ngay_ban_hanh)."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

DOCUMENT = "title string, content string, url string, doc_type string, source string, so_hieu string, ngay_ban_hanh string"
LOG = "ts string, session_id string, query string, answer string, used_llm string, chunk_count int, source_titles array<string>, latency_ms long, ip string, user_agent string, guard_triggered boolean, invalid_citations array<int>, error string, guard_reason string"
PDF_MAGIC, PDF_MOST, DOCX_LEAST = b"%PDF-", 50 << 20, 500
#: Names that a field may have, the first that isn't empty counts.
NAMES = {"content": ("text", "content", "body"), "title": ("title", "name"), "url": ("url", "link"), "doc_type": ("doc_type", "type"), "source": ("source",), "so_hieu": ("so_hieu", "number"), "ngay_ban_hanh": ("ngay_ban_hanh", "date")}


def documents(rows: DataFrame, most: int | None = None, clean: bool = True) -> DataFrame:
    """Documents of a table with some of the known names; blank ones are dropped, before the first `most` by url and title are taken."""
    have = {c.lower(): c for c in rows.columns}
    pick = lambda k: F.coalesce(*(F.nullif(F.col(f"`{have[n]}`").cast("string"), F.lit("")) for n in NAMES[k] if n in have), F.lit(""))
    out = rows.select(*(pick(k).alias(k) for k in (x.split()[0] for x in DOCUMENT.split(", ")))).where(F.col("content").rlike(r"(?U)\S"))
    out = out.withColumn("content", T.cleaned(F.col("content"))) if clean else out
    return out.orderBy("url", "title", F.xxhash64("content")).limit(most) if most else out


def json_files(spark: SparkSession, path: str, shortest: int = 1) -> DataFrame:
    """One document a file, in the order of their paths; malformed, blank and (100 for a rebuild) too short ones are left out."""
    rows = spark.read.schema(DOCUMENT + ", _corrupt_record string").option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    rows = rows.where(F.col("_corrupt_record").isNull() & F.coalesce("content", F.lit("")).rlike(r"(?U)\S"))
    return rows.withColumn("content", T.cleaned(F.col("content"))).where(F.length("content") >= shortest).drop("_corrupt_record").orderBy("path")


def text_files(spark: SparkSession, path: str, markdown: bool = False) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("title"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("url"))
    clean = T.markdown_cleaned if markdown else T.cleaned
    return rows.withColumn("content", clean(F.col("content"))).where("content <> ''")


def chat_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Lines of a JSON log; malformed ones are dropped; last: the newest so many."""
    rows = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("ts is not null")
    return rows.orderBy(F.desc("ts")).limit(last) if last else rows


def binary_files(spark: SparkSession, path: str, most: int = PDF_MOST) -> DataFrame:
    """path, length, content and refusal (too_large before the content is looked at, not_a_pdf) of PDF files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", F.when(F.col("length") > most, "too_large").when(F.substring("content", 1, 5) != F.lit(PDF_MAGIC), "not_a_pdf").alias("refusal"), "content")


def docx_text(data: bytes) -> str:
    """Paragraphs, then the cells of tables that aren't among them yet, by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = [t for p in body.findall(f"{w}p") if (t := words(p))]
    seen = set(out)
    for cell in body.iter(f"{w}tc"):
        t = words(cell)
        if t and t not in seen:
            seen.add(t)
            out.append(t)
    return "\n\n".join(out)


def extracted(files: DataFrame, extract: Callable[[bytes], str], doc_type: str, shortest: int = 100) -> DataFrame:
    """Documents of binary files (path, content) by an extractor port; those it fails on or with too little text are left out."""

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    text = extract(data)
                except Exception:  # a file that the port can't read is no document
                    text = ""
                if len(text) >= shortest:
                    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
                    out.append((stem, text, f"upload://{stem}", doc_type, "upload", "", ""))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(7)], names=[x.split()[0] for x in DOCUMENT.split(", ")])

    return files.select("path", "content").mapInArrow(run, DOCUMENT).withColumn("content", T.cleaned(F.col("content")))


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") >= DOCX_LEAST)
    return extracted(rows, docx_text, "docx")


def preferred_link(links, cdn: str):
    """The first .docx link on the CDN host, else the first .docx link."""
    docx = F.filter(links, lambda x: F.lower(x).endswith(".docx"))
    return F.coalesce(F.get(F.filter(docx, lambda x: x.contains(cdn)), F.lit(0)), F.get(docx, F.lit(0)))


def uploads(files: DataFrame, most: int = PDF_MOST) -> DataFrame:
    """(filename, mime, length) with refusal: not_a_pdf by type and name, too_large; null for those let in."""
    named = F.lower("filename").endswith(".pdf") | (F.col("mime") == "application/pdf")
    return files.withColumn("refusal", F.when(~F.coalesce(named, F.lit(False)), "not_a_pdf").when(F.col("length") > most, "too_large"))


def is_download(name):
    """Whether a report's file name may be asked for: letters, digits, `_` and `-` before .pdf, so no other folder either."""
    return F.coalesce(name, F.lit("")).rlike(r"^[a-zA-Z0-9_-]+\.pdf\z")


def _unicode_map(body: bytes) -> dict[bytes, str]:
    """Codes, as hexadecimal digits, to text of a map to Unicode."""
    maps = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        maps |= {a.lower(): bytes.fromhex(b.decode()).decode("utf-16-be", "replace") for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            maps |= {b"%0*x" % (len(a), int(a, 16) + i): chr(int(c, 16) + i) for i in range(min(int(b, 16) - int(a, 16) + 1, 65536))}
    return maps


def _page_fonts(data: bytes, maps: dict[int, dict]) -> dict[int, dict[bytes, dict]]:
    """By the object number of a content stream, the maps of the fonts that its page names. maps: by the object number of the map."""
    objects = {int(n): head for n, head in re.findall(rb"(\d+)\s+\d+\s+obj\b(.{0,4096}?)(?:\bstream\b|\bendobj\b)", data, re.S)}
    named = lambda key, d: objects.get(int(m[1]), b"") if (m := re.search(rb"/%s\s+(\d+)\s+\d+\s+R" % key, d)) else d
    out: dict[int, dict[bytes, dict]] = {}
    for page in objects.values():
        if m := re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page):
            fonts = re.search(rb"/Font\s*<<(.*?)>>", named(b"Resources", page), re.S) or re.search(rb"()", b"")
            listed = fonts[1] or named(b"Font", named(b"Resources", page))
            of = {name: maps.get(int(u[1]), {}) for name, n in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", listed) if (u := re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(n), b"")))}
            for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1]):
                out.setdefault(int(n), {}).update(of)
    return out


def pdf_text(data: bytes) -> str:
    """Text of a PDF's content streams in the order of the file, a line for each text line; a font with a map to Unicode is read by it, as its page names it (where none
    is named, by all maps together), others as Latin-1. Encrypted files and compressed object tables that hold fonts give what can be read without them."""
    streams, found = [], {}
    for m in re.finditer(rb"(?:(\d+)\s+\d+\s+obj\s*)?<<((?:(?!endobj).){0,4096}?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        body, number = data[m.end() : end if end >= 0 else len(data)], int(m[1] or -1 - m.start())
        if b"FlateDecode" in m[2]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"begincmap" in body:
            found[number] = _unicode_map(body)
        elif re.search(rb"\bBT\b", body):
            streams.append((number, body))
    fonts, every = _page_fonts(data, found), {k: v for one in found.values() for k, v in one.items()}

    def shown(token: bytes, maps: dict[bytes, str]) -> str:
        width = max(map(len, maps), default=2)
        if token.startswith(b"<"):
            digits = re.sub(rb"\s", b"", token[1:-1]).lower()
            digits += b"0" * (-len(digits) % 2)
            step = width if maps else 2
            return "".join(maps.get(digits[i : i + step], "" if maps else bytes.fromhex(digits[i : i + 2].decode()).decode("latin-1")) for i in range(0, len(digits), step))
        plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda e: _ESCAPES.get(e.group(1)) if e.group(1) in _ESCAPES else bytes([int(e.group(1), 8) & 255]) if e.group(1).isdigit() else e.group(1).strip(b"\r\n"), token[1:-1], flags=re.S)
        return plain.decode("utf-16-be", "replace")[1:] if plain.startswith(b"\xfe\xff") else plain.decode("latin-1")

    out = []
    for number, body in streams:
        line, operands, maps = "", [], every
        for m in re.finditer(rb"/[^\s/<>\[\]()]+|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", body, re.S):
            token = m.group()
            if token[:1] == b"/":
                maps = fonts.get(number, {}).get(token[1:], every) if re.match(rb"\s+[-+.\d]+\s+Tf\b", body[m.end() : m.end() + 40]) else maps
            elif token[:1] in b"(<":
                operands.append(shown(token, maps))
            elif re.fullmatch(rb"[-+.\d]+", token):
                operands.append(" " if token.startswith(b"-") and len(token) > 3 and operands and isinstance(operands[-1], str) else 0)
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"') and line:
                    out.append(line)
                    line = ""
                line, operands = line + "".join(x for x in operands if isinstance(x, str)), []
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                if line.strip():
                    out.append(line)
                line, operands = "", []
            elif token not in (b"[", b"]"):
                operands = []
        if line.strip():
            out.append(line)
    return "\n".join(" ".join(x.split()) for x in out)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_files(spark: SparkSession, path: str, extract: Callable[[bytes], str] = pdf_text) -> DataFrame:
    """Documents of PDF files; the extractor is a port."""
    return extracted(binary_files(spark, path).where("refusal is null"), extract, "pdf")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set; an empty one is an error."""
    rows = spark.read.schema("question string, ground_truth string, contexts array<string>, category string").option("multiLine", True).json(path)
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows
