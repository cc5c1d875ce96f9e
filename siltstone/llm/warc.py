"""WARC archives: a writer with revisit records, and a salvage reader.

Every task writes one archive of gzip members, a record each, to the shared folder, under a name of its attempt; the manifest names the files of the attempts
that counted. The reader streams an archive in blocks. A member that fails (bad deflate data or
CRC, a bad header, a length that does not fit, a payload digest that does not match) is given up at its own start; from the next byte on the
reader searches for the next gzip member, or the next `WARC/` version line where records are not compressed, that gives a valid
record, and goes on there. What lies between is logged as a quarantined gap (file, first byte, byte after the last, reason), never dropped in silence.
A record's length is believed only where a record ends after it, which is looked up in the file before anything is read, so a false one costs no memory.

Nulls: null html is an empty payload, null url leaves the target out, a null page_id goes without its header and comes back null.
Repeated page_ids are read back row by row; of equal payloads all rows with the smallest page_id are responses. Empty tables
give no archives and no rows. Other columns are ignored. Payloads and urls of any length are held one at a time. Of a damaged header, lengths of other than 1 to 18 ASCII
digits are a gap, and page ids beyond 64 bits are null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import saved, work_dir

VERSION = b"WARC/1.0"
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, at long"
_GAPS = "file string, first long, past long, reason string"


def opened(uri: str):
    """(file system, path) of a file:, hdfs:, s3: or gs: address, from any executor."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "file://", uri) if uri.startswith("file:") else f"file://{uri}")


# --- writing --------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, sha1: str, refers_to=None) -> bytes:
    """One record; a revisit (refers_to given) carries headers only, with the digest and length of the full payload."""
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    block = payload if refers_to is None else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, compressed: bool = True) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest (file, records, bytes). The decisions who is a response are a
    narrow table (SHA-1, length and SHA-256 of the payload, smallest page_id), so a payload made to have another's SHA-1 is not taken for it; only that is
    aggregated, and AQE can split a digest that many rows share."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    same = ["sha1", "sha256", "size"]
    pages = pages.withColumns({"sha1": F.sha1("payload"), "sha256": F.unhex(F.sha2("payload", 256)), "size": F.length("payload")})
    first = pages.where(F.col("size") >= least_bytes).groupBy(*same).agg(F.min("page_id").alias("first"))
    rows = pages.join(first, same, "left").withColumn("refers", F.expr(f"if(size < {least_bytes} or page_id <=> first, null, first)"))

    def write(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc" + ".gz" * compressed
        n = size = 0
        out = None
        for batch in batches:
            for page_id, url, payload, sha1, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers")), strict=True):
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers)
                data = member(data) if compressed else data
                out = out or fs.open_output_stream(name, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    return rows.select("page_id", "url", "payload", "sha1", "refers").mapInArrow(write, "file string, records long, bytes long")


# --- reading --------------------------------------------------------------------------------


class Window:
    """Bytes of a file from `at` on, read in blocks; what lies before `at` is let go."""

    def __init__(self, file, block: int = BLOCK):
        self.file, self.block, self.start, self.data, self.ended = file, block, 0, bytearray(), False

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(self.block)
        self.ended = not got
        self.data += got
        return bool(got)

    def peek(self, at: int, n: int) -> bytes:
        """n bytes from `at` on, read past what lies between; fewer at the file's end."""
        if at + n <= self.start + len(self.data):
            return bytes(self.data[at - self.start : at - self.start + n])
        here = self.file.tell()
        try:
            self.file.seek(0, 2)
            if at > self.file.tell():
                return b""
            self.file.seek(at)
            return self.file.read(n)
        finally:
            self.file.seek(here)

    def drop(self, to: int) -> None:
        if to - self.start >= self.block or to - self.start == len(self.data):
            del self.data[: to - self.start]
            self.start = to

    def find(self, what: tuple[bytes, ...], at: int) -> tuple[int, bytes] | None:
        """The first place from `at` on where one of `what` stands; lets go of what it has passed over."""
        longest = max(map(len, what))
        while True:
            hits = [(i, w) for w in what if (i := self.data.find(w, at - self.start)) >= 0]
            if hits and (min(hits)[0] + longest <= len(self.data) or self.ended):
                return min(hits)[0] + self.start, min(hits)[1]
            if not hits and len(self.data) - (at - self.start) > longest:
                at = self.start + len(self.data) - longest
                self.drop(at)
            if not self.more() and self.ended:
                hits = [(i, w) for w in what if (i := self.data.find(w, at - self.start)) >= 0]
                return (min(hits)[0] + self.start, min(hits)[1]) if hits else None


class Bad(ValueError):
    pass


def _parse(data: bytes, exact: bool) -> tuple[dict, bytes, int]:
    """(headers, block, bytes used) of the record that data begins with; exact: data must hold nothing else."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        raise Bad("no record header")
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Bad("bad header line")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise Bad("no content length")
    past = end + 4 + int(size)
    if data[past : past + 4] != b"\r\n\r\n" or exact and len(data) != past + 4:
        raise Bad("length does not fit")
    block = bytes(data[end + 4 : past])
    if head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha1:") and head["warc-payload-digest"][5:] != digest(block):
        raise Bad("payload digest differs")
    return head, block, past + 4


def _member(w: Window, at: int) -> tuple[bytes, int]:
    """(content, next byte) of the gzip member at `at`."""
    z, out, i = zlib.decompressobj(31), [], at
    while not z.eof:
        if i - w.start >= len(w.data) and not w.more():
            raise Bad("file ends within a member")
        chunk = bytes(w.data[i - w.start : i - w.start + BLOCK])
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            raise Bad(f"member: {e}") from None
        i += len(chunk) - len(z.unused_data)
    return b"".join(out), i


def _plain(w: Window, at: int) -> tuple[dict, bytes, int]:
    """The uncompressed record at `at`."""
    seen = at - w.start
    while (end := w.data.find(b"\r\n\r\n", seen)) < 0:
        seen = max(seen, len(w.data) - 3)
        if not w.more():
            raise Bad("file ends within a header")
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})\s*\r\n", bytes(w.data[at - w.start : end + 4]))
    if not m:
        raise Bad("no content length")
    need = end + 4 + int(m[1]) + 4
    if w.peek(w.start + need - 4, 4) != b"\r\n\r\n":
        raise Bad("length does not fit")
    while len(w.data) < need:
        if not w.more():
            raise Bad("file ends within a record")
    head, block, used = _parse(bytes(w.data[at - w.start : need]), True)
    return head, block, at + used


def read_archive(file, block: int = BLOCK) -> Iterator[tuple]:
    """("record", first byte, headers, block) and ("gap", first byte, byte after the last, reason), in the file's order."""
    w = Window(file, block)
    at, lost, why = 0, None, ""
    while True:
        while len(w.data) - (at - w.start) < len(VERSION) and w.more():
            pass
        here = bytes(w.data[at - w.start : at - w.start + 5])
        if not here:
            break
        try:
            if here.startswith(MAGIC):
                data, past = _member(w, at)
                head, payload, _ = _parse(data, True)
            elif here.startswith(b"WARC/"):
                head, payload, past = _plain(w, at)
            else:
                raise Bad("neither a member nor a version line")
        except Bad as e:
            if lost is None:
                lost, why = at, str(e)
            hit = w.find((MAGIC, b"WARC/"), at + 1)
            if hit is None:
                yield "gap", lost, w.start + len(w.data), why
                return
            at = hit[0]
            w.drop(at)
            continue
        if lost is not None:
            yield "gap", lost, at, why
            lost = None
        yield "record", at, head, payload
        at = past
        w.drop(at)
    if lost is not None:
        yield "gap", lost, at, why


def _number(head: dict, key: str) -> int | None:
    said = head.get(key, "")
    return int(said) if re.fullmatch("-?[0-9]{1,19}", said) and -(1 << 63) <= int(said) < 1 << 63 else None


def read_archives(files: DataFrame, gaps: bool = False, payloads: bool = True) -> DataFrame:
    """The records of the archives named in files (file: string), or with gaps=True their quarantined byte gaps. A task holds one
    block of an archive and one record at a time."""

    def rows(names: list[str], out: list, most: int):
        for name in names:
            fs, path = opened(name)
            with fs.open_input_file(path) as f:
                size = 0
                for kind, at, *x in read_archive(f):
                    if gaps:
                        if kind == "gap":
                            out.append((name, at, *x))
                    elif kind == "record":
                        head, payload = x
                        kept = head.get("warc-type")
                        url = head.get("warc-target-uri")
                        url = None if url is None else re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), url)
                        n = _number(head, "warc-payload-length") if kept == "revisit" else len(payload)
                        out.append((_number(head, "warc-page-id"), url, n, head.get("warc-payload-digest", "").removeprefix("sha1:"), kept, _number(head, "warc-refers-to-page-id"), payload if payloads else None, name, at))
                        size += len(payload) if payloads else 0
                    if len(out) >= 5000 or size > most:
                        yield True
                        size = 0
        yield True

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()] if gaps else [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in (_GAPS if gaps else _RECORDS).split(", ")]

    def read(batches):
        for batch in batches:
            out: list = []
            for _ in rows(batch.column("file").to_pylist(), out, 16 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                out.clear()

    return files.select("file").mapInArrow(read, _GAPS if gaps else _RECORDS)


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest's files dealt out, one to a task as far as partitions go."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "file")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back."""
    path = work_dir(spark, "warc")
    manifest = saved(write_archives(pages, f"{path}/archives", least_bytes), f"{path}/manifest")
    return read_archives(spread(manifest), payloads=False)
