"""SentencePiece encoding and decoding of whole texts by a shared-prefix Viterbi search.

The text, with blanks as marks and one mark in front, falls apart into marked words, which no piece of the model crosses (that is checked
when a model is read). The distinct words of a run of texts are sorted, which lays them out as a trie, and traversed depth-first:
the forward state of every prefix is computed once and shared by all words that begin with it.

For a Unigram model the state of a prefix is its best score and the last piece of the path that has it (of equal scores the longest last piece). For a
BPE model, the one at hand, the best path by scores is not the tokenizer's answer, and the state is
the last piece of the prefix's segmentation: among the pieces that end there only one is compatible with the state before it (the two, merged
by themselves, stay as they are), and that sequence is the one that merging by rank gives. Ids equal those of the
sentencepiece library (for a Unigram model up to paths of equal scores, between which its rounding over the whole text decides); a model of any other type
is refused. Characters outside the vocabulary become byte pieces. Decoding joins the pieces, decodes
bytes as UTF-8 and takes the first mark away.

A worker keeps words of about CACHED bytes at most between runs of texts, however long the words are; each text is encoded whole, in runs of about a slice.

Nulls and cases: null text gives null ids and null text back; empty text gives no ids. A mark (U+2581) in a text reads as a blank, as in the library; all
other texts come back exactly. Repeated rows are encoded alike. Empty tables give no rows. Other columns are kept unless their
names are those of the results, which win.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import SLICE, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of known words and their ids, reckoned at WORD for each and LETTER for each of its characters.
CACHED = 64 << 20
WORD, LETTER = 216, 8
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


UNIGRAM, BPE = 1, 2
_PENALTY = 10.0  # of a character outside the vocabulary, below the lowest score


def _fields(data: bytes):
    """(number, value) of a serialised message's fields: numbers, or bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def model_type(model: bytes) -> int:
    """1 Unigram (where nothing is said), 2 BPE, 3 words, 4 characters."""
    trainer = next((v for k, v in _fields(model) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)


class Pieces:
    """A BPE or Unigram model with byte fallback, without a normaliser of its own."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.kind = model_type(model)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model is neither BPE nor Unigram")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                self.byte_id[int(piece[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            elif sp.is_unused(i):
                self.bytes.append(piece.replace(MARK, " ").encode())
            else:
                self.id[piece], self.rank[piece] = i, sp.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses a word's mark or a line break")
        if not all(self.byte_id) or sp.encode("a  b ", out_type=str)[0][:1] != MARK or sp.decode(sp.encode("Aﬁ  b ")) != "Aﬁ  b ":
            raise ValueError("the model has no byte fallback, or normalises texts")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.sizes = [len(x) for x in self.text]
        # Every suffix of a piece, with the piece's number where it is one.
        self.ends: dict[str, int] = {}
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                self.ends.setdefault(piece[k:], -1)
            self.ends[piece] = i
        self.runs: dict[str, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def run(self, piece: str) -> tuple:
        """How merging builds a piece from its characters: ranks of the merges in their order, first and last parts before each
        merge and at the end, and whether all of it becomes one part."""
        got = self.runs.get(piece)
        if got is None:
            parts, ranks = list(piece), []
            firsts, lasts = [parts[0]], [parts[-1]]
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.rank.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r > best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                ranks.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            got = self.runs[piece] = (ranks, firsts, lasts, len(parts) == 1)
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging pieces a and b together leaves them apart: no merge across is ever the best one at hand (leftmost among
        equals). Numbers from the vocabulary's size on are characters outside it; a below 0 is the beginning of the word."""
        n = len(self.bytes)
        if a < 0 or a >= n or b >= n:
            ok = b >= n or self.run(self.text[b])[3]
        else:
            (ra, _, lasts, whole), (rb, firsts, _, other) = self.run(self.text[a]), self.run(self.text[b])
            ok, i, j, none = whole and other, 0, 0, float("-inf")
            while ok:
                across = self.rank.get(lasts[i] + firsts[j], none)
                x, y = ra[i] if i < len(ra) else none, rb[j] if j < len(rb) else none
                if across > none and across > x and across >= y:
                    ok = False
                elif x == y == none:
                    break
                elif x >= y:
                    i += 1
                else:
                    j += 1
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a << 21 | b] = ok
        return ok

    def search(self, words: list[str]):
        return self._viterbi(words) if self.kind == UNIGRAM else self._merges(words)

    def _viterbi(self, words: list[str]):
        """(word, ids as bytes) of sorted distinct words by a Unigram model: a depth-first walk of their trie that keeps the forward scores of
        the prefixes of the word at hand."""
        score, last = [0.0], [-1]
        before, ends, sizes, vocabulary = "", self.ends.get, self.sizes, len(self.bytes)
        rank = {i: self.rank[piece] for piece, i in self.id.items()}
        unknown = min(rank.values(), default=0.0) - _PENALTY
        for w in words:
            n, depth = len(w), 0
            most = min(n, len(before))
            while depth < most and w[depth] == before[depth]:
                depth += 1
            del score[depth + 1 :], last[depth + 1 :]
            for i in range(depth + 1, n + 1):
                best, piece = float("-inf"), -1
                if w[i - 1] not in self.id:
                    best, piece = score[i - 1] + unknown, vocabulary + ord(w[i - 1])
                for start in range(i - 1, -1, -1):
                    k = ends(w[start:i])
                    if k is None:
                        break
                    if k >= 0 and (s := score[start] + rank[k]) >= best:  # of equals the longest
                        best, piece = s, k
                score.append(best)
                last.append(piece)
            before = w
            yield w, self._path(w, last, sizes, vocabulary)

    def _path(self, w: str, last: list[int], sizes: list[int], vocabulary: int) -> bytes:
        """Ids of a word from the last pieces of its prefixes."""
        out, i = [], len(w)
        while i:
            k = last[i]
            if k < vocabulary:
                out.append(k)
                i -= sizes[k]
            else:
                i -= 1
                out.extend(self.byte_id[b] for b in reversed(w[i].encode("utf-8", "surrogatepass")))
        out.reverse()
        return array("i", out).tobytes()

    def _merges(self, words: list[str]):
        """The same by a BPE model; the walk keeps the last pieces of the prefixes' segmentations."""
        last = [-1]  # the last piece of the segmentation of every prefix of the word at hand
        before, ends, fits, sizes, vocabulary = "", self.ends.get, self.fits.get, self.sizes, len(self.bytes)
        for w in words:
            n, depth = len(w), 0
            most = min(n, len(before))
            while depth < most and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :]
            for i in range(depth + 1, n + 1):
                found = []
                for start in range(i - 1, -1, -1):
                    k = ends(w[start:i])
                    if k is None:
                        break
                    if k >= 0:
                        found.append(k)
                while found:  # the longest first
                    k = found.pop()
                    a = last[i - sizes[k]]
                    ok = fits(a << 21 | k)
                    if ok is None:
                        ok = self.compatible(a, k)
                    if ok:
                        break
                else:  # a character outside the vocabulary
                    k = vocabulary + ord(w[i - 1])
                last.append(k)
            before = w
            yield w, self._path(w, last, sizes, vocabulary)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        units = [None if t is None else self.units(t) for t in texts]
        known = self.known
        new = set().union(*(us for us in units if us)) - known.keys()
        cost = WORD * len(new) + LETTER * sum(map(len, new))
        if self.held + cost > CACHED:
            known.clear()
            new = set().union(*(us for us in units if us))
            self.held, cost = 0, WORD * len(new) + LETTER * sum(map(len, new))
        known.update(self.search(sorted(new)))
        self.held += cost
        of = known.__getitem__
        out = [None if us is None else np.frombuffer(b"".join(map(of, us)), np.int32) for us in units]
        if self.held > CACHED:  # this run's words alone are too many to keep
            known.clear()
            self.held = 0
        return out

    @staticmethod
    def units(t: str) -> list[str]:
        """What no piece crosses: marked words, and what follows a line break up to the next mark."""
        if not t:
            return []
        if "  " in t or t[0] == " " or MARK in t or "\0" in t:
            return _UNITS.findall(MARK + t.replace(" ", MARK))
        return (MARK + t.replace(" ", "\0" + MARK).replace("\n", "\0\n")).split("\0")

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_read: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The model, read once in a worker."""
    if model not in _read:
        _read.clear()
        _read[model] = Pieces(model)
    return _read[model]


def _runs(texts: list[str | None]):
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > 4 * SLICE:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _column(found: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([x is None for x in found] + [False]))
    values = [x for x in found if x is not None]
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:  # read by the driver alone; executors get the bytes (under a megabyte)
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """docs (of their columns those in keep, all by default) with ids and n_tokens; check adds round_trip: the ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = {ids.lower(), "n_tokens", "round_trip"}
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
    at_text = [c.lower() for c in rows.columns].index(text.lower())
    kept = [i for i, c in enumerate(rows.columns) if keep is None or c in keep]
    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *[T.StructField("round_trip", T.BooleanType())] * check]
    schema = T.StructType([*(rows.schema.fields[i] for i in kept), *more])

    def run(batches):
        p = pieces(shared.value)
        for batch in batches:
            column = batch.column(at_text)
            for a, b in _runs(column.to_pylist()):
                texts = column.slice(a, b - a).to_pylist()
                found = p.encode(texts)
                out = [*(batch.column(i).slice(a, b - a) for i in kept), _column(found), pa.array([None if x is None else len(x) for x in found], pa.int64())]
                if check:
                    out.append(pa.array([None if t is None else p.decode(x.tolist()) == t.replace(MARK, " ") for t, x in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text that ids stand for (null for null ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()))
    at = [c.lower() for c in rows.columns].index(ids.lower())
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        p = pieces(shared.value)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
