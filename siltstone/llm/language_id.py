"""Language ID by interpolated Kneser-Ney character language models.

Letters are lower-cased and mapped to 63 classes (a to z are classes of their own, other letters share the rest by hash), all else
to a blank, and blanks that follow each other to one. A four-character gram is a 24-bit code. Every task counts the codes of its
texts by language; the counts of all tasks are added up by language and code. From them come the Kneser-Ney probabilities: absolute
discount at the highest order, continuation counts (distinct left neighbours) below. The model is an array of the codes that
any language has seen, sorted by a hash that keeps them apart and looked up from the first one of its leading bits on, with a row of log probabilities, and for shorter contexts full tables. It holds 64**4
codes and 64**3 contexts a language at most, however large the corpus, so it may go to every task.

A text gets the language of the lowest cross-entropy per character. It is rejected (accepted = false) where that cross-entropy is more than
DEVIATIONS standard deviations above the mean of that language's own texts of about its length (powers of two of its characters), where it has no letter, or
where nothing was learned. Means and variances between texts are calibrated on all texts that are learned from; a length with fewer than ENOUGH of a language's texts takes those
of all its lengths. To the variance between texts comes that of a mean of as many
characters as the text has, so little is said of short texts.

The score is the posterior of the language at even priors, of a text of at most 200 characters: a longer one counts as 200 characters of its cross-entropy, since neighbouring
characters are no independent evidence. It changes neither the language nor what is accepted.

Nulls and cases: null, empty and letterless texts are `und` with score 0; rows whose lang is null are not learned from; equal
cross-entropies go to the first language by code point. Without any language learned everything is `und`, rejected, with score 0. Texts of any length are
scored whole, in pieces of PIECE characters that hand on three characters of context. Empty tables give no rows. Other columns are kept unless their names
are those of the results, which win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import text_places, trimmed

CLASSES = 64
ORDER = 4
PIECE = 1 << 19
#: Texts of a language and length that a calibration of their own takes.
ENOUGH = 50
#: Whatever the distribution, fewer than one in 144 of its values lie as far from the mean (Chebyshev).
DEVIATIONS = 12.0
#: Least standard deviation between texts (nats per character), and powers of two of a text's length.
LEAST = 0.05
BINS = 32
_BITS = 6
_MASK3 = CLASSES**3 - 1
_CODES = np.uint32(CLASSES**ORDER - 1)
_FACTOR = 0x9E3779B1
_table: list[np.ndarray] = []


def _hashed(code: np.ndarray) -> np.ndarray:
    """A bijection of the codes that spreads them."""
    return code * np.uint32(_FACTOR) & _CODES


def classes() -> np.ndarray:
    """Class of each code point; 0 is the blank."""
    if not _table:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                x = ord(low[0])
                t[c] = x - 96 if 97 <= x <= 122 else 27 + (x * 2654435761 % 2**32) * 37 // 2**32
        _table.append(t)
    return _table[0]


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owners): for every character class of the texts the code of it and the three before it (blanks before the first), and the
    number of its text. Texts without letters give nothing."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(" ".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = classes()[points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = (k != 0) | np.concatenate(([False], k[:-1] != 0))  # the first blank after letters
    k, owner = k[keep].astype(np.uint32), owner[keep]
    code, before = k.copy(), k
    for j in range(1, ORDER):
        before = np.concatenate((np.zeros(1, np.uint32), before[:-1]))
        before[np.flatnonzero(np.diff(owner, prepend=-1))] = 0
        code |= before << np.uint32(_BITS * j)
    return code, owner


def _coded(texts: list[str | None]):
    """encoded(texts), of one long text piece by piece."""
    if len(texts) > 1 or not texts or len(texts[0] or "") <= PIECE:
        yield encoded(texts)
        return
    tail = np.zeros(ORDER - 1, np.uint32)
    for at in range(0, len(texts[0]), PIECE):
        piece = texts[0][at : at + PIECE] + (" " if at + PIECE >= len(texts[0]) else "")
        k = classes()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        k = np.concatenate((tail, k[(k != 0) | np.concatenate(([tail[-1] != 0], k[:-1] != 0))].astype(np.uint32)))
        n, code = len(k) - len(tail), np.zeros(len(k) - len(tail), np.uint32)
        for j in range(ORDER):
            code |= k[ORDER - 1 - j : ORDER - 1 - j + n] << np.uint32(_BITS * j)
        tail = k[-(ORDER - 1) :]
        yield code, np.zeros(n, np.int64)


def count(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n) over all rows for which learn holds."""

    def tally(batches):
        sums: dict[str, list] = {}

        def out():
            for name, parts in sums.items():
                codes, n = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

        for batch in batches:
            for a, b in text_places(batch.column(0)):
                langs = np.array(batch.column(1).slice(a, b - a).to_pylist(), object)
                for code, owner in _coded(batch.column(0).slice(a, b - a).to_pylist()):
                    for name in set(langs):
                        mine = np.sort(code[(langs == name)[owner]])
                        if len(mine):
                            at = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                            parts = sums.setdefault(name, [])
                            parts.append((mine[at].astype(np.int32), np.diff(np.append(at, len(mine)))))
                            if len(parts) > 32:
                                sums[name] = [_merged(parts)]
        yield from out()

    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
    return rows.mapInArrow(trimmed(tally), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Model:
    """Kneser-Ney models of all languages, of counts as `count` gives them."""

    def __init__(self, langs: np.ndarray, codes: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        self.hashes = np.sort(_hashed(np.unique(codes).astype(np.uint32)))
        self.codes = (self.hashes * np.uint32(pow(_FACTOR, -1, CLASSES**ORDER)) & _CODES).astype(np.int64)  # in the order of their hashes
        self.shift = np.uint32(max(0, 24 - (len(self.codes).bit_length() + 1)))
        self.first = np.searchsorted(self.hashes, np.arange((CLASSES**ORDER >> int(self.shift)) + 1, dtype=np.uint64) << np.uint64(self.shift)).astype(np.int32)
        self.ended = np.append(self.hashes, np.uint32(CLASSES**ORDER))
        self.full = np.zeros((len(self.codes), len(self.langs)), np.float32)
        self.low = np.zeros((CLASSES**3, len(self.langs)), np.float32)  # log p of the three-character gram
        self.back = np.zeros((CLASSES**3, len(self.langs)), np.float32)  # log weight of the shorter context
        self.mean, self.between = (np.zeros((BINS, len(self.langs))) for _ in range(2))  # cross-entropies of own texts by length
        self.within = np.zeros(len(self.langs))  # variance of a character's
        for i, name in enumerate(self.langs):
            mine = langs == name
            self._learn(i, codes[mine].astype(np.int64), n[mine].astype(np.float64))

    def _learn(self, i: int, codes: np.ndarray, n: np.ndarray) -> None:
        def discount(x):
            one, two = (x == 1).sum(), (x == 2).sum()
            return one / (one + 2 * two) if one and two else 0.5

        # Continuation counts: distinct left neighbours of each shorter gram.
        grams, counts = [codes], [n]
        for k in range(ORDER - 1, 0, -1):
            g, c = np.unique(grams[0] & (CLASSES**k - 1), return_counts=True)
            grams.insert(0, g)
            counts.insert(0, c.astype(np.float64))
        p = np.full(1, 1 / CLASSES)  # of the empty context's characters, evenly
        for k in range(1, ORDER + 1):
            g, c = grams[k - 1], counts[k - 1]
            context = g >> _BITS
            d = discount(c)
            total = np.bincount(context, c, CLASSES ** (k - 1))
            kinds = np.bincount(context, None, CLASSES ** (k - 1))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            if k < ORDER:
                every = np.arange(CLASSES**k)
                seen = np.zeros(CLASSES**k)
                seen[g] = np.maximum(c - d, 0) / total[context]
                lower = p[0] if k == 1 else p[every & (CLASSES ** (k - 1) - 1)]
                p = seen + weight[every >> _BITS] * lower
        self.low[:, i], self.back[:, i] = np.log(p), np.log(weight)
        self.full[:, i] = self.back[self.codes >> _BITS, i] + self.low[self.codes & _MASK3, i]
        at = self.places(codes.astype(np.uint32))
        own = np.log(np.maximum(n - d, 0) / total[context] + weight[context] * p[codes & _MASK3])
        self.full[at, i] = own
        self.within[i] = (n * own**2).sum() / n.sum() - ((n * own).sum() / n.sum()) ** 2

    def rows(self, code: np.ndarray) -> np.ndarray:
        """Log probabilities of codes by language, looked up in the sorted array; codes that no language has back off."""
        if not len(self.codes):
            return np.zeros((len(code), len(self.langs)), np.float32)
        at = self.places(code.astype(np.uint32))
        out = self.full[at]
        new = np.flatnonzero(at < 0)
        out[new] = self.back[code[new] >> _BITS] + self.low[code[new] & _MASK3]
        return out

    def places(self, code: np.ndarray) -> np.ndarray:
        """Places of codes in the array, -1 for those that no language has."""
        h = _hashed(code)
        at = self.first[h >> self.shift]
        behind = np.flatnonzero(self.ended[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.ended[at[behind]] < h[behind]]
        at[self.ended[at] != h] = -1
        return at

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character by text and language, characters)."""
        sums, chars = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for code, owner in _coded(texts):
            if len(code):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                sums[owner[first]] += np.add.reduceat(self.rows(code), first, axis=0, dtype=np.float64)
                chars[owner[first]] += np.diff(np.append(first, len(owner)))
        return -sums / np.maximum(chars, 1)[:, None], chars

    def calibrate(self, lang: np.ndarray, size: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> None:
        """Sets what is accepted from sums over the languages' own texts by length: numbers of texts, sums and sums of squares of cross-entropies."""
        for i, name in enumerate(self.langs):
            x = np.zeros((3, BINS))
            for k, v in enumerate((n, total, squares)):
                np.add.at(x[k], size[lang == name], v[lang == name])
            x = np.where(x[0] >= ENOUGH, x, x.sum(1, keepdims=True))
            mean = x[1] / np.maximum(x[0], 1)
            self.mean[:, i] = np.where(x[0] > 0, mean, np.inf)
            self.between[:, i] = np.maximum(x[2] / np.maximum(x[0], 1) - mean**2, LEAST**2)

    def accepted(self, h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Of cross-entropies: whether a text is one of its best language as far as its length lets tell."""
        if not self.langs:
            return np.zeros(len(h), bool)
        best, size = h.argmin(axis=1), bins(chars)
        deviation = np.sqrt(self.between[size, best] + self.within[best] / np.maximum(chars, 1))
        return (chars > 0) & (h[np.arange(len(h)), best] <= self.mean[size, best] + DEVIATIONS * deviation)


def bins(chars: np.ndarray) -> np.ndarray:
    """Number of a text's length: powers of two."""
    return np.minimum(np.log2(np.maximum(chars, 1)).astype(np.int64), BINS - 1)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """Models of the languages of all rows for which learn holds, calibrated on all of them."""
    found = count(docs, learn, text, lang).toPandas()  # 64**4 rows a language at most
    model = Model(found["lang"].to_numpy(object), found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        m = shared.value
        place = {name: i for i, name in enumerate(m.langs)}
        for batch in batches:
            for a, b in text_places(batch.column(0)):
                h, chars = m.cross_entropies(batch.column(0).slice(a, b - a).to_pylist())
                own = np.array([place.get(x, -1) for x in batch.column(1).slice(a, b - a).to_pylist()])
                some = (chars > 0) & (own >= 0)
                own, size, h = own[some], bins(chars[some]), h[some, own[some]]
                kinds, back = np.unique(own * BINS + size, return_inverse=True)
                sums = [np.bincount(back, x, len(kinds)) for x in (np.ones(len(h)), h, h * h)]
                yield pa.RecordBatch.from_arrays([pa.array([m.langs[k // BINS] for k in kinds], pa.string()), pa.array(kinds % BINS, pa.int32()), *(pa.array(x, pa.float64()) for x in sums)], names=["lang", "size", "n", "total", "squares"])

    if model.langs:
        sums = rows.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(trimmed(measured), "lang string, size int, n double, total double, squares double").groupBy("lang", "size").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).toPandas()  # BINS rows a language at most
        model.calibrate(sums["lang"].to_numpy(object), sums["size"].to_numpy(np.int64), *(sums[c].to_numpy(float) for c in ("n", "total", "squares")))
    shared.destroy()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (of their columns those in keep, all by default) with lang_pred, score (posterior of the language, 0 to 1), accepted and cross_entropy (null without letters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = {"lang_pred", "score", "accepted", "cross_entropy"}
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
    at_text = [c.lower() for c in rows.columns].index(text.lower())
    kept = [i for i, c in enumerate(rows.columns) if keep is None or c in keep]

    def predict(batches):
        m = shared.value
        for a, b, batch in ((a, b, batch) for batch in batches for a, b in text_places(batch.column(at_text))):
            batch = batch.slice(a, b - a)
            h, chars = m.cross_entropies(batch.column(at_text).cast(pa.string()).to_pylist())
            n = len(chars)
            ok = (chars > 0) & bool(m.langs)
            if m.langs:
                best = h.argmin(axis=1)
                least = h[np.arange(n), best]
                odds = np.exp(-(h - least[:, None]) * np.minimum(chars, 200)[:, None])
                score, accepted = np.where(ok, 1 / odds.sum(axis=1), 0.0), m.accepted(h, chars)
            else:
                best, least, score, accepted = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            pred = [m.langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_()), pa.array(least, pa.float64(), mask=~ok)],
                names=[*(batch.schema.names[i] for i in kept), "lang_pred", "score", "accepted", "cross_entropy"],
            )

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())]
    return rows.mapInArrow(predict, T.StructType([*(rows.schema.fields[i] for i in kept), *more]))


def held_out(doc_id: str = "doc_id", fold: int = 0) -> Column:
    """crc32 of doc_id as text, modulo 5, equals fold; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == fold


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, accepted, cross_entropy, held_out: learns from the rows that are not held out, identifies all."""
    model = fit(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).withColumn("held_out", held_out())


def known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected; the columns stay as they are. Nothing is held out here: all rows with a language are learned from."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, F.lit(True)))
    at_text = [c.lower() for c in docs.columns].index("text")

    def keep(batches):
        m = shared.value
        for batch in batches:
            for a, b in text_places(batch.column(at_text)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(m.accepted(*m.cross_entropies(part.column(at_text).cast(pa.string()).to_pylist())), pa.bool_()))

    return docs.mapInArrow(trimmed(keep), docs.schema)
