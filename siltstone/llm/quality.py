"""Quality classifier from weak labels.

Nine overlapping heuristic labellers vote good, bad or nothing on every document. Votes are counted by pattern over all documents (3**9
patterns at most), and expectation-maximisation (Dawid and Skene, 1979) estimates from the pattern counts how often each labeller, where it votes, votes what on
good and on bad documents; no true label is used. The posteriors of the patterns then train a linear scorer over hashed features of
the words (word, shape, pair of shapes, repetition), on at most 2 * SAMPLE documents, the first by a hash of doc_id and text; executors turn them into counts
of features (FEATURES numbers a document at most, however long its text), and the scorer judges every whole document.

Nulls and cases: null, empty and blank texts have no words, score 0 and are not kept. Ties cannot arise: equal documents get equal
scores. Repeated rows are judged alike; a null doc_id is drawn and judged as any other. Copies with doc_ids of their own are drawn like other documents;
rows that are equal in doc_id and text tie in the draw, where any of them gives the same sample. Empty tables give no rows. Where all
documents get the same posterior the scorer learns a constant. Other columns are kept unless their names are those of the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import _SPACE, hashed_words, mix, text_runs, trimmed

#: Documents that the scorer is trained on, about (twice as many at most).
SAMPLE = 4000
FEATURES = 1 << 15
ROUNDS = 80
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "repetition", "variety", "bare_symbols", "sentences", "length", "marked_words", "word_length")

_codes = np.arange(256)
_UPPER = (_codes >= 65) & (_codes <= 90)
_LETTER = _UPPER | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
_DIGIT = (_codes >= 48) & (_codes <= 57)
_STOP = np.isin(_codes, np.frombuffer(b".,;:?!'\"()-", np.uint8))
_SYMBOL = (_codes > 32) & (_codes < 127) & ~_LETTER & ~_DIGIT & ~_STOP
_END = np.isin(_codes, np.frombuffer(b".?!", np.uint8))
_LAST = np.select([_LETTER, _DIGIT, _STOP, _SYMBOL], [0, 1, 2, 3], 4)


class Words:
    """Words of some texts with what labellers and features need."""

    def __init__(self, texts: list[bytes | None]):
        self.hashes, self.offsets = hashed_words(texts)
        a = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[a].view(np.int8), prepend=1, append=1))
        s, e = edge[::2], edge[1::2]
        within = lambda what: (c := np.concatenate(([0], np.cumsum(what[a], dtype=np.int32))))[e] - c[s]
        self.length, self.upper, self.symbol, self.letter = e - s, within(_UPPER), within(_SYMBOL), within(_LETTER)
        self.ends = _END[a[e - 1]] if len(e) else np.zeros(0, bool)
        self.last = _LAST[a[e - 1]] if len(e) else np.zeros(0, int)
        self.first_upper = _UPPER[a[s]] if len(s) else np.zeros(0, bool)
        self.n = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        self.again = np.concatenate(([False], (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1]))) if len(s) else np.zeros(0, bool)

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, x, len(self.n))

    def votes(self) -> np.ndarray:
        """Votes of the labellers (columns) on the texts (rows)."""
        n = np.maximum(self.n, 1)
        size, letters = np.maximum(self.total(self.length), 1), np.maximum(self.total(self.letter), 1)
        order = np.lexsort((self.hashes, self.owner))
        h, o = self.hashes[order], self.owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.zeros(0, bool)
        kinds = np.bincount(o[new], minlength=len(self.n))
        ends = self.total(self.ends) / n
        vote = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
        share = lambda x: self.total(x) / n
        columns = (
            vote((x := self.total(self.symbol) / size) > 0.04, x < 0.01),
            vote((x := self.total(self.upper) / letters) > 0.25, x < 0.1),
            vote((x := share(self.again)) > 0.08, x < 0.02),
            vote((x := kinds / np.minimum(n, 400)) < 0.3, (x > 0.5) & (self.n >= 20)),
            vote((x := share((self.letter == 0) & (self.symbol > 0))) > 0.08, x < 0.01),
            vote((ends < 1 / 80) & (self.n >= 40), (ends > 1 / 40) & (ends < 1 / 3) & (self.n >= 10)),
            vote(self.n < 1, self.n >= 60),
            vote((x := share((self.letter > 0) & (self.symbol > 0))) > 0.08, x < 0.01),
            vote(((x := size / n) > 14) | (x < 2), (x > 3.5) & (x < 9)),
        )
        return np.stack(columns, 1)

    def features(self) -> np.ndarray:
        """Hashed features of every word (four columns)."""
        symbols = np.minimum(self.symbol, 2)
        shape = np.minimum(self.length, 15) + 16 * (self.first_upper + 2 * (self.upper == self.letter) * (self.letter > 1) + 4 * symbols + 12 * self.last)
        shape = shape.astype(np.uint64)
        before = np.concatenate((np.zeros(1, np.uint64), shape[:-1])) if len(shape) else shape
        before[self.offsets[:-1][self.n > 0]] = 0  # a text's first word has none before it
        columns = (self.hashes, mix(shape + np.uint64(1 << 40)), mix(shape * np.uint64(4096) + before + np.uint64(1 << 41)), mix(self.again.astype(np.uint64) + np.uint64(1 << 42)))
        return np.stack([(c & np.uint64(FEATURES - 1)).astype(np.int32) for c in columns], 1)

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        """Probability of good for each text; 0 without words."""
        z = self.total(w[self.features()].sum(1)) / np.maximum(self.n, 1) + bias
        return np.where(self.n > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0)


def _patterns(batches):
    """(pattern, n): the base-3 number of a document's votes, counted by batch."""
    for batch in batches:
        found = [Words(texts).votes() @ 3 ** np.arange(len(LABELLERS)) for _, _, texts in text_runs(batch.column(0))]
        p, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, labellers' vote probabilities [labeller, class, vote], share of good) by expectation-maximisation,
    from the majority's votes on."""
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    q = (good + 1) / (good + 2.0 * bad + 2)
    hot = np.stack([votes == v for v in range(3)], 2).astype(float)  # pattern, labeller, vote
    for _ in range(rounds):
        w = np.stack([(1 - q) * n, q * n])  # class, pattern
        p = np.einsum("cp,plv->lcv", w, hot) + 0.1
        p[:, :, NONE] = 0  # whether a labeller votes at all tells nothing about the class
        p /= p.sum(2, keepdims=True)
        p[:, :, NONE] = 1
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        logs = np.einsum("plv,lcv->pc", hot, np.log(p)) + np.log(prior)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return q, p, float(prior[1])


def _counted(batches):
    """(draw, pattern, n, features, counts) of a sample's documents: their numbers of words, and how often each feature stands in them."""
    for batch in batches:
        for a, b, texts in text_runs(batch.column(1)):
            x = Words(texts)
            f, patterns = x.features(), (x.votes() @ 3 ** np.arange(len(LABELLERS))).astype(np.int64)
            kinds, counts = [], []
            for i, j in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True):
                k, c = np.unique(f[i:j], return_counts=True)
                kinds.append(k.astype(np.uint16).tobytes())
                counts.append(c.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(patterns), pa.array(x.n.astype(np.int64)), pa.array(kinds, pa.binary()), pa.array(counts, pa.binary())], names=["draw", "pattern", "n", "features", "counts"])


def train(features: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray, goodness: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic scorer for soft labels, by Adam over the whole sample: of each document the features, their counts
    and the number of words."""
    w, bias = np.zeros(FEATURES), 0.0
    f = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), [len(x) for x in features]).astype(np.int64)
    share = np.concatenate([*counts, np.zeros(0)]) / np.maximum(n, 1)[owner]
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    total = max(1, int((n > 0).sum()))
    for step in range(1, ROUNDS + 1):
        z = np.bincount(owner, w[f] * share, len(n)) + bias
        d = np.where(n > 0, 1 / (1 + np.exp(-z)) - goodness, 0) / total
        g = np.append(np.bincount(f, d[owner] * share, FEATURES) + 1e-7 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs (of their columns those in keep, all by default) with weak_good (posterior of good by the labellers' votes), quality (the scorer's
    probability of good) and kept (quality >= 0.5)."""
    only = docs.select(F.col(text).cast("string").alias("text"))
    counts = only.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")  # sums in one order give the same model every time
    patterns, n = counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    posterior, _, _ = estimate(patterns, n)
    of = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    share = min(1.0, sample / max(1, n.sum()))
    key = [F.col(f"`{c}`") for c in docs.columns if c.lower() in ("doc_id", text.lower())]
    draw = F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(1 << 62))
    drawn = docs.select(draw.alias("draw"), F.col(text).cast("string").alias("text")).where(F.col("draw") < int(share * (1 << 62)))
    drawn = drawn.mapInArrow(trimmed(_counted), "draw long, pattern long, n long, features binary, counts binary").orderBy("draw", "pattern", "n", "features", "counts").limit(2 * sample).toPandas()
    w, bias = train([np.frombuffer(x, np.uint16) for x in drawn["features"]], [np.frombuffer(x, np.float32) for x in drawn["counts"]], drawn["n"].to_numpy(np.int64), np.array([of.get(p, 0.5) for p in drawn["pattern"].tolist()]))
    model = docs.sparkSession.sparkContext.broadcast((of, w.astype(np.float32), bias))
    taken = {"weak_good", "quality", "kept"}
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
    at_text = [c.lower() for c in rows.columns].index(text.lower())
    kept = [i for i, c in enumerate(rows.columns) if keep is None or c in keep]

    def judge(batches):
        of, w, bias = model.value
        for batch in batches:
            weak, q = [], []
            for _, _, texts in text_runs(batch.column(at_text)):
                x = Words(texts)
                weak += [of.get(p, 0.5) for p in (x.votes() @ 3 ** np.arange(len(LABELLERS))).tolist()]
                q.append(x.scores(w, bias))
            q = np.concatenate(q) if q else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(weak, pa.float64()), pa.array(q, pa.float64()), pa.array(q >= 0.5, pa.bool_())], names=[*(batch.schema.names[i] for i in kept), "weak_good", "quality", "kept"])

    more = [T.StructField("weak_good", T.DoubleType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return rows.mapInArrow(judge, T.StructType([*(rows.schema.fields[i] for i in kept), *more]))
