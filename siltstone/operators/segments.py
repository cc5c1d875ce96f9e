"""A stored index of words: generations of packed postings with block-max bounds, which documents come into, change in and leave.

A generation holds `blocks`, cut by part. A task inverts its own documents, a chunk of ROWS of them or CHUNK bytes of text at a time. Of each chunk a part, a hash of the term, has one row: `words` (its terms in order, the
documents of each, and for each range of RANGE documents with the term the greatest tf and the smallest length there) and `data` (places in the chunk, and tfs), both packed; the parts from PARTS on have
the chunk's documents (ids, dls, ranges). So a posting is shuffled once and stored once, packed, and there is no forward form: docs() puts it together from the chunks. A document that a batch changes or deletes is a
tombstone of that generation (`dead`: doc_id, the generation that held it, and its place there), and its words are in `terms` (term, df below 0, held, part). A generation none of whose documents is
left leaves the ledger, and nothing is counted off it.

Which generations count is a ledger: numbered JSON files, each the whole state, of which the last one holds. A batch writes its generation first and its ledger file last, by a
rename that fails where the number is taken, so readers see a batch whole or not at all; a batch that the ledger has already changes nothing, and one
that broke off is written over. compact() makes one generation of all, without tombstones, and remove_old() deletes what no state since then holds.

A question reads the parts of its words only. Bounds come first, from `words` without the postings: a range's bound for a question is the sum of its
words' best possible weights there. The LEADERS ranges with the highest bounds of each question are scored, which gives the question's threshold (its k-th
best score so far), and of all other ranges only those whose bound reaches it are scored, from their chunks; where all documents are some thousand, all ranges are scored at once. The postings of the asked words meet the
chunk's documents in one task, which keeps k rows a question. Results equal those of retrieval.bm25 over the documents that are there.

Cases: a null doc_id counts in the statistics and is never found, and can be neither changed nor deleted. Of several rows of a batch with one doc_id the first text by its order stays. Documents
without words count too; a null text takes its document out. Deleting what isn't there changes nothing. An empty index finds nothing.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.retrieval import CANDIDATES, K1, MATRIX_BYTES, POOL, ROWS, SCORE_DIGITS, B, _lowered, _okapi, _rows_of, _worded, _words_of, idf, top
from siltstone.operators.tables import cut
from siltstone.sources.shared import small_batches, trimmed

#: Parts that terms are cut into, documents of a range, and ranges that are scored first.
PARTS = 64
RANGE = 256
LEADERS = 4
#: Bytes of text in a chunk, about, where its documents are long.
CHUNK = 8 << 20
#: Bytes of a term that are hashed along with those of the other terms.
LETTERS = 64
_BLOCKS = "chunk long, words binary, data binary, ids array<long>, dls array<int>, ranges array<int>, part int"
_TERMS, _DEAD = "term string, df long, held long, part int", "doc_id long, held long, dl int, chunk long, range int, place int"
_DOC, _ROWS = "doc_id long, dl int, terms array<string>, tfs array<int>, gen long", ["gen", "chunk", "words", "data", "doc_id", "dl", "place"]


@dataclass
class State:
    """What a ledger file says: its number, the generations that count with their documents and words and those they took out of others, the batches that are in, and the names of those compacted."""

    number: int = 0
    generations: list[dict] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)


# --- chunks


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 up, each in the narrowest type that holds it, compressed."""
    kept = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
    raw = b"".join([np.array([len(kept), *(v for x in kept for v in (x.itemsize, len(x)))], np.int64).tobytes(), *(x.tobytes() for x in kept)])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(said: bytes) -> list[np.ndarray]:
    raw = pa.decompress(said[8:], int(np.frombuffer(said, np.int64, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for width, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, f"u{width}", size, at))
        at += width * size
    return out


def _spelled(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of terms, and their bytes."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    terms = pa.concat_arrays([terms.cast(pa.string())])
    ends = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, 4 * terms.offset)
    return np.diff(ends), np.frombuffer(terms.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _terms(sizes: np.ndarray, letters: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))


def _parts(terms: pa.Array) -> np.ndarray:
    """The part of each term: a hash of its bytes, the first LETTERS of them eight at a time."""
    sizes, letters = _spelled(terms)
    at, padded = np.cumsum(sizes) - sizes, np.append(letters, np.zeros(8, np.uint8))
    hashed = sizes.astype(np.uint64)
    for i in np.flatnonzero(sizes > LETTERS).tolist():
        hashed[i] = zlib.crc32(letters[at[i] + LETTERS : at[i] + sizes[i]].tobytes())
    for i in range(0, min(LETTERS, int(sizes.max(initial=0))), 8):
        some = np.flatnonzero(sizes > i)
        eight = padded[(at[some] + i)[:, None] + np.arange(8)] * (np.arange(i, i + 8) < sizes[some][:, None])
        x = (hashed[some] ^ np.ascontiguousarray(eight.astype(np.uint8)).view(np.uint64)[:, 0]) * np.uint64(0x9E3779B97F4A7C15)
        hashed[some] = x ^ (x >> np.uint64(29))
    return (hashed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % PARTS


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    """values as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _repeated(terms: pa.ListArray, tfs: pa.ListArray) -> pa.ListArray:
    """Lists of words, each as often as it comes."""
    n = tfs.flatten().to_numpy()
    row = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    return _lists(np.bincount(row, n, len(terms)).astype(np.int64), terms.flatten().take(pa.array(np.repeat(np.arange(len(n)), n))))


def _chunks(width: int, most: int):
    """Rows of `blocks` of (doc_id, lower-case text) rows, or of (doc_id, words) rows."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            said = batch.column(1)
            values = said if not pa.types.is_list(said.type) else said.flatten()
            each = pc.fill_null(pc.binary_length(said), 0).to_numpy() if values is said else np.diff(said.offsets.to_numpy()) * 8
            ends, a = np.cumsum(each), 0
            while a < len(batch):
                b = min(a + ROWS, len(batch), max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))))
                yield _chunk(base, batch.column(0).slice(a, b - a), said.slice(a, b - a), width)
                base, a = base + 1, b

    return run


def _chunk(chunk: int, ids: pa.Array, said: pa.Array, width: int) -> pa.RecordBatch:
    if pa.types.is_list(said.type):
        row, words = _rows_of(said)
    else:
        row, words = _words_of(said)
        words = words.dictionary_encode()
    n, terms = len(ids), words.dictionary
    dls, parts = np.bincount(row, minlength=n), _parts(terms)
    place = np.empty(len(terms), np.int64)
    place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    order = np.lexsort((place, parts))  # by part, then in the order of terms
    place[order] = np.arange(len(terms))
    terms, parts = terms.take(pa.array(order)), parts[order]
    pair, tfs = np.unique(place[words.indices.to_numpy()] * n + row, return_counts=True)
    code, row = pair // n, pair % n
    step = np.where(np.diff(code, prepend=-1) == 0, np.diff(row, prepend=0), row)
    first = np.flatnonzero(np.diff(code * n + row // width, prepend=-1))
    best, least = (np.maximum.reduceat(tfs, first), np.minimum.reduceat(dls[row], first)) if len(first) else (tfs, tfs)
    df, blocks = np.bincount(code, minlength=len(terms)), np.bincount(code[first], minlength=len(terms))
    sizes, letters = _spelled(terms)
    bounds = np.searchsorted(parts, np.arange(PARTS + 1))
    at, row_at, block_at = (np.append(0, np.cumsum(x))[bounds] for x in (sizes, df, blocks))
    have = np.flatnonzero(np.diff(bounds))
    cuts = [(slice(bounds[p], bounds[p + 1]), slice(at[p], at[p + 1]), slice(block_at[p], block_at[p + 1]), slice(row_at[p], row_at[p + 1])) for p in have]
    packed = [_packed(sizes[t], letters[a], df[t], blocks[t], row[first][b] // width, best[b], least[b]) for t, a, b, _ in cuts]
    data = [_packed(step[r], tfs[r]) for *_, r in cuts]
    none = [None] * len(have)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(have) + 1, chunk)),
            pa.array([*packed, None], pa.binary()),
            pa.array([*data, None], pa.binary()),
            pa.concat_arrays([pa.array(none, pa.list_(pa.int64())), _lists(np.array([n]), ids)]),
            pa.concat_arrays([pa.array(none, pa.list_(pa.int32())), _lists(np.array([n]), pa.array(dls.astype(np.int32)))]),
            pa.concat_arrays([pa.array(none, pa.list_(pa.int32())), _lists(np.array([n]), pa.array((np.arange(n) // width).astype(np.int32)))]),
            pa.array(np.append(have, PARTS + (chunk + (chunk >> 32)) % PARTS).astype(np.int32)),
        ],
        names=[x.split()[0] for x in _BLOCKS.split(", ")],
    )


def _only(shared):
    """(gen, chunk, words, data) rows with the asked terms alone, without bounds."""

    def run(batches):
        for batch in batches:
            rows = []
            for g, c, words, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                sizes, letters, df, *_ = _unpacked(words)
                terms = _terms(sizes, letters)
                keep = pc.is_in(terms, value_set=shared.value).to_numpy(zero_copy_only=False)
                if keep.any():
                    held, none = np.repeat(keep, df), np.zeros(0, np.int64)
                    rows.append((g, c, _packed(*_spelled(terms.filter(pa.array(keep))), df[keep], none, none, none, none), _packed(*(x[held] for x in _unpacked(data)))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(i).type) for i, x in enumerate(zip(*rows, strict=True))], names=batch.schema.names)

    return run


def _counted(shared):
    """(term, df) of (words) rows: documents of the asked terms."""

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                sizes, letters, df, *_ = _unpacked(words)
                code = pc.fill_null(pc.index_in(_terms(sizes, letters), value_set=shared.value), -1).to_numpy()
                total += np.bincount(code[code >= 0], df[code >= 0], len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([shared.value.take(pa.array(some)), pa.array(total[some])], names=["term", "df"])

    return run


def _bounded(shared, mean: float):
    """(query, gen, chunk, range, bound) of (gen, chunk, words) rows: what a part's words add to a range's bound at most. shared: terms, their idf, the queries of each and where they begin."""

    def run(batches):
        terms, idfs, query, starts = shared.value
        for batch in batches:
            for g, c, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sizes, letters, _, blocks, ranges, best, least = _unpacked(words)
                code = np.repeat(pc.fill_null(pc.index_in(_terms(sizes, letters), value_set=terms), -1).to_numpy(), blocks)
                some = code >= 0
                code, ranges, best, least = code[some], ranges[some].astype(np.int64), best[some].astype(float), least[some]
                if not len(code):
                    continue
                w = idfs[code] * best * (K1 + 1) / (best + K1 * (1 - B + B * least / mean))
                n, many = int(ranges.max()) + 1, starts[code + 1] - starts[code]
                which = np.repeat(starts[code] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pair, place = np.unique(query[which] * n + np.repeat(ranges, many), return_inverse=True)
                bound = np.bincount(place, np.repeat(w, many))
                yield pa.RecordBatch.from_arrays([pa.array(pair // n), pa.array(np.full(len(pair), g)), pa.array(np.full(len(pair), c)), pa.array((pair % n).astype(np.int32)), pa.array(bound)], names=["query", "gen", "chunk", "range", "bound"])

    return run


def _assembled(batches):
    """Documents (doc_id, dl, terms, tfs, gen) of _ROWS rows in the order of (gen, chunk): documents with a place, and packed words."""
    held, key = [], None
    for batch in (b for b in batches if len(b)):
        g, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.append(0, 1 + np.flatnonzero((np.diff(g) != 0) | (np.diff(c) != 0)))
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            if (g[a], c[a]) != key:
                if held:
                    yield from _chunk_documents(held)
                held, key = [], (g[a], c[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from _chunk_documents(held)


def _chunk_documents(held: list[pa.RecordBatch]):
    rows = pa.Table.from_batches(held)
    docs, said = rows.filter(pc.is_valid(rows["place"])), rows.filter(pc.is_valid(rows["words"]))
    if not len(docs):
        return
    terms, codes, places, tfs, n = [], [], [], [], 0
    for words, data in zip(said["words"].to_pylist(), said["data"].to_pylist(), strict=True):
        sizes, letters, df, *_ = _unpacked(words)
        step, tf = _unpacked(data)
        ends, df = np.cumsum(step, dtype=np.int64), df.astype(np.int64)
        first = np.cumsum(df) - df
        places.append(ends - np.repeat(ends[first] - step[first], df))
        codes.append(n + np.repeat(np.arange(len(df)), df))
        terms.append(_terms(sizes, letters))
        tfs.append(tf.astype(np.int32))
        n += len(df)
    place = docs["place"].to_numpy()
    at = np.full(1 + max([place.max(), *(x.max(initial=0) for x in places)]), -1)
    at[place] = np.arange(len(docs))
    row, code, tf = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((places, np.int64), (codes, np.int64), (tfs, np.int32)))
    row = at[row]
    order = np.argsort(row, kind="stable")[np.count_nonzero(row < 0) :]
    sizes = np.bincount(row[order], minlength=len(docs))
    lists = _lists(sizes, pa.concat_arrays([*terms, pa.array([], pa.string())]).take(pa.array(code[order]))), _lists(sizes, pa.array(tf[order]))
    docs = docs.combine_chunks()
    yield pa.RecordBatch.from_arrays([*(docs[x].chunk(0) for x in ("doc_id", "dl")), *lists, docs["gen"].chunk(0)], names=["doc_id", "dl", "terms", "tfs", "gen"])


def _scored(okapi):
    """What _okapi gives of the documents of _ROWS rows."""

    def run(batches):
        yield from okapi(pa.RecordBatch.from_arrays([b.column(0), _repeated(b.column(2), b.column(3)), b.column(1)], names=["doc_id", "words", "dl"]) for b in _assembled(batches))

    return run


def _taken_out(batches):
    """(held, part, term, df) of the documents of _ROWS rows."""
    for b in _assembled(batches):
        words = b.column(2).flatten().dictionary_encode()
        df = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df), b.column(4)[0].as_py())), pa.array(_parts(words.dictionary).astype(np.int32)), words.dictionary, pa.array(df)], names=["held", "part", "term", "df"])


def _met(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """_ROWS rows of documents (gen, chunk, doc_id, dl, place) and packed words (gen, chunk, words, data), each chunk in one task, in order."""
    docs = docs.select("gen", "chunk", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("data"), "doc_id", "dl", "place")
    blocks = blocks.select("gen", "chunk", "words", "data", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("dl"), F.lit(None).cast("int").alias("place"))
    return docs.unionByName(blocks).repartition("gen", "chunk").sortWithinPartitions("gen", "chunk")


def _near(rows: DataFrame) -> DataFrame:
    """rows, sent to all tasks where they are CANDIDATES at most."""
    return F.broadcast(rows) if rows.limit(CANDIDATES + 1).count() <= CANDIDATES else rows


def _spread(batches):
    """(doc_id, words) of (doc_id, terms, tfs) rows."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _repeated(b.column(1), b.column(2))], names=["doc_id", "words"])


def _left(generations: list[dict]) -> list[dict]:
    """generations without those of which no document is left and which took none out of others that are left; the last one stays."""
    lost: dict[int, int] = {}
    for g in generations:
        for held, (count, _) in g["dead"].items():
            lost[int(held)] = lost.get(int(held), 0) + count
    out: list[dict] = []
    for g in generations[:-1]:
        if lost.get(g["number"], 0) < g["n"] or {int(held) for held in g["dead"]} & {x["number"] for x in out}:
            out.append(g)
    return [*out, generations[-1]]


class Index:
    """The index in a folder. apply() takes batches, search() answers (item_id, text) questions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- the ledger

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def state(self) -> State:
        """The last state that was committed."""
        fs, folder = self._fs(f"{self.root}/ledger")
        if not fs.exists(folder):
            return State()
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return State()
        file = fs.open(self._fs(f"{self.root}/ledger/{names[-1]}")[1])
        try:
            said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return State(**json.loads(said))

    def _commit(self, state: State) -> None:
        fs, target = self._fs(f"{self.root}/ledger/{state.number:012d}.json")
        _, aside = self._fs(f"{self.root}/ledger/.{state.number:012d}.{id(state)}.part")
        if fs.exists(target):
            raise RuntimeError(f"another writer has committed state {state.number} of {self.root}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        if not fs.rename(aside, target):
            raise RuntimeError(f"state {state.number} of {self.root} could not be committed")

    def _read(self, what: str, schema: str, generations: list[int]) -> DataFrame:
        rows = None
        for g in generations:  # generations are few: compact() keeps them so
            one = self.spark.read.schema(schema).parquet(f"{self.root}/gen={g}/{what}").withColumn("gen", F.lit(g).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
        return self.spark.createDataFrame([], f"{schema}, gen long") if rows is None else rows

    # --- writing

    def docs(self, state: State | None = None) -> DataFrame:
        """(doc_id, dl, terms, tfs, gen) of the documents that are there."""
        state = state or self.state()
        return _met(self._there(state), self._words(state)).mapInArrow(trimmed(_assembled), _DOC)

    def _words(self, state: State) -> DataFrame:
        """(chunk, words, data, part, gen) of all documents, also those that went."""
        return self._read("blocks", _BLOCKS, [g["number"] for g in state.generations]).where(F.col("part") < PARTS)

    def _there(self, state: State) -> DataFrame:
        """(gen, chunk, place, doc_id, dl, range) of the documents that are there."""
        numbers = [g["number"] for g in state.generations]
        rows = self._read("blocks", _BLOCKS, numbers).where(F.col("part") >= PARTS).select("gen", "chunk", F.posexplode(F.arrays_zip("ids", "dls", "ranges")).alias("place", "d"))
        rows = rows.select("gen", "chunk", "place", F.col("d.ids").alias("doc_id"), F.col("d.dls").alias("dl"), F.col("d.ranges").alias("range"))
        if not any(int(held) in numbers for g in state.generations for held in g["dead"]):
            return rows
        return rows.join(self._read("dead", _DEAD, numbers).where(F.col("held").isin(numbers)).select("doc_id", F.col("held").alias("gen")), ["doc_id", "gen"], "left_anti")

    def apply(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, new_only: bool = False) -> bool:
        """Takes in a batch: documents (doc_id, text) that are new or changed (new_only: those that are there stay as they are), and deletes (doc_id). False, and nothing done, where the ledger has it."""
        state = self.state()
        if batch in state.batches:
            return False
        there = self._there(state)
        fresh = self.spark.createDataFrame([], "doc_id long, text string") if upserts is None else upserts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        if not fresh.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # texts are shuffled only where a number repeats
            first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
            fresh = fresh.where("doc_id is null").unionByName(fresh.where("doc_id is not null").withColumn("nth", first).where("nth = 1").drop("nth"))
        if new_only:
            fresh = fresh.join(there.select("doc_id"), "doc_id", "left_anti")
        gone = fresh.select("doc_id") if deletes is None else fresh.select("doc_id").unionByName(deletes.select(F.col("doc_id").cast("long").alias("doc_id")))
        dead = there.join(gone.where("doc_id is not null").distinct(), "doc_id", "left_semi")
        self._write(state, fresh.where("text is not null").select("doc_id", _lowered()), None if new_only and deletes is None else dead, State(state.number + 1, state.generations, [*state.batches, batch]))
        return True

    def compact(self) -> None:
        """One generation of all that is there. Readers of the state before are not disturbed."""
        state = self.state()
        if state.generations:
            words = self.docs(state).select("doc_id", "terms", "tfs").mapInArrow(trimmed(_spread), "doc_id long, words array<string>")
            self._write(state, words, None, State(state.number + 1, [], state.batches))

    def remove_old(self) -> None:
        """Deletes generations that the last state doesn't hold, and earlier ledger files. Not while others read older states or write."""
        state = self.state()
        fs, root = self._fs(self.root)
        live = {f"gen={g['number']}" for g in state.generations}
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith("gen=") and s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(self._fs(f"{self.root}/ledger")[1]):
            if s.getPath().getName() < f"{state.number:012d}.json":
                fs.delete(s.getPath(), False)

    def _write(self, state: State, forward: DataFrame, dead: DataFrame | None, after: State) -> None:
        """forward: (doc_id, lower-case text), or (doc_id, words)."""
        folder, put = f"{self.root}/gen={after.number}", lambda rows: rows.write.mode("overwrite").option("compression", "zstd")
        with small_batches(self.spark):
            shares = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // (2 * PARTS))  # a part goes to several tasks where there are more tasks than parts
            put(forward.mapInArrow(trimmed(_chunks(RANGE, CHUNK)), _BLOCKS).repartition("part", F.pmod(F.xxhash64("chunk"), F.lit(shares)))).partitionBy("part").parquet(f"{folder}/blocks")
            rows = self.spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").where(F.col("part") >= PARTS)
            n, total = rows.select(F.explode("dls").alias("dl")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if dead is None:
                dead = self.spark.createDataFrame([], f"{_DEAD}, gen long")
            put(dead.select("doc_id", F.col("gen").alias("held"), "dl", "chunk", "range", "place")).parquet(f"{folder}/dead")
            dead = self.spark.read.schema(_DEAD).parquet(f"{folder}/dead")
            counts = {str(r[0]): [r[1], r[2]] for r in dead.groupBy("held").agg(F.count("*"), F.sum("dl")).collect()}  # generations are few
            after.generations = _left([*after.generations, {"number": after.number, "n": n, "total": total, "dead": counts}])
            numbers = [g["number"] for g in after.generations]
            dead = dead.where(F.col("held").isin(numbers)).withColumn("gen", F.col("held"))
            blocks = self._words(State(generations=[g for g in state.generations if str(g["number"]) in counts and g["number"] in numbers]))
            blocks = blocks.join(dead.select("gen", "chunk").distinct(), ["gen", "chunk"], "left_semi")
            less = _met(dead, blocks).mapInArrow(trimmed(_taken_out), "held long, part int, term string, df long").groupBy("held", "part", "term").agg((-F.sum("df")).alias("df"))
            put(less.select("term", "df", "held", "part").repartition("part").sortWithinPartitions("part", "term")).partitionBy("part").parquet(f"{folder}/terms")
        self._commit(after)

    # --- answering

    def search(self, questions: DataFrame, k: int = POOL) -> DataFrame:
        """(item_id, doc_id, rank, score): the k best documents of each question, as retrieval.bm25 ranks them."""
        state, kind = self.state(), questions.schema["item_id"].dataType
        asked = cut(_worded(questions, "item_id").select("item_id", F.explode(F.array_distinct("words")).alias("term")).where("item_id is not null").distinct())
        blocks, out = max(1, -(-asked.count() * 64 // MATRIX_BYTES)), None  # bytes of a word, its weight and its question's number
        for i in range(blocks):
            found = cut(self._search(state, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), k))
            out = found if out is None else out.unionByName(found)
        return out.select(F.col("item_id").cast(kind).alias("item_id"), "doc_id", "rank", "score")

    def _search(self, state: State, asked: DataFrame, k: int) -> DataFrame:
        """search() of (item_id, term) rows that fit into MATRIX_BYTES."""
        spark, numbers = self.spark, [g["number"] for g in state.generations]
        gone = [v for g in state.generations for held, v in g["dead"].items() if int(held) in numbers]
        n, total = (sum(g[x] for g in state.generations) - sum(v[i] for v in gone) for i, x in enumerate(("n", "total")))
        mean, few = total / n if total else 1.0, n <= 4 * LEADERS * RANGE  # bounds would cost more than they save
        terms = pc.unique(asked.select("term").toArrow().column("term")).cast(pa.string())
        terms = pa.concat_arrays(terms.chunks) if isinstance(terms, pa.ChunkedArray) else terms
        parts, shared = np.unique(_parts(terms)).tolist(), spark.sparkContext.broadcast(terms)
        words = self._words(state).where(F.col("part").isin(parts))
        less = self._read("terms", _TERMS, numbers).where(F.col("part").isin(parts) & F.col("held").isin(numbers)).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select("term", "df")
        with small_batches(spark):
            known = words.select("words").mapInArrow(trimmed(_counted(shared)), "term string, df long").unionByName(less).groupBy("term").agg(F.sum("df").alias("df"))
            rows = asked.join(known, "term").select("item_id", "term", idf(F.lit(n), F.col("df")).alias("idf")).orderBy("item_id", "term").toArrow()
        item = rows.column("item_id").combine_chunks().dictionary_encode()
        items = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(item.dictionary))), "item_id": item.dictionary})) if len(rows) else asked.select(F.lit(0).cast("long").alias("query"), "item_id").limit(0)
        rows = pa.table({"item_id": item.indices.cast(pa.int64()), "term": rows.column("term"), "idf": rows.column("idf")})
        okapi = _scored(_okapi(rows, mean, k, spark))

        def scored(ranges: DataFrame | None) -> DataFrame:
            there, held = self._there(state), words
            if ranges is not None:
                there = there.join(_near(ranges), ["gen", "chunk", "range"], "left_semi")
                held = held.join(_near(ranges.select("gen", "chunk").distinct()), ["gen", "chunk"], "left_semi")
            held = held.select("gen", "chunk", "words", "data").mapInArrow(trimmed(_only(shared)), "gen long, chunk long, words binary, data binary")
            return _met(there, held).mapInArrow(trimmed(okapi), "item_id long, doc_id long, score double")

        def named(found: DataFrame) -> DataFrame:
            return top(found, k).withColumnRenamed("item_id", "query").join(F.broadcast(items), "query").select("item_id", "doc_id", "rank", "score")

        if few:
            return named(scored(None))
        said = rows.column("term").combine_chunks().dictionary_encode()
        codes = said.indices.to_numpy()
        order, idfs = np.argsort(codes, kind="stable"), np.zeros(len(said.dictionary))
        idfs[codes] = rows.column("idf").to_numpy()
        weights = spark.sparkContext.broadcast((said.dictionary, idfs, rows.column("item_id").to_numpy()[order], np.append(0, np.cumsum(np.bincount(codes, minlength=len(idfs))))))
        bounds = words.select("gen", "chunk", "words").mapInArrow(trimmed(_bounded(weights, mean)), "query long, gen long, chunk long, range int, bound double")  # bounds alone: no postings are read
        bounds = bounds.groupBy("query", "gen", "chunk", "range").agg(F.sum("bound").alias("bound"))
        bounds = cut(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "gen", "chunk", "range"))))
        ranges = ["gen", "chunk", "range"]
        first = cut(bounds.where(F.col("place") <= LEADERS).select(*ranges).distinct())
        leaders = cut(top(scored(first), k))
        least = leaders.groupBy("item_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least")).withColumnRenamed("item_id", "query")
        rest = bounds.where(F.col("place") > LEADERS).join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2 * 10.0**-SCORE_DIGITS))
        rest = cut(rest.select(*ranges).distinct().join(first, ranges, "left_anti"))  # leaders' ranges are scored for all questions
        return named(leaders.select("item_id", "doc_id", "score").unionByName(scored(rest)))
