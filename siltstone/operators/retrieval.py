"""Retrieval of many questions at once: BM25, dense vectors, rank fusion, reranking.

Questions are (item_id, text), the corpus (doc_id, text). Results are (item_id, doc_id, rank, score); texts are joined last, for the
rows that are left. Scores are rounded to SCORE_DIGITS before ranking, so that equal texts tie, and ties go to the smaller doc_id.

Models are ports: `embed` gives (key, vector) of (key, text) rows, `rerank` ranks candidates as `reranked` does. The index of words may be
a stored one (operators.segments); without one the corpus is scanned.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import tables
from siltstone.sources.shared import removed, scratch, small_batches, trimmed

K1, B = 1.5, 0.75
RRF = 60
POOL, TOP, SINGLE = 20, 8, 5
DIMENSIONS = 384
SCORE_DIGITS = 8
#: Question vectors that are sent to all tasks at once, as 64-bit numbers, and rows of a tile where there are more; blocks of questions' words in one plan.
MATRIX_BYTES = 32 << 20
TILE_BYTES = 128 << 20
AT_ONCE = 4
#: Rows that a task multiplies at once, and weights of words that it adds up at once.
ROWS = 1024
WEIGHTS = 1 << 18
#: Candidates that are sent to all tasks, to find their texts.
CANDIDATES = 1 << 17


def corpus(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id and text of the rows with text; most: the first so many by doc_id, with a warning if that leaves any out."""
    rows = docs.select("doc_id", "text").where("text <> ''")
    if not most:
        return rows
    if (n := rows.count()) > most:
        warnings.warn(f"the corpus has {n} chunks, the first {most} are taken", stacklevel=2)
    return rows.orderBy("doc_id").limit(most)


def stored(points: DataFrame, most: int | None = None) -> DataFrame:
    """The corpus of stored points (doc_id, payload): the text of each payload's node, those without one left out, and its public metadata."""
    rows = points.select("doc_id", T.payload_text(F.col("payload")).alias("text"), T.public_metadata(F.col("payload"), T.INTERNAL).alias("metadata"))
    return corpus(rows, most).join(rows.select("doc_id", "metadata"), "doc_id")


def top(scored: DataFrame, k: int, digits: int = SCORE_DIGITS) -> DataFrame:
    """The k best of every question, ranked from 1."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "doc_id", "rank", "score")


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf)."""
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return words.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(questions: DataFrame, docs: DataFrame, k: int = POOL, index=None) -> DataFrame:
    """Okapi scores over distinct question words (rows without a number take part in the counts only). One scan cuts the documents into words and keeps those that are asked for in the shared folder; what
    it keeps is counted, then scored where it lies: a task keeps k rows a question, and only those are shuffled. index: a stored one (operators.segments.Index), which is asked instead and reads the parts of those
    words only; or postings as rows, of which all are read."""
    if index is not None and not isinstance(index, DataFrame):
        return index.search(questions, k)
    if index is None:
        asked = _worded(questions, "item_id").select("item_id", F.explode(F.array_distinct("words")).alias("term"))
        return _bm25_scan(tables.cut(asked.where("item_id is not null")), docs, k)
    asked = questions.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    found = index.join(terms, "term", "left_semi")
    size = index.groupBy("doc_id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = size.select("n").scalar(), size.select("mean").scalar()
    weight = idf(n, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    scored = found.join(df, "term").select("doc_id", "term", weight.alias("w")).join(asked, "term").groupBy("item_id", "doc_id").agg(F.sum("w").alias("score"))
    return top(scored, k)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _bm25_scan(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lowered())
    kind, out, paths = asked.schema["item_id"].dataType, None, []
    blocks = max(1, -(-asked.count() * 64 // MATRIX_BYTES))  # bytes of a word, its weight and its question's number
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        terms = part.select("term").distinct().toArrow().column("term").combine_chunks()
        paths.append(scratch(spark, "asked-words"))
        with small_batches(spark):
            texts.mapInArrow(trimmed(_only(terms, spark)), schema := "doc_id long, words array<string>, dl long").write.parquet(paths[-1])
        held = spark.read.schema(schema).parquet(paths[-1])
        n, total = held.agg(F.count("*"), F.sum("dl")).first()
        counts = held.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        rows = part.join(counts, "term").select("item_id", "term", idf(F.lit(n), F.col("df")).alias("idf")).orderBy("item_id", "term").toArrow()
        found = held.mapInArrow(trimmed(_okapi(rows, (total or 0) / max(1, n) or 1.0, k, spark)), "query long, id long, score double")
        found = found if blocks <= AT_ONCE else tables.cut(found)  # so that the plan stays small
        out = found if out is None else out.unionByName(found)
    best = tables.cut(top(out.select(F.col("query").cast(kind).alias("item_id"), F.col("id").alias("doc_id"), "score"), k))  # run here, where batches are small
    for path in paths:
        removed(spark, path)
    return best


def _only(terms: pa.Array, spark):
    """(doc_id, words, dl) of (doc_id, text) rows: the words that are among terms, as often as they come, and the number of all words."""
    shared = spark.sparkContext.broadcast(terms)  # MATRIX_BYTES, or one question's words

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            row, words = _words_of(batch.column(1))
            asked = pc.is_in(words, value_set=shared.value.cast(words.type))
            lists = _lists(row[asked.to_numpy(zero_copy_only=False)], words.filter(asked), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.bincount(row, minlength=len(batch)))], names=["doc_id", "words", "dl"])

    return run


def _lowered() -> Column:
    return F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")


def _words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of each word in lower-case texts its row, and the words, as text.tokens has them."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, r"[^\pL\pN_]+", " "), " ")
    row, words = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
    some = pc.not_equal(words, "")
    return row[some.to_numpy(zero_copy_only=False)], words.filter(some)


def _lists(row: np.ndarray, words: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), words)


def _worded(rows: DataFrame, key: str) -> DataFrame:
    """(key, words), by the same words as those of the scans."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*_words_of(batch.column(1)), len(batch))], names=[key, "words"])

    return rows.select(key, _lowered()).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, words array<string>")


def _okapi(asked: pa.Table, mean: float, k: int, spark):
    """Scores (doc_id, words) rows, or (doc_id, words, dl) rows where other words are left out, for asked (item_id, term, idf) rows; a task adds up the weights of so many documents at a time that they are WEIGHTS at most, or one document's."""
    items, item = np.unique(asked.column("item_id").to_numpy(), return_inverse=True)
    term = asked.column("term").combine_chunks().dictionary_encode()
    place = {w: i for i, w in enumerate(term.dictionary.to_pylist())}
    codes = term.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(codes, minlength=len(place))))
    idfs = np.zeros(len(place))
    idfs[codes] = asked.column("idf").to_numpy()
    shared = spark.sparkContext.broadcast((items, place, item[order], starts, idfs))  # MATRIX_BYTES, or one question's words

    def run(batches):
        items, place, item, starts, idfs = shared.value
        kept, size = Best(len(items), k), max(1, min(ROWS, WEIGHTS // max(1, len(item))))
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            row, words = _rows_of(batch.column(1))
            code = np.array([place.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
            dl = batch.column(2).to_numpy() if batch.num_columns > 2 else np.bincount(row, minlength=len(batch))
            pair, tf = np.unique((row * len(place) + code)[code >= 0], return_counts=True)
            if not len(pair):
                continue
            row, code = pair // len(place), pair % len(place)
            w = idfs[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / mean))
            ids = batch.column(0)
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i in range(0, len(batch), size):
                a, b = np.searchsorted(row, (i, i + size))
                n, many = len(ids[i : i + size]), starts[code[a:b] + 1] - starts[code[a:b]]
                which = np.repeat(starts[code[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                s = np.bincount(item[which] * n + np.repeat(row[a:b] - i, many), np.repeat(w[a:b], many), len(items) * n).reshape(len(items), n)
                s[:, none[i : i + size]] = 0
                kept.add(np.round(s, SCORE_DIGITS), ids[i : i + size], s > 0)
        yield kept.batch(items)

    return run


def _rows_of(lists: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each word in lists its row; the words as codes."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().dictionary_encode()


class Best:
    """The k best rows of each of n queries that a task has seen, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.ids, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, s: np.ndarray, ids: np.ndarray, some: np.ndarray) -> None:
        """s: scores of queries x rows; some: the pairs that count."""
        q, d = np.nonzero((s >= self.least[:, None]) & some)
        q, ids, s = np.append(self.q, q), np.append(self.ids, ids[d]), np.append(self.s, s[q, d])
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < self.k
        self.q, self.ids, self.s = q[keep], ids[keep], s[keep]
        full, count = np.unique(self.q, return_counts=True)
        full = full[count == self.k]
        self.least[full] = self.s[np.searchsorted(self.q, full, "right") - 1]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[self.q], pa.int64()), pa.array(self.ids), pa.array(self.s)], names=["query", "id", "score"])


def embedded(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector): unit vectors of a hashing embedder (bucket and sign of a word from its md5), null without words; the default of the
    embedding port. A distinct word of ROWS rows is hashed once."""

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            row, words = _words_of(batch.column(1))
            words = words.dictionary_encode()
            digests = b"".join([hashlib.md5(w).digest()[:3] for w in words.dictionary.cast(pa.binary()).to_pylist()])
            high, low, sign = np.frombuffer(digests, np.uint8).reshape(-1, 3).T.astype(np.int64)
            code, sign = words.indices.to_numpy(), np.where(sign < 128, 1, -1)
            v = np.bincount(row * DIMENSIONS + ((high * 256 + low) % DIMENSIONS)[code], sign[code], len(batch) * DIMENSIONS).reshape(len(batch), DIMENSIONS)
            norm = np.sqrt((v * v).sum(1))
            v = v / np.where(norm, norm, 1)[:, None]  # counts of no words at all are whole numbers
            starts = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * DIMENSIONS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(v.ravel()), mask=pa.array(norm == 0))], names=[key, "vector"])

    keyed = rows.select(F.col(key).cast("long").alias(key), _lowered())
    return keyed.mapInArrow(trimmed(run), f"{key} long, vector array<double>")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int, own: bool = True) -> DataFrame:
    """(query, id, score): of (query, vector) rows each one's k highest dot products with (id, vector) rows, rounded, ties to the smaller id; only
    pairs that share a dimension other than 0. Query vectors of MATRIX_BYTES go to all tasks as a matrix, over one scan; more of them meet the rows in tiles (_tiled), so the plan has the
    same size for any number. A task keeps k rows a query, and those of all tasks are merged. own=False leaves a vector out that has the query's number."""
    queries = tables.cut(queries.where("vector is not null"))
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if n * 8 * width <= MATRIX_BYTES:
        rows = queries.orderBy("query").toArrow() if n else queries.limit(0).toArrow()
        out = _scan(rows, vectors, k, digits, own)
    else:
        out = _tiled(queries, vectors, k, digits, own, width)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return tables.cut(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "score"))  # run here, where batches are small


def _tiled(queries: DataFrame, vectors: DataFrame, k: int, digits: int, own: bool, width: int) -> DataFrame:
    """The k best of each query in each tile. A tile is about TILE_BYTES of rows, by a hash of their ids, and all queries in turn: the rows come first and are held as a matrix, the
    queries pass them ROWS at a time."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    tiles = max(1, -(-rows.count() * 8 * width // TILE_BYTES))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"), F.lit(0).alias("kind"), "id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), F.lit(1).alias("kind"), F.col("query").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))

    def run(batches):
        at, held, ids, x = None, [], None, None
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            tile, kind = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
            starts = np.append(0, np.flatnonzero((np.diff(tile) != 0) | (np.diff(kind) != 0)) + 1)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
                part = batch.slice(a, b - a)
                if tile[a] != at:
                    at, held, x = tile[a], [], None
                names, m = _filled(part.column("id"), part.column("vector"), width)
                if kind[a] == 0:
                    held.append((names, m))
                    continue
                if x is None and held:
                    ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    held = []
                if x is None or not len(names):
                    continue
                order = np.argsort(names)
                kept = Best(len(names), k)
                for i in range(0, len(ids), 4 * ROWS):
                    _add(kept, names[order], m[order], ids[i : i + 4 * ROWS], x[i : i + 4 * ROWS], digits, own)
                yield kept.batch(names[order])

    met = left.unionByName(right).repartition("tile").sortWithinPartitions("tile", "kind")
    return met.mapInArrow(trimmed(run), "query long, id long, score double")


def _add(kept: Best, names: np.ndarray, m: np.ndarray, ids: np.ndarray, x: np.ndarray, digits: int, own: bool) -> None:
    """What the queries (names, m) find in the rows (ids, x)."""
    s = np.round(m @ x.T, digits)
    some = s != 0
    if not some[kept.least <= 0].all():
        some |= ((m != 0).astype(np.float32) @ (x != 0).astype(np.float32).T) > 0
    if not own:
        some &= names[:, None] != ids
    kept.add(s, ids, some)


def _filled(ids: pa.Array, vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors, as rows of a matrix filled up with 0 or cut to width; those that are null, empty or hold a null are left out."""
    starts, values = vectors.offsets.to_numpy(), vectors.values
    sizes = np.diff(starts)
    whole = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    if values.null_count:
        gaps = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
        whole &= gaps[starts[1:]] == gaps[starts[:-1]]
    values, x = values.to_numpy(zero_copy_only=False), np.zeros((int(whole.sum()), width))
    starts, sizes = starts[:-1][whole], np.minimum(sizes[whole], width)
    row = np.repeat(np.arange(len(x)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[row, column] = values[np.repeat(starts, sizes) + column]
    return ids.filter(pa.array(whole)).to_numpy(zero_copy_only=False).astype(np.int64), x


def _scan(queries: pa.Table, vectors: DataFrame, k: int, digits: int, own: bool) -> DataFrame:
    numbers, vector = (queries.column(c).combine_chunks() for c in ("query", "vector"))
    numbers, matrix = _filled(numbers, vector, int(np.diff(vector.offsets.to_numpy()).max(initial=0)))
    shared = vectors.sparkSession.sparkContext.broadcast((numbers, matrix))  # MATRIX_BYTES, or one query's vector

    def run(batches):
        names, m = shared.value
        kept = Best(len(names), k)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            ids, x = _filled(batch.column(0), batch.column(1), m.shape[1])
            if not len(ids) or not len(names):
                continue
            _add(kept, names, m, ids, x, digits, own)
        yield kept.batch(names)

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(trimmed(run), "query long, id long, score double")


def dense(questions: DataFrame, docs: DataFrame, k: int = POOL, embed: Callable = embedded) -> DataFrame:
    """Cosine of unit vectors."""
    q, d = embed(questions.select("item_id", "text"), "item_id"), embed(docs.select("doc_id", "text"), "doc_id")
    found = nearest(q.select(F.col("item_id").alias("query"), "vector"), d.select(F.col("doc_id").alias("id"), "vector"), k, SCORE_DIGITS)
    return top(found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score"), k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(vector: Column) -> Column:
    """A vector of length 1; null where it has none."""
    x = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm))


def knn(queries: DataFrame, vectors: DataFrame, k: int = SINGLE) -> DataFrame:
    """(query_id, vec_id, rank, score): the k nearest by cosine, itself left out. Queries are a stated set, compared with all rows in blocks."""
    q, v = (rows.select(F.col("vec_id").alias(name), unit(F.col("embedding")).alias("vector")) for rows, name in ((queries, "query"), (vectors, "id")))
    found = nearest(q, v, k, 6, own=False).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fused(lists: list[DataFrame], k: int = POOL) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    return top(both.groupBy("item_id", "doc_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score")), k, 12)


def hybrid(questions: DataFrame, docs: DataFrame, k: int = TOP, pool: int = POOL, embed: Callable = embedded, index=None, mode: str = "hybrid") -> DataFrame:
    """mode: hybrid fuses both lists; dense and bm25 degrade to one of them, for a store without words or without vectors."""
    if mode == "dense":
        return dense(questions, docs, k, embed)
    if mode == "bm25":
        return bm25(questions, docs, k, index)
    if mode != "hybrid":
        raise ValueError(f"unknown mode: {mode}")
    return fused([bm25(questions, docs, pool, index), dense(questions, docs, pool, embed)], k)


def reranked(candidates: DataFrame, questions: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """Candidates in the order of token F1 between question and text (the default scorer of the reranking port)."""
    q = questions.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("q"))
    chosen = candidates.select("doc_id").distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= CANDIDATES else chosen  # else all texts would be shuffled
    wanted = docs.join(chosen, "doc_id", "left_semi").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("d"))
    scored = candidates.select("item_id", "doc_id").join(q, "item_id").join(wanted, "doc_id").select("item_id", "doc_id", T.token_f1(F.col("q"), F.col("d")).alias("score"))
    return top(scored, k)


def hybrid_reranked(questions: DataFrame, docs: DataFrame, k: int = TOP, rerank: Callable | None = reranked, **options) -> DataFrame:
    """rerank=None, where no reranker is there, keeps the first k in the order of fusion."""
    found = hybrid(questions, docs, POOL, **options)
    return rerank(found, questions, docs, k) if rerank else found.where(F.col("rank") <= k)


def with_fallback(found: DataFrame, questions: DataFrame, docs: DataFrame, k: int = SINGLE) -> DataFrame:
    """found, and the dense top k of the questions that found nothing."""
    none = questions.join(found.select("item_id").distinct(), "item_id", "left_anti")
    return found.unionByName(dense(none, docs, k))


STRATEGIES = {"bm25_only": lambda q, d: bm25(q, d, SINGLE), "dense_only": lambda q, d: dense(q, d, SINGLE), "hybrid": hybrid, "hybrid_rerank": hybrid_reranked}


def ablation(questions: DataFrame, docs: DataFrame, strategies=tuple(STRATEGIES)) -> DataFrame:
    """(strategy, item_id, doc_id, rank, score) of all strategies. The two ranked lists, POOL rows a question, are made once."""
    sparse, near = tables.cut(bm25(questions, docs, POOL)), tables.cut(dense(questions, docs, POOL))
    both = fused([sparse, near], POOL)
    runs = {"bm25_only": sparse.where(F.col("rank") <= SINGLE), "dense_only": near.where(F.col("rank") <= SINGLE), "hybrid": both.where(F.col("rank") <= TOP), "hybrid_rerank": reranked(both, questions, docs)}
    out = None
    for name in strategies:
        rows = runs[name].withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def compared(pairs: DataFrame, docs: DataFrame, k: int = SINGLE, retrieve: Callable = bm25) -> DataFrame:
    """(item_id, side, doc_id, rank, score): two independent retrievals for (item_id, a, b, aspect) rows, of `a aspect` and `b aspect`, in one pass."""
    sides = pairs.select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("name")), F.struct(F.lit(1).alias("side"), F.col("b").alias("name")))).alias("s"), "aspect")
    asked = sides.select((F.col("item_id") * 2 + F.col("s.side")).alias("item_id"), F.concat_ws(" ", "s.name", "aspect").alias("text"))
    found = retrieve(asked, docs, k)
    return found.select(F.floor(F.col("item_id") / 2).alias("item_id"), F.pmod("item_id", F.lit(2)).cast("int").alias("side"), "doc_id", "rank", "score")


def hits(found: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Results with the beginning of their texts and the score rounded to four digits."""
    return found.join(docs.select("doc_id", F.substring("text", 1, most).alias("excerpt")), "doc_id").select("item_id", "rank", "doc_id", F.round("score", 4).alias("score"), "excerpt")
