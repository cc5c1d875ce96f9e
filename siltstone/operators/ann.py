"""An index for nearest vectors: cells around two levels of centres, residuals as product codes, and an exact rerank of what the codes favour.

About the root of the row count of cells (so about as many rows in each), below about the root of as many top centres. Centres and code words are fitted on a bounded sample, PER_CELL rows for each
cell by a hash of the id, in Spark: the top centres by rounds of assignment and sums, those below each of them, and the code words of each slice of dimensions,
as groups of at most FIT rows. Every row is then put into its nearest cell and stored there with its code, a byte for each slice of about SLICE dimensions of what its cell's centre
leaves. Where centres and what is to be compared with them meet, they are shuffled to the same task, centres first; nothing but the top centres and code words is sent
to all tasks.

A query looks into the `probes` cells nearest to it, finds the `shortlist` best rows by lookup tables over codes, and takes the k best of these by exact cosines. How many probes and how long a
shortlist a table needs is measured when it is built: MEASURED of its own rows are asked by brute force too, and probes (then the shortlist) grow until recall reaches
`target`. The measured recall and the share of rows that those queries read are kept with the index, so a caller knows both. Vectors that fall into clusters need few
cells; those that don't may need most of them, and then the share says that a scan would do.

Cases: rows without a length (null, empty, zero, or with a null in it) are neither stored nor found; shorter vectors are filled up with 0. Equal vectors tie by id. A vector doesn't find its
own number. Empty tables give an index that finds nothing.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import retrieval
from siltstone.operators.retrieval import ROWS, Best, _filled
from siltstone.operators.tables import cut
from siltstone.sources.shared import small_batches, trimmed

#: Rows of the sample for each cell, rows that one group is fitted on at most, rounds of fitting.
PER_CELL, FIT, ROUNDS = 64, 65_536, 6
#: Dimensions of a slice, code words of a slice, and parts that cells are stored in.
SLICE, WORDS, BUCKETS = 4, 256, 64
#: Rows that recall is measured with, neighbours of each, and what is added to the target when probes are chosen.
MEASURED, NEIGHBOURS, MARGIN = 200, 5, 0.02
#: Rows of a cell that a task gets, and queries that it compares at once with ROWS of them.
PART_ROWS, AT_ONCE = 1 << 18, 256
#: Numbers of the centres that a task writes beside rows at once.
NUMBERS = 1 << 20
SHORTLIST = 50
_VECTOR = "vector array<double>"


def _groups(batches, keys: tuple[str, ...]):
    """Batches cut where the keys change: (key values, whether it is the first of them, batch). Rows come sorted by the keys."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        starts = np.append(0, np.flatnonzero((np.diff(values) != 0).any(0)) + 1)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
            key = tuple(values[:, a].tolist())
            yield key, key != last, batch.slice(a, b - a)
            last = key


def _matrix(batch: pa.RecordBatch, width: int, name: str = "vector") -> np.ndarray:
    return _filled(pa.array(np.zeros(len(batch), np.int64)), batch.column(name), width)[1]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _unit(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of length 1; where a sum has none, the row before."""
    norms = np.linalg.norm(x, axis=1)
    return np.where(norms[:, None] > 0, x / np.maximum(norms, 1e-300)[:, None], before)


def _fitted(x: np.ndarray, k: int, spherical: bool) -> np.ndarray:
    """k-means of a group's rows, from its first k distinct rows on."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([_nearest(x[i : i + 4096], c) for i in range(0, len(x), 4096)])
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = _unit(sums, c) if spherical else np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


# --- fitting ----------------------------------------------------------------------------------


def _top_centres(sample: DataFrame, n: int, width: int) -> np.ndarray:
    """Rounds of k-means over the sample: tasks give sums by centre, which are added up and made the next centres. n vectors, about the fourth root of the rows, go to the driver."""
    first = sample.orderBy(F.xxhash64("id"), "id").limit(n).select("vector").toArrow()
    c = np.unique(_matrix(first.to_batches()[0], width), axis=0) if first.num_rows else np.zeros((0, width))
    for _ in range(ROUNDS if len(c) > 1 else 0):
        shared = sample.sparkSession.sparkContext.broadcast(c)

        def sums(batches, shared=shared):
            c = shared.value
            total = np.zeros_like(c)
            for batch in batches:
                x = _matrix(batch, width)
                np.add.at(total, _nearest(x, c), x)
            some = np.flatnonzero((total != 0).any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _lists(total[some])], names=["top", "vector"])

        def added(table: pa.Table) -> pa.Table:
            total = _lists(_matrix(table.combine_chunks().to_batches()[0], width).sum(0, keepdims=True))
            return pa.table({"top": table.column("top").slice(0, 1), "vector": total})

        rows = sample.select("vector").mapInArrow(sums, f"top int, {_VECTOR}").groupBy("top").applyInArrow(added, f"top int, {_VECTOR}").toArrow()
        new = np.zeros_like(c)
        if rows.num_rows:
            new[rows.column("top").to_numpy()] = _matrix(rows.combine_chunks().to_batches()[0], width)
        c = _unit(new, c)
    return c


def _bounded(rows: DataFrame, key: str) -> DataFrame:
    """At most FIT rows of each group, the first by a hash of their id."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("id"), "id"))).where(F.col("nth") <= FIT).drop("nth")


def _with_top(rows: DataFrame, tops: np.ndarray, beam: int, columns: list[str], width: int) -> DataFrame:
    """rows (columns, vector) with top: the beam nearest top centres of each."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)  # about the fourth root of the rows

    def run(batches):
        c = shared.value
        for batch in batches:
            x = _matrix(batch, width)
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :beam]
            again = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(again) for n in [*columns, "vector"]), pa.array(near.ravel().astype(np.int32))], names=[*columns, "vector", "top"])

    kinds = ", ".join(f"{n} long" for n in columns)
    return rows.select(*columns, "vector").mapInArrow(run, f"{kinds}, {_VECTOR}, top int")


def _routed(rows: DataFrame, key: str, centres: DataFrame, tops: np.ndarray, beam: int, most: int, width: int, ranked: bool = True) -> DataFrame:
    """(key, vector, cell, centre, near, place): the `most` cells nearest to each row below its beam top centres (ranked=False: of one, without place). Rows and centres meet by top centre, in slices of rows."""
    slices = 32
    data = _with_top(rows, tops, beam, [key], width).select("top", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), F.col(key).alias("number"), "vector")
    heads = centres.select("top", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.col("cell").cast("long").alias("number"), "vector")

    def run(batches):
        cells, c = np.zeros(0, np.int64), np.zeros((0, width))
        for (_, _, kind), new, batch in _groups(batches, ("top", "slice", "kind")):
            if kind == 0:
                x, numbers = _matrix(batch, width), batch.column("number").to_numpy()
                cells, c = (numbers, x) if new else (np.append(cells, numbers), np.concatenate([c, x]))
                continue
            few = max(1, NUMBERS // max(1, min(most, len(c)) * width))  # rows whose centres are written at once
            for part in (batch.slice(i, few) for i in range(0, len(batch), few)):
                x, numbers = _matrix(part, width), part.column("number").to_numpy()
                s = x @ c.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :most]
                row = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), part.column("vector").take(pa.array(row)), pa.array(cells[near.ravel()]), _lists(c[near.ravel()]), pa.array(s[row, near.ravel()])], names=[key, "vector", "cell", "centre", "near"])

    met = data.unionByName(heads).repartition("top", "slice").sortWithinPartitions("top", "slice", "kind").mapInArrow(trimmed(run), f"{key} long, {_VECTOR}, cell long, centre array<double>, near double")
    if not ranked:
        return met
    order = Window.partitionBy(key).orderBy(F.desc("near"), "cell")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _rows(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.select(F.col(name).cast("long").alias(name), retrieval.unit(F.col("embedding")).alias("vector")).where(F.col(name).isNotNull() & F.col("vector").isNotNull())


class Index:
    """A stored index: open() reads one, build() makes one. about: rows, width, cells, probes, shortlist, and the recall and share of rows read that were measured."""

    def __init__(self, spark: SparkSession, path: str, about: dict, tops: np.ndarray, words: np.ndarray):
        self.spark, self.path, self.about, self.tops, self.words = spark, path, about, tops, words

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        said = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(spark, path, said["about"], np.array(said["tops"]).reshape(-1, said["about"]["width"]), np.array(said["words"]))

    def _save(self) -> None:
        said = json.dumps({"about": self.about, "tops": self.tops.tolist(), "words": self.words.tolist()})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/about")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id long, cell long, code binary, {_VECTOR}, bucket int").parquet(f"{self.path}/rows")

    @property
    def centres(self) -> DataFrame:
        return self.spark.read.schema(f"top int, cell long, {_VECTOR}, n long").parquet(f"{self.path}/centres")

    # --- answering

    def _probed(self, asked: DataFrame, probes: int) -> DataFrame:
        """(query, vector, cell, centre, near, place) of the cells that (query, vector) rows look into. All top centres are looked below while they are few, else twice as many as hold the probes on average."""
        beam = min(len(self.tops), max(8, math.ceil(2 * probes * len(self.tops) / self.about["cells"])))
        return _routed(asked, "query", self.centres.drop("n"), self.tops, beam, probes, self.about["width"]).where("cell is not null")

    def search(self, queries: DataFrame, k: int = retrieval.SINGLE, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
        """(query, id, score, rank): the k nearest of (query, embedding) rows, their cosines rounded to six digits."""
        probes, shortlist = min(probes or self.about["probes"], max(1, self.about["cells"])), max(k, shortlist or self.about["shortlist"])
        asked = cut(_rows(queries, "query"))
        if not self.about["rows"]:
            return self.spark.createDataFrame([], "query long, id long, score double, rank int")
        probed = cut(self._probed(asked, probes).select("query", "vector", "cell"))
        wanted = cut(self._shortlisted(probed, shortlist))
        found = self.rows.select("id", "bucket", F.col("vector").alias("v")).join(wanted.select("query", "id", "bucket"), ["id", "bucket"]).join(asked, "query")
        scored = found.select("query", "id", F.round(retrieval.cosine(F.col("vector"), F.col("v")), 6).alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "score", "rank")

    def _shortlisted(self, probed: DataFrame, shortlist: int) -> DataFrame:
        """(query, id, bucket): the shortlist best rows of each query by codes. A cell's rows come in parts of about PART_ROWS, to each of which its queries and centre go first."""
        width, words, k = self.about["width"], self.words, shortlist
        shared = self.spark.sparkContext.broadcast(words)  # WORDS vectors
        sizes = self.centres.select("cell", "vector", (1 + F.floor(F.col("n") / PART_ROWS)).alias("parts"))
        cells = probed.select("cell").distinct().join(sizes, "cell")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        none, code = F.lit(None).cast(_VECTOR.split()[1]), F.lit(None).cast("binary")
        centre = cells.select("cell", every, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("number"), "vector", code.alias("code"))
        asked = probed.join(cells.select("cell", "parts"), "cell").select("cell", every, F.lit(1).alias("kind"), F.col("query").alias("number"), "vector", code.alias("code"))
        data = self.rows.select("id", "cell", "code", "bucket").join(cells.select("cell", "parts"), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(2).alias("kind"), F.col("id").alias("number"), none.alias("vector"), "code")

        def run(batches):
            words = shared.value  # slices x WORDS x dimensions
            m, _, d = words.shape
            centre, numbers, queries, best, cell = None, None, None, None, None

            def given():
                made = [b.batch(numbers[i : i + AT_ONCE]) for i, b in zip(range(0, len(numbers), AT_ONCE), best, strict=True)]
                made = pa.Table.from_batches(made).combine_chunks().to_batches() if made else []
                return [pa.RecordBatch.from_arrays([*m.columns, pa.array(np.full(len(m), cell))], names=["query", "id", "score", "cell"]) for m in made]

            for (at, _, kind), new, batch in _groups(batches, ("cell", "part", "kind")):
                if kind == 0:
                    if best is not None:
                        yield from given()
                    centre, best, queries, numbers, cell = _matrix(batch, width)[0], None, None, None, at
                elif kind == 1:
                    x, q = _matrix(batch, width), batch.column("number").to_numpy()
                    queries, numbers = (x, q) if new else (np.concatenate([queries, x]), np.append(numbers, q))
                else:
                    if best is None:
                        best = [Best(len(numbers[i : i + AT_ONCE]), k) for i in range(0, len(numbers), AT_ONCE)]
                    ids = batch.column("number").to_numpy()
                    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), m)
                    for i in range(0, len(numbers), AT_ONCE):  # however many queries look into the cell, scores are AT_ONCE times ROWS
                        q = np.zeros((len(numbers[i : i + AT_ONCE]), m * d))
                        q[:, :width] = queries[i : i + AT_ONCE]
                        table = np.einsum("qmd,mwd->mqw", q.reshape(-1, m, d), words)
                        base = (queries[i : i + AT_ONCE] @ centre)[:, None]
                        for a in range(0, len(ids), ROWS):
                            s = np.repeat(base, len(ids[a : a + ROWS]), 1)
                            for j in range(m):
                                s += table[j][:, codes[a : a + ROWS, j]]
                            best[i // AT_ONCE].add(s, ids[a : a + ROWS], numbers[i : i + AT_ONCE, None] != ids[a : a + ROWS])
            if best is not None:
                yield from given()

        met = centre.unionByName(asked).unionByName(data).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(trimmed(run), "query long, id long, score double, cell long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shortlist).select("query", "id", F.pmod("cell", F.lit(BUCKETS)).cast("int").alias("bucket"))

    # --- measuring

    def _measured(self, target: float) -> None:
        """Sets probes and shortlist so that MEASURED of the rows find at least `target` of their neighbours, and keeps what they found and read."""
        about = self.about
        asked = cut(self.rows.orderBy(F.xxhash64("id"), "id").limit(MEASURED).select(F.col("id").alias("query"), "vector"))
        n, k = asked.count(), min(NEIGHBOURS, about["rows"] - 1)
        if n == 0 or k == 0:
            about |= {"probes": max(1, about["cells"]), "recall": 1.0, "share": 1.0}
            return
        truth = cut(retrieval.nearest(asked, self.rows.select("id", "vector"), k, 6, own=False).join(self.rows.select("id", "cell"), "id"))
        order = cut(_routed(asked, "query", self.centres.drop("n"), self.tops, len(self.tops), about["cells"], about["width"]).join(self.centres.select("cell", "n"), "cell").select("query", "cell", "place", "n"))
        places = [r[0] for r in truth.join(order, ["query", "cell"]).select("place").orderBy("place").collect()]  # MEASURED x NEIGHBOURS at most
        probes = places[min(len(places), math.ceil(min(1.0, target + MARGIN) * len(places))) - 1]
        shortlist, whole = SHORTLIST, truth.count()
        while True:
            about |= {"probes": int(probes), "shortlist": shortlist}
            found = self.search(asked.select("query", F.col("vector").alias("embedding")), k).join(truth.select("query", "id"), ["query", "id"]).count()
            about["recall"] = round(found / whole, 4)
            if about["recall"] >= target or probes >= about["cells"] and shortlist >= about["rows"]:
                break
            probes, shortlist = min(about["cells"], math.ceil(probes * 1.25)), min(about["rows"], shortlist * 2)
        read = order.where(F.col("place") <= probes).agg(F.sum("n")).first()[0]
        about["share"] = round(read / (n * about["rows"]), 4)


def build(vectors: DataFrame, path: str, cells: int | None = None, target: float = 0.9) -> Index:
    """Writes an index of (id, embedding) rows to path. cells: about the root of the number of rows by default."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    _rows(vectors, "id").write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    cells = min(max(1, n), cells or max(1, round(math.sqrt(n))))
    every = max(1, n // (PER_CELL * cells))
    sample = cut(rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0))
    tops = _top_centres(sample, max(1, round(math.sqrt(cells))), width)
    about = {"rows": n, "width": width, "cells": 0, "sample": sample.count(), "probes": 1, "shortlist": SHORTLIST, "recall": 1.0, "share": 1.0}
    slices = -(-width // SLICE)
    if not n:
        index = Index(spark, path, about, tops, np.zeros((slices, 1, SLICE)))
        index._save()
        return index
    drawn = cut(_with_top(sample, tops, 1, ["id"], width))
    kept = cells / about["sample"]

    def below(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c = _fitted(_matrix(table.to_batches()[0], width), max(1, round(kept * table.column("whole")[0].as_py())), True)
        return pa.table({"top": pa.array(np.full(len(c), table.column("top")[0].as_py(), np.int32)), "place": pa.array(np.arange(len(c))), "vector": _lists(c)})

    sized = drawn.join(drawn.groupBy("top").agg(F.count("*").alias("whole")), "top")
    fitted = cut(_bounded(sized, "top").groupBy("top").applyInArrow(below, f"top int, place long, {_VECTOR}"))
    per = fitted.agg(F.max("place")).first()[0] + 1
    centres = cut(fitted.select("top", (F.col("top") * F.lit(per) + F.col("place")).alias("cell"), "vector"))
    about["cells"] = centres.count()

    def words_of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c = _fitted(_matrix(table.to_batches()[0], SLICE), WORDS, False)
        return pa.table({"slice": pa.array(np.full(len(c), table.column("slice")[0].as_py(), np.int32)), "vector": _lists(c)})

    left = _routed(sample, "id", centres, tops, 1, 1, width, False).select("id", F.zip_with("vector", "centre", lambda x, c: x - c).alias("r"))
    cuts = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    parts = left.orderBy(F.xxhash64("id"), "id").limit(FIT).select("id", cuts, "r").select("id", "slice", F.slice("r", F.col("slice") * SLICE + 1, F.lit(SLICE)).alias("vector"))
    words = np.zeros((slices, WORDS, SLICE))
    fit = parts.groupBy("slice").applyInArrow(words_of, f"slice int, {_VECTOR}").toArrow()
    for s in range(slices):
        own = fit.filter(pa.compute.equal(fit.column("slice"), s)).combine_chunks()
        c = _matrix(own.to_batches()[0], SLICE)
        words[s] = c[np.minimum(np.arange(WORDS), len(c) - 1)]
    shared = spark.sparkContext.broadcast(words)

    def coded(batches):
        words = shared.value
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, len(b), 4096)):
            r = np.zeros((len(batch), slices * SLICE))
            r[:, :width] = _matrix(batch, width) - _matrix(batch, width, "centre")
            codes = np.stack([_nearest(r[:, s * SLICE : (s + 1) * SLICE], words[s]) for s in range(slices)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cell"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vector")], names=["id", "cell", "code", "vector"])

    put = _routed(rows, "id", centres, tops, 1, 1, width, False).mapInArrow(coded, f"id long, cell long, code binary, {_VECTOR}")
    put = put.withColumn("bucket", F.pmod("cell", F.lit(BUCKETS)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "cell")
    with small_batches(spark):
        put.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    index = Index(spark, path, about, tops, words)
    centres.join(index.rows.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select("top", "cell", "vector", F.coalesce("n", F.lit(0)).alias("n")).write.mode("overwrite").parquet(f"{path}/centres")
    index._measured(target)
    index._save()
    return index
