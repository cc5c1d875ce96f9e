"""What the operators of this package share: work folders, word hashing, connected components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import shared_dir, small_batches, trimmed

#: Bytes of text that are turned into numpy arrays at once (each such byte costs about 40 bytes meanwhile).
SLICE = 2 << 20
PIECE = 1 << 20


# --- work folders -------------------------------------------------------------------------------


_watched: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("watched", default=())


@contextlib.contextmanager
def watched():
    """Collects the work folders that this thread makes meanwhile."""
    made: list[str] = []
    before = _watched.set((*_watched.get(), made))
    try:
        yield made
    finally:
        _watched.reset(before)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    for made in _watched.get():
        made.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the driver ends; a work folder that stays does no harm
        pass


def saved(df: DataFrame, path: str, large: bool = False) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage ends there and a lost executor loses nothing. large: each row is megabytes, so that
    tasks may read them one by one."""
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").options(compression="zstd", **({"parquet.block.row.count.limit": "1"} if large else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- words --------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[_SPACE] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64), up to n."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            a = np.full(max(n, PIECE + 4096), x, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_places(column: pa.Array, most: int = SLICE):
    """(first, last + 1) of runs of a column's texts that hold about `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = before = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a, before = b, int(ends[b - 1])


def text_runs(column: pa.Array, most: int = SLICE):
    """The same with the texts as bytes; only one run at a time is in Python."""
    for a, b in text_places(column, most):
        yield a, b, column.slice(a, b - a).cast(pa.binary()).to_pylist()


def hashed_words(texts: list[bytes | None], lower: bool = True, ends: bool = False):
    """(hashes, offsets[, last three bytes]): 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z lower-cased;
    those of text i are hashes[offsets[i]:offsets[i + 1]]. A hash is a polynomial over random values of the bytes, mixed."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    whole = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    hashes, starts, tails = [], [], []
    at = 0
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        if end < len(whole):  # cut at white space; a longer word makes a longer piece
            while end < len(whole) and not _SPACE[whole[end - 1]]:
                end += 1
        a = whole[at:end]
        a = _LOWER[a] if lower else a
        space = _SPACE[a]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        s, e = edge[::2], edge[1::2]
        p, inv = _power(len(a) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * p[: len(a)])))
        hashes.append(mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        if ends:
            k = [np.where(e - j - 1 >= s, a[np.maximum(e - j - 1, 0)], 0).astype(np.uint32) for j in range(3)]
            tails.append(k[0] | k[1] << 8 | k[2] << 16)
        at = end
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = cat(starts, np.int64)
    out = cat(hashes, np.uint64), np.searchsorted(start, bounds)
    return (*out, cat(tails, np.uint32)) if ends else out


# --- connected components -----------------------------------------------------------------------


class Links:
    """Union-find over local row numbers; the smallest number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True


def _finish(batches):
    """Union-find over all edges that one task gets."""
    ids, pairs = {}, []
    for batch in batches:
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    order = sorted({x for p in pairs for x in p})
    ids = {x: i for i, x in enumerate(order)}
    links = Links(len(order))
    for x, y in pairs:
        links.join(ids[x], ids[y])
    yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array([order[links.root(i)] for i in range(len(order))], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, path: str, most_rounds: int = 60, few: int = 200_000) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b: long) reaches, itself included.

    Alternating large-star and small-star rounds (Kiveris and others, 2014), each written to the shared folder: nothing is
    collected, and a vertex with many neighbours is only a key of a partial aggregate and of a join that AQE can split.
    As soon as no more than `few` edges are left (a bound of one task's memory, counted first), a single task ends it by union-find.
    Edges from a vertex to itself and repeated edges do no harm; no edges give no rows."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, last = saved(e, f"{path}/0"), None
    if e.count() <= few:
        return saved(e.repartition(1).mapInArrow(_finish, "id long, component long"), f"{path}/ended")
    for i in range(1, most_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = saved(small.where("a <> b").distinct(), f"{path}/{i}")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
