"""Mixing sources to target weights in fixed-length blocks.

The words of a source, its rows in the order of a hash of their source, doc_id and text, are one stream that is cut into blocks of BLOCK words (the last may
be shorter). The order is that of the content, so the mix is the same however the table is split. A source's
target is its share of the mix by weight, at most `cap` times its words; what exceeds a cap is shared again by weight. The mix is a
sequence of slots, one block each, dealt to output shards: how many slots a shard takes of each source is drawn from a
multinomial distribution over what the sources still have to give (so the draws end at the targets exactly), and the j-th slot of
a source takes block p(j) of a pseudorandom permutation of the source's blocks, another one for each pass over the source. A
source's last slot may take the first words of its block only. Slots and documents' pieces meet in a join by (source, block).

The draws go down a binary tree of the shards: each node draws what its left half takes of what the node has, with a seed of its own, so a task
draws the shards of its subtree alone, and nothing but one row for each source is on the driver. Positions in a stream are
sums by bins of the hash first (about BIN rows each) and then within the bins, so a source that holds a third of all rows is never in one task.

Nulls: a null source is a source of its own, ordered last; null text has no words. Documents without words are taken 0 times.
Repeated rows are rows of their own: which of them comes first is not determined, what they are taken together is. Empty tables
give no rows. Other columns are ignored by `mix` and kept by `mixed`. A text of any length is counted whole: it is one row that may cover many blocks, and is never
itself moved with them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import mix as spread_bits
from siltstone.llm.common import saved, work_dir

WEIGHTS = (5, 2, 1)
BLOCK = 128
SHARD_SLOTS = 4096
#: Shards that a task draws at a time, and rows of a source whose places are summed up in one task.
SUBTREE = 32
BIN = 8192
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Each source's target in words; sources above cap times their size stop there, the excess is shared again by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / total
        over = [i for i in open_ if out[i] > cap * sizes[i]]
        if not over:
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the places i: a Feistel network over the next power of four, walked along its
    cycles until it is below n."""
    if n < 2:
        return i.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x, out_of = i.astype(np.uint64), np.ones(len(i), bool)
    while out_of.any():
        y = x[out_of]
        left, right = y >> np.uint64(half), y & low
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
            left, right = right, left ^ (spread_bits(right ^ salt) & low)
        x[out_of] = left << np.uint64(half) | right
        out_of[out_of] = x[out_of] >= n
    return x.astype(np.int64)


def draw(left: np.ndarray, need: int, rng: np.random.Generator) -> np.ndarray:
    """need slots of those left by source: multinomial, drawn again where a source would give more than it has."""
    got = np.zeros_like(left)
    while need:
        rest = left - got
        more = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        got, need = got + more, need - int(more.sum())
    return got


def subtree(slots: np.ndarray, shard_slots: int, seed: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts by shard and source, slots of each source before the first): the shards lo to hi - 1 (0 <= lo < hi <= the number of shards)."""
    n = -(-int(slots.sum()) // shard_slots)
    size = lambda x: min(x * shard_slots, int(slots.sum()))  # noqa: E731  slots of the first x shards
    out, before = np.zeros((hi - lo, len(slots)), np.int64), np.zeros_like(slots)
    todo = [(0, n, slots, before)]
    while todo:
        a, b, own, at = todo.pop()
        if b - a == 1:
            out[a - lo] = own
            before = at if a == lo else before
            continue
        half = (a + b) // 2
        got = draw(own, size(half) - size(a), np.random.Generator(np.random.Philox(key=[seed, a << 32 | b])))
        todo += [x for x in ((a, half, got, at), (half, b, own - got, at + got)) if x[0] < hi and x[1] > lo]
    return out, before


def mix(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, cap: int = 2, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, slots). documents: doc_id, source, size, source_size, target, taken, row (row_id, or a number given here) and place (the hash);
    slots: shard, source_no, pass, block, words, the mix itself."""
    spark = docs.sparkSession
    path = work_dir(spark, "mix")
    row = F.col(row_id) if row_id else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.col("source").cast("string"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sized = docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), place.alias("place"))
    sized = saved(sized, f"{path}/sized")
    bits = max(0, math.ceil(math.log2(max(1, sized.count() / BIN))))
    sized = sized.withColumn("bin", F.shiftright("place", 63 - bits).cast("long"))  # 2 ** (bits + 1) bins in the order of the hash
    by_bin = saved(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")), f"{path}/bins")
    sources = sorted(((r["source"], r["words"]) for r in by_bin.groupBy("source").agg(F.sum("words").alias("words")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    size = [w for _, w in sources]
    target = targets(size, [weights[i % len(weights)] for i in range(len(size))], share, cap)
    want = [round(t) for t in target]
    blocks = [math.ceil(s / block) for s in size]
    passes = [w // s if s else 0 for w, s in zip(want, size, strict=True)]
    rest = [w - p * s for w, p, s in zip(want, passes, size, strict=True)]
    slots = np.array([p * k + math.ceil(r / block) for p, k, r in zip(passes, blocks, rest, strict=True)], np.int64)
    shards = -(-int(slots.sum()) // shard_slots)

    def fill(batches):
        for lo in (x * SUBTREE for batch in batches for x in batch.column(0).to_pylist()):
            hi = min(lo + SUBTREE, shards)
            counts, before = subtree(slots, shard_slots, seed, lo, hi)
            for no in np.flatnonzero(counts.sum(0)).tolist():
                n = int(counts[:, no].sum())
                j = np.arange(before[no], before[no] + n)
                k, whole = blocks[no], size[no] // block
                turn, i = j // k, j % k
                b, words = i.copy(), np.where(i < whole, block, size[no] - whole * block)
                for t in np.unique(turn):
                    here = (turn == t) & (i < whole)
                    b[here] = permuted(i[here], whole, seed * 1_000_003 + no * 1009 + int(t))
                    if t == passes[no]:  # the pass that isn't completed
                        words[turn == t] = np.minimum(words[turn == t], rest[no] - i[turn == t] * block)
                shard = np.repeat(np.arange(lo, hi), counts[:, no])
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(np.full(n, no), pa.int32()), pa.array(turn, pa.int32()), pa.array(b, pa.int64()), pa.array(words, pa.int64())], names=["shard", "source_no", "pass", "block", "words"])

    tasks = -(-shards // SUBTREE)
    plan = spark.range(0, tasks, 1, max(1, min(tasks, 10_000)))
    slot_table = saved(plan.mapInArrow(fill, "shard long, source_no int, pass int, block long, words long"), f"{path}/slots")  # a table, so that its true size rules out a broadcast
    known = spark.createDataFrame([(s, i, w, t) for i, ((s, w), t) in enumerate(zip(sources, target, strict=True))], "source string, source_no int, source_size long, target double")
    start = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bin.withColumn("base", F.coalesce(F.sum("words").over(start), F.lit(0))).alias("b").join(known.alias("k"), F.col("b.source").eqNullSafe(F.col("k.source"))).select(F.col("b.source").alias("s"), F.col("bin").alias("t"), "base", "source_no", "source_size", "target")
    within = Window.partitionBy("source", "bin").orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = ordered.join(base, (F.col("bin") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("at", F.col("base") + F.col("before"))
    placed = saved(placed.select("row", "doc_id", "source", "size", "source_no", "source_size", "target", "at", "place"), f"{path}/placed")
    pieces = placed.where("size > 0").select("row", "source_no", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    part = F.greatest(F.lit(0), F.least(F.expr("at + size"), F.expr(f"block * {block} + words")) - F.greatest(F.col("at"), F.expr(f"block * {block}")))
    taken = pieces.join(slot_table.select("source_no", "block", "words").hint("merge"), ["source_no", "block"]).groupBy("row").agg(F.sum(part).alias("taken"))
    out = placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "row", "place")
    return out, slot_table


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix repeats them, all columns as they are: a document of which the mix takes x times its words comes floor(x)
    times, and once more with the probability of the remainder (by a hash of its content), so documents stay whole and the sources'
    words come to their targets on average."""
    row = "_row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row = "_" + row
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), f"{work_dir(docs.sparkSession, 'mixed')}/docs")
    out, _ = mix(numbered, row_id=row, **options)
    chance = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    times = out.where("taken > 0").select(F.col("row").alias(row), F.floor(F.col("taken") / F.col("size") + chance).cast("int").alias(f"{row}_times")).where(F.col(f"{row}_times") > 0)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return numbered.join(times, row).select(*cols, F.explode(F.sequence(F.lit(1), F.col(f"{row}_times"))).alias(f"{row}_again")).select(*cols)
