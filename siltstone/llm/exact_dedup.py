"""Exact dedup by an extendible-hash index on shared files.

One scan writes segments: a row for every document with the SHA-256 of its text without white space, and leads: each distinct text with the
number of its rows and the best of them. A task holds HELD bytes of distinct texts, compares every row with them by its bytes, and writes a
lead for each when it lets go of them, so a group of copies is pre-aggregated before any shuffle. Leads of several rows, and those of texts that more than SALT leads and a
share of 1 / HOT of all hold (HOT texts at most, so their hashes are sent to all tasks), are put together again in SALT parts of the tasks before their owner gets
them, so no owner reads a text once for each task.

The directory is built from counts of distinct keys by prefix: a bucket over capacity splits on its next bit, and the directory doubles when a
split needs more bits than it has, up to 2**MOST_BITS slots; beyond four distinct keys for each slot and unit of capacity the capacity grows with the number of keys.
The directory is a table in the shared folder. Owner tasks get whole buckets (key ranges), chain the texts that share a 64-bit key,
compare bytes, and write the index; the rows find their bucket in the directory and their group in the bucket's part of the index.

Nulls: a null text counts as empty; a null doc_id stays only where all of its group's are null. Of repeated rows (equal
doc_id and text) exactly one is kept. Texts of any length are held one at a time beside the HELD bytes; ties go by doc_id, then to the row read first. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import saved, text_runs, trimmed, work_dir

_WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of distinct texts that a task holds; parts that the leads of large groups are put together in first; share of the leads from which a text counts as one; bits of the directory.
HELD = 8 << 20
SALT = 64
HOT = 4096
MOST_BITS = 18
_SEGMENT = "sha binary, doc_id long, n_points long, mark long, tag long, text binary, n long, best_points long, best_id long, best_tag long"
_LEAD = ("sha binary", "text binary", "n long", "best_points long", "best_id long", "best_tag long")
_INDEX = "bucket int, chain int, sha binary, group_size long, best_points long, best_id long, best_tag long"


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, doc_id, tag): most code points, then smallest doc_id (null last), then first row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if rank(a) <= rank(b) else b


def _segments(batches):
    base, held, size = TaskContext.get().partitionId() << 40, {}, 0
    names = [c.split()[0] for c in _SEGMENT.split(", ")]

    def leads():
        groups = [(sha, t, n, *best) for t, (sha, n, best) in held.items()]
        held.clear()
        for a, b in runs([len(g[1]) for g in groups]):
            none = pa.nulls(b - a, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups[a:b]], pa.binary()), none, none, none, none, pa.array([g[1] for g in groups[a:b]], pa.binary()), *(pa.array([g[i] for g in groups[a:b]], pa.int64()) for i in range(2, 6))], names=names)

    for batch in batches:
        points, ids = pc.utf8_length(batch.column("text")).fill_null(0).to_pylist(), batch.column("doc_id").to_pylist()
        for a, b, texts in text_runs(batch.column("text")):
            sha = []
            for i, t in enumerate(texts, a):
                t = t.translate(None, _WHITE) if t else b""
                row, g = (points[i], ids[i], base + i), held.get(t)
                if g is None:
                    g = held[t] = [hashlib.sha256(t).digest(), 1, row]
                    size += len(t) + 300
                else:
                    g[1], g[2] = g[1] + 1, _better(g[2], row)
                sha.append(g[0])
            none = pa.nulls(b - a, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(ids[a:b], pa.int64()), pa.array(points[a:b], pa.int64()), batch.column("mark").slice(a, b - a), pa.array(range(base + a, base + b), pa.int64()), pa.nulls(b - a, pa.binary()), none, none, none, none], names=names)
            if size > HELD:
                yield from leads()
                size = 0
        base += len(batch)
    yield from leads()


def runs(sizes: list[int], most: int = 4 << 20):
    """(first, last + 1) of runs of about `most` bytes."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def build_directory(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(directory, buckets) from counts of keys by the longest prefix. A bucket is (local depth, prefix, keys); the directory, of
    2**depth slots, names each prefix's bucket. Only a bucket whose keys all share the longest prefix may stay over capacity."""
    bits = int(len(counts)).bit_length() - 1
    total = np.concatenate(([0], np.cumsum(counts)))
    directory, buckets, depth = np.zeros(1, np.int64), [(0, 0, int(total[-1]))], 0
    todo = [0]
    while todo:
        b = todo.pop()
        local, prefix, n = buckets[b]
        if n <= capacity or local == bits:
            continue
        if local == depth:  # double the directory
            directory, depth = np.repeat(directory, 2), depth + 1
        width = bits - local - 1
        left = int(total[(2 * prefix + 1) << width] - total[(2 * prefix) << width])
        buckets[b] = (local + 1, 2 * prefix, left)
        buckets.append((local + 1, 2 * prefix + 1, n - left))
        first = (2 * prefix + 1) << (depth - local - 1)
        directory[first : first + (1 << (depth - local - 1))] = len(buckets) - 1
        todo += [b, len(buckets) - 1]
    return directory, buckets


def _chains(batches):
    """Of rows sorted by key, for each key the chain of its distinct texts, told apart by their bytes: [bucket, sha, text, n, best]. Holds one key's chain."""
    key, chain = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = r["sha"][:8]
            if k != key and chain:
                yield chain
                chain = []
            key, row = k, (r["best_points"], r["best_id"], r["best_tag"])
            for c in chain:
                if c[2] == r["text"]:
                    c[3], c[4] = c[3] + r["n"], _better(c[4], row)
                    break
            else:
                chain.append([r["bucket"], r["sha"], r["text"], r["n"], row])
    if chain:
        yield chain


def _own(batches):
    """The index of an owner's buckets."""
    out = []

    def packed():
        kinds = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])

    for chain in _chains(batches):
        out += [(bucket, i, sha, n, *best) for i, (bucket, sha, _, n, best) in enumerate(chain)]
        if len(out) > 20000:
            yield packed()
            out.clear()
    yield packed()


def _put_together(batches):
    """Leads of the same text as one."""
    for chain in _chains(batches):
        for bucket, sha, text, n, best in chain:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "sha": pa.array([sha], pa.binary()), "text": pa.array([text], pa.binary()), "n": [n], "best_points": [best[0]], "best_id": pa.array([best[1]], pa.int64()), "best_tag": [best[2]]})


def build_index(docs: DataFrame, capacity: int = 512, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows, index), tables in the shared folder; rows have their bucket. capacity: distinct keys of a bucket; most_bits bounds the directory."""
    spark = docs.sparkSession
    path = work_dir(spark, "exact")
    segments = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("mark")).mapInArrow(trimmed(_segments), _SEGMENT), f"{path}/segments")
    slot = lambda bits: F.expr(f"cast(conv(hex(substring(sha, 1, 3)), 16, 10) as int) div {1 << (24 - bits)}")
    found = segments.where("n is not null").select("sha").distinct().groupBy(slot(most_bits).alias("p")).count().toPandas()  # at most 2**most_bits rows
    counts = np.zeros(1 << most_bits, np.int64)
    counts[found["p"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    directory, _ = build_directory(counts, max(capacity, -(-4 * int(counts.sum()) // len(counts))))
    table = pd.DataFrame({"slot": np.arange(len(directory), dtype=np.int32), "bucket": directory.astype(np.int32)})
    table = saved(spark.createDataFrame(table, "slot int, bucket int"), f"{path}/directory")
    depth = len(directory).bit_length() - 1
    placed = segments.withColumn("slot", slot(depth)).join(F.broadcast(table), "slot")  # 2**most_bits rows of two numbers at most

    names = [c.split()[0] for c in _LEAD]
    every = segments.where("n is not null").groupBy("sha").agg(F.count("*").alias("n_leads"))
    bar = max(SALT, every.agg(F.coalesce(F.sum("n_leads"), F.lit(0))).first()[0] // HOT)
    hot = saved(every.where(F.col("n_leads") > bar).select("sha", F.lit(True).alias("hot")), f"{path}/hot")
    leads = placed.where("n is not null").select("bucket", *names).join(F.broadcast(hot), "sha", "left")  # fewer than HOT hashes
    alone = (F.col("n") == 1) & F.col("hot").isNull()
    several = leads.where(~alone).drop("hot").repartition("bucket", F.expr(f"pmod(shiftright(best_tag, 40), {SALT})")).sortWithinPartitions("sha")
    leads = leads.where(alone).drop("hot").select("bucket", *names).unionByName(several.select("bucket", *names).mapInArrow(_put_together, "bucket int, " + ", ".join(_LEAD)))
    index = leads.repartition("bucket").sortWithinPartitions("sha").mapInArrow(_own, _INDEX)
    return placed.where("n is null").select("bucket", "sha", "doc_id", "n_points", "mark", "tag"), saved(index, f"{path}/index")


def exact_dedup(docs: DataFrame, capacity: int = 512) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points, mark (xxhash64 of the text), tag for each row of docs (doc_id, text)."""
    rows, index = build_index(docs, capacity)
    rows = rows.join(index.select("bucket", "sha", "group_size", "best_id", "best_tag"), ["bucket", "sha"])
    return rows.select("doc_id", F.col("best_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best_tag")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_points", "mark", "tag")


def exact_deduplicated(docs: DataFrame, capacity: int = 512) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns as they are. Rows are told apart by doc_id and text; rows that are
    equal in both are reduced to one in a branch of its own, which is planned only where such rows exist."""
    rows = exact_dedup(docs, capacity)
    name = "_kept"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    id_, mark = f"{name}_id", f"{name}_mark"
    kept = rows.where("kept").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(mark))
    left = docs.join(kept, on, "left_semi")
    again = rows.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).count().where("count > 1").select(id_, mark)
    if again.isEmpty():
        return left
    return left.join(again, on, "left_anti").union(left.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))
