"""Near-duplicate vectors by an epsilon grid order join (Boehm and others, 2001).

Unit vectors with cosine >= t lie at most e = sqrt(2 - 2t) apart. They are rotated to the principal dimensions of all vectors, and
sorted within their label by grid cells of width e on the leading dimensions (the epsilon grid order). Runs of BLOCK vectors of the sequence are
blocks with bounding boxes, eight (FANOUT_BITS) neighbouring intervals make one above them, and so on up to the whole sequence of a label. From there pairs of
intervals are joined recursively: those whose boxes are more than e apart are provably distant and are skipped, the others are replaced by the pairs of
what they hold, down to blocks; each level is one join by interval. Within a pair of blocks the recursion goes on, halves the two
sequence intervals, skips again, and compares the rest in double precision. Blocks go to their comparisons by tiles of four by four blocks (TILE_BITS), so a block is
shipped once for each tile and not for each partner. Equal vectors are one vector with
a count throughout, links inside a tile are counted there, and only a spanning forest of them is passed on to find the components.

Nulls and cases: a null label, a null vector, one with null or non-finite elements, of length 0 or norm 0 links with nothing (n_links
0, its own component, kept). Vectors of different dimensions never link. A null vec_id takes no part (component null, not kept).
Repeated vec_ids are vectors of their own with that number. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Links, components, saved, work_dir

THRESHOLD = 0.93
BLOCK = 1024
LEADING = 8
FANIN = 16
LEAF = 128
FANOUT_BITS = 3
TILE_BITS = 2
_SLACK = 1e-9


def _prepared(batches):
    """vec_id, label, dim, fp (null where the vector links with nothing) and the unit vector's bytes."""
    for batch in batches:
        labels, vectors = batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
        dims, fps, units = [], [], []
        for label, v in zip(labels, vectors, strict=True):
            dim = fp = unit = None
            if label is not None and v and None not in v:
                a = np.array(v, np.float64) + 0.0
                top = np.abs(a).max()
                if np.isfinite(top) and top > 0:
                    s = a / top  # the norm of very large or small elements neither overflows nor vanishes
                    dim, fp, unit = len(v), hashlib.blake2b(a.tobytes(), digest_size=16).digest(), (s / np.sqrt(s @ s)).tobytes()
            dims.append(dim)
            fps.append(fp)
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(fps, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "fp", "unit"])


def _moments(batches):
    """Second moments by dimension (d * d numbers), of the vectors or of other moments: tasks' sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.array(batch.column("dim").to_pylist())
        for d in set(dims.tolist()):
            here = batch.filter(pa.array(dims == d)).column(1).to_pylist()
            if len(here[0]) == 8 * d * d and batch.schema.names[1] == "moments":
                x = sum(np.frombuffer(m) for m in here)
            else:
                u = np.frombuffer(b"".join(here)).reshape(-1, d)
                x = (u.T @ u).ravel()
            sums[d] = sums.get(d, 0) + x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["dim", "moments"])


def principal(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the rotation whose first columns are the leading principal directions. Tasks' moments are added up in levels, FANIN of them in a task."""
    kind, rows = "dim int, moments binary", classes.select("dim", "unit")
    total, n = rows.mapInArrow(_moments, kind), rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FANIN)
        total = total.repartition(n).mapInArrow(_moments, kind)
    out = {}
    for r in total.collect():  # d * d numbers a dimension
        d = r["dim"]
        _, v = np.linalg.eigh(np.frombuffer(r["moments"]).reshape(d, d))
        out[d] = np.ascontiguousarray(v[:, ::-1])
    return out


def _box_gap(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def _hits(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Pairs with cosine >= t, by the epsilon grid order recursion over the two sequences."""
    e2 = 2 - 2 * t + _SLACK
    out = np.zeros((len(a), len(b)), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        x, y = a[i:j], b[k:m]
        if _box_gap(x.min(0), x.max(0), y.min(0), y.max(0)) > e2:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            s = x @ y.T
            out[i:j, k:m] = s >= t
            near = np.abs(s - t) < 1e-12
            for p, q in zip(*np.nonzero(near), strict=True):
                out[i + p, k + q] = math.sumprod(x[p].tolist(), y[q].tolist()) / math.sqrt(math.sumprod(x[p].tolist(), x[p].tolist()) * math.sumprod(y[q].tolist(), y[q].tolist())) >= t
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]
    return out


def _forest(hit: np.ndarray, own: bool) -> list[tuple[int, int]]:
    """Links (row, column) that span the components of a matrix of links, between two blocks or, own, within one."""
    out, rows, columns = [], np.zeros(len(hit), bool), np.zeros(hit.shape[1], bool)
    for i in np.flatnonzero(hit.any(1)).tolist():
        if rows[i]:
            continue
        rows[i], edge = True, [i]
        while len(edge):
            found = hit[edge] & ~columns
            new = np.flatnonzero(found.any(0))
            if not len(new):
                break
            out += [(edge[r], c) for r, c in zip(found[:, new].argmax(0).tolist(), new.tolist(), strict=True)]
            columns[new] = True
            if own:
                edge = new[~rows[new]].tolist()
            else:
                back = hit[:, new] & ~rows[:, None]
                edge = np.flatnonzero(back.any(1)).tolist()
                out += [(r, int(new[c])) for r, c in zip(edge, back[edge].argmax(1).tolist(), strict=True)]
            rows[edge] = True
    return out


def _join(t: float):
    """Links between the blocks of a tile: its rows, the blocks with those they are compared with, come one after the other."""

    def tile(rows):
        d = rows[0]["dim"]
        load = lambda r: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ns"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, d))
        blocks = {r["block"]: load(r) for r in rows}
        size = {b: len(x[0]) for b, x in blocks.items()}
        first = dict(zip(size, np.cumsum([0, *size.values()]).tolist(), strict=False))
        ids, n = (np.concatenate([x[k] for x in blocks.values()]) for k in (0, 1))
        links, up = np.zeros(len(ids), np.int64), Links(len(ids))
        for r in rows:
            for other in r["others"] or []:
                a, b = first[r["block"]], first[other]
                h = _hits(blocks[r["block"]][2], blocks[other][2], t)
                if a == b:
                    np.fill_diagonal(h, False)
                else:
                    links[b : b + size[other]] += n[a : a + len(h)] @ h
                links[a : a + len(h)] += h @ n[b : b + size[other]]
                for i, j in _forest(h, a == b):
                    up.join(a + i, b + j)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[[up.root(i) for i in some.tolist()]] if len(some) else ids[some])], names=["cid", "links", "other"])

    def run(batches):
        rows: list = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and any(rows[0][c] != r[c] for c in ("label", "dim", "x", "y")):
                    yield tile(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield tile(rows)

    return run


def block_pairs(blocks: DataFrame, path: str, width: float) -> DataFrame:
    """(label, dim, a, b, block_a, block_b): pairs of blocks whose boxes are at most width apart, a <= b being their places in the sequence, by the
    recursion over intervals of it."""
    top, low = (x or 0 for x in blocks.agg(F.max(F.expr("block >> 32")), F.max(F.expr("block & 4294967295"))).first())
    low_bits = -(-int(low).bit_length() // FANOUT_BITS) * FANOUT_BITS  # numbers without gaps between the tasks' blocks, so that levels shrink
    dense = F.expr(f"(block >> 32 << {low_bits}) | (block & 4294967295)")
    levels = -(-(int(top).bit_length() + low_bits) // FANOUT_BITS)
    boxes = [saved(blocks.select("label", "dim", dense.alias("node"), "block", "lo", "hi"), f"{path}/level-0")]
    each = lambda f, c, d: F.array(*(f(F.get(c, F.lit(i))) for i in range(d)))
    for k in range(1, levels + 1):
        above = boxes[-1].groupBy("label", "dim", F.shiftright("node", FANOUT_BITS).alias("node"))
        boxes.append(saved(above.agg(each(F.min, "lo", LEADING).alias("lo"), each(F.max, "hi", LEADING).alias("hi")), f"{path}/level-{k}"))
    gap = F.expr("aggregate(zip_with(zip_with(lo_a, hi_b, (x, y) -> x - y), zip_with(lo_b, hi_a, (x, y) -> x - y), (x, y) -> pow(greatest(0D, x, y), 2)), 0D, (s, x) -> s + coalesce(x, 0D))")
    pairs = boxes[-1].select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(levels - 1, -1, -1):
        side = lambda s, k=k: boxes[k].select("label", "dim", F.shiftright("node", FANOUT_BITS).alias(f"up_{s}"), F.col("node").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), *([F.col("block").alias(f"block_{s}")] if k == 0 else []))
        pairs = pairs.withColumnsRenamed({"a": "up_a", "b": "up_b"}).join(side("a"), ["label", "dim", "up_a"]).join(side("b"), ["label", "dim", "up_b"]).where("a <= b").where(gap <= width * width + _SLACK)
        pairs = saved(pairs.select("label", "dim", "a", "b", *(["block_a", "block_b"] if k == 0 else [])), f"{path}/pairs-{k}")
    if not levels:  # a single block a label
        pairs = boxes[0].select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"), F.col("block").alias("block_a"), F.col("block").alias("block_b"))
    return pairs


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    path = work_dir(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = saved(rows.mapInArrow(_prepared, "vec_id long, label string, dim int, fp binary, unit binary"), f"{path}/rows")
    valid = rows.where("fp is not null and vec_id is not null")
    classes = valid.groupBy("label", "dim", "fp").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), f"{path}/classes")
    axes = spark.sparkContext.broadcast(principal(classes))  # d * d numbers a dimension
    width = math.sqrt(2 - 2 * threshold) + _SLACK

    def place(batches):
        for batch in batches:
            dims, units = batch.column("dim").to_pylist(), batch.column("unit").to_pylist()
            y = [np.frombuffer(u) @ axes.value[d] for d, u in zip(dims, units, strict=True)]
            keys = [(np.floor(v[:LEADING] / width) + 128).astype(np.uint8).tobytes() for v in y]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "cid", "n")), pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in y], pa.binary())], names=["label", "dim", "cid", "n", "key", "y"])

    def cut(batches):
        base, run, of = TaskContext.get().partitionId() << 32, [], None

        def done():
            v = np.stack([np.frombuffer(x[2]) for x in run])
            lead = v[:, :LEADING]
            return pa.RecordBatch.from_pydict({"block": pa.array([base], pa.int64()), "label": pa.array([of[0]], pa.string()), "dim": pa.array([of[1]], pa.int32()), "lo": pa.array([lead.min(0).tolist()], pa.list_(pa.float64())), "hi": pa.array([lead.max(0).tolist()], pa.list_(pa.float64())), "ids": pa.array([np.array([x[0] for x in run], np.int64).tobytes()], pa.binary()), "ns": pa.array([np.array([x[1] for x in run], np.int64).tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

        for batch in batches:
            for label, dim, *x in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "cid", "n", "y")), strict=True):
                if run and (of != (label, dim) or len(run) == block):
                    yield done()
                    base, run = base + 1, []
                of = (label, dim)
                run.append(x)
        if run:
            yield done()

    placed = classes.select("label", "dim", "cid", "n", "unit").mapInArrow(place, "label string, dim int, cid long, n long, key binary, y binary")
    ordered = placed.repartitionByRange("label", "dim", "key", "cid").sortWithinPartitions("label", "dim", "key", "cid")
    blocks = saved(ordered.mapInArrow(cut, "block long, label string, dim int, lo array<double>, hi array<double>, ids binary, ns binary, vectors binary"), f"{path}/blocks")
    pairs = block_pairs(blocks, path, width)
    tiled = pairs.select("label", "dim", F.shiftright("a", TILE_BITS).alias("x"), F.shiftright("b", TILE_BITS).alias("y"), "block_a", "block_b")
    tiled = tiled.groupBy("label", "dim", "x", "y", F.col("block_a").alias("block")).agg(F.collect_list("block_b").alias("others"))  # at most as many as a side of a tile
    needed = tiled.unionByName(tiled.select("label", "dim", "x", "y", F.explode("others").alias("block"), F.lit(None).cast("array<long>").alias("others")))
    needed = needed.groupBy("label", "dim", "x", "y", "block").agg(F.max("others").alias("others"))
    both = needed.join(blocks.select("block", "ids", "ns", "vectors"), "block").repartition("label", "dim", "x", "y").sortWithinPartitions("label", "dim", "x", "y", "block")
    found = saved(both.mapInArrow(_join(threshold), "cid long, links long, other long"), f"{path}/links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")), f"{path}/components").withColumnRenamed("id", "cid")
    least = parts.join(classes.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("first"))
    parts = parts.join(least, "component").select("cid", "first")
    judged = classes.select("label", "dim", "fp", "cid", "n", "rep").join(links, "cid", "left").join(parts, "cid", "left")
    judged = saved(judged.select("label", "dim", "fp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id")), f"{path}/judged")
    linked = valid.select("vec_id", "label", "dim", "fp").join(judged, ["label", "dim", "fp"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("fp is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
