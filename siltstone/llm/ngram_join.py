"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct five-word shingles. Equal sets are one class (by a 128-bit sum), so copies are
never compared. Two sets with Jaccard >= 0.8 share three shingles (COMMON; all, if one has fewer) among the first
n - ceil(0.8 n) + 3 of each in any order common to all; the order here is by hash, with the corpus's most frequent shingles last, so
passages that many documents share open no large buckets. Classes that share such a shingle, and whose sizes allow it, form a
bucket. Pairs in small buckets (SMALL) are counted: one that no large bucket holds must come up three times. In a large bucket a signature tree is built: a
leaf entry holds a bitmap of a whole set and its size, a node the OR of the bitmaps below and their range of sizes. A traversal of
node pairs drops those whose sizes or whose maximum possible overlap (common bits, and the shingles that share a bit) rule out a link.

A first traversal finds the entries that have any partner in their bucket which the bounds leave; only their full sets are fetched. Units
of the same entries are one from then on. The next pass, over the units of each set's first shingles (rare and frequent ones), builds trees of finer bitmaps from the
full sets and checks a pair on them as soon as the traversal comes to it, so a task passes on true links alone, and of those a spanning forest; that
joins most copies. The third, over all units that hold several components, finds the entries with a partner of another component that the
bounds leave, and the last checks those on their full sets, again at the leaf. Pairs and nodes of one component are passed over. So no link
between two components is missed, and a large group of near copies is never expanded into its pairs. Links are put together in distributed rounds.

A bucket of more than BUCKET classes or SHINGLES shingles is cut by size into blocks. Its entries all count as live; the first pass looks into
each block, the second at those pairs of blocks, each a unit of its own, whose sizes allow a link and that hold several components.

Shingles are 64-bit hashes: with n shingles in two sets, the chance that a hash collision changes a decision is about n**2 / 2**64.

Nulls and cases: null, empty and blank texts have empty sets and link with nothing (own component); texts of fewer than five words have one
shingle, the whole sequence. Rows that share a doc_id are one vertex; a null doc_id links nothing (component null). Texts are taken
whole. Empty tables give no rows. Other columns are ignored by `near_texts` and kept by `near_deduplicated`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, hashed_words, mix, saved, text_runs, trimmed, work_dir

SHINGLE = 5
BUCKET = 512
SHINGLES = 1 << 20
HEAVY = 1 << 16
OWNED = 100_000
FILTER = 1 << 22
FANOUT = 4
EARLY = 2
COMMON = 3
SMALL = 4
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    h, offsets = hashed_words(texts)
    k = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        k += h[j : len(h) - SHINGLE + 1 + j] * _FACTORS[j] if len(k) else k
    k = mix(k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(k[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((h[a:b] * np.array(_FACTORS[: b - a])).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return mix(s ^ _FACTORS[0]).sum(dtype=np.uint64).tobytes() + mix(s ^ _FACTORS[1]).sum(dtype=np.uint64).tobytes()


def prefix_size(n: int) -> int:
    """Two sets that are linked share at least min(n, COMMON) of each one's first so many shingles, in any order common to all."""
    return min(n, n - (4 * n + 4) // 5 + COMMON)


def bitmap(s: np.ndarray, each: int = 2) -> bytes:
    """Bits at the low bits of the hashes (so a half can be laid over the other to compare widths); `each` to 2 * `each` bits a shingle."""
    width = 64
    while width < each * len(s):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


_SETS = "kind int, doc_id long, n int, fp binary, bits binary, token long, df long"


def _sets(batches):
    """A row for each document (kind 0), and for shingles that several of a task's documents hold (kind 1)."""
    many, docs = [], 0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for a, b, texts in text_runs(batch.column("text")):
            sets = shingle_sets(texts)
            docs += b - a
            n = [len(s) for s in sets]
            none = pa.nulls(b - a, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * (b - a), pa.int32()), pa.array(ids[a:b], pa.int64()), pa.array(n, pa.int32()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), none, none],
                names=["kind", "doc_id", "n", "fp", "bits", "token", "df"],
            )
            tokens, df = np.unique(np.concatenate(sets), return_counts=True)
            many.append((tokens[df > 2], df[df > 2]))
            if len(many) > 64:
                many = [_summed(many)]
    if docs:
        tokens, df = _summed(many)
        best = np.argsort(-df, kind="stable")[: HEAVY // 4]
        best = best[df[best] >= max(4, docs // 1000)]
        none = lambda kind: pa.nulls(len(best), kind)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(best), pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.binary()), pa.array(tokens[best].view(np.int64)), pa.array(df[best].astype(np.int64))], names=["kind", "doc_id", "n", "fp", "bits", "token", "df"])


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    tokens, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return tokens, np.bincount(back, np.concatenate([p[1] for p in parts]), len(tokens)).astype(np.int64)


def _prefixes(heavy, bits: int):
    """(owner, tokens, places, early, fps, sizes): the prefixes of a batch's distinct sets by hash range, packed."""

    def run(batches):
        last = heavy.value
        for batch in batches:
            seen: dict[bytes, int] = {}
            tokens, sizes, first = [], [], []
            for _, _, texts in text_runs(batch.column("text")):
                for s in shingle_sets(texts):
                    if len(s) and (fp := fingerprint(s)) not in seen:
                        seen[fp] = len(seen)
                        if len(last):
                            late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                            rare = int(len(s) - late.sum())
                            s = np.concatenate((s[~late], s[late])) if late.any() else s
                        else:
                            rare = len(s)
                        at = np.arange(prefix_size(len(s)))
                        first.append(np.where(at < rare, at, at - rare) < EARLY)
                        tokens.append(s[: len(at)].copy())
                        sizes.append(len(s))
            if not seen:
                continue
            place = np.repeat(np.arange(len(tokens), dtype=np.uint32), [len(t) for t in tokens])
            early = np.concatenate(first)
            t = np.concatenate(tokens)
            order = np.argsort(t)
            t, place, early = t[order], place[order], early[order]
            owner = (t >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(t), np.int64)
            fps, n = np.frombuffer(b"".join(seen), "V16"), np.array(sizes, np.int32)
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            for i, j in zip(at, np.append(at[1:], len(t)), strict=True):
                used, back = np.unique(place[i:j], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(owner[i])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (t[i:j], back.astype(np.uint32), early[i:j], fps[used], n[used]))], names=["owner", "tokens", "places", "early", "fps", "sizes"])

    return run


def _buckets(batches):
    """Classes that share a prefix token and whose sizes allow a link: (bucket, block, fp, early) of large buckets, early telling that the token is
    among a class's first (block null where the bucket isn't cut); (fp, other, times) of the pairs in small ones."""
    state = {"next": TaskContext.get().partitionId() << 36}

    def answer(rows):
        tokens = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        fps = np.concatenate([np.frombuffer(r[3], "V16") for r in rows])
        sizes = np.concatenate([np.frombuffer(r[4], np.int32) for r in rows])
        early = np.concatenate([np.frombuffer(r[2], bool) for r in rows])
        base = np.cumsum([0] + [len(r[4]) // 4 for r in rows])
        place = np.concatenate([np.frombuffer(r[1], np.uint32).astype(np.int64) + b for r, b in zip(rows, base[:-1], strict=True)])
        kinds, first, back = np.unique(fps, return_index=True, return_inverse=True)
        n = sizes[first].astype(np.int64)
        node = back[place]
        order = np.lexsort((node, n[node], tokens))
        tokens, node, early = tokens[order], node[order], early[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1])
        tokens, node, early = tokens[keep], node[keep], early[keep]
        size = n[node]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (5 * size[:-1] < 4 * size[1:])  # sizes too far apart for any pair across
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(tokens)))
        start, count = start[count > 1], count[count > 1]
        # Runs of the same classes come from every shingle that copies with few changes share; one of them is enough.
        code = np.concatenate(([np.uint64(0)], np.cumsum(mix(node.astype(np.uint64) + np.uint64(77)))))
        soon = np.concatenate(([0], np.cumsum(early)))
        order = np.argsort(soon[start] - soon[start + count], kind="stable")  # of equal runs the one with most early places stays
        start, count = start[order], count[order]
        runs, times = np.unique(np.stack((code[start + count] - code[start], count.astype(np.uint64)), 1), axis=0, return_index=True, return_counts=True)[1:] if len(start) else ([], [])
        out_b, out_c, out_f, out_e = [], [], [], []
        out_p, out_q, out_t = [], [], []
        for r, w in zip(runs, times, strict=True):
            at = np.arange(start[r], start[r] + count[r])
            if len(at) <= SMALL:
                for i, j in ((i, j) for i in range(len(at)) for j in range(i + 1, len(at))):
                    if 5 * size[at[i]] >= 4 * size[at[j]]:
                        p, q = sorted((node[at[i]], node[at[j]]))  # nodes are in the order of their fps
                        out_p.append(p)
                        out_q.append(q)
                        out_t.append(w)
                continue
            block = np.maximum(np.arange(len(at)) // BUCKET, (np.cumsum(size[at]) - size[at]) // SHINGLES) if len(at) > BUCKET or size[at].sum() > SHINGLES else np.full(len(at), -1)
            out_b.append(np.full(len(at), state["next"]))
            out_c.append(block)
            out_f.append(kinds[node[at]])
            out_e.append(early[at])
            state["next"] += 1
        fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        out = []
        if out_b:
            fp = np.concatenate(out_f)
            cut = np.concatenate(out_c)
            out.append([pa.array(np.concatenate(out_b)), pa.array(cut, pa.int64(), mask=cut < 0), fixed(fp), pa.array(np.concatenate(out_e)), pa.nulls(len(fp), pa.binary()), pa.nulls(len(fp), pa.int64())])
        if out_p:
            m = len(out_p)
            out.append([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), fixed(kinds[out_p]), pa.nulls(m, pa.bool_()), fixed(kinds[out_q]), pa.array(out_t, pa.int64())])
        return [pa.RecordBatch.from_arrays(x, names=["bucket", "block", "fp", "early", "other", "times"]) for x in out]

    owner, rows = None, []
    for batch in batches:
        for o, *r in zip(*(batch.column(c).to_pylist() for c in ("owner", "tokens", "places", "early", "fps", "sizes")), strict=True):
            if o != owner and rows:
                yield from answer(rows)
                rows = []
            owner = o
            rows.append(r)
    if rows:
        yield from answer(rows)


class Node:
    """Bitmap (an integer) of `width` bits, sizes from lo to hi, most shingles that share a bit with another, what lies below, an entry
    below (its own, if it is a leaf), and whether all entries below are known to be alike in what a traversal asks (its own mark)."""

    __slots__ = ("bits", "width", "lo", "hi", "excess", "below", "item", "alike")

    def __init__(self, bits, width, lo, hi, excess, below, item):
        self.bits, self.width, self.lo, self.hi, self.excess, self.below, self.item, self.alike = bits, width, lo, hi, excess, below, item, False


def _folded(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def tree(items: list[tuple], parts: list | None = None) -> Node:
    """Of (n, bitmap bytes), at least one; entries of equal parts stand side by side."""
    level = []
    for i in sorted(range(len(items)), key=lambda i: (str(parts[i]) if parts else "", items[i])):
        n, raw = items[i]
        bits = int.from_bytes(raw, "little")
        level.append(Node(bits, 8 * len(raw), n, n, n - bits.bit_count(), (), i))
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FANOUT):
            below = level[i : i + FANOUT]
            width = min(x.width for x in below)
            bits = excess = 0
            for x in below:
                b = _folded(x.bits, x.width, width)
                bits |= b
                excess = max(excess, x.excess if x.width == width else x.hi - (b.bit_count() if not x.below else 0))
            above.append(Node(bits, width, min(x.lo for x in below), max(x.hi for x in below), excess, below, below[0].item))
        level = above
    return level[0]


def possible(x: Node, y: Node) -> bool:
    """Whether some entries of x and y may be linked: 100 * overlap >= 80 * union, that is 9 * overlap >= 4 * (sum of sizes)."""
    if 5 * x.hi < 4 * y.lo or 5 * y.hi < 4 * x.lo:
        return False
    if x.width == y.width:
        common, a, b = (x.bits & y.bits).bit_count(), x.excess, y.excess
    else:
        if x.width < y.width:
            x, y = y, x
        folded = _folded(x.bits, x.width, y.width)
        common, b = (folded & y.bits).bit_count(), y.excess
        a = b if x.below else x.hi - folded.bit_count()
    most = min(x.hi, y.hi, common + min(a, b))
    return 9 * most >= 4 * (x.lo + y.lo)


def traverse(root: Node, other: Node, skip=None):
    """Pairs of entries of two trees (or of one) that the bounds leave, by a traversal of node pairs without those that skip(x, y) tells to pass over."""
    todo = [(root, other)]
    while todo:
        x, y = todo.pop()
        if skip and skip(x, y):
            continue
        if x is y:
            below = x.below
            for i, a in enumerate(below):
                todo += [(a, b) for b in below[i + 1 :]]
            todo += [(a, a) for a in below if a.below]  # the nearest first
        elif possible(x, y):
            if not x.below and not y.below:
                yield x.item, y.item
            elif len(x.below) >= len(y.below):
                todo += [(a, y) for a in x.below]
            else:
                todo += [(x, b) for b in y.below]


def _by(batches, keys, columns):
    """Lists of the rows that agree in the keys, which stand one after the other."""
    last, items = None, []
    for batch in batches:
        for key, *item in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if key != last and items:
                yield last, items
                items = []
            last = key
            items.append(tuple(item))
    if items:
        yield last, items


def _code(fps: list[bytes]) -> int:
    """A number for a set of classes: units of the same classes are one, and two sets that share a number do no harm."""
    a = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, 2)
    return int(mix(mix(a[:, 0]) + a[:, 1]).sum(dtype=np.uint64).astype(np.int64))


def _live(batches):
    """(bucket, fp, early) of the entries that have a partner in the bucket which the bounds leave, by the number of their set. A pair of
    nodes whose entries all have one already tells nothing new."""
    for _, items in _by(batches, ("bucket",), ("fp", "n", "bits", "early")):
        found: set[int] = set()

        def done(x, found=found):
            if not x.alike:
                x.alike = all(map(done, x.below)) if x.below else x.item in found  # once true it stays so
            return x.alike

        if len(items) > 1:
            root = tree([i[1:3] for i in items])
            for pair in traverse(root, root, lambda x, y: done(x) and done(y)):
                found.update(pair)
        if found:
            kept = [items[i] for i in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([_code([i[0] for i in kept])] * len(kept), pa.int64()), pa.array([i[0] for i in kept], pa.binary()), pa.array([i[3] for i in kept], pa.bool_())], names=["bucket", "fp", "early"])


def _grown(items: list[tuple], x: int, y: int, sized: list[tuple], parts: list) -> list[Node]:
    """The trees of a unit's one or two blocks over (n, bitmap) of its items, whose first column is the block."""
    out = []
    for block in dict.fromkeys((x, y)):
        if at := [i for i, r in enumerate(items) if r[0] == block]:
            out.append(tree([sized[i] for i in at], [parts[i] for i in at]))
            todo = [out[-1]]
            while todo:
                node = todo.pop()
                node.item = at[node.item]
                todo += node.below
    return [out[0], out[-1]] if out and (x == y or len(out) == 2) else []


def _crossing(batches):
    """(unit, x, y, block, fp, part) of the entries that have a partner of another component which the bounds leave, by the number of their set."""
    for (_, x, y), items in _by(batches, ("bucket", "x", "y"), ("block", "fp", "part", "n", "bits")):
        found: set[int] = set()

        def alone(node, items=items):
            """The component of all entries below, None if there are several."""
            if not node.below:
                return items[node.item][2]
            if node.alike is False:
                parts = {alone(b) for b in node.below}
                node.alike = parts.pop() if len(parts) == 1 else None
            return node.alike

        def done(node, found=found):
            return all(map(done, node.below)) if node.below else node.item in found

        def skip(a, b, alone=alone, done=done):
            return ((p := alone(a)) is not None and p == alone(b)) or (done(a) and done(b))

        if trees := _grown(items, x, y, [i[3:] for i in items], [i[2] for i in items]):
            for pair in traverse(*trees, skip):
                found.update(pair)
        if found:
            kept = [items[i] for i in sorted(found)]
            code = _code([i[1] for i in kept])
            column = lambda k, kind, kept=kept: pa.array([i[k] for i in kept], kind)
            same = lambda v, kept=kept: pa.array([v] * len(kept), pa.int64())
            yield pa.RecordBatch.from_arrays([same(code), same(x), same(y), column(0, pa.int64()), column(1, pa.binary()), column(2, pa.int64())], names=["bucket", "x", "y", "block", "fp", "part"])


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets of 0.8 or more, in integers."""
    if len(s) > len(t):
        s, t = t, s
    common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * common >= 80 * (len(s) + len(t) - common)


def _search(batches):
    """(a, b): fps of linked pairs that join two components, checked on the full sets; a task passes on a spanning forest of them. Rows
    of a unit (bucket, x, y) stand one after the other: of one block (x = y), or of two, between which pairs are looked for."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for (_, x, y), items in _by(batches, ("bucket", "x", "y"), ("block", "fp", "part", "hashes")):
        of = [root(i[1] if i[2] is None else i[2]) for i in items]  # by the class, or the component that is known
        sets = [np.frombuffer(i[3], np.uint64) for i in items]

        def one(node, of=of):
            """The component of all entries below, None if there are several."""
            if node.alike or not node.below:
                return root(of[node.item])
            parts = (one(b) for b in node.below)
            first = next(parts)
            node.alike = first is not None and all(p == first for p in parts)  # components only grow
            return first if node.alike else None

        def same(p, q, one=one):
            return (a := one(p)) is not None and a == one(q)

        out = []
        if trees := _grown(items, x, y, [(len(v), bitmap(v, 4)) for v in sets], of):
            for i, j in traverse(*trees, same):
                if linked(sets[i], sets[j]):
                    up[root(of[i])] = root(of[j])
                    out.append((items[i][1], items[j][1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _wanted(chosen):
    """(fp, n, bits, hashes) of the sets that the filter lets through, with finer bitmaps."""

    def run(batches):
        bits = chosen.value
        for batch in batches:
            seen = set()
            for _, _, texts in text_runs(batch.column("text")):
                fps, sets, wide = [], [], []
                for s in shingle_sets(texts):
                    if len(s):
                        fp = fingerprint(s)
                        slot = int.from_bytes(fp[:4], "big") % FILTER
                        if bits[slot >> 3] >> (slot & 7) & 1 and fp not in seen:
                            seen.add(fp)
                            fps.append(fp)
                            sets.append(s.tobytes())
                            wide.append(bitmap(s, 4))
                if fps:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([len(x) // 8 for x in sets], pa.int32()), pa.array(wide, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "n", "bits", "hashes"])

    return run


def near_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    path = work_dir(spark, "ngrams")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = rows.select("text").where("text is not null")
    sets = saved(rows.mapInArrow(trimmed(_sets), _SETS), f"{path}/sets")
    found = sets.where("kind = 1").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(HEAVY).select("token").toPandas()
    heavy = spark.sparkContext.broadcast(np.sort(found["token"].to_numpy(np.int64).view(np.uint64)))  # HEAVY numbers at most; any list gives the same links
    classes = sets.where("kind = 0 and fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = saved(classes, f"{path}/classes")
    entries = classes.agg(F.coalesce(F.sum(F.expr("n div 5 + 1")), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, entries / OWNED))))
    dealt = texts.mapInArrow(trimmed(_prefixes(heavy, bits)), "owner int, tokens binary, places binary, early binary, fps binary, sizes binary").repartition(max(1, min(1 << bits, 100_000)), "owner").sortWithinPartitions("owner")
    shared = saved(dealt.mapInArrow(_buckets, "bucket long, block long, fp binary, early boolean, other binary, times long"), f"{path}/buckets")
    buckets = shared.where("bucket is not null").select("bucket", "block", "fp", "early")
    often = shared.where("bucket is null").groupBy(F.col("fp").alias("a"), F.col("other").alias("b")).agg(F.sum("times").alias("times"))
    often = often.where(F.col("times") >= COMMON)  # different sets of fewer shingles have no link
    star = F.expr(f"-1 - pmod(xxhash64(a), {1 << 62})")  # a bucket for a class and all it was counted with; two that share a number do no harm
    counted = often.select(star.alias("bucket"), F.explode(F.array("a", "b")).alias("fp"), F.lit(True).alias("early")).distinct()

    whole = buckets.where("block is null").select("bucket", "fp", "early").union(counted)
    whole = whole.join(classes.select("fp", "n", "bits"), "fp").repartition("bucket").sortWithinPartitions("bucket")
    live = whole.mapInArrow(_live, "bucket long, fp binary, early boolean").groupBy("bucket", "fp").agg(F.max("early").alias("early"))
    live = saved(live.withColumn("block", F.lit(0).cast("long")).unionByName(buckets.where("block is not null")), f"{path}/live")
    active = saved(live.select("fp").distinct(), f"{path}/active")
    slot = F.expr(f"pmod(cast(conv(hex(substring(fp, 1, 4)), 16, 10) as long), {FILTER})")
    slots = active.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)  # FILTER numbers at most
    chosen = np.zeros(FILTER // 8, np.uint8)
    np.bitwise_or.at(chosen, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    full = texts.mapInArrow(trimmed(_wanted(spark.sparkContext.broadcast(chosen.tobytes()))), "fp binary, n int, bits binary, hashes binary")
    full = saved(full.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "bits", "hashes"))).join(active, "fp", "left_semi"), f"{path}/full")

    together = lambda rows: rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def searched(units: DataFrame, name: str) -> DataFrame:
        """Links of (bucket, x, y, block, fp, part)."""
        dealt = together(units.join(full.select("fp", "hashes"), "fp"))
        return saved(dealt.mapInArrow(trimmed(_search), "a binary, b binary"), f"{path}/{name}-links")

    def connected(links: DataFrame, name: str) -> DataFrame:
        rep = lambda s: classes.select(F.col("fp").alias(s), F.col("rep").alias(f"rep_{s}"))
        edges = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        return components(edges, f"{path}/{name}-components")

    first = searched(live.where("early").select("bucket", F.col("block").alias("x"), F.col("block").alias("y"), "block", "fp", F.lit(None).cast("long").alias("part")), "first")
    parts = connected(first, "first")
    known = full.select("fp", "n", "bits").join(classes.select("fp", "rep"), "fp").join(parts, F.col("rep") == F.col("id"), "left").select("fp", "n", "bits", F.coalesce("component", "rep").alias("part"))
    marked = live.select("bucket", "block", "fp").join(known.drop("bits"), "fp")
    block = marked.groupBy("bucket", "block").agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("n", "part") for f in (F.min, F.max)))
    left, right = block.alias("l"), block.alias("r")
    unit = left.join(right, "bucket").where("l.block <= r.block and 5 * l.n_max >= 4 * r.n_min and 5 * r.n_max >= 4 * l.n_min")
    unit = unit.where("least(l.part_min, r.part_min) <> greatest(l.part_max, r.part_max)").select("bucket", F.col("l.block").alias("x"), F.col("r.block").alias("y"))
    unit = unit.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    crossing = together(marked.join(unit, ["bucket", "block"]).select("bucket", "x", "y", "block", "fp").join(known, "fp")).mapInArrow(_crossing, "bucket long, x long, y long, block long, fp binary, part long")
    second = searched(saved(crossing.distinct(), f"{path}/crossing"), "second")
    if not second.isEmpty():
        parts = connected(first.union(second), "second")
    whole = classes.select("fp", "rep").join(parts, classes["rep"] == parts["id"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    own = sets.where("kind = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "fp")
    linked = own.where("fp is not null and doc_id is not null").join(whole, "fp").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return linked.union(own.where("fp is null or doc_id is null").select("doc_id", "n_shingles", "doc_id"))


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its component; all columns stay."""
    name = "_dropped"
    while any(c.lower() == name for c in docs.columns):
        name = "_" + name
    gone = near_texts(docs).groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
