"""How far the sources of a language differ in their words: an audit by exact, smoothed shares.

Terms are found at the level of bytes: a lookup table over the concatenated UTF-8 of a slice of texts marks the bytes of terms, and edges of the marks are
the terms' ends. Slices are grouped by their xxHash, and every slice is compared with the first of its group byte by byte (those that differ get
a group by their bytes). A slice gives one row for each (lang, source, term), which Spark adds up, map side first.

Kept terms and their counts are written to the shared folder. Each language is cut into blocks of terms, about BLOCK counts each (LARGE at most where it has many sources), by a hash of the term; a block
holds all sources' counts of its terms as a CSR matrix, and the numbers of all sources. A block's part of a pair's divergence is a sum over the counts of one source's row (reduceat),
set against the other's as a dense vector, plus what the terms cost that the one lacks, from sorted shares and their running sums; Spark adds the parts of all blocks.
No pair of sources is joined, and one source, language or term that holds most rows is many tasks' work. Shares are found by long division in steps of
1,000 (exact while a language's words and smoothing together are under 9.2e15; beyond that by Python's integers).

Cases: null text, lang and source count as ''. A group without terms has count 0 of every kept term. A language without kept terms has pairs of value 0 and no
terms. Repeated rows count as often as they occur, and each is a document of its own; doc_id is not read. Texts of any length are read whole, in pieces cut between
terms (a term longer than a piece makes a longer piece). Ties are in the order of UTF-8. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import SLICE, saved, text_places, trimmed, work_dir

#: Documents that a term needs in its language, scale and smoothing of shares, terms of a group that are reported.
LEAST, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Counts of a block, about, and of a block of a language with very many sources: as many as pairs of sources, so that the parts of pairs are no more than the counts; rows of a batch
#: that a block gives.
BLOCK, LARGE = 32_768, 1 << 20
ROWS = 20_000
#: Languages whose sizes are sent to all tasks; more are joined by language.
LANGS = 1 << 16

_TERM = np.ones(256, bool)
_TERM[0x00:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_COUNTS = "lang string, source string, term binary, n long, docs long"


# --- terms ----------------------------------------------------------------------------------


def term_slices(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the terms in texts that lie end to end in data; text i is data[bounds[i]:bounds[i + 1]], and no term goes from one into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_term = _TERM[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = False, is_term[:-1]
    after[-1], after[:-1] = False, is_term[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(is_term & ~before), np.flatnonzero(is_term & ~after) + 1


def grouped_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(codes, terms): terms[codes[i]] is data[starts[i]:ends[i]]. Grouped by hash; every slice is compared with its group's first, and those
    that differ are grouped by their bytes."""
    whole, n = data.tobytes(), len(starts)
    hashes = np.array([hashed(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    _, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = ends - starts, first[codes]
    other = size != size[like]
    check = np.flatnonzero(~other & (like != np.arange(n)))
    for at in range(0, len(check), 1 << 16):  # index arrays of a few MB at a time
        i = check[at : at + (1 << 16)]
        run = np.arange(size[i].sum()) - np.repeat(np.cumsum(size[i]) - size[i], size[i])
        unlike = data[np.repeat(starts[i], size[i]) + run] != data[np.repeat(starts[like[i]], size[i]) + run]
        other[i] |= np.logical_or.reduceat(unlike, np.cumsum(size[i]) - size[i])
    terms = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    places: dict[bytes, int] = {}
    for i in np.flatnonzero(other).tolist():
        term = whole[starts[i] : ends[i]]
        if term not in places:
            places[term] = len(terms)
            terms.append(term)
        codes[i] = places[term]
    return codes, terms


def _pieces(text: bytes, most: int):
    """text in pieces of about `most` bytes, cut where no term is."""
    a = 0
    while a < len(text):
        b = min(a + most, len(text))
        while b < len(text):
            ahead = np.frombuffer(text, np.uint8, min(1 << 16, len(text) - b), b)
            gap = np.flatnonzero(~_TERM[ahead])
            if len(gap):
                b += int(gap[0])
                break
            b += len(ahead)
        yield text[a:b]
        a = b


def _counted(batches):
    """Counts of the terms of (text, lang, source) rows, a slice of texts at a time, and a row without a term for each group."""

    def rows(lang, source, terms, n, docs):
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for a, b in text_places(batch.column("text")):
            part = batch.slice(a, b - a)
            texts = pa.concat_arrays([part.column("text").cast(pa.binary())])
            langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            lang_of, source_of = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64)
            group = lang_of * len(sources.dictionary) + source_of
            group_codes, group = np.unique(group, return_inverse=True)
            named = [(langs.dictionary[int(g) // len(sources.dictionary)].as_py(), sources.dictionary[int(g) % len(sources.dictionary)].as_py()) for g in group_codes]
            yield rows([x for x, _ in named], [x for _, x in named], [b""] * len(named), [0] * len(named), [0] * len(named))
            if len(part) == 1 and len(texts[0].as_buffer()) > 2 * SLICE:  # a long text, piece by piece
                total: Counter[bytes] = Counter()
                for piece in _pieces(texts[0].as_py(), SLICE):
                    data = _LOWER[np.frombuffer(piece, np.uint8)]
                    codes, terms = grouped_slices(data, *term_slices(data, np.array([0, len(data)])))
                    for term, n in zip(terms, np.bincount(codes, minlength=len(terms)).tolist(), strict=True):
                        total[term] += n
                names, counts = list(total), list(total.values())
                for i in range(0, len(names), ROWS):
                    k = len(names[i : i + ROWS])
                    yield rows([named[0][0]] * k, [named[0][1]] * k, names[i : i + ROWS], counts[i : i + ROWS], [1] * k)
                continue
            bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            data, bounds = _LOWER[data], bounds - bounds[0]
            starts, ends = term_slices(data, bounds)
            if not len(starts):
                continue
            codes, terms = grouped_slices(data, starts, ends)
            row = np.searchsorted(bounds, starts, "right") - 1
            pair, n = np.unique(row * len(terms) + codes, return_counts=True)  # a document's terms
            key = group[pair // len(terms)] * len(terms) + pair % len(terms)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            key, n, docs = key[order][first], np.add.reduceat(n[order], first), np.diff(np.append(first, len(order)))
            g, t = key // len(terms), key % len(terms)
            langs, sources, spelled = pa.array([x for x, _ in named], pa.string()), pa.array([x for _, x in named], pa.string()), pa.array(terms, pa.binary())
            for i in range(0, len(key), ROWS):
                x, y = pa.array(g[i : i + ROWS]), pa.array(t[i : i + ROWS])
                yield rows(langs.take(x), sources.take(x), spelled.take(y), n[i : i + ROWS], docs[i : i + ROWS])


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term by group, and a row with the empty term for each group."""
    filled = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    found = documents.select(*filled).mapInArrow(trimmed(_counted), _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- divergences ----------------------------------------------------------------------------


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * n / total), exact, for n <= total."""
    n, total = np.broadcast_arrays(np.asarray(n), np.maximum(total, 1))  # 0 where a language keeps no term, so that no share counts
    if len(n) and int(total.max()) >= 9_200_000_000_000_000:
        return np.array([1 + SCALE * int(x) // int(y) for x, y in zip(n, total, strict=True)], np.int64)
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def block_divergences(source: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, all_total: int, terms: int):
    """Of a block's counts (source and term numbers) and each source's total (count of its words and smoothing, of all terms of the language; all_total: the
    language's): (a, total of each source's divergence from a in this block) for every source a, and last (group, term, excess over the language) of the TOP
    terms of each source."""
    order = np.lexsort((term, source))
    source, term, n = source[order], term[order], n[order]
    sizes = np.bincount(source, minlength=len(totals))
    ends = np.append(0, np.cumsum(sizes))
    some = np.flatnonzero(sizes)
    p, zero = share(n + SMOOTH, totals[source]), share(np.full(len(totals), SMOOTH), totals)
    for a in range(len(totals)):
        own, at = p[ends[a] : ends[a + 1]], term[ends[a] : ends[a + 1]]
        dense = np.full(terms, zero[a])
        dense[at] = own
        total = np.zeros(len(totals), np.int64)
        if len(some):
            step = np.abs(p - dense[term]) - np.abs(zero[source] - dense[term])
            total[some] = np.add.reduceat(step, ends[:-1][some])
        ranked = np.sort(own)
        sums = np.append(0, np.cumsum(ranked))
        below = np.searchsorted(ranked, zero)
        total += zero * below - sums[below] + (sums[-1] - sums[below]) - zero * (len(own) - below) + (terms - len(own)) * np.abs(zero - zero[a])
        yield a, total
    by_term = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[by_term], prepend=-1))
    q = np.zeros(terms, np.int64)
    if len(first):
        q[term[by_term][first]] = share(np.add.reduceat(n[by_term], first) + SMOOTH, all_total)
    excess = p - q[term]
    keep = np.flatnonzero(excess > 0)
    keep = keep[np.lexsort((term[keep], -excess[keep], source[keep]))]
    start = np.flatnonzero(np.diff(source[keep], prepend=-1))
    rank = np.arange(len(keep)) - np.repeat(start, np.diff(np.append(start, len(keep))))
    keep = keep[rank < TOP]
    yield source[keep], term[keep], excess[keep]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).combine_chunks()  # about BLOCK counts and the language's sources
    head = table.filter(pc.is_null(table.column("term")))
    rows = table.filter(pc.is_valid(table.column("term")))
    lang, kept, all_n = (head.column(c)[0].as_py() for c in ("lang", "kept", "all_n"))
    head = head.take(pc.sort_indices(head.column("source").cast(pa.binary())))
    names = head.column("source").combine_chunks()
    totals = head.column("n").to_numpy().astype(np.int64) + SMOOTH * kept
    spelled = rows.column("term").combine_chunks().dictionary_encode()
    spelled = spelled.combine_chunks() if isinstance(spelled, pa.ChunkedArray) else spelled
    by = pc.sort_indices(spelled.dictionary).to_numpy()
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    terms = spelled.dictionary.take(pa.array(by))
    source = pc.index_in(rows.column("source").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    result = lambda group, part, item, value: pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), group, pa.array([part] * len(value), pa.string()), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])
    for made in block_divergences(source, place[spelled.indices.to_numpy()], rows.column("n").to_numpy().astype(np.int64), totals, all_n + SMOOTH * kept, len(by)):
        if len(made) == 2:
            a, total = made
            others = np.delete(np.arange(len(names)), a)
            for i in range(0, len(others), ROWS):
                b = others[i : i + ROWS]
                yield result(names.take(pa.array(np.full(len(b), a))), "pair", names.take(pa.array(b)).cast(pa.binary()), total[b])
        else:
            group, term, excess = made
            yield result(names.take(pa.array(group)), "term", terms.take(pa.array(term)), excess)


def divergences(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of (text, lang, source) rows. part pair: value is the sum of the differences of shares between a source and item,
    another source of its language, over all kept terms; all of them. part term: the kept terms whose share in the source is above that in the language, the
    TOP ones."""
    path = work_dir(documents.sparkSession, "divergence")
    every = Window.partitionBy("lang", "term")
    counts = term_counts(documents).withColumn("among", F.sum("docs").over(every)).withColumn("nth", F.row_number().over(every.orderBy("source")))
    kept = saved(counts.where(f"among >= {LEAST} or term = X''").select("lang", "source", F.nullif("term", F.lit(b"")).alias("term"), "n", "nth"), f"{path}/kept")
    sources = F.count_if(F.col("term").isNull())
    blocks = 1 + F.floor(F.count("term") / F.least(F.greatest(F.lit(BLOCK), sources * sources), F.lit(LARGE)))
    langs = saved(kept.groupBy("lang").agg(F.count_if(F.expr("term is not null and nth = 1")).alias("kept"), F.sum("n").alias("all_n"), blocks.alias("blocks")), f"{path}/langs")
    langs = F.broadcast(langs) if langs.count() <= LANGS else langs
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("binary").alias("term"), "n", "kept", "all_n")
    rows = kept.where("term is not null").join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "kept", "all_n")
    parts = heads.unionByName(rows).groupBy("lang", "block").applyInArrow(trimmed_group(_block), "lang string, source string, part string, item binary, value long")
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' or rank <= {TOP}")
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


def trimmed_group(f):
    """trimmed for a function of groups, whose form is told by its annotations."""
    inner = trimmed(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from inner(batches)

    return run
