"""WARC archives, URL filter, vectors, mixing and the pipeline on small tables, against brute force."""

import base64
import hashlib
import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import embedding_dedup, mixing, queries, url_filter, warc
from siltstone.llm.common import work_dir

SF = "/root/testdata/sf0.001"


# --- twins --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "oracle"))
    from compare import of_spark, of_sql

    assert of_spark(queries.QUERIES[name](spark, SF)) == of_sql(queries.SQL[name], SF)


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


# --- WARC ------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/ é%", "<p>x</p>", 1), (2, None, "<p>x</p>", 2), (3, "u", None, 3), (4, "u v", "", 4), (5, "w", "é" * 100_000, 5), (5, "w", "é" * 100_000, 5), (None, "n", "<p>x</p>", 6), (7, "\x01", "WARC/1.0\r\n\x1f\x8b\x08 in a payload", 7)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int")
    got = warc.round_trip(spark, pages).collect()
    want = []
    for i, _, h, _ in PAGES:
        b = (h or "").encode()
        first = min(j for j, _, g, _ in PAGES if j is not None and (g or "").encode() == b)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.url for r in got} == {u for _, u, _, _ in PAGES}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def records(n=12, compressed=True):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        payload = bytes(rnd.randrange(256) for _ in range(rnd.randrange(4000))) + b"WARC/1.0\r\n" * (i % 3)
        data = warc.record(i, f"http://h/{i}", payload, warc.digest(payload))
        out.append((warc.member(data) if compressed else data, payload))
    return out


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("block", [512, 1 << 20])
def test_salvage(compressed, block):
    whole = records(compressed=compressed)
    data = b"".join(r for r, _ in whole)
    ends = np.cumsum([len(r) for r, _ in whole]).tolist()

    def read(x):
        found = list(warc.read_archive(io.BytesIO(x), block))
        return [(f[2]["warc-page-id"], f[3]) for f in found if f[0] == "record"], [f[1:3] for f in found if f[0] == "gap"]

    assert read(data) == ([(str(i), p) for i, (_, p) in enumerate(whole)], [])
    bad = bytearray(data)
    for at in (ends[2] - 30, ends[6] - 30):  # damage in records 2 and 6
        bad[at] ^= 255
    got, gaps = read(bytes(bad))
    assert [g[0] for g in got] == [str(i) for i in range(12) if i not in (2, 6)] and gaps == [(ends[1], ends[2]), (ends[5], ends[6])]
    got, gaps = read(b"junk" + data[: ends[3] - 5])
    assert [g[0] for g in got] == ["0", "1", "2"] and gaps == [(0, 4), (4 + ends[2], 4 + ends[3] - 5)]
    got, gaps = read(data[: ends[4]] + b"\0" * 5000 + data[ends[4] :])
    assert len(got) == 12 and gaps == [(ends[4], ends[4] + 5000)]
    assert read(b"") == ([], [])


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("length", ["²", "9" * 5000, "1" * 19, "-1", "999999999", ""])
def test_false_lengths_are_gaps(compressed, length):
    """A length that is no number, too large or beyond the file costs its record alone."""
    whole = [r for r, _ in records(6, False)]
    whole[2] = whole[2].replace(b"Content-Length: ", f"Content-Length: {length}".encode() + b"\r\nX-Old: ")
    data = [warc.member(r) if compressed else r for r in whole]
    found = list(warc.read_archive(io.BytesIO(b"".join(data)), 512))
    ends = np.cumsum([0, *map(len, data)]).tolist()
    assert [f[2]["warc-page-id"] for f in found if f[0] == "record"] == ["0", "1", "3", "4", "5"]
    assert [f[1:3] for f in found if f[0] == "gap"] == [(ends[2], ends[3])]


def test_a_false_length_is_not_read_ahead():
    """Nothing is buffered for it, however long the archive is."""
    data = [r for r, _ in records(3, False)] * 700
    size = sum(map(len, data))
    data[0] = data[0].replace(b"Content-Length: ", f"Content-Length: {size - 5000}\r\nX-Old: ".encode())
    most, more = 0, warc.Window.more

    def watched(self):
        nonlocal most
        most = max(most, len(self.data))
        return more(self)

    try:
        warc.Window.more = watched
        found = list(warc.read_archive(io.BytesIO(b"".join(data)), 1 << 16))
    finally:
        warc.Window.more = more
    assert sum(f[0] == "record" for f in found) == 2099 and most < 1 << 18 < size


def test_ids_beyond_64_bits_are_null(spark):
    folder = work_dir(spark, "test").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(warc.record("9" * 25, "u", b"x", warc.digest(b"x")) + warc.record(5, "u", b"x", warc.digest(b"x"), "1" * 30))
    got = warc.read_archives(spark.createDataFrame([(f"{folder}/a.warc",)], "file string")).collect()
    assert [(r.page_id, r.refers_to) for r in got] == [(None, None), (5, None)]


@pytest.mark.parametrize("compressed", [True, False])
def test_headers_of_any_length_are_read(spark, compressed):
    """A url of more than 1 MiB stands in its record's header."""
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "data:," + "% " * 700_000, "<p>b</p>"), (3, "v", "<p>c</p>")], "page_id long, url string, html string").repartition(1)
    files = warc.write_archives(pages, work_dir(spark, "test"), compressed=compressed).select("file").localCheckpoint()
    assert {r["page_id"]: (r["url"], bytes(r["payload"])) for r in warc.read_archives(files).collect()} == {r["page_id"]: (r["url"], r["html"].encode()) for r in pages.collect()}
    assert warc.read_archives(files, gaps=True).count() == 0


def test_gaps_are_logged(spark):
    folder = work_dir(spark, "test")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").repartition(1)
    name = warc.write_archives(pages, folder).collect()[0]["file"]
    with open(name, "r+b") as f:
        f.seek(100)
        f.write(b"\xff\xff\xff")
    files = spark.createDataFrame([(name,)], "file string")
    assert warc.read_archives(files).count() == 19
    gap = warc.read_archives(files, gaps=True).collect()
    assert len(gap) == 1 and gap[0]["first"] == 0 and gap[0]["past"] > 100


# --- URLs ----------------------------------------------------------------------------------------------------

URLS = [
    ("http://A.Example.COM/en/725?x", "a.example.com", "/en/725", "example.com/en/7"), ("https://example.com/en/8#t", "example.com", "/en/8", "com/en/"), ("x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/"),
    ("http://b.net/de/9", "b.net", "/de/9", "net/de/"), ("http://m.example.net/de/81/", "m.example.net", "/de/81/", "example.net/de/8"), ("http://c.org/es/", "c.org", "/es/", "org/es/"), ("http://c.org/es", "c.org", "/es", None),
    ("no scheme /en/", "", "", None), (None, "", "", None), ("", "", "", None), ("http://?q=/en/", "", "", None), ("a://b://com/en/", "b:", "//com/en/", None), ("http://com/en/1\n2", "com", "/en/1\n2", "com/en/"),
]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u[0], 0.5) for i, u in enumerate(URLS)], "page_id long, url string, score double")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == dict((r, v) for v, r in url_filter.RULES)[rule]
        if not URLS[i][0]:
            assert got[i].verdict == "allow" and got[i].score is None
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    one_class = url_filter.url_filter(pages.where("page_id in (1, 6)")).collect()
    assert {(r.page_id, r.verdict) for r in one_class} == {(1, "block"), (6, "allow")}


def test_url_model_against_brute_force(spark):
    """Scores of the variable-order model, counted and smoothed again in Python."""
    rnd = random.Random(2)
    word = lambda s: "".join(rnd.choice(s) for _ in range(6))
    train = [("allow", f"http://{word('abcd')}.net/{word('abcd')}") for _ in range(40)] + [("block", f"http://{word('wxyz')}.com/{word('wxyz')}") for _ in range(40)]
    model = url_filter.train(spark.createDataFrame(train, "ruling string, url string"), work_dir(spark, "test"))
    asked = [f"http://{word('abwx')}.net/{word('cdyz')}" for _ in range(20)]
    got = {r.url: r.score for r in url_filter.scores(spark.createDataFrame([(u,) for u in asked], "url string"), model).collect()}
    n = url_filter.ORDER
    grams = lambda u: [("\x02" * (n - 1) + u + "\x03")[i : i + n] for i in range(len(u) + 1)]
    counts = {k: [{}, {}] for k in range(1, n + 1)}
    for ruling, u in train:
        for g in grams(u):
            for k in counts:
                c = counts[k][ruling == "block"]
                c[g[-k:]] = c.get(g[-k:], 0) + 1

    def p(g, side):
        if not g:
            return 1 / 256
        c = {x: m for x, m in counts[len(g)][side].items() if x[:-1] == g[:-1]}
        low = p(g[1:], side)
        return (c.get(g, 0) + len(c) * low) / (sum(c.values()) + len(c)) if c else low

    for u in set(asked):
        assert abs(got[u] - np.mean([np.log(p(g, 0) / p(g, 1)) for g in grams(u)])) < 1e-6


def test_urls_that_repeat_and_tie(spark):
    """Repeated rows are judged alike; a URL whose score is the cut is allowed."""
    from unittest import mock

    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (2, "http://a.com/en/1"), (3, "http://b.net/de/1"), (4, "zz"), (4, "zz"), (None, "zz")], "page_id long, url string")
    got = url_filter.url_filter(pages).collect()
    assert len(got) == 6 and len({(r.url, r.verdict, r.score) for r in got}) == 3
    cut = got[0].cut
    with mock.patch.object(url_filter, "scores", lambda urls, model: urls.select("url").where("url <> ''").distinct().withColumn("score", F.lit(1.0))):
        got = {r.url: r for r in url_filter.url_filter(pages).collect()}
    assert got["zz"].score == got["zz"].cut and got["zz"].verdict == "allow" and cut is not None


def test_url_model_keeps_every_gram(spark):
    """More distinct grams than 65,536 in an order, with the settings of production: each has its own value, unseen ones back off."""
    rnd = random.Random(3)
    word = lambda s: "".join(rnd.choice(s) for _ in range(50))
    letters = "abcdefghijklmnopqrstuvwxyz"
    train = [("allow", "http://" + word(letters)) for _ in range(1500)] + [("block", "http://" + word(letters[5:] + "0123456789")) for _ in range(1500)]
    model = url_filter.train(spark.createDataFrame(train, "ruling string, url string"), work_dir(spark, "test"))
    n = url_filter.ORDER
    grams = lambda u: [("\x02" * (n - 1) + u + "\x03")[i : i + n] for i in range(len(u) + 1)]
    counts, sums, kinds = ([{}, {}] for _ in range(3))
    for ruling, u in train:
        for g in grams(u):
            for x in (g[-k:] for k in range(1, n + 1)):
                c, s, d = (y[ruling == "block"] for y in (counts, sums, kinds))
                d[x[:-1]] = d.get(x[:-1], 0) + (x not in c)
                c[x] = c.get(x, 0) + 1
                s[x[:-1]] = s.get(x[:-1], 0) + 1
    assert model.where(f"kind = 'lr' and k = {n}").count() == len({x for c in counts for x in c if len(x) == n}) > 1 << 16

    def p(g, side):
        if not g:
            return 1 / 256
        low, c, d = p(g[1:], side), sums[side].get(g[:-1], 0), kinds[side].get(g[:-1], 0)
        return (counts[side].get(g, 0) + d * low) / (c + d) if c else low

    asked = [u for _, u in train[::100]] + ["http://" + word(letters + "0123456789!é") for _ in range(50)]
    got = {r.url: r.score for r in url_filter.scores(spark.createDataFrame([(u,) for u in asked], "url string"), model).collect()}
    assert set(got) == set(asked)
    for u in asked:
        assert abs(got[u] - np.mean([np.log(p(g, 0) / p(g, 1)) for g in grams(u)])) < 1e-6


# --- vectors -----------------------------------------------------------------------------------------------


def brute_vectors(rows, t=0.93):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.array(v, float) / max(map(abs, v))
            ok[k] = (label, a / np.sqrt(a @ a))
    links = {k: {j for j in ok if j != k and ok[j][0] == ok[k][0] and len(ok[j][1]) == len(ok[k][1]) and ok[j][1] @ ok[k][1] >= t} for k in ok}
    part = {k: rows[k][0] for k in range(len(rows))}
    while True:
        new = {k: min([part[k], *(part[j] for j in links.get(k, ()))]) for k in part}
        if new == part:
            break
        part = new
    return sorted((rows[k][0], len(links.get(k, ())), part[k], rows[k][0] == part[k]) for k in part)


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_vectors_against_brute_force(spark, block):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rnd.normal(size=6) * rnd.choice([0.02, 0.15, 0.3])).tolist(), int(rnd.integers(0, 2))) for i in range(260)]
    rows += [(1000 + i, centres[0].tolist(), 1) for i in range(40)]  # one common vector
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 6, 1), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2004, [float("nan")] * 6, 1), (2005, [float("inf")] + [0.0] * 5, 1), (2006, centres[0].tolist(), None), (2007, [1.0, 0.0], 1), (2008, [2.0, 0.0], 1), (2009, [1e200] * 6, 0), (2010, [1e-200] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1)).repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, block=block).collect())
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    none = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in none] == [(None, 0, None, False)]


# --- mixing -------------------------------------------------------------------------------------------------


def test_targets_stop_at_the_cap():
    got = mixing.targets([1000, 10, 200, 0], [5, 2, 1, 5], 1.5, 2)
    assert abs(sum(got) - 1815) < 1e-6 and got[1] == 20 and got[3] == 0 and all(t <= 2 * s for t, s in zip(got, [1000, 10, 200, 0], strict=True))


def test_permutations_and_draws():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 3).tolist() != mixing.permuted(np.arange(1000), 1000, 4).tolist()
    slots = np.array([500, 3, 0, 70])
    counts, before = mixing.subtree(slots, 64, 1, 0, 9)
    assert counts.sum(0).tolist() == slots.tolist() and counts.sum(1).tolist() == [64] * 8 + [61] and not before.any()
    for lo, hi in ((0, 3), (3, 4), (4, 9)):  # a task's part of the tree is that of the whole
        part, start = mixing.subtree(slots, 64, 1, lo, hi)
        assert part.tolist() == counts[lo:hi].tolist() and start.tolist() == counts[:lo].sum(0).tolist()


def test_taken_is_the_same_for_any_split_and_as_the_slots_say(spark):
    """taken by document against the slots, word by word, over one partition and over seven, rows in any order."""
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["a", "b", "c", None]), " ".join(f"w{i}" for _ in range(rnd.choice((0, 1, 7, 60, 500))))) for i in range(200)]
    rows += [(300, "a", "x y z")] * 3 + [(None, "b", "q r")] * 2
    taken = []
    for n in (1, 7):
        rnd.shuffle(rows)
        out, slots = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(n), block=16, shard_slots=20)
        got, slots = out.toPandas(), slots.toPandas()
        taken.append(sorted((str(r.doc_id), str(r.source), int(r.taken)) for r in got.itertuples()))
    assert taken[0] == taken[1]
    for no, source in enumerate(["a", "b", "c", None]):
        mine = got[got.source.isna() if source is None else got.source == source].sort_values(["place", "doc_id", "size", "row"])
        times = np.zeros(int(mine["size"].sum()), int)
        for x in slots[slots.source_no == no].itertuples():
            times[x.block * 16 : x.block * 16 + x.words] += 1
        ends = np.cumsum(mine["size"].to_numpy())
        totals = sorted((str(i), int(times[e - n : e].sum())) for i, e, n in zip(mine["doc_id"], ends, mine["size"], strict=True))
        assert totals == sorted((str(i), int(t)) for i, t in zip(mine["doc_id"], mine["taken"], strict=True))
    ids = [sorted(r.doc_id or -1 for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(n), block=16).select("doc_id").collect()) for n in (1, 7)]
    assert ids[0] == ids[1]


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "é", "Z", None]), " ".join("w" for _ in range(rnd.choice((0, 1, 5, 90, 400, 3000)))), 1) for i in range(300)]
    rows += [(i, "a", "one  two\n", 1) for i in range(300, 500)] + [(600, "tiny", "x", 1), (601, "a", None, 1), (600, "tiny", "x", 1), (None, "a", "u v", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int").repartition(5).cache()
    out, slots = mixing.mix(df, block=16, shard_slots=50)
    got = out.toPandas()
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    for s, rows_of in got.groupby(got.source.fillna("~")):
        key = None if s == "~" else s
        assert set(rows_of.source_size) == {sizes[key]} and abs(rows_of.target.iloc[0] - want[key]) < 1e-6 and abs(rows_of.taken.sum() - want[key]) <= 0.5
    per_shard = {r.shard: r["count"] for r in slots.groupBy("shard").count().collect()}
    assert sorted(per_shard.values())[1:] == [50] * (len(per_shard) - 1)
    again = mixing.mix(df, block=16, shard_slots=50)[0].toPandas()
    assert sorted(map(str, again[["doc_id", "taken"]].values.tolist())) == sorted(map(str, got[["doc_id", "taken"]].values.tolist()))
    whole = mixing.mixed(df, block=16)
    assert whole.columns == df.columns and whole.join(df, ["doc_id", "text"], "left_anti").where("text is not null and doc_id is not null").count() == 0
    assert mixing.mix(df.limit(0))[0].count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------


def test_stages_over_awkward_rows(spark):
    """Nulls in every column, empty texts, repeated rows, ties, clashing columns, empty tables: stage by stage, chained lazily."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, _kept_id int, taken long"
    body = [(i, f"the cat number {i % 7} sat on the mat and the dog of house {i % 7} slept all day long", "en", "s", i, "k", i, i, i) for i in range(30)]
    odd = [(100, None, "en", "s", None, None, None, None, None), (101, "", None, None, None, None, None, None, None), (102, " 12 \n", "en", None, 0, None, 0, 0, 0), (None, "the cat number 9 sat on the mat and the dog of house 9 slept all night long", "en", None, 1, None, 1, 1, 1), (None, None, None, None, None, None, None, None, None), (None, "the cat number 9 sat on the mat and the dog of house 9 slept all night long", "en", None, 1, None, 1, 1, 1), body[3], body[3]]
    docs = spark.createDataFrame(body + odd, schema).repartition(3)
    for rows in (docs, docs.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES[:4]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns, name
        out = corpus_pipeline.STAGES[4][1](spark, kept, SF)
        assert {"doc_id", "source", "lang", "ids", "n_tokens"} <= set(out.columns)
        ids = sorted({-1 if r.doc_id is None else r.doc_id for r in out.collect()})
        assert ids == ([-1, *range(7)] if rows is docs else [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0 and stage(spark, docs.limit(0), SF).count() == 0, name


def test_two_pipelines_do_not_remove_each_others_folders(spark):
    import threading

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, threads = {}, []
    for n in range(2):
        threads.append(threading.Thread(target=lambda n=n: rows.update({n: sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())})))
        threads[-1].start()
    for t in threads:
        t.join()
    assert rows[0] == rows[1]


def test_the_shared_folder_is_never_local_on_a_cluster():
    from siltstone.sources import shared

    class Session:
        def __init__(self, master, named):
            self.sparkContext = type("C", (), {"master": master, "applicationId": "a-test"})
            self.conf = type("F", (), {"get": staticmethod(lambda name, default: named)})

    assert shared.shared_dir(Session("spark://h:7077", "hdfs://n/c/")) == "hdfs://n/c"
    assert shared.shared_dir(Session("local[4]", None)) == shared.shared_dir(Session("local[4]", "")) and shared.shared_dir(Session("local[4]", None)).startswith("file:")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared_dir(Session(master, None))


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    before = {r.doc_id: r.text for r in docs.collect()}
    groups = {}
    for i, t in before.items():
        groups.setdefault("".join(t.split()), []).append(i)
    exact = {min(g, key=lambda i: (-len(before[i]), i)) for g in groups.values()}
    sets = {}
    for i in exact:
        w = before[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    part = {i: i for i in exact}
    pairs = [(i, j) for i in exact for j in exact if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(5):
        for i, j in pairs:
            part[i] = part[j] = min(part[i], part[j])
    left = {i for i in exact if part[i] == i}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= left and all(r.round_trip for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()} and len(rows) == kept.count()  # stages chained lazily give the same
    assert len(rows) > len(left)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert all(r.ids == sp.encode(before[r.doc_id]) for r in rows)
