"""The stored index of words and the index of vectors: equal to a rebuild, measured against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ann, retrieval
from siltstone.operators.segments import Index


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(i: int, n: int = 9) -> str:
    return " ".join(f"w{(i * j * j) % 23}" for j in range(1, 3 + i % n)) + (" rare" if i % 41 == 0 else "")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3 RARE"), (3, "none"), (4, None), (5, "w0 w5 w7 w9"), (None, "w1")], "item_id int, text string")


def found(df):
    return {tuple(r) for r in df.collect()}


def test_changes_equal_a_rebuild(spark, asked, tmp_path, monkeypatch):
    from siltstone.operators import segments

    monkeypatch.setattr(segments, "RANGE", 8)
    monkeypatch.setattr(segments, "LEADERS", 1)
    index = Index(spark, str(tmp_path / "index"))
    assert index.search(asked).count() == 0
    there = {i: words(i) for i in range(150)} | {500: ""}
    assert index.apply("a", documents(spark, [*there.items(), (None, "w1 w1"), (None, "w2")]).repartition(3))
    same = lambda: found(index.search(asked, 6)) == found(retrieval.bm25(asked, documents(spark, [*there.items(), (None, "w1 w1"), (None, "w2")]), 6))
    assert same() and index.state().generations[0]["n"] == 153
    changed = {i: words(i + 1) for i in range(0, 60, 7)} | {600: "w1 rare", 601: "w3"}
    gone = [3, 5, 9, 10, 11, 9999]
    batch = documents(spark, [*changed.items(), (600, "zz second text of one batch"), (12, None)])
    deletes = spark.createDataFrame([(i,) for i in gone], "doc_id long")
    assert index.apply("b", batch, deletes)
    there = {i: t for i, t in (there | changed).items() if i not in (*gone, 12)}
    assert same() and index.state().number == 2
    assert not index.apply("b", batch, deletes) and index.state().number == 2 and same()  # a batch that runs twice
    assert index.apply("c", documents(spark, [(600, "w5"), (700, "w5 rare")]), new_only=True)  # 600 stays as it is
    there[700] = "w5 rare"
    assert same()
    before = Index(spark, index.root)
    index.compact()
    assert same() and len(index.state().generations) == 1 and found(before.search(asked, 6)) == found(index.search(asked, 6))
    index.remove_old()
    assert same() and sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("gen=")) == ["gen=4"]
    assert not index.apply("a", batch) and same()  # the ledger's names outlive compaction


def test_a_batch_that_broke_off_is_written_over(spark, asked, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "index"))
    index.apply("a", documents(spark, [(1, "w1"), (2, "w2")]))
    want = found(index.search(asked))

    def broken(state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_commit", broken)
        with pytest.raises(OSError, match="lost"):
            index.apply("b", documents(spark, [(3, "w1 w1")]))
    assert found(index.search(asked)) == want
    assert index.apply("b", documents(spark, [(3, "w1 w2")]))
    assert found(index.search(asked)) == found(retrieval.bm25(asked, documents(spark, [(1, "w1"), (2, "w2"), (3, "w1 w2")])))
    stale = index.state()
    index.apply("c", documents(spark, [(4, "w1")]))
    stale.number += 1
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(stale)


def test_texts_are_shuffled_only_where_numbers_repeat(spark, tmp_path, monkeypatch):
    """A batch without repeated numbers is taken in where its documents lie, and what is stored is compressed by zstd."""
    index, seen, write = Index(spark, str(tmp_path / "index")), [], Index._write
    monkeypatch.setattr(Index, "_write", lambda self, state, forward, *a: (seen.append(forward._jdf.queryExecution().toString()), write(self, state, forward, *a)))
    index.apply("a", documents(spark, [(1, "w1"), (2, "w2"), (None, "w1")]))
    index.apply("b", documents(spark, [(3, "w1 z"), (3, "w1 a")]))
    assert "Window" not in seen[0] and "Window" in seen[1]
    assert index.docs().where("doc_id = 3").first()["terms"] in (["w1", "a"], ["a", "w1"])
    assert all(".zstd." in p.name for p in (tmp_path / "index" / "gen=1").rglob("part-*.parquet"))


def test_a_posting_is_shuffled_and_stored_once(spark, tmp_path):
    """Two copies of each document, of which one changes and one goes, as bm25_index_top5 has them: words are stored once, packed, and tombstones hold none; with all that is shuffled they stay below twice the text."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 1200) % 40_000)) for i in range(1500)]
    documents(spark, rows).repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, asked = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(i, rows[i][1][:200]) for i in range(60)], "item_id long, text string")
    moved = lambda: sum(executors.apply(i).totalShuffleWrite() for executors in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(executors.size()))
    size = lambda what: sum(p.stat().st_size for p in (tmp_path / "index").glob(f"gen=*/{what}/**/*.parquet"))
    index, second, before, text = Index(spark, str(tmp_path / "index")), docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text"), moved(), sum(len(r[1]) for r in rows)
    index.apply("first", docs.select("doc_id", F.concat(F.lit("other "), "text").alias("text")).unionByName(second))
    index.apply("second", docs, second.select("doc_id"))
    got, went = found(index.search(asked, 5)), moved() - before
    assert got == found(retrieval.bm25(asked, docs, 5)) and len(got) == 300
    assert went + size("*") < 2 * text and size("dead") < 0.02 * text
    assert [g["number"] for g in index.state().generations] == [2]  # nothing of the first one is left


def test_what_is_packed_comes_out_again():
    import pyarrow as pa

    from siltstone.operators import segments

    texts, ids = ["a b a", "", "x" * 300_000 + " b", " ".join(f"w{i}" for i in range(500)), "điều b"], [5, -1, None, 2**60, 7]
    made = segments._chunk(9, pa.array(ids, pa.int64()), pa.array(texts), 2)
    none = lambda n, *kinds: [pa.nulls(n, kind) for kind in kinds]
    words = pa.RecordBatch.from_arrays([pa.array([1] * (len(made) - 1), pa.int64()), *(made.column(i).slice(0, len(made) - 1) for i in range(3)), *none(len(made) - 1, pa.int64(), pa.int32(), pa.int32())], names=segments._ROWS)
    docs = pa.RecordBatch.from_arrays([pa.array([1] * 5, pa.int64()), pa.array([9] * 5, pa.int64()), *none(5, pa.binary(), pa.binary()), pa.array(ids, pa.int64()), pa.array([3, 0, 2, 500, 2], pa.int32()), pa.array(range(5), pa.int32())], names=segments._ROWS)
    assert made.column("ranges")[-1].as_py() == [0, 0, 1, 1, 2] and made.column("dls")[-1].as_py() == [3, 0, 2, 500, 2]
    got = [r for b in segments._assembled([words.slice(0, 0), words.slice(0, 3), docs, words.slice(3)]) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == ids and [dict(zip(r["terms"], r["tfs"], strict=True)) for r in got] == [{w: x.split().count(w) for w in x.split()} for x in texts]


def test_generations_leave_the_ledger_when_nothing_of_them_is_left(spark, tmp_path, monkeypatch):
    """What they took out of others stays out, and their words are counted off no more. Questions have any kind of number, or there are none."""
    from siltstone.operators import segments

    monkeypatch.setattr(segments, "RANGE", 4)
    monkeypatch.setattr(segments, "CHUNK", 200)
    index, there = Index(spark, str(tmp_path / "index")), {}
    asked = spark.createDataFrame([("a", "w1 w2"), ("b", "RARE w3"), ("c", "none"), (None, "w1")], "item_id string, text string")
    numbered = asked.withColumn("item_id", F.ascii("item_id"))

    def same(numbers):
        docs = documents(spark, list(there.items())) if there else documents(spark, []).limit(0)
        want = {(chr(r[0]), *r[1:]) for r in found(retrieval.bm25(numbered, docs, 4))}
        for leaders in (4, 0):
            monkeypatch.setattr(segments, "LEADERS", leaders)
            assert found(index.search(asked, 4)) == want
        assert [g["number"] for g in index.state().generations] == numbers

    def put(batch, changed, gone=()):
        assert index.apply(batch, documents(spark, list(changed.items())) if changed else None, spark.createDataFrame([(i,) for i in gone], "doc_id long") if gone else None)
        there.update(changed)
        for i in gone:
            there.pop(i, None)

    put("a", {i: words(i) for i in range(60)})
    same([1])
    put("b", {i: words(i + 3) for i in (*range(0, 20), 70, 71)})  # takes some out of a
    same([1, 2])
    put("c", {i: words(i + 5) for i in range(0, 20)}, [70, 71])  # all of b, which keeps what it took out of a
    same([1, 2, 3])
    put("d", {80: "w1 rare"}, [*range(20, 60)])  # the rest of a, and with it b
    same([3, 4])
    put("e", {}, [*range(0, 20), 80])
    same([5])
    put("f", {1: "w1 w2 w2"})
    same([6])
    index.compact()
    assert [(r.doc_id, r.dl, dict(zip(r.terms, r.tfs, strict=True))) for r in index.docs().collect()] == [(1, 3, {"w1": 1, "w2": 2})]
    assert index.search(asked.limit(0)).count() == 0


def test_only_the_parts_of_the_words_are_read(spark, tmp_path):
    """The plan of the blocks holds a filter on the partition, and the bounds read no postings."""
    index = Index(spark, str(tmp_path / "index"))
    index.apply("a", documents(spark, [(i, words(i)) for i in range(50)]))
    seen = []
    cut = retrieval.tables.cut

    def kept(rows):
        seen.append(rows._jdf.queryExecution().toString())
        return cut(rows)

    from siltstone.operators import segments

    segments.cut, before, least = kept, segments.cut, segments.LEADERS
    segments.LEADERS = 0  # bounds are asked for however few documents there are
    try:
        index.search(spark.createDataFrame([(1, "w1")], "item_id int, text string")).collect()
    finally:
        segments.cut, segments.LEADERS = before, least
    bounds = next(p for p in seen if "bound" in p and "ReadSchema" in p)
    assert "PartitionFilters: [isnotnull(part" in bounds or "PartitionFilters: [(part" in bounds
    assert "tfs" not in bounds[bounds.index("== Physical Plan ==") :]


def test_stream_and_engine_write_one_layout(spark, asked, tmp_path):
    from siltstone.streaming import replay

    folder = str(tmp_path / "in.parquet")
    for i in range(3):
        rows = [(j, words(j), False) for j in range(i * 10, i * 10 + 10)] + ([(2, None, True), (3, "w1 w1 w1", None)] if i == 2 else [])
        spark.createDataFrame(rows, "doc_id long, text string, deleted boolean").coalesce(1).write.mode("append").parquet(folder)
    index = Index(spark, str(tmp_path / "index"))
    for _ in range(2):
        replay.refresh_index(replay.source(spark, folder, 1), index.root, str(tmp_path / "cp")).awaitTermination()
    there = {j: words(j) for j in range(30) if j != 2} | {3: "w1 w1 w1"}
    assert found(index.search(asked)) == found(retrieval.bm25(asked, documents(spark, list(there.items()))))
    index.apply("by hand", documents(spark, [(40, "w1 w2")]))
    assert found(index.search(asked)) == found(retrieval.bm25(asked, documents(spark, [*there.items(), (40, "w1 w2")])))


def test_engine_replaces_and_deletes(spark, tmp_path):
    from siltstone.engine import Engine
    from siltstone.sources.readers import DOCUMENT

    text = lambda what: f"Điều 1. {what} dành cho sinh viên giỏi của trường đại học này.\nĐiều 2. Ký túc xá mở cửa từ sáu giờ sáng đến mười giờ tối."
    doc = lambda key, what: (key, text(what), f"http://x/{key}", "law", "s", key, "")
    table = lambda *rows: spark.createDataFrame(list(rows), DOCUMENT)
    e, fresh = Engine(spark, str(tmp_path / "a"), mode="bm25"), Engine(spark, str(tmp_path / "b"), mode="bm25")
    e.ingest(table(doc("A", "Học bổng"), doc("B", "Trợ cấp"), doc("C", "Học phí")))
    for _ in range(2):
        e.replace(table(doc("B", "Học bổng mới")))
        e.delete(spark.createDataFrame([("C",)], "key string"))
    fresh.ingest(table(doc("A", "Học bổng"), doc("B", "Học bổng mới")))
    asked = spark.createDataFrame([(1, "học bổng mới"), (2, "trợ cấp"), (3, "học phí"), (4, "ký túc xá")], "item_id long, text string")
    assert found(e.search(asked)) == found(fresh.search(asked)) and e.chunks().count() == 4
    assert {(r.key, r.n_chunks) for r in e.list_documents().collect()} == {("A", 2), ("B", 2)}


# --- vectors ---------------------------------------------------------------------------------------------


def vectors(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>").repartition(8)


def recall(index, rows, every: int, k: int = 5) -> float:
    queries = rows.where(f"id % {every} = 3")
    got = found(index.search(queries.withColumnRenamed("id", "query"), k).select("query", "id"))
    want = found(retrieval.knn(queries.withColumnRenamed("id", "vec_id"), rows.withColumnRenamed("id", "vec_id"), k).select("query_id", "vec_id"))
    return len(got & want) / len(want)


def clustered(rng, n: int, width: int) -> np.ndarray:
    return np.repeat(rng.normal(size=(n // 20, width)), 20, axis=0) + 0.4 * rng.normal(size=(n // 20 * 20, width))


@pytest.mark.parametrize(("kind", "cells"), [("clustered", 100), ("clustered", 1000), ("gaussian", 100)])
def test_recall_is_measured_and_holds(spark, tmp_path, kind, cells):
    """Rows that aren't the measured ones find at least nine tenths too; where vectors fall into clusters less than a fifth of the rows are read."""
    rng = np.random.default_rng(4)
    rows = vectors(spark, clustered(rng, 10_000, 32) if kind == "clustered" else rng.normal(size=(10_000, 32)))
    index = ann.build(rows, str(tmp_path / "index"), cells)
    assert index.about["rows"] == 10_000 and 0.7 * cells <= index.about["cells"] <= 1.3 * cells
    assert index.about["recall"] >= 0.9 and recall(ann.Index.open(spark, index.path), rows, 67) >= 0.88
    if kind == "clustered":
        assert index.about["share"] < 0.2
    assert index.rows.count() == 10_000 and index.rows.select("id").distinct().count() == 10_000


def test_all_cells_and_a_long_list_are_exact(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])], "id long, embedding array<double>")
    index = ann.build(rows, str(tmp_path / "index"))
    assert index.rows.count() == 300 and index.rows.select("id").distinct().count() == 300
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query")
    a = found(index.search(queries, 5, probes=10**6, shortlist=300).select("query", "id", "rank"))
    b = found(retrieval.knn(rows.where("id % 50 = 0").withColumnRenamed("id", "vec_id"), rows.where("id is not null").withColumnRenamed("id", "vec_id")).select("query_id", "vec_id", "rank"))
    assert a == b
    for few in (rows.limit(0), rows.where("id = 5")):
        small = ann.build(few, str(tmp_path / f"few{few.count()}"))
        assert small.search(queries).select("id").distinct().count() == few.count() and small.about["rows"] == few.count()
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "id long, embedding array<double>")
    got = ann.build(alike, str(tmp_path / "alike")).search(alike.where("id = 7").select(F.col("id").alias("query"), "embedding"))
    assert [r.id for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
