"""Goldens of the operators, sources, sinks and streams on tiny tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import answer, chunk, evaluate, logs, retrieval, rules, tables
from siltstone.plans import fixtures
from siltstone.sources import html, readers, sinks


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "red fox jumps"), (2, "blue fox"), (3, "green hill far away"), (4, ""), (5, None), (6, "blue fox")], "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "blue fox"), (2, "nothing here"), (3, "")], "item_id long, text string")


def test_retrieval_ties_go_to_the_smaller_id(docs, asked):
    for strategy in retrieval.STRATEGIES.values():
        got = strategy(asked.where("item_id = 1"), retrieval.corpus(docs)).orderBy("rank").collect()
        assert [r.doc_id for r in got][:2] == [2, 6] and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert retrieval.bm25(asked.where("item_id > 1"), retrieval.corpus(docs)).count() == 0


def test_fusion_is_symmetric_and_adds_ranks(spark):
    lists = [spark.createDataFrame(r, "item_id long, doc_id long, rank int, score double") for r in ([(1, 1, 1, 9.0), (1, 2, 3, 1.0)], [(1, 1, 1, 0.5), (1, 3, 20, 0.1), (1, 2, 20, 0.2)])]
    a, b = (retrieval.fused(x).orderBy("rank").collect() for x in (lists, lists[::-1]))
    assert a == b and abs(a[0].score - 0.0327869) < 1e-6 and abs(a[1].score - 0.0283730) < 1e-6


def test_cosine_of_a_zero_vector(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "z array<double>, a array<double>, b array<double>")
    got = row.select(retrieval.cosine(F.col("z"), F.col("a")).alias("x"), retrieval.cosine(F.col("a"), F.col("b")).alias("y")).first()
    assert got.x == 0.0 and abs(got.y - 1) < 1e-12


def test_grades(spark, asked):
    found = spark.createDataFrame([(1, 1, 1, 0.10), (3, 1, 1, 0.0999)], "item_id long, doc_id long, rank int, score double")
    assert {r.item_id: r.grade for r in answer.grade(asked, found, 0.05).collect()} == {1: "relevant", 2: "irrelevant", 3: "judge"}
    assert {r.grade for r in answer.grade(asked.where("item_id <> 2"), found, 0.0).collect()} == {"judge"}


def test_budget_ends_at_the_first_that_exceeds(spark):
    docs = spark.createDataFrame([(1, "x" * 4000), (2, "y" * 3000), (3, "z" * 10)], "doc_id long, text string")
    found = spark.createDataFrame([(1, i, i, 1.0) for i in (1, 2, 3)], "item_id long, doc_id long, rank int, score double")
    got = answer.context(found, docs, total=6000).collect()
    assert [(r.doc_id, r.chars) for r in got] == [(1, 3001)]


def test_retry_is_bounded(spark, docs, asked):
    got = {r.item_id: (r.retries, r.grade) for r in answer.retried(asked, retrieval.corpus(docs)).collect()}
    assert got == {1: (0, "relevant"), 2: (2, "irrelevant"), 3: (2, "irrelevant")}
    never = lambda rows: rows.select("item_id", F.lit(False).alias("relevant"))
    got = {r.item_id: r.retries for r in answer.retried(asked, retrieval.corpus(docs), gate=0.0, judge=never).collect()}
    assert set(got.values()) == {2}


def test_judges_replies_and_rewriting(spark, docs, asked):
    rows = retrieval.corpus(docs)
    reply = lambda shown: shown.select("item_id", F.when(F.col("excerpts").contains("[1] blue"), '{"relevant": false, "reason": "x"}').otherwise("no json").alias("reply"))
    one = asked.where("item_id = 1")
    got = answer.retried(one, rows, gate=0.0, judge=answer.judging(reply, retrieval.bm25, rows)).first()
    assert (got.retries, got.grade) == (2, "irrelevant")
    assert answer.retried(one, rows, gate=0.0, judge=answer.judging(lambda shown: shown.select("item_id", F.lit("?").alias("reply")), retrieval.bm25, rows)).first().grade == "relevant"
    port = lambda r: r.select("item_id", F.lit(" red fox ").alias("query"))
    got = {r.item_id: (r["query"], r.retries, r.grade) for r in answer.retried(asked, rows, rewrite=port).collect()}
    assert got[2] == ("red fox", 1, "relevant") and got[1][1] == 0


def test_chunks(spark):
    long = "Điều 3. T" + "".join(f"\n{i}. " + "c" * 1500 for i in range(1, 5))
    text = "mở đầu Điều 1. " + "a" * 60 + "\n1. b\nĐiều 2. ngắn " + long
    got = chunk.chunks(spark.createDataFrame([(1, text), (2, "p" * 700 + "\n\n" + "q" * 200), (3, "")], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.strategy, r.clause_count) for r in got] == [(1, "article", 1), (1, "clauses", 0), (1, "clauses", 0), (2, "window", None), (2, "window", None)]
    assert got[1].text.startswith("Điều 3. T") and all(r.header == "Điều 3. T" for r in got[1:3])


def test_rules(spark):
    got = {r.sit_id: r for r in rules.rendered(rules.verdicts(spark.createDataFrame([(1, "gpa trợ cấp 2,5"), (2, "trợ cấp gpa 2.4"), (3, "trợ cấp"), (4, "xin chào 3"), (5, "trợ cấp khóa luận 3"), (6, "khóa luận 2.5"), (7, "vắng mặt 20%")], "sit_id long, text string"), fixtures.criteria(spark))).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["pass", "fail", "insufficient_info", "no_match", "no_match", "fail", "pass"]
    assert got[1].value == 2.5 and got[1].answer.endswith("QD-11 — Điều 2") and got[4].answer == ""
    bad = fixtures.criteria(spark).withColumn("condition", F.col("condition").withField("operator", F.lit("~")))
    with pytest.raises(Exception, match="unsupported operator"):
        rules.verdicts(spark.createDataFrame([(1, "gpa trợ cấp 2,5")], "sit_id long, text string"), bad).collect()
    near = rules.verdicts(spark.createDataFrame([(1, "mức điểm để nhận học tập 3")], "sit_id long, text string"), fixtures.criteria(spark), vectors=True).first()
    assert near.criterion_id == "grant" and near.verdict == "pass"


def test_rules_file(spark, tmp_path):
    assert rules.load(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "keywords": ["x"], "condition": {"operator": ">=", "value": 1}}, {"id": "b", "keywords": ["y"]}]))
    got = rules.load(spark, str(tmp_path / "c.json")).orderBy("position").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].condition.value == 1.0


@pytest.mark.parametrize(("n", "place"), [(1, 0), (5, 4), (19, 18), (20, 19), (50, 47), (110, 104)])
def test_p95_place(spark, n, place):
    got = evaluate.latency(spark.range(n).select(F.lit("s").alias("s"), F.col("id").cast("double").alias("v")), "v", "s").first()
    assert got.p95 == place and got.least == 0 and got.most == n - 1


def test_deltas_and_targets(spark):
    m = spark.createDataFrame([("bm25_only", 0.0), ("dense_only", 5.0), ("hybrid", 6.0)], "strategy string, v double")
    assert {r.delta: r.pct for r in evaluate.deltas(m, "v").collect()} == {"dense_vs_bm25": None, "hybrid_vs_dense": 20.0, "rerank_vs_hybrid": None, "rerank_vs_dense": None}
    rows = spark.createDataFrame([(0.8, 0.75, 0.7), (0.9, float("nan"), 0.9), (0.9, None, 0.9)], "faithfulness double, answer_relevancy double, context_recall double")
    assert [r.passed for r in sinks.judge_report(rows).collect()] == [True, False, False]


def test_answer_rates(spark):
    rows = spark.createDataFrame([("theo [1]", "x"), (" ", "x"), ("không tìm thấy", "Câu hỏi này"), (None, "câu hỏi")], "answer string, truth string")
    got = evaluate.answer_rates(rows).first()
    assert (got.citation_rate, got.refusal_rate, got.n_answers, got.n_outside) == (0.5, 0.5, 2, 2)
    assert evaluate.answer_rates(rows.where("truth = 'x'")).first().refusal_rate is None


def test_logs(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "error", 0.0), (2, "2024-01-01 00:00:30", 1, "error", 0.0), (3, "2024-01-01 00:01:00", 1, "error", 0.0), (4, "2024-01-01 00:05:00", 1, "view", 7.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.pair for r in logs.admitted(events).orderBy("event_id").collect()] == [0, 0, 0, None]
    assert [r.recent for r in logs.rate_limited(events).orderBy("event_id").collect()] == [1, 2, 3, 1]
    none = logs.error_rate(events.where("event_type = 'error'")).first()
    assert none.errors == 3 and none.error_rate == 0.0
    empty = logs.metrics(events.limit(0)).first()
    assert (empty.total_queries, empty.avg_latency_ms, empty.active_sessions) == (0, 0.0, 0)
    health = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", False)], "grp string, healthy boolean")
    assert {r.grp: r.status for r in logs.health(health).collect()} == {"a": "ok", "b": "degraded", "c": "error"}


def test_tables(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n int")
    path = str(tmp_path / "t")
    sinks.save_new(base, path, "k")
    sinks.save_new(spark.createDataFrame([(2, "x", 1), (3, "c", 1)], base.schema), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]
    sinks.upsert(spark.createDataFrame([(2, "y", 1), (2, "z", 2)], base.schema), path, "k", "n")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 0), (2, "z", 2), (3, "c", 1)]
    got = tables.backfilled(base.withColumn("v", F.lit("")), {"v": F.lit("f")}).collect()
    assert all(r.v == "f" and r.changed for r in got)
    assert [r.v for r in tables.first_by(base.union(base), "k", "v").orderBy("k").collect()] == ["a", "b"]


def test_html(spark):
    page = '<html><title>T</title><nav><a href="/n">n</a></nav><article class="c"><p>' + "word " * 60 + '</p><table><tr><td>Số:</td><td>12</td></tr></table><a href="https://x.example.com/a">a</a><a href="http://evil.org/">e</a><a href="/n">again</a></article><script>var t="</p>";</script></html>'
    pages = spark.createDataFrame([(1, "http://h/x", page), (2, "http://h/y", "<p>short</p>"), (3, "http://h/z", None)], "page_id long, url string, html string")
    assert {(r.link, r.pos) for r in html.links(pages, ("example.com",)).collect()} == {("https://h/n", 0), ("https://x.example.com/a", 1)}
    got = html.main_text(pages).collect()
    assert len(got) == 1 and got[0].title == "T" and "var t" not in got[0].text
    got = html.parsed(pages).collect()
    assert len(got) == 1 and got[0].pairs == {"số": "12"} and "n\n" not in got[0].text[:3]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "A", "content": "some – text"}))
    (tmp_path / "b.json").write_text(json.dumps({"title": "B", "content": "  "}))
    (tmp_path / "c.json").write_text("{broken")
    assert [(r.title, r.content) for r in readers.json_files(spark, str(tmp_path / "*.json")).collect()] == [("A", "some - text")]
    (tmp_path / "m.md").write_text("<!-- x -->\n# hi\n\n\n\nyou")
    assert readers.text_files(spark, str(tmp_path / "m.md"), markdown=True).first().content == "# hi\n\nyou"
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "y.pdf").write_bytes(b"PK")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-" + b"0" * 200)
    assert {r.path[-5:]: r.refusal for r in readers.binary_files(spark, str(tmp_path / "*.pdf"), 100).collect()} == {"x.pdf": None, "y.pdf": "not_a_pdf", "z.pdf": "too_large"}
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>{'para ' * 40}</w:t></w:r></w:p><w:p><w:r><w:t>same</w:t></w:r></w:p><w:tbl><w:tr>{cell('same')}{cell('cell')}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("pad", bytes(range(256)) * 8)
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    (tmp_path / "e.docx").write_bytes(b"no zip" * 200)
    got = readers.docx_files(spark, str(tmp_path / "*.docx")).collect()
    assert len(got) == 1 and got[0].title == "d" and got[0].content.endswith("same\n\ncell")
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "query": "a"}\n\nbad\n{"ts": "2", "query": "b"}\n')
    assert [r.query for r in readers.chat_log(spark, str(tmp_path / "log.jsonl"), 1).collect()] == ["b"]
    rows = spark.createDataFrame([("", "body", "t"), (" ", "", "u"), ("x", "y", "v")], "text string, content string, title string")
    assert [(r.content, r.title) for r in readers.documents(rows, 1).collect()] == [("body", "t")]
    links = spark.createDataFrame([(["a.pdf", "http://h/b.docx", "http://cdn.x/c.docx"],), (["http://h/b.DOCX"],), ([],)], "l array<string>")
    assert [r[0] for r in links.select(readers.preferred_link(F.col("l"), "cdn.x")).collect()] == ["http://cdn.x/c.docx", "http://h/b.DOCX", None]
    (tmp_path / "q.json").write_text("[]")
    with pytest.raises(ValueError, match="no questions"):
        readers.questions(spark, str(tmp_path / "q.json"))


def test_report(spark, docs):
    found = spark.createDataFrame([(1, 1, 1, 0.123456), (1, 2, 2, 0.1)], "item_id long, doc_id long, rank int, score double")
    got = {(r.section, r.position): r.body for r in sinks.report_sections(found, docs, "Title").collect()}
    assert got[("header", 0)] == "Title" and got[("sources", 1)] == "1 | 0.1235" and got[("excerpts", 2)] == "blue fox"


def test_streams(spark, tmp_path):
    from siltstone.streaming import replay, sessions

    turns = spark.createDataFrame([(c, t) for c in (1, 2) for t in range(25 * c)], "conv_id long, turn long")
    path = str(tmp_path / "turns.parquet")
    turns.repartition(3).write.parquet(path)
    assert {tuple(r) for r in sessions.session_state(spark, path).collect()} == {(1, 20, 24), (2, 20, 49)}
    replay.append_stream(replay.source(spark, path), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 75
    texts = str(tmp_path / "texts.parquet")
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(texts)
    replay.refresh_index(replay.source(spark, texts), str(tmp_path / "index"), str(tmp_path / "cp2")).awaitTermination()
    from siltstone.operators.segments import Index

    assert [(r.doc_id, r.dl, dict(zip(r.terms, r.tfs))) for r in Index(spark, str(tmp_path / "index")).docs().collect()] == [(1, 3, {"a": 2, "b": 1})]


def test_bm25_by_scan_equals_bm25_by_postings(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 7))) for i in range(40)] + [(None, "w1 w2"), (50, ""), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3"), (3, "none"), (4, None), (5, "w0 w5 w7")], "item_id int, text string")
    whole = docs.where("doc_id < 40")
    monkeypatch.setattr(retrieval, "MATRIX_BYTES", 200)  # several blocks
    want = {tuple(r) for r in retrieval.bm25(asked, whole, 6, retrieval.postings(whole)).collect()}
    assert {tuple(r) for r in retrieval.bm25(asked, whole, 6).collect()} == want and len(want) == 18
    assert None not in {r.doc_id for r in retrieval.bm25(asked, docs, 50).collect()}
    for q, d in ((asked, docs.limit(0)), (asked.limit(0), docs)):
        assert retrieval.bm25(q, d).count() == 0


def test_bm25_cuts_the_documents_into_words_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    texts = ["Straße_9 fox, FOX!", " ..x.. ", "Điều 48 İx ΣΑΣ", "½ ² Ⅷ x\u0301y", "fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox điều 48"), (2, "ΣΑΣ ½ y"), (3, None)], "item_id int, text string")
    got = {tuple(r) for r in retrieval.bm25(asked, docs.mapInArrow(seen, docs.schema), 3).collect()}
    assert read.value == len(texts)
    assert got == {tuple(r) for r in retrieval.bm25(asked, docs, 3, retrieval.postings(docs)).collect()} and {r[0] for r in got} == {1, 2}
    docs = docs.unionByName(spark.createDataFrame([(6, ""), (7, None), (8, "?!")], docs.schema))
    words = {r.doc_id: r.words for r in retrieval._worded(docs, "doc_id").collect()}
    assert words == {r.doc_id: r.w for r in docs.select("doc_id", retrieval.T.tokens(F.col("text")).alias("w")).collect()}


def looped(rows, most, seconds, failures, pairs):
    """The plain loop over each key's calls in order."""
    out, of = {}, {}
    for k, at, event, bad in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        windows, failed, turn = of.setdefault(k, ([[] for _ in range(pairs)], [0] * pairs, [0]))
        live = [p for p in range(pairs) if failed[p] < failures]
        out[event] = (None, None, None)
        for i in range(len(live)):
            p = live[(turn[0] + i) % len(live)]
            windows[p] = [t for t in windows[p] if t > at - seconds]
            if len(windows[p]) < most:
                windows[p].append(at)
                turn[0] = (live.index(p) + 1) % len(live)
                failed[p] = failed[p] + 1 if bad else 0
                out[event] = (p, len(windows[p]), failed[p])
                break
    return out


@pytest.mark.parametrize(("pairs", "states"), [(1, 256), (2, 256), (3, 256), (2, 1)])
def test_admission_in_chunks_equals_the_loop(spark, pairs, states):
    """A key's calls are cut at gaps and put in many chunks; pairs die, times tie, and states are handed on."""
    import random

    rnd, rows, at = random.Random(pairs), [], 0
    for i in range(4000):
        at += rnd.choice([0, 0, 1, 1, 2, 3, 7, 10, 11, 40]) if i % 90 else 500
        rows.append((rnd.choice([1, 1, 1, 2, None]), at, i, rnd.random() < (0.62 if i > 2500 else 0.3)))
    events = spark.createDataFrame(rows, "user_id long, s long, event_id long, bad boolean").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", F.when(F.col("bad"), "error").otherwise("ok").alias("event_type"))
    got = {r.event_id: (r.pair, r.recent, r.failed_run) for r in logs.admitted(events.repartition(5), 3, 10, 4, pairs=pairs, chunk=50, states=states).collect()}
    assert got == looped(rows, 3, 10, 4, pairs)
    assert logs.admitted(events.limit(0)).count() == 0


def test_one_key_is_several_tasks(spark):
    """Calls of one key come in bursts; no task gets more than a few chunks."""
    rows = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("event_id"), F.lit(7).alias("user_id"), F.timestamp_seconds(F.floor(F.col("id") / 1000) * 100 + F.col("id") % 7).alias("ts"), F.lit("ok").alias("event_type"))
    chunks = logs._chunks(rows.select(F.col("user_id").alias("k"), F.unix_micros("ts").alias("at"), F.floor(F.unix_micros("ts") / 61_000_000).alias("bin")), 61, 10_000)
    assert sorted({(r.chunk, r.chunks) for r in chunks.collect()}) == [(i, 20) for i in range(20)]
    got = logs.admitted(rows, chunk=10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        assert got.where("pair = 0").count() == 2000 and got.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_for_questions_hold_little(spark):
    """Vectors are met in small Arrow batches, and the weights of words that all questions ask for are added up some documents at a time."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    def embed(rows, key):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(len(b)) if key == "doc_id" else 1.0]] * len(b))], names=[key, "vector"])

        return rows.select(key, "text").mapInArrow(run, f"{key} long, vector array<double>")

    docs = spark.range(6000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"))
    got = retrieval.dense(spark.createDataFrame([(1, "w")], "item_id long, text string"), docs, 3, embed).collect()
    assert len(got) == 3 and max(r.score for r in got) <= 2048

    terms = [f"t{i}" for i in range(20)]
    asked = pa.table({"item_id": [i for i in range(200) for _ in terms], "term": terms * 200, "idf": [1.0] * 4000})
    batch = pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array([terms] * 1024)], names=["doc_id", "words"])
    run = retrieval._okapi(asked, 20.0, 5, SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    tracemalloc.start()
    found = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].column("id").to_pylist() == [0, 1, 2, 3, 4] * 200 and peak < 64 << 20
