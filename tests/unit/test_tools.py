"""Tools, routing, ports and degraded modes."""

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.operators import evaluate, logs, retrieval, rules, tools
from siltstone.plans import fixtures
from siltstone.sources.readers import DOCUMENT


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(1, "red fox jumps over", "Fox", "Điều 1", "u1"), (2, "blue fox sleeps " + "z" * 600, "Fox", "", "u2"), (3, "green hill far away", None, "Điều 3", None)], "doc_id long, text string, title string, header string, url string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "fox"), (2, "nothing here")], "item_id long, text string")


def test_routes(spark):
    rows = spark.createDataFrame([("compare",), ("simple_qa",), ("unknown",), ("bad",), (None,)], "i string")
    assert [r[0] for r in rows.select(tools.route(F.col("i"))).collect()] == ["compare", "retrieve", "retrieve", "retrieve", "retrieve"]
    rows = spark.createDataFrame([("so sánh a và b", "report"), ("một câu hỏi dài hơn sáu từ rõ ràng", " Report "), ("một câu hỏi dài hơn sáu từ rõ ràng", "poem"), ("ngắn thôi", "report"), ("một câu hỏi dài hơn sáu từ rõ ràng", None)], "q string, said string")
    assert [r[0] for r in rows.select(tools.labelled(F.col("said"), F.col("q"))).collect()] == ["compare", "report", "simple_qa", "simple_qa", "simple_qa"]


def test_tools(spark, chunks, asked):
    found = tools.search(asked, chunks, retrieval.bm25).orderBy("rank").collect()
    assert {r.item_id for r in found} == {1} and all(len(r.text) <= 500 for r in found) and found[0].title == "Fox"
    assert {r.header for r in tools.extract(asked, chunks, retrieval.bm25).collect()} == {"Điều 1"}
    assert tools.describe(asked, chunks, retrieval.bm25).count() == 1
    answers = {r.item_id: r.answer for r in tools.summarize(asked, chunks, retrieval.bm25).collect()}
    assert "red fox" in answers[1] and answers[2] == "Không tìm thấy văn bản: nothing here"
    said = tools.summarize(asked, chunks, retrieval.bm25, lambda rows: rows.select("item_id", F.substring("prompt", 1, 30).alias("answer")), focus="x").where("item_id = 1").first()
    assert said.answer.startswith("Tóm tắt văn bản sau. Tập trung")
    sections = {r.section for r in tools.report(asked.where("item_id = 1"), chunks, retrieval.bm25).collect()}
    assert sections == {"header", "summary", "sources", "excerpts"}


def test_the_sides_of_a_comparison_are_retrieved_by_themselves(spark, chunks):
    asked = spark.createDataFrame([(1, "red và green về hill"), (2, "none và nothing")], "item_id long, text string")
    got = {r.item_id: r for r in tools.compare(asked, chunks, retrieval.bm25).collect()}
    assert "red fox" in got[1].context_a and got[1].context_b.startswith("green hill") and "red" not in got[1].context_b
    assert got[2].answer == "Không tìm thấy nội dung để so sánh."


def test_tools_in_sql(spark, chunks, asked):
    names = tools.register(spark, asked, chunks, retrieval.bm25)
    assert len(names) == 7 and spark.sql("select count(*) from extract_articles").first()[0] == 1
    assert tuple(spark.sql("select * from compare_arguments('A và B về c')").first()) == ("A", "B", "c")
    assert tuple(spark.sql("select * from compare_arguments('alone')").first()) == ("alone", "alone", "alone")


def test_ports_and_modes(spark, chunks, asked):
    docs = chunks.select("doc_id", "text")
    same = lambda rows, key: rows.select(key, F.array(F.lit(1.0), F.length("text").cast("double")).alias("vector"))
    assert retrieval.dense(asked, docs, 2, same).count() == 4
    stored = retrieval.postings(docs)
    assert retrieval.bm25(asked, docs, 5, stored).collect() == retrieval.bm25(asked, docs, 5).collect()
    assert retrieval.hybrid(asked, docs, mode="bm25").count() == 2 and retrieval.hybrid(asked, docs, mode="dense").count() >= 2
    with pytest.raises(ValueError, match="mode"):
        retrieval.hybrid(asked, docs, mode="x")
    assert retrieval.hybrid_reranked(asked, docs, 1, None).groupBy("item_id").count().where("count > 1").count() == 0
    backwards = lambda found, q, d, k: found.withColumn("rank", -F.col("rank"))
    assert retrieval.hybrid_reranked(asked, docs, 8, backwards).where("rank < 0").count() > 0


def test_nearest_against_brute_force(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 6)]) for i in range(120)] + [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(300, None), (301, [0.0] * 6)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query")
    monkeypatch.setattr(retrieval, "MATRIX_BYTES", 200)  # several blocks
    found = lambda: {(r["query"], r["id"], r["score"]) for r in retrieval.nearest(q, v, 4, 8, own=False).collect()}
    got = found()  # more queries than go to all tasks: one tile
    monkeypatch.setattr(retrieval, "TILE_BYTES", 900)
    monkeypatch.setattr(retrieval, "ROWS", 5)
    assert found() == got  # several tiles, and batches that end within them
    monkeypatch.setattr(retrieval, "MATRIX_BYTES", 1 << 20)
    assert found() == got  # a matrix
    assert retrieval.nearest(q.limit(0), v, 4, 8).count() == 0
    want = set()
    for i, x in rows:
        if i % 10 == 0 and x:
            pairs = sorted((-float(np.dot(x, y)), j) for j, y in rows if y and j != i and np.any(np.array(x) * np.array(y)))
            want |= {(i, j, -s) for s, j in pairs[:4]}
    assert got == want


def test_value_port(spark):
    asked = spark.createDataFrame([(1, "trợ cấp gpa hai phẩy sáu"), (2, "trợ cấp gpa 2,6")], "sit_id long, text string")
    port = lambda rows: rows.select("sit_id", F.lit("2.6").alias("value"))
    got = {r.sit_id: (r.verdict, r.value) for r in rules.verdicts(asked, fixtures.criteria(spark), extract=port).collect()}
    assert got == {1: ("pass", 2.6), 2: ("pass", 2.6)}
    assert {r.verdict for r in rules.verdicts(asked, fixtures.criteria(spark)).collect()} == {"insufficient_info", "pass"}


def test_refused_calls_fill_no_window_and_dead_pairs_are_skipped(spark):
    ts = lambda s: F.timestamp_seconds(s)
    events = spark.range(40).select(F.col("id").alias("event_id"), ts(F.col("id") * 4).alias("ts"), F.lit(1).alias("user_id"), F.lit("view").alias("event_type"))
    got = [r.pair for r in logs.admitted(events, 3, 61).orderBy("event_id").collect()]
    assert got[:3] == [0, 0, 0] and got[3:16] == [None] * 13 and got[16:19] == [0, 0, 0]  # let in again a window after the first
    got = [r.pair for r in logs.admitted(events, 3, 61, pairs=2).orderBy("event_id").collect()]
    assert got[:7] == [0, 1, 0, 1, 0, 1, None]
    bad = events.withColumn("event_type", F.when(F.col("event_id") < 6, "error").otherwise("view"))
    got = logs.admitted(bad, 10, 61, pairs=2).orderBy("event_id").collect()
    assert [r.pair for r in got[:8]] == [0, 1, 0, 1, 0, 1, None, None] and got[5].failed_run == 3


def test_scores_of_answers(spark):
    rows = spark.createDataFrame([(1, "red fox", "red fox"), (2, "!!", "fox"), (3, "", "x"), (4, "a", "Câu hỏi này")], "item_id long, answer string, truth string")
    got = evaluate.correctness(rows).first()
    assert (got.n, got.token_f1, got.semantic) == (2, 0.5, 1.0)
    none = evaluate.correctness(rows.limit(0)).first()
    assert (none.n, none.token_f1, none.semantic) == (0, 0.0, 0.0)
    lists = spark.createDataFrame([(["q1", "q2", "q3"], ["a1", "a2"], ["t1", "t2", "t3"])], "q array<string>, a array<string>, t array<string>")
    assert len(lists.select(evaluate.zipped(F.col("q"), F.col("a"), F.col("t")).alias("z")).first().z) == 2
    assert evaluate.with_context(spark.createDataFrame([(["x"],), ([],), (None,)], "contexts array<string>")).count() == 1


def test_engine_sends_questions_where_their_intents_go(spark, tmp_path):
    text = "Điều 1. Học bổng dành cho sinh viên giỏi của trường đại học.\nĐiều 2. Ký túc xá mở cửa từ sáu giờ sáng đến mười giờ tối."
    docs = spark.createDataFrame([("Quy chế", text, "http://x/1", "law", "s", "QD-1", "")], DOCUMENT)
    e = Engine(spark, str(tmp_path / "e"), criteria=fixtures.criteria(spark))
    e.ingest(docs)
    e.ingest(docs)
    assert e.index.docs().groupBy("doc_id").count().where("count > 1").count() == 0
    asked = spark.createDataFrame([(1, "s", "so sánh học bổng và ký túc xá"), (2, "s", "tóm tắt ký túc xá"), (3, "s", "xuất pdf ký túc xá"), (4, "s", "ký túc xá mở cửa"), (5, "s", "gpa trợ cấp 2,6 có được không")], "item_id long, session_id string, text string")
    answers = e.ask(asked).persist()
    got = {r.item_id: r for r in answers.collect()}
    assert {i: r.grade for i, r in got.items()} == {1: "compare", 2: "summary", 3: "report", 4: "relevant", 5: "rule"}
    assert got[3].answer.startswith("# Báo cáo: xuất pdf") and got[4].sources[0]["meta"]["so_hieu"] == "QD-1"
    history = spark.createDataFrame([(4, "user: ký túc xá")], "item_id long, history string")
    said = e.ask(asked.where("item_id = 4"), history=history, rewrite=lambda rows: rows.select("item_id", F.lit("học bổng sinh viên").alias("query"))).first()
    assert said["query"] == "học bổng sinh viên"
    e.log(asked, answers)
    m = e.metrics()
    assert m["total_queries"] == 5 and m["avg_latency_ms"] > 0 and m["error_rate"] == 0.0
    e.log_errors(spark.createDataFrame([("s", "/query", "ValueError", "my password is x")], "session_id string, endpoint string, error_type string, message string"))
    assert e.metrics()["error_rate"] == 0.2 and "password" not in spark.read.parquet(f"{e.root}/error_log").where("endpoint = '/query' and error_type = 'ValueError'").first().message
    assert e.tool("search_legal_docs", asked.where("item_id = 4").select("item_id", "text")).count() > 0
    body = b"BT " + b" ".join(b"(Upload line number %d of the file.) Tj T*" % i for i in range(9)) + b" ET"
    pdf = b"%PDF-1.4\n<< /Length 9 >>\nstream\n" + body + b"\nendstream"
    files = spark.createDataFrame([("a.pdf", None, len(pdf), bytearray(pdf)), ("b.txt", "text/plain", 1, bytearray(b"x"))], "filename string, mime string, length long, content binary")
    assert {(r.filename, r.refusal) for r in e.upload(files).collect()} == {("a.pdf", None), ("b.txt", "not_a_pdf")}
    assert e.list_documents().where("url = 'upload://a'").count() == 1 and spark.read.parquet(f"{e.root}/upload_log").count() == 2
    items = spark.createDataFrame([(1, "ký túc xá mở cửa", "Ký túc xá mở cửa từ sáu giờ sáng"), (2, "x", "Câu hỏi này")], "item_id long, question string, truth string")
    calls = []

    def generate(rows):
        calls.append(1)
        return rows.select("item_id", F.col("context").alias("answer"))

    for _ in range(2):
        got = e.evaluate(items, ("bm25_only", "hybrid"), generate, str(tmp_path / "cache")).collect()
        assert {r.strategy for r in got} == {"bm25_only", "hybrid"} and all(r.hit_rate == 1.0 and r.token_f1 > 0 and r.semantic > 0 for r in got)
    assert len(calls) == 2

    def judge(rows):
        assert rows.columns == ["item_id", "question", "answer", "contexts", "truth"] and rows.where("size(contexts) = 0").isEmpty()
        scored = F.when(F.col("item_id") == 1, 0.9).otherwise(F.lit(float("nan")))
        return rows.select("item_id", *(scored.alias(m) for m in ("faithfulness", "answer_relevancy", "context_recall")), F.lit(None).cast("double").alias("context_precision"))

    got = e.evaluate(items, ("bm25_only",), generate, str(tmp_path / "cache"), judge).first()
    assert (got.faithfulness, got.context_recall, got.passed) == (0.9, 0.9, True) and got.context_precision != got.context_precision and got.hit_rate == 1.0


def test_index_has_every_row_and_finds_most(spark):
    """Recall of the index against brute force on the embeddings."""
    from siltstone.plans import catalog

    d = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in catalog.queries()["knn_embeddings_top5"](spark, d).collect()}
    got = {(r.query_id, r.vec_id) for r in catalog.queries()["knn_index_top5"](spark, d).collect()}
    assert len(exact & got) / len(exact) >= 0.9


def test_limiter_as_a_stream_and_capped_corpus(spark, tmp_path):
    from siltstone.streaming.limits import limits

    rows = spark.range(30).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 2).alias("user_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.recent, r.limited) for r in limits(spark, str(tmp_path / "events.parquet"), 3, 10).collect()}
    assert got[0] == (1, False) and got[4] == (3, False) and got[6] == (4, True) and got[29] == (4, True)
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (3, "")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="2 chunks"):
        assert [r.doc_id for r in retrieval.corpus(docs, 1).collect()] == [1]
    points = spark.createDataFrame([(1, {"_node_content": '{"text": "t"}', "_x": "y", "k": "v"}), (2, {"k": "v"})], "doc_id long, payload map<string,string>")
    assert [(r.doc_id, r.text, r.metadata) for r in retrieval.stored(points).collect()] == [(1, "t", {"k": "v"})]
