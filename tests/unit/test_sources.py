"""Discovery, uploads, PDF text, migration, reports, caches."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.operators import logs
from siltstone.sources import crawl, html, readers, sinks


def test_crawl_stops_at_an_empty_page_and_at_the_cap(spark):
    listings = spark.createDataFrame([(0, 1, ["a", "b", "x"]), (0, 2, []), (0, 3, ["never"]), (1, 1, ["c", "a"]), (1, 2, ["d"]), (1, 6, ["late"])], "type_no int, page int, links array<string>")
    documents = spark.createDataFrame([(u,) for u in ("a", "b", "c", "d", "never", "late")], "url string")
    got = crawl.crawled(listings, documents).orderBy("place").collect()
    assert [r.url for r in got] == ["a", "b", "c", "a", "d"] and [r.place for r in got] == [1, 2, 3, 4, 5]
    assert [r.url for r in crawl.crawled(listings, documents, max_docs=3).orderBy("place").collect()] == ["a", "b", "c"]
    assert [r.url for r in crawl.crawled(listings, documents, max_pages=1).orderBy("place").collect()] == ["a", "b", "c", "a"]
    assert crawl.crawled(listings.limit(0), documents).count() == 0


def test_types_issues_and_their_documents(spark):
    rows = spark.createDataFrame([(1, "luat"), (2, "other")], "k int, doc_type string")
    assert crawl.of_types(rows, ["luat"]).count() == 1 and crawl.of_types(rows, []).count() == 2
    links = spark.createDataFrame([(0, "http://h/cong-bao-so-2"), (1, "http://h/x"), (2, "http://h/cong-bao-so-1"), (3, "http://h/cong-bao-so-2"), (4, "http://h/cong-bao-so-3#t")], "pos int, url string")
    assert [(r.place, r.url[-1]) for r in crawl.issue_links(links, 5).orderBy("place").collect()] == [(1, "2"), (2, "1")]
    assert crawl.issue_links(links, 1).count() == 1
    anchors = spark.createDataFrame([(7, 0, "https://h/van-ban/nghi-dinh-5.htm", ""), (7, 1, "https://h/van-ban/nghi-dinh-5.htm", "again"), (7, 2, "https://evil/van-ban/x.htm", "x"), (7, 3, "https://h/van-ban/luat-1.htm", " L " * 100)], "page_id int, pos int, url string, text string")
    got = {r.url: r for r in crawl.issue_documents(anchors, "h").collect()}
    assert len(got) == 2 and got["https://h/van-ban/nghi-dinh-5.htm"].title == "nghi-dinh-5.htm" and got["https://h/van-ban/nghi-dinh-5.htm"].doc_type == "nghi_dinh"
    assert len(got["https://h/van-ban/luat-1.htm"].title) == 200


def test_attachments_are_joined_in_the_order_of_their_links(spark):
    pages = spark.createDataFrame([(1, "", "H", "P", ["b.pdf", "x.doc", "a.PDF", "b.pdf"]), (2, "T", None, None, ["a.PDF"]), (3, None, None, "", ["b.pdf"]), (4, "", "", "", [])], "page_id int, title string, headline string, page_title string, links array<string>")
    texts = spark.createDataFrame([("b.pdf", "B" * 1200), ("a.PDF", "A" * 500), ("x.doc", "X" * 2000)], "url string, text string")
    got = {r.page_id: r for r in crawl.attached(pages, texts).collect()}
    assert set(got) == {1, 3} and got[1].title == "H" and got[1].content == "B" * 1200 + "  " + "A" * 500 or got[1].content.startswith("B" * 1200)
    assert got[3].title == crawl.UNTITLED


def test_search_results_and_info(spark):
    page = '<a href="/no">no</a><div class="vbTitle"><a href="/a"><b>Luật</b> 45/2019/QH14</a></div><td class="title"><a href="http://o/b">B</a><a>none</a></td>'
    got = crawl.search_results(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), "http://base").orderBy("pos").collect()
    assert [(r.url, r.title.replace(" ", ""), r.so_hieu) for r in got] == [("http://base/a", "Luật45/2019/QH14", "45/2019/QH14"), ("http://o/b", "B", "")]
    pairs = spark.createDataFrame([({"ngày có hiệu lực": "1/1", "cơ quan ban hành": "QH", "số": "2"},), ({},), (None,)], "p map<string,string>").select(crawl.info(F.col("p")).alias("i")).collect()
    assert (pairs[0].i.effective_date, pairs[0].i.issuing_body) == ("1/1", "QH") and pairs[1].i.effective_date is None


def test_discovery_counters_and_progress(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, 0, "u"), ("c", 1, 1, "v"), ("c", 2, 0, "u"), ("c", 2, 1, "w"), ("d", 1, 0, "u")], "category string, keyword_no int, pos int, url string")
    got = sorted((r.category, r.place, r.url) for r in crawl.discovered(rows, 3).collect())
    assert got == [("c", 1, "u"), ("c", 2, "v"), ("d", 1, "u")]
    rows = spark.createDataFrame([("x" * 100, False), ("x" * 99, False), (None, False), ("x", True)], "content string, known boolean")
    assert {r.status: r.n for r in crawl.counters(rows).collect()} == {"saved": 1, "short": 1, "failed": 1, "skipped": 1}
    path = str(tmp_path / "progress")
    assert crawl.progress(spark, path) == ([], 0)
    crawl.save_progress(spark, path, ["a"], 3)
    crawl.save_progress(spark, path, ["a", "b"], 5)
    assert crawl.progress(spark, path) == (["a", "b"], 5) and crawl.pending(["a", "b", "c"], ["b", "a"]) == ["c"]
    port = lambda links: links.withColumn("html", F.when(F.col("url") != "bad", F.lit("<p>x</p>")))
    assert crawl.fetched(spark.createDataFrame([("a",), ("bad",), ("a",)], "url string"), port).count() == 1


def test_uploads_downloads_and_logs(spark):
    rows = spark.createDataFrame([("a.pdf", None, 10), ("b", "application/pdf", 10), ("c.PDF", "x", 99), ("d.txt", "text/plain", 1), (None, None, 1)], "filename string, mime string, length long")
    assert [r.refusal for r in readers.uploads(rows, 50).collect()] == [None, None, "too_large", "not_a_pdf", "not_a_pdf"]
    names = spark.createDataFrame([("a_b-1.pdf",), ("../a.pdf",), ("a.pdf\n",), ("a.PDF",), (None,)], "n string")
    assert [r[0] for r in names.select(readers.is_download(F.col("n"))).collect()] == [True, False, False, False, False]
    assert len(logs.upload_log(spark.createDataFrame([("x" * 300,)], "filename string")).first().filename) == 260


def pdf(content: bytes, extra: bytes = b"", flate=True) -> bytes:
    body = zlib.compress(content) if flate else content
    head = b"<< /Length %d%s >>" % (len(body), b" /Filter /FlateDecode" if flate else b"")
    return b"%PDF-1.4\n1 0 obj\n" + head + b"\nstream\n" + body + b"\nendstream\nendobj\n" + extra + b"%%EOF"


def test_fonts_of_a_pdf_are_told_apart():
    """Two subset fonts use the same code for different letters."""
    cmap = lambda n, c: b"%d 0 obj << >>\nstream\n1 begincmap 1 beginbfchar <01> <%04X> endbfchar endcmap\nendstream endobj\n" % (n, ord(c))
    head = b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >> endobj\n"
    fonts = b"3 0 obj << /Type /Font /ToUnicode 5 0 R >> endobj\n4 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj\n"
    body = b"2 0 obj << >>\nstream\nBT /F1 12 Tf <01> Tj T* /F2 12 Tf <01> Tj ET\nendstream endobj\n"
    assert readers.pdf_text(head + fonts + body + cmap(5, "A") + cmap(6, "B")) == "A\nB"


def test_text_after_a_stray_end_tag_is_kept(spark):
    page = "<main><p>first</p></br></div><img src=x><p>second</p></main>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html.parsed(rows, shortest=1).first().text == "first\nsecond"


def test_pdf_text(spark, tmp_path):
    content = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) world) Tj 0 -14 Td [(sec) -20 (ond) -300 (line \\351)] TJ T* (th\\\nird) Tj ET"
    for flate in (True, False):
        assert readers.pdf_text(pdf(content, flate=flate)) == "Hello (PDF) world\nsecond line é\nthird"
    cmap = b"begincmap 1 beginbfchar <0003> <0110> endbfchar 1 beginbfrange <0041> <0043> <0061> endbfrange endcmap"
    font = b"2 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(cmap), cmap)
    assert readers.pdf_text(pdf(b"BT <000300410042 0043> Tj ET", font)) == "Đabc"
    assert readers.pdf_text(b"%PDF-1.4 nothing") == "" and readers.pdf_text(b"") == ""
    assert readers.pdf_text(b"<< /Filter /FlateDecode >>\nstream\nnot zlib\nendstream") == ""
    lines = b"BT " + b" ".join(b"(A line of the report, number %d.) Tj T*" % i for i in range(9)) + b" ET"
    (tmp_path / "r.pdf").write_bytes(pdf(lines))
    (tmp_path / "short.pdf").write_bytes(pdf(content))
    got = readers.pdf_files(spark, str(tmp_path / "*.pdf")).collect()
    assert [(r.title, r.doc_type) for r in got] == [("r", "pdf")] and "number 8." in got[0].content


def test_migration_keeps_vectors_and_is_verified(spark, tmp_path):
    store = spark.createDataFrame([(i, f"t{i}", {"k": "v"}, [float(i + 1), 1.0, float(i * i)]) for i in range(9)], "id long, text string, metadata map<string,string>, embedding array<double>")
    sinks.migrate(store, str(tmp_path / "new"), "json")
    new = spark.read.schema(store.schema).json(str(tmp_path / "new"))
    assert sorted(map(str, new.collect())) == sorted(map(str, store.collect()))
    assert sinks.verified(store, new) and not sinks.verified(store, new.where("id <> 4")) and sinks.verified(store.limit(0), new.limit(0))


def test_a_broken_upsert_is_recovered(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 0)], "k long, v string, n int")
    path = str(tmp_path / "t")
    for left in (".next", ".old"):
        base.write.mode("overwrite").parquet(path + left)
        sinks.recover(spark, path)
        assert spark.read.parquet(path).count() == 1
        sinks.upsert(spark.createDataFrame([(1, left, 1)], base.schema), path, "k", "n")
        assert [r.v for r in spark.read.parquet(path).collect()] == [left]
        sinks._remove(spark, path)
    (tmp_path / "t.next").mkdir()  # not complete
    sinks.recover(spark, path)
    assert not sinks.exists(spark, path)


def test_reports_and_caches(spark, tmp_path):
    metrics = spark.createDataFrame([("hybrid", 0.5), ("bm25_only", None)], "strategy string, mrr double")
    deltas = spark.createDataFrame([("dense_vs_bm25", None), ("hybrid_vs_dense", 2.5)], "delta string, pct double")
    report = json.loads(sinks.benchmark_report(metrics, deltas).first().report)
    assert report == {"strategies": [{"strategy": "bm25_only", "mrr": None}, {"strategy": "hybrid", "mrr": 0.5}], "deltas": {"dense_vs_bm25": None, "hybrid_vs_dense": 2.5}}
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "item_id long, text string")
    answers = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, answer string")
    path = str(tmp_path / "cache")
    assert sinks.cached_answers(spark, path, "hybrid", asked) is None
    sinks.cache_answers(answers, path, "hybrid", asked)
    assert sorted(map(tuple, sinks.cached_answers(spark, path, "hybrid", asked.repartition(2)).collect())) == [(1, "a"), (2, None)]
    assert sinks.cached_answers(spark, path, "hybrid", asked.where("item_id = 1")) is None and sinks.cached_answers(spark, path, "dense", asked) is None


def test_rebuild_leaves_short_documents_out(spark, tmp_path):
    for n in (99, 100):
        (tmp_path / f"{n}.json").write_text(json.dumps({"title": str(n), "content": "x" * n}))
    assert [r.title for r in readers.json_files(spark, str(tmp_path / "*.json"), 100).collect()] == ["100"]
    rows = spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "0")], "content string, url string")
    assert [r.content for r in readers.documents(rows.repartition(3), 2).collect()] == ["c", "a"]


def test_anchors(spark):
    page = spark.createDataFrame([(1, "http://h/x", '<a href="/a">A</a> <a href="http://o/b">B b</a><a name="n">no</a>')], "page_id long, url string, html string")
    assert [tuple(r) for r in html.anchors(page).orderBy("pos").collect()] == [(1, 0, "https://h/a", "A"), (1, 1, "http://o/b", "B b")]


def test_sections_have_the_summary(spark):
    docs = spark.createDataFrame([(1, "a < b")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 1, 0.5)], "item_id long, doc_id long, rank int, score double")
    rows = sinks.report_sections(found, docs, "T", summaries=spark.createDataFrame([(1, "one & two\n\nthree")], "item_id long, summary string"))
    assert {(r.section, r.position): r.body for r in rows.collect()}[("summary", 0)] == "one &amp; two"
    text = sinks.report_markdown(rows).first().report
    assert text.split("\n\n") == ["# T", "one &amp; two", "three", "- 1 | 0.5", "> a &lt; b"]


@pytest.mark.parametrize("kind", ["report", "wrong"])
def test_progress_of_an_empty_list(spark, tmp_path, kind):
    crawl.save_progress(spark, str(tmp_path / kind), [], 0)
    assert crawl.progress(spark, str(tmp_path / kind)) == ([], 0)


def test_tables_are_dropped_only_if_really_meant_and_logs_append(spark, tmp_path):
    spark.range(1).createOrReplaceTempView("kept_table")
    spark.range(1).createOrReplaceTempView("other_table")
    try:
        gone = sinks.dropped_tables(spark, {"kept_table"})
        assert "other_table" in gone and "kept_table" not in gone and spark.table("other_table").count() == 1
    finally:
        for name in ("kept_table", "other_table"):
            spark.catalog.dropTempView(name)
    rows = spark.createDataFrame([("1", "q")], "ts string, query string")
    for _ in range(2):
        sinks.append_json(rows, str(tmp_path / "log"))
    assert readers.chat_log(spark, str(tmp_path / "log")).count() == 2


def test_counts_of_a_hot_key_do_not_depend_on_its_stretches(spark):
    """recent against brute force, times at and around the window's edge."""
    at = [0, 59, 60, 61, 120, 120, 121, 180, 181, 3600]
    events = spark.createDataFrame([(i, t, 1) for i, t in enumerate(at)], "event_id long, t long, user_id long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.recent for r in logs.rate_limited(events, 3, 60).collect()}
    assert got == {i: sum(t - 60 <= u <= t for u in at) for i, t in enumerate(at)}
