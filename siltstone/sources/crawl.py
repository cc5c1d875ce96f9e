"""Discovery over captured pages: listings, search results, attachments, issues, progress. The network is a port; these take what it brought."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.html import Reader

ATTACHED_LEAST, CATEGORY_LEAST = 1000, 100
#: Where result lists have their links, and the title of an attachment page without any.
RESULT_BOXES = (".vbTitle", ".title", ".van-ban-title")
UNTITLED = "congbao_document"
RESULT_TYPE = "Luật"


def crawled(listings: DataFrame, documents: DataFrame, max_pages: int = 5, max_docs: int = 100) -> DataFrame:
    """(place, url) of the documents that a crawl keeps: types in their order, pages of a type up to the first without links (max_pages at most),
    links in their order, until max_docs documents are kept. listings: (type_no, page, links), documents: those that could be fetched, by
    url. A url that is listed again counts again."""
    inside = listings.where((F.col("page") >= 1) & (F.col("page") <= max_pages))
    empty = inside.where(F.size(F.coalesce("links", F.array().cast("array<string>"))) == 0).groupBy("type_no").agg(F.min("page").alias("stop"))
    asked = inside.join(empty, "type_no", "left").where(F.col("page") < F.coalesce("stop", F.lit(max_pages + 1)))
    links = asked.select("type_no", "page", F.posexplode("links").alias("pos", "url")).join(documents.select("url").distinct(), "url", "left_semi")
    first = links.orderBy("type_no", "page", "pos").limit(max_docs)
    return first.select(F.row_number().over(Window.orderBy("type_no", "page", "pos")).alias("place"), "url")  # max_docs rows


def of_types(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows of the given document types; all without any given."""
    return rows.where(F.col("doc_type").isin(*kinds)) if kinds else rows


def issue_links(anchors: DataFrame, most: int) -> DataFrame:
    """(place, url): issue pages among (pos, url) in their order, each once, the first `most`."""
    kept = anchors.where(F.col("url").contains("cong-bao-so") & ~F.col("url").contains("#"))
    once = kept.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos").limit(most)
    return once.select(F.row_number().over(Window.orderBy("pos")).alias("place"), "url")  # `most` rows


def issue_documents(anchors: DataFrame, host: str) -> DataFrame:
    """(page_id, url, title, doc_type, pos) of (page_id, pos, url, text): documents of a host, each once, titled by their link (200 characters) or the last part of the url."""
    kept = anchors.where(F.regexp_extract("url", r"^https?://([^/]*)", 1) == host)
    first = Window.partitionBy("page_id", "url").orderBy("pos")
    once = kept.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    title = F.coalesce(F.nullif(F.substring(T.stripped(F.col("text")), 1, 200), F.lit("")), F.element_at(F.split("url", "/"), -1))
    return once.select("page_id", "url", title.alias("title"), T.doc_type(F.col("url")).alias("doc_type"), "pos")


def attached(pages: DataFrame, texts: DataFrame, shortest: int = ATTACHED_LEAST) -> DataFrame:
    """(page_id, title, content) of pages (page_id, title, headline, page_title, links) whose attachments (url, text) hold enough text: each
    attachment once, in the order of the links, by blank lines. The title is the known one, else the headline, else the page's."""
    title = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("title", "headline", "page_title")), F.lit(UNTITLED))
    links = pages.select("page_id", F.posexplode(F.filter("links", lambda x: F.lower(x).contains(".pdf"))).alias("pos", "url")).groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    parts = links.join(texts.where("text <> ''"), "url").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    whole = parts.select("page_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text")).where(F.length("text") >= shortest)
    return pages.select("page_id", title.alias("title")).join(whole, "page_id").select("page_id", "title", T.cleaned(F.col("text")).alias("content"))


def search_results(pages: DataFrame, base: str) -> DataFrame:
    """(page_id, pos, url, title, so_hieu, doc_type) of result pages (page_id, html): the links inside the boxes that hold results."""

    def run(batches):
        for batch in batches:
            out = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                r = Reader(RESULT_BOXES)
                r.feed(html or "")
                out += [(page, i, href if href.startswith("http") else base + href, text) for i, (href, text) in enumerate(r.links)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["page_id", "pos", "url", "title"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, pos int, url string, title string")
    return rows.withColumns({"so_hieu": T.simple_number(F.col("title")), "doc_type": F.lit(RESULT_TYPE)})


def discovered(results: DataFrame, limit: int) -> DataFrame:
    """(category, url, place, ...) of results (category, keyword_no, pos, url, ...): of each category the first `limit` results in the order of its
    keywords, then each url once at its first place."""
    order = Window.partitionBy("category").orderBy("keyword_no", "pos")
    first = results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("category", "url").orderBy("place"))).where("_r = 1").drop("_r", "keyword_no", "pos")


def info(pairs: Column) -> Column:
    """struct(effective_date, issuing_body) of a page's label-value pairs: the last label that names the one or, not naming that, the other."""
    last = lambda test: F.get(F.reverse(F.transform(F.filter(F.map_entries(pairs), lambda e: test(e["key"])), lambda e: e["value"])), F.lit(0))
    effective = lambda k: k.contains("hiệu lực")
    return F.struct(last(effective).alias("effective_date"), last(lambda k: ~effective(k) & (k.contains("ban hành") | k.contains("cơ quan"))).alias("issuing_body"))


def counters(rows: DataFrame) -> DataFrame:
    """(status, n): saved, short, failed and skipped of (url, content, known) rows: already stored, not fetched, too short, or saved."""
    status = F.when(F.col("known"), "skipped").when(F.col("content").isNull(), "failed").when(F.length("content") < CATEGORY_LEAST, "short").otherwise("saved")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def save_progress(spark: SparkSession, path: str, done: list[str], documents: int) -> None:
    """Appends what is done so far; the last row counts."""
    spark.createDataFrame([(done, documents)], "done array<string>, documents long").withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def progress(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(done, documents) as saved last; nothing where nothing is saved."""
    from siltstone.sources.sinks import exists

    row = spark.read.parquet(path).orderBy(F.desc("saved_at"), F.desc(F.size("done"))).first() if exists(spark, path) else None
    return (list(row["done"]), row["documents"]) if row else ([], 0)


def pending(categories: list[str], done: list[str]) -> list[str]:
    return [c for c in categories if c not in set(done)]


def fetched(links: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url, html) by a port that takes (url) rows; those it brings nothing for are left out."""
    return fetch(links.select("url").distinct()).where("html is not null")
