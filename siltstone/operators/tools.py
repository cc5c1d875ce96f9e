"""The tools that a question may be sent to, over many questions at once, and the routing by intent.

Each tool takes questions (item_id, text) and the chunks (doc_id, text, title, header, url) and a retriever, a port; generate, a port
too, takes (item_id, prompt) rows and gives (item_id, answer). Without one an answer is the context itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answer, retrieval

SEARCHED, SUMMARIZED, EXTRACTED, REPORTED, DESCRIBED, COMPARED = 5, 10, 8, 8, 1, 5
SHOWN, EXCERPT, SIDE = 500, 200, 1500
#: Where an intent's questions go; any other goes to retrieval.
ROUTES = {"simple_qa": "retrieve", "compare": "compare", "summarize": "summarize", "report": "report", "compliance_check": "compliance", "unknown": "retrieve"}


_SIDES, _ABOUT = re.compile(T.SIDES, re.IGNORECASE), re.compile(T.ABOUT, re.IGNORECASE)


def route(intent: Column) -> Column:
    """The node of an intent; retrieval for one that isn't known."""
    known = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, intent), F.lit("retrieve"))


def labelled(said: Column, query: Column) -> Column:
    """The intent by keywords where they tell or the question is short, else the label that a model gave; simple_qa for one that isn't known."""
    label = F.lower(F.trim(said))
    own = T.intent(query)
    sure = (own != "simple_qa") | (T.word_count(query) <= 6) | said.isNull()
    return F.when(sure, own).when(label.isin(*(k for k in ROUTES if k != "unknown")), label).otherwise("simple_qa")


def _found(questions: DataFrame, chunks: DataFrame, retrieve: Callable, k: int) -> DataFrame:
    found = retrieve(questions.select("item_id", "text"), chunks.select("doc_id", "text")).where(F.col("rank") <= k)
    names = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "header", "url"))
    return found.join(chunks.select("doc_id", F.substring("text", 1, SHOWN).alias("text"), *names), "doc_id").withColumn("score", F.round("score", 4))


def search(questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid, k: int = SEARCHED) -> DataFrame:
    """(item_id, rank, text, score, title, header, url)."""
    return _found(questions, chunks, retrieve, k).select("item_id", "rank", "text", "score", "title", "header", "url")


def _said(contexts: DataFrame, generate: Callable | None) -> DataFrame:
    if generate is None:
        return contexts.select("item_id", F.col("context").alias("answer"))
    return generate(contexts.select("item_id", F.col("prompt"))).select("item_id", "answer")


def summarize(questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid, generate: Callable | None = None, focus: str = "") -> DataFrame:
    """(item_id, answer) from the first SUMMARIZED hits; without any the question is named as not found."""
    found = answer.joined(search(questions, chunks, retrieve, SUMMARIZED), F.col("text"), "\n\n", "context")
    note = f" Tập trung vào: {focus}." if focus else ""
    said = _said(found.withColumn("prompt", F.concat(F.lit(f"Tóm tắt văn bản sau.{note}\n\n"), "context")), generate)
    return questions.select("item_id", "text").join(said, "item_id", "left").select("item_id", F.coalesce("answer", F.concat(F.lit("Không tìm thấy văn bản: "), "text")).alias("answer"))


def compare(questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid, generate: Callable | None = None) -> DataFrame:
    """(item_id, a, b, aspect, context_a, context_b, answer): the sides of a question, each retrieved by itself."""
    pairs = questions.select("item_id", T.compare_arguments(F.col("text")).alias("c")).select("item_id", "c.*")
    found = retrieval.compared(pairs, chunks.select("doc_id", "text"), COMPARED, lambda q, d, k: retrieve(q, d).where(F.col("rank") <= k))
    rows = found.join(chunks.select("doc_id", F.substring("text", 1, SHOWN).alias("shown")), "doc_id")
    sides = rows.groupBy("item_id").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == i, F.struct("rank", "shown")))), lambda x: x["shown"]), "\n").alias(f"context_{s}") for i, s in ((0, "a"), (1, "b"))))
    rows = pairs.join(sides, "item_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("context_a", "context_b")})
    part = lambda s: F.concat(F.lit("**"), s, F.lit(":**\n"), F.substring(f"context_{s}", 1, SIDE), F.lit("\n\n"))
    prompt = F.concat(F.lit("So sánh "), "a", F.lit(" và "), "b", F.lit(" về khía cạnh: "), "aspect", F.lit("\n\n"), part("a"), part("b"), F.lit("Trình bày dưới dạng bảng so sánh nếu có thể."))
    some = rows.where("context_a <> '' or context_b <> ''")
    said = _said(some.select("item_id", F.concat(part("a"), part("b")).alias("context"), prompt.alias("prompt")), generate)
    return rows.join(said, "item_id", "left").withColumn("answer", F.coalesce("answer", F.lit("Không tìm thấy nội dung để so sánh.")))


def extract(questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid, within: str = "") -> DataFrame:
    """(item_id, rank, header, title, url, score, excerpt) of the hits that have an article's header."""
    asked = questions.select("item_id", F.trim(F.concat("text", F.lit(" "), F.lit(within))).alias("text"))
    rows = search(asked, chunks, retrieve, EXTRACTED).where("header <> ''")
    return rows.select("item_id", "rank", "header", "title", "url", "score", F.substring("text", 1, EXCERPT).alias("excerpt"))


def report(questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid, generate: Callable | None = None) -> DataFrame:
    """(item_id, section, position, body): a report for each question with its summary, titled by its first 60 characters."""
    from siltstone.sources.sinks import report_sections

    found = _found(questions, chunks, retrieve, REPORTED)
    summaries = summarize(questions, chunks, retrieve, generate).select("item_id", F.col("answer").alias("summary"))
    sections = report_sections(found.select("item_id", "doc_id", "rank", "score"), chunks.select("doc_id", "text"), "", summaries=summaries)
    titles = questions.select("item_id", F.concat(F.lit("Báo cáo: "), F.substring("text", 1, 60)).alias("heading"))
    return sections.join(titles, "item_id").select("item_id", "section", "position", F.when(F.col("section") == "header", F.col("heading")).otherwise(F.col("body")).alias("body"))


def describe(questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid) -> DataFrame:
    """(item_id, title, url, header, score) of the first hit."""
    return search(questions, chunks, retrieve, DESCRIBED).select("item_id", "title", "url", "header", "score")


#: All tools by name.
TOOLS = {"search_legal_docs": search, "summarize_document": summarize, "compare_documents": compare, "extract_articles": extract, "generate_pdf_report": report, "get_document_metadata": describe}


def register(spark: SparkSession, questions: DataFrame, chunks: DataFrame, retrieve: Callable = retrieval.hybrid) -> list[str]:
    """Every tool over the questions as a temporary view of its name, and the text tools as SQL functions; gives the names."""
    for name, tool in TOOLS.items():
        tool(questions, chunks, retrieve).createOrReplaceTempView(name)

    class CompareArguments:
        def eval(self, query: str):
            sides = _SIDES.split(query or "", maxsplit=1)
            right = _ABOUT.split(sides[1].strip(), maxsplit=1) if len(sides) == 2 else []
            yield (sides[0].strip(), right[0].strip(), (right[1].strip() if len(right) > 1 else "") or query) if right else (query, query, query)

    spark.udtf.register("compare_arguments", F.udtf(CompareArguments, returnType="a string, b string, aspect string"))
    return [*TOOLS, "compare_arguments"]
