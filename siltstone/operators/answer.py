"""From ranked chunks to cited answers: gates, budgets, grading, citations, the bounded retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import retrieval, tables

CHUNK_CHARS, TOTAL_CHARS = 3000, 15000
JUDGE_CHUNKS, JUDGE_CHARS, JUDGE_TOTAL = 12, 250, 2500
EXCERPT, SHOWN = 700, 5
GATE, CONFIDENT = 0.05, 2.0
RETRIES = 2


def gated(found: DataFrame, least: float = GATE) -> DataFrame:
    return found.where(F.col("score") >= least)


def context(found: DataFrame, docs: DataFrame, chunk: int = CHUNK_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """Chunks of a question in rank order, cut to chunk characters (and a mark), up to the first that would exceed total."""
    text = F.when(F.length("text") > chunk, F.concat(F.substring("text", 1, chunk), F.lit("…"))).otherwise(F.col("text"))
    rows = found.join(docs.select("doc_id", text.alias("shown")), "doc_id")
    so_far = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chars", F.sum(F.length("shown")).over(so_far)).where(F.col("chars") <= total)


def judge_excerpts(found: DataFrame, docs: DataFrame) -> DataFrame:
    rows = found.where(F.col("rank") <= JUDGE_CHUNKS).join(docs.select("doc_id", F.substring("text", 1, JUDGE_CHARS).alias("shown")), "doc_id")
    so_far = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chars", F.sum(F.length("shown")).over(so_far)).where(F.col("chars") <= JUDGE_TOTAL)


def joined(rows: DataFrame, text: Column, joint: str, name: str) -> DataFrame:
    """A question's texts in rank order (a few rows a question, cut by a budget before)."""
    return rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), joint).alias(name))


def grade(questions: DataFrame, found: DataFrame, gate: float = GATE) -> DataFrame:
    """(item_id, n, best, grade): irrelevant without results, relevant from twice the gate on (a gate over 0), else judge."""
    best = found.groupBy("item_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    rows = questions.select("item_id").join(best, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sure = (F.col("best") >= gate * CONFIDENT) if gate > 0 else F.lit(False)
    return rows.withColumn("grade", F.when(F.col("n") == 0, "irrelevant").when(sure, "relevant").otherwise("judge"))


def extractive(found: DataFrame, docs: DataFrame, titles: Column) -> DataFrame:
    """(item_id, answer): heading and the beginning of the text of each question's first chunks."""
    flat = T.stripped(F.regexp_replace("text", r"(?U)\s+", " "))
    cut = F.when(F.length(flat) > EXCERPT, F.concat(F.regexp_replace(F.substring(flat, 1, EXCERPT), r"\s+\z", ""), F.lit("..."))).otherwise(flat)
    rows = found.where(F.col("rank") <= SHOWN).join(docs.select("doc_id", cut.alias("cut"), titles.alias("title")), "doc_id")
    return joined(rows, F.concat(F.lit("**["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("**\n"), F.col("cut")), "\n\n", "answer")


def cited(answers: DataFrame, found: DataFrame) -> DataFrame:
    """The results that an answer (item_id, answer) cites by their rank."""
    marks = answers.select("item_id", F.explode(T.cited_indices(F.col("answer"))).alias("rank"))
    return found.join(marks, ["item_id", "rank"], "left_semi")


def judging(reply: Callable, retrieve: Callable, docs: DataFrame) -> Callable:
    """A judge for `retried` of a port that gives (item_id, reply), a model's raw replies, for (item_id, query, excerpts) rows. A reply
    that holds no JSON verdict, or none at all, counts as relevant."""

    def judge(rows: DataFrame) -> DataFrame:
        found = retrieve(rows.select("item_id", F.col("query").alias("text")), docs)
        line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "shown")
        shown = joined(judge_excerpts(found, docs), line, "\n\n", "excerpts")
        said = reply(rows.select("item_id", "query").join(shown, "item_id")).select("item_id", T.judge_reply(F.col("reply")).alias("j"))
        return rows.select("item_id").join(said, "item_id", "left").select("item_id", F.coalesce("j.relevant", F.lit(True)).alias("relevant"))

    return judge


def retried(questions: DataFrame, docs: DataFrame, retrieve=retrieval.bm25, gate: float = GATE, judge=None, rewrite: Callable | None = None) -> DataFrame:
    """(item_id, query, retries, grade): irrelevant questions are rewritten and asked again, RETRIES times at most. judge tells of (item_id,
    query) rows which are relevant; without one all that reach it are. rewrite, a port, gives (item_id, query) for (item_id, query, tried)
    rows; what it gives none for, or one that was tried, loses its stop words."""
    state = questions.select("item_id", F.col("text").alias("query"), F.array(F.col("text")).alias("tried"))
    out = None
    for turn in range(RETRIES + 1):
        asked = state.select("item_id", F.col("query").alias("text"))
        graded = grade(asked, retrieve(asked, docs), gate).select("item_id", "grade")
        if judge is not None:
            unsure = state.join(graded.where("grade = 'judge'"), "item_id", "left_semi")
            said = judge(unsure).select("item_id", F.when(F.col("relevant"), "relevant").otherwise("irrelevant").alias("said"))
            graded = graded.join(said, "item_id", "left").select("item_id", F.coalesce("said", "grade").alias("grade"))
        graded = tables.cut(state.join(graded, "item_id").withColumn("grade", F.when(F.col("grade") == "judge", "relevant").otherwise(F.col("grade"))))  # a row a question
        ended = graded if turn == RETRIES else graded.where("grade = 'relevant'")
        rows = ended.select("item_id", "query", F.lit(turn).alias("retries"), "grade")
        out = rows if out is None else out.unionByName(rows)
        rest = graded.where("grade = 'irrelevant'")
        again = T.reformulated(F.col("query"), F.col("tried"))
        if rewrite is not None and turn < RETRIES:
            said = rewrite(rest.select("item_id", "query", "tried")).select("item_id", T.stripped(F.col("query")).alias("said"))
            rest = rest.join(said, "item_id", "left")
            again = F.when((F.col("said") != "") & ~F.array_contains("tried", F.col("said")), F.col("said")).otherwise(again)
        state = rest.select("item_id", again.alias("query"), F.concat("tried", F.array(again)).alias("tried"))
    return out
