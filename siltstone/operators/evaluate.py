"""Quality of retrieval and answers, latency, and how strategies compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.retrieval import cosine, embedded

RELEVANT = 0.15
#: What a judge scores an answer by.
JUDGED = ("faithfulness", "answer_relevancy", "context_recall", "context_precision")
#: (name, from, to): deltas that the report holds.
DELTAS = (("dense_vs_bm25", "bm25_only", "dense_only"), ("hybrid_vs_dense", "dense_only", "hybrid"), ("rerank_vs_hybrid", "hybrid", "hybrid_rerank"), ("rerank_vs_dense", "dense_only", "hybrid_rerank"))


def relevance(found: DataFrame, truths: DataFrame, docs: DataFrame) -> DataFrame:
    """found with relevant: token F1 of the document and the question's ground truth (item_id, truth) is at least RELEVANT."""
    t = truths.select("item_id", F.array_distinct(T.tokens(F.col("truth"))).alias("t"))
    wanted = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("d"))
    return found.join(t, "item_id").join(wanted, "doc_id").withColumn("relevant", T.token_f1(F.col("t"), F.col("d")) >= RELEVANT).drop("t", "d")


def hit_rate_and_mrr(judged: DataFrame, questions: DataFrame, by: str = "strategy") -> DataFrame:
    """(by, n_items, hit_rate, mrr) over all questions asked; one without any result counts as missed."""
    first = judged.groupBy(by, "item_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    every = judged.select(by).distinct().join(questions.select("item_id").distinct())
    found = every.join(first, [by, "item_id"], "left")
    return found.groupBy(by).agg(F.count("*").alias("n_items"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def context_counts(found: DataFrame, questions: DataFrame, by: str = "strategy") -> DataFrame:
    """(by, avg_chunks, items_with_context) over all questions asked; one without any result counts as 0 chunks."""
    sizes = found.groupBy(by, "item_id").agg(F.count("*").alias("n"))
    every = found.select(by).distinct().join(questions.select("item_id").distinct())
    rows = every.join(sizes, [by, "item_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(by).agg(F.round(F.avg("n"), 1).alias("avg_chunks"), F.count_if(F.col("n") > 0).alias("items_with_context"))


def judge_means(judged: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the mean of each metric over the rows where it is neither null nor NaN; NaN where there is none."""
    scored = lambda m: F.round(F.nanvl(F.col(m), F.lit(None).cast("double")), 4)
    return judged.agg(*(F.coalesce(F.round(F.avg(scored(m)), 4), F.lit(float("nan"))).alias(m) for m in metrics))


def judged(answers: DataFrame, items: DataFrame, found: DataFrame, docs: DataFrame, judge: Callable) -> DataFrame:
    """judge_means of what a judge says of (item_id, answer) rows: it gets (item_id, question, answer, contexts, truth) of those with any context, contexts in the order of
    their ranks (TOP of them at most), and gives (item_id, JUDGED...), null or NaN where it has no score."""
    texts = found.join(docs.select("doc_id", "text"), "doc_id").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    rows = answers.select("item_id", "answer").join(items.select("item_id", "question", "truth"), "item_id").join(texts, "item_id", "left")
    return judge_means(judge(with_context(rows.select("item_id", "question", "answer", "contexts", "truth"))), list(JUDGED))


def deltas(metrics: DataFrame, value: str, by: str = "strategy") -> DataFrame:
    """(delta, pct): percent from one strategy to another; null where either is missing or 0."""
    at = lambda s: F.max(F.when(F.col(by) == s, F.col(value)))
    pairs = metrics.agg(*(F.struct(at(a).alias("a"), at(b).alias("b")).alias(n) for n, a, b in DELTAS))
    rows = pairs.select(F.explode(F.array(*(F.struct(F.lit(n).alias("delta"), F.col(f"{n}.a").alias("a"), F.col(f"{n}.b").alias("b")) for n, _, _ in DELTAS))).alias("x")).select("x.*")
    return rows.select("delta", F.when((F.col("a") != 0) & (F.col("b") != 0), F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 1)).alias("pct"))


def latency(rows: DataFrame, value: str, by: str) -> DataFrame:
    """mean, median, p95 (the sorted value at min(floor(0.95 n), n - 1)), least and most. The rank is found without gathering a group in one row."""
    order = Window.partitionBy(by).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    place = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1) + 1
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 1).alias("mean"), F.round(F.median("v"), 1).alias("median"), F.round(F.max(F.when(F.col("i") == place, F.col("v"))), 1).alias("p95"), F.round(F.min("v"), 1).alias("least"), F.round(F.max("v"), 1).alias("most")
    )


def answer_rates(answers: DataFrame) -> DataFrame:
    """Of (answer, truth): citation rate of non-blank answers, and refusal rate of questions outside the corpus (null without any)."""
    filled = F.coalesce(F.col("answer"), F.lit("")).rlike(r"(?U)\S")
    return answers.agg(
        F.round(F.coalesce(F.avg(F.when(filled, T.is_cited(F.col("answer")).cast("double"))), F.lit(0.0)), 4).alias("citation_rate"),
        F.round(F.avg(F.when(T.is_out_of_corpus(F.col("truth")), T.is_refusal(F.col("answer")).cast("double"))), 4).alias("refusal_rate"),
        F.count(F.when(filled, 1)).alias("n_answers"), F.count(F.when(T.is_out_of_corpus(F.col("truth")), 1)).alias("n_outside"),
    )


def correctness(pairs: DataFrame, embed: Callable = embedded) -> DataFrame:
    """n, token_f1 and semantic: mean token F1 and mean cosine of (answer, truth), without questions outside the corpus and empty texts. Pairs of
    which a vector has no length count for the first mean only; 0 without any."""
    words = lambda c: F.array_distinct(T.tokens(F.col(c)))
    kept = pairs.where(~T.is_out_of_corpus(F.col("truth"))).where("answer <> '' and truth <> ''")
    vector = lambda c, name: embed(kept.select("item_id", F.col(c).alias("text")), "item_id").select("item_id", F.col("vector").alias(name))
    both = vector("answer", "a").join(vector("truth", "b"), "item_id").where("a is not null and b is not null")
    means = kept.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(T.token_f1(words("answer"), words("truth"))), F.lit(0.0)), 4).alias("token_f1"))
    near = both.agg(F.round(F.coalesce(F.avg(cosine(F.col("a"), F.col("b"))), F.lit(0.0)), 4).alias("semantic"))
    return means.withColumn("semantic", near.scalar())


def with_context(answers: DataFrame) -> DataFrame:
    """The rows that judge metrics are asked for: those with any context."""
    return answers.where(F.size(F.coalesce("contexts", F.array().cast("array<string>"))) > 0)


def by_tier(judged: DataFrame, questions: DataFrame, tier: str = "tier") -> DataFrame:
    """hit_rate_and_mrr of each strategy by a column of the questions."""
    rows = judged.join(questions.select("item_id", tier), "item_id")
    first = rows.groupBy("strategy", tier, "item_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    sizes = questions.groupBy(tier).agg(F.count_distinct("item_id").alias("n_items"))
    sums = first.groupBy("strategy", tier).agg(F.count("first").alias("hits"), F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("ranks")).join(sizes, tier)
    return sums.select("strategy", tier, "n_items", F.round(F.col("hits") / F.col("n_items"), 4).alias("hit_rate"), F.round(F.col("ranks") / F.col("n_items"), 4).alias("mrr"))


def zipped(questions: Column, answers: Column, truths: Column) -> Column:
    """Parallel lists as one list of structs, as long as the shortest."""
    n = F.least(F.size(questions), F.size(answers), F.size(truths))
    return F.slice(F.arrays_zip(questions.alias("question"), answers.alias("answer"), truths.alias("truth")), F.lit(1), n)


def targets_met(metrics: DataFrame, targets: dict[str, float]) -> Column:
    ok = F.lit(True)
    for name, least in targets.items():
        ok = ok & (F.coalesce(F.nanvl(F.col(name), F.lit(None).cast("double")), F.lit(0.0)) >= least)
    return ok
