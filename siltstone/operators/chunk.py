"""Structure-aware chunks: articles, oversized articles by clause, and paragraph packing where a text has no article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

SHORTEST, LONGEST, WINDOW = 50, 4000, 800
ARTICLE_HEADER, WINDOW_HEADER = 120, 80
SECOND_SHORTEST = 30


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, strategy, text, header, clause_count, char_count) of docs (doc_id, text: cleaned). char_count of a part of an
    oversized article is the length before its blanks are stripped and it is cut."""
    rows = docs.select("doc_id", "text", T.articles(F.col("text")).alias("articles"))
    found = rows.where(F.size("articles") > 0).select("doc_id", F.posexplode("articles").alias("n", "raw")).select("doc_id", "n", T.stripped(F.col("raw")).alias("article")).where(F.length("article") >= SHORTEST)
    header = F.substring(F.split("article", "\n")[0], 1, ARTICLE_HEADER)
    parts = F.filter(T.packed(T.clauses(F.col("article")), LONGEST), lambda b: b.rlike(r"(?U)\S"))
    whole = F.array(F.struct(F.lit("article").alias("strategy"), F.col("article").alias("text"), T.clause_count(F.col("article")).alias("clause_count"), F.length("article").alias("char_count")))
    split = F.transform(parts, lambda b: F.struct(F.lit("clauses").alias("strategy"), F.substring(T.stripped(b), 1, LONGEST).alias("text"), F.lit(0).alias("clause_count"), F.length(b).alias("char_count")))
    one = found.select("doc_id", "n", header.alias("header"), F.posexplode(F.when(F.length("article") > LONGEST, split).otherwise(whole)).alias("m", "c")).select("doc_id", "n", "m", "header", "c.*")
    packed = rows.where(F.size("articles") == 0).select("doc_id", F.posexplode(T.packed(T.paragraphs(F.col("text")), WINDOW, "\n\n")).alias("n", "text"))
    two = packed.select("doc_id", "n", F.lit(0).alias("m"), F.substring("text", 1, WINDOW_HEADER).alias("header"), F.lit("window").alias("strategy"), "text", F.lit(None).cast("int").alias("clause_count"), F.length("text").alias("char_count"))
    return one.unionByName(two).select("doc_id", (F.col("n") * 10000 + F.col("m")).cast("long").alias("chunk_index"), "strategy", "text", "header", F.col("clause_count").cast("long").alias("clause_count"), F.col("char_count").cast("long").alias("char_count"))


def second_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text, header) of docs (doc_id, text) by the corpus expander's chunker: cut before every article in any case,
    what stands before the first one is kept. An index counts the pieces that are not blank, also those too short to be kept. The
    reference's window of words is only for texts without such a piece, which have no words either."""
    parts = F.filter(F.transform(F.split("text", T.ANY_ARTICLE), T.stripped), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("chunk_index", "text")).where(F.length("text") >= SECOND_SHORTEST)
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.substring(F.split("text", "\n")[0], 1, ARTICLE_HEADER).alias("header"))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("text") >= SHORTEST)


def with_ids(rows: DataFrame, source: str = "doc_id") -> DataFrame:
    """A stable chunk_id, so that a second ingest writes the same rows."""
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("\x01", F.col(source).cast("string"), F.col("chunk_index").cast("string"), "text"), 256))
