"""Writers: documents once, chunks, logs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import tables

TARGETS = {"faithfulness": 0.80, "answer_relevancy": 0.75, "context_recall": 0.70}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table doesn't hold yet."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = tables.new_rows(rows, spark.read.parquet(path), key)
    rows.write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str, key: str, version: str) -> None:
    """Writes a new generation of the table beside the old one, puts the old one aside and the new one in its place. A crash between leaves one of
    them whole; recover() finds it."""
    spark = rows.sparkSession
    recover(spark, path)
    base = spark.read.parquet(path) if exists(spark, path) else rows.limit(0)
    replaced(tables.upserted(base, rows, key, version), path)


def replaced(rows: DataFrame, path: str) -> None:
    """Writes rows, which may be made of the table itself, in its place; a crash between leaves one of both whole (recover)."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path + ".next")
    if exists(spark, path):
        _move(spark, path, path + ".old")
    _move(spark, path + ".next", path)
    _remove(spark, path + ".old")


def recover(spark: SparkSession, path: str) -> None:
    """Ends an upsert that was broken off: where the table is missing, the new generation if it is complete, else the old one."""
    if not exists(spark, path):
        for other in (path + ".next", path + ".old"):
            if exists(spark, other + "/_SUCCESS"):
                _move(spark, other, path)
                break
    if exists(spark, path):
        _remove(spark, path + ".old")


def _paths(spark: SparkSession, *names: str):
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *paths


def _move(spark: SparkSession, a: str, b: str) -> None:
    fs, x, y = _paths(spark, a, b)
    if not fs.rename(x, y):
        raise OSError(f"{a} could not be moved to {b}")


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _paths(spark, path)
    fs.delete(p, True)


def migrate(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes a store's rows (id, text, metadata, embedding) to another store as they are: nothing is embedded again."""
    rows.select("id", "text", "metadata", "embedding").write.mode("overwrite").format(format).save(path)


def verified(old: DataFrame, new: DataFrame) -> bool:
    """Whether the first, middle and last row of the old store (id, embedding), each asked for by its own vector, find the same nearest id in both stores."""
    from siltstone.operators.retrieval import nearest, unit

    ordered = tables.cut(old.select("id").orderBy("id")).withColumn("at", F.monotonically_increasing_id())  # sorted once; `at` is the partition's number and the row's place in it
    sizes = sorted(ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect())  # a row a partition
    n = sum(r["count"] for r in sizes)
    if not n:
        return new.isEmpty()
    places, wanted, before = sorted({0, n // 2, n - 1}), [], 0
    for r in sizes:
        wanted += [(r["part"] << 33) + p - before for p in places if before <= p < before + r["count"]]
        before += r["count"]
    picked = old.select("id", "embedding").join(ordered.where(F.col("at").isin(wanted)).select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    asked = picked.select(F.col("id").alias("query"), unit(F.col("embedding")).alias("vector"))
    first = lambda store: nearest(asked, store.select("id", unit(F.col("embedding")).alias("vector")), 1, 8)
    return tables.parity(first(old), first(new), "query", "id").first()["equal"] and first(new).count() == asked.count()


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def dropped_tables(spark: SparkSession, keep: set[str], really: bool = False) -> list[str]:
    """Tables beyond the ones to keep; dropped only if really is set."""
    gone = sorted(t.name for t in spark.catalog.listTables() if t.name not in keep)
    for t in gone if really else []:
        spark.sql(f"DROP TABLE IF EXISTS `{t}`")
    return gone


def report_sections(found: DataFrame, docs: DataFrame, title: str, rows: int = 20, excerpts: int = 10, chars: int = 600, summaries: DataFrame | None = None) -> DataFrame:
    """(item_id, section, position, body): header, the paragraphs of the summaries (item_id, summary), source table and excerpts of a report, escaped for markup."""
    hits = found.join(docs.select("doc_id", "text"), "doc_id")
    head = found.select("item_id").distinct().select("item_id", F.lit("header").alias("section"), F.lit(0).alias("position"), F.lit(title).alias("body"))
    sources = hits.where(F.col("rank") <= rows).select("item_id", F.lit("sources").alias("section"), F.col("rank").alias("position"), F.concat_ws(" | ", F.col("doc_id").cast("string"), F.round("score", 4).cast("string")).alias("body"))
    parts = hits.where(F.col("rank") <= excerpts).select("item_id", F.lit("excerpts").alias("section"), F.col("rank").alias("position"), T.xml_escaped(F.substring("text", 1, chars)).alias("body"))
    out = head.unionByName(sources).unionByName(parts)
    if summaries is None:
        return out
    lines = summaries.select("item_id", F.posexplode(F.filter(F.transform(F.split("summary", "\n"), T.stripped), lambda x: x != "")).alias("position", "line"))
    return out.unionByName(lines.select("item_id", F.lit("summary").alias("section"), "position", T.xml_escaped(F.col("line")).alias("body")))


def report_markdown(sections: DataFrame) -> DataFrame:
    """(item_id, report): a report's sections as one Markdown text."""
    place = F.array_position(F.array(*(F.lit(x) for x in ("header", "summary", "sources", "excerpts"))), F.col("section"))
    line = F.when(F.col("section") == "header", F.concat(F.lit("# "), "body")).when(F.col("section") == "sources", F.concat(F.lit("- "), "body")).when(F.col("section") == "excerpts", F.concat(F.lit("> "), "body")).otherwise(F.col("body"))
    rows = sections.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "position", line.alias("line")))).alias("lines"))
    return rows.select("item_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("report"))


def judge_report(metrics: DataFrame) -> DataFrame:
    """metrics with passed: every target is reached; a missing value counts as 0."""
    from siltstone.operators.evaluate import targets_met

    return metrics.withColumn("passed", targets_met(metrics, TARGETS))


def benchmark_report(metrics: DataFrame, deltas: DataFrame) -> DataFrame:
    """One row, report: the JSON of a comparison, its strategies and the deltas between them."""
    rows = metrics.agg(F.array_sort(F.collect_list(F.struct("strategy", *(c for c in metrics.columns if c != "strategy")))).alias("strategies"))
    moved = deltas.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("delta", "pct")))).alias("deltas"))
    return rows.join(moved).select(F.to_json(F.struct("strategies", "deltas"), {"ignoreNullFields": "false"}).alias("report"))


def answer_key(questions: DataFrame) -> str:
    """A fingerprint of the list of questions in its order (item_id)."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\x01")
    return questions.agg(F.sha2(F.coalesce(listed, F.lit("")), 256)).first()[0]


def cached_answers(spark: SparkSession, path: str, strategy: str, questions: DataFrame) -> DataFrame | None:
    """A strategy's stored answers, only where they are of just these questions; else None."""
    if not exists(spark, f"{path}/{strategy}"):
        return None
    rows = spark.read.parquet(f"{path}/{strategy}").where(F.col("questions") == answer_key(questions)).drop("questions")
    return None if rows.isEmpty() else rows


def cache_answers(answers: DataFrame, path: str, strategy: str, questions: DataFrame) -> None:
    answers.withColumn("questions", F.lit(answer_key(questions))).write.mode("overwrite").parquet(f"{path}/{strategy}")
