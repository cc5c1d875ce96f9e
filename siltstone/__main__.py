"""python -m siltstone ingest ROOT --source json|parquet|text|markdown|docx|pdf PATH; python -m siltstone evaluate ROOT ITEMS [--strategies NAME...] [--limit N]
[--retrieval-only] [--cache FOLDER] [--report FILE]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.engine import SOURCES, Engine
from siltstone.operators.evaluate import deltas
from siltstone.operators.retrieval import STRATEGIES
from siltstone.operators.tables import cut
from siltstone.sources.readers import questions
from siltstone.sources.sinks import benchmark_report


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("root")
    ingest.add_argument("path")
    ingest.add_argument("--source", choices=sorted(SOURCES), default="json")
    ingest.add_argument("--reset", action="store_true")
    judge = commands.add_parser("evaluate")
    judge.add_argument("root")
    judge.add_argument("items")
    judge.add_argument("--strategies", nargs="*", default=list(STRATEGIES))
    judge.add_argument("--limit", type=int)
    judge.add_argument("--retrieval-only", action="store_true", help="no answers, so no scores of answers")
    judge.add_argument("--cache", help="folder of answers, taken again for the same questions")
    judge.add_argument("--report", help="folder that the comparison is written to as JSON")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    engine = Engine(spark, a.root)
    if a.command == "ingest":
        if a.reset:
            engine.reset()
        engine.ingest(SOURCES[a.source](spark, a.path))
        print(engine.metrics())
    else:
        items = questions(spark, a.items).select(F.xxhash64("question").alias("item_id"), "question", F.col("ground_truth").alias("truth")).dropDuplicates(["item_id"])
        rows = items.orderBy("item_id").limit(a.limit) if a.limit else items
        found = cut(engine.evaluate(rows, a.strategies, None if a.retrieval_only else extracts, a.cache))
        found.orderBy("strategy").show(truncate=False)
        if a.report:
            benchmark_report(found, deltas(found, "mrr")).coalesce(1).write.mode("overwrite").text(a.report)


def extracts(rows):
    """The default answers: the beginning of the context."""
    return rows.select("item_id", F.substring("context", 1, 700).alias("answer"))


if __name__ == "__main__":
    main()
