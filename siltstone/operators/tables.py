"""Maintenance of stored tables: save what is new, upsert, backfill, compare, register."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import shared_dir, small_batches


def cut(rows: DataFrame) -> DataFrame:
    """rows as a checkpoint in the shared folder: plans that use them again and again start there."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    with small_batches(rows.sparkSession):
        return rows.checkpoint()


def new_rows(rows: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return rows.join(existing.select(key), key, "left_anti")


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order: distinct that keeps places."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def upserted(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """base with updates written over it; of several updates of a key the last version wins."""
    last = updates.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def backfilled(rows: DataFrame, filled: dict) -> DataFrame:
    """Empty fields filled from extracted ones; changed tells whether any was."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    changed = F.lit(False)
    for c, v in filled.items():
        changed = changed | (empty(c) & (F.coalesce(v, F.lit("")) != ""))
    return rows.withColumns({**{c: F.when(empty(c), v).otherwise(F.col(c)) for c, v in filled.items()}, "changed": changed})


def parity(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """rows, same and equal of two stores' answers by key."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("n_same"), F.coalesce(F.bool_and(F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("equal"))


def registry(chunks: DataFrame, key: str = "source") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))
