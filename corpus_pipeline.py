"""A corpus from raw documents: languages, copies, near copies, a mix of sources, token ids.

Every stage takes the rows its predecessor kept and returns the columns of documents, the last one token ids. Stages may be chained
lazily: the work folders of a stage (in the shared folder) stay until the driver ends. run() writes what a stage returns and reads it again, and
removes the stage's work folders and its input as soon as that is written.

Nulls and cases, in every stage: documents whose text is null, empty or without a letter are `und` and go in the first stage, so no
later one sees them (called alone, each states in its module what it does with them). Null lang and source are values like any other; a null doc_id
takes no part in near-copy groups and stays. Of repeated rows exact_dedup keeps one. Of ties it keeps the smallest doc_id, as ngram_join does. Empty
tables give empty tables in every stage. Columns beyond those of documents stay up to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import remove, saved, watched, work_dir
from siltstone.llm.exact_dedup import exact_deduplicated
from siltstone.llm.language_id import known_language
from siltstone.llm.mixing import mixed
from siltstone.llm.ngram_join import near_deduplicated
from siltstone.llm.sentencepiece_codec import encode, model_bytes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept."""
    return known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the longest."""
    return exact_deduplicated(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked directly or over others, the one with the smallest doc_id."""
    return near_deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, whole."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and n_tokens; round_trip tells that the ids decode to the text."""
    return encode(docs.select("doc_id", "source", "lang", "text"), model_bytes(), keep=["doc_id", "source", "lang"], check=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL expresses neither the language models nor the mix nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    path = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        with watched() as made:
            docs = saved(stage(spark, docs, sf_dir), f"{path}/{name}")
        for folder in [*made, *before]:  # all that reads them is written
            remove(spark, folder)
        before = [f"{path}/{name}"]
    return docs
