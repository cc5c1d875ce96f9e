"""Situations against threshold rules: match, value, verdict."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import retrieval
from siltstone.operators.tables import cut

#: Bytes of keywords that are sent to all situations at once (more go in blocks), and what a keyword counts beside its own.
BLOCK_BYTES, KEYWORD = 32 << 20, 64

SCHEMA = "id string, topic string, keywords array<string>, so_hieu string, dieu_khoan string, source_url string, condition struct<type: string, field: string, operator: string, value: double, unit: string>, verdict_template struct<pass: string, fail: string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file, numbered in its order; a missing file gives none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], "position long, " + SCHEMA)
    return rows.select(F.monotonically_increasing_id().alias("position"), "*")


def matched(situations: DataFrame, criteria: DataFrame) -> DataFrame:
    """(sit_id, text, id): the rule with strictly most keywords in a situation, null where there is no such rule. Each situation passes an automaton
    of all keywords once, where it lies; keywords beyond BLOCK_BYTES go in blocks, each over one scan. Every keyword counts once, as often as its rule has it."""
    rules = cut(criteria.select("id", "position", F.explode("keywords").alias("keyword")).where("keyword is not null").groupBy("id", "position", F.lower("keyword").alias("keyword")).agg(F.count("*").alias("n")))
    texts = situations.select("sit_id", F.lower("text").alias("low")).where("low is not null")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("keyword") + KEYWORD), F.lit(0))).first()[0]
    blocks, found = max(1, -(-size // BLOCK_BYTES)), None
    kind = situations.schema["sit_id"].dataType.simpleString()
    for i in range(blocks):
        part = rules.where(F.pmod(F.xxhash64("id", "keyword"), F.lit(blocks)) == i).toArrow()
        rows = texts.mapInArrow(_found(part, situations.sparkSession), f"sit_id {kind}, id string, position long, n long")
        found = rows if found is None else found.unionByName(rows)
    counted = found.groupBy("sit_id", "id", "position").agg(F.sum("n").alias("score"))
    order = Window.partitionBy("sit_id").orderBy(F.desc("score"), "position")
    best = counted.select("sit_id", "id", "score", F.row_number().over(order).alias("r"), F.lead("score").over(order).alias("next")).where((F.col("r") == 1) & (F.col("score") > F.coalesce("next", F.lit(0))))
    return situations.select("sit_id", "text").join(best.select("sit_id", "id"), "sit_id", "left")


def _found(rules: pa.Table, spark: SparkSession):
    """Counts of the keywords of each rule in (sit_id, low) rows, by an Aho-Corasick automaton that a worker builds once."""
    shared = spark.sparkContext.broadcast(rules.combine_chunks())  # BLOCK_BYTES

    def run(batches):
        ids, positions, keywords, n = (shared.value.column(c) for c in ("id", "position", "keyword", "n"))
        of: dict[str, list[int]] = {}
        for i, word in enumerate(keywords.to_pylist()):
            of.setdefault(word, []).append(i)
        always = of.pop("", [])
        automaton = ahocorasick.Automaton()
        for word, places in of.items():
            automaton.add_word(word, places)
        if of:
            automaton.make_automaton()
        for batch in batches:
            which, what = [], []
            for row, text in enumerate(batch.column("low").to_pylist()):
                hit = {id(places): places for _, places in automaton.iter(text)} if of else {}
                places = [*always, *(i for p in hit.values() for i in p)]
                which += [row] * len(places)
                what += places
            take = pa.array(what, pa.int64())
            out = [batch.column("sit_id").take(pa.array(which, pa.int64())), ids.take(take), positions.take(take), n.take(take)]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=["sit_id", "id", "position", "n"])

    return run


def by_vector(situations: DataFrame, criteria: DataFrame, least: float = 0.45, embed: Callable | None = None) -> DataFrame:
    """(sit_id, id): the rule whose topic is nearest by vectors (the first of equals), at a cosine of at least `least`. Topics' vectors go to all situations as a
    matrix, in blocks of retrieval.MATRIX_BYTES; nothing is joined by dimension."""
    embed = embed or retrieval.embedded
    topics = cut(embed(criteria.select("position", F.col("topic").alias("text")), "position").where("vector is not null"))
    rows = embed(situations.select("sit_id", "text"), "sit_id")
    count, width = topics.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks, found = max(1, -(-count * 8 * (width or 1) // retrieval.MATRIX_BYTES)), None
    for i in range(blocks):
        part = topics.where(F.pmod(F.xxhash64("position"), F.lit(blocks)) == i).orderBy("position").select(F.col("position").alias("id"), "vector").toArrow()
        near = rows.mapInArrow(_nearest_topic(part, situations.sparkSession, width or 1), "sit_id long, position long, score double")
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("sit_id").orderBy(F.desc("score"), "position")
    best = found.where(F.col("score") >= least).withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("sit_id", "position").join(criteria.select("id", "position"), "position").select("sit_id", "id")


def _nearest_topic(topics: pa.Table, spark: SparkSession, width: int):
    positions, matrix = retrieval._filled(*(topics.column(c).combine_chunks() for c in ("id", "vector")), width)
    shared = spark.sparkContext.broadcast((positions, matrix))  # MATRIX_BYTES, or one topic's vector

    def run(batches):
        positions, m = shared.value
        for batch in (b.slice(i, retrieval.ROWS) for b in batches for i in range(0, len(b), retrieval.ROWS)):
            ids, x = retrieval._filled(batch.column(0), batch.column(1), width)
            if not len(positions):
                ids, x = ids[:0], x[:0]
            s = np.round(x @ m.T, retrieval.SCORE_DIGITS)
            at = s.argmax(1) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(positions[at]), pa.array(s[np.arange(len(ids)), at])], names=["sit_id", "position", "score"])

    return run


def verdicts(situations: DataFrame, criteria: DataFrame, vectors: bool = False, embed: Callable | None = None, extract: Callable | None = None) -> DataFrame:
    """(sit_id, criterion_id, verdict, value, explanation): pass, fail, insufficient_info or no_match. extract, a port, gives (sit_id, value) of
    the (sit_id, text, topic) rows of which no pattern finds a number; without one they stay without a value."""
    rows = matched(situations, criteria)
    if vectors:
        rest = by_vector(rows.where("id is null"), criteria, embed=embed).withColumnRenamed("id", "near")
        rows = rows.join(rest, "sit_id", "left").select("sit_id", "text", F.coalesce("id", "near").alias("id"))
    c = criteria.select("id", "topic", "so_hieu", "dieu_khoan", "condition", "verdict_template")
    v, least, op = F.col("value"), F.col("condition.value"), F.col("condition.operator")
    ok = F.when(op == "<=", v <= least).when(op == "<", v < least).when(op == ">=", v >= least).when(op == ">", v > least).when(op == "==", v == least).otherwise(F.raise_error(F.concat(F.lit("unsupported operator: "), op)))
    found = rows.join(c, "id", "left").withColumn("value", F.when(F.col("id").isNotNull(), T.situation_value(F.col("text"))))
    if extract is not None:
        said = extract(found.where("id is not null and value is null").select("sit_id", "text", "topic")).select("sit_id", F.col("value").cast("double").alias("said"))
        found = found.join(said, "sit_id", "left").withColumn("value", F.coalesce("value", "said")).drop("said")
    verdict = F.when(F.col("id").isNull(), "no_match").when(v.isNull(), "insufficient_info").otherwise(F.when(ok, "pass").otherwise("fail"))
    filled = F.replace(F.replace(F.when(F.col("verdict") == "pass", F.col("verdict_template.pass")).otherwise(F.col("verdict_template.fail")), F.lit("{dieu_khoan}"), F.col("dieu_khoan")), F.lit("{so_hieu}"), F.col("so_hieu"))
    text = F.when(F.col("verdict") == "no_match", "").when(F.col("verdict") == "insufficient_info", F.format_string(T.VALUE_MISSING, F.col("topic"))).otherwise(filled)
    return found.withColumn("verdict", verdict).select("sit_id", F.coalesce("id", F.lit("")).alias("criterion_id"), "verdict", "value", text.alias("explanation"), "so_hieu", "dieu_khoan")


def rendered(rows: DataFrame) -> DataFrame:
    """verdicts with answer: prefix, explanation and source line."""
    source = F.concat(F.lit("\n\n**Nguồn:** "), "so_hieu", F.lit(" — "), "dieu_khoan")
    prefix = F.when(F.col("verdict") == "pass", T.VERDICT_PREFIX["pass"]).when(F.col("verdict") == "fail", T.VERDICT_PREFIX["fail"])
    return rows.withColumn("answer", F.when(prefix.isNotNull(), F.concat(prefix, F.lit(" "), "explanation", source)).otherwise(F.col("explanation")))
