"""Goldens of the survey's rows that had no code: SCL-16, SCL-45, AGG-14, AGG-15, VEC-02, PRJ-01, PRJ-02, JN-07."""

import math

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunk, evaluate, rules
from siltstone.plans import catalog, fixtures


def test_rows_are_registered():
    assert {"chunk_second", "short_timestamps", "eval_context_counts", "eval_judge_means", "score_scales_top5", "node_chunks", "payload_flatten", "compliance_vectors"} <= set(catalog.queries())


def test_second_chunker_keeps_the_preamble_and_ignores_case(spark):
    long = "x" * 30
    docs = spark.createDataFrame([(1, f" Căn cứ {long}\nĐIỀU 1. {long}\nb điều 2: ngắn Điều 3. {long}"), (2, " \n"), (3, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.chunk_index, r.text, r.header) for r in chunk.second_chunks(docs).orderBy("doc_id", "chunk_index").collect()]
    assert rows == [(1, 0, f"Căn cứ {long}", f"Căn cứ {long}"), (1, 1, f"ĐIỀU 1. {long}\nb", f"ĐIỀU 1. {long}"), (1, 3, f"Điều 3. {long}", f"Điều 3. {long}")]


def test_timestamps_scales_and_payloads(spark):
    rows = spark.createDataFrame([("2026-06-19T13:26:06.113149+00:00",), ("2026-06-19 13:26:06.1",), ("",)], "s string")
    assert [r[0] for r in rows.select(T.short_timestamp(F.col("s"))).collect()] == ["19/06 13:26:06", "2026-06-19 13:26:06", ""]
    scales = spark.range(1).select(*(v.alias(n) for n, v in T.score_scales(F.lit(0.5)).items())).first()
    assert (scales.similarity, scales.inverse_distance, scales.one_less_distance) == (0.5, 1 / 1.5, 0.5)
    payload = F.create_map(*(F.lit(x) for x in ("_node_content", '{"text": "t"}', "doc_id", "1", "k", "v")))
    got = spark.range(1).select(T.payload_text(payload).alias("t"), T.public_metadata(payload).alias("one"), T.public_metadata(payload, T.INTERNAL).alias("two")).first()
    assert (got.t, got.one, got.two) == ("t", {"doc_id": "1", "k": "v"}, {"k": "v"})


def test_context_counts_and_judge_means(spark):
    found = spark.createDataFrame([("s", 1), ("s", 1), ("s", 1), ("u", 1)], "strategy string, item_id long")
    asked = spark.createDataFrame([(1,), (2,)], "item_id long")
    assert {tuple(r) for r in evaluate.context_counts(found, asked).collect()} == {("s", 1.5, 1), ("u", 0.5, 1)}
    judged = spark.createDataFrame([(0.5, math.nan), (None, None), (math.nan, None), (1.0, math.nan)], "a double, b double")
    means = evaluate.judge_means(judged, ["a", "b"]).first()
    assert means.a == 0.75 and math.isnan(means.b)


def test_vectors_find_the_first_of_equally_near_rules(spark):
    first = fixtures.criteria(spark).where("id = 'grant'")
    both = first.withColumn("id", F.lit("z")).union(first.withColumns({"id": F.lit("a"), "position": F.lit(9).cast("long")}))
    near = rules.by_vector(spark.createDataFrame([(1, "mức điểm để nhận"), (2, "xin chào")], "sit_id long, text string"), both)
    assert [tuple(r) for r in near.collect()] == [(1, "z")]
