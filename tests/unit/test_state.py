"""State that ends: sessions and clients that fall silent leave it."""

import time

from pyspark.sql import functions as F

from siltstone.streaming import limits, replay, sessions


def run(spark, stream_of, folder, out, cp, mode, by_events=True):
    """Runs a stream over what the folder holds now, with the state of the runs before, and gives all rows so far."""
    session = replay.stateful(spark, by_events)
    stream = stream_of(replay.source(session, folder, 1))
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(put).start().awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(out).drop("batch").collect()]


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)


def states(spark, cp):
    return spark.read.format("statestore").option("path", cp).option("stateVarName", "numbers").load()


def test_silent_sessions_end(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("turns", "out", "cp"))
    of = lambda stream: sessions.sessions(stream, 100, "ts")
    schema = "conv_id long, turn long, s long"
    add(spark, folder, [(1, t, t) for t in range(25)] + [(2, 0, 5)], schema)
    assert set(run(spark, of, folder, out, cp, "update")) == {(1, 20, 24, False), (2, 1, 0, False)}
    add(spark, folder, [(2, 1, 110)], schema)  # the first one has been silent for 86 seconds
    assert (1, 20, 24, True) not in run(spark, of, folder, out, cp, "update")
    add(spark, folder, [(3, 0, 180)], schema)
    got = run(spark, of, folder, out, cp, "update")
    assert (1, 20, 24, True) in got and (2, 2, 1, False) in got and not any(r[0] == 2 and r[3] for r in got)
    add(spark, folder, [(1, 25, 181)], schema)  # begins anew
    assert (1, 1, 25, False) in run(spark, of, folder, out, cp, "update")
    assert {r.key.conv_id for r in states(spark, cp).select("key").collect()} == {1, 2, 3}


def test_silent_clients_leave(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("events", "out", "cp"))
    of = lambda stream: limits.limited(stream, 3, 10, delay="0 seconds")
    schema = "event_id long, user_id long, s long"
    add(spark, folder, [(i, 1, i) for i in range(6)] + [(10, 2, 5)], schema)
    assert {r[0]: r[1:] for r in run(spark, of, folder, out, cp, "append")}[5] == (4, True)
    add(spark, folder, [(11, 2, 14)], schema)
    assert {r[0]: r[1:] for r in run(spark, of, folder, out, cp, "append")}[11] == (2, False)
    add(spark, folder, [(12, 2, 16)], schema)
    run(spark, of, folder, out, cp, "append")
    assert {r.key.k for r in states(spark, cp).select("key").collect()} == {2}


def test_keys_leave_by_the_machines_time_too(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("turns", "out", "cp"))
    of = lambda stream: sessions.sessions(stream, 1)
    add(spark, folder, [(1, 0, 0), (1, 1, 0)], "conv_id long, turn long, s long")
    assert run(spark, of, folder, out, cp, "update", False) == [(1, 2, 1, False)]
    time.sleep(2)
    add(spark, folder, [(2, 0, 0)], "conv_id long, turn long, s long")
    assert (1, 2, 1, True) in run(spark, of, folder, out, cp, "update", False)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert before is None or "HDFS" in before  # the caller's settings stay
