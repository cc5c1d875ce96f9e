"""The rate limiter as a stream: the state of a client is the times of its newest requests, until it falls silent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.streaming.replay import replayed, stateful
from siltstone.streaming.sessions import KEPT, Expiring

MOST, SECONDS = 10, 60


class Limiter(Expiring):
    """Of (event_id, time) rows of a client: recent (its requests in the last seconds, this one included, at most most + 1) and limited. Rows of a batch are
    taken in the order of their times; the state holds most + 1 times."""

    def __init__(self, most: int, seconds: int, kept: int, by_events: bool):
        super().__init__(kept, by_events)
        self.most, self.seconds = most, seconds

    def handleInputRows(self, key, rows, timerValues):
        times = self.numbers()
        events = sorted((at, event) for f in rows for at, event in zip(f["time"].tolist(), f["event_id"].tolist(), strict=True))
        out = []
        for at, event in events:
            times = [t for t in times if t >= at - self.seconds * 1_000_000][-self.most :] + [at]
            out.append((event, len(times), len(times) > self.most))
        self.keep(times, [at for at, _ in events], timerValues)
        yield pd.DataFrame(out, columns=["event_id", "recent", "limited"])


def limited(stream: DataFrame, most: int = MOST, seconds: int = SECONDS, key: str = "user_id", delay: str | None = None) -> DataFrame:
    """(event_id, recent, limited) of a stream of requests (event_id, ts, key). With a delay the stream has a watermark: a client leaves the state once it is `seconds` behind
    it, and requests that come later than the delay are left out. Without one, every request is judged by what the state holds, and a client leaves after KEPT seconds of the machine's time."""
    rows = stream if delay is None else stream.withWatermark("ts", delay)
    rows = rows.select(F.col(key).alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), *([] if delay is None else ["ts"]))
    processor = Limiter(most, seconds, max(KEPT, seconds) if delay is None else seconds, delay is not None)
    return rows.groupBy("k").transformWithStateInPandas(processor, "event_id long, recent int, limited boolean", "Append", "ProcessingTime" if delay is None else "EventTime")


def limits(spark: SparkSession, path: str, most: int = MOST, seconds: int = SECONDS, key: str = "user_id") -> DataFrame:
    """(event_id, recent, limited) of a stored event table, replayed as a stream to its end. Events that come after later ones of their client
    are judged by what the state holds."""
    return replayed(stateful(spark), path, lambda stream: limited(stream, most, seconds, key), "append")
