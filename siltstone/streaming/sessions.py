"""Sessions with bounded state that end when they fall silent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from siltstone.streaming.replay import replayed, stateful

MOST = 20
#: Seconds of the machine's time after which a key without a time of its own leaves the state.
KEPT = 86_400


class Expiring(StatefulProcessor):
    """A key's list of numbers, and one timer that takes it out of the state. The time is that of the events (column `time`, microseconds) where there is a
    watermark, else the machine's."""

    def __init__(self, seconds: int, by_events: bool):
        self.milliseconds, self.by_events = seconds * 1000, by_events

    def init(self, handle) -> None:
        self.handle = handle
        self.list = handle.getListState("numbers", "number long")

    def numbers(self) -> list[int]:
        return [int(x[0]) for x in self.list.get()]

    def keep(self, numbers: list[int], times: list[int], timer_values) -> None:
        """numbers as the new state, and a timer after the last of times, or of the timers that are set."""
        self.list.put([(n,) for n in numbers])
        now = max(times) // 1000 if self.by_events else timer_values.getCurrentProcessingTimeInMs()
        end, before = now + self.milliseconds, list(self.handle.listTimers())
        if end > max(before, default=-1):
            for t in before:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        gone = self.ended(key)
        self.list.clear()
        if gone is not None:
            yield gone

    def ended(self, key) -> pd.DataFrame | None:
        """Rows that tell of the end."""
        return None

    def close(self) -> None:
        pass


class Sessions(Expiring):
    """The newest MOST turns of a session; emits their number and the last one after each batch, and once more when it has ended."""

    def _row(self, key, turns: list[int], ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "n_messages": [len(turns)], "last_turn": [turns[-1]], "ended": [ended]})

    def handleInputRows(self, key, rows, timerValues):
        turns, times = self.numbers(), []
        for f in rows:
            turns = sorted(turns + f["turn"].tolist())[-MOST:]
            times += f["time"].tolist()
        self.keep(turns, times, timerValues)
        yield self._row(key, turns, False)

    def ended(self, key):
        turns = self.numbers()
        return self._row(key, turns, True) if turns else None


def sessions(stream: DataFrame, silence: int = KEPT, ts: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(conv_id, n_messages, last_turn, ended) of a stream of turns (conv_id, turn), after each batch for the sessions in it. A session without turns for
    `silence` seconds, by the times in column ts and their watermark (rows `delay` behind it are too late) or by the machine's, emits a row with ended and leaves the state;
    a turn after that begins anew."""
    time = F.lit(0).cast("long") if ts is None else F.unix_micros(F.col(ts).cast("timestamp"))
    rows = (stream if ts is None else stream.withWatermark(ts, delay)).select("conv_id", "turn", time.alias("time"), *([] if ts is None else [ts]))
    mode = "ProcessingTime" if ts is None else "EventTime"
    return rows.groupBy("conv_id").transformWithStateInPandas(Sessions(silence, ts is not None), "conv_id long, n_messages long, last_turn long, ended boolean", "Update", mode)


def session_state(spark: SparkSession, path: str, silence: int = KEPT, ts: str | None = None) -> DataFrame:
    """(conv_id, n_messages, last_turn) after the whole stream: what the last batch that had a session's rows gave."""
    rows = replayed(stateful(spark, ts is not None), path, lambda stream: sessions(stream, silence, ts), "update")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("n_messages", "last_turn"), F.struct("last_turn", "n_messages")).alias("s"))
    return last.select("conv_id", "s.*")
