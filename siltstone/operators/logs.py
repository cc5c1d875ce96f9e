"""Analytics over query and error logs and conversations. Events: (event_id, ts, user_id, event_type, value); `error` rows are the error log."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import tables

ERROR = "error"


def metrics(events: DataFrame) -> DataFrame:
    """total_queries, avg_latency_ms (of latencies above 0, one digit, 0 without any), active_sessions, in one pass."""
    q = F.col("event_type") != ERROR
    return events.agg(
        F.count(F.when(q, 1)).alias("total_queries"), F.round(F.coalesce(F.avg(F.when(q & (F.col("value") > 0), F.col("value"))), F.lit(0.0)), 1).alias("avg_latency_ms"), F.countDistinct(F.when(q, F.col("user_id"))).alias("active_sessions")
    )


def error_rate(events: DataFrame, minutes: int = 60, now=None) -> DataFrame:
    """Errors per query in the last minutes before now (the last event's time by default); 0 without queries."""
    end = events.agg(F.max("ts").alias("m")).select("m").scalar() if now is None else F.lit(now)
    rows = events.where(F.col("ts") >= end - F.make_interval(mins=F.lit(minutes)))
    errors, queries = F.count(F.when(F.col("event_type") == ERROR, 1)), F.count(F.when(F.col("event_type") != ERROR, 1))
    return rows.agg(errors.alias("errors"), queries.alias("queries"), F.when(queries > 0, F.round(errors / queries, 4)).otherwise(0.0).alias("error_rate"))


def rate_limited(events: DataFrame, most: int = 10, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """events with recent (a key's events in the last seconds, those of the same time included) and limited (more than most). Time is cut into stretches
    of that length and an event also counts in the one after its own, so a key with very many events is not one task's."""
    stretch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    rows = events.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_part", stretch + F.when(F.col("_own"), 0).otherwise(1))
    recent = F.expr(f"count(*) OVER (PARTITION BY `{key}`, _part ORDER BY ts RANGE BETWEEN INTERVAL '{seconds}' SECOND PRECEDING AND CURRENT ROW)")
    counted = rows.withColumn("recent", recent).where("_own").drop("_own", "_part")
    return counted.withColumn("limited", F.col("recent") > most)


class _Calls:
    """Where the calls of a key stand: each pair's times let through within the window, its failed calls on end, and whose turn it is."""

    def __init__(self, most: int, seconds: int, failures: int, state: tuple):
        self.most, self.width, self.failures = most, seconds * 1_000_000, failures
        self.failed, self.cursor = list(state[:-1]), state[-1]
        self.windows: list[list[int]] = [[] for _ in self.failed]

    def state(self) -> tuple:
        """What outlives a gap of the window's length."""
        return (*self.failed, self.cursor)

    def call(self, at: int, bad: bool) -> tuple:
        """(pair, recent, failed_run) of a call."""
        live = [p for p, n in enumerate(self.failed) if n < self.failures]
        for p in (live[(self.cursor + i) % len(live)] for i in range(len(live))):
            window = self.windows[p] = [t for t in self.windows[p] if t > at - self.width]
            if len(window) < self.most:
                window.append(at)
                self.cursor = (live.index(p) + 1) % len(live)
                self.failed[p] = self.failed[p] + 1 if bad else 0
                return p, len(window), self.failed[p]
        return None, None, None


def _chunks(rows: DataFrame, seconds: int, size: int) -> DataFrame:
    """(k, bin, chunk, chunks): chunks of about `size` calls that begin where no call was for `seconds`. Calls are counted by bins of that length first, so a key is as many rows as there are bins in its time."""
    bins = rows.groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("k").orderBy("bin")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) >= seconds * 1_000_000, F.lit(True))
    counted = bins.withColumn("starts", starts).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begun = F.max(F.when(F.col("starts"), F.col("before"))).over(order)  # calls before the stretch that a bin is in
    return counted.select("k", "bin", F.floor(begun / size).alias("chunk")).withColumn("chunks", F.max("chunk").over(Window.partitionBy("k")) + 1)


def admitted(events: DataFrame, most: int = 10, seconds: int = 61, failures: int = 3, key: str = "user_id", pairs: int = 1, chunk: int = 100_000, states: int = 256) -> DataFrame:
    """(event_id, pair, recent, failed_run): calls let through by a round robin over `pairs` of a key, in the order of ts and event_id. A pair takes
    a call when it isn't dead and has fewer than `most` calls let through in the last seconds; pair is its number, null where none takes it (a
    refused call fills no window). recent counts the window's calls with this one, failed_run a pair's failed calls on end; from
    `failures` on it is dead.

    A key's calls are cut where none came for `seconds`, as no window outlives that, into chunks of about `chunk` calls, each a task's work. What does outlive it are few states (failed calls of each pair, whose
    turn): a first pass runs the chunks of keys that have several from every such state, which soon fall together; the states are handed on from chunk to chunk; a second pass runs all chunks from the right one. A task
    holds `most` times for each pair and state, and no rows. Keys are counted first: where all are small, one pass is enough. Where pairs have more than `states` states, or calls leave no such gap, a key's calls are one chunk."""
    start = (*[0] * pairs, 0)
    every = list(itertools.product(*[range(failures + 1)] * pairs, range(pairs))) if (failures + 1) ** pairs * pairs <= states else []
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col(key).alias("k"), F.col("event_id").cast("long").alias("event_id"), at.alias("at"), F.coalesce(F.col("event_type") == ERROR, F.lit(False)).alias("bad"), F.floor(at / (seconds * 1_000_000)).alias("bin"))
    kind = rows.schema["k"].dataType.simpleString()
    if every and (rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0) <= chunk:
        every = []  # no key has several chunks
    if every:
        rows = tables.cut(rows.alias("r").join(_chunks(rows, seconds, chunk).alias("c"), F.expr("r.k <=> c.k and r.bin <=> c.bin")).select("r.k", "event_id", "at", "bad", "chunk", "chunks"))
    else:
        rows = rows.select("k", "event_id", "at", "bad", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("chunks"))

    def passed(batches):
        """From each state that a chunk may begin in, the one it ends in."""
        last, runs, before = None, [], None

        def ended():
            to = [0] * len(every)
            for calls, starts in runs:
                for i in starts:
                    to[i] = every.index(calls.state())
            return pa.RecordBatch.from_arrays([pa.array([last[0]], type_), pa.array([last[1]], pa.int64()), pa.array([to], pa.list_(pa.int32()))], names=["k", "chunk", "to"])

        for batch in batches:
            type_ = batch.schema.field("k").type
            for k, n, t, bad in zip(*(batch.column(c).to_pylist() for c in ("k", "chunk", "at", "bad")), strict=True):
                if (k, n) != last:
                    if runs:
                        yield ended()
                    last, before, runs = (k, n), None, [(_Calls(most, seconds, failures, s), [i]) for i, s in enumerate(every)]
                if before is not None and t - before >= seconds * 1_000_000 and len(runs) > 1:
                    alike: dict[tuple, tuple] = {}
                    for calls, starts in runs:
                        alike.setdefault(calls.state(), (calls, []))[1].extend(starts)
                    runs = list(alike.values())
                for calls, _ in runs:
                    calls.call(t, bad)
                before = t
        if runs:
            yield ended()

    def handed_on(batches):
        last, state = None, start
        for batch in batches:
            out = []
            for k, n, to in zip(*(batch.column(c).to_pylist() for c in ("k", "chunk", "to")), strict=True):
                state = start if (k,) != last else state
                last = (k,)
                out.append(list(state))
                state = every[to[every.index(tuple(state))]]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("chunk"), pa.array(out, pa.list_(pa.int32()))], names=["k", "chunk", "state"])

    def run(batches):
        last, calls = None, None
        for batch in batches:
            out = []
            for k, n, event, t, bad, state in zip(*(batch.column(c).to_pylist() for c in ("k", "chunk", "event_id", "at", "bad", "state")), strict=True):
                if (k, n) != last:
                    last, calls = (k, n), _Calls(most, seconds, failures, tuple(state or start))
                if state is None:
                    out.append((event, *calls.call(t, bad)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["event_id", "pair", "recent", "failed_run"])

    none = F.lit(None).cast("array<int>")
    all_rows = rows.select("k", "chunk", F.lit(1).alias("kind"), "event_id", "at", "bad", none.alias("state"))
    if every:
        many = rows.where("chunks > 1").select("k", "chunk", "event_id", "at", "bad").repartition("k", "chunk").sortWithinPartitions("k", "chunk", "at", "event_id")
        ends = many.mapInArrow(passed, f"k {kind}, chunk long, to array<int>")
        starts = ends.repartition("k").sortWithinPartitions("k", "chunk").mapInArrow(handed_on, f"k {kind}, chunk long, state array<int>")
        all_rows = all_rows.unionByName(starts.select("k", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("at"), F.lit(False).alias("bad"), "state"))
    return all_rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "kind", "at", "event_id").mapInArrow(run, "event_id long, pair int, recent int, failed_run int")


def error_windows(events: DataFrame, width: str = "60 minutes", slide: str = "30 minutes") -> DataFrame:
    """Errors and queries by sliding window, batch or stream."""
    by = events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.when(F.col("event_type") == ERROR, 1)).alias("errors"), F.count(F.when(F.col("event_type") != ERROR, 1)).alias("queries"))
    return by.select(F.col("w.start").alias("window_start"), "errors", "queries", F.when(F.col("queries") > 0, F.round(F.col("errors") / F.col("queries"), 4)).otherwise(0.0).alias("error_rate"))


def last_messages(turns: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of every conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def histories(turns: DataFrame, n: int = 6, chars: int = 800) -> DataFrame:
    """Every user message with the n messages before it, cut to chars, as `role: text` lines."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars))
    rows = turns.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))
    return rows.where("role = 'user'").select("conv_id", "turn", "history")


def hit_summary(found: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, summary): documents of a question's hits in the order of their first hit, with counts, the first three as `name (n đoạn)`."""
    by = found.join(names, "doc_id").groupBy("item_id", "name").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    order = Window.partitionBy("item_id").orderBy("first")
    rows = by.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    text = F.concat("name", F.lit(" ("), F.col("n").cast("string"), F.lit(" đoạn)"))
    return rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda x: x["t"]), ", ").alias("summary"))


def health(services: DataFrame) -> DataFrame:
    """ok, degraded or error of (grp, healthy) by group: all, some or none healthy."""
    return services.groupBy("grp").agg(F.when(F.bool_and("healthy"), "ok").when(F.bool_or("healthy"), "degraded").otherwise("error").alias("status"))


def query_log(rows: DataFrame) -> DataFrame:
    """Rows as they are logged: query cut to 500 characters, answer to 300."""
    return rows.withColumns({"query": F.substring("query", 1, 500), "answer_snippet": F.substring("answer_snippet", 1, 300)})


def upload_log(rows: DataFrame) -> DataFrame:
    """Uploads as they are logged: the filename cut to 260 characters."""
    return rows.withColumn("filename", F.substring("filename", 1, 260))


def shown_sources(sources: Column, most: int = 5) -> Column:
    """The first sources of an answer, cited or not."""
    return F.slice(F.coalesce(sources, F.array()), 1, most)


def source_titles(found: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, titles): the titles of a question's first hits, as the chat log has them."""
    rows = found.where(F.col("rank") <= most).join(names, "doc_id")
    return rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("titles"))
