"""Running a stream over stored rows to its end, and appending logs and chunks as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.shared import scratch


def stateful(spark: SparkSession, by_events: bool = False) -> SparkSession:
    """A session with the same settings, but that its streams keep their state in RocksDB, as transformWithState needs; the settings of spark stay as they are.
    Streams by the machine's time run batches with rows only (they would never end otherwise, as a timer may always be due); those by the time of events run one more for the timers."""
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(by_events).lower())
    return session


def source(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stored table as a stream, some files at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path if _is_folder(spark, path) else path.rsplit("/", 1)[0] + "/" + path.rsplit("/", 1)[1].replace(".parquet", "[.]parquet"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def replayed(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """plan over the stream of a stored table, to its end. complete: the last result; append: all rows that came out. What it writes is removed when the driver ends."""
    folder = scratch(spark, "stream")
    out = f"{folder}/out"
    stream = plan(source(spark, path))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")  # a batch that runs again writes the same

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows if mode == "complete" else rows.drop("batch")


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows to a table."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def refresh_index(stream: DataFrame, path: str, checkpoint: str):
    """Takes the documents (doc_id, text) of a stream into the stored index at path as they come (operators.segments). A row with deleted, if there is such a column,
    takes its document out. A batch that runs again after a crash changes nothing: its name, of the checkpoint and its number, is in the index's ledger."""
    from siltstone.operators.segments import Index

    def put(batch: DataFrame, number: int) -> None:
        index, gone = Index(batch.sparkSession, path), None
        if "deleted" in batch.columns:
            gone, batch = batch.where("deleted").select("doc_id"), batch.where("not coalesce(deleted, false)")
        index.apply(f"{checkpoint}:{number}", batch.select("doc_id", "text"), gone)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
