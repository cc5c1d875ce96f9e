"""The folder that the driver and all executors share, and how little memory their Python workers hold."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch at most while small_batches() holds.
ROWS = 2048
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a temporary one of this machine if the whole
    application runs in this process (local mode, as in tests), an error on a cluster: executors would lose what they write."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _own[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder; one that stays because the JVM is gone does no harm."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_writing = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ROWS rows at most, while any thread is in here; the last one puts back what the first one found."""
    conf, name, session = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", spark._jsparkSession.sessionUUID()
    with _writing:
        n, before = _writers.get(session, (0, conf.get(name)))
        _writers[session] = n + 1, before
        conf.set(name, str(min(int(before), ROWS)) if int(before) > 0 else str(ROWS))
    try:
        yield
    finally:
        with _writing:
            n, before = _writers.pop(session)
            if n > 1:
                _writers[session] = n - 1, before
            else:
                conf.set(name, before)


def trimmed(f):
    """A function over Arrow batches that gives the worker's freed memory back to the system at its end: workers live on between stages."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return run
