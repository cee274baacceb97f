"""Where projections and cursors are kept between batches."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.shared import drop, shared_root

log = logging.getLogger("tidemark")


class Store(Protocol):
    """Named state tables. put() makes value and positions visible at once."""

    def get(self, name: str) -> DataFrame | None: ...

    def put(self, name: str, state: DataFrame, batch_id: str | None = None) -> None: ...


class ParquetStore:
    """Versioned snapshots in a folder that all executors share, with a pointer file that is replaced by renaming.

    A snapshot is complete before the pointer names it, so a crash leaves the version before. put() with a batch_id that
    the pointer bears already does nothing, which makes a repeated batch harmless. The last `versions` snapshots stay,
    for readers that still use them.
    """

    def __init__(self, spark: SparkSession, path: str, versions: int = 2):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), versions

    def _at(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _pointer(self, name: str) -> dict[str, Any] | None:
        fs, path = self._at(f"{self.path}/{name}/current")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def get(self, name: str) -> DataFrame | None:
        at = self._pointer(name)
        return None if at is None else self.spark.read.parquet(f"{self.path}/{name}/{at['versions'][-1]}")

    def put(self, name: str, state: DataFrame, batch_id: str | None = None) -> None:
        at = self._pointer(name) or {"versions": [], "batch": None}
        if batch_id is not None and at["batch"] == batch_id:
            return
        version = uuid.uuid4().hex
        state.write.parquet(f"{self.path}/{name}/{version}")
        kept, gone = (at["versions"] + [version])[-self.versions :], (at["versions"] + [version])[: -self.versions]
        self._replace(name, {"versions": kept, "batch": batch_id})
        for old in gone:
            drop(self.spark, f"{self.path}/{name}/{old}")

    def _replace(self, name: str, content: dict[str, Any]) -> None:
        fs, new = self._at(f"{self.path}/{name}/current-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        _, current = self._at(f"{self.path}/{name}/current")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(new, current, options)


class MemoryStore:
    """State for the life of a session, as checkpoints in the shared folder so that plans don't grow with each batch."""

    def __init__(self):
        self.states: dict[str, DataFrame] = {}
        self.batches: dict[str, str | None] = {}

    def get(self, name: str) -> DataFrame | None:
        return self.states.get(name)

    def put(self, name: str, state: DataFrame, batch_id: str | None = None) -> None:
        if name is None or state is None:
            raise ValueError("a name and a state are needed")
        if batch_id is not None and self.batches.get(name) == batch_id:
            return
        context = state.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_root(state.sparkSession))
        self.states[name], self.batches[name] = state.checkpoint(), batch_id

    def __iter__(self):
        return iter(self.states)


class CallableStore:
    """A store made of two functions."""

    def __init__(self, get: Callable[[str], DataFrame | None], put: Callable[[str, DataFrame], None]):
        self._get, self._put = get, put

    def get(self, name: str) -> DataFrame | None:
        return self._get(name)

    def put(self, name: str, state: DataFrame, batch_id: str | None = None) -> None:
        self._put(name, state)


class TracedStore:
    """Another store, telling of every read and write: reads once they are done, writes before."""

    def __init__(self, inner: Store, on_get: Callable[[str, DataFrame | None], None] | None = None, on_put: Callable[[str, DataFrame], None] | None = None):
        if on_get is None and on_put is None:
            on_get = lambda n, s: log.info("get %s: %s", n, "nothing" if s is None else "found")
            on_put = lambda n, s: log.info("put %s", n)
        self.inner, self.on_get, self.on_put = inner, on_get, on_put

    def get(self, name: str) -> DataFrame | None:
        state = self.inner.get(name)
        if self.on_get:
            self.on_get(name, state)
        return state

    def put(self, name: str, state: DataFrame, batch_id: str | None = None) -> None:
        if self.on_put:
            self.on_put(name, state)
        self.inner.put(name, state, batch_id)


class RetryingStore:
    """Another store whose passing failures are tried again: `tries` times in all, waiting longer each time."""

    def __init__(self, inner: Store, tries: int = 3, pause: float = 0.5):
        self.inner, self.tries, self.pause = inner, tries, pause

    def get(self, name: str) -> DataFrame | None:
        return retried(lambda: self.inner.get(name), self.tries, self.pause)

    def put(self, name: str, state: DataFrame, batch_id: str | None = None) -> None:
        retried(lambda: self.inner.put(name, state, batch_id), self.tries, self.pause)


def _passing(error: Exception) -> bool:
    """Whether trying again may help: trouble of a file system or a connection, in Python or Java."""
    from py4j.protocol import Py4JJavaError

    if isinstance(error, Py4JJavaError):
        name = error.java_exception.getClass().getName()
        return name.startswith(("java.io.", "java.net.")) and "FileNotFound" not in name
    return isinstance(error, OSError) and not isinstance(error, FileNotFoundError)


def retried(work: Callable[[], Any], tries: int = 5, pause: float = 0.2, passing: Callable[[Exception], bool] = _passing) -> Any:
    """work(), again after pause, 2 * pause and so on while it raises a passing error; the last one is raised."""
    for i in range(1, tries + 1):
        try:
            return work()
        except Exception as e:
            if i == tries or not passing(e):
                raise
            log.info("try %d of %d failed: %s", i, tries, e)
            time.sleep(pause * i)


class CursorStore:
    """Positions by (stream, partition), a table kept in another store. Positions are numbers, text or times."""

    def __init__(self, spark: SparkSession, inner: Store, name: str = "cursors"):
        self.spark, self.inner, self.name, self._lock = spark, inner, name, threading.Lock()

    def get(self, stream_id: str, partition_id: str = "") -> Any:
        state = self.inner.get(self.name)
        row = None if state is None else state.where((state.stream_id == stream_id) & (state.partition_id == partition_id)).first()
        made = None if row is None else json.loads(row["position"])
        return datetime.fromisoformat(made["time"]) if isinstance(made, dict) else made

    def put(self, stream_id: str, position: Any, partition_id: str = "") -> None:
        """Insert or replace one position. Threads of one driver take turns; drivers need stores of their own."""
        text = json.dumps({"time": position.isoformat()} if isinstance(position, datetime) else position)
        new = self.spark.createDataFrame([(stream_id, partition_id, text)], "stream_id string, partition_id string, position string")
        keys = ["stream_id", "partition_id"]
        with self._lock:
            old = self.inner.get(self.name)
            self.inner.put(self.name, new if old is None else old.join(new, keys, "left_anti").unionByName(new).coalesce(1))


class CallableCursors:
    """Positions kept by two functions: get(stream id, partition id) and put(stream id, position, partition id)."""

    def __init__(self, get: Callable[[str, str], Any], put: Callable[[str, Any, str], None]):
        self._get, self._put = get, put

    def get(self, stream_id: str, partition_id: str = "") -> Any:
        return self._get(stream_id, partition_id)

    def put(self, stream_id: str, position: Any, partition_id: str = "") -> None:
        self._put(stream_id, position, partition_id)
