"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by kept(), with the session that wrote them.
_KEPT: list[tuple[SparkSession, str]] = []
_SCOPE = threading.local()
#: Bytes of a row group in these tables: a task that writes or reads one holds about as much, on the heap and outside it.
ROW_GROUP = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a local master gets a temporary folder and a cluster one below its warehouse, never a machine's own.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="tidemark-shared-")
    else:
        made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-shared"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below shared_root()."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, compression: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df from a table in the shared folder: computed once, and safe when executors are lost.

    release(), the end of scratch() or the end of the driver removes the table.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "tidemark")
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).partitionBy(*partition_by).parquet(path)
    _KEPT.append((spark, path))
    if (scope := getattr(_SCOPE, "made", None)) is not None:
        scope.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._tidemark_path = path
    return made


def release(spark: SparkSession) -> None:
    """Remove the tables that kept() wrote in this session; frames that read them are void then."""
    for pair in [p for p in _KEPT if p[0] is spark]:
        _KEPT.remove(pair)
        drop(*pair)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that kept() writes within it, in this thread, are removed at its end but for the frames put into its list."""
    outer, made, stay = getattr(_SCOPE, "made", None), [], []
    _SCOPE.made = made
    try:
        yield stay
    finally:
        _SCOPE.made = outer
    held = {df._tidemark_path for df in stay}
    for pair in made:
        if pair[1] not in held:
            _KEPT.remove(pair)
            drop(*pair)
        elif outer is not None:
            outer.append(pair)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _KEPT}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)
