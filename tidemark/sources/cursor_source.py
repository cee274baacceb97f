"""A Structured Streaming source for data that is fetched by position: one bounded batch for each read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class CursorDataSource(DataSource):
    """spark.readStream.format("cursor"): rows of a Parquet file or folder, the next `batch` after the last position.

    Options: path, cursor (a column of integers), columns DDL in schema(), batch (1000), first (position before the first
    row, -1). Rows that share a cursor value are never parted, so a batch may pass its size by the ties of its last value;
    null cursors are not read. The reader runs on the driver, which holds a batch's rows and, to find where it ends, as
    many cursor values; for bulk data read the folder with the file source instead.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return self.options["columns"]

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(schema, self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, schema, options):
        self.names, self.path, self.cursor = schema.names, options["path"], options["cursor"]
        self.batch, self.first = int(options.get("batch", 1000)), int(options.get("first", -1))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": self.first}

    def _end(self, low: int) -> int:
        """The cursor of the last of the next `batch` rows."""
        import pyarrow.dataset as ds

        least = np.empty(0, "i8")
        for part in ds.dataset(self.path).scanner(columns=[self.cursor], filter=ds.field(self.cursor) > low).to_batches():
            least = np.concatenate([least, np.asarray(part.column(0), "i8")])
            if len(least) > self.batch:
                least = np.partition(least, self.batch - 1)[: self.batch]
        return int(least.max()) if len(least) else low

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        import pyarrow.dataset as ds

        at, columns = ds.field(self.cursor), list(dict.fromkeys([*self.names, self.cursor]))
        table = ds.dataset(self.path).to_table(columns=columns, filter=(at > start["position"]) & (at <= end["position"])).sort_by(self.cursor)
        return zip(*(table[n].to_pylist() for n in self.names))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"position": self._end(start["position"])}
        return self.readBetweenOffsets(start, end), end

    def commit(self, end: dict) -> None:
        pass
