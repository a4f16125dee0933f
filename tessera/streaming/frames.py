"""Frames over unbounded tables: projection, filters, renames, windowed aggregates and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F


class StreamingDataFrame:
    def __init__(self, sdf: SparkFrame):
        if not sdf.isStreaming:
            raise ValueError("not a stream")
        self.__dict__["_sdf"] = sdf

    @property
    def columns(self):
        return self._sdf.columns

    def __getitem__(self, key):
        if isinstance(key, list):
            return StreamingDataFrame(self._sdf.select(*key))
        if isinstance(key, Column):
            return StreamingDataFrame(self._sdf.where(key))
        return F.col(key)

    def __setitem__(self, key, value):
        self.__dict__["_sdf"] = self._sdf.withColumn(key, value if isinstance(value, Column) else F.lit(value))

    def rename(self, columns):
        return StreamingDataFrame(self._sdf.withColumnsRenamed(columns))

    def sql(self) -> str:
        return self._sdf._jdf.queryExecution().analyzed().toString()

    def windowed(self, on: str, size: str, slide: str | None = None, late: str = "0 seconds", by=(), **named) -> StreamingDataFrame:
        """Aggregates (name=column expression) in time windows; rows later than ``late`` are dropped."""
        at = F.window(on, size, slide) if slide else F.window(on, size)
        return StreamingDataFrame(self._timed(on).withWatermark(on, late).groupBy(at.alias("window"), *by).agg(*(e.alias(n) for n, e in named.items())))

    def sessions(self, on: str, gap: str, late: str = "0 seconds", by=(), **named) -> StreamingDataFrame:
        return StreamingDataFrame(self._timed(on).withWatermark(on, late).groupBy(F.session_window(on, gap).alias("session"), *by).agg(*(e.alias(n) for n, e in named.items())))

    def distinct(self, on: str, late: str, *keys: str) -> StreamingDataFrame:
        """First row for each key within the watermark."""
        return StreamingDataFrame(self._timed(on).withWatermark(on, late).dropDuplicatesWithinWatermark([*keys]))

    def _timed(self, on: str) -> SparkFrame:
        """Watermarks need instants: a local time counts in the session's zone."""
        return self._sdf.withColumn(on, F.col(on).cast("timestamp"))

    def _writer(self, checkpoint: str | None, mode: str, trigger):
        out = self._sdf.writeStream.outputMode(mode)
        if checkpoint:
            out = out.option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True}))

    def to_table(self, path: str, checkpoint: str, mode="append", format="parquet", trigger=None):
        return self._writer(checkpoint, mode, trigger).format(format).option("path", path).start()

    def to_topic(self, servers: str, topic: str, checkpoint: str, trigger=None):
        """Rows as JSON to a message topic."""
        out = StreamingDataFrame(self._sdf.select(F.to_json(F.struct("*")).alias("value")))
        return out._writer(checkpoint, "append", trigger).format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()

    def to_key_value(self, put: Callable[[SparkFrame, int], None], checkpoint: str, trigger=None):
        """Micro-batches to a writer of a key-value store; ``put`` must take a repeated batch id."""
        return self._writer(checkpoint, "append", trigger).foreachBatch(put).start()

    def to_memory(self, name: str, mode="append", trigger=None):
        return self._writer(None, mode, trigger).format("memory").queryName(name).start()
