"""Collector records as an incremental stream: offsets are the last record number read of each channel.

Records lie in segments `channel=<name>/first=<n>/last=<m>` of parquet files, so a listing alone tells what is new. Offsets go to the
stream's checkpoint; a restart goes on behind them, and a segment that was read in part is read from the next number on.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.operators.drift import numbered_stream

SCHEMA = "channel string, record_no bigint, body string"


def write_segments(records: DataFrame, base: str, per_segment: int = 10_000) -> None:
    """Append records (channel, record_no, body) as segments. Numbers that were written before must not come again."""
    rows = records.select("channel", "record_no", "body").withColumn("first", F.floor((F.col("record_no") - 1) / per_segment) * per_segment + 1)
    ends = rows.groupBy("channel", "first").agg(F.min("record_no").alias("low"), F.max("record_no").alias("last"))
    named = rows.join(ends, ["channel", "first"]).drop("first").withColumnRenamed("low", "first")
    named.repartition("channel", "first").sortWithinPartitions("channel", "record_no").write.mode("append").partitionBy(
        "channel", "first", "last").parquet(base)


def numbered_records(events: DataFrame, channel: str, order: list[str], body: list[str]) -> DataFrame:
    """Records of each channel numbered from 1 in time order, the body as JSON."""
    rows = numbered_stream(events.withColumn("channel", F.col(channel)), "channel", order)
    return rows.select("channel", F.col("n").alias("record_no"), F.to_json(F.struct(*body)).alias("body"))


class Segment(InputPartition):
    def __init__(self, folder: str, channel: str, above: int, through: int):
        self.folder, self.channel, self.above, self.through = folder, channel, above, through


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RecordReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _segments(self) -> Iterator[tuple[str, str, int, int]]:
        from pyarrow import fs

        store, root = _store(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for folder in sorted({f.path.rsplit("/", 1)[0] for f in listed if f.is_file and f.path.endswith(".parquet") and "/_" not in f.path}):
            named = dict(p.split("=", 1) for p in folder.split("/")[-3:] if "=" in p)
            yield folder, unquote(named["channel"]), int(named["first"]), int(named["last"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for _, channel, _, high in self._segments():
            last[channel] = max(high, last.get(channel, 0))
        return last

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(folder, channel, start.get(channel, 0), end[channel]) for folder, channel, low, high in self._segments()
                if channel in end and high > start.get(channel, 0) and low <= end[channel]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        store, _ = _store(self.path)
        new = (pc.field("record_no") > partition.above) & (pc.field("record_no") <= partition.through)
        for batch in ds.dataset(partition.folder, filesystem=store, format="parquet").to_batches(filter=new, columns=["record_no", "body"]):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([partition.channel] * batch.num_rows), batch.column("record_no"), batch.column("body")],
                                                 ["channel", "record_no", "body"])

    def commit(self, end: dict) -> None:
        pass


class RecordSource(DataSource):
    """Format `collector_records`, option `path`."""

    @classmethod
    def name(cls) -> str:
        return "collector_records"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"])


def record_stream(spark: SparkSession, base: str) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.readStream.format("collector_records").option("path", base).load()


