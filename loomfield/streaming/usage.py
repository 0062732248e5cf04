"""Structured Streaming: token usage, last-wins merges and an append-aware transcript source."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from loomfield.operators import state


def hourly(events: DataFrame, at: str = "ts", by: tuple[str, ...] = ("event_type",), value: str = "value", late: str = "1 hour") -> DataFrame:
    """Tumbling hourly counts and sums; rows later than `late` behind the newest are dropped."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), *by)
    return windows.agg(F.count("*").alias("calls"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), *by, "calls", "total")


def merge_last(batch: DataFrame, keys: list[str], order: str, path: str) -> None:
    """Merges a micro-batch into a Parquet table of the last row of each key, whatever order rows come in.

    The table is written beside the old version and a pointer file names the newest, so a batch that is
    tried again gives the same rows.
    """
    spark = batch.sparkSession
    old = current(spark, path)
    rows = batch if old is None else old.unionByName(batch)
    version = _version(spark, path) + 1
    state.latest(rows, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{path}/newest-{version}")


def _version(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max([int(n.removeprefix("newest-")) for n in names if n.startswith("newest-")], default=0)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    version = _version(spark, path)
    return spark.read.parquet(f"{path}/v{version}") if version else None


def run_last_wins(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """A query that keeps the last row of each key, available at once with `current`."""
    merge = lambda batch, _: merge_last(batch, keys, order, path)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_only(batch: DataFrame, old: DataFrame, key: str, view: DataFrame) -> DataFrame:
    """The rows of a recomputed view whose hash differs from the stored one: what a refresh has to write."""
    keep = state.changed(old, view, key).where("action <> 'gone'")
    return view.join(keep, key, "left_semi")


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    """Whole lines appended to files of a folder. A file's last line waits until it ends; a shorter file is read anew."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def _sizes(self) -> dict[str, int]:
        found = {}
        for base, _, names in os.walk(self.folder):
            for name in sorted(names):
                if name.endswith(self.suffix):
                    path = os.path.join(base, name)
                    with open(path, "rb") as file:
                        found[path] = self._whole(file, os.path.getsize(path))
        return found

    @staticmethod
    def _whole(file, size: int, step: int = 1 << 16) -> int:
        """Bytes up to and with the last line end."""
        end = size
        while end > 0:
            start = max(0, end - step)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
        return 0

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        spans = []
        for path, size in sorted(new.items()):
            begin = old.get(path, 0)
            begin = 0 if size < begin else begin
            if size > begin:
                spans.append(_Span(path, begin, size))
        return spans or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple[str, int, str]]:
        if not partition.path:
            return
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = file.readline()
                yield partition.path, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)


class TailSource(DataSource):
    """Format `loomfield_tail`: (file, offset, value) of lines as files grow. Option `path`, and `suffix` (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "loomfield_tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))
