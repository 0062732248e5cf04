"""Streaming queries, run to completion over the supplied files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.plans.registry import query
from loomfield.session import table
from loomfield.streaming import timers, usage


def _stream(spark, sf, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _folder(spark) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='loomfield-')}/stream-{uuid.uuid4().hex}"


@query("t11_hourly_stream", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly(spark, sf):
    folder = _folder(spark)
    out = usage.hourly(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), late="60 days")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")  # noqa: E731  complete mode: each batch holds all rows
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumns({"hour": F.col("hour").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("t13_last_wins_stream", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, sf):
    folder = _folder(spark)
    stream = _stream(spark, sf, "events").select("user_id", "event_id", "event_type")
    usage.run_last_wins(stream, ["user_id"], "event_id", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return usage.current(spark, f"{folder}/out")


@query("t05_refreshes")
def refreshes(spark, sf):
    """Users' events as changes of their transcripts: read an hour after the last, six after the first, and a day apart at least."""
    folder, hour = _folder(spark), 3_600_000
    out = timers.refreshes(_stream(spark, sf, "events"), "user_id", "ts", hour, 6 * hour, 24 * hour)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(timers.REFRESH).parquet(f"{folder}/out")
