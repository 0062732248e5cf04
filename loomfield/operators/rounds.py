"""Tables between the rounds of an iteration."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder that `spark.checkpoint.dir` names; a temporary folder where there is none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="loomfield-")
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/round-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again.

    Unlike a checkpoint this also forgets what the optimizer inferred about the columns, which grows from round to round, and
    it tells the planner the size, so small tables are broadcast and large ones aren't. It survives lost executors.
    """
    spark, path = df.sparkSession, _folder(df.sparkSession)
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the JVM may be gone at exit; the cluster's own cleaning applies then
            return
