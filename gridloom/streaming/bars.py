"""Bars from a stream of events: tumbling windows with a watermark, the panel rows of each closed step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def step_bars(events: DataFrame, at: str, code: str, value: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, code, x, y): sum and count of each code in each window. Works on streams and on tables alike.

    On a stream a window is given out once, after the watermark has passed its end; state older than that is dropped.
    """
    window = F.window(F.col(at), width)
    df = events.withWatermark(at, late) if events.isStreaming else events
    out = df.groupBy(window.alias("w"), F.col(code).alias("code")).agg(F.sum(value).alias("x"), F.count("*").alias("y"))
    return out.select(F.col("w.start").alias("start"), "code", "x", "y")


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    known = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{known.rstrip('/')}/bars-{uuid.uuid4().hex}"


def stream_to_bars(stream: DataFrame, events: DataFrame, at: str, code: str, value: str, width: str = "6 hours", late: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Run ``stream`` over all that is there, append its closed windows to a Parquet sink, and add the windows still open.

    The state holds open windows only and nothing is kept in the driver. ``events`` is the same source as a table; of it, only what lies
    after the last closed window is read for the open ones.
    """
    spark = stream.sparkSession
    folder = folder or _folder(spark)
    bars = step_bars(stream, at, code, value, width, late)
    sink = bars.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/closed").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(bars.schema).parquet(f"{folder}/closed")
    last = closed.agg(F.max("start").alias("last")).first().last
    rest = events if last is None else events.filter(F.col(at) >= F.lit(last) + F.expr(f"INTERVAL {width}"))
    return closed.unionByName(step_bars(rest, at, code, value, width, late))
