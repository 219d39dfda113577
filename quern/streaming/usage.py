"""Streams over usage events. Event-time windows and watermarks are extras of this engine."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import next_state

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STATE = "calls long, successes long, streak long, utility double"
#: The user of the event that closes a stream.
CLOSING = -(2**62)


def event_stream(spark: SparkSession, pattern: str, per_trigger: int = 8, closing: str | None = None) -> DataFrame:
    """The event files that a path pattern names, as a stream with a zoned event time. (The file source takes a plain path
    for a folder, so a single file is named by a pattern.) closing: a folder for the event that closes the stream's windows."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(pattern)
    if closing:
        rows = rows.union(spark.readStream.schema(EVENTS).parquet(closing))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def usage_states(events: DataFrame) -> DataFrame:
    """(key, calls, successes, streak, utility) after each trigger: the fold of lifecycle.usage_state, one event at a time.

    A key's events are ordered by (ts, event_id) inside a trigger; across triggers in order of arrival."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Usage(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("usage", STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            s = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, 0.5)
            batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            for ok in batch["event_type"].ne("error"):
                s = next_state(s, ok)
            self.state.update((int(s[0]), int(s[1]), int(s[2]), float(s[3])))
            yield pd.DataFrame([(key[0], *s)], columns=["key", "calls", "successes", "streak", "utility"])

        def close(self) -> None:
            pass

    return events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Usage(), outputStructType=f"key long, {STATE}", outputMode="Update", timeMode="None")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("user_id").alias("_least"))
    return out.filter(F.col("_least") > CLOSING).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by inactivity gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    # by an aggregate, as a filter of the key would be pushed below the watermark
    out = w.agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("_least")).filter(F.col("_least") > CLOSING)
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def with_state_store(spark: SparkSession) -> None:
    """The state store that arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Process what is available through Parquet files in the shared folder of the session and return the rows; the
    stream's own checkpoint lies beside them, so a run that lost its driver resumes."""
    spark = stream.sparkSession
    at = at or run_folder(spark)
    if mode == "update":  # the file sink appends only: keep each batch with its number

        def keep(df: DataFrame, number: int) -> None:
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/number={number}")

        q = stream.writeStream.outputMode(mode).foreachBatch(keep)
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows")
    q.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{at}/rows").parquet(f"{at}/rows").drop("number")


def run_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared one."""
    from ..operators.lineage import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(spark: SparkSession, pattern: str, windows: Callable[[DataFrame], DataFrame], last: datetime.datetime | None = None) -> DataFrame:
    """The rows of windowed aggregations over everything that the pattern names, the windows that are open at the end too.

    The stream runs until nothing is left; then an event of the user CLOSING at ``last`` (a time behind all others) moves the watermark past the open windows,
    and the same stream goes on from its checkpoint to emit them."""
    at = run_folder(spark)
    spark.createDataFrame([], EVENTS).write.parquet(f"{at}/closing")
    run = lambda: run_once(windows(event_stream(spark, pattern, closing=f"{at}/closing")), "append", at)
    run()
    end = last or datetime.datetime(9000, 1, 1)
    spark.createDataFrame([(0, end, CLOSING, "closing", 0.0, None)], EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/closing")
    return run()
