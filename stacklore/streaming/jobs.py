"""Structured Streaming jobs over append-only event files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stacklore.sources.shared import shared_dir

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def change_feed(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """Event files as a stream with event time; offsets take the place of cutoffs."""
    raw = spark.readStream.schema(EVENTS).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def follow(table: DataFrame) -> DataFrame:
    """A table of Parquet files, as a stream of its files."""
    folder = table.inputFiles()[0].rpartition("/")[0]
    return table.sparkSession.readStream.schema(table.schema).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet in the shared folder, and read that."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there, each micro-batch through ``apply``."""
    root = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", root).trigger(availableNow=True).start()
    q.awaitTermination()


def sessions(feed: DataFrame, idle: str = "2 hours") -> DataFrame:
    """Sessions that end after ``idle`` without an event."""
    w = F.session_window("ts", idle)
    return feed.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rolling_metrics(feed: DataFrame, width: str = "10 minutes", step: str = "10 minutes", slow: float = 200.0) -> DataFrame:
    w = F.window("ts", width, step)
    out = feed.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"), F.sum((F.col("value") > slow).cast("int")).alias("slow"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors", "slow")


#: Chunks that a session remembers as shown and as disliked.
SHOWN, DISLIKED = 50, 20
STATE = "recent array<bigint>, disliked array<bigint>, n bigint, centroid array<double>, anchor bigint"


def session_state(feed: DataFrame, vector: list[str], shown: int = SHOWN, disliked: int = DISLIKED) -> DataFrame:
    """Per user what its session keeps over micro-batches, one row for each user and batch: the last chunks shown and those
    disliked (events ``error``), first in and first out, how many events there were, the running mean of the columns
    ``vector``, and as anchor the last chunk that was opened (``click``; -1 for none)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, bad, n, mean, anchor = ([], [], 0, [0.0] * len(vector), -1) if not state.exists else state.get
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        known = rows[rows["k"].notna()]
        recent = [*recent, *(int(k) for k in known["k"])][-shown:]
        bad = [*bad, *(int(k) for k in known[known["event_type"] == "error"]["k"])][-disliked:]
        opened = known[known["event_type"] == "click"]["k"]
        anchor = int(opened.iloc[-1]) if len(opened) else anchor
        for v in rows[vector].itertuples(index=False):
            n += 1
            mean = [m + (x - m) / n for m, x in zip(mean, v)]
        state.update((recent, bad, n, mean, anchor))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 7_200_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [mean], "recent": [recent], "disliked": [bad], "anchor": [anchor]})

    schema = "user_id long, n long, mean array<double>, recent array<long>, disliked array<long>, anchor long"
    return feed.groupBy("user_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_ready(status: DataFrame) -> DataFrame:
    """The first time at which each state of a job is seen."""
    return status.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"))
