"""Replay of recorded rows as a live stream: the gaps between events, shortened, decide when each message is sent."""

from __future__ import annotations

import os
import time as clock
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import codec
from zonecast.session import remove, scratch_folder
from zonecast.sources.tables import anchored


def schedule(rows: DataFrame, time: str, speed: float = 100.0) -> DataFrame:
    """Rows with due_seconds: how long after the first event of the pass they are sent. The shortened gaps add up to just that; no row looks at another."""
    own = F.unix_micros(F.col(time).cast("timestamp"))
    first = rows.agg(F.min(own)).first()[0]
    return rows.withColumn("due_seconds", (own - F.lit(first)) / 1e6 / speed)


def first_events(rows: DataFrame, count: int, time: str) -> DataFrame:
    """The first so many rows in the order of time, equal times by the rest of the row."""
    return rows.orderBy(time, *(c for c in rows.columns if c != time)).limit(count)


def iso(stamp: Column) -> Column:
    """ISO text with the offset of UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def trip_messages(trips: DataFrame) -> DataFrame:
    """Raw trips as the messages that enrichment reads; the due time stays beside them."""
    told = trips.withColumns({c: iso(F.col(c)) for c in ("pickup_datetime", "dropoff_datetime")})
    return _messages(told, "PULocationID", schemas.RAW_TRIP.names)


def weather_messages(weather: DataFrame) -> DataFrame:
    return _messages(weather.withColumn("observation_time", iso(F.col("observation_time"))), "station_id", schemas.WEATHER.names)


def _messages(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    value = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return rows.select(F.col(key).cast("string").alias("key"), value.alias("value"), "due_seconds")


def topic_writer(kind: str, target: str) -> Callable[[DataFrame], None]:
    """Appends messages to a topic: ``kafka``, or ``files`` for a folder of JSON lines."""

    def write(messages: DataFrame) -> None:
        if kind == "kafka":
            messages.write.format("kafka").option("kafka.bootstrap.servers", os.environ["KAFKA_BROKERS"]).option("topic", target).save()
        else:
            messages.write.mode("append").json(target)

    if kind not in ("kafka", "files"):
        raise ValueError(f"unknown kind of topic: {kind}")
    return write


def replay(
    rows: DataFrame,
    time: str,
    times: tuple[str, ...],
    messages: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame], None],
    speed: float = 100.0,
    anchor: str = "original",
    loop: bool = False,
    max_events: int | None = None,
    every: float = 1.0,
    stop: Callable[[], bool] = lambda: False,
    wait: Callable[[float], None] = clock.sleep,
    now: Callable[[], float] = clock.monotonic,
) -> int:
    """Send the rows in the order of their time, and return how many were sent.

    Each pass is written once to the shared folder, in slices of ``every`` seconds of the shortened time, and a slice is sent when
    it is due; so a lost executor costs a slice, and the driver holds no rows. With ``loop`` the rows are sent again and again;
    ``max_events`` is the number over all passes. ``stop`` is asked before every slice: what is under way is finished first. A slice whose time has passed
    is sent at once. ``wait`` and ``now`` are the clock.
    """
    spark, sent = rows.sparkSession, 0
    while not stop() and (max_events is None or sent < max_events):
        known = rows.where(F.col(time).isNotNull())
        if max_events is not None:
            known = first_events(known, max_events - sent, time)
        due = schedule(known, time, speed)
        staged = messages(anchored(due, times, anchor)).withColumn("slice", F.floor(F.col("due_seconds") / every).cast("long"))
        folder = scratch_folder(spark, "replay")
        staged.repartition("slice").sortWithinPartitions("slice", "due_seconds").write.partitionBy("slice").parquet(folder)
        again = spark.read.schema(staged.schema).parquet(folder)
        # A row for each slice that is not empty.
        counts = again.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
        began, before = now(), sent
        for own in counts:
            if stop():
                break
            late = own["slice"] * every - (now() - began)
            if late > 0:
                wait(late)
            write(again.where(F.col("slice") == own["slice"]).sortWithinPartitions("due_seconds").select("key", "value"))
            sent += own["n"]
        remove(spark, folder)
        if not loop or sent == before:
            break
    return sent


def replay_trips(trips: DataFrame, write: Callable[[DataFrame], None], **options) -> int:
    return replay(trips, "pickup_datetime", ("pickup_datetime", "dropoff_datetime"), trip_messages, write, **options)


def replay_weather(weather: DataFrame, write: Callable[[DataFrame], None], **options) -> int:
    return replay(weather, "observation_time", ("observation_time",), weather_messages, write, **options)
