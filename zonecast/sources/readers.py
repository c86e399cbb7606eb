"""Sources: one factory for streams, whatever carries them, and readers with declared schemas for tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast import schemas
from zonecast.functions import codec, measures, temporal
from zonecast.operators import checks

MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "value")])


def starting_offsets(default: str, *variables: str) -> str:
    """The first of the environment's settings that is there: one for a topic, then one for all."""
    return next((v for n in variables if (v := os.environ.get(n))), default)


#: Where a job's stream begins if nothing says otherwise. Fixed values.
OFFSETS = {"weather-events": "earliest"}


def offsets_of(job: str, topic: str) -> str:
    """<JOB>_STARTING_OFFSETS_<TOPIC>, else <JOB>_STARTING_OFFSETS, else the topic's default."""
    prefix = f"{job.upper()}_STARTING_OFFSETS"
    return starting_offsets(OFFSETS.get(topic, "latest"), f"{prefix}_{topic.replace('-', '_').upper()}", prefix)


def kafka_options(topic: str, offsets: str = "latest", per_trigger: int | None = None) -> dict[str, str]:
    found = {"kafka.bootstrap.servers": os.environ["KAFKA_BROKERS"], "subscribe": topic, "startingOffsets": offsets, "failOnDataLoss": "false"}
    return found | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger is not None else {})


def jdbc_options(url: str, **options: str) -> dict[str, str]:
    """The zone dimension's five columns as a subquery, so that the database sends no others; user and password from the environment."""
    stated = {"user": os.environ.get("PG_USER"), "password": os.environ.get("PG_PASSWORD"), "driver": "org.postgresql.Driver"}
    wanted = f"(select {', '.join(schemas.ZONE.names)} from taxi_zones) as z"
    return {"url": url, "dbtable": wanted} | {k: v for k, v in stated.items() if v} | options


def stream_messages(spark: SparkSession, kind: str, location: str, offsets: str = "latest", per_trigger: int | None = None, **options: str) -> DataFrame:
    """Messages (key, value, and what else the carrier gives) as a stream.

    kind ``kafka``: location is the topic, the brokers are in KAFKA_BROKERS, lost offsets do not fail the query; needs the
    connector. kind ``files``: location is a folder of JSON lines {"key", "value"}, read as they appear.
    """
    reader = spark.readStream
    if kind == "kafka":
        return reader.format("kafka").options(**kafka_options(location, offsets, per_trigger), **options).load()
    if kind == "files":
        reader = reader.schema(MESSAGE).options(**options)
        if per_trigger is not None:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        return reader.json(location)
    raise ValueError(f"unknown kind of stream: {kind}")


def describe_messages(messages: DataFrame, text: str = "hello from") -> DataFrame:
    """What a smoke job prints of each message: a constant, and the partition, offset and time that the carrier gives."""
    known = [c for c in ("partition", "offset", "timestamp") if c in messages.columns]
    return messages.select(F.lit(text).alias("msg"), *known)


def stream_trips(messages: DataFrame) -> DataFrame:
    return codec.from_messages(messages, schemas.RAW_TRIP)


def stream_enriched_trips(messages: DataFrame, with_weather: bool = False) -> DataFrame:
    return codec.from_messages(messages, schemas.ENRICHED_TRIP_WEATHER if with_weather else schemas.ENRICHED_TRIP)


def stream_weather(messages: DataFrame) -> DataFrame:
    return codec.from_messages(messages, schemas.WEATHER)


def read_trips(spark: SparkSession, path: str, *columns: str, ordered: bool = False) -> DataFrame:
    """Monthly trip files, older column names resolved, rows without pickup time left out; ValueError if required columns are missing.

    With columns named, only those are read and all rows stay. A replay wants them ordered.
    """
    found = spark.read.parquet(path)
    if columns:
        names = checks.resolve_columns(found, {c: checks.ALIASES.get(c, ()) for c in columns})
        return found.select(*(F.col(own).alias(name) for name, own in names.items()))
    if absent := checks.missing_columns(found):
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    names = checks.resolve_columns(found, {c: checks.ALIASES.get(c, ()) for c in schemas.RAW_TRIP.names})
    rows = found.select(*(F.col(own).alias(name) for name, own in names.items())).where("pickup_datetime is not null")
    return in_event_order(rows, "pickup_datetime") if ordered else rows


def in_event_order(rows: DataFrame, time: str) -> DataFrame:
    """Rows by time; equal times by the rest of the row, so that the order does not depend on files."""
    return rows.orderBy(time, *(c for c in rows.columns if c != time))


def read_weather(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Weather CSV, columns in any order; times are UTC where they state no offset; rows without a readable time are left out, NaN is null.

    ValueError if columns are missing.
    """
    raw = spark.read.option("header", True).csv(path)
    if absent := [c for c in schemas.WEATHER.names if c not in raw.columns]:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    stated = F.col("observation_time").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    time = temporal.parse_instant(F.when(stated, F.col("observation_time")).otherwise(F.concat("observation_time", F.lit("+00:00"))))
    numbers = {f.name: measures.missing_if_nan(F.col(f.name).try_cast(f.dataType)) for f in schemas.WEATHER.fields if f.dataType == T.DoubleType()}
    rows = raw.withColumns({"observation_time": time, **numbers}).where("observation_time is not null").select(*schemas.WEATHER.names)
    return in_event_order(rows, "observation_time") if ordered else rows


def read_baseline(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """The lookup that build_baseline wrote; a streaming job keeps it, read once and not for every batch."""
    found = spark.read.schema(schemas.BASELINE).option("header", True).csv(path)
    if keep:
        found = found.cache()
        found.count()
    return found


def read_zones(spark: SparkSession, kind: str, location: str, **options: str) -> DataFrame:
    """The zone dimension from ``parquet``, ``csv`` or ``jdbc`` (location is the URL; only the five columns are asked for)."""
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(location, **options)).load()
    if kind == "csv":
        return spark.read.schema(schemas.ZONE).option("header", True).options(**options).csv(location)
    if kind == "parquet":
        return spark.read.options(**options).parquet(location).select(*schemas.ZONE.names)
    raise ValueError(f"unknown kind of zone table: {kind}")


def newest_file(spark: SparkSession, path: str) -> str | None:
    """The file that was changed last."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
