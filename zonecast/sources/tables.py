"""Keyed tables on plain parquet: last write wins, and writing a batch twice changes nothing."""

from __future__ import annotations

import time as clock
import uuid
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast import schemas
from zonecast.operators import flows


class KeyedTable(NamedTuple):
    name: str
    keys: tuple[str, ...]
    #: The time that rows are laid out by, in folders of a day; a table without one is a single folder.
    time: str | None
    schema: T.StructType


TABLES = {
    t.name: t
    for t in (
        KeyedTable("trip_events", ("pickup_datetime", "pu_zone_id", "do_zone_id", "dropoff_datetime"), "pickup_datetime", schemas.TRIP_EVENT),
        KeyedTable("hourly_demand", ("time_bucket", "zone_id"), "time_bucket", schemas.DEMAND),
        KeyedTable("hotspot_alerts", ("detected_at", "zone_id"), "detected_at", schemas.ALERT),
        KeyedTable("network_flows", ("time_window", "origin_zone_id", "dest_zone_id"), "time_window", schemas.FLOW_DEGREES),
        KeyedTable("taxi_zones", ("zone_id",), None, schemas.ZONE),
    )
}
PART = "day"


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each key: that of the greatest order; rows without a key are left out."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.na.drop(subset=list(keys)).dropDuplicates(list(keys))
    newest = rows.na.drop(subset=list(keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, "_r.*").select(*rows.columns)


def merge(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Old rows with those of new keys replaced, and new rows added. In a batch, of several rows with one key the greatest stays."""
    rest = [c for c in new.columns if c not in keys]
    both = old.select(*new.columns, F.lit(0).alias("_age")).union(new.withColumn("_age", F.lit(1)))
    return last_wins(both, keys, ("_age", *rest)).select(*new.columns)


def append_missing(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of new whose keys old does not have, once each."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti")


def add_degrees(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The flows of every window that a batch touches, with degrees over the whole window and not over the batch."""
    plain = schemas.FLOW.names
    windows = batch.select("time_window").distinct()
    touched = stored.select(*plain).join(windows, "time_window", "left_semi")
    return flows.with_degrees(merge(touched, batch.select(*plain), TABLES["network_flows"].keys))


class Pointer(NamedTuple):
    #: The last batch of each query that wrote to the table.
    done: dict[str, int]
    #: The folder of each day.
    parts: dict[str, str]


class TableStore:
    """Keyed tables in a folder: a version per write, and a pointer that moves when the version is complete.

    A write rewrites the day folders that the batch touches and takes over the others by name. Readers see the old version or
    the new one. The pointer keeps the last batch number of each query, so a batch that comes again is skipped, and one of
    another query, or of the same job under a new checkpoint, is not. One writer at a time per table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, table: KeyedTable) -> Pointer:
        at = self._path(f"{self.root}/{table.name}/current.txt")
        if not self._fs.exists(at):
            return Pointer({}, {})
        rows = [r.value.split("\t") for r in self.spark.read.text(at.toString()).collect()]
        return Pointer({q: int(n) for kind, q, n in rows if kind == "query"}, {d: p for kind, d, p in rows if kind == PART})

    def read(self, name: str) -> DataFrame:
        table = TABLES[name]
        parts = self._pointer(table).parts
        if not parts:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*parts.values())

    def write(self, name: str, batch: DataFrame, batch_id: int, query: str = "") -> bool:
        """Merge a batch of a query; False if it was merged before or has no rows."""
        table = TABLES[name]
        done, parts = self._pointer(table)
        if batch_id <= done.get(query, -1):
            return False
        batch = batch.persist()
        try:
            day = F.date_format(table.time, "yyyy-MM-dd") if table.time else F.lit("all")
            # The days of a batch: few, as a batch covers a short time.
            days = [r[0] for r in batch.na.drop(subset=list(table.keys)).select(day).distinct().collect()]
            if not days:
                return False
            touched = [parts[d] for d in days if d in parts]
            old = self.spark.read.schema(table.schema).parquet(*touched) if touched else self.spark.createDataFrame([], table.schema)
            if name == "network_flows":
                merged = merge(old, add_degrees(old, batch).select(*table.schema.names), table.keys)
            else:
                merged = merge(old, batch.select(*table.schema.names), table.keys)
            version = f"{self.root}/{table.name}/v{batch_id}-{uuid.uuid4().hex[:8]}"
            merged.withColumn(PART, day).repartition(PART).sortWithinPartitions(*table.keys).write.partitionBy(PART).parquet(version)
            self._point(table, Pointer(done | {query: batch_id}, parts | {d: f"{version}/{PART}={d}" for d in days}))
            return True
        finally:
            batch.unpersist()

    def _point(self, table: KeyedTable, pointer: Pointer) -> None:
        lines = [f"query\t{q}\t{n}" for q, n in sorted(pointer.done.items())] + [f"{PART}\t{d}\t{p}" for d, p in sorted(pointer.parts.items())]
        new, current = (self._path(f"{self.root}/{table.name}/{n}") for n in (f"next-{uuid.uuid4().hex[:8]}.txt", "current.txt"))
        out = self._fs.create(new)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = options.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(options.Options.Rename, 1)
        overwrite[0] = options.Options.Rename.OVERWRITE
        context.rename(new, current, overwrite)

    def vacuum(self, name: str, keep_hours: float = 24.0) -> int:
        """Delete the day folders that the table no longer refers to and that are older than the longest read or write; the number that went."""
        table = TABLES[name]
        kept = {self._path(p).toUri().getPath() for p in self._pointer(table).parts.values()}
        oldest, gone = (clock.time() - 3600 * keep_hours) * 1000, 0
        root = self._path(f"{self.root}/{table.name}")
        if not self._fs.exists(root):
            return 0
        for version in self._fs.listStatus(root):
            if not version.isDirectory():
                continue
            inside = self._fs.listStatus(version.getPath())
            days = [f for f in inside if f.isDirectory() and f.getPath().getName().startswith(f"{PART}=")]
            stale = [f for f in days if f.getPath().toUri().getPath() not in kept and f.getModificationTime() <= oldest]
            for folder in stale:
                self._fs.delete(folder.getPath(), True)
            gone += len(stale)
            if len(stale) == len(days) and version.getModificationTime() <= oldest:
                self._fs.delete(version.getPath(), True)
        return gone


def write_single(df: DataFrame, path: str, kind: str = "csv", order: tuple[str, ...] = ()) -> str:
    """A small table as one file, CSV with a header or JSON lines, in the given order; the finished file is moved to its name."""
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex[:8]}"
    one = df.coalesce(1)
    one = one.sortWithinPartitions(*order) if order else one
    options = {"header": "true"} if kind == "csv" else {"ignoreNullFields": "false"}
    one.write.format(kind).options(**options).save(folder)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
    return path


def write_single_csv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> str:
    return write_single(df, path, "csv", order)


def write_report(report: DataFrame, file: str, folder: str) -> str:
    """A validation report as one JSON file, named by the checked file and the time of the check."""
    stem = file.rsplit("/", 1)[-1].removesuffix(".parquet")
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    return write_single(report.withColumn("file", F.lit(file)), f"{folder.rstrip('/')}/{stem}__{stamp}.json", "json")


def gaps(rows: DataFrame, time: str, tie: str, speed: float = 1.0, by: tuple[str, ...] = (), slice: str = "hour") -> DataFrame:
    """Rows with gap_seconds: the time since the row before, shortened by the speed; the first has 0, and so have rows without a time.

    Without keys the order is over the whole table: each slice of time (an hour, or what date_trunc knows) is ordered by itself,
    and takes its first gap from the greatest time of the slices before it, of which there is one row each.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    if by:
        before = F.lag(seconds).over(Window.partitionBy(*by).orderBy(time, tie))
        return rows.withColumn("gap_seconds", F.coalesce((seconds - before) / speed, F.lit(0.0)))
    dealt = rows.withColumn("_p", F.date_trunc(slice, time)).withColumn("_s", seconds)
    ends = dealt.where("_p is not null").groupBy("_p").agg(F.max("_s").alias("_end"))
    prior = ends.select(F.col("_p").alias("_q"), F.lag("_end").over(Window.orderBy("_p")).alias("_prior"))
    before = F.coalesce(F.lag("_s").over(Window.partitionBy("_p").orderBy(time, tie)), F.col("_prior"))
    joined = dealt.join(prior, F.col("_p") == F.col("_q"), "left")
    return joined.withColumn("gap_seconds", F.coalesce((F.col("_s") - before) / speed, F.lit(0.0))).drop("_p", "_q", "_s", "_prior")


def anchored(rows: DataFrame, times: tuple[str, ...], anchor: str = "original") -> DataFrame:
    """Rows with their times moved so that the first of the first column is now (``now``), or left as they are (``original``)."""
    if anchor == "original":
        return rows
    if anchor != "now":
        raise ValueError(f"unknown anchor: {anchor}")
    first = rows.agg(F.min(times[0])).first()[0]
    if first is None:
        return rows
    shift = F.current_timestamp().cast("timestamp") - F.lit(first).cast("timestamp")
    return rows.withColumns({t: F.col(t) + shift for t in times})
