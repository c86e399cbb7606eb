"""Files and answers from outside, brought in once: month files, a weather service, zone outlines."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import codec
from zonecast.sources.tables import append_missing

CHUNK = 1 << 20


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a parquet file has a schema and rows."""
    try:
        return not spark.read.parquet(path).limit(1).isEmpty()
    except Exception:  # noqa: BLE001 - whatever is wrong with the file, it is fetched again
        return False


def fetch_file(spark: SparkSession, url: str, path: str, force: bool = False, check: Callable[[SparkSession, str], bool] = readable) -> bool:
    """Bring a file to a path of any file system, under the name ``.part`` until it is whole; False if there is none at the url.

    A file that is there and passes the check is left alone, so a second run fetches nothing.
    """
    make, fs = _hadoop(spark, path)
    if fs.exists(make(path)) and not force and check(spark, path):
        return True
    part = make(f"{path}.part")
    try:
        with urllib.request.urlopen(url) as answer:
            out = fs.create(part, True)
            try:
                while block := answer.read(CHUNK):
                    out.write(bytearray(block))
            finally:
                out.close()
    except urllib.error.URLError as error:
        if getattr(error, "code", 404) != 404:
            raise
        return False
    fs.delete(make(path), False)
    return bool(fs.rename(part, make(path)))


def fetch_months(spark: SparkSession, months: DataFrame, url_of: Callable[[str], str], path_of: Callable[[str], str], **options) -> dict[str, bool]:
    """The files of some months (column month, a date), a few dozen at most: whether each is there now."""
    names = [r[0] for r in months.select(F.date_format("month", "yyyy-MM")).distinct().orderBy(F.col("date_format(month, yyyy-MM)")).collect()]
    return {m: fetch_file(spark, url_of(m), path_of(m), **options) for m in names}


def fetch_weather(spark: SparkSession, url: str, station: str, stored: DataFrame | None = None) -> DataFrame:
    """A weather service's answer as a weather row, none if the stored rows have its hour and station already."""
    with urllib.request.urlopen(url) as answer:
        text = answer.read().decode()
    row = codec.flatten_weather(spark.createDataFrame([(text,)], "value string"), station)
    return row if stored is None else append_missing(stored.select(*schemas.WEATHER.names), row, ("observation_time", "station_id"))


def _ring_sums(ring: Column) -> Column:
    """(twice the area, and the moments) of a closed ring of [lon, lat] points, about its first point; the sign follows the direction."""
    first = ring[0]
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def add(acc: Column, pair: Column) -> Column:
        x1, y1, x2, y2 = (pair[n][k] - first[k] for n, k in (("p", 0), ("p", 1), ("q", 0), ("q", 1)))
        cross = x1 * y2 - x2 * y1
        return F.struct((acc.a + cross).alias("a"), (acc.x + (x1 + x2) * cross).alias("x"), (acc.y + (y1 + y2) * cross).alias("y"))

    return F.aggregate(pairs, F.struct(*(F.lit(0.0).alias(c) for c in "axy")), add)


def zone_centroids(features: DataFrame) -> DataFrame:
    """(zone_id, centroid_lat, centroid_lon) from outlines: zone_id, rings array<array<array<double>>> of [lon, lat] points, holes turning the other way.

    Centres of area over all of a zone's rings. Degrees are treated as a plane, which is exact up to a scale for each axis within a
    zone; zones without area have none.
    """
    ring = features.select("zone_id", F.explode("rings").alias("ring")).where(F.size("ring") > 3)
    sums = ring.select("zone_id", F.col("ring")[0][0].alias("lon"), F.col("ring")[0][1].alias("lat"), _ring_sums(F.col("ring")).alias("s"))
    whole = sums.groupBy("zone_id").agg(
        F.sum("s.a").alias("a"), F.sum(F.col("s.x") + 3 * F.col("lon") * F.col("s.a")).alias("x"), F.sum(F.col("s.y") + 3 * F.col("lat") * F.col("s.a")).alias("y")
    )
    return whole.where("a != 0").select("zone_id", (F.col("y") / (3 * F.col("a"))).alias("centroid_lat"), (F.col("x") / (3 * F.col("a"))).alias("centroid_lon"))


def read_outlines(spark: SparkSession, path: str, key: str = "LocationID") -> DataFrame:
    """(zone_id, rings) of a GeoJSON file of polygons and multipolygons; the file is one small document."""
    point = "array<array<array<double>>>"
    shape = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("c"))
    feature = text.select(F.explode("c.features").alias("f"))
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", point))).otherwise(
        F.from_json("f.geometry.coordinates", f"array<{point}>")
    )
    return feature.select(F.col("f.properties")[key].cast("int").alias("zone_id"), F.flatten(parts).alias("rings"))
