"""A made-up but plausible weather series, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATION = "KNYC"
#: Fixed values of the weather model: mean and swing of the day in degrees, noise, humidity range, wind and rain ranges, share of clouds.
MEAN_C, SWING_C, NOISE_C = 18.0, 6.0, 0.8
HUMIDITY, WIND, RAIN, CLOUDS = (40.0, 95.0), (3.0, 8.0), (0.5, 4.0), 0.35
#: Rain falls in blocks of so many hours, in this share of the blocks.
RAIN_HOURS, RAIN_SHARE = 3, 0.15


def synthetic_weather(spark: SparkSession, start: str, hours: int, seed: int = 42, station: str = STATION) -> DataFrame:
    """A row for each hour from start (ISO, an instant): temperatures follow a sine that peaks at 13 UTC.

    Noise is hashed from seed and hour (the first 28 bits of an MD5), so that the result does not depend on partitions and
    any SQL can repeat it.
    """

    def noise(salt: int, low: float, high: float, per: Column | None = None) -> Column:
        text = F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("id") if per is None else per))
        return F.conv(F.substring(text, 1, 7), 16, 10).cast("long") / float(1 << 28) * (high - low) + low

    first = F.to_timestamp(F.lit(start))
    hour = F.pmod(F.floor(F.unix_seconds("observation_time") / 3600), F.lit(24))
    warm = MEAN_C + SWING_C * F.sin(2 * F.pi() * (hour - 7) / 24) + noise(1, -NOISE_C, NOISE_C)
    humid = F.least(F.greatest(100 - 1.5 * F.col("_t") + noise(2, -5.0, 5.0), F.lit(HUMIDITY[0])), F.lit(HUMIDITY[1]))
    wet = noise(3, 0.0, 1.0, F.floor(F.col("id") / RAIN_HOURS)) < RAIN_SHARE
    rows = spark.range(hours).withColumn("observation_time", F.timestamp_seconds(F.unix_seconds(first) + F.col("id") * 3600))
    return rows.withColumn("_t", warm).withColumn("_wet", wet).select(
        "observation_time",
        F.lit(station).alias("station_id"),
        F.round("_t", 2).alias("temperature_c"),
        F.when(F.col("_wet"), F.round(noise(4, *RAIN), 2)).alias("precipitation_mm"),
        F.round(noise(5, *WIND), 2).alias("wind_speed_ms"),
        F.round(humid, 1).alias("humidity_pct"),
        F.when(F.col("_wet"), "Rain").when(noise(6, 0.0, 1.0) < CLOUDS, "Clouds").otherwise("Clear").alias("weather_condition"),
    )
