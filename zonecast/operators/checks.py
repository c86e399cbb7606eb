"""Checks of a month of trips, and of references to zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import temporal

LEAST_ROWS, MOST_NULLS, ZONE_IDS = 5_000_000, 0.05, (1, 265)
CRITICAL = ("pickup_datetime", "PULocationID", "DOLocationID")
#: Older names of columns, by the names that stand for them.
ALIASES = {"pickup_datetime": ("pickup_ts",), "dropoff_datetime": ("dropoff_ts",)}


def resolve_columns(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The column that stands for each wanted name: the first of its names, whatever the case; KeyError if there is none."""
    present = {c.lower(): c for c in df.columns}
    found = {}
    for name, others in wanted.items():
        match = next((present[n.lower()] for n in (name, *others) if n.lower() in present), None)
        if match is None:
            raise KeyError(f"no column for {name} among {df.columns}")
        found[name] = match
    return found


def missing_columns(df: DataFrame) -> list[str]:
    """The required trip columns that neither their name nor an alias gives."""
    present = {c.lower() for c in df.columns}
    return [c for c in schemas.RAW_TRIP.names if not present & {n.lower() for n in (c, *ALIASES.get(c, ()))}]


def null_fractions(trips: DataFrame, columns: tuple[str, ...] = CRITICAL) -> DataFrame:
    """A row for each column: column, null_fraction, within the limit. One pass."""
    parts = trips.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_fraction")) for c in columns)))
    return parts.select(pairs.alias("p")).select("p.*", (F.col("p.null_fraction") <= MOST_NULLS).alias("ok"))


def zone_ranges(trips: DataFrame, columns: tuple[str, ...] = ("PULocationID", "DOLocationID"), bounds: tuple[int, int] = ZONE_IDS) -> DataFrame:
    """A row for each zone column: its least and greatest id and whether both are within the bounds; all null is not."""
    parts = trips.agg(*(F.struct(F.min(c).alias("least"), F.max(c).alias("greatest")).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in columns)))
    ok = (F.col("p.r.least") >= bounds[0]) & (F.col("p.r.greatest") <= bounds[1])
    return parts.select(pairs.alias("p")).select("p.column_name", "p.r.least", "p.r.greatest", F.coalesce(ok, F.lit(False)).alias("ok"))


def month_range(trips: DataFrame, month: str, time: str = "pickup_datetime") -> DataFrame:
    """One row: first and last pickup, and whether both are in the month (yyyy-MM)."""
    ok = (F.date_format("first_pickup", "yyyy-MM") == month) & (F.date_format("last_pickup", "yyyy-MM") == month)
    return trips.agg(F.min(time).alias("first_pickup"), F.max(time).alias("last_pickup")).withColumn("ok", F.coalesce(ok, F.lit(False)))


def row_counts(trips: DataFrame, columns: tuple[str, ...] = ("pickup_datetime", "PULocationID")) -> DataFrame:
    """One row: all rows, rows with all columns, and the part that is dropped."""
    clean = F.count_if(F.col(columns[0]).isNotNull() if len(columns) == 1 else F.forall(F.array(*(F.col(c).isNotNull() for c in columns)), lambda x: x))
    counts = trips.agg(F.count(F.lit(1)).alias("raw_rows"), clean.alias("clean_rows"))
    return counts.withColumn("dropped_fraction", F.when(F.col("raw_rows") > 0, 1 - F.col("clean_rows") / F.col("raw_rows")))


def validate_trips(trips: DataFrame, month: str | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row: rows, checks (name to result), errors, passed. A month of None leaves the month check out; with columns missing only they are told."""
    if absent := missing_columns(trips):
        errors = F.array(*(F.lit(f"missing column {c}") for c in absent))
        return trips.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.create_map(F.lit("columns"), F.lit(False)).alias("checks"), errors.alias("errors"), F.lit(False).alias("passed"))
    names = resolve_columns(trips, {c: ALIASES.get(c, ()) for c in schemas.RAW_TRIP.names})
    known = trips.select(*(F.col(own).alias(name) for name, own in names.items()))
    zones = ("PULocationID", "DOLocationID")
    stats = known.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.avg(F.col(c).isNull().cast("double")).alias(f"nulls_{c}") for c in CRITICAL),
        *(f(c).alias(f"{n}_{c}") for c in zones for n, f in (("least", F.min), ("greatest", F.max))),
        F.date_format(F.min("pickup_datetime"), "yyyy-MM").alias("first_month"),
        F.date_format(F.max("pickup_datetime"), "yyyy-MM").alias("last_month"),
    )
    checks = {"columns": F.lit(True), "row_count": F.col("rows") >= least_rows}
    checks |= {f"nulls {c}": F.col(f"nulls_{c}") <= MOST_NULLS for c in CRITICAL}
    checks |= {f"zones {c}": (F.col(f"least_{c}") >= ZONE_IDS[0]) & (F.col(f"greatest_{c}") <= ZONE_IDS[1]) for c in zones}
    if month is not None:
        checks["month"] = (F.col("first_month") == month) & (F.col("last_month") == month)
    made = F.create_map(*(x for name, ok in checks.items() for x in (F.lit(name), F.coalesce(ok, F.lit(False)))))
    found = stats.select("rows", made.alias("checks"))
    errors = F.map_keys(F.map_filter("checks", lambda _, ok: ~ok))
    return found.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)


def month_of_file(path: str) -> str | None:
    """The month (yyyy-MM) that a trip file's name states."""
    import re

    found = re.search(temporal.FILE_MONTH, path)
    return f"{found[1]}-{found[2]}" if found else None


def unknown_zones(trips: DataFrame, zones: DataFrame, column: str) -> DataFrame:
    """The trips whose zone is given but not in the zone table: to be kept apart, as a table with keys would refuse them."""
    known = zones.select(F.col("zone_id").alias("_known"))
    return trips.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")


def zone_table(lookup: DataFrame, centroids: DataFrame) -> DataFrame:
    """The zones that have a centroid, from two tables whose columns may go by several names."""
    l = resolve_columns(lookup, {"LocationID": ("zone_id", "location_id"), "Zone": ("zone_name",), "Borough": ()})
    c = resolve_columns(centroids, {"LocationID": ("zone_id", "location_id"), "centroid_lat": ("lat", "latitude"), "centroid_lon": ("lon", "longitude", "centroid_lng", "lng")})
    left = lookup.select(F.col(l["LocationID"]).cast("int").alias("zone_id"), F.col(l["Zone"]).alias("zone_name"), F.col(l["Borough"]).alias("borough"))
    right = centroids.select(F.col(c["LocationID"]).cast("int").alias("zone_id"), F.col(c["centroid_lat"]).cast("double").alias("centroid_lat"), F.col(c["centroid_lon"]).cast("double").alias("centroid_lon"))
    return left.join(right, "zone_id").select(*schemas.ZONE.names)
