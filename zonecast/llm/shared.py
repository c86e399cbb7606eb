"""What the operators share: shared-folder tables, plan sizes, row keys, joins with tables of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import remove, scratch_folder

#: Stands for a null id wherever ids are compared: one document, smaller than every other.
NULL_ID = -(2**63)
#: Size of a table up to which it is broadcast, and the number of its heaviest keys that are broadcast beyond that.
BROADCAST_BYTES, HEAVY_KEYS = 32 << 20, 1000
#: Bytes of rows that go to a Python worker at a time, about: both sides hold a batch several times over, outside the heap.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, survive lost executors and go when dropped or at exit."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = scratch_folder(spark, "llm")
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._zonecast_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._zonecast_path)


def join_by_key(rows: DataFrame, table: DataFrame, on: dict[str, str], weight: str, limit: int = BROADCAST_BYTES, heavy: int = HEAVY_KEYS) -> DataFrame:
    """Rows, left-joined with a written table of one row per key (columns of rows to those of the table); ``weight`` says how many rows have the key.

    A table within the limit is broadcast, and rows stay where they are. Of a larger one the keys that hold over a part in ``heavy`` of
    all rows, of which there are fewer than that, are broadcast, and only the others meet by a shuffle: no key fills a task.
    """

    def joined(side: DataFrame, with_: DataFrame, how: str) -> DataFrame:
        return side.join(with_, [F.col(a) == F.col(b) for a, b in on.items()], how)

    if (plan_bytes(table) or limit + 1) <= limit:
        return joined(rows, F.broadcast(table), "left")
    least = (table.agg(F.sum(weight)).first()[0] or 0) / heavy
    many, few = table.where(F.col(weight) > least), table.where(F.col(weight) <= least)
    rest = joined(rows, F.broadcast(many.select(*on.values())), "left_anti")
    return joined(rows, F.broadcast(many), "inner").unionByName(joined(rest, few, "left"))


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers BATCH_BYTES at a time and not 10,000 rows of whatever size; a lower limit stays.

    The limit is the session's, as it counts when a plan runs, which for a returned table is later. Results do not depend on it.
    """
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate; None where the plan has none (it then says about 2**63)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else None


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_group(df: DataFrame, width: int, *cols: str) -> Column:
    """A stable group of each row in [0, width), from its content."""
    return F.pmod(F.xxhash64(*(F.col(c) for c in cols)), F.lit(width)).cast("int")


def id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))
