"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.shared import Scratch, id_key, shuffle_width

SPACE = b" \t\n\x0b\x0c\r"


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hash(line: bytes, least: int) -> bytes | None:
    """The line's 128-bit key hash, none if its key is shorter than least code points."""
    key = line.strip(SPACE)
    if len(key) < least or _code_points(key) < least:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _exploded(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for own, text in zip(batch.column("key_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = {h for line in (text.as_py() or b"").split(b"\n") if (h := _hash(line, least))}
                ids += [own] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["key_id", "hash"])

    return run


def _reassembled(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.binary()), batch.column("gone"), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                total.append(len(lines))
                if gone.is_valid:
                    gone = set(gone.as_py())
                    lines = [x for x in lines if (h := _hash(x, least)) is None or h not in gone]
                dropped.append(total[-1] - len(lines))
                kept.append(b"\n".join(lines))
            names = [n for n in batch.schema.names if n not in ("text", "gone")]
            own = [batch.column(n) for n in names]
            new = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pc.cast(pa.array(kept, pa.binary()), pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*names, "n_lines", "n_dropped", "kept_text"])

    return run


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False
) -> DataFrame:
    """One row per input row: its id (or all its columns but the text), n_lines, n_dropped, kept_text.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` distinct ids hold lose all their lines except in the
    largest id that holds them. Other lines stay in place.

    Hashes (128 bits) are distinct within a row before they are shuffled, are counted within groups of documents and
    then over the groups, and only those that go come back to their documents. A null or empty text is one empty line. All
    rows of one id count as one document; null ids count as one document smaller than all others. Columns
    of the names that the result adds are replaced. An empty table gives an empty result.
    """
    names = [c for c in (docs.columns if keep_columns else (id_col,)) if c not in ("n_lines", "n_dropped", "kept_text", text_col)]
    source = docs.select(F.struct(*names).alias("_row"), F.col(text_col).cast("string").alias("text"), id_key(id_col).alias("key_id"))
    spark = docs.sparkSession
    found = source.select("key_id", "text").mapInArrow(_exploded(min_chars), "key_id long, hash binary")
    # Documents are dealt into groups, so that a line of a third of all documents is that of many groups and of no single task.
    group = F.pmod(F.xxhash64("key_id"), F.lit(shuffle_width(spark))).cast("int")
    lines = Scratch(spark).table(found.withColumn("g", group))
    held = lines.groupBy("g", "hash").agg(F.count_distinct("key_id").alias("n"), F.max("key_id").alias("last"))
    shared = held.groupBy("hash").agg(F.sum("n").alias("docs"), F.max("last").alias("keeper")).where(F.col("docs") >= min_docs)
    told = held.select("g", "hash").join(shared.select("hash", "keeper"), "hash")
    gone = lines.join(told, ["g", "hash"]).where("key_id != keeper").groupBy("key_id").agg(F.collect_set("hash").alias("gone"))
    joined = source.join(gone, "key_id", "left").select("_row", "text", "gone")
    schema = source.select("_row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return joined.mapInArrow(_reassembled(min_chars), schema).select("_row.*", "n_lines", "n_dropped", "kept_text")
