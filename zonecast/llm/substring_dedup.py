"""Removal of every passage whose fixed-length word window occurs more than once in the corpus."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.shared import plan_bytes, row_group, shuffle_width
from zonecast.llm.windows import chunks, covered, pack, unpack, window_hashes

#: Text hashed at once, and hashes held before they are sent: these bound a worker's memory.
CHUNK_BYTES, HELD_HASHES = 2 << 20, 3_000_000
#: Bytes of a document group: they grow with the root of the input, between these bounds.
GROUP_BYTES = (4 << 20, 48 << 20)
#: Most partitions that the groups are dealt over: of more groups, a task takes several, one after the other.
MOST_PARTITIONS = 50_000


def group_count(docs: DataFrame) -> int:
    """So many groups that each group sends each bucket a useful number of hashes."""
    size = plan_bytes(docs)
    if size is None:
        return 4 * shuffle_width(docs.sparkSession)
    least, most = GROUP_BYTES
    return max(8, math.ceil(size / min(most, max(least, math.isqrt(size << 15)))))


def _at_most_two(values: np.ndarray) -> np.ndarray:
    """Sorted values with every third and later copy left out: more than two say nothing new."""
    if len(values) < 3:
        return values
    return values[np.concatenate([[True, True], values[2:] != values[:-2]])]


def _repeated(values: np.ndarray) -> np.ndarray:
    """The distinct values that a sorted array holds more than once."""
    return np.unique(values[1:][values[1:] == values[:-1]])


def _count_side(size: int, buckets: int):
    """(g, text) to (bucket, g, hashes): per group and bucket, the group's window hashes, repeats at most twice."""
    width = np.uint64((1 << 64) // buckets + 1)

    def send(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for g, parts in held.items():
            values = _at_most_two(np.sort(np.concatenate(parts)))
            owner = (values // width).astype(np.int32)
            # Only the buckets that get something: of very many buckets most get nothing from one group.
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            blobs = [pack(values[i:j]) for i, j in pairwise([*starts.tolist(), len(values)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[starts]), pa.array([g] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "hashes"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = defaultdict(list), 0
        for batch in batches:
            texts, groups = batch.column("text").cast(pa.binary()), batch.column("g").to_numpy()
            for g in np.unique(groups).tolist():
                own = (texts[i].as_py() or b"" for i in np.flatnonzero(groups == g).tolist())
                for run_of in chunks(own, CHUNK_BYTES):
                    found = window_hashes(run_of, size)[0]
                    if len(found):
                        held[g].append(found)
                        count += len(found)
                    if count > HELD_HASHES:
                        yield from send(held)
                        held, count = defaultdict(list), 0
        yield from send(held)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """A bucket's hashes of all groups to (g, hashes): what of each group's hashes occurs more than once anywhere."""
    parts = [unpack(x.as_py()) for x in table.column("hashes")]
    repeated = _repeated(np.sort(np.concatenate(parts)))
    groups, blobs = [], []
    if len(repeated):
        for g, part in zip(table.column("g").to_pylist(), parts, strict=True):
            at = np.minimum(np.searchsorted(repeated, part), len(repeated) - 1)
            own = np.unique(part[repeated[at] == part])
            if len(own):
                groups.append(g)
                blobs.append(pack(own))
    return pa.table({"g": pa.array(groups, pa.int32()), "hashes": pa.array(blobs, pa.binary())})


def _remove_side(size: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        repeated = np.unique(np.concatenate([np.empty(0, np.uint64), *(unpack(x.as_py()) for x in answers.column("hashes"))]))
        total, removed, kept = [], [], []
        texts = docs.column("text").cast(pa.binary())
        for part in chunks((t.as_py() or b"" for t in texts), CHUNK_BYTES):
            hashes, at, firsts = window_hashes(part, size)
            if len(repeated) and len(hashes):
                found = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
                gone = covered(int(firsts[-1]), at[repeated[found] == hashes], size)
            else:
                gone = np.zeros(int(firsts[-1]), bool)
            for text, i, j in zip(part, firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                words, own = text.split(), gone[i:j]
                total.append(j - i)
                removed.append(int(own.sum()))
                kept.append(b" ".join(compress(words, (~own).tolist()) if removed[-1] else words))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    Every window of ``window`` consecutive words is hashed (Rabin-Karp, 64 bits) and counted over the whole
    corpus, the same document included; a word goes if any repeated window covers it, so overlapping windows
    merge into maximal intervals. Windows are judged on the input. Words are runs without ASCII white space,
    kept unchanged and joined by one space.

    Rows fall into groups by content. A group sends each distinct hash at most twice to the hash's bucket, and
    gets back those that are repeated, so a passage that a third of all rows share costs each group two entries. Partitions hold
    whole groups in order, several each beyond ``MOST_PARTITIONS``, so a task holds one group's hashes at a time.
    A null text has no words and gives an empty text; texts shorter than a window stay whole; repeated rows
    are copies of each other; a null id is passed through; other columns are not read; an empty table gives
    an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = group_count(source)
    dealt = source.withColumn("g", row_group(source, groups, "doc_id", "text"))
    dealt = dealt.repartition(min(groups, MOST_PARTITIONS), "g").sortWithinPartitions("g")
    hashes = dealt.mapInArrow(_count_side(window, groups), "bucket int, g int, hashes binary")
    answers = hashes.groupBy("bucket").applyInArrow(_answer, "g int, hashes binary")
    id_type = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(
        _remove_side(window), f"doc_id {id_type}, n_words long, n_removed long, kept_text string"
    )
