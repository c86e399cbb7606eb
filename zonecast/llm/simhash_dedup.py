"""SimHash near-duplicates, found through deletion-variant signatures of a few segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.llm.components import connected_components
from zonecast.llm.shared import NULL_ID, Scratch, id_key, shuffle_width
from zonecast.llm.windows import mix

HASH_SEED = 42
BITS = 64
#: Step of the keys of bands.
GOLDEN = 0x9E3779B97F4A7C15
#: Bands of MinHashes in a similarity search, hashes of one at most, and the share of pairs at the very similarity that may share none.
BANDS, MOST_BAND_HASHES, MISSED = 56, 32, 1e-4
#: Rows, and shingles, of one block of a crowd of candidates; larger crowds are compared in pairs of blocks.
RUN_ROWS, RUN_SHINGLES = 512, 1_000_000
#: Shingles of a matrix at a time.
CHUNK_SHINGLES = 1024
#: Adds up to this many single-byte counters before one could overflow.
BLOCK = 255


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased text, repeats included."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    stops = list(accumulate(len(w) + 1 for w in found))
    count = len(found) - words + 1
    starts = [0, *stops[: count - 1]]
    slices = map(slice, starts, (s - 1 for s in stops[words - 1 :]))
    digests = map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(HASH_SEED))
    return np.fromiter(digests, np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    starts = np.arange(0, len(hashes), BLOCK)
    lanes = np.uint64(0x0101010101010101)
    result = 0
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > len(hashes)):
            result |= 1 << (8 * int(byte) + k)
    return result


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"", words)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments, two at least, of which one differs by at most one bit within the distance."""
    count = max(2, distance // 2 + 1)
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    stops = list(accumulate(widths))
    return [(stop - width, width) for stop, width in zip(stops, widths, strict=True)]


def _part(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _variant_key(fp: Column, bit: Column, segments: list[tuple[int, int]]) -> Column:
    """The segment that holds the bit, without the bit, beside the bit's number: equal for two fingerprints that agree there."""
    key = None
    for shift, width in reversed(segments):
        wildcard = F.expr(f"shiftleft(1L, bit - {shift})")
        value = F.shiftleft(_part(fp, shift, width).bitwiseAND(F.bitwise_not(wildcard)), 6).bitwiseOR(bit.cast("long"))
        key = value if key is None else F.when(bit < shift + width, value).otherwise(key)
    return key


def _first_shared_bit(diff: Column, segments: list[tuple[int, int]]) -> Column:
    """The lowest-segment wildcard that two fingerprints share, so that a pair meets once."""
    result = F.lit(-1)
    for shift, width in reversed(segments):
        part = _part(diff, shift, width)
        result = (
            F.when(F.bit_count(part) == 0, F.lit(shift))
            .when(F.bit_count(part) == 1, F.bit_count(part - F.lit(1)) + F.lit(shift))
            .otherwise(result)
        )
    return result


def fingerprint_links(fps: DataFrame, distance: int) -> DataFrame:
    """(u, v) for all distinct fingerprints (column fp, no repeats) that differ in at most ``distance`` bits, u < v, once each."""
    segments = _segments(distance)
    bits = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")
    keyed = fps.select("fp", bits).select("fp", "bit", _variant_key(F.col("fp"), F.col("bit"), segments).alias("key"))
    one = keyed.select(F.col("key").alias("key"), F.col("fp").alias("u"))
    two = keyed.select(F.col("key").alias("key2"), F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    bit = F.col("key").bitwiseAND(F.lit(63))
    meets = (
        (F.col("key") == F.col("key2"))
        & (F.col("u") < F.col("v"))
        & (F.bit_count(diff) <= distance)
        & (_first_shared_bit(diff, segments) == bit)
    )
    # Catalyst's estimate leaves out that explode makes 64 rows of one: by it, tables far beyond the driver's memory would be broadcast.
    return one.hint("merge").join(two, meets).select("u", "v")


def simhash_groups(
    docs: DataFrame, words: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id, kept.

    Documents link when their fingerprints differ in at most ``distance`` bits. Copies and documents of one
    fingerprint are one node, so groups of copies of any size cost one row each in the joins. A null text
    counts as empty (fingerprint zero, linked like any other); a null id is a document smaller than all
    others and its group's component_id is null. Repeated rows are repeated in the result. Columns other
    than the two named ones are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.table(fingerprints(docs, words, id_col, text_col))
    nodes = scratch.table(marked.groupBy("fp").agg(F.min(id_key("doc_id")).alias("least")))
    groups = connected_components(fingerprint_links(nodes.select("fp"), distance), scratch)
    joined = nodes.join(groups, nodes.fp == groups.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    firsts = joined.groupBy("component").agg(F.min("least").alias("first"))
    named = scratch.table(joined.join(firsts, "component").select(F.col("fp").alias("node_fp"), "first"))
    out = marked.join(named, F.col("fp") == F.col("node_fp"), "left")
    component = F.when(F.col("first") != NULL_ID, F.col("first"))
    return out.select("doc_id", "fp", component.alias("component_id"), (id_key("doc_id") == F.col("first")).alias("kept"))


def band_hashes(similarity: float) -> int:
    """The MinHashes that a band joins: as many as leave documents of that similarity without an equal band in a share MISSED of cases at most."""
    return max([r for r in range(1, MOST_BAND_HASHES + 1) if (1 - similarity**r) ** BANDS <= MISSED], default=1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def band_keys(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """A key for every band: equal where all the least hashes of the band are."""
    factors = np.random.default_rng(HASH_SEED).integers(0, 1 << 31, (BANDS * hashes, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    low, least = shingles.astype(np.uint32), np.full(BANDS * hashes, 2**32 - 1, np.uint32)
    for k in range(0, len(low), CHUNK_SHINGLES):
        np.minimum(least, (factors * low[k : k + CHUNK_SHINGLES]).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, hashes).T:
        keys = mix(keys ^ column.astype(np.uint64)) + np.uint64(GOLDEN)
    return keys.view(np.int64)


def shingle_bands(docs: DataFrame, words: int, hashes: int, id_col: str, text_col: str) -> DataFrame:
    """(key_id, fp, digest, size, bands): for each row its fingerprint, a hash and the size of its set of shingles, and the set's bands; no bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, sizes, bands = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                every = shingle_hashes(text.as_py() or b"", words)
                own = np.unique(every)
                fps.append(fingerprint(every))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                bands.append(band_keys(own, hashes) if len(own) else np.empty(0, np.int64))
            stops = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(stops, pa.array(np.concatenate([np.empty(0, np.int64), *bands])))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["key_id", "fp", "digest", "size", "bands"])

    source = docs.select(id_key(id_col).alias("key_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "key_id long, fp long, digest binary, size long, bands array<long>")


def _nearest_tree(count: int, u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The pairs of a least spanning forest: as connected as all the pairs, and each row with its nearest."""
    label, chosen = np.arange(count), []
    rank = np.argsort(cost, kind="stable")
    u, v, order = u[rank], v[rank], rank
    while len(u):
        first = np.full(count, len(u))
        at = np.arange(len(u))
        np.minimum.at(first, label[u], at)
        np.minimum.at(first, label[v], at)
        picked = np.unique(first[first < len(u)])
        chosen.append(order[picked])
        while True:
            low = np.minimum(label[u[picked]], label[v[picked]])
            new = label.copy()
            np.minimum.at(new, label[u[picked]], low)
            np.minimum.at(new, label[v[picked]], low)
            new = new[new][label]
            if (new == label).all():
                break
            label = new
        open_ = label[u] != label[v]
        u, v, order = u[open_], v[open_], order[open_]
    return np.concatenate([np.empty(0, np.int64), *chosen])


def _shingles(words: int):
    """(component, blocks, node, text) to (component, blocks, node, shingles): the sorted set of the whole text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                sets = [shingle_set(t.as_py() or b"", words).tobytes() for t in part.column(3).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], names=["component", "blocks", "node", "shingles"])

    return run


def _similar_pairs(similarity: float):
    """A pair of blocks to links (u, v): a spanning forest of the pairs, one from each block, that share enough of their shingles."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = (table.column(c)[0].as_py() for c in "ij")
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        kept = times[column] > 1
        column, owner = shared[column[kept]], owner[kept]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(left), len(right)))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK_SHINGLES):
            at = slice(*np.searchsorted(column, [first, first + CHUNK_SHINGLES]))
            holds = np.zeros((len(sets), CHUNK_SHINGLES), np.float32)
            holds[owner[at], column[at] - first] = 1
            common += holds[left] @ holds[right].T
        either = sizes[left][:, None] + sizes[right][None, :] - common
        p, q = np.nonzero(common >= similarity * either - 1e-9)
        u, v = left[p], right[q]
        share = common[p, q] / either[p, q]
        if i == j:
            u, v, share = (x[p < q] for x in (u, v, share))
        tree = _nearest_tree(len(sets), u, v, -share)
        return pa.table({"u": node[u[tree]], "v": node[v[tree]]})

    return run


def _fingerprint_stars(marked: DataFrame, nodes: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(u, v) of nodes: as connected as all pairs of them that have fingerprints within the distance."""
    held = marked.select("fp", "digest").distinct().join(nodes.select(F.col("digest").alias("own"), "least"), F.col("digest") == F.col("own")).select("fp", "least")
    held = scratch.table(held)
    firsts = scratch.table(held.groupBy("fp").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")))
    same = held.join(firsts.where("n > 1").select(F.col("fp").alias("own"), "first"), F.col("fp") == F.col("own")).select(F.col("least").alias("u"), F.col("first").alias("v"))
    pairs = fingerprint_links(firsts.select("fp"), distance).withColumnsRenamed({"u": "fp_u", "v": "fp_v"})
    one, two = (firsts.select(F.col("fp").alias(f"own_{x}"), F.col("first").alias(x)) for x in "uv")
    near = pairs.join(one, F.col("fp_u") == F.col("own_u")).join(two, F.col("fp_v") == F.col("own_v")).select("u", "v")
    return same.union(near).where("u != v")


def _similar_links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, similarity: float, distance: int, words: int, scratch: Scratch) -> DataFrame:
    """(u, v) of nodes whose sets of shingles are that similar, a spanning forest at least of all that have near fingerprints or share a band.

    Nodes that are candidates for each other, directly or through others, are one crowd, and all the pairs of a crowd are compared on the
    shingles of their whole texts. Crowds too large for a task are split into blocks, and every pair of blocks is compared, so none is cut.
    """
    keyed = nodes.select(F.col("least").alias("node"), F.explode("bands").alias("key"))
    leasts = keyed.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("own"), "v")
    stars = keyed.join(leasts, F.col("key") == F.col("own")).where("node != v").select(F.col("node").alias("u"), "v").distinct()
    crowds = scratch.table(connected_components(_fingerprint_stars(marked, nodes, distance, scratch).union(stars), scratch))
    sized = crowds.join(nodes.select("least", "size"), F.col("node") == F.col("least"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / RUN_ROWS, F.sum("size") / RUN_SHINGLES)).cast("int")
    members = scratch.table(
        crowds.join(sized.groupBy("component").agg(blocks.alias("blocks")).withColumnRenamed("component", "crowd"), F.col("component") == F.col("crowd"))
        .select("component", "blocks", "node")
    )
    texts = docs.join(members, F.col("key_id") == F.col("node")).select("component", "blocks", "node", "text")
    sets = texts.mapInArrow(_shingles(words), "component long, blocks int, node long, shingles binary")
    dealt = sets.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = dealt.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "shingles")
    return paired.groupBy("component", "i", "j").applyInArrow(_similar_pairs(similarity), "u long, v long")


def near_duplicate_groups(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, component_id, kept; for documents that are as similar in shingles of ``words`` words.

    Two documents link if the Jaccard similarity of their sets of shingles (lower-cased in ASCII, hashed to 64 bits, of the whole
    texts) is at least ``similarity``; every link is decided so. Candidates are the pairs that simhash_groups links, of fingerprints
    within ``distance`` bits, found through the same variants. A fingerprint of shingles loses a bit in seven at a similarity of
    0.8, too many for an index, so those that agree in a band of MinHashes are candidates too: two documents of just
    that similarity share none in a share MISSED of cases at most, and others of their group may still bring them together.

    Rows of one id are one document. A null or blank text has no words: such documents are one group. A null id counts as
    smallest and its group's component_id is null. Documents of equal sets are one node. Other columns are not read; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.table(shingle_bands(docs, words, band_hashes(similarity), id_col, text_col))
    nodes = scratch.table(marked.groupBy("digest").agg(F.min("key_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    source = docs.select(id_key(id_col).alias("key_id"), F.col(text_col).cast("string").alias("text"))
    links = scratch.table(_similar_links(source, marked, nodes, similarity, distance, words, scratch))
    groups = connected_components(links, scratch)
    named = nodes.join(groups, F.col("least") == F.col("node"), "left").select(F.col("digest").alias("own"), F.coalesce("component", "least").alias("component"))
    out = marked.select("key_id", "digest").join(named, F.col("digest") == F.col("own"), "left")
    return out.select(
        F.nullif("key_id", F.lit(NULL_ID)).alias("doc_id"),
        F.nullif("component", F.lit(NULL_ID)).alias("component_id"),
        (F.col("key_id") == F.col("component")).alias("kept"),
    )


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
