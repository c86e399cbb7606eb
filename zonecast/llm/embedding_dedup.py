"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.components import connected_components
from zonecast.llm.shared import NULL_ID, Scratch, id_key
from zonecast.llm.windows import mix

#: Rows of one block of a leaf; larger leaves are compared block by block, each pair of blocks in a task of its own.
BLOCK_ROWS = 1500
#: Rows of a matrix product at a time.
STRIPE = 256
#: Sample rows below which a node is not split, and directions that are tried for it.
LEAST_SAMPLE, TRIES = 8, 4
#: The share of a node's rows that a child may keep: two children of a larger share have more pairs to compare than the node. So a crowd
#: as narrow as the margin is never cut, however many rows it has, and loses no link.
MOST_KEPT = math.sqrt(0.5)
#: Shares of a node's sample that a cut may leave to its left. Of those cuts the one with the fewest rows about it is taken: it goes between crowds.
CUTS = np.linspace(0.3, 0.7, 17)
OTHER_LENGTH = -1


class Tree:
    """Splits fit on a sample: a node's cut on the random direction of its level sends a vector left, right, or, near the cut, both ways."""

    def __init__(self, sample: np.ndarray, rows: int, margin: float, leaf_rows: int, rng: np.random.Generator):
        self.margin = margin
        depth = TRIES * (2 + math.ceil(math.log2(1 + rows)))
        normals = rng.standard_normal((depth, sample.shape[1]))
        normals /= np.linalg.norm(normals, axis=1, keepdims=True)
        self.leaves = 0
        nodes: list[list] = []
        scale, places = rows / max(1, len(sample)), sample @ normals.T

        def leaf() -> int:
            self.leaves += 1
            return -self.leaves

        def split(own: np.ndarray, level: int) -> tuple[int, float, np.ndarray, np.ndarray] | None:
            for at in range(level, min(level + TRIES, depth)):
                p = places[own, at]
                cuts = np.quantile(p, CUTS)
                near, ordered = np.array([-2, -1, 1, 2]) * margin, np.sort(p)
                low, inner_low, inner_high, high = (np.searchsorted(ordered, cuts + step) for step in near)
                fits = np.maximum(inner_high, len(own) - inner_low) <= MOST_KEPT * len(own)
                if fits.any():
                    cut = float(cuts[np.where(fits, high - low, len(own) + 1).argmin()])
                    left, right = self._sides(p, cut)
                    return at, cut, own[left], own[right]
            return None

        # (rows of the sample, level, node and side that lead here)
        todo = [(np.arange(len(sample)), 0, None, 0)]
        self.root = 0
        while todo:
            own, level, parent, side = todo.pop()
            found = split(own, level) if len(own) * scale > leaf_rows and len(own) >= LEAST_SAMPLE else None
            here = len(nodes) if found else leaf()
            if parent is None:
                self.root = here
            else:
                nodes[parent][2 + side] = here
            if found:
                nodes.append([found[0], found[1], 0, 0])
                todo += [(found[3], found[0] + 1, here, 1), (found[2], found[0] + 1, here, 0)]
        self.level = np.array([n[0] for n in nodes], np.int64)
        self.cut = np.array([n[1] for n in nodes], float)
        self.children = np.array([n[2:] for n in nodes], np.int64).reshape(-1, 2)
        self.normals = normals[: int(self.level.max()) + 1 if nodes else 0]

    def _sides(self, p: np.ndarray, cut: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        return p <= cut + self.margin, p > cut - self.margin

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of each row; leaves count from 0."""
        places = vectors @ self.normals.T
        row, node = np.arange(len(vectors)), np.full(len(vectors), self.root)
        rows, leaves = [], []
        while len(row):
            done = node < 0
            rows.append(row[done])
            leaves.append(-node[done] - 1)
            row, node = row[~done], node[~done]
            left, right = self._sides(places[row, self.level[node]], self.cut[node])
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([self.children[node[left], 0], self.children[node[right], 1]])
        return np.concatenate(rows), np.concatenate(leaves)


def grow_forest(sample: np.ndarray, rows: int, threshold: float, trees: int, spill: float, leaf_rows: int, seed: int) -> list[Tree]:
    margin = spill * math.sqrt((2 - 2 * threshold) / max(1, sample.shape[1]))
    return [Tree(sample, rows, margin, leaf_rows, np.random.default_rng([seed, t])) for t in range(trees)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, digest, vector): vector is null where the row can link with nothing."""
    for batch in batches:
        digests, vectors = [], []
        for value in batch.column(1):
            own = None
            if value.is_valid and not value.values.null_count and len(value.values):
                row = value.values.to_numpy().astype(np.float64) + 0.0
                # Scaling by the largest component first keeps the norm of any finite vector finite.
                top = np.abs(row).max()
                if np.isfinite(top) and top > 0:
                    row = row / top
                    own = (row / np.linalg.norm(row)).tobytes()
            vectors.append(own)
            digests.append(None if own is None else xxhash.xxh3_128_digest(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["key_id", "digest", "vector"]
        )


def _lengths(vectors: pa.Array) -> np.ndarray:
    """Bytes of each vector."""
    return np.diff(np.frombuffer(vectors.buffers()[1], np.int32, len(vectors) + 1, 4 * vectors.offset))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length, without a copy."""
    first = np.frombuffer(vectors.buffers()[1], np.int32, 1, 4 * vectors.offset)[0] if len(vectors) else 0
    return np.frombuffer(vectors.buffers()[2], np.float64, len(vectors) * width, int(first)).reshape(-1, width) if len(vectors) else np.empty((0, width))


def _placed(batch: pa.RecordBatch, forest: list[Tree], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) by row and ascending leaf, leaves numbered through the trees; a vector of another length has leaf -1 alone."""
    vectors = batch.column("vector")
    fits = _lengths(vectors) == 8 * width
    at, other = np.flatnonzero(fits), np.flatnonzero(~fits)
    rows, leaves, first = [other], [np.full(len(other), OTHER_LENGTH)], 0
    if len(at):
        matrix = _matrix(vectors if fits.all() else vectors.take(pa.array(at)), width)
        for tree in forest:
            row, leaf = tree.place(matrix)
            rows.append(at[row])
            leaves.append(first + leaf)
            first += tree.leaves
    row, leaf = np.concatenate(rows), np.concatenate(leaves)
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def _leaf_counts(forest: list[Tree], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 + sum(t.leaves for t in forest), np.int64)
        for batch in batches:
            counts += np.bincount(_placed(batch, forest, width)[1] + 1, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"leaf": pa.array(held - 1), "n": pa.array(counts[held])})

    return run


def _deal(forest: list[Tree], width: int, blocks: np.ndarray):
    """A row to every pair of blocks (i <= j) of each of its leaves that its own block is part of; blocks are by leaf + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, leaf = _placed(batch, forest, width)
            firsts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(leaf, pa.int32()))
            count = blocks[leaf + 1]
            key = batch.column("rep").to_numpy().view(np.uint64)[row] ^ (leaf.astype(np.uint64) << np.uint64(40))
            mine = (mix(key) % count.astype(np.uint64)).astype(np.int64)
            # Each row once for every block that its own is paired with.
            at = np.repeat(np.arange(len(row)), count)
            other = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            columns = {"leaf": leaf[at], "i": np.minimum(mine[at], other), "j": np.maximum(mine[at], other), "side": mine[at]}
            for k in range(0, len(at), 20_000):
                part = slice(k, k + 20_000)
                taken = pa.array(row[at[part]])
                arrays = [pa.array(c[part], pa.int64() if n == "leaf" else pa.int32()) for n, c in columns.items()]
                arrays += [lists.take(taken), *(batch.column(c).take(taken) for c in ("rep", "copies", "vector"))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "leaves", "rep", "copies", "vector"])

    return run


def _earlier(lists: pa.ListArray, leaf: int) -> np.ndarray:
    """For each row a bit for every earlier leaf that it shares with another row here; two rows met there if their bits do."""
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    own = lists.flatten().to_numpy()
    owner, own = owner[own < leaf], own[own < leaf]
    _, column, times = np.unique(own, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    owner, column = owner[kept], place[column[kept]]
    bits = np.zeros((len(lists), (int(column.max()) if len(column) else 0) // 64 + 1), np.uint64)
    # No two entries are of the same row and leaf, so that adding sets bits.
    np.add.at(bits, (owner, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return bits


def _roots(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    label = np.arange(count)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    """A pair of blocks to (a, b, n): b null, n copies linked with a; or b a row of a's component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        sides = table.column("side").to_numpy()
        bits = _earlier(table.column("leaves").chunk(0), leaf)
        vectors = table.column("vector").chunk(0)
        lengths = _lengths(vectors)
        counts = np.zeros(len(reps), np.int64)
        us, vs = [], []
        for length in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == length)
            rows = _matrix(vectors if len(same) == len(vectors) else vectors.take(pa.array(same)), length // 8)
            one, two = (same, same) if i == j else (same[sides[same] == i], same[sides[same] == j])
            left, right = (rows, rows) if i == j else (rows[sides[same] == i], rows[sides[same] == j])
            for k in range(0, len(one), STRIPE):
                p, q = np.nonzero(left[k : k + STRIPE] @ right.T >= threshold)
                u, v = one[p + k], two[q]
                fresh = (u < v) if i == j else np.ones(len(u), bool)
                u, v = u[fresh], v[fresh]
                met = np.zeros(len(u), bool)
                for word in bits.T:
                    met |= (word[u] & word[v]) != 0
                u, v = u[~met], v[~met]
                counts += np.bincount(u, copies[v], len(reps)).astype(np.int64) + np.bincount(v, copies[u], len(reps)).astype(np.int64)
                us.append(u)
                vs.append(v)
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs))
        root = _roots(len(reps), u, v)
        counted, joined = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(reps)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([reps[counted], reps[joined]]), pa.int64()),
                "b": pa.array([None] * len(counted) + reps[root[joined]].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([counts[counted], np.zeros(len(joined), np.int64)]), pa.int64()),
            }
        )

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    trees: int = 6,
    spill: float = 0.75,
    sample_rows: int = 20_000,
    sample_bytes: int = 64 << 20,
    seed: int = 17,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors link at cosine >= threshold, in double precision; every found pair is verified. The trees are fit
    on ``sample_rows`` vectors (the least content hashes), or on one in 200 where that is more, within ``sample_bytes``, and place
    every row; a row within the spill margin of a cut goes both ways. A pair that meets in several leaves counts in the first.
    Leaves beyond ``BLOCK_ROWS`` rows, such as those of a crowded direction, which no cut divides, are compared exactly in pairs of blocks.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Equal directions are one entry with a count of ids, so copies are not
    compared with each other. Rows of one id are one vector if equal. A null id counts as smallest, and a component
    that it names has a null component_id. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    source = vectors.select(id_key(id_col).alias("key_id"), F.col(vector_col).alias("embedding"))
    rows = scratch.table(source.mapInArrow(_digests, "key_id long, digest binary, vector binary"))
    grouped = rows.where("digest is not null").groupBy("digest")
    reps = scratch.table(
        grouped.agg(F.min("key_id").alias("rep"), F.count_distinct("key_id").alias("copies"), F.first("vector").alias("vector"))
    )
    count = reps.count()
    # The commonest length, of a sample of lengths alone.
    lengths = reps.select("digest", F.length("vector").alias("n")).orderBy("digest").limit(1000).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    width = (lengths["n"] if lengths else 8) // 8
    wanted = min(max(sample_rows, count // 200), max(1, sample_bytes // (8 * width)))
    taken = reps.where(F.length("vector") == 8 * width).orderBy("digest").limit(wanted).select("vector").collect()
    sample = np.frombuffer(b"".join(r.vector for r in taken), np.float64).reshape(-1, width)
    forest = grow_forest(sample, count, threshold, trees, spill, BLOCK_ROWS, seed)
    # At most a row for each leaf of the trees, which the sample bounds.
    sizes = reps.mapInArrow(_leaf_counts(forest, width), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    blocks = np.ones(1 + sum(t.leaves for t in forest), np.int64)
    for r in sizes:
        blocks[r.leaf + 1] = math.ceil(r.n / BLOCK_ROWS)
    dealt = reps.mapInArrow(_deal(forest, width, blocks), "leaf long, i int, j int, side int, leaves array<int>, rep long, copies long, vector binary")
    found = scratch.table(dealt.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    named = (
        reps.select("digest", "rep", "copies")
        .join(links, F.col("rep") == F.col("a"), "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("digest").alias("own"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    out = rows.select("key_id", "digest").join(named, F.col("digest") == F.col("own"), "left")
    component = F.coalesce("component", "key_id")
    return out.select(
        F.nullif("key_id", F.lit(NULL_ID)).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(NULL_ID)).alias("component_id"),
        (F.col("key_id") == component).alias("kept"),
    )
