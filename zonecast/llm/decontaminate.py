"""Benchmark passages in documents: q-gram lemma filter in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.windows import MIX, chunks, mix

#: Characters of benchmark text that one pass over the documents searches for; a larger benchmark takes more passes.
PASS_CHARS = 2_000_000
#: Bits of the table that tells most q-grams of a document apart from those of the benchmark.
FILTER_BITS = 22
CHUNK_BYTES = 1 << 20


def fold(text: str) -> str:
    """Lower case, white space folded: what both sides are compared in."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters at every position that has so many, by doubling."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    base = MIX[0]
    power, length, value = points.astype(np.uint64) * np.uint64(MIX[1]), 1, None
    done, left = 0, q
    while left:
        if left & 1:
            part = power[done : len(points) - q + 1 + done] if done + length <= q else power
            value = part.copy() if value is None else value * np.uint64(pow(base, length, 1 << 64)) + part
            done += length
        left >>= 1
        if left:
            power = power[:-length] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
            length *= 2
    return mix(value)


def edit_budget(length: int, rate: float, q: int) -> int:
    """The edits allowed: the rate's share of the length, less where the q-gram lemma would then ask for no q-gram."""
    return max(0, min(int(rate * length), (length - q) // q))


def aligned(item: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place for the whole item in the text if within the budget; only a band about the diagonals is filled.

    The text is the item's length and a little over; cells further from the diagonal than the slack are never part of
    an alignment within the budget.
    """
    n, m = len(item), len(text)
    slack = max(0, m - n) + budget
    width = budget + slack + 1
    far = budget + 1
    offsets = np.arange(width) - budget
    # Row i holds cells (i, i + offset); a match may start at any column.
    cost = np.where((offsets >= 0) & (offsets <= m), 0, far).astype(np.int32)
    begin = np.clip(offsets, 0, m).astype(np.int32)
    steps = np.arange(width, dtype=np.int32)
    for i in range(1, n + 1):
        column = i + offsets
        valid = (column >= 0) & (column <= m)
        letter = np.where((column >= 1) & (column <= m), text[np.clip(column - 1, 0, m - 1)], 0xFFFFFFFF) != item[i - 1]
        swap = np.where(column >= 1, cost + letter, far)
        skip = np.append(cost[1:], far) + 1
        down = skip < swap
        new = np.where(down, skip, swap)
        start = np.where(down, np.append(begin[1:], 0), begin)
        new = np.where(valid, new, far + width)
        # Insertions run along the row: the least of new[k] - k so far.
        order = new - steps
        best = np.minimum.accumulate(order)
        source = np.maximum.accumulate(np.where(order == best, steps, 0))
        cost, begin = np.minimum(best + steps, far + width).astype(np.int32), start[source]
        if cost.min() > budget:
            return None
    column = n + offsets
    cost = np.where((column >= 0) & (column <= m), cost, far)
    at = int(cost.argmin())
    return (int(cost[at]), int(begin[at]), int(column[at])) if cost[at] <= budget else None


def exact(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """The first place of the unchanged item: what most contaminated documents hold."""
    whole, part = text.tobytes(), item.tobytes()
    at = whole.find(part)
    while at >= 0 and at % 4:
        at = whole.find(part, at + 1)
    return (0, at // 4, at // 4 + len(item)) if at >= 0 else None


class Index:
    """The q-grams of some benchmark items, with where they stand."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        self.ids = [key for key, _ in items]
        self.texts = [codes(text) for _, text in items]
        self.budgets = np.array([edit_budget(len(t), rate, q) for t in self.texts], np.int64)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.needed = np.maximum(1, lengths - q + 1 - self.budgets * q)
        grams = [gram_hashes(t, q) for t in self.texts]
        hashes = np.concatenate([np.empty(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(hashes)))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of every shared q-gram."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[found] == hashes[at]
        at, found = at[same], found[same]
        count = self.count[found]
        slots = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.repeat(at, count), self.owner[slots], self.place[slots]

    def regions(self, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first diagonal) of the bands that share enough q-grams. Bands are twice as wide as an alignment may drift and overlap by half."""
        position, item, place = self.hits(hashes)
        if not len(position):
            return
        drift = self.budgets[item] + 1
        diagonal = position - place + len(hashes)
        span = np.int64(4 * len(hashes) + 4)
        keys = np.concatenate([item * span + 2 * (diagonal // (2 * drift)), item * span + 2 * ((diagonal + drift) // (2 * drift)) + 1])
        values, counts = np.unique(keys, return_counts=True)
        enough = values[counts >= self.needed[values // span]]
        for key in enough.tolist():
            own, band = divmod(key, int(span))
            width = 2 * (int(self.budgets[own]) + 1)
            yield own, band // 2 * width - (band % 2) * (width // 2) - len(hashes)


def find_in_text(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, edits) of every benchmark item in a folded text, the best place of each overlapping run."""
    points = codes(text)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for own, diagonal in index.regions(gram_hashes(points, index.q)):
        item, budget = index.texts[own], int(index.budgets[own])
        first = max(0, diagonal - budget)
        window = points[first : max(0, diagonal + 2 * (budget + 1) + len(item) + budget)]
        if len(window) and (match := exact(item, window) or aligned(item, window, budget)):
            found.setdefault(own, []).append((first + match[1], first + match[2], match[0]))
    rows = []
    for own, places in found.items():
        kept: list[tuple[int, int, int]] = []
        for start, end, edits in sorted(set(places), key=lambda p: (p[2], p[0], p[1])):
            if all(end <= s or e <= start for s, e, _ in kept):
                kept.append((start, end, edits))
        rows += [(index.ids[own], *place) for place in kept]
    return sorted(rows)


def find_in_texts(texts: pa.Array, index: Index) -> Iterator[tuple[int, tuple[int, int, int, int], str]]:
    """(number of the text, match, passage) over many texts; runs of them are filtered together, those with a band that holds enough are read alone."""
    at = 0
    for part in chunks((t.as_py() or "" for t in texts), CHUNK_BYTES):
        folded = [fold(t) for t in part]
        starts = np.cumsum([0, *(len(t) + 1 for t in folded)])
        marked: set[int] = set()
        for own, diagonal in index.regions(gram_hashes(codes("\x00".join(folded)), index.q)):
            reach = 2 * (int(index.budgets[own]) + 1) + len(index.texts[own])
            low, high = np.searchsorted(starts, [max(0, diagonal), max(0, diagonal + reach)], side="right")
            marked.update(range(int(low) - 1, min(int(high), len(folded))))
        for k in sorted(marked):
            for row in find_in_text(folded[k], index):
                yield at + k, row, folded[k][row[1] : row[2]]
        at += len(part)


class Short:
    """Items too short for edits: found unchanged, as whole words, all in one pass over a text."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items: dict[str, list[int]] = {}
        for key, text in items:
            self.items.setdefault(text, []).append(key)
        self.automaton = ahocorasick.Automaton()
        for text in self.items:
            self.automaton.add_word(text, text)
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, 0) of every place in a folded text; the places of an item do not overlap."""
        rows, free = [], {}
        for last, item in self.automaton.iter(text) if self.items else ():
            start, end = last + 1 - len(item), last + 1
            whole = (start == 0 or not (text[start - 1].isalnum() and item[0].isalnum())) and (end == len(text) or not (text[end].isalnum() and item[-1].isalnum()))
            if whole and start >= free.get(item, 0):
                free[item] = end
                rows += [(key, start, end, 0) for key in self.items[item]]
        return rows


def split_items(items: list[tuple[int, str]], min_chars: int, q: int, rate: float) -> tuple[Index, Short]:
    least = max(min_chars, q)
    return Index([x for x in items if len(x[1]) >= least], q, rate), Short([x for x in items if len(x[1]) < least])


def find_all(texts: pa.Array, index: Index, short: Short) -> Iterator[tuple[int, tuple[int, int, int, int], str]]:
    """(number of the text, match, passage) of items of both kinds."""
    if index.ids:
        yield from find_in_texts(texts, index)
    if short.items:
        for k, text in enumerate(texts):
            folded = fold(text.as_py() or "")
            for row in short.find(folded):
                yield k, row, folded[row[1] : row[2]]


def _search(index: Index, short: Short):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, row, passage in find_all(batch.column("text"), index, short):
                ids.append(k)
                rows.append((*row, passage))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            taken = batch.column("doc_id").take(pa.array(ids, pa.int64()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [taken, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "item_id", "start", "end", "edits", "passage"]
            )

    return run


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct (item_id, folded text) in runs of bounded size; longer texts than a run's size stand alone."""
    run, held = [], 0
    for row in benchmark.where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        text = fold(row.text)
        if not text:
            continue
        if run and held + len(text) > PASS_CHARS:
            yield run
            run, held = [], 0
        run.append((row.item_id, text))
        held += len(text)
    if run:
        yield run


def benchmark_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = 12,
    edit_rate: float = 0.07,
    min_chars: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each place where a document holds a whole benchmark item: doc_id, item_id, start, end, edits, passage.

    Both sides are lower-cased and white space is folded; start and end are code points of the folded text. An item may
    differ by ``edit_rate`` of its length in edits (fewer where the q-gram lemma would otherwise need no shared q-gram).
    Places of one item do not overlap: the one with fewest edits stays. Items shorter than ``min_chars`` are searched for without
    edits, as whole words. Items that are null or blank are not searched for; nothing is found in null or empty texts; repeated items count once, repeated documents repeat their rows; null
    document ids pass through; other columns are not read; an empty table on either side gives an empty result.

    The benchmark goes to the executors in runs of at most ``PASS_CHARS`` characters, one pass over the documents each;
    documents are neither shuffled nor joined.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, start long, end long, edits long, passage string"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = None
    for run in _passes(items):
        part = source.mapInArrow(_search(*split_items(run, min_chars, q, edit_rate)), schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_passages(
    docs: DataFrame, benchmark: DataFrame, q: int = 12, edit_rate: float = 0.07, min_chars: int = 40, text_col: str = "text"
) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item; see benchmark_passages. Rows are judged where they are read: no shuffle."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    kept = docs
    for run in _passes(items):
        kept = kept.mapInArrow(_clean(*split_items(run, min_chars, q, edit_rate), text_col), docs.schema)
    return kept


def _clean(index: Index, short: Short, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, _, _ in find_all(batch.column(text_col), index, short):
                keep[k] = False
            yield batch.filter(pa.array(keep))

    return run
