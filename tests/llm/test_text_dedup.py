"""Line, substring and SimHash dedup against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zonecast.llm import line_dedup, simhash_dedup, substring_dedup, windows
from zonecast.llm.components import connected_components
from zonecast.llm.shared import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, least_docs, least_chars):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -(2**63) if i is None else i
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(order(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or order(i) == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def plain_windows(rows, size):
    texts = [WORD.findall((text or "").encode()) for _, text, *_ in rows]
    counts = Counter(tuple(t[k : k + size]) for t in texts for k in range(len(t) - size + 1))
    out = []
    for (i, *_), words in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(words) - size + 1):
            if counts[tuple(words[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return Counter(out)


def plain_fingerprint(text, size):
    words = WORD.findall("".join(ascii_lower(text or "")).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_lines(docs, rows):
    found = line_dedup.drop_shared_lines(docs, min_docs=5, min_chars=40)
    assert Counter(map(tuple, found.collect())) == plain_lines(rows, 5, 40)
    assert found.agg(F.sum("n_dropped")).first()[0] >= 19


def test_lines_keep_columns(docs):
    out = line_dedup.drop_shared_lines(docs, keep_columns=True)
    assert len(set(out.columns)) == len(out.columns) and {"source", "weight", "kept_text"} <= set(out.columns)
    assert out.where("kept_text = 'clash'").count() == 0 and out.count() == docs.count()


@pytest.mark.parametrize("size", [1, 35, 50])
def test_windows(docs, rows, size):
    found = substring_dedup.remove_repeated_windows(docs, window=size)
    assert Counter(map(tuple, found.collect())) == plain_windows(rows, size)


def test_window_pieces_add_up(docs, rows, monkeypatch):
    """Small chunks and early sends change nothing."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "HELD_HASHES", 700)
    found = substring_dedup.remove_repeated_windows(docs, window=35)
    assert Counter(map(tuple, found.collect())) == plain_windows(rows, 35)


def test_windows_of_many_groups_in_few_partitions(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "group_count", lambda _: 40)
    monkeypatch.setattr(substring_dedup, "MOST_PARTITIONS", 3)
    found = substring_dedup.remove_repeated_windows(docs, window=35)
    assert Counter(map(tuple, found.collect())) == plain_windows(rows, 35)


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        values = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (windows.unpack(windows.pack(values)) == values).all()


def test_word_hashes_tell_words_apart():
    texts = [b"a ab b", b"", b"  ab\tc\x0bd ", b"\xc3\xa9 e"]
    hashes, firsts = windows.word_hashes(texts)
    assert firsts.tolist() == [0, 3, 3, 6, 8] and len(set(hashes.tolist())) == 7 and hashes[1] == hashes[3]


@pytest.mark.parametrize("size", [4, 5])
def test_simhash(docs, rows, size):
    found = simhash_dedup.simhash_groups(docs, words=size, distance=4).collect()
    fps = [plain_fingerprint(t, size) for _, t, *_ in rows]
    ids = [-(2**63) if i is None else i for i, *_ in rows]
    linked = [(ids[a], ids[b]) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    label = plain_components(set(ids), linked)
    want = Counter((i if i != -(2**63) else None, f, label[i] if label[i] != -(2**63) else None) for i, f in zip(ids, fps, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in found)


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 7])
def test_fingerprint_links(spark, distance):
    rng = random.Random(distance)
    fps = {0, 2**64 - 1, 1 << 63}
    for _ in range(60):
        fp = rng.getrandbits(64)
        fps.add(fp)
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, distance + 2)):
                fp ^= 1 << b
            fps.add(fp)
    signed = sorted(f - 2**64 if f >> 63 else f for f in fps)
    found = simhash_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_fingerprint_links_broadcast_no_variants(spark):
    """A small table of fingerprints is 64 times as large once exploded: the driver must not hold it."""
    found = simhash_dedup.fingerprint_links(spark.range(100).select(F.xxhash64("id").alias("fp")), 4)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    label = plain_components({x for e in edges for x in e}, edges)
    assert {(r.node, r.component) for r in found} == {(n, c) for n, c in label.items() if n != 5} and len(found) == len({r.node for r in found})


def test_empty_tables(empty):
    assert line_dedup.drop_shared_lines(empty).count() == 0
    assert substring_dedup.remove_repeated_windows(empty).count() == 0
    assert simhash_dedup.simhash_groups(empty).count() == 0


def near_copies(count=12, copies=6):
    """Long texts, each with copies in which one word in sixty is another, and one with many."""
    rng = random.Random(21)
    make = lambda n: ["".join(rng.choice(["th", "er", "an", "on", "re", "ou", "es"]) for _ in range(rng.randint(2, 5))) for _ in range(n)]
    rows, groups = [], {}
    for k in range(count):
        base = make(300)
        for c in range(40 if k == 0 else copies):
            words = list(base)
            for at in rng.sample(range(300), 3 if c else 0):
                words[at] = "new" + "".join(make(1))
            rows.append((k * 100 + c, " ".join(words)))
            groups[k * 100 + c] = k * 100
    return rows, groups


@pytest.mark.parametrize("limit", [4096, 8])
def test_near_copies(spark, monkeypatch, limit):
    """All copies of a text are one group and no others are; long runs in blocks give the same."""
    monkeypatch.setattr(simhash_dedup, "RUN_ROWS", limit)
    rows, groups = near_copies()
    found = simhash_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == groups
    assert {r.doc_id for r in found if r.kept} == set(groups.values())


def test_near_copies_on_odd_tables(docs, empty):
    found = simhash_dedup.near_duplicate_groups(docs).collect()
    assert len(found) == docs.count() and simhash_dedup.near_duplicate_groups(empty).count() == 0
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[None] is None and {by_id[k] for k in (*range(40, 46), *range(50, 56))} == {40}


def test_spanning_pairs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        u, v = rng.integers(0, 20, 40), rng.integers(0, 20, 40)
        u, v = u[u != v], v[u != v]
        kept = simhash_dedup._nearest_tree(20, u, v, rng.integers(0, 5, len(u)))
        whole, part = (plain_components(range(20), [(int(a), int(b)) for a, b in zip(u[k], v[k], strict=True)]) for k in (slice(None), kept))
        assert whole == part and len(kept) == 20 - len(set(whole.values()))


def test_components_over_many_partitions(spark, monkeypatch):
    """Long paths and stars that no partition holds whole, contracted in small pieces."""
    from zonecast.llm import components

    monkeypatch.setattr(components, "HELD_EDGES", 40)
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "7")):
        spark.conf.set(key, value)
    try:
        rng = random.Random(8)
        order = rng.sample(range(400), 400)
        edges = [(a, b) for a, b in zip(order[:300], order[1:301], strict=True)] + [(order[320], k) for k in order[321:]]
        found = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7), Scratch(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    label = plain_components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in found} == label and len(found) == len(label)


def plain_shingles(text, size=5):
    words = WORD.findall(ascii_lower(text).encode())
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def pseudo_words(rng, count):
    return ["".join(rng.choice(["th", "er", "an", "on", "re", "ou", "es"]) for _ in range(rng.randint(2, 5))) for _ in range(count)]


def plain_near_groups(rows, similarity=0.8):
    sets = {i: plain_shingles(t) for i, t in rows}
    close = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    return plain_components(sets, [(a, b) for a in sets for b in sets if a < b and close(a, b)])


def test_near_copies_by_passages(spark):
    """A passage appended, cut off, put in or replaced is found as edits of single words are, and what is less similar is not."""
    rng = random.Random(31)
    rows = []
    for k in range(60):
        base = pseudo_words(rng, rng.randint(100, 900))
        n = len(base)
        at, some = rng.randrange(n // 4, n // 2), pseudo_words(rng, n // 5)
        share = n // 13
        edited = [base + some, base[: n - n // 6], base[:at] + some[: n // 6] + base[at:], base[:at] + some[:share] + base[at + share :], base + pseudo_words(rng, n // 2)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(edited[k % 5]))]
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain_near_groups(rows)
    assert found == want and len(set(want.values())) < 80


def test_near_copies_are_not_texts_of_the_same_words(spark):
    """Order counts: shuffles of a text, and long texts of one small vocabulary, stay apart."""
    rng = random.Random(32)
    rows = []
    for k in range(8):
        base = pseudo_words(rng, 400)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(rng.sample(base, len(base))))]
    vocabulary = pseudo_words(rng, 3000)
    zipf = [1 / (k + 1) for k in range(3000)]
    rows += [(1000 + k, " ".join(rng.choices(vocabulary, zipf, k=60_000))) for k in range(4)]
    found = simhash_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found) and len(found) == len(rows)


@pytest.mark.parametrize("limit", [512, 16])
def test_near_copies_in_a_crowd(spark, monkeypatch, limit):
    """A crowd of copies, many of them too far from each other, gives the groups of all pairs, however it is split."""
    monkeypatch.setattr(simhash_dedup, "RUN_ROWS", limit)
    rng = random.Random(33)
    base, rows = pseudo_words(rng, 120), []
    for k in range(250):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(2, 8)):
            words[at] = rng.choice(base)
        rows.append((k, " ".join(words)))
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain_near_groups(rows)
    assert found == want and 1 < len(set(want.values())) < 250


def test_near_copies_by_fingerprint(spark, monkeypatch):
    """The variants of fingerprints find pairs by themselves, and the shingles decide: repeats weigh in a fingerprint and not in a set."""
    monkeypatch.setattr(simhash_dedup, "band_keys", lambda shingles, hashes: np.array([shingles.sum()], np.uint64).view(np.int64))
    rng = random.Random(34)
    rows = []
    for k in range(12):
        base = pseudo_words(rng, 600)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:-1], "changed"])), (10 * k + 2, " ".join(pseudo_words(rng, 600)))]
    refrain = pseudo_words(rng, 7) * 300
    rows += [(1000 + k, " ".join(refrain + pseudo_words(rng, 40))) for k in range(2)]
    fps = {i: plain_fingerprint(t, 5) for i, t in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    texts = dict(rows)
    want = plain_components(fps, [(a, b) for a, b in near if jaccard(texts[a], texts[b]) >= 0.8])
    assert (1000, 1001) in near and want[1001] == 1001 and len(set(want.values())) < len(rows) - 8
    found = simhash_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == want
