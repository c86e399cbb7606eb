"""Vectors, mixing, quality, decontamination and the pipeline."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonecast.llm import decontaminate, embedding_dedup, mixing, quality, shared


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("digest", "rep", "leaf", "n_links")}).repartition(3)


def plain_links(rows, threshold):
    good = {}
    for key, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            good[key] = a / np.linalg.norm(a)
    links = {(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold}
    label = {k: k for k, _ in rows}
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {k: (sum(k in pair for pair in links), label[k]) for k, _ in rows}


def vector_rows(count, width=16, hot=60):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(width).tolist()) for k in range(count)]
    centre = rng.standard_normal(width)
    rows += [(1000 + k, (centre + 0.03 * rng.standard_normal(width)).tolist()) for k in range(hot)]
    rows += [(2000 + k, rows[k][1]) for k in range(5)] + [(2100, [3.0 * x for x in rows[7][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * width), (3003, [1.0, None] * (width // 2)), (3004, [float("nan")] * width), (3005, [float("inf")] * width)]
    return rows + [(3006, [1.0, 0.0]), (3007, [1.0, 0.01]), (3008, [1e30] * width), (3009, [1e-30] * width)]


@pytest.mark.parametrize("block", [1500, 25])
def test_vectors(spark, monkeypatch, block):
    """With small blocks the trees split, spill, and fall back to pairs of blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = vector_rows(300)
    found = embedding_dedup.near_duplicate_vectors(vectors(spark, rows), threshold=0.95, trees=6, spill=1.5).collect()
    want = plain_links(rows, 0.95)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vectors_odd_tables(spark):
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, [(1, None)]).where("false")).count() == 0
    found = embedding_dedup.near_duplicate_vectors(vectors(spark, [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, None)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found) == [(0, 1, None), (5, 1, None), (5, 1, None), (6, 0, 6)]


def plain_weights(tokens, exponent):
    total = sum(tokens.values())
    raised = {k: (v / total) ** exponent for k, v in tokens.items() if v}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def plain_mix(tokens, target_entropy, max_repetition, budget):
    """(weights, budget) by a plain bisection of the exponent over the sources by name."""
    drawn = lambda w: budget if budget is not None else max(tokens[k] / w[k] for k in w)
    if target_entropy is not None:
        fits = lambda w: -sum(x * math.log(x) for x in w.values()) <= target_entropy
    else:
        fits = lambda w: max_repetition is None or max(drawn(w) * w[k] / tokens[k] for k in w) <= max_repetition
    low, high = 0.0, 1.0
    if fits(plain_weights(tokens, 0.0)):
        high = 0.0
    elif fits(plain_weights(tokens, 1.0)):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(plain_weights(tokens, middle)) else (middle, high)
    weights = plain_weights(tokens, high)
    return weights, drawn(weights)


def test_exponent():
    tokens = {"a": 800, "b": 150, "c": 50, "d": 50, "e": 0}
    counts, times = [800, 150, 50, 0], [1, 1, 2, 1]
    mix = mixing.solve(counts, times, None, 4.0, None)
    assert 0 < mix.exponent < 1 and abs(max(mix.budget * mix.weight(n) / n for n in (800, 150, 50)) - 4) < 1e-6
    assert abs(min(mix.budget * mix.weight(n) / n for n in (800, 150, 50)) - 1) < 1e-9
    for given in ((None, 4.0, None), (0.9, None, 1000), (None, None, 1000), (None, 2.0, 5000.0), (0.0, None, None), (None, 0.5, 100.0)):
        mix, (weights, budget) = mixing.solve(counts, times, *given), plain_mix(tokens, *given)
        assert abs(mix.budget - budget) < 1e-6 * budget and all(abs(mix.weight(tokens[k]) - w) < 1e-9 for k, w in weights.items()) and mix.weight(0) == 0
    assert mixing.solve(counts, times, None, None, 1000).exponent == 0 and mixing.solve([], [], None, 4.0, None).budget == 0


def plain_draws(rows, seed, block_docs, max_repetition, budget):
    """(copies, block, block_rank) of each row (source, tokens, order, hash of its source and of every block) by plain loops."""
    by_source = {}
    for k, row in enumerate(rows):
        by_source.setdefault(row["source"], []).append(k)
    tokens = {s: sum(rows[k]["n"] for k in own) for s, own in by_source.items()}
    weights, budget = plain_mix(tokens, None, max_repetition, budget)
    out = {}
    for source, own in by_source.items():
        part = int(budget * weights.get(source, 0.0) * (1 + 1e-12) + 1e-6)
        epochs, rest = divmod(part, tokens[source]) if tokens[source] else (1, 0)
        count = -(-len(own) // block_docs)
        blocks = {}
        for k in own:
            blocks.setdefault(rows[k]["order"] % count, []).append(k)
        for rank, block in enumerate(sorted(blocks, key=lambda b: (rows[own[0]]["ranks"][b], b))):
            held = sum(rows[k]["n"] for k in blocks[block])
            last = None
            if held > rest:
                left = rest
                for order in sorted({rows[k]["order"] for k in blocks[block]}):
                    size = sum(rows[k]["n"] for k in blocks[block] if rows[k]["order"] == order)
                    if size > left:
                        break
                    left, last = left - size, order
            for k in blocks[block]:
                more = rows[k]["n"] > 0 and (held <= rest or (rest > 0 and last is not None and rows[k]["order"] <= last))
                out[k] = (epochs + more, block, rank)
            rest = max(0, rest - held)
    return out


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_mixing(spark, docs, rows, monkeypatch, limit):
    """Draws, blocks and their order as plain loops give them; ties and repeated rows, null texts, sources and ids, blocks broadcast or not."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mixing, "join_by_key", lambda *a: shared.join_by_key(*a, limit=limit, heavy=3))
    source = F.coalesce(F.col("source"), F.lit("\x00null"))
    ranks = F.array(*(F.xxhash64(F.lit(7), F.col("_s"), F.lit(b)) for b in range(30)))
    hashed = docs.select("doc_id", "text", source.alias("_s"), F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text")).alias("order")).withColumn("ranks", ranks).collect()
    known = [{"source": r._s, "n": len((r.text or "").encode().split()), "order": r.order, "ranks": r.ranks, "id": r.doc_id} for r in hashed]
    for budget in (None, 30_000.0, 500.0):
        found = mixing.mix_sources(docs, max_repetition=3.0, budget_tokens=budget, keep_columns=True).collect()
        want = plain_draws(known, 7, 4, 3.0, budget)
        got = sorted((r.doc_id or -1, r.n_tokens, r.copies, r.block, r.block_rank) for r in found)
        assert got == sorted((known[k]["id"] or -1, known[k]["n"], *drawn) for k, drawn in want.items() if drawn[0] > 0)
        assert budget is not None or len(found) == len(rows)
    again = mixing.mix_sources(docs.repartition(7), max_repetition=3.0).select("doc_id", "copies")
    first = mixing.mix_sources(docs, max_repetition=3.0).select("doc_id", "copies")
    assert first.exceptAll(again).count() == 0 and mixing.mix_sources(docs.where("false")).count() == 0


def labelled(spark, count=600):
    """Clean, junk and insulting texts of three sites, one of them mostly junk, and labels for most."""
    rng = random.Random(9)
    pool = ["".join(rng.choice(["th", "er", "an", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for k in range(count):
        site = k % 3
        kind = rng.choices(["clean", "junk", "toxic"], [0.2, 0.7, 0.1] if site == 2 else [0.8, 0.1, 0.1])[0]
        text = [rng.choice(pool) for _ in range(rng.randint(20, 120))]
        if kind == "junk":
            text = [w + rng.choice(["%%%", "###", "$$$"]) for w in text]
        if kind == "toxic":
            text[5:5] = rng.sample(["idiot", "scum", "loser"], 2)
        docs.append((k, " ".join(text), "en", f"site{site}", kind))
        if k % 5:
            labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, kind string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    found = quality.judge_quality(docs, labels, keep_columns=True).where("doc_id % 5 = 0").collect()
    right = sum(r.keep == (r.kind == "clean") for r in found)
    assert right >= 0.95 * len(found)
    sites = {r.source: r.p_site for r in found}
    assert sites["site2"] < sites["site0"]


def plain_posteriors(rows):
    """(p_site, p_good) of each row of (host, path, p): sums in Python, the document itself left out at every level."""
    by_path, by_host = {}, {}
    for host, path, p in rows:
        for held, key in ((by_path, (host, path)), (by_host, host)):
            total, n = held.get(key, (0.0, 0))
            held[key] = total + p, n + 1
    total, count = sum(p for *_, p in rows), len(rows)
    strength = lambda mean, spread: min(max(mean * (1 - mean) / max(spread, 1e-6) - 1, 2.0), 1e6)
    rates = [s / n for s, n in by_host.values()]
    of_host = strength(total / count, sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates))
    rate = {h: s / n for h, (s, n) in by_host.items()}
    within = sum((s / n - rate[h]) ** 2 for (h, _), (s, n) in by_path.items()) / len(by_path)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for host, path, p in rows:
        prior = (total - p) / (count - 1) if count > 1 else p
        up = (by_host[host][0] - p + of_host * prior) / (by_host[host][1] - 1 + of_host)
        k = strength(rate[host], within)
        site = (by_path[host, path][0] - p + k * up) / (by_path[host, path][1] - 1 + k)
        out.append((site, 1 / (1 + math.exp(-(logit(p) + logit(site) - logit(prior))))))
    return out


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_posteriors_equal_a_plain_version(spark, monkeypatch, limit):
    """Sites are broadcast, or the heaviest of them alone; both give what sums in Python give."""
    monkeypatch.setattr(quality, "join_by_key", lambda *a: shared.join_by_key(*a, limit=limit, heavy=3))
    docs, labels = labelled(spark, 300)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("l"), (F.col("doc_id") % 4).cast("string")))).withColumn("source", F.when(F.col("doc_id") == 299, "alone").otherwise(F.col("source")))
    found = quality.judge_quality(docs, labels).collect()
    want = plain_posteriors([(r.source, r.lang, r.p_doc) for r in found])
    assert len(found) == 300 and all(abs(r.p_site - site) < 1e-9 and abs(r.p_good - good) < 1e-9 and r.keep == (good >= 0.5) for r, (site, good) in zip(found, want, strict=True))
    assert max(abs(r.p_doc - r.p_good) for r in found) > 0.01
    alone = quality.judge_quality(docs.limit(1), labels).first()
    assert abs(alone.p_doc - alone.p_good) < 1e-5


def test_join_by_key(spark, tmp_path):
    """Heavy and light keys, keys without a row, and null keys, with a broadcast of all and of the heavy ones alone."""
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 10}" if k % 3 else None) for k in range(200)], "id long, key string")
    rows.where("key != 'k4'").groupBy(F.col("key").alias("own")).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    want = {(r.id, r.key): r.n for r in rows.join(table, F.col("key") == F.col("own"), "left").collect()}
    for limit in (1 << 30, 0):
        for heavy in (2, 1000):
            got = shared.join_by_key(rows, table, {"key": "own"}, "n", limit=limit, heavy=heavy).collect()
            assert len(got) == 200 and {(r.id, r.key): r.n for r in got} == want


def test_quality_on_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (10, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.judge_quality(docs, labels, keep_columns=True)
    assert found.count() == docs.count() and found.where("keep").count() == docs.count() and len(set(found.columns)) == len(found.columns)
    assert quality.judge_quality(docs, labels.where("false")).where("keep").count() == docs.count()
    assert quality.judge_quality(empty, labels).count() == 0


def plain_edits(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_alignment_at_random():
    rng = random.Random(1)
    codes = decontaminate.codes
    for _ in range(1500):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(3, 14)))
        noise = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        text, budget = noise() + "".join(c for c in item if rng.random() > 0.1) + noise(), rng.randint(0, 4)
        if text:
            found, want = decontaminate.aligned(codes(item), codes(text), budget), plain_edits(item, text)
            assert (found is None) == (want > budget) and (found is None or found[0] == want and plain_edits(item, text[found[1] : found[2]]) == want)


def spoil(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(out) - 1)
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
    return "".join(out)


def test_decontamination(spark, empty):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice(["th", "er", "an", "on", "re", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(k, prose(rng.randint(12, 60))) for k in range(30)] + [(90, "too short"), (91, None), (None, prose(30))]
    docs, leaks = [], set()
    for k in range(120):
        text = prose(rng.randint(0, 200))
        if k % 3 == 0:
            own = rng.randrange(30)
            held = spoil(rng, items[own][1], rng.randint(0, int(0.03 * len(items[own][1]))))
            text = f"{text}\n {held.upper() if k % 2 else held.replace(' ', '  ')} {prose(20)}"
            leaks.add((k, own))
        if k % 3 == 1:
            text += " " + items[k % 30][1][: len(items[k % 30][1]) // 2]
        docs.append((k, text))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1] + " " + items[1][1])]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.benchmark_passages(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == leaks | {(None, 0), (502, 1)} and sum(r.doc_id == 502 for r in found) == 2
    texts = dict(docs)
    for r in found:
        assert decontaminate.fold(texts[r.doc_id])[r.start : r.end] == r.passage and plain_edits(decontaminate.fold(items[r.item_id][1]), r.passage) == r.edits
    clean = decontaminate.without_passages(table.withColumn("passage", F.lit(1)), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs if d is not None} - {d for d, _ in got}
    assert decontaminate.benchmark_passages(empty, bench).count() == 0 and decontaminate.benchmark_passages(table, bench.where("false")).count() == 0
    assert decontaminate.without_passages(table, bench.where("false")).count() == len(docs)


def test_decontamination_equals_a_whole_scan(spark):
    """Every item against every text by a full table of edits: found if and only if some place is within the budget, up to the bound and beyond it."""
    rng = random.Random(31)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()
    items = [(k, prose(rng.randint(45, 110))) for k in range(8)]
    docs = []
    for k in range(48):
        item = decontaminate.fold(items[k % 8][1])
        budget = decontaminate.edit_budget(len(item), 0.07, 12)
        out = list(item)
        # Edits as far apart as they can be, which shared q-grams are fewest for: from none to two beyond the budget.
        for e in range(edits := k // 8 * (budget + 2) // 5):
            at = min(len(out) - 1, (e + 1) * len(out) // (edits + 1))
            out[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[:1]])
        docs.append((k, f"{prose(60)} {''.join(out)} {prose(60)}"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, text in docs:
        for i, item in items:
            own = decontaminate.fold(item)
            if plain_edits(own, decontaminate.fold(text)) <= decontaminate.edit_budget(len(own), 0.07, 12):
                want.add((d, i))
    assert found == want and 24 <= len(want) < 48


def test_short_items(spark):
    """Without edits, as whole words, however short; with longer ones beside them."""
    items = [(1, "Yes"), (2, "two  words"), (3, "what is it?"), (4, "yes"), (5, " "), (6, "a longer item that is searched for with edits in it")]
    docs = [(1, "yes, YES yes"), (2, "eyes yesterday"), (3, "Two\nwords two wordsmith"), (4, "So what is it? What is it?!"), (5, "A longer item that is searchd for with edits in it"), (6, None)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.benchmark_passages(table, bench).collect())
    assert found == [*((1, i, s, s + 3, 0) for i in (1, 4) for s in (0, 5, 9)), (3, 2, 0, 9, 0), (4, 3, 3, 14, 0), (4, 3, 15, 26, 0), (5, 6, 0, 50, 1)]
    assert {r.doc_id for r in decontaminate.without_passages(table, bench).collect()} == {2, 6}


def test_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 60)
    items = [(k, f"item {k} " + "abcdefghij klmnop " * (k + 3)) for k in range(4)]
    table = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    found = decontaminate.benchmark_passages(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(k, k) for k in range(4)} <= {(r.doc_id, r.item_id) for r in found}


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    kinds = {r.doc_id: r.kind for r in docs.collect()}
    copies = docs.where("kind = 'clean'").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", F.lit("copy").alias("kind")).limit(20)
    item = "the passage of a public benchmark that no training text may hold, as it stands in the test"
    leak = spark.createDataFrame([(5000, "on the an " * 30 + item, "en", "site0", "leak")], docs.schema)
    whole = docs.union(copies).union(leak).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {k for k, kind in kinds.items() if kind == "clean"}
    assert len(clean & found.keys()) >= 0.95 * len(clean) and len(found.keys() - clean) <= 0.05 * len(kinds)
    assert not found.keys() & {5000} and not any(k >= 1000 for k in found) and all(r.copies >= 1 for r in found.values())


def test_stages_on_empty_tables(spark, tmp_path, empty):
    labelled(spark, 30)[1].where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "mixing" or out.columns == empty.columns)


def test_stages_on_odd_tables(spark, tmp_path, docs, rows):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and columns of the operators' own names go through every stage."""
    labelled(spark, 30)[1].where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no document of the corpus holds this passage of a public benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "mixing" or out.columns == docs.columns
        now = shared.Scratch(spark).table(out)
        counts.append(now.count())
    # Nothing is judged, lines go but no documents; then one of each group of copies stays, and the rest to the end.
    assert counts[:2] == [len(rows)] * 2 and counts[2] == counts[3] == counts[4] < len(rows)
    # The one line of six copies stays in the last of them, 45, with which go the texts that differ in a word; the other five are empty then.
    # Null, empty and blank texts are one group.
    kept = [r.doc_id for r in now.select("doc_id").collect()]
    assert not set(kept) & {*range(40, 45), *range(50, 56), 2, 3} and {45, 1, None} <= set(kept) and kept.count(70) == kept.count(71) == 2


def test_vectors_between_crowds(spark):
    """Pairs just above the threshold all over, and a crowd that is wider than the margin: at least 999 in 1000 links with the query's own parameters."""
    rng = np.random.default_rng(13)
    count, width = 8000, 32
    rows = rng.standard_normal((count, width))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[:3000] = rows[0] + rng.standard_normal((3000, width)) * math.sqrt((1 / 0.9 - 1) / width)
    for k in range(4000, 8000, 2):
        other = rng.standard_normal(width)
        other -= (other @ rows[k]) * rows[k]
        rows[k + 1] = 0.951 * rows[k] + math.sqrt(1 - 0.951**2) * other / np.linalg.norm(other)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(table).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert (want[4000:] >= 1).all() and want[:3000].sum() > 10_000 and all(found[k] <= want[k] for k in range(count))
    for part in (slice(0, 3000), slice(4000, 8000)):
        assert sum(found[k] for k in range(count)[part]) >= 0.999 * want[part].sum()


def test_vectors_of_a_crowded_direction(spark):
    """With the query's own parameters no link of a crowd about the threshold is lost."""
    rng = np.random.default_rng(12)
    count, width = 9000, 64
    rows = rng.standard_normal((count, width))
    centre = rng.standard_normal(width)
    rows[: count // 3] = centre / np.linalg.norm(centre) + rng.standard_normal((count // 3, width)) * math.sqrt((1 / 0.95 - 1) / width)
    rows = rows.astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(table, threshold=0.95).collect()}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert want.sum() > 1_000_000 and sum(found.values()) == want.sum() and [found[k] for k in range(count)] == want.tolist()


def test_quality_of_a_small_language(spark):
    """Insults that a few labelled documents hold, of a language of its own, are learned."""
    docs, labels = labelled(spark)
    rng = random.Random(14)
    pool = ["".join(rng.choice(["ka", "lo", "mi", "su", "te"]) for _ in range(rng.randint(2, 4))) for _ in range(400)]
    insults, own, marks = ["vorgak", "zubbin", "drexul", "plonga"], [], []
    for k in range(72):
        text = [rng.choice(pool) for _ in range(rng.randint(20, 120))]
        if toxic := k % 6 == 0:
            text[5:5] = [insults[k // 6 % 4], insults[(k // 6 + 1) % 4]]
        own.append((2000 + k, " ".join(text), "xx", "site9", "toxic" if toxic else "clean"))
        if k < 60:
            marks.append((2000 + k, 1, int(toxic)))
    whole = docs.union(spark.createDataFrame(own, docs.schema))
    found = quality.judge_quality(whole, labels.union(spark.createDataFrame(marks, labels.schema)), keep_columns=True).where("doc_id >= 2060").collect()
    assert len(found) == 12 and all(r.keep == (r.kind == "clean") for r in found)


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    """Rows go to the workers by their bytes, and a text that is among the kept columns goes once. Before, all 32 MB went as one batch, twice."""

    def sized(model, text_col):
        def run(batches):
            for batch in batches:
                seen = pa.array([float(batch.nbytes)] * len(batch), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "_text"), seen], names=[*(n for n in batch.schema.names if n != "_text"), "p_doc"])

        return run

    monkeypatch.setattr(quality, "_scored", sized)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(1600).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.repeat(F.lit("word "), 4000).alias("text"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    try:
        found = quality.judge_quality(docs, labels, keep_columns=True)
        assert found.count() == 1600
        assert found.agg(F.max("p_doc")).first()[0] < 1.1 * shared.BATCH_BYTES
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1000)
        shared.bound_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_quality_same_in_any_batches(spark):
    """Texts within the rows and beside them, in slices and in batches, are scored alike."""
    docs = spark.range(2500).coalesce(1).select(
        F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"), F.lit("en").alias("lang"), F.when(F.col("id") % 11 > 0, F.concat_ws(" ", F.lit("good text"), F.col("id") % 97, F.when(F.col("id") % 3 == 0, "spam spam"))).alias("text")
    )
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    with_texts, without = ({r.doc_id: (r.p_doc, r.keep) for r in quality.judge_quality(docs, labels, keep_columns=k).collect()} for k in (True, False))
    assert len(with_texts) == 2500 and with_texts == without
    assert len({p for p, _ in with_texts.values()}) > 3
