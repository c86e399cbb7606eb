"""Document quality: a trained classifier's evidence, combined with empirical Bayes posteriors of host and path."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.llm.shared import Scratch, bound_batches, join_by_key

#: Labelled documents that the classifier is fit on, at most: those of the least id hashes.
TRAIN_ROWS = 20_000
#: Words of a label's vocabulary, the documents that a word needs, and its least evidence in nats.
VOCABULARY, LEAST_DOCS, LEAST_EVIDENCE = 5000, 2, 1.5
#: Documents that a word's evidence is shrunk by.
SHRINK = 2
#: Characters of a word's beginning.
STEM = 5
#: Rows that a worker scores and sends on at a time.
SCORED_ROWS = 1000
LABELS = ("low_quality", "toxic")
WORD = re.compile(r"\w+")

_CLASSES = np.zeros((256, 6))
for _code in range(256):
    _char = chr(_code)
    _CLASSES[_code] = [
        _char.isascii() and _char.isupper(),
        _char.isascii() and _char.isdigit(),
        _char.isascii() and not _char.isalnum() and not _char.isspace() and _char not in ".,;:'\"-()?",
        _char in ".,;:?",
        _char == "\n",
        _char in " \t",
    ]


def words_of(text: str) -> set[str]:
    """The distinct words, and the beginnings of the longer ones, which stand for forms that the sample lacks."""
    found = set(WORD.findall(text.lower()))
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


def shape(text: str, words: list[str]) -> list[float]:
    """What a text looks like, whatever its words and length."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256) @ _CLASSES
    size, number = max(1, len(data)), max(1, len(words))
    upper, digits, symbols, stops, lines, spaces = (counts / size).tolist()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / number
    return [
        math.log1p(len(words)),
        min(1.0, 10 * symbols),
        min(1.0, 4 * upper),
        min(1.0, 10 * digits),
        min(1.0, 10 * stops),
        min(1.0, 10 * lines),
        4 * spaces,
        len(set(words)) / number ** 0.9,
        same,
        min(2.0, size / number / 10),
    ]


class Model(NamedTuple):
    #: Evidence of words, by label.
    words: tuple[dict[str, float], ...]
    #: Mean, scale, and weights with the bias first, by label.
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, text: str) -> list[float]:
        """The text's shape, and for each label the sum of its five strongest words and the number of all that are known.

        All words of the text are looked up. A sum over all would grow with a text's length, as every word has some chance to be there.
        """
        tokens = text.split()
        found = words_of(text)
        row = shape(text, tokens)
        for known in self.words:
            evidence = sorted((known[w] for w in found & known.keys()), reverse=True)
            row += [min(10.0, sum(evidence[:5])), math.log1p(len(evidence))]
        return row

    def probabilities(self, text: str) -> list[float]:
        row = (np.array(self.features(text)) - self.mean) / self.scale
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + float(w[1:] @ row))))) for w in self.weights]


def fit_logistic(rows: np.ndarray, target: np.ndarray, decay: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; rows are standardised, the bias comes first and has no penalty."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    penalty = np.full(x.shape[1], decay)
    penalty[0] = 1e-3
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + penalty * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, rows = [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            own = words_of(text)
            words += own
            rows += [k] * len(own)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(batch.column(c).take(at) for c in ("half", *LABELS))], names=["word", "half", *LABELS])


def _count(half: int, label: str | None = None) -> Column:
    """Documents of one half, of the label if there is one."""
    return F.coalesce(F.sum(F.when(F.col("half") == half, F.col(label) if label else F.lit(1))), F.lit(0)).alias(f"{label or 'rows'}_{half}")


COUNTS = [(half, label) for half in (0, 1) for label in (None, *LABELS)]


def _vocabulary(counts: DataFrame, label: str, totals: dict[str, int], halves: tuple[int, ...]) -> dict[str, float]:
    """The words that speak most for a label in these halves: smoothed log-odds of being in its documents against the rest."""
    yes = sum(totals[f"{label}_{h}"] for h in halves)
    no = sum(totals[f"rows_{h}"] for h in halves) - yes
    if not yes or not no:
        return {}
    own = counts.select("word", sum((F.col(f"{label}_{h}") for h in halves), F.lit(0)).alias("yes"), sum((F.col(f"rows_{h}") for h in halves), F.lit(0)).alias("all"))
    evidence = F.log((F.col("yes") + 1) / (yes + 2)) - F.log((F.col("all") - F.col("yes") + 1) / (no + 2))
    known = own.where(F.col("yes") >= LEAST_DOCS).select("word", (evidence * F.col("yes") / (F.col("yes") + SHRINK)).alias("e"), "yes").where(F.col("e") >= LEAST_EVIDENCE)
    return {r.word: r.e for r in known.orderBy(F.desc(F.col("e") * F.sqrt("yes")), "word").limit(VOCABULARY).collect()}


def train_model(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """A model for both labels. Words are learned from the whole labelled sample; the weights are fit across: each half's words by the other half's evidence."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.lit(1) - F.col("quality"), F.lit(0))).cast("int").alias("low_quality"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    # The sample is bounded by train_rows.
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select(F.col("doc_id").alias("_id"), *LABELS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    joined = docs.select(F.col(id_col).alias("_doc"), text).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    half = F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("half")
    train = scratch.table(joined.select("text", *LABELS, half).dropDuplicates(["text"]))
    totals = train.agg(*(_count(*c) for c in COUNTS)).first().asDict()
    exploded = train.mapInArrow(_exploded, "word string, half int, low_quality int, toxic int")
    counts = scratch.table(exploded.groupBy("word").agg(*(_count(*c) for c in COUNTS)))
    words = tuple(_vocabulary(counts, label, totals, (0, 1)) for label in LABELS)
    width = len(shape("", [])) + 2 * len(LABELS)
    sure = np.array([-30.0, *np.zeros(width)])
    blank = Model(words, np.zeros(width), np.ones(width), np.array([sure] * len(LABELS)))
    across = [blank._replace(words=tuple(_vocabulary(counts, label, totals, (1 - h,)) for label in LABELS)) for h in (0, 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [across[h].features(t) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *(batch.column(c) for c in LABELS)], names=["x", *LABELS])

    held = train.mapInArrow(features, "x array<double>, low_quality int, toxic int").collect()
    if not held:
        return blank
    rows = np.array([r.x for r in held])
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-3)
    fits = []
    for label in LABELS:
        target = np.array([r[label] for r in held], float)
        fits.append(fit_logistic((rows - mean) / scale, target) if 0 < target.sum() < len(target) else sure if not target.sum() else -sure)
    return Model(words, mean, scale, np.array(fits))


def _scored(model: Model, text_col: str | None):
    """Adds p_doc of the text in _text, or in that field of _row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(k, SCORED_ROWS)
                texts = batch.column("_row").field(text_col) if text_col else batch.column("_text")
                found = [model.probabilities(text.as_py() or "") for text in texts]
                good = pa.array([math.prod(1 - p for p in row) for row in found], pa.float64())
                names = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), good], names=[*names, "p_doc"])

    return run


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def _strength(mean: Column, spread: Column) -> Column:
    """The number of documents that a beta prior of the parent's mean is worth, from the spread of the siblings' means."""
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(spread, F.lit(1e-6)) - 1, F.lit(2.0)), F.lit(1e6))


def site_sums(scored: DataFrame) -> DataFrame:
    """One row for each path: the documents and the sum of p_doc of the path, of its host and of the whole, and the strengths of the priors of both levels.

    All from grouped sums that merge on the map side: one row per path, then per host, then one.
    """
    paths = scored.groupBy(F.col("_host").alias("_h"), F.col("_path").alias("_p")).agg(F.sum("p_doc").alias("path_sum"), F.count(F.lit(1)).alias("path_n"))
    hosts = paths.groupBy("_h").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    # One row each, and numbers from then on.
    of_host = F.col("host_sum") / F.col("host_n")
    whole = hosts.agg(F.sum("host_sum").alias("sum"), F.sum("host_n").alias("n"), F.coalesce(F.var_pop(of_host), F.lit(0.0)).alias("spread")).first()
    joined = paths.join(hosts.withColumnRenamed("_h", "_k"), F.col("_h") == F.col("_k")).drop("_k")
    within = joined.agg(F.coalesce(F.avg((F.col("path_sum") / F.col("path_n") - of_host) ** 2), F.lit(0.0)).alias("within")).first()["within"]
    mean = F.lit((whole["sum"] or 0.0) / (whole["n"] or 1))
    return joined.withColumns(
        {
            "whole_sum": F.lit(whole["sum"]).cast("double"),
            "whole_n": F.lit(whole["n"]).cast("long"),
            "host_strength": _strength(mean, F.lit(whole["spread"])),
            "path_strength": _strength(of_host, F.lit(within)),
        }
    )


def site_posterior(p: Column) -> tuple[Column, Column]:
    """(site, prior) of a document beside its site's sums: the posterior mean of its path, shrunk toward its host's and that toward the whole's.

    The document's own p is left out of all three, or it would count twice; of a single document nothing else is known.
    """
    prior = F.when(F.col("whole_n") > 1, (F.col("whole_sum") - p) / (F.col("whole_n") - 1)).otherwise(p)
    host = (F.col("host_sum") - p + F.col("host_strength") * prior) / (F.col("host_n") - 1 + F.col("host_strength"))
    return (F.col("path_sum") - p + F.col("path_strength") * host) / (F.col("path_n") - 1 + F.col("path_strength")), prior


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    keep_columns: bool = False,
) -> DataFrame:
    """One row per input row: its id, host and path (or all its columns), p_doc, p_site, p_good, keep.

    p_doc is the classifier's probability that the document is neither of low quality nor toxic; p_site is the shrunk share
    of good documents among the others of its host and path. p_good has the document's log-odds, moved by the difference between
    those of the site and of the prior; ``keep`` says whether it reaches the threshold. A null host or path is a
    site of its own, a null text is empty; repeated rows are scored alike; labels with a null id or none that match
    leave the classifier without evidence, and then every row is kept; an empty table gives an empty result. Columns of
    the names that the result adds are replaced.

    Workers get bounded batches, by bound_batches. Documents are not shuffled: sites are few and are broadcast, and where they are not, see join_by_key.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    model = train_model(docs, labels, scratch, id_col, text_col, train_rows)
    added = ("p_doc", "p_site", "p_good", "keep")
    names = [c for c in (docs.columns if keep_columns else (id_col, host_col, path_col)) if c not in added]
    site = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias(a) for c, a in ((host_col, "_host"), (path_col, "_path"))]
    # A text that the row holds is sent to the workers once.
    held = text_col if text_col in names and dict(docs.dtypes)[text_col] == "string" else None
    source = docs.select(F.struct(*names).alias("_row"), *site, *([] if held else [F.col(text_col).cast("string").alias("_text")]))
    schema = source.drop("_text").schema.add("p_doc", "double")
    scored = scratch.table(source.mapInArrow(_scored(model, held), schema))
    sites = scratch.table(site_sums(scored.select("_host", "_path", "p_doc")))
    joined = join_by_key(scored, sites, {"_host": "_h", "_path": "_p"}, "path_n")
    own, prior = site_posterior(F.col("p_doc"))
    good = 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + _logit(F.col("p_site")) - _logit(F.col("_prior")))))
    placed = joined.select("_row", "p_doc", own.alias("p_site"), prior.alias("_prior"))
    return placed.select("_row.*", "p_doc", "p_site", good.alias("p_good")).withColumn("keep", F.col("p_good") >= threshold)
