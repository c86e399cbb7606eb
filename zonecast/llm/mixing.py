"""Sources mixed to tempered weights, realised as budgeted permutations of blocks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.shared import Scratch, join_by_key

#: Documents of a block, about: the most rows that one task sorts.
BLOCK_DOCS = 4096
#: Columns that the result adds; it leaves out the documents' own of these names.
RESULT = ("n_tokens", "weight", "block", "block_rank", "copies")
WORDS = r"[^\x20\x09-\x0D]+"


class Mix(NamedTuple):
    exponent: float
    #: A source's weight is its share raised to the exponent, over this.
    norm: float
    budget: float
    total: int

    def weight(self, tokens: int) -> float:
        return (tokens / self.total) ** self.exponent / self.norm if tokens > 0 else 0.0


def entropy(weights: np.ndarray, times: np.ndarray) -> float:
    return float(-(times * weights * np.log(weights)).sum())


def solve(tokens: list[int], times: list[int], target_entropy: float | None, max_repetition: float | None, budget: float | None, steps: int = 60) -> Mix:
    """The least exponent in [0, 1] (the flattest mix) that keeps to the repetition limit, or the one that meets the target entropy.

    Given are the token counts that sources have, and how many sources have each. Entropy falls and the largest repetition
    falls as the exponent rises, so both are bisected. Without a budget it is the least that draws every token of every source at least once.
    """
    held, number = np.array(tokens, float), np.array(times, float)
    held, number = held[held > 0], number[held > 0]
    total = int((held * number).sum())
    if not total:
        return Mix(1.0, 1.0, 0.0, 1)
    logs = np.log(held / total)

    def tempered(exponent: float) -> tuple[np.ndarray, float, float]:
        """(weights, norm, budget)"""
        raised = np.exp(exponent * logs)
        norm = float((raised * number).sum())
        return raised / norm, norm, budget if budget is not None else float((held / (raised / norm)).max())

    def fits(exponent: float) -> bool:
        weights, _, drawn = tempered(exponent)
        if target_entropy is not None:
            return entropy(weights, number) <= target_entropy
        return max_repetition is None or float((drawn * weights / held).max()) <= max_repetition

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    elif fits(high):
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    _, norm, drawn = tempered(high)
    return Mix(high, norm, drawn, total)


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = 4.0,
    budget_tokens: float | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_columns: bool = False,
) -> DataFrame:
    """A row for each document that is drawn: its columns (or id and source), n_tokens, weight, block, block_rank, copies.

    Weights are the sources' token shares raised to an exponent and normalised; the exponent is bisected to meet
    ``target_entropy`` (nats) or else ``max_repetition``. A source's part of the budget is whole epochs plus a rest: each
    document is drawn once per epoch, and the blocks of the source, in an order permuted by the seed, once more until the
    rest is used; within the last block documents are taken in permuted order, while they fit. ``copies`` is the number
    of draws; documents with none are left out. With no budget given, every document is drawn at least once.

    Tokens are runs without ASCII white space. Documents without tokens are drawn once per epoch, at no cost. A null source
    is one source of its own; a null text is empty; repeated rows are drawn alike. Any number of sources will do: the driver gets the
    distinct token counts of sources, which are fewer than the root of twice the tokens. An empty table gives an empty result.
    Columns of the names that the result adds are replaced. Texts are read once, and are not shuffled while a row for each block of
    ``BLOCK_DOCS`` documents can be broadcast; where it cannot, see join_by_key.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep_columns else (id_col, source_col)) if c not in RESULT]
    own = F.struct(*(F.col(c) for c in names)).alias("_row")
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null"))
    shuffle = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    marked = docs.select(own, tokens.alias("n_tokens"), source.alias("_source"), shuffle.alias("_order"))
    # Counted once: what follows reads the counts, and the texts only where they are asked for.
    scratch = Scratch(spark)
    counted = scratch.table(marked)
    sums = scratch.table(counted.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    kinds = sums.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    mix = solve([r.tokens for r in kinds], [r.n for r in kinds], target_entropy, max_repetition, budget_tokens)
    share = F.col("tokens") / F.lit(float(mix.total))
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(mix.exponent) * F.log(share)) / F.lit(mix.norm)).otherwise(0.0)
    # Whole epochs and the tokens of the rest; a source without tokens has one epoch.
    part = F.floor(F.lit(mix.budget) * F.col("weight") * (1 + 1e-12) + 1e-6).cast("long")
    plan = scratch.table(
        sums.withColumn("weight", weight).withColumn("part", part).select(
            F.col("_source").alias("_plan"),
            "docs",
            "weight",
            F.ceil(F.col("docs") / BLOCK_DOCS).cast("int").alias("blocks"),
            F.when(F.col("tokens") > 0, F.floor(F.col("part") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long").alias("epochs"),
            F.when(F.col("tokens") > 0, F.col("part") % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long").alias("rest"),
        )
    )

    def in_blocks(rows: DataFrame) -> DataFrame:
        return join_by_key(rows, plan, {"_source": "_plan"}, "docs").withColumn("block", F.pmod("_order", F.col("blocks")).cast("int"))

    dealt = in_blocks(counted.select("_source", "n_tokens", "_order"))
    keys = ("_source", "block")
    sizes = dealt.groupBy(*keys).agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("own_rest"), F.count(F.lit(1)).alias("own_docs"))
    # A row for each block, so that a source's window is small whatever the source's share.
    permuted = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_source", "block"), "block")
    ranked = scratch.table(
        sizes.select(
            *keys,
            (F.row_number().over(permuted) - 1).alias("block_rank"),
            (F.sum("held").over(permuted) - F.col("held")).alias("before"),
            "held",
            "own_rest",
            "own_docs",
        )
    )
    # The block of each source, one at most, that the rest ends in.
    partial = ranked.where("before < own_rest and before + held > own_rest").select(F.col("_source").alias("_p"), F.col("block").alias("_b"), "before", "own_rest", "own_docs")
    inside = Window.partitionBy("_source", "block").orderBy("_order", "n_tokens")
    ending = join_by_key(dealt.select("_source", "block", "_order", "n_tokens"), scratch.table(partial), {"_source": "_p", "block": "_b"}, "own_docs").where("before is not null")
    cut = (
        ending.withColumn("upto", F.sum("n_tokens").over(inside))
        .where("before + upto <= own_rest")
        .groupBy(F.col("_source").alias("_c"), F.col("block").alias("_d"))
        .agg(F.max("_order").alias("last"))
    )
    whole = ranked.select(F.col("_source").alias("_r"), F.col("block").alias("_k"), "block_rank", (F.col("before") + F.col("held") <= F.col("own_rest")).alias("full"), "own_docs")
    told = scratch.table(whole.join(cut, (F.col("_r") == F.col("_c")) & (F.col("_k") == F.col("_d")), "left").drop("_c", "_d"))
    joined = join_by_key(in_blocks(counted), told, {"_source": "_r", "block": "_k"}, "own_docs")
    extra = (F.col("full") | F.coalesce(F.col("_order") <= F.col("last"), F.lit(False))) & (F.col("n_tokens") > 0)
    copies = F.col("epochs") + extra.cast("long")
    return joined.select("_row.*", "n_tokens", "weight", "block", "block_rank", copies.alias("copies")).where("copies > 0")
