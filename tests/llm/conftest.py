from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, count: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "an", "on", "re", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(count))


def corpus() -> list[tuple]:
    """Copies, near copies, shared lines and passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(11)
    texts: list[tuple[int | None, str | None]] = [(None, "A line of no id.\n" + words(rng, 30)), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one two")]
    line, passage = "  The same footer stands in many documents, MORE than forty points long ", words(rng, 60)
    for k in range(10, 30):
        texts.append((k, f"{words(rng, 40)}\n{line if k % 2 else line.lower()}\n{words(rng, 20)} {passage if k % 3 == 0 else ''} {words(rng, 10)}"))
    long = words(rng, 300)
    texts += [(k, long) for k in range(40, 46)]
    texts += [(k, long.replace(long.split()[k], "changed", 1)) for k in range(50, 56)]
    texts += [(60, words(rng, 20_000)), (61, "x" * 300_000), (62, "\n" * 2000), (70, "tie " * 100), (70, "tie " * 100), (71, words(rng, 80)), (71, words(rng, 80))]
    return [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or "")) for i, t in texts]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names the operators use themselves."""
    clash = ("fp", "component_id", "kept_text", "n_words", "hash", "gone", "g", "bucket", "weight", "copies", "block", "keep", "p_doc", "_row", "_text", "key_id")
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return made.withColumns({c: F.lit("clash") for c in clash}).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
