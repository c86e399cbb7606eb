"""URL filter: rules by host and path first, then a logistic model on hashed character n-grams, all in SQL functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of urls to block and of others, for the model that is trained where the caller has no labelled table. Fixed values, invented.
BLOCKED_WORDS = (
    "casino slots poker betting jackpot bingo roulette gamble viagra pills pharmacy meds steroids loan payday lender "
    "porn xxx adult escort nude sexcam webcam replica watches counterfeit crack keygen warez torrent "
    "clickbait spam linkfarm seofarm adserver adtrack tracker pixel malware phishing"
).split()
FINE_WORDS = (
    "university library museum science history research weather recipes travel garden school college "
    "docs manual guide article news journal archive catalog wiki forum blog photo album "
    "music theatre sports health council village mountain river orchard northern"
).split()
#: The commonest pairs of letters of English: names made of them are of no kind, and are not blocked.
PAIRS = "th he in er an re nd on en at ou ed ha to or it is hi es ng ti te st ar al le se".split()
NEUTRAL = 240
#: Forms of urls that such words stand in; word 1 is the url's own, word 2 another of its kind.
FORMS = (
    "https://{0}.example.org/en/{n}",
    "http://www.{0}-{1}.example.com/{n}.html",
    "https://m.example.net/{0}/{1}",
    "http://best{0}.example.net/de/{n}?ref=x",
    "https://thing.example.org/fr/{0}-{1}-{n}",
)
#: Labelled urls that are read, at most: those of the least hashes.
TRAIN_ROWS = 5000
#: Characters of an n-gram, buckets that n-grams are hashed to, and the factor and modulus of the hash.
SIZES, BUCKETS, FACTOR, MODULUS = (3, 4, 5), 4096, 131, 2_147_483_647


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0): every word in every form, and names of no kind in one form each, made by rule."""
    neutral = ["".join(PAIRS[(k * (5 + 2 * j) + j * j) % len(PAIRS)] for j in range(2 + k % 4)) for k in range(NEUTRAL)]
    rows = []
    for label, words, forms in ((1, BLOCKED_WORDS, 5), (0, FINE_WORDS, 5), (0, neutral, 1)):
        for k, word in enumerate(words):
            own = [FORMS[(k + f) % len(FORMS)] for f in range(forms)]
            rows += [(form.format(word, words[(k + 7) % len(words)], n=(37 * k + 11 * f) % 1000), label) for f, form in enumerate(own)]
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host in lower case from after the first :// to /, ?, # or the end, the path from there to ?, # or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, text.substr(at + F.lit(3), F.length(text))).otherwise("")
    bare = F.regexp_extract(rest, r"^([^?#]*)", 1)
    slash = F.instr(bare, "/")
    host = F.when(slash > 0, bare.substr(F.lit(1), slash - 1)).otherwise(bare)
    path = F.when(slash > 0, bare.substr(slash, F.length(bare))).otherwise("")
    return F.translate(host, UPPER, LOWER), path


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; rules are (action, host/path), a short list that goes into the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def url_text(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))


def gram_buckets(text: Column) -> Column:
    """The distinct buckets of the text's n-grams, in time that grows linearly with it: its code points are taken apart once."""
    points = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))

    def grams(own: Column, n: int) -> Column:
        def bucket(at: Column) -> Column:
            value = F.lit(n).cast("long")
            for step in range(n):
                value = (value * FACTOR + F.get(own, at + step)) % MODULUS
            return (value % BUCKETS).cast("int")

        return F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(0), F.size(own) - n), bucket)).otherwise(F.array().cast("array<int>"))

    # Bound by a lambda, the array is made once and not for every n-gram.
    return F.transform(F.array(points), lambda own: F.array_distinct(F.concat(*(grams(own, n) for n in SIZES))))[0]


def fit(rows: list[tuple[list[int], int]], rounds: int = 300, rate: float = 4.0, momentum: float = 0.95, decay: float = 1e-5) -> tuple[float, list[float]]:
    """(bias, weight of each bucket) by gradient descent with momentum over (buckets, label); each row is scaled to length 1. Without rows nothing is to be blocked."""
    if not rows:
        return -30.0, [0.0] * BUCKETS
    held = np.zeros((len(rows), BUCKETS + 1))
    for k, (buckets, _) in enumerate(rows):
        held[k, buckets] = 1 / np.sqrt(max(1, len(buckets)))
    held[:, -1] = 1.0
    target, weights, speed = np.array([y for _, y in rows], float), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        error = target - 1 / (1 + np.exp(-np.clip(held @ weights, -30, 30)))
        speed = momentum * speed + held.T @ error / len(rows) - decay * weights
        weights += rate * speed / 2
    return float(weights[-1]), weights[:-1].tolist()


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", train_rows: int = TRAIN_ROWS) -> tuple[float, list[float]]:
    """The model of a labelled table, of at most ``train_rows`` rows; rows without url or label are left out. Features come from the expressions that score."""
    known = labelled.select(F.col(url_col).cast("string").alias("_url"), F.col(label_col).cast("int").alias("_label")).na.drop()
    taken = known.orderBy(F.xxhash64("_url"), "_url", "_label").limit(train_rows)
    rows = taken.select(gram_buckets(url_text(*split_url(F.col("_url")))).alias("b"), "_label").collect()
    return fit([(r.b, r._label) for r in rows])


def default_labelled(spark: SparkSession) -> DataFrame:
    """The invented labelled table, (url, label)."""
    lines = F.split(F.lit("\n".join(f"{y} {u}" for u, y in labelled_urls())), "\n")
    parts = F.split(F.col("line"), " ")
    return spark.range(1).select(F.explode(lines).alias("line")).select(parts[1].alias("url"), parts[0].cast("int").alias("label"))


def model_score(buckets: Column, bias: float, weights: list[float]) -> Column:
    """The probability to block, from the distinct buckets of the n-grams of host and path."""
    # One literal, read once when the plan is made.
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return 1 / (1 + F.exp(-F.lit(bias) - total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; without one the model does, at ``threshold``. Null urls and urls without
    :// have empty host and path and are left to the model. Urls of any length are read whole, in linear time. Repeated rows
    repeat, null ids pass through, other columns are not read, and an empty table gives an empty result. ``labelled`` has the
    columns url and label (1 to block); without it an invented table stands in, and an empty one blocks nothing. No shuffle and no Python on the
    executors: the model is fit on the driver to the buckets of at most ``train_rows`` labelled urls, and is a constant of the plan.
    """
    bias, weights = train(default_labelled(pages.sparkSession) if labelled is None else labelled, train_rows=train_rows)
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    scored = F.transform(F.array(gram_buckets(url_text(F.col("host"), F.col("path")))), lambda b: model_score(b, bias, weights))[0]
    return (
        parts.withColumns({"rule": rule, "by_rule": verdict, "score": scored})
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", judged).alias("verdict"), "score")
    )
