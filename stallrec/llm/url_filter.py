"""URL filter: host and path rules, else a ratio of character language models.

Two variable-order Markov models are counted from the URLs that the rules accept and
reject. A model interpolates contexts of 0 to 3 characters by Witten-Bell smoothing: a
context seen often speaks for itself, a rare one hands over to the next shorter. A URL's
score is the mean over its characters of log P(accepted model) - log P(rejected model), and
the cutoff is the one with the least balanced error on labelled URLs that the models have
not seen.

URLs are read in an alphabet of 40 signs (letters a-z, all digits as one, 11 marks, one sign
for the rest, one for the start), so there are at most 40**4 counts per model whatever the
number of URLs: that is the size bound of what is broadcast (10 MB). Counting covers every
labelled URL and is a grouped sum in Spark.

Defined cases: a null URL or one without ``://`` has empty host and path, meets no rule and
scores 0; with labels of one kind only, the method gives that kind, and without any labels
it allows; repeated rows are judged alike and counted each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallrec.llm.common import map_rows
from stallrec.session import cut_lineage

#: Fixed values: (rule host, rule path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
START, REST = 0, 39
SIGNS = "abcdefghijklmnopqrstuvwxyz0./:?&=#-_%~"
A = 40
ORDER = 3
FOLDS = 5
STEP = 1000  # scores are compared in thousandths


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host and path."""
    marked = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(marked > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(F.col("_rest"), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.col("_rest"), r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("_rest", rest).withColumn("host", lowered).withColumn("path", path).drop("_rest")


def rule_column(rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    best = F.lit(None)
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        hit = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, hit).otherwise(best)
    return best


def signs(url: str | None) -> np.ndarray:
    """Codes of the URL's characters, A-Z lower-cased, with three start signs before them."""
    points = np.frombuffer((url or "").encode("utf-32-le"), np.uint32)
    return np.r_[np.full(ORDER, START), _CODE[np.minimum(points, 128)]].astype(np.int64)


def _code_table() -> np.ndarray:
    table = np.full(129, REST)
    for n, sign in enumerate(SIGNS):
        table[ord(sign)] = n + 1
        table[ord(sign.upper())] = n + 1
    table[ord("0") : ord("9") + 1] = SIGNS.index("0") + 1
    return table


_CODE = _code_table()


def windows(url: str | None) -> np.ndarray:
    """One number per character: it and the three signs before it, in base 40."""
    s = signs(url)
    return ((s[:-3] * A + s[1:-2]) * A + s[2:-1]) * A + s[3:]


def counts(labelled: DataFrame) -> DataFrame:
    """verdict, gram, n over all rows of labelled (url, verdict)."""

    def start():
        return lambda columns: {"grams": [windows(u).astype(np.int32) for u in columns["url"].to_pylist()]}

    exploded = map_rows(labelled.select("url", "verdict"), start, {"grams": "array<int>"}).select(
        "verdict", F.explode("grams").alias("gram")
    )
    return exploded.groupBy("verdict", "gram").agg(F.count("*").alias("n"))


def log_model(full: np.ndarray) -> np.ndarray:
    """log P(last sign | signs before) of every window, from its counts."""
    full = full.reshape((A,) * (ORDER + 1)).astype(np.float64)
    chance = np.full(A, 1.0 / A)
    for order in range(ORDER + 1):
        seen = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full
        total, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        back = np.broadcast_to(chance, seen.shape)
        weight = np.maximum(total + kinds, 1)
        chance = np.where(total > 0, (seen + kinds * back) / weight, back)
    return np.log(chance).astype(np.float32)


def fit_ratio(labelled: DataFrame) -> np.ndarray | None:
    """Log ratio of every window; None unless both verdicts occur."""
    rows = counts(labelled).toPandas()  # at most 2 * 40**4 rows
    models = {}
    for verdict in ("allow", "block"):
        part = rows[rows["verdict"] == verdict]
        if part.empty:
            return None
        full = np.zeros(A ** (ORDER + 1))
        full[part["gram"].to_numpy()] = part["n"].to_numpy()
        models[verdict] = log_model(full)
    return (models["allow"] - models["block"]).reshape(-1)


def with_score(urls: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Add score, in thousandths, rounded down; no characters score 0."""
    held = urls.sparkSession.sparkContext.broadcast(ratio)

    def start():
        table = held.value

        def score(url):
            at = windows(url)
            return int(np.floor(STEP * float(table[at].mean(dtype=np.float64)))) if len(at) else 0

        return lambda columns: {"score": [score(u) for u in columns["url"].to_pylist()]}

    return map_rows(urls, start, {"score": "long"})


def calibrate(scored: DataFrame) -> int:
    """The cutoff (a score at or above it allows) with the least balanced error; of equals the least.
    It lies midway between the scores on both sides, so unseen URLs have the same room either way.

    What reaches the driver is a histogram in thousandths of a bounded score.
    """
    rows = scored.groupBy("score").agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad")
    )
    bins = sorted(rows.collect())
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return 0
    best, at, lost, passed = 2.0, 0, 0, bad
    before = bins[0]["score"]
    for row in bins:
        error = lost / good + passed / bad
        if error < best:
            best, at = error, -(-(before + row["score"]) // 2)
        before = row["score"]
        lost, passed = lost + row["good"], passed - row["bad"]
    return at


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page (page_id, url)."""
    parted = with_parts(pages.select("page_id", "url")).withColumn("_hit", rule_column(rules))
    labelled = cut_lineage(
        parted.filter("_hit IS NOT NULL").select("url", F.col("_hit.verdict").alias("verdict"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold"))
    )
    ratio = fit_ratio(labelled.filter("fold <> 0"))
    if ratio is None:
        kinds = {r["verdict"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        only = kinds.pop() if len(kinds) == 1 else "allow"
        judged = parted.withColumn("score", F.lit(0).cast("long")).withColumn("_said", F.lit(only))
    else:
        cutoff = calibrate(with_score(labelled.filter("fold = 0").select("url", "verdict"), ratio))
        judged = with_score(parted, ratio).withColumn("_said", F.when(F.col("score") >= cutoff, "allow").otherwise("block"))
    return judged.select(
        "page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", "_said").alias("verdict"), "score"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
