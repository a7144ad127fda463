"""Quality rules with risk-controlled cutoffs.

Every document gets whole-text counts. Each rule turns them into a score of 0 to 100 and
rejects above a cutoff. Cutoffs are chosen per stratum (language) on labelled documents:
from the mildest cutoff downwards, a cutoff is taken while an exact binomial test shows
that at most ``risk / number of rules`` of good documents lie above it, and the walk ends
at the first cutoff that fails. Walking one fixed order needs no correction by itself; the
error level is divided by the number of rules times strata (Bonferroni). So with
probability ``1 - error`` no stratum loses more than ``risk`` of its good documents.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; a
stratum with too few labels has no certified cutoff and its rules reject nothing; a null
language is a stratum of its own; of several labels of a document the worst counts;
repeated rows are judged alike; other columns pass through untouched.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallrec.llm.common import map_rows, split_words
from stallrec.session import cut_lineage

RISK = 0.02
ERROR = 0.05
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
OFF = 100
COUNTS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_upper": "long",
    "n_letters": "long",
    "n_exclaims": "long",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows whose word sequence occurs twice or more in the text.

    Exact: windows get equal numbers only if their halves have equal numbers, from single
    words up to 8 words, so nothing rests on a hash. ``window`` is a power of two.
    """
    if len(words) < window:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        seen, rank = np.unique(pairs, return_inverse=True)
        if len(seen) == len(pairs):
            return 0
        width *= 2
    again = np.bincount(rank)[rank] > 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.flatnonzero(again), 1)
    np.add.at(change, np.flatnonzero(again) + window, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text. Upper and lower case are those of ASCII."""
    words = split_words(text)
    if not words:
        lone = sum(text.count(chr(c)) for c in SYMBOLS) if text else 0
        return (0, 0, lone, 0, 0, 0, 0, 0, 0)
    data = text.encode()
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(seen.sum() - seen[0x80:0xC0].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    upper = int(seen[65:91].sum())
    return (
        len(words),
        points - int(seen[list(SPACE_BYTES)].sum()),
        int(seen[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + int(seen[97:123].sum()),
        int(seen[33]),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    def start():
        def make(columns):
            rows = [text_counts(t) for t in columns["text"].to_pylist()]
            return dict(zip(COUNTS, zip(*rows))) if rows else {c: [] for c in COUNTS}

        return make

    return map_rows(docs, start, COUNTS)


def share(part: str, whole: str) -> Column:
    """Whole percents, rounded down."""
    return F.coalesce(F.try_divide(F.lit(100) * F.col(part), F.col(whole)).cast("long"), F.lit(0)).cast("int")


#: Rule name -> what its score is a share of; higher is worse.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "n_letters"),
    "exclaims": ("n_exclaims", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def scores() -> Column:
    return F.array(*[F.least(share(*parts), F.lit(OFF)) for parts in RULES.values()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial; at or above the mean 1.0 stands for any value over a half."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total += term
        k -= 1
    return math.exp(log) * total


def certified(above: np.ndarray, n: int, risk: float, level: float) -> int:
    """The lowest cutoff certified from the mildest downwards; OFF if there is none.

    ``above[c]`` is how many good documents score over ``c``.
    """
    chosen = OFF
    for cutoff in range(OFF - 1, -1, -1):
        if n == 0 or binomial_cdf(int(above[cutoff]), n, risk) > level:
            break
        chosen = cutoff
    return chosen


def cutoffs(
    counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """One row per stratum with good labels: stratum, limits (a cutoff per rule).

    ``counted`` has doc_id, the stratum and COUNTS; ``labels`` has doc_id and quality (1 is
    good). What reaches one task is at most 101 bins per rule of one stratum.
    """
    good = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    ).select("doc_id")
    binned = (
        counted.filter(~base_failed())
        .select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), scores().alias("score"))
        .join(good, "doc_id", "left_semi")
        .select("stratum", F.posexplode("score").alias("rule", "bin"))
        .groupBy("stratum", "rule", "bin")
        .agg(F.count("*").alias("n"))
    )
    binned = cut_lineage(binned)
    strata = binned.select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    rules = len(RULES)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        level = error / (rules * int(frame["strata"].iloc[0]))
        limits = []
        for rule in range(rules):
            part = frame[frame["rule"] == rule]
            bins = np.bincount(part["bin"], weights=part["n"], minlength=OFF + 1)
            above = bins.sum() - np.cumsum(bins)
            limits.append(certified(above, int(bins.sum()), risk / rules, level))
        return pd.DataFrame({"stratum": [frame["stratum"].iloc[0]], "limits": [limits]})

    # one row, so the join needs no shuffle
    return binned.join(F.broadcast(strata)).groupBy("stratum").applyInPandas(choose, "stratum string, limits array<int>")


def judge(counted: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add base_failed and kept to counted documents. Columns of ``counted`` stay."""
    held = limits.select(F.col("stratum").alias("_stratum"), F.col("limits").alias("_limits"))
    over = F.exists(F.arrays_zip(scores().alias("s"), F.col("_limits").alias("l")), lambda z: z["s"] > z["l"])
    return (
        counted.join(held, F.coalesce(counted[stratum], F.lit("")) == F.col("_stratum"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))
        .drop("_stratum", "_limits")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, lang, counts, base_failed and kept of every document, the text read once."""
    counted = cut_lineage(with_counts(docs.select("doc_id", "lang", "text")).drop("text"))
    return judge(counted, cut_lineage(cutoffs(counted, labels, risk=risk, error=error)))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that are kept, with their own columns. Texts are counted twice rather
    than shuffled to meet their verdicts."""
    own = docs.columns
    narrow = docs.select("doc_id", "lang", "text")
    limits = cut_lineage(cutoffs(with_counts(narrow).drop("text"), labels, risk=risk, error=error))
    whole = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), "lang", "text")
    return judge(with_counts(whole), limits).filter("kept").select("_row.*")
